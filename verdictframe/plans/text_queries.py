"""Text matching, passage edits, leakage and request rendering over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import scalars as S
from verdictframe.functions import text as X
from verdictframe.operators import edits as E
from verdictframe.operators import labels as L
from verdictframe.operators import review as R
from verdictframe.operators import status as ST
from verdictframe.plans import tables as T
from verdictframe.plans.registry import query

norm = T.norm_sql


def _alternation(markers) -> str:
    return X.marker_pattern(markers).replace("'", "''")


@query("normalize_text", f"SELECT doc_id, length({norm('text')}) AS n, md5({norm('text')}) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select("doc_id", X.normalize("text").alias("t"))
    return docs.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


VALUES_SQL = f"""SELECT doc_id, lang, source, text, {norm('text')} AS a, string_split({norm('text')}, ' ')[(doc_id % 60 + 1)::int] AS original_value,
  CASE lang WHEN 'en' THEN 'THE' WHEN 'fr' THEN 'Les' WHEN 'de' THEN 'Der' ELSE 'Que' END AS perturbed_value, doc_id % 11 = 0 AS is_refusal FROM documents"""


def _valued(spark, sf_dir):
    """Documents as answers: a word of the text or nothing as one value, a common word as the other."""
    docs = T.table(spark, sf_dir, "documents")
    words = F.split(X.normalize("text"), " ")
    common = (
        F.when(F.col("lang") == "en", "THE").when(F.col("lang") == "fr", "Les").when(F.col("lang") == "de", "Der").otherwise("Que")
    )
    return docs.withColumns(
        {
            "original_value": F.get(words, (F.col("doc_id") % 60).cast("int")),
            "perturbed_value": common,
            "is_refusal": F.col("doc_id") % 11 == 0,
        }
    )


@query(
    "norm_contains",
    f"""SELECT lang, count(*) FILTER (coalesce({norm('original_value')}, '') <> '' AND contains(a, {norm('original_value')})) AS has_original,
  count(*) FILTER (contains(a, {norm('perturbed_value')})) AS has_perturbed, count(*) AS n FROM ({VALUES_SQL}) GROUP BY lang""",
)
def norm_contains(spark, sf_dir):
    return _valued(spark, sf_dir).groupBy("lang").agg(
        F.count_if(X.norm_contains("text", "original_value")).alias("has_original"),
        F.count_if(X.norm_contains("text", "perturbed_value")).alias("has_perturbed"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "behavior_label",
    f"""WITH x AS (SELECT doc_id, is_refusal, {norm('original_value')} AS o, {norm('perturbed_value')} AS p, a, lower(text) AS t FROM ({VALUES_SQL})),
y AS (SELECT *, o <> '' AND contains(a, o) AS ho, p <> '' AND contains(a, p) AS hp FROM x)
SELECT doc_id, CASE WHEN is_refusal THEN 'refusal_or_insufficient' WHEN ho AND hp THEN 'both_claims' WHEN hp THEN 'context_follow'
  WHEN ho THEN 'memory_override' WHEN regexp_matches(t, '{_alternation(X.CONFLICT_MARKERS)}') THEN 'conflict_awareness'
  WHEN regexp_matches(t, '{_alternation(X.REFUSAL_MARKERS)}') THEN 'refusal_or_insufficient' ELSE 'unrelated_or_failed' END AS label,
  NOT is_refusal AND ho AS entails_original, NOT is_refusal AND hp AS entails_perturbed FROM y""",
)
def behavior_label(spark, sf_dir):
    label = X.behavior_label("text", "original_value", "perturbed_value", "is_refusal")
    return _valued(spark, sf_dir).select("doc_id", label.alias("b")).select("doc_id", "b.*")


MARKED = "CASE WHEN {i} % 5 = 0 THEN '{a}' WHEN {i} % 5 = 1 THEN '{b}' WHEN {i} % 5 = 2 THEN '{c}' ELSE '' END"
PHRASES = ["However, sources differ. ", "There is NO information here. ", "The PASSAGE does not say. "]


@query(
    "marker_tests",
    f"""WITH x AS (SELECT conv_id, turn, {MARKED.format(i='(conv_id + turn)', a=PHRASES[0], b=PHRASES[1], c=PHRASES[2])} || text AS t FROM conversations)
SELECT conv_id, turn, regexp_matches(lower(t), '{_alternation(X.CONFLICT_MARKERS)}') AS conflict,
  regexp_matches(lower(t), '{_alternation(X.REFUSAL_MARKERS)}') AS refusal, regexp_matches(lower(t), '{_alternation(X.META_MARKERS)}') AS meta FROM x""",
)
def marker_tests(spark, sf_dir):
    conv = T.table(spark, sf_dir, "conversations")
    lead = F.coalesce(T.pick((F.col("conv_id") + F.col("turn")) % 5, PHRASES), F.lit(""))
    return conv.withColumn("t", F.concat(lead, "text")).select(
        "conv_id",
        "turn",
        X.has_marker("t", X.CONFLICT_MARKERS).alias("conflict"),
        X.has_marker("t", X.REFUSAL_MARKERS).alias("refusal"),
        X.has_marker("t", X.META_MARKERS).alias("meta"),
    )


REASONS = [
    "Passage 3 still contains the value",
    "contextual ANCHORS remain",
    "deterministic_leakage:[1]",
    "would not change the answer",
    "implausible value",
    "type_valid is false",
]


def _reason_case() -> str:
    arms = " ".join(f"WHEN contains(lower(r), '{k}') THEN '{v}'" for v, k in X.REASON_KEYWORDS)
    return f"CASE {arms} ELSE 'other' END"


@query(
    "reason_clusters",
    f"""WITH x AS (SELECT unnest(string_split(text, chr(10))) AS line, doc_id FROM documents),
y AS (SELECT coalesce([{', '.join(repr(r) for r in REASONS)}][(doc_id % 9 + 1)::int], '') || ' ' || line AS r FROM x)
SELECT {_reason_case()} AS cluster, count(*) AS n FROM y GROUP BY 1 ORDER BY n DESC, cluster LIMIT 10""",
)
def reason_clusters(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    lead = F.coalesce(T.pick(F.col("doc_id") % 9, REASONS), F.lit(""))
    lines = F.transform(F.split("text", "\n"), lambda s: F.concat(F.col("lead"), F.lit(" "), s))
    return ST.reason_clusters(docs.withColumn("lead", lead).select(lines.alias("rejection_reasons")))


@query(
    "reason_buckets",
    f"""WITH y AS (SELECT doc_id, coalesce([{', '.join(repr(r) for r in REASONS)}][(doc_id % 9 + 1)::int], '') || ' ' || text AS r FROM documents)
SELECT doc_id, {_reason_case()} AS cluster FROM y""",
)
def reason_buckets(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    lead = F.coalesce(T.pick(F.col("doc_id") % 9, REASONS), F.lit(""))
    return docs.select("doc_id", X.bucket_reason(F.concat(lead, F.lit(" "), "text")).alias("cluster"))


@query(
    "record_search",
    "SELECT page_id FROM pages WHERE contains(lower(url), 'example.org/de') OR contains(lower(html), 'example.org/de')",
)
def record_search(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").where(X.search(["url", "html"], " Example.ORG/de ")).select("page_id")


@query(
    "clip_and_truncate",
    """SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN left(text, 997) || '...' ELSE text END) AS clipped,
  length(left(text, 240)) AS n240, md5(left(text, 600)) AS head600 FROM documents""",
)
def clip_and_truncate(spark, sf_dir):
    """Report columns that are clipped by definition; matching elsewhere uses the whole text."""
    docs = T.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.md5(X.clip("text", 1000)).alias("clipped"),
        F.length(X.truncate("text", 240)).cast("bigint").alias("n240"),
        F.md5(X.truncate("text", 600)).alias("head600"),
    )


@query(
    "stable_ids",
    "SELECT doc_id, 'garage_core_' || left(sha1(doc_id::varchar), 12) AS core_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), lang) AS first_value FROM documents",
)
def stable_ids(spark, sf_dir):
    blank = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return T.table(spark, sf_dir, "documents").select(
        "doc_id",
        S.stable_id(F.col("doc_id").cast("string"), "garage_core_").alias("core_id"),
        S.first_nonblank(blank, "lang").alias("first_value"),
    )


@query(
    "event_scalars",
    """WITH t AS (SELECT event_id, epoch_us(ts) / 1e6 AS s, value FROM events)
SELECT event_id, strftime(make_timestamp((s::bigint) * 1000000), '%Y-%m-%d %H:%M') AS minute,
  trunc((s + value - s) * 1000)::bigint AS latency_ms, round(value * 1000 / 3600000, 9) AS hours FROM (SELECT event_id, floor(s) AS s, value FROM t)""",
)
def event_scalars(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").select(
        "event_id", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("double").alias("s")
    )
    return events.select(
        "event_id",
        S.epoch_minute("s").alias("minute"),
        S.latency_ms("s", F.col("s") + F.col("value")).alias("latency_ms"),
        F.round(S.ms_to_hours(F.col("value") * 1000), 9).alias("hours"),
    )


# ---- passages ---------------------------------------------------------------------------------


@query(
    "passage_explode",
    f"SELECT core_id, passage_id::int AS passage_id, length(text) AS n, md5(text) AS digest FROM ({T.DOC_PASSAGES})",
)
def passage_explode(spark, sf_dir):
    p = T.doc_passages(spark, sf_dir, labels=False)
    return p.select("core_id", "passage_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query(
    "leakage_scan",
    f"""WITH p AS ({T.DOC_PASSAGES}), l AS (SELECT core_id, passage_id FROM p
  WHERE {norm('original_value')} <> '' AND contains({norm('text')}, {norm('original_value')}))
SELECT doc_id AS core_id, coalesce('failed:leakage:[' || string_agg(passage_id::varchar, ', ' ORDER BY passage_id) || ']', 'ok') AS status
FROM documents LEFT JOIN l ON core_id = doc_id GROUP BY doc_id""",
)
def leakage_scan(spark, sf_dir):
    """Status of every document by whether its first word still occurs, from whole nested records."""
    docs = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("core_id"),
        F.split(X.normalize("text"), " ")[0].alias("original_value"),
        F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("passage_id"), t.alias("text"))).alias("p"),
    )
    found = docs.withColumn("ids", E.leaked_ids("p", "original_value"))
    return found.select("core_id", E.leakage_status("ids").alias("status"))


EDITS_SQL = f"""WITH p AS ({T.DOC_PASSAGES}),
e AS (SELECT core_id, passage_id, passage_id % 2 = 0 AS was_modified, 'edited ' || text AS modified_text FROM p WHERE sent AND (core_id + passage_id) % 3 <> 0),
j AS (SELECT p.*, coalesce(e.was_modified, false) AND length(e.modified_text) > 0 AS edited, e.modified_text FROM p LEFT JOIN e USING (core_id, passage_id)),
k AS (SELECT *, NOT edited AND NOT sent AND {norm('original_value')} <> '' AND contains({norm('text')}, {norm('original_value')}) AS backstop FROM j),
x AS (SELECT *, CASE WHEN edited THEN modified_text WHEN backstop THEN
  regexp_replace(text, regexp_escape(original_value), replace(perturbed_value, '\\', '\\\\'), 'gi') ELSE text END AS perturbed_text FROM k)"""


def _edited(spark, sf_dir):
    passages = T.doc_passages(spark, sf_dir)
    wanted = F.col("sent") & ((F.col("core_id") + F.col("passage_id")) % 3 != 0)
    edits = passages.where(wanted).select(
        "core_id", "passage_id", (F.col("passage_id") % 2 == 0).alias("was_modified"), F.concat(F.lit("edited "), "text").alias("modified_text"),
        F.lit("o").alias("original_span"), F.lit("p").alias("perturbed_span"),
    )
    return passages, edits


@query(
    "backstop_replace",
    EDITS_SQL + " SELECT core_id, passage_id::int AS passage_id, edited OR backstop AS modified, backstop, md5(perturbed_text) AS digest FROM x",
)
def backstop_replace(spark, sf_dir):
    passages, edits = _edited(spark, sf_dir)
    out = E.apply_edits(passages, edits, ["core_id"])
    return out.select("core_id", "passage_id", "modified", "backstop", F.md5("perturbed_text").alias("digest"))


@query(
    "edit_status",
    EDITS_SQL
    + f""", s AS (SELECT core_id, string_agg(passage_id::varchar, ', ' ORDER BY passage_id) FILTER ({norm('original_value')} <> ''
    AND contains({norm('perturbed_text')}, {norm('original_value')})) AS leaked,
  string_agg(passage_id::varchar, ', ' ORDER BY passage_id) FILTER (sent AND (core_id + passage_id) % 3 = 0) AS missing FROM x GROUP BY core_id)
SELECT core_id, CASE WHEN leaked IS NOT NULL THEN 'failed:leakage:[' || leaked || ']'
  WHEN missing IS NOT NULL THEN 'failed:missing_doc_entries:[' || missing || ']' ELSE 'ok' END AS status FROM s""",
)
def edit_status(spark, sf_dir):
    passages, edits = _edited(spark, sf_dir)
    out = E.apply_edits(passages, edits, ["core_id"])
    listed = edits.select("core_id", "passage_id", F.lit(True).alias("listed"))
    both = out.join(listed, ["core_id", "passage_id"], "left")

    def ids(keep):
        return F.sort_array(F.collect_list(F.when(keep, F.col("passage_id"))))  # ids of one record

    per = both.groupBy("core_id").agg(
        ids(E.leaks("perturbed_text", "original_value")).alias("leaked"),
        ids(F.col("sent")).alias("sent_ids"),
        ids(F.col("listed")).alias("listed_ids"),
    )
    return per.select("core_id", E.edit_status("leaked", E.missing_entries("sent_ids", "listed_ids")).alias("status"))


@query(
    "passage_diff",
    EDITS_SQL
    + """ SELECT core_id, passage_id::int AS passage_id, coalesce(evidence_correct, 'UNLABELED') AS label, evidence_cited AS cited,
  length(text) AS n_original, md5(perturbed_text) AS perturbed, edited OR backstop AS was_modified,
  CASE WHEN modified_text IS NOT NULL THEN 'o' END AS original_span, CASE WHEN modified_text IS NOT NULL THEN 'p' END AS perturbed_span FROM x""",
)
def passage_diff(spark, sf_dir):
    passages, edits = _edited(spark, sf_dir)
    changed = E.apply_edits(passages, edits, ["core_id"]).where("modified").select(
        "core_id", "passage_id", F.col("perturbed_text").alias("text"), F.col("modified").alias("was_modified")
    )
    out = E.passage_diffs(passages, changed, edits)
    return out.select(
        "core_id", "passage_id", "label", "cited", F.length("original_text").cast("bigint").alias("n_original"),
        F.md5("perturbed_text").alias("perturbed"), "was_modified", "original_span", "perturbed_span",
    )


@query(
    "modified_detail",
    EDITS_SQL
    + """, m AS (SELECT core_id, passage_id, row_number() OVER (PARTITION BY core_id ORDER BY passage_id) - 1 AS pos, text, perturbed_text,
  modified_text, was FROM (SELECT x.*, (SELECT any_value(e.was_modified) FROM e WHERE e.core_id = x.core_id AND e.passage_id = x.passage_id) AS was FROM x) WHERE edited OR backstop)
SELECT core_id, passage_id::int AS passage_id, pos::int AS pos, md5(text) AS original, md5(perturbed_text) AS perturbed, CASE WHEN was THEN 'o' END AS original_span FROM m""",
)
def modified_detail(spark, sf_dir):
    passages, edits = _edited(spark, sf_dir)
    out = E.apply_edits(passages, edits, ["core_id"])
    changed = out.where("modified")
    records = changed.groupBy("core_id").agg(F.sort_array(F.collect_list("passage_id")).alias("modified_passage_ids"))
    perturbed = out.select("core_id", "passage_id", F.col("perturbed_text").alias("text"))
    detail = E.modified_detail(records, passages, perturbed, edits)
    return detail.select(
        "core_id", "passage_id", "pos", F.md5("original_text").alias("original"),
        F.md5("perturbed_text").alias("perturbed"), "original_span",
    )


def _nested(spark, sf_dir):
    """Documents as records with an array of labelled passages."""
    def passage(t, i):
        kind = (F.col("doc_id") + i) % 4
        return F.struct(
            i.alias("passage_id"), t.alias("text"),
            T.pick(kind, ["ANSWER-THE-QUESTION", "related-information", "UNKNOWN"]).alias("evidence_correct"),
        )

    return T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("core_id"), F.transform(F.split("text", "\n"), passage).alias("p")
    )


@query(
    "render_requests",
    f"""WITH p AS ({T.DOC_PASSAGES}),
r AS (SELECT core_id, string_agg('[' || passage_id || '] ' || text, chr(10) || chr(10) ORDER BY passage_id) AS plain,
  string_agg('[' || passage_id || '] [' || upper(evidence_correct) || '] ' || text, chr(10) || chr(10) ORDER BY passage_id)
    FILTER ((core_id + passage_id) % 4 < 2) AS sent,
  string_agg('[' || passage_id || '] ' || text, chr(10) || chr(10) ORDER BY passage_id) FILTER (passage_id % 3 = 1) AS modified,
  string_agg('[' || passage_id || '] ' || text, chr(10) || chr(10) ORDER BY passage_id) FILTER (passage_id < 5) AS head FROM p GROUP BY core_id)
SELECT core_id, md5(plain) AS plain, md5(coalesce(sent, '')) AS sent, md5(coalesce(modified, head)) AS modified,
  md5('Q ' || core_id || chr(10) || coalesce(sent, '') || ' end') AS request FROM r""",
)
def render_requests(spark, sf_dir):
    records = _nested(spark, sf_dir)
    ids = F.transform(F.filter("p", lambda x: x["passage_id"] % 3 == 1), lambda x: x["passage_id"])
    sent = E.render_passages(E.passages_to_send("p"), with_label=True)
    return records.select(
        "core_id",
        F.md5(E.render_passages("p")).alias("plain"),
        F.md5(sent).alias("sent"),
        F.md5(E.render_modified("p", ids)).alias("modified"),
        F.md5(E.render_request("Q {core_id}\n{passages} end", core_id=F.col("core_id"), passages=sent)).alias("request"),
    )


@query(
    "grounding_by_mode",
    f"""WITH p AS (SELECT core_id, count(*) AS n FROM ({T.DOC_PASSAGES}) GROUP BY core_id), m(mode) AS (VALUES ('rag_perturbed'), ('rag_original'), ('closed_book'))
SELECT core_id, mode, CASE mode WHEN 'closed_book' THEN 0 WHEN 'rag_original' THEN n ELSE CASE WHEN core_id % 2 = 0 THEN n END END::int AS passages FROM p CROSS JOIN m""",
)
def grounding_by_mode(spark, sf_dir):
    modes = F.array(*[F.lit(m) for m in ("rag_perturbed", "rag_original", "closed_book")])
    records = _nested(spark, sf_dir).withColumns(
        {
            "q": F.when(F.col("core_id") % 2 == 0, F.col("p")).otherwise(F.slice("p", 1, 0)),
            "mode": F.explode(modes),
        }
    )
    chosen = E.select_grounding("mode", "p", "q", closed_book=F.slice("p", 1, 0))
    return records.select("core_id", "mode", F.when(chosen.isNotNull(), F.size(chosen)).alias("passages"))


@query(
    "localization",
    f"""WITH v AS ({T.DOC_VERDICTS}), x AS (SELECT *, string_split({norm('text')}, ' ')[(core_id % 60 + 1)::int] AS value,
  CASE WHEN core_id % 5 <> 0 THEN core_id % 7 END AS passage FROM v WHERE gold AND pred),
f AS (SELECT judge, generator, length(value) > 0 AND length(text) > 0 AS stated, contains({norm('text')}, {norm('value')}) AS hit,
  passage IS NOT NULL AS named, coalesce(passage IN (core_id % 3, 5), false) AS inside FROM x),
c AS (SELECT judge, generator, count(*) AS tp, count(*) FILTER (stated AND hit) AS claim_hits, count(*) FILTER (stated) AS claim_n,
  count(*) FILTER (named AND inside) AS passage_hits, count(*) FILTER (named) AS passage_n FROM f GROUP BY judge, generator)
SELECT *, CASE WHEN claim_n > 0 THEN round(1e2 * claim_hits / claim_n, 6) END AS claim_pct,
  CASE WHEN passage_n > 0 THEN round(1e2 * passage_hits / passage_n, 6) END AS passage_pct FROM c""",
)
def localization(spark, sf_dir):
    rows = T.doc_verdicts(spark, sf_dir).withColumns(
        {
            "perturbed_value": F.get(F.split(X.normalize("text"), " "), (F.col("core_id") % 60).cast("int")),
            "supporting_source_passage_id": F.when(F.col("core_id") % 5 != 0, (F.col("core_id") % 7).cast("int")),
            "modified_passage_ids": F.array((F.col("core_id") % 3).cast("int"), F.lit(5)),
        }
    )
    out = L.localization(rows, ["judge", "generator"], claim="text")
    return out.withColumns({c: F.round(c, 6) for c in ("claim_pct", "passage_pct")})


@query(
    "localization_flags",
    f"""WITH x AS (SELECT judge, core_id, text, string_split({norm('text')}, ' ')[(core_id % 60 + 1)::int] AS value,
  CASE WHEN core_id % 5 <> 0 THEN core_id % 7 END AS passage FROM ({T.DOC_VERDICTS}))
SELECT judge, core_id, CASE WHEN length(value) > 0 AND length(text) > 0 THEN {norm('value')} <> '' AND contains({norm('text')}, {norm('value')}) END AS target_match,
  CASE WHEN passage IS NOT NULL THEN passage IN (core_id % 3, 5) END AS localization_match FROM x""",
)
def localization_flags(spark, sf_dir):
    rows = T.doc_verdicts(spark, sf_dir).withColumns(
        {
            "value": F.get(F.split(X.normalize("text"), " "), (F.col("core_id") % 60).cast("int")),
            "passage": F.when(F.col("core_id") % 5 != 0, (F.col("core_id") % 7).cast("int")),
            "modified": F.array((F.col("core_id") % 3).cast("int"), F.lit(5)),
        }
    )
    target, place = L.localization_flags("text", "value", "passage", "modified")
    return rows.select("judge", "core_id", target.alias("target_match"), place.alias("localization_match"))


@query(
    "review_cases",
    f"""WITH v AS (SELECT * , CASE core_id % 3 WHEN 0 THEN 'refusal_or_insufficient' WHEN 1 THEN 'conflict_awareness' END AS label FROM ({T.DOC_VERDICTS})),
c AS (SELECT *, CASE WHEN gold AND pred THEN 'TP' WHEN gold THEN 'FN' WHEN pred THEN 'FP' ELSE 'TN' END AS cell FROM v)
SELECT judge || '-on-' || generator || '__' || core_id AS case_id, cell,
  CASE cell WHEN 'TP' THEN 'true_positive' WHEN 'FP' THEN 'apparent_fp' WHEN 'FN' THEN 'false_negative' ELSE 'true_negative' END AS category,
  CASE WHEN cell = 'FP' AND label IS NOT NULL THEN CASE WHEN regexp_matches(lower(text), '{_alternation(X.META_MARKERS)}')
    THEN 'likely_artifact' ELSE 'substantive_claim' END ELSE '' END AS artifact,
  md5(CASE WHEN length(text) > 1000 THEN left(text, 997) || '...' ELSE text END) AS supporting FROM c""",
)
def review_cases(spark, sf_dir):
    rows = T.doc_verdicts(spark, sf_dir).withColumns(
        {
            "cell": S.confusion_cell("gold", "pred"),
            "label": T.pick(F.col("core_id") % 3, ["refusal_or_insufficient", "conflict_awareness"]),
        }
    )
    return rows.select(
        R.case_id("judge", "generator", "core_id").alias("case_id"),
        "cell",
        R.category("gold", "pred").alias("category"),
        R.artifact_tag("cell", "label", "text").alias("artifact"),
        F.md5(R.supporting_text("text")).alias("supporting"),
    )


@query(
    "flag_audit_artifacts",
    f"""WITH v AS (SELECT judge, core_id, gold, pred, text || CASE WHEN core_id % 3 = 0 THEN ' They Do Not Specify it' ELSE '' END AS claim, CASE core_id % 2 WHEN 0 THEN 'refusal_or_insufficient' ELSE 'conflict_awareness' END AS label FROM ({T.DOC_VERDICTS}))
SELECT judge, core_id, CASE WHEN pred AND NOT gold THEN CASE WHEN regexp_matches(lower(claim), '{_alternation(X.META_MARKERS)}') THEN 'likely_artifact' ELSE 'substantive_claim' END ELSE '' END AS review_tag,
  CASE WHEN pred AND NOT gold THEN CASE WHEN regexp_matches(lower(claim), '{_alternation(X.META_MARKERS_FLAG_AUDIT)}') THEN 'likely_artifact' ELSE 'substantive_claim' END ELSE '' END AS flag_audit_tag FROM v""",
)
def flag_audit_artifacts(spark, sf_dir):
    """The review's markers beside those of the flag audit, which know one phrase more."""
    rows = T.doc_verdicts(spark, sf_dir).withColumns(
        {
            "cell": S.confusion_cell("gold", "pred"),
            "claim": F.concat("text", F.when(F.col("core_id") % 3 == 0, " They Do Not Specify it").otherwise("")),
            "label": F.when(F.col("core_id") % 2 == 0, "refusal_or_insufficient").otherwise("conflict_awareness"),
        }
    )
    tags = {"review_tag": X.META_MARKERS, "flag_audit_tag": X.META_MARKERS_FLAG_AUDIT}
    return rows.select("judge", "core_id", *[R.artifact_tag("cell", "label", "claim", markers).alias(name) for name, markers in tags.items()])


@query(
    "example_match",
    f"""WITH e AS (SELECT 'c' || (item_id % 4) AS cell, {norm('text')} AS wq FROM benchmark),
c AS (SELECT doc_id AS case_id, 'c' || (doc_id % 4) AS cell, {norm('text')} AS cq FROM documents)
SELECT DISTINCT case_id FROM c JOIN (SELECT cell, trim(wq) AS wq FROM e) USING (cell) WHERE starts_with(cq, wq) OR starts_with(wq, cq)""",
)
def example_match(spark, sf_dir):
    """Cases whose question begins with an example's whole question, or is the beginning of it."""
    examples = T.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string")).alias("cell"),
        F.col("text").alias("question"),
    )
    cases = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("case_id"), F.concat(F.lit("c"), (F.col("doc_id") % 4).cast("string")).alias("cell"),
        F.col("text").alias("question"),
    )
    return R.match_examples(cases, examples)
