"""Raw-record gates, model responses, status and label reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verdictframe.functions import jsonvals as J
from verdictframe.functions import scalars as S
from verdictframe.operators import edits as E
from verdictframe.operators import labels as L
from verdictframe.operators import raw as RAW
from verdictframe.operators import responses as RS
from verdictframe.operators import status as ST
from verdictframe.operators import steps as STEPS
from verdictframe.operators.history import overlap
from verdictframe.plans import tables as T
from verdictframe.plans.registry import query, round_columns
from verdictframe.schemas import GATES
from verdictframe.session import ensure_checkpoint_dir
from verdictframe.sources import records as SRC

# ---- raw records ------------------------------------------------------------------------------
# Each document becomes one raw JSON line. Keys are absent, null, boolean, number or text by the
# document id, and evidence labels sit in a parallel array (sometimes too short) or in passages.

SEEKING = ['', '"question_seeking":null,', '"question_seeking":"Yes ",', '"question_seeking":false,', '"question_seeking":1,']
VALID = ['true', '"TRUE"', '1', '"2"', 'null', '"no"', '2.5']
PREMISE = ['', '"question_false_premise":false,', '"question_false_premise":null,', '"question_false_premise":"true",']
CHECKED = ['', '"answer_validate":true,', '"answer_validate":null,']
IDS = ['"sample_id":"s{}",', '"sample_id":null,"id":{},', '"sample_id":"","question_id":"q{}",', '']


def _choose(i, values):
    return T.pick(i % len(values), values)


def raw_lines(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    ids = F.replace(_choose(i, IDS), F.lit("{}"), i.cast("string"))
    lines = F.split("text", "\n")

    def tag(p):
        return F.when((i + p) % 3 == 0, F.lit('"answer-the-question"')).when((i + p) % 3 == 1, F.lit('"ANSWER-THE-QUESTION"')).otherwise(F.lit("null"))

    def passage(t, p):
        body = F.coalesce(
            F.when((i + p) % 4 == 0, F.concat(F.lit('"text":'), _quote(t), F.lit(","))),
            F.when((i + p) % 4 == 1, F.concat(F.lit('"cite_950":" ","cite_'), (p + 1).cast("string"), F.lit('":'), _quote(t), F.lit(","))),
            F.when((i + p) % 4 == 2, F.concat(F.lit('"text":"","cite_900":"  ","cite_901":'), _quote(t), F.lit(","))),
            F.lit('"text":7,'),
        )
        label = F.when(i % 2 == 0, F.concat(F.lit('"evidence_correct":'), tag(p), F.lit(","))).otherwise("")
        return F.concat(F.lit("{"), body, label, F.lit('"evidence_cited":"yes","passage_id":'), (p + 10).cast("string"), F.lit("}"))

    top = F.transform(F.filter(lines, lambda t, p: p < F.size(lines) - (i % 3)), lambda t, p: tag(p))
    array = F.when(i % 2 == 1, F.concat(F.lit('"evidence_correct":['), F.array_join(top, ","), F.lit("],"))).otherwise("")
    text = F.concat(
        F.lit("{"), ids,
        F.lit('"question_valid":'), _choose(i, VALID), F.lit(","),
        _choose(i, SEEKING), _choose(i, PREMISE), _choose(i, CHECKED), array,
        F.lit('"question":"Q","question_category":"'), F.col("lang"), F.lit('","question_popularity":"'), F.col("source"),
        F.lit('","answer":"A","grounding":['), F.array_join(F.transform(lines, passage), ","), F.lit("]}"),
    )
    return d.select("doc_id", text.alias("line"))


def _quote(t):
    """A JSON string literal."""
    wrapped = F.to_json(F.struct(t.alias("v")))  # {"v":"..."}
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def raw_records(spark, sf_dir):
    return raw_lines(spark, sf_dir).select("doc_id", "line", F.parse_json("line").alias("raw"))


RAW_SQL = """SELECT doc_id, lang, source, i0 - 1 AS p, lines[i0] AS text, len(lines) AS n FROM
  (SELECT doc_id, lang, source, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i0 FROM documents)"""
GATED_SQL = f"""WITH p AS ({RAW_SQL}),
t AS (SELECT doc_id, any_value(n) AS n,
  count(*) FILTER (CASE WHEN doc_id % 2 = 1 THEN p < n - doc_id % 3 ELSE true END AND (doc_id + p) % 3 < 2) AS tagged FROM p GROUP BY doc_id),
g AS (SELECT doc_id, tagged, doc_id % 7 IN (0, 1, 2, 6) AS valid, doc_id % 5 IN (0, 2, 4) AS seeking, doc_id % 4 = 3 AS premise, doc_id % 3 <> 2 AS checked FROM t)"""


@query(
    "eligibility_gate",
    GATED_SQL + " SELECT doc_id, tagged::int AS answer_passages, valid AND seeking AND NOT premise AND checked AND tagged >= 2 AS eligible FROM g",
)
def eligibility_gate(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    return raw.select(
        "doc_id",
        RAW.count_answer_passages(F.col("raw")).alias("answer_passages"),
        RAW.passes_gates(F.col("raw")).alias("eligible"),
    )


@query(
    "core_projection",
    GATED_SQL
    + """, s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 's' || doc_id WHEN 1 THEN doc_id::varchar WHEN 2 THEN 'q' || doc_id ELSE '' END AS sid FROM g
  WHERE valid AND seeking AND NOT premise AND checked AND tagged >= 2)
SELECT 'garage_core_' || left(sha1(sid), 12) AS core_id, sid AS garage_sample_id, lang AS question_category, source AS question_popularity,
  'A' AS answer_generate, any_value(n)::int AS passages,
  md5(string_agg(CASE (doc_id + p) % 4 WHEN 0 THEN text WHEN 1 THEN CASE WHEN trim(text) <> '' THEN text ELSE '' END
    WHEN 2 THEN CASE WHEN trim(text) <> '' THEN text ELSE '' END ELSE '' END, chr(10) ORDER BY p)) AS texts,
  coalesce(string_agg((p + 10)::varchar, ',' ORDER BY p) FILTER (((doc_id % 2 = 1 AND p < n - doc_id % 3) OR doc_id % 2 = 0) AND (doc_id + p) % 3 < 2), '') AS answer_ids,
  bool_or(((doc_id % 2 = 1 AND p < n - doc_id % 3) OR doc_id % 2 = 0) AND (doc_id + p) % 3 < 2) AS has_cited_answer
FROM s JOIN p USING (doc_id) GROUP BY doc_id, sid, lang, source""",
)
def core_projection(spark, sf_dir):
    core = RAW.select_raw(raw_records(spark, sf_dir), line="line")
    texts = F.transform("all_grounding_original", lambda p: p["text"])
    ids = F.transform("answer_containing_passage_ids", lambda x: x.cast("string"))
    return core.select(
        "core_id", "garage_sample_id", "question_category", "question_popularity", "answer_generate",
        F.size("all_grounding_original").alias("passages"),
        F.md5(F.array_join(texts, "\n")).alias("texts"),
        F.array_join(ids, ",").alias("answer_ids"),
        RAW.has_cited_answer().alias("has_cited_answer"),
    )


@query(
    "citation_slots",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'two' WHEN 1 THEN 'own' WHEN 2 THEN lang ELSE source END AS first_text,
  CASE doc_id % 4 WHEN 0 THEN 'ten' WHEN 1 THEN 'ten' WHEN 2 THEN '' ELSE 'two' END AS second_text FROM documents""",
)
def citation_slots(spark, sf_dir):
    """Landed raw lines whose citation slots are out of order by name: the slot of the position, else the first in the file."""
    i, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    slots = (
        F.when(i % 4 == 0, '[{"cite_02":" ","cite_2":"two","cite_10":"ten"},{"cite_10":"ten","cite_3":"three"}]')
        .when(i % 4 == 1, '[{"cite_9":"nine","cite_1":"own"},{"cite_2":null,"cite_10":"ten","cite_1":"one"}]')
        .when(i % 4 == 2, F.concat(F.lit('[{"text":"","cite_7":"'), lang, F.lit('","cite_30":"later"},{"cite_2":5,"cite_3":" "}]')))
        .otherwise(F.concat(F.lit('[{"text":7,"cite_5":false,"cite_4":"'), source, F.lit('","cite_20":"later"},{"cite_1":"one","cite_2":"two"}]')))
    )
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    line = F.concat(F.lit('{"sample_id":"'), i.cast("string"), F.lit('","grounding":'), slots, F.lit("}"))
    T.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(folder)
    core = RAW.to_core(SRC.read_raw_lines(spark, folder), line="line")
    text = lambda at: F.col("all_grounding_original")[at]["text"]
    return core.select(F.col("garage_sample_id").cast("bigint").alias("doc_id"), text(0).alias("first_text"), text(1).alias("second_text"))


# ---- validation, status -----------------------------------------------------------------------

GATE_COLUMNS_SQL = """SELECT doc_id, lang, source, quality, toxic, n_chars,
  CASE WHEN doc_id % 4 <> 0 THEN quality = 1 END AS type_valid, CASE WHEN doc_id % 4 <> 0 THEN toxic = 0 END AS answer_causal,
  CASE WHEN doc_id % 4 <> 0 AND doc_id % 9 <> 1 THEN n_chars > 100 END AS global_context_consistent,
  CASE WHEN doc_id % 4 <> 0 THEN lang <> 'es' END AS no_original_answer_leakage,
  CASE WHEN doc_id % 4 <> 0 THEN n_chars < 9000 END AS original_contradicts_perturbed FROM documents JOIN labels USING (doc_id)"""
ALL_GATES_SQL = " AND ".join(GATES)


def core_like(spark, sf_dir):
    """Labelled documents as core records: a validation struct, step states and provenance."""
    d = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id")
    on = F.col("doc_id") % 4 != 0
    gates = {
        "type_valid": F.col("quality") == 1,
        "answer_causal": F.col("toxic") == 0,
        "global_context_consistent": F.when(F.col("doc_id") % 9 != 1, F.col("n_chars") > 100),
        "no_original_answer_leakage": F.col("lang") != "es",
        "original_contradicts_perturbed": F.col("n_chars") < 9000,
    }
    rows = d.withColumns({g: F.when(on, c) for g, c in gates.items()})
    return rows.withColumns(
        {
            "validation": F.struct(*GATES),
            "pipeline_state": _states(),
            "generators": F.create_map(
                F.lit("perturb"), F.struct(F.when(F.col("doc_id") % 6 != 0, F.col("source")).alias("provider"), F.lit("m").alias("model"))
            ),
        }
    )


def _states():
    i = F.col("doc_id")
    status = _choose(i, ["ok", "ok_partial", "failed:no_json", "skipped:no_grounding", "ok"])
    full = F.create_map(
        F.lit("filter"), F.lit("ok"), F.lit("perturb"), _choose(i + 1, ["ok", "failed:leakage:[1]"]), F.lit("validate"), status
    )
    return F.map_filter(full, lambda k, v: (k != "validate") | (i % 7 != 0))


STATES_SQL = """SELECT doc_id, 'filter' AS step, 'ok' AS status FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'perturb', CASE WHEN (doc_id + 1) % 2 = 0 THEN 'ok' ELSE 'failed:leakage:[1]' END FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'validate', ['ok', 'ok_partial', 'failed:no_json', 'skipped:no_grounding', 'ok'][(doc_id % 5 + 1)::int] FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0"""


@query("gate_breakdown", f"WITH x AS (SELECT * FROM ({GATE_COLUMNS_SQL}) WHERE coalesce({', '.join(GATES)}) IS NOT NULL) "
    + " UNION ALL ".join(f"""SELECT '{g}' AS gate, count(*) FILTER ({g}) AS passed, count(*) FILTER (NOT {g}) AS failed,
  count(*) FILTER ({g} IS NULL) AS unset, round(coalesce(1e2 * count(*) FILTER ({g}) / nullif(count({g}), 0), 0), 6) AS pass_pct FROM x""" for g in GATES))
def gate_breakdown(spark, sf_dir):
    return round_columns(ST.gate_breakdown(core_like(spark, sf_dir)), "pass_pct")


@query("gate_failures", f"WITH x AS (SELECT * FROM ({GATE_COLUMNS_SQL}) WHERE NOT coalesce({ALL_GATES_SQL}, false)) "
    + " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER (NOT coalesce({g}, false)) AS failures FROM x" for g in GATES))
def gate_failures(spark, sf_dir):
    return ST.gate_failures(core_like(spark, sf_dir))


@query(
    "gate_predicates",
    f"""SELECT doc_id, coalesce({ALL_GATES_SQL}, false) AS passes,
  CASE WHEN {' AND '.join(f'{g} IS NOT NULL' for g in GATES)} THEN {ALL_GATES_SQL} END AS passes_or_unset FROM ({GATE_COLUMNS_SQL})""",
)
def gate_predicates(spark, sf_dir):
    return core_like(spark, sf_dir).select(
        "doc_id", S.gates_pass().alias("passes"), S.gates_pass_or_unset().alias("passes_or_unset")
    )


@query(
    "pass_rates",
    f"""SELECT 'gates' AS definition, count(*) FILTER (coalesce({ALL_GATES_SQL}, false)) AS passed, count(*) AS total,
  round(1e2 * count(*) FILTER (coalesce({ALL_GATES_SQL}, false)) / count(*), 6) AS pass_pct FROM ({GATE_COLUMNS_SQL})
UNION ALL SELECT 'state', count(*) FILTER (status = 'ok'), count(*), round(1e2 * count(*) FILTER (status = 'ok') / count(*), 6)
FROM ({STATES_SQL}) WHERE step = 'validate'""",
)
def pass_rates(spark, sf_dir):
    core = core_like(spark, sf_dir)
    both = ST.pass_rate(core).select(F.lit("gates").alias("definition"), "*").unionByName(
        ST.pass_rate(core, by_state=True).select(F.lit("state").alias("definition"), "*")
    )
    return round_columns(both, "pass_pct")


@query("status_counts", f"""SELECT step, status, count(*) AS n FROM ({STATES_SQL}) GROUP BY step, status
UNION ALL SELECT 'validate', 'unset', count(*) FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 = 0""")
def status_counts(spark, sf_dir):
    core = core_like(spark, sf_dir)
    steps = F.explode(F.array(*[F.lit(s) for s in ("filter", "perturb", "validate")]))
    rows = core.select("pipeline_state", steps.alias("step"))
    return ST.status_counts(rows, F.col("pipeline_state")[F.col("step")], ["step"])


@query(
    "step_stats",
    f"""SELECT step, count(*) AS records, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (starts_with(status, 'failed')) AS failed,
  count(*) FILTER (starts_with(status, 'skipped')) AS skipped FROM ({STATES_SQL}) GROUP BY step""",
)
def step_stats(spark, sf_dir):
    return ST.step_stats(ST.explode_state(core_like(spark, sf_dir), key="doc_id"))


@query(
    "latest_step",
    f"""SELECT doc_id, arg_max(step, o) AS step, arg_max(status, o) AS status FROM
  (SELECT *, CASE step WHEN 'filter' THEN 0 WHEN 'perturb' THEN 1 ELSE 2 END AS o FROM ({STATES_SQL})) GROUP BY doc_id""",
)
def latest_step(spark, sf_dir):
    return core_like(spark, sf_dir).select("doc_id", ST.latest_step("pipeline_state").alias("s")).select("doc_id", "s.*")


@query(
    "provider_breakdown",
    "SELECT CASE WHEN doc_id % 6 <> 0 THEN source ELSE 'unknown' END AS provider, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1",
)
def provider_breakdown(spark, sf_dir):
    return ST.provider_breakdown(core_like(spark, sf_dir), "perturb")


@query(
    "value_counts_topk",
    "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 7",
)
def value_counts_topk(spark, sf_dir):
    return ST.top_k(T.table(spark, sf_dir, "documents"), "source", 7)


@query(
    "strata_counts",
    "SELECT coalesce(CASE WHEN doc_id % 5 <> 0 THEN lang END, '?') || '/' || source AS stratum, count(*) AS n FROM documents GROUP BY 1",
)
def strata_counts(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    return ST.strata_counts(docs, ["lang", "source"])


KIND_NAMES = {"t0": "entity", "t1": "numerical", "t2": "numerical"}


@query(
    "composition_pivot",
    f"""WITH a AS (SELECT *, CASE kind WHEN 't0' THEN 'entity' WHEN 't1' THEN 'numerical' WHEN 't2' THEN 'numerical' ELSE kind END AS k FROM ({T.ANSWERS}))
SELECT coalesce(k, 'TOTAL') AS kind, count(*) FILTER (perturber = 'g0') AS n_g0, count(*) FILTER (perturber = 'g1') AS n_g1,
  count(*) FILTER (perturber = 'g2') AS n_g2, count(*) AS total, count(*) FILTER (is_validated) AS validated, count(*) FILTER (NOT is_validated) AS diagnostic
FROM a GROUP BY ROLLUP (k)""",
)
def composition_pivot(spark, sf_dir):
    return ST.composition(T.answers(spark, sf_dir), "kind", "perturber", T.JUDGES, "is_validated", KIND_NAMES)


@query(
    "input_counts",
    f"SELECT generator AS file, count(*) AS rows, count(DISTINCT core_id) AS unique_ids FROM ({T.ANSWERS}) GROUP BY generator",
)
def input_counts(spark, sf_dir):
    return ST.input_counts(T.answers(spark, sf_dir).withColumnRenamed("generator", "file"), "file", ["core_id"])


# ---- responses --------------------------------------------------------------------------------
# Each event becomes a model response: well-formed JSON with values of every type, or one of the
# ways a response goes wrong.

def responses(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    good = F.concat(
        F.lit('{"k":'), k.cast("string"),
        F.lit(',"verdict":"'), _choose(i, ["correct", "incorrect", "unclear", "maybe"]),
        F.lit('","contains_factual_error":'), _choose(k, ["true", "false", '"false"', "0", "1", "[]", '""', "null"]),
        F.lit(',"supporting_source_passage_id":'), _choose(i, ["3", '"12"', '"x"', "null", "2.7"]),
        F.lit(',"wrong_claim":'), F.when(k % 3 != 0, F.concat(F.lit('"'), F.repeat(F.col("event_type"), k.cast("int") * 4 + 1), F.lit('"'))).otherwise("null"),
        F.lit(',"confidence":"'), _choose(k, ["high", "sure", "low"]),
        F.lit('","cited_passage_ids":'), _choose(i, ['[1,"2",3.5,true,"-4","x"]', "[]", "null"]),
        F.lit(',"answer":"'), F.col("event_type"), F.lit('","is_refusal":'), _choose(k, ["false", "true"]), F.lit("}"),
    )
    text = (
        F.when(i % 11 == 1, F.concat(good, F.lit(" trailing")))
        .when(i % 11 == 2, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(i % 11 == 3, F.lit(""))
        .when(i % 11 == 4, F.lit("[]"))
        .when(i % 11 == 5, F.lit('[1, 2]'))
        .when(i % 11 == 6, F.concat(F.lit("  "), good, F.lit("\n")))
        .otherwise(good)
    )
    error = F.when(i % 13 == 0, F.lit("timeout"))
    return e.select("event_id", "event_type", k.alias("k"), text.alias("text"), error.alias("error"))


RESPONSES_SQL = """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 11 NOT IN (1, 2, 3, 4, 5) AS good, event_id % 13 = 0 AS failed FROM events"""


@query(
    "strict_json_parse",
    f"""SELECT CASE WHEN failed THEN 'call_failed' WHEN good THEN 'ok' WHEN event_id % 11 = 5 THEN 'unexpected' ELSE 'no_json' END AS response_status,
  count(*) AS n, sum(CASE WHEN good THEN k END)::bigint AS k FROM ({RESPONSES_SQL}) GROUP BY 1""",
)
def strict_json_parse(spark, sf_dir):
    parsed = RS.parse_responses(responses(spark, sf_dir).withColumnRenamed("k", "k0"))
    return parsed.groupBy("response_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(J.as_int(J.field(F.col("parsed"), "k"))).alias("k")
    )


@query(
    "verdict_fields",
    f"""SELECT event_id, ['correct', 'incorrect', 'unclear'][(event_id % 4 + 1)::int] AS verdict, k % 8 IN (0, 2, 4) AS contains_factual_error,
  [3, 12, NULL, NULL, 2][(event_id % 5 + 1)::int] AS supporting_source_passage_id,
  CASE WHEN k % 3 <> 0 THEN md5(left(repeat(event_type, (k * 4 + 1)::int), 600)) END AS wrong_claim,
  ['high', NULL, 'low'][(k % 3 + 1)::int] AS confidence FROM ({RESPONSES_SQL}) WHERE good AND NOT failed AND event_id % 4 <> 3""",
)
def verdict_fields(spark, sf_dir):
    answered = responses(spark, sf_dir).where(F.col("error").isNull())
    rows = answered.select("event_id", RS.verdict_fields(J.strict_json(F.trim("text"))).alias("v")).where(F.col("v").isNotNull())
    return rows.select(
        "event_id", "v.verdict", "v.contains_factual_error", "v.supporting_source_passage_id",
        F.md5("v.wrong_claim").alias("wrong_claim"), "v.confidence",
    )


@query(
    "answer_fields",
    f"""WITH x AS (SELECT *, good AND NOT failed AS ok, good AND NOT failed AND k % 2 = 1 AS refusal FROM ({RESPONSES_SQL}))
SELECT event_id, CASE WHEN ok THEN event_type ELSE '' END AS answer_text, refusal AS is_refusal,
  CASE WHEN ok AND event_id % 3 = 0 THEN '1,2,-4' ELSE '' END AS citations,
  CASE WHEN failed THEN 'call_failed' WHEN ok THEN NULL WHEN event_id % 11 = 5 THEN 'unexpected' ELSE 'no_json' END AS notes,
  CASE WHEN refusal THEN 'refusal_or_insufficient' WHEN NOT ok THEN 'unrelated_or_failed' WHEN event_type = 'click' THEN 'context_follow'
    WHEN event_type = 'view' THEN 'memory_override' ELSE 'unrelated_or_failed' END AS behavior_label FROM x""",
)
def answer_fields(spark, sf_dir):
    parsed = RS.parse_responses(responses(spark, sf_dir)).withColumns(
        {"original_value": F.lit("View"), "perturbed_value": F.lit("CLICK")}
    )
    rows = RS.answer_fields(parsed)
    ids = F.transform("cited_passage_ids", lambda x: x.cast("string"))
    return rows.select(
        "event_id", "answer_text", "is_refusal", F.array_join(ids, ",").alias("citations"), "notes", "behavior_label"
    )


def label_responses(spark, sf_dir):
    """Conversation turns as answers, each with a label evaluation of varying quality."""
    c = T.table(spark, sf_dir, "conversations")
    i = F.col("conv_id") * 3 + F.col("turn")
    body = F.concat(
        F.lit('{"behavior_label":"'), _choose(i, [*T.BEHAVIORS, "other"]), F.lit('","entails_original_claim":'), _choose(i, ["true", "false", "null"]),
        F.lit(',"entails_perturbed_claim":'), _choose(i, ["0", "1"]), F.lit(',"rationale":"'), F.repeat(F.lit("why "), 200),
        F.lit('","confidence":"'), _choose(i, ["high", "HIGH", "medium"]), F.lit('"}'),
    )
    answer = F.when(i % 9 == 0, "  ").otherwise(F.col("text"))
    return c.select("conv_id", "turn", "role", answer.alias("answer_text"), J.strict_json(body).alias("parsed"), i.alias("i"))


LABEL_SQL = """SELECT conv_id, turn, conv_id * 3 + turn AS i, (conv_id * 3 + turn) % 9 = 0 OR trim(text) = '' AS blank FROM conversations"""


@query(
    "label_eval_fields",
    f"""WITH x AS (SELECT *, ['context_follow', 'both_claims', 'memory_override', 'conflict_awareness', 'refusal_or_insufficient', 'unrelated_or_failed'][(i % 7 + 1)::int] AS l FROM ({LABEL_SQL}))
SELECT conv_id, turn, CASE WHEN blank THEN 'unrelated_or_failed' ELSE l END AS behavior_label,
  CASE WHEN blank THEN false WHEN l IS NOT NULL THEN i % 3 = 0 END AS entails_original_claim, CASE WHEN blank THEN false WHEN l IS NOT NULL THEN i % 2 = 1 END AS entails_perturbed_claim,
  CASE WHEN blank THEN 'high' WHEN l IS NOT NULL THEN ['high', NULL, 'medium'][(i % 3 + 1)::int] END AS confidence,
  CASE WHEN blank THEN 33 WHEN l IS NOT NULL THEN 600 END AS n_rationale,
  CASE WHEN blank OR l IS NULL THEN false ELSE (i % 2 = 1 AND i % 3 <> 0) OR l = 'context_follow' OR (l = 'both_claims' AND i % 2 = 1) END OR (NOT blank AND l IS NULL AND i % 2 = 0) AS gold FROM x""",
)
def label_eval_fields(spark, sf_dir):
    rows = label_responses(spark, sf_dir).withColumn("ev", RS.label_eval_fields("answer_text", "parsed"))
    fallback = F.when(F.col("i") % 2 == 0, "context_follow").otherwise("memory_override")
    return rows.select(
        "conv_id", "turn", "ev.behavior_label", "ev.entails_original_claim", "ev.entails_perturbed_claim", "ev.confidence",
        F.length("ev.rationale").alias("n_rationale"), RS.derive_gold("ev", fallback).alias("gold"),
    )


@query(
    "status_rollup",
    f"""WITH x AS (SELECT conv_id, blank OR i % 7 <> 6 AS ok, turn % 2 = 1 AND conv_id % 5 <> 0 AS called FROM ({LABEL_SQL}))
SELECT conv_id, count(*) FILTER (called AND ok) AS n_ok, count(*) FILTER (called AND NOT ok) AS n_failed,
  CASE WHEN count(*) FILTER (called) = 0 THEN 'skipped:no_generator_outputs' WHEN count(*) FILTER (called AND NOT ok) = 0 THEN 'ok'
    WHEN count(*) FILTER (called AND ok) > 0 THEN 'ok_partial' ELSE 'failed:all_evals_failed' END AS status FROM x GROUP BY conv_id""",
)
def status_rollup(spark, sf_dir):
    rows = label_responses(spark, sf_dir)
    done = RS.label_eval_fields("answer_text", "parsed").isNotNull()
    records = rows.select("conv_id").distinct()
    called = rows.where("turn % 2 = 1 AND conv_id % 5 <> 0")
    return RS.roll_up_status(called, ["conv_id"], done, "failed:all_evals_failed", records, "skipped:no_generator_outputs")


SPEC_VALUES = ['"a"', '" b "', '""', '"a"', "null", "7"]


def spec_responses(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    entry = lambda t, p: F.concat(
        F.lit('{"passage_id":'), F.when((i + p) % 6 == 0, F.lit('"x"')).when((i + p) % 6 == 1, F.concat(F.lit('"'), (p % 4).cast("string"), F.lit('"')))
        .otherwise((p % 4).cast("string")),
        F.lit(',"was_modified":'), F.when(p % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(',"modified_text":'), F.when((i + p) % 5 == 0, F.lit("5")).otherwise(F.concat(F.lit('"m'), p.cast("string"), F.lit('"'))),
        F.lit(',"mention_kind":'), F.when((i + p) % 7 == 0, F.lit('"odd"')).otherwise(F.lit('"explicit"')), F.lit("}"),
    )
    mods = F.transform(F.split("text", "\n"), entry)
    kind = _choose(i, ['"entity_substitution"', '"ranking_flip"', '"nonsense"'])
    body = F.concat(
        F.lit('{"original_value":'), _choose(i, SPEC_VALUES), F.when(i % 10 != 9, F.lit(',"perturbed_value":"a"')).otherwise(""),
        F.lit(',"perturbation_type":'), kind, F.lit(',"doc_modifications":['), F.array_join(mods, ","), F.lit("]}"),
    )
    text = F.when(i % 17 == 0, F.lit("oops")).otherwise(body)
    return d.select("doc_id", J.strict_json(text).alias("parsed"))


@query(
    "parse_spec",
    """WITH x AS (SELECT doc_id, ['a', 'b', '', 'a', 'None', '7'][(doc_id % 6 + 1)::int] AS o, CASE WHEN doc_id % 10 <> 9 THEN 'a' END AS p,
  ['entity_substitution', 'ranking_flip', 'nonsense'][(doc_id % 3 + 1)::int] AS k FROM documents),
y AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'failed:no_json' WHEN p IS NULL THEN 'failed:bad_spec' WHEN o = '' THEN 'failed:empty_values'
  WHEN o = p THEN 'failed:identical_values' WHEN k = 'nonsense' THEN 'failed:unknown_type:nonsense' ELSE 'ok' END AS spec_status FROM x)
SELECT doc_id, spec_status, CASE WHEN spec_status = 'ok' THEN o END AS original_value, CASE WHEN spec_status = 'ok' THEN k END AS perturbation_type FROM y""",
)
def parse_spec(spark, sf_dir):
    out = E.parse_spec(spec_responses(spark, sf_dir))
    return out.select("doc_id", "spec_status", "original_value", "perturbation_type")


@query(
    "parse_edits",
    """WITH p AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS p FROM documents WHERE doc_id % 17 <> 0),
e AS (SELECT doc_id, (p % 4)::int AS passage_id, p, p % 2 = 0 AS was_modified, 'm' || p AS modified_text FROM p
  WHERE (doc_id + p) % 6 <> 0 AND (doc_id + p) % 5 <> 0 AND (doc_id + p) % 7 <> 0)
SELECT doc_id, passage_id, arg_max(was_modified, p) AS was_modified, arg_max(modified_text, p) AS modified_text FROM e GROUP BY doc_id, passage_id""",
)
def parse_edits(spark, sf_dir):
    out = E.parse_edits(spec_responses(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "passage_id", "was_modified", "modified_text")


@query(
    "validation_fields",
    """WITH x AS (SELECT doc_id, doc_id % 8 <> 0 AS has, doc_id % 3 <> 0 AS tv, doc_id % 4 IN (1, 2) AS leak FROM documents)
SELECT doc_id, CASE WHEN has THEN tv END AS type_valid, CASE WHEN leak THEN false WHEN has THEN true END AS no_original_answer_leakage,
  CASE WHEN has THEN 'r1|7' ELSE '' END || CASE WHEN leak THEN CASE WHEN has THEN '|' ELSE '' END || 'deterministic_leakage:[1, 2]' ELSE '' END AS reasons FROM x""",
)
def validation_fields(spark, sf_dir):
    """The response's gates, then the leak found by matching overrides its own leakage gate."""
    i = F.col("doc_id")
    body = F.concat(
        F.lit('{"type_valid":'), _choose(i, ["0", "1", '"no"']),
        F.lit(',"answer_causal":true,"global_context_consistent":true,"no_original_answer_leakage":"false","rejection_reasons":["r1","",7,null]}'),
    )
    rows = T.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(i % 8 != 0, J.strict_json(body)).alias("parsed"),
        F.when((i % 4).isin(1, 2), F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("leaked"),
    )
    staged = rows.withColumn("v", RS.validation_fields("parsed"))
    fixed = staged.withColumn("v", E.override_leakage_gate("v", "leaked"))
    return fixed.select("doc_id", "v.type_valid", "v.no_original_answer_leakage", F.array_join("v.rejection_reasons", "|").alias("reasons"))


@query(
    "expand_work",
    """WITH m(mode) AS (VALUES ('rag_perturbed'), ('closed_book')), g(model) AS (VALUES ('a'), ('b'), ('c'))
SELECT mode, model, count(*) AS n, sum(length(text))::bigint AS chars FROM conversations, m, g WHERE role = 'assistant' AND trim(text) <> '' GROUP BY ALL""",
)
def expand_work(spark, sf_dir):
    turns = T.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    work = RS.expand_work(turns, ["a", "b", "c"], "model", ["rag_perturbed", "closed_book"], "text")
    return work.groupBy("mode", "model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def rule_scorer(batch):
    """A stand-in model: flags answers with digits, from the whole text."""
    import json

    digits = batch["text"].str.contains(r"[0-9]", regex=True)
    batch = batch.assign(text_out=[json.dumps({"verdict": "incorrect" if d else "correct", "contains_factual_error": bool(d)}) for d in digits])
    return batch.assign(input_tokens=batch["text"].str.len(), output_tokens=1, error=None)[
        ["text_out", "input_tokens", "output_tokens", "error"]
    ].rename(columns={"text_out": "text"})


@query(
    "score_requests",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]') THEN 'incorrect' ELSE 'correct' END AS verdict, length(text) AS input_tokens
FROM conversations WHERE role = 'assistant'""",
)
def score_requests(spark, sf_dir):
    turns = T.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    answered = RS.score_requests(turns.select("conv_id", "turn", "text"), rule_scorer, "conv_id bigint, turn bigint")
    parsed = RS.parse_responses(answered)
    return parsed.select("conv_id", "turn", RS.verdict_fields("parsed")["verdict"].alias("verdict"), "input_tokens")


@query(
    "stamp_and_rescue",
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'failed:unexpected:' || left('ValueError: bad row ' || text, 240) ELSE 'ok' END AS step_status,
  'judge=x' || CASE WHEN doc_id % 7 <> 0 THEN ';validate=' || ['ok', 'ok_partial', 'failed:no_json', 'skipped:no_grounding', 'ok'][(doc_id % 5 + 1)::int] ELSE '' END AS states
FROM documents JOIN labels USING (doc_id)""",
)
def stamp_and_rescue(spark, sf_dir):
    """Provenance stamps replace earlier ones; a row with a problem survives as a stub."""
    core = core_like(spark, sf_dir)
    problem = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("ValueError: bad row "), "text"))
    stamped = core.withColumn("pipeline_state", RS.stamp("pipeline_state", "judge", F.lit("y")))
    stamped = stamped.withColumn("pipeline_state", RS.stamp("pipeline_state", "judge", F.lit("x")))
    rescued = RS.rescue(stamped.withColumn("core_id", F.col("doc_id").cast("string")), problem, "judge")
    kept = F.map_filter("pipeline_state", lambda k, v: k.isin("judge", "validate"))
    entries = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rescued.select("doc_id", "step_status", F.array_join(entries, ";").alias("states"))


_STATES_SQL = """CASE WHEN lang = 'fr' THEN 'filter=failed:unexpected:KeyError: ''fr'''
  WHEN source = 'src0' THEN 'filter=ok;generate=failed:unexpected:ZeroDivisionError: division by zero'
  WHEN n_chars % 50 = 7 THEN 'filter=ok;generate=ok;judge=failed:unexpected:ValueError: no verdict for ' || n_chars || ' characters'
  ELSE 'filter=ok;generate=ok;judge=' || CASE WHEN n_chars % 2 = 0 THEN 'ok' ELSE 'ok_partial' END END"""


@query(
    "isolated_chain",
    f"""WITH s AS (SELECT doc_id, lang, n_chars, 1000.0::DOUBLE / nullif(substr(source, 4)::int, 0) AS share, {_STATES_SQL} AS states FROM documents WHERE n_chars % 11 <> 0)
SELECT doc_id, CASE WHEN lang <> 'fr' THEN lang || '!' END AS tongue, CASE WHEN states LIKE '%generate=ok%' THEN round(share, 6) END AS share,
  CASE WHEN states LIKE '%judge=ok%' THEN n_chars::bigint END AS verdict, states FROM s""",
)
def isolated_chain(spark, sf_dir):
    """Three steps in Python over documents, each of which throws on some rows; those stay, with the error, and skip what follows."""
    names = {"de": "de!", "en": "en!", "es": "es!"}

    def tongue(row):
        return None if row["n_chars"] % 11 == 0 else row | {"tongue": names[row["lang"]]}

    def share(row):
        return row | {"share": 1000 / int(row["source"][3:])}

    def verdict(row):
        if row["n_chars"] % 50 == 7:
            raise ValueError(f"no verdict for {row['n_chars']} characters")
        state = dict(row["pipeline_state"]) | {"judge": "ok" if row["n_chars"] % 2 == 0 else "ok_partial"}
        return row | {"verdict": row["n_chars"], "pipeline_state": state}

    docs = T.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"), F.expr("cast(map() as map<string,string>)").alias("pipeline_state"))
    schema = "doc_id bigint, lang string, source string, n_chars bigint, pipeline_state map<string,string>"
    steps = {}
    for name, function, more in (("filter", tongue, "tongue string"), ("generate", share, "share double"), ("judge", verdict, "verdict bigint")):
        schema = f"{schema}, {more}"
        steps[name] = STEPS.BatchStep(STEPS.by_record(function, schema), schema)
    done = STEPS.chain(docs, steps)
    entries = F.array_sort(F.transform(F.map_entries("pipeline_state"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return done.select("doc_id", "tongue", F.round("share", 6).alias("share"), "verdict", F.array_join(entries, ";").alias("states"))


@query(
    "latest_generation",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN source || '/' || lang WHEN doc_id % 4 = 2 THEN lang ELSE source END AS generator,
  CASE WHEN doc_id % 4 > 0 THEN 'm' || (doc_id % 4) END AS mode, CASE WHEN doc_id % 4 > 0 THEN lang END AS behavior_label FROM documents""",
)
def latest_generation(spark, sf_dir):
    """The last of up to three outputs of a record, named by provider and model or whichever it has."""
    i, source, lang = F.col("doc_id") % 4, F.col("source"), F.col("lang")

    def output(k):
        return F.struct(
            F.when(F.lit(k) != 2, source).otherwise("").alias("generator_provider"), F.when(F.lit(k) != 3, lang).alias("generator_model"),
            F.lit(f"m{k}").alias("mode"), lang.alias("behavior_label"),
        )

    outputs = F.slice(F.array(*[output(k) for k in (1, 2, 3)]), F.lit(1), i.cast("int"))
    return T.table(spark, sf_dir, "documents").select("doc_id", ST.latest_generation(outputs).alias("g")).select("doc_id", "g.*")


# ---- label reports ----------------------------------------------------------------------------


@query(
    "label_summary",
    f"""WITH c AS (SELECT generator, label, count(*) AS n, count(*) FILTER (is_refusal AND label IS NOT NULL) AS r FROM ({T.ANSWERS}) GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY generator) AS outputs, sum(CASE WHEN label IS NOT NULL THEN n ELSE 0 END) OVER (PARTITION BY generator) AS evaluated,
  sum(r) OVER (PARTITION BY generator) AS refs FROM c)
SELECT generator, label, n, outputs::bigint AS outputs, evaluated::bigint AS evaluated, refs::bigint AS self_declared_refusals, round(1e2 * n / evaluated, 6) AS rate_pct FROM w WHERE label IS NOT NULL""",
)
def label_summary(spark, sf_dir):
    return round_columns(L.label_summary(T.answers(spark, sf_dir)), "rate_pct")


def _difference_sql(side: str, left: str, right: str) -> str:
    return f"""WITH a AS (SELECT generator, {side} AS side, label = 'context_follow' AS f FROM ({T.ANSWERS}) WHERE label IS NOT NULL),
c AS (SELECT generator, count(*) FILTER (side AND f) AS x, count(*) FILTER (side) AS xn, count(*) FILTER (NOT side AND f) AS y, count(*) FILTER (NOT side) AS yn FROM a GROUP BY generator)
SELECT generator, x AS {left}_cf, xn AS {left}_n, y AS {right}_cf, yn AS {right}_n, round(1e2 * x / xn, 6) AS {left}_pct, round(1e2 * y / yn, 6) AS {right}_pct,
  round(1e2 * x / xn - 1e2 * y / yn, 6) AS delta_pp FROM c"""


@query("self_affinity", _difference_sql("generator = perturber", "own", "other"))
def self_affinity(spark, sf_dir):
    return round_columns(L.self_affinity(T.answers(spark, sf_dir)), "own_pct", "other_pct", "delta_pp")


@query("validity_gap", _difference_sql("is_validated", "valid", "gap"))
def validity_gap(spark, sf_dir):
    return round_columns(L.validity_gap(T.answers(spark, sf_dir)), "valid_pct", "gap_pct", "delta_pp")


@query(
    "type_pushback",
    f"""SELECT generator, kind, count(*) AS n, round(1e2 * count(*) FILTER (label = 'memory_override') / count(*), 6) AS mem_pct,
  round(1e2 * count(*) FILTER (label = 'conflict_awareness') / count(*), 6) AS conf_pct, round(1e2 * count(*) FILTER (label = 'context_follow') / count(*), 6) AS cf_pct
FROM ({T.ANSWERS}) WHERE label IS NOT NULL GROUP BY generator, kind""",
)
def type_pushback(spark, sf_dir):
    return round_columns(L.type_pushback(T.answers(spark, sf_dir)), "mem_pct", "conf_pct", "cf_pct")


@query(
    "citation_rate",
    f"""WITH a AS (SELECT generator, label = 'context_follow' AS f, c1 IN (m1, m2) OR c2 IN (m1, m2) AS hit FROM ({T.ANSWERS}))
SELECT generator, count(*) FILTER (f AND hit) AS cf_cited, count(*) FILTER (f) AS cf_n, round(1e2 * count(*) FILTER (f AND hit) / count(*) FILTER (f), 6) AS cited_pct FROM a GROUP BY generator""",
)
def citation_rate(spark, sf_dir):
    return round_columns(L.citation_rate(T.answers(spark, sf_dir)), "cited_pct")


@query(
    "cited_overlap",
    f"SELECT generator, count(*) FILTER (c1 IN (m1, m2) OR c2 IN (m1, m2)) AS overlapping, count(*) AS n FROM ({T.ANSWERS}) GROUP BY generator",
)
def cited_overlap(spark, sf_dir):
    hit = overlap("cited_passage_ids", "modified_passage_ids")
    return T.answers(spark, sf_dir).groupBy("generator").agg(F.count_if(hit).alias("overlapping"), F.count(F.lit(1)).alias("n"))


@query("label_counts", f"SELECT core_id, coalesce(label, 'unlabeled') AS label, count(*) AS n FROM ({T.ANSWERS}) GROUP BY ALL")
def label_counts(spark, sf_dir):
    return L.label_counts(T.answers(spark, sf_dir))


@query(
    "entailment_joint",
    f"""SELECT entails_original, entails_perturbed, count(*) FILTER (generator = 'g0') AS n_g0, count(*) FILTER (generator = 'g1') AS n_g1,
  count(*) FILTER (generator = 'g2') AS n_g2 FROM ({T.ANSWERS}) GROUP BY ALL""",
)
def entailment_joint(spark, sf_dir):
    return L.entailment_joint(T.answers(spark, sf_dir), T.JUDGES)


@query(
    "follow_matrix",
    f"""SELECT perturber, round(1e2 * avg((label = 'context_follow')::int) FILTER (generator = 'g0'), 6) AS follow_pct_g0,
  round(1e2 * avg((label = 'context_follow')::int) FILTER (generator = 'g1'), 6) AS follow_pct_g1,
  round(1e2 * avg((label = 'context_follow')::int) FILTER (generator = 'g2'), 6) AS follow_pct_g2 FROM ({T.ANSWERS}) WHERE label IS NOT NULL GROUP BY perturber""",
)
def follow_matrix(spark, sf_dir):
    return round_columns(L.follow_matrix(T.answers(spark, sf_dir), T.JUDGES), *[f"follow_pct_{g}" for g in T.JUDGES])


@query(
    "label_agreement",
    f"""WITH c AS (SELECT code_label, label, count(*) AS n FROM ({T.ANSWERS}) WHERE label IS NOT NULL GROUP BY ALL)
SELECT code_label, label, n, round(1e2 * sum(CASE WHEN code_label <> label THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS disagreement_pct FROM c""",
)
def label_agreement(spark, sf_dir):
    return round_columns(L.label_agreement(T.answers(spark, sf_dir)), "disagreement_pct")
