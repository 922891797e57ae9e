"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.llm import balltree, kdtree, langid, licenses, linededup, packing, pieces, pii, pq, quality, simhash, warc, whitening
from verdictframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


OP1_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h)
SELECT page_id, bytes AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN k USING (h)
"""


@query("op1_seekable_warc", OP1_SQL)
def op1(spark, sf_dir):
    folder = warc.new_folder(spark)
    index = warc.write_bundles(table(spark, sf_dir, "pages"), folder)
    return warc.read_bundles(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_language_mixture")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    seen = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.identify(seen, model).drop("text")


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op3_kd_tree_topk", OP3_SQL)
def op3(spark, sf_dir):
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


PACKED = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_grouping_genetic_packing")
def op4(spark, sf_dir):
    path = tokenizer_path("word_bpe_49k.json")
    return packing.packed_documents(table(spark, sf_dir, "documents"), path, keep_ids=False).select(*PACKED)


@query("op5_contextual_pii")
def op5(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{pii.KINDS[kind]}")

    counts = [count(kind) for kind in range(len(pii.KINDS))]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


@query("op6_product_quantised_links", OP6_SQL)
def op6(spark, sf_dir):
    return pq.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_simhash_trie")
def op7(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op8_sentencepiece_spans")
def op8(spark, sf_dir):
    got = pieces.encoded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_rare_word_licenses")
def op9(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    start = F.transform("base", lambda b: b["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(start).cast("bigint").alias("first_word"),
        F.array_max(start).cast("bigint").alias("last_word"),
        "base_labels",
        "labels",
        "score",
    )


OP10_SQL = r"""
WITH lines AS (
  SELECT row_id, doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS row_id, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), firsts AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (f.first < l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (f.first IS NULL OR f.first >= l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN firsts f USING (key) GROUP BY l.doc_id
"""


@query("op10_levelled_line_dedup", OP10_SQL)
def op10(spark, sf_dir):
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


@query("op11_polarised_whitening")
def op11(spark, sf_dir):
    white = whitening.whitened_components(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS docs, sum(len(t))::BIGINT AS total FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
q AS (SELECT i, item_id, term, count(*) AS c FROM (
        SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY ALL),
x AS (SELECT i, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY i, item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""


@query("op12_ball_tree_search", OP12_SQL)
def op12(spark, sf_dir):
    return balltree.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op13_sql() -> str:
    value = {
        "symbols_per_word": "n_symbols / greatest(1, n_words)",
        "chars_per_word": "word_chars / greatest(1, n_words)",
        "short_words": "-(word_chars / greatest(1, n_words))",
        "duplicate_lines": "n_dup_lines / greatest(1, n_lines)",
        "repeated_words": "n_repeat_words / greatest(1, n_words)",
    }
    cells = ", ".join(f"({i}, {j + 1}, '{name}', {c})" for i, (name, cuts) in enumerate(quality.RULES) for j, c in enumerate(cuts))
    which = " ".join(f"WHEN '{name}' THEN {sql}" for name, sql in value.items())
    part = quality.RISK / len(quality.RULES)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS stratum, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, doc_id, stratum, text, regexp_extract_all(text, '[^ 	-]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines FROM t),
wins AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
twice AS (SELECT r, i FROM wins JOIN (SELECT r, win FROM wins GROUP BY r, win HAVING count(*) > 1) USING (r, win)),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) AS o(k) GROUP BY r),
f AS (SELECT r, doc_id, stratum, len(w) AS n_words, length(regexp_replace(text, '[ 	-]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
c(rule, cut, name, cutoff) AS (VALUES {cells}),
g AS (SELECT doc_id, max(quality) > 0 AS good, md5(doc_id::VARCHAR) < '8' AS holdout FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
n AS (SELECT stratum, count(*) FILTER (holdout AND good) AS held, count(*) FILTER (NOT holdout AND good) AS good, count(*) FILTER (NOT holdout AND NOT good) AS bad
      FROM b JOIN g USING (doc_id) WHERE NOT base_failed GROUP BY stratum),
beyond AS (SELECT r, doc_id, stratum, rule, cut FROM b, c WHERE NOT base_failed AND CASE name {which} END > cutoff::DOUBLE),
x AS (SELECT stratum, rule, cut, count(*) FILTER (holdout AND good) AS k, count(*) FILTER (NOT holdout AND good) AS kg, count(*) FILTER (NOT holdout AND NOT good) AS kb
      FROM beyond JOIN g USING (doc_id) GROUP BY stratum, rule, cut),
tail AS (SELECT stratum, rule, cut, sum(exp(lgamma(held + 1) - lgamma(i + 1) - lgamma(held - i + 1) + i * ln({part!r}) + (held - i) * ln(1 - {part!r}))) AS p
         FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM x JOIN n USING (stratum) WHERE held > 0) GROUP BY stratum, rule, cut),
ok AS (SELECT stratum, rule, max(cut) AS cut FROM x JOIN n USING (stratum) JOIN tail USING (stratum, rule, cut)
       WHERE p <= {quality.ERROR!r} / ((SELECT count(*) FROM n WHERE held > 0) * (SELECT count(*) FROM c)) AND kb > 0 AND kb * good >= {quality.LIFT!r} * kg * bad
       GROUP BY stratum, rule),
gone AS (SELECT DISTINCT r FROM beyond JOIN ok USING (stratum, rule, cut))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone.r IS NULL AS kept FROM b LEFT JOIN gone USING (r)
"""


@query("op13_certified_quality", _op13_sql())
def op13(spark, sf_dir):
    out = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
