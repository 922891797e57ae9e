"""The driver tables reshaped into the tables the operators work on, with their SQL twins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER_KEYS = ["core_id", "generator", "l_linenumber", "l_partkey", "l_suppkey"]
JUDGES = ["g0", "g1", "g2"]
BEHAVIORS = [
    "context_follow",
    "both_claims",
    "memory_override",
    "conflict_awareness",
    "refusal_or_insufficient",
    "unrelated_or_failed",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: Sequence[str]) -> Column:
    """``values[index]``, null beyond the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _judged(*predictions: Column) -> Column:
    cells = [F.struct(F.lit(j).alias("judge"), p.alias("pred")) for j, p in zip(JUDGES, predictions)]
    return F.explode(F.array(*cells))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges on every line item as an answer; the fan-out is an explode, not a join."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("core_id"),
        F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string")).alias("generator"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (F.col("l_orderkey") % 12 != 0).alias("is_validated"),
        (F.col("l_returnflag") == "R").alias("gold"),
        pick(F.col("l_partkey") % 7, BEHAVIORS).alias("behavior"),
        _judged(F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.04, F.col("l_quantity") > 25).alias("v"),
    ).select("*", "v.judge", "v.pred").drop("v")


VERDICTS = """
SELECT l_orderkey AS core_id, 'g' || CAST(l_suppkey % 3 AS VARCHAR) AS generator,
  l_linenumber, l_partkey, l_suppkey, 'g' || CAST(j.j AS VARCHAR) AS judge,
  l_orderkey % 12 <> 0 AS is_validated, l_returnflag = 'R' AS gold,
  CASE j.j WHEN 0 THEN l_discount >= 0.05 WHEN 1 THEN l_tax >= 0.04 ELSE l_quantity > 25 END AS pred,
  CASE CAST(l_partkey % 7 AS INTEGER) WHEN 0 THEN 'context_follow' WHEN 1 THEN 'both_claims'
    WHEN 2 THEN 'memory_override' WHEN 3 THEN 'conflict_awareness'
    WHEN 4 THEN 'refusal_or_insufficient' WHEN 5 THEN 'unrelated_or_failed' END AS behavior
FROM lineitem CROSS JOIN (VALUES (0),(1),(2)) j(j)
"""


def doc_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule judges on labelled documents; the text rule reads the whole text."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("core_id"),
        F.concat(F.lit("g"), (F.col("doc_id") % 3).cast("string")).alias("generator"),
        (F.col("quality") == 1).alias("is_validated"),
        (F.col("toxic") == 1).alias("gold"),
        F.col("lang").alias("behavior"),
        "text",
        _judged(F.col("n_chars") > 2000, F.col("lang") != "en", F.col("text").rlike("@|[0-9]{3}")).alias("v"),
    ).select("*", "v.judge", "v.pred").drop("v")


DOC_VERDICTS = """
SELECT d.doc_id AS core_id, 'g' || CAST(d.doc_id % 3 AS VARCHAR) AS generator,
  'g' || CAST(j.j AS VARCHAR) AS judge, l.quality = 1 AS is_validated, l.toxic = 1 AS gold,
  CASE j.j WHEN 0 THEN d.n_chars > 2000 WHEN 1 THEN d.lang <> 'en'
    ELSE regexp_matches(d.text, '@|[0-9]{3}') END AS pred, d.lang AS behavior, d.text AS text
FROM documents d JOIN labels l USING (doc_id) CROSS JOIN (VALUES (0),(1),(2)) j(j)
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled answers with perturber, change type, entailment flags and passage ids."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("core_id"),
        F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string")).alias("generator"),
        F.concat(F.lit("g"), (F.col("l_orderkey") % 3).cast("string")).alias("perturber"),
        F.concat(F.lit("t"), (F.col("l_partkey") % 5).cast("string")).alias("kind"),
        (F.col("l_orderkey") % 12 != 0).alias("is_validated"),
        pick(F.col("l_partkey") % 7, BEHAVIORS).alias("label"),
        pick((F.col("l_partkey") + F.col("l_linenumber")) % 6, BEHAVIORS).alias("code_label"),
        (F.col("l_linestatus") == "F").alias("is_refusal"),
        (F.col("l_discount") > 0.05).alias("entails_original"),
        (F.col("l_tax") > 0.02).alias("entails_perturbed"),
        F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1).alias("cited_passage_ids"),
        F.array((F.col("l_suppkey") % 9).cast("int"), (F.col("l_orderkey") % 9).cast("int")).alias(
            "modified_passage_ids"
        ),
    )


ANSWERS = """
SELECT l_orderkey AS core_id, 'g' || (l_suppkey % 3) AS generator, 'g' || (l_orderkey % 3) AS perturber,
  't' || (l_partkey % 5) AS kind, l_orderkey % 12 <> 0 AS is_validated,
  CASE l_partkey % 7 WHEN 0 THEN 'context_follow' WHEN 1 THEN 'both_claims' WHEN 2 THEN 'memory_override'
    WHEN 3 THEN 'conflict_awareness' WHEN 4 THEN 'refusal_or_insufficient' WHEN 5 THEN 'unrelated_or_failed' END AS label,
  CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN 'context_follow' WHEN 1 THEN 'both_claims' WHEN 2 THEN 'memory_override'
    WHEN 3 THEN 'conflict_awareness' WHEN 4 THEN 'refusal_or_insufficient' WHEN 5 THEN 'unrelated_or_failed' END AS code_label,
  l_linestatus = 'F' AS is_refusal, l_discount > 0.05 AS entails_original, l_tax > 0.02 AS entails_perturbed,
  l_linenumber AS c1, l_linenumber + 1 AS c2, l_suppkey % 9 AS m1, l_orderkey % 9 AS m2
FROM lineitem
"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls; each 20th token count is missing."""
    return trace_columns(table(spark, sf_dir, "events"))


def trace_columns(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 9).alias("run_id"),
        F.col("event_type").alias("model"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        F.when(k % 20 != 0, k).alias("input_tokens"),
        F.when(k % 15 != 0, k * 2).alias("output_tokens"),
        (F.col("event_type") == "error").alias("error"),
    )


TRACES = """
SELECT event_id, ts, user_id % 9 AS run_id, event_type AS model,
  CAST(floor(value * 10) AS BIGINT) AS latency_ms,
  CASE WHEN CAST(json_extract_string(props,'$.k') AS BIGINT) % 20 <> 0
       THEN CAST(json_extract_string(props,'$.k') AS BIGINT) END AS input_tokens,
  CASE WHEN CAST(json_extract_string(props,'$.k') AS BIGINT) % 15 <> 0
       THEN CAST(json_extract_string(props,'$.k') AS BIGINT) * 2 END AS output_tokens,
  event_type = 'error' AS error
FROM events
"""

# A perturbed value with characters that are special in patterns and replacements.
SPECIAL_VALUE = "new$1\\value"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def doc_passages(spark: SparkSession, sf_dir: str, labels: bool = True) -> DataFrame:
    """Lines of each document as passages, with values and evidence labels.

    The original value is the first normalised word of the document.
    """
    from verdictframe.functions.text import normalize

    whole = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("core_id"), F.split(normalize("text"), " ")[0].alias("original_value"), "text"
    )
    # the value is computed before the explode: beside it, it would be recomputed for every line
    docs = whole.select(
        "core_id",
        "original_value",
        F.lit(SPECIAL_VALUE).alias("perturbed_value"),
        F.posexplode(F.split("text", "\n")).alias("passage_id", "text"),
    )
    if not labels:
        return docs
    kind = (F.col("core_id") + F.col("passage_id")) % 4
    return docs.withColumns(
        {
            "evidence_correct": pick(kind, ["ANSWER-THE-QUESTION", "related-information", "UNKNOWN"]),
            "evidence_cited": F.when(F.col("passage_id") % 2 == 0, "YES").otherwise("NO"),
            "sent": F.coalesce(kind < 2, F.lit(False)),
        }
    )


DOC_PASSAGES = f"""
SELECT core_id, original_value, 'new$1\\value' AS perturbed_value, i - 1 AS passage_id, lines[i] AS text,
  CASE (core_id + i - 1) % 4 WHEN 0 THEN 'ANSWER-THE-QUESTION' WHEN 1 THEN 'related-information' WHEN 2 THEN 'UNKNOWN' END AS evidence_correct,
  CASE WHEN (i - 1) % 2 = 0 THEN 'YES' ELSE 'NO' END AS evidence_cited,
  (core_id + i - 1) % 4 < 2 AS sent
FROM (SELECT doc_id AS core_id, string_split({norm_sql('text')}, ' ')[1] AS original_value,
        string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i
      FROM documents)
"""
