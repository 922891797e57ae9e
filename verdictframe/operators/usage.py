"""Model-call usage: roll-ups, latency, reconciliation with verdicts, tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.scalars import ms_to_hours

MEASURES = (
    "calls", "errors", "input_tokens", "output_tokens",
    "missing_input_usage", "missing_output_usage", "sum_call_ms",
)
VERDICT_MEASURES = (*MEASURES, "verdicts")


def usage_by(traces: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """Counts and sums per key; missing token counts are counted, not imputed."""
    failed = F.coalesce(F.col(error).cast("boolean"), F.lit(False)) if dict(traces.dtypes)[error] == "boolean" else (
        F.length(F.coalesce(F.col(error), F.lit(""))) > 0
    )
    return traces.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(failed).alias("errors"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.count_if(F.col("input_tokens").isNull()).alias("missing_input_usage"),
        F.count_if(F.col("output_tokens").isNull()).alias("missing_output_usage"),
        F.sum("latency_ms").alias("sum_call_ms"),
    )


def usage_rollup(
    per_run: DataFrame, run: str = "run_id", judge: str = "judge", measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Run rows, judge totals and the grand total, in one (level, run, judge) table.

    Takes per-run sums, so the grouping sets expand a handful of rows instead of every call.
    """
    sums = [F.sum(m).alias(m) for m in measures]
    runs = per_run.select(F.lit("run").alias("level"), run, judge, *measures)
    judges = per_run.groupBy(judge).agg(*sums).select(
        F.lit("judge").alias("level"), F.lit(None).cast("string").alias(run), judge, *measures
    )
    total = per_run.agg(*sums).select(
        F.lit("total").alias("level"), F.lit(None).cast("string").alias(run),
        F.lit(None).cast("string").alias(judge), *measures,
    )
    out = runs.withColumn(run, F.col(run).cast("string")).unionByName(judges).unionByName(total)
    return out.withColumn("sum_call_hours", ms_to_hours("sum_call_ms"))


def with_verdicts(per_run: DataFrame, verdicts: DataFrame, run: str = "run_id", judge: str = "judge") -> DataFrame:
    """Per-run usage with the number of saved verdicts, 0 for a run that has none; roll up with ``VERDICT_MEASURES``."""
    saved = verdicts.groupBy(run, judge).agg(F.count(F.lit(1)).alias("verdicts"))
    return per_run.join(saved, [run, judge], "left").na.fill(0, ["verdicts"])


def latency_summary(traces: DataFrame, keys: Sequence[str], exact: bool = True) -> DataFrame:
    """Median latency, tokens and errors per key.

    The exact median counts each distinct latency first and weights it, so the aggregation buffer
    holds distinct milliseconds rather than calls; ``exact=False`` uses a fixed-size sketch.
    """
    failed = F.count_if(F.coalesce(F.col("error"), F.lit(False)))
    if not exact:
        return traces.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("calls"),
            failed.alias("errors"),
            F.sum("input_tokens").alias("input_tokens"),
            F.percentile_approx("latency_ms", 0.5, 10_000).cast("double").alias("p50_ms"),
        )
    distinct = traces.groupBy(*keys, "latency_ms").agg(
        F.count(F.lit(1)).alias("n"), failed.alias("e"), F.sum("input_tokens").alias("t")
    )
    return distinct.groupBy(*keys).agg(
        F.sum("n").alias("calls"),
        F.sum("e").alias("errors"),
        F.sum("t").alias("input_tokens"),
        F.percentile("latency_ms", F.lit(0.5), F.col("n")).alias("p50_ms"),
    )


def reconcile(calls: DataFrame, verdicts: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: calls against verdicts plus errors; a run on one side only shows as such.

    Both inputs are aggregates: (run, calls, errors, pairs, duplicate_events) and
    (run, verdicts, pairs).
    """
    left = calls.select(run, "calls", "errors", F.col("pairs").alias("call_pairs"), "duplicate_events")
    right = verdicts.select(run, "verdicts", F.col("pairs").alias("verdict_pairs"))
    joined = left.join(right, run, "full")
    balanced = F.col("calls") == F.col("verdicts") + F.col("errors")
    one_pair = (F.col("call_pairs") == 1) & (F.col("verdict_pairs") == 1)
    return joined.select(
        run, "calls", "verdicts", "errors",
        (F.col("calls").isNotNull() & F.col("verdicts").isNotNull()).alias("in_both"),
        F.coalesce(balanced, F.lit(False)).alias("balanced"),
        F.coalesce(one_pair, F.lit(False)).alias("single_pair"),
        F.coalesce(F.col("duplicate_events") == 0, F.lit(False)).alias("events_unique"),
    )


def call_sides(traces: DataFrame, run: str, event: str, pair: Sequence[str], error: str) -> DataFrame:
    """Left input of ``reconcile``: distinct pairs and repeated event ids by two-step aggregates."""
    events = traces.groupBy(run, event, *pair).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce(F.col(error), F.lit(False))).alias("_e")
    )
    pairs = events.groupBy(run, *pair).agg(
        F.sum("_n").alias("calls"), F.sum("_e").alias("errors"), F.sum(F.col("_n") - 1).alias("_d")
    )
    return pairs.groupBy(run).agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"),
        F.count(F.lit(1)).alias("pairs"), F.sum("_d").alias("duplicate_events"),
    )


def verdict_sides(verdicts: DataFrame, run: str, pair: Sequence[str]) -> DataFrame:
    pairs = verdicts.groupBy(run, *pair).agg(F.count(F.lit(1)).alias("verdicts"))
    return pairs.groupBy(run).agg(F.sum("verdicts").alias("verdicts"), F.count(F.lit(1)).alias("pairs"))


def events_of(traces: DataFrame, core_id, key: str = "core_id", order: str = "started_at") -> DataFrame:
    """All calls of one question across steps, oldest first."""
    return traces.where(F.col(key) == core_id).orderBy(F.coalesce(F.col(order), F.lit(0)))


def tail_events(traces: DataFrame, n: int, order: Sequence[str] = ("started_at",)) -> DataFrame:
    return traces.orderBy(*[F.desc(c) for c in order]).limit(n)


def ledger(traces: DataFrame) -> DataFrame:
    """The trace log without prompts and responses."""
    return traces.drop("system_prompt", "user_prompt", "raw_response", "parsed_output")
