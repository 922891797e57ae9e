"""Answer-paired contrasts: the matching judge against the mean of the others on the same answer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.session import checkpointed

ALL = "all"
#: Rows that a task spreads over their strata, where a row becomes up to eight.
ROWS_PER_TASK = 500_000


def _dealt(base: DataFrame, cluster: str) -> DataFrame:
    """``base`` written once and dealt by cluster to as many tasks as its rows ask for.

    What is grouped by cluster and more after that stays in its task, so rows are shuffled before they are spread,
    not after. A hot cluster is a few rows by then.
    """
    rows = checkpointed(base)
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    parts = max(min(tasks, 1 + n // 20_000), -(-n // ROWS_PER_TASK))
    return rows.repartition(parts, cluster)


def paired_answers(
    df: DataFrame,
    answer_keys: Sequence[str],
    judge: str = "judge",
    generator: str = "generator",
    gold: str = "gold",
    pred: str = "pred",
    order: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per answer: same (0/1), cross (mean), delta, usable.

    ``answer_keys`` must hold the generator. With ``order`` several verdicts of one judge on one
    answer collapse to the last; without it (answer, judge) must be unique, and a single aggregate
    does all the work. Both aggregates combine map-side, so a hot answer is no problem.
    """
    flag = F.coalesce(F.col(pred), F.lit(False)).cast("int")
    truth = F.coalesce(F.col(gold), F.lit(False))
    rows = df.select(*answer_keys, F.col(judge).alias("_judge"), *carry, truth.alias("gold"), flag.alias("_flag"),
                     *([F.col(order).alias("_ord")] if order else []))
    if order:
        kept = ["gold", *carry]
        rows = rows.groupBy(*answer_keys, "_judge").agg(
            F.max_by("_flag", "_ord").alias("_flag"),
            *[F.max_by(c, "_ord").alias(c) for c in kept],
            F.max("_ord").alias("_ord"),
        )
        own = [F.max_by(c, "_ord").alias(c) for c in kept]
    else:
        own = [F.max(c).alias(c) for c in ["gold", *carry]]
    match = F.col("_judge") == F.col(generator)
    answers = rows.groupBy(*answer_keys).agg(
        *own,
        F.max(F.when(match, F.col("_flag"))).alias("_same"),
        F.sum(F.when(~match, F.col("_flag"))).alias("_cross_sum"),
        F.count(F.when(~match, F.col("_flag"))).alias("_cross_n"),
    )
    usable = F.col("_same").isNotNull() & (F.col("_cross_n") > 0)
    return answers.select(
        *answer_keys,
        "gold",
        *carry,
        F.col("_same").cast("double").alias("same"),
        F.when(F.col("_cross_n") > 0, F.col("_cross_sum") / F.col("_cross_n")).alias("cross"),
        usable.alias("usable"),
    ).withColumn("delta", F.when(F.col("usable"), F.col("same") - F.col("cross")))


def paired_delta(answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, same, cross and delta in percentage points over usable answers, plus the number dropped."""
    use = F.col("usable")
    return answers.groupBy(*by).agg(
        F.count_if(use).alias("n"),
        F.count_if(~use).alias("dropped"),
        (100 * F.avg(F.when(use, F.col("same")))).alias("same_pct"),
        (100 * F.avg(F.when(use, F.col("cross")))).alias("cross_pct"),
        (100 * F.avg("delta")).alias("delta_pp"),
    )


def stratum_stats(
    answers: DataFrame, cluster: str, generator: str | None = "generator", populations: Column | None = None
) -> DataFrame:
    """Sufficient statistics per (group, metric, cluster) for recall, FPR and flag rate.

    Answers are first summed per (cluster, generator, gold); only those few rows are dealt by cluster and spread over
    the strata they belong to. ``populations`` is an array of names each cluster counts for; leave
    it out for the bootstrap, which picks the clusters of a population itself.
    """
    base = answers.where("usable")
    dims = [generator] if generator else []
    if populations is not None:
        base, dims = base.withColumn("_populations", populations), [*dims, "_populations"]
    base = base.groupBy(cluster, *dims, "gold").agg(
        F.sum("delta").alias("num"),
        F.count(F.lit(1)).alias("den"),
        F.sum("same").alias("same_sum"),
        F.sum("cross").alias("cross_sum"),
    )
    metric = F.when(F.col("gold"), "recall_delta").otherwise("fpr_delta")
    groups = F.array(F.lit(ALL), F.col(generator).cast("string")) if generator else F.array(F.lit(ALL))
    spread = _dealt(base, cluster).withColumn("metric", F.explode(F.array(metric, F.lit("flag_rate_delta"))))
    spread = spread.withColumn("group", F.explode(groups))
    keys = ["group", "metric", cluster]
    if populations is not None:
        spread, keys = spread.withColumn("population", F.explode("_populations")), ["population", *keys]
    return spread.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("num", "den", "same_sum", "cross_sum")])


def population_names(validated: str = "is_validated") -> Column:
    inside = F.when(F.coalesce(F.col(validated), F.lit(False)), "validated").otherwise("gap_fill")
    return F.array(F.lit("full"), inside)


def slice_stats(
    answers: DataFrame,
    cluster: str,
    slices: Mapping[str, Sequence[str] | None],
    label: str = "behavior",
) -> DataFrame:
    """Like ``stratum_stats`` for overlapping label slices; ``None`` means every answer."""
    base = answers.where("usable").groupBy(cluster, label, "gold").agg(
        F.sum("delta").alias("num"), F.count(F.lit(1)).alias("den")
    )
    members = [
        F.when(F.lit(True) if labels is None else F.col(label).isin(*labels), F.lit(name))
        for name, labels in slices.items()
    ]
    belongs = F.filter(F.array(*members), lambda x: x.isNotNull())
    metric = F.when(F.col("gold"), "recall_delta").otherwise("avoided_flag_delta")
    spread = _dealt(base, cluster).withColumn("group", F.explode(belongs)).withColumn(
        "metric", F.explode(F.array(metric, F.lit("all_flag_delta")))
    )
    return spread.groupBy("group", "metric", cluster).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def suppress_small(points: DataFrame, n: str, min_n: int, columns: Sequence[str]) -> DataFrame:
    """Blank the given columns where fewer than ``min_n`` answers stand behind them."""
    return points.withColumns({c: F.when(F.col(n) >= min_n, F.col(c)) for c in columns})


def cluster_stats(paired: DataFrame, cluster: str, population: DataFrame) -> DataFrame:
    """Sum of deltas and count per cluster; clusters of the population without rows stay as zeros."""
    sums = paired.where("usable").groupBy(cluster).agg(
        F.sum("delta").alias("num"), F.count(F.lit(1)).alias("den")
    )
    joined = population.select(cluster).distinct().join(sums, cluster, "left")
    return joined.select(
        cluster,
        F.coalesce(F.col("num"), F.lit(0.0)).alias("num"),
        F.coalesce(F.col("den"), F.lit(0)).cast("bigint").alias("den"),
    )


def interval_covers_zero(low: Column | str = "ci_low", high: Column | str = "ci_high") -> Column:
    lo = F.col(low) if isinstance(low, str) else low
    hi = F.col(high) if isinstance(high, str) else high
    return F.coalesce((lo <= 0) & (hi >= 0), F.lit(False))
