"""Judge x generator confusion matrices, their metrics, margins and unpaired contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.scalars import pct, ratio_or_zero

COUNTS = ("n", "gold_pos", "tp", "fp", "tn", "fn")


def confusion(
    df: DataFrame,
    keys: Sequence[str],
    gold: str = "gold",
    pred: str = "pred",
    fill: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Counts per key in one aggregate; ``fill`` names key values whose empty cells appear as zeros."""
    g = F.coalesce(F.col(gold), F.lit(False))
    p = F.coalesce(F.col(pred), F.lit(False))
    cells = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(g).alias("gold_pos"),
        F.count_if(g & p).alias("tp"),
        F.count_if(~g & p).alias("fp"),
        F.count_if(~g & ~p).alias("tn"),
        F.count_if(g & ~p).alias("fn"),
    )
    if not fill:
        return cells
    grid = df.sparkSession.range(1).select()
    for key, values in fill.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(key))
    full = grid.join(cells, list(fill), "left")
    return full.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS])


def with_metrics(cells: DataFrame, digits: int | None = None) -> DataFrame:
    """Precision, recall and F1 in percent (0 when undefined) and FPR (null when undefined)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = ratio_or_zero(tp, tp + fp)
    recall = ratio_or_zero(tp, tp + fn)
    f1 = ratio_or_zero(2 * precision * recall, precision + recall)
    named = {
        "precision": 100 * precision,
        "recall": 100 * recall,
        "f1": 100 * f1,
        "fpr": pct(fp, fp + tn),
    }
    if digits is not None:
        named = {k: F.round(v, digits) for k, v in named.items()}
    return cells.select("*", *[v.alias(k) for k, v in named.items()])


def by_population(
    df: DataFrame,
    keys: Sequence[str],
    validated: str = "is_validated",
    gold: str = "gold",
    pred: str = "pred",
) -> DataFrame:
    """Cells for the full, validated and gap-fill populations from one pass over the rows."""
    flagged = df.withColumn("_valid", F.coalesce(F.col(validated), F.lit(False)))
    split = confusion(flagged, [*keys, "_valid"], gold, pred)
    own = F.when(F.col("_valid"), F.lit("validated")).otherwise(F.lit("gap_fill"))
    spread = split.withColumn("population", F.explode(F.array(F.lit("full"), own)))
    return spread.groupBy("population", *keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def margins(
    cells: DataFrame,
    judge: str = "judge",
    generator: str = "generator",
    by: Sequence[str] = (),
    metric: str = "f1",
) -> DataFrame:
    """Row and column means, diagonal, off-diagonal and their difference, as (margin, name, value)."""
    own = F.col(judge) == F.col(generator)
    rows = cells.groupBy(*by, judge).agg(F.avg(metric).alias("value"))
    cols = cells.groupBy(*by, generator).agg(F.avg(metric).alias("value"))
    diag = cells.groupBy(*by).agg(
        F.avg(F.when(own, F.col(metric))).alias("diagonal"),
        F.avg(F.when(~own, F.col(metric))).alias("off_diagonal"),
    )
    diag = diag.withColumn("difference", F.col("diagonal") - F.col("off_diagonal"))
    long = diag.unpivot(list(by), ["diagonal", "off_diagonal", "difference"], "margin", "value")
    parts = [
        rows.select(*by, F.lit("row").alias("margin"), F.col(judge).alias("name"), "value"),
        cols.select(*by, F.lit("column").alias("margin"), F.col(generator).alias("name"), "value"),
        long.select(*by, "margin", F.lit("all").alias("name"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unpaired_effects(
    cells: DataFrame,
    judge: str = "judge",
    generator: str = "generator",
    by: Sequence[str] = (),
    metrics: Sequence[str] = ("recall", "fpr", "f1", "precision"),
) -> DataFrame:
    """Own minus mean of the other generators, per judge; a null rate counts as 0 in the delta."""
    own = F.col(judge) == F.col(generator)
    aggregates: list[Column] = []
    for m in metrics:
        zeroed = F.coalesce(F.col(m), F.lit(0.0))
        aggregates += [
            F.max(F.when(own, F.col(m))).alias(f"{m}_own"),
            F.avg(F.when(~own, F.col(m))).alias(f"{m}_cross"),
            (F.max(F.when(own, zeroed)) - F.avg(F.when(~own, zeroed))).alias(f"{m}_delta"),
        ]
    return cells.groupBy(*by, judge).agg(*aggregates)
