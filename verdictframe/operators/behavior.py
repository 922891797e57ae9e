"""Verdicts stratified by the behaviour of the answer they judge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.scalars import pct
from verdictframe.operators.bootstrap import rate_interval

UNLABELED = "UNLABELED"


def behavior_blocks(
    df: DataFrame,
    answer_keys: Sequence[str],
    behavior: str = "behavior",
    judge: str = "judge",
    generator: str = "generator",
    gold: str = "gold",
    pred: str = "pred",
) -> DataFrame:
    """Counts, rates and the headline metric per behaviour.

    Verdicts first collapse to one row per answer, so the number of answers is a plain count and
    no distinct set is built per behaviour.
    """
    g = F.coalesce(F.col(gold), F.lit(False))
    p = F.coalesce(F.col(pred), F.lit(False))
    same = F.col(judge) == F.col(generator)
    label = F.coalesce(F.nullif(F.col(behavior), F.lit("")), F.lit(UNLABELED))
    counts = {
        "n_verdicts": F.count(F.lit(1)),
        "tp": F.count_if(g & p),
        "fp": F.count_if(~g & p),
        "fn": F.count_if(g & ~p),
        "tn": F.count_if(~g & ~p),
        "same_n": F.count_if(same),
        "same_flags": F.count_if(same & p),
        "cross_n": F.count_if(~same),
        "cross_flags": F.count_if(~same & p),
    }
    rows = df.withColumn("_label", label)
    answers = rows.groupBy("_label", *answer_keys).agg(*[v.alias(k) for k, v in counts.items()])
    blocks = answers.groupBy(F.col("_label").alias("behavior")).agg(
        F.count(F.lit(1)).alias("n_answers"), *[F.sum(k).alias(k) for k in counts]
    )
    positives = F.col("tp") + F.col("fn")
    negatives = F.col("fp") + F.col("tn")
    is_recall = 2 * positives >= F.col("n_verdicts")
    return blocks.select(
        "behavior",
        "n_verdicts",
        "n_answers",
        pct(positives, "n_verdicts").alias("gold_pos_pct"),
        pct(F.col("tp") + F.col("fp"), "n_verdicts").alias("flag_pct"),
        "tp",
        "fp",
        "fn",
        "tn",
        F.when(is_recall, "recall").otherwise("fpr").alias("headline_metric"),
        F.when(is_recall, pct("tp", positives)).otherwise(pct("fp", negatives)).alias("headline"),
        pct("same_flags", "same_n").alias("same_flag_pct"),
        pct("cross_flags", "cross_n").alias("cross_flag_pct"),
    )


def headline_intervals(
    df: DataFrame,
    answer_keys: Sequence[str],
    behavior: str = "behavior",
    gold: str = "gold",
    pred: str = "pred",
    n_boot: int = 10_000,
    seed: int = 20260627,
) -> DataFrame:
    """Answer-clustered interval of the headline rate of each behaviour."""
    g = F.coalesce(F.col(gold), F.lit(False))
    label = F.coalesce(F.nullif(F.col(behavior), F.lit("")), F.lit(UNLABELED))
    rows = df.select(label.alias("behavior"), *answer_keys, g.alias("_gold"), F.col(pred).alias("_pred"))
    share = rows.groupBy("behavior").agg((2 * F.count_if("_gold") >= F.count(F.lit(1))).alias("_want"))
    relevant = rows.join(share, "behavior").where(F.col("_gold") == F.col("_want"))
    return rate_interval(relevant, ["behavior"], answer_keys, "_pred", n_boot, seed)
