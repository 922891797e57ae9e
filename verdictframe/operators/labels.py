"""Reports over generator answers and their behaviour labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictframe.functions.scalars import pct
from verdictframe.functions.text import norm_contains

FOLLOW = "context_follow"


def _is(label: str, value: str) -> Column:
    return F.coalesce(F.col(label) == value, F.lit(False))


def label_summary(df: DataFrame, generator: str = "generator", label: str = "label", refusal: str = "is_refusal") -> DataFrame:
    """Outputs, evaluated, and per label its count and share of evaluated outputs.

    Self-declared refusals count among evaluated outputs only.
    """
    evaluated = F.col(label).isNotNull()
    cells = df.groupBy(generator, label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(refusal) & evaluated).alias("_ref")
    )
    whole = Window.partitionBy(generator)  # one row per (generator, label): a handful
    known = F.when(F.col(label).isNotNull(), F.col("n")).otherwise(0)
    return cells.select(
        generator,
        label,
        "n",
        F.sum("n").over(whole).alias("outputs"),
        F.sum(known).over(whole).alias("evaluated"),
        F.sum("_ref").over(whole).alias("self_declared_refusals"),
        pct(F.when(F.col(label).isNotNull(), F.col("n")), F.sum(known).over(whole)).alias("rate_pct"),
    ).where(F.col(label).isNotNull())


def _rate_difference(df: DataFrame, generator: str, label: str, side: Column, names: tuple[str, str]) -> DataFrame:
    left, right = names
    known, follow = df.where(F.col(label).isNotNull()), _is(label, FOLLOW)
    on = F.coalesce(side, F.lit(False))
    counts = known.groupBy(generator).agg(
        F.count_if(on & follow).alias(f"{left}_cf"),
        F.count_if(on).alias(f"{left}_n"),
        F.count_if(~on & follow).alias(f"{right}_cf"),
        F.count_if(~on).alias(f"{right}_n"),
    )
    a, b = pct(f"{left}_cf", f"{left}_n"), pct(f"{right}_cf", f"{right}_n")
    delta = F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))
    return counts.select("*", a.alias(f"{left}_pct"), b.alias(f"{right}_pct"), delta.alias("delta_pp"))


def self_affinity(df: DataFrame, generator: str = "generator", perturber: str = "perturber", label: str = "label") -> DataFrame:
    """Context-follow rate on own perturbations against those of others."""
    return _rate_difference(df, generator, label, F.col(generator) == F.col(perturber), ("own", "other"))


def validity_gap(df: DataFrame, generator: str = "generator", validated: str = "is_validated", label: str = "label") -> DataFrame:
    return _rate_difference(df, generator, label, F.col(validated), ("valid", "gap"))


def type_pushback(df: DataFrame, generator: str = "generator", kind: str = "kind", label: str = "label") -> DataFrame:
    """Follow, memory and conflict rates per generator and perturbation type."""
    known = df.where(F.col(label).isNotNull())
    counts = known.groupBy(generator, F.coalesce(F.col(kind), F.lit("unknown")).alias(kind)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(_is(label, FOLLOW)).alias("_cf"),
        F.count_if(_is(label, "memory_override")).alias("_mem"),
        F.count_if(_is(label, "conflict_awareness")).alias("_conf"),
    )
    return counts.select(
        generator,
        kind,
        "n",
        pct("_mem", "n").alias("mem_pct"),
        pct("_conf", "n").alias("conf_pct"),
        pct("_cf", "n").alias("cf_pct"),
    )


def citation_rate(df: DataFrame, generator: str = "generator", label: str = "label",
                  cited: str = "cited_passage_ids", modified: str = "modified_passage_ids") -> DataFrame:
    """Context-follow answers that cite at least one modified passage."""
    hit = F.coalesce(F.arrays_overlap(cited, modified), F.lit(False))
    follow = _is(label, FOLLOW)
    counts = df.groupBy(generator).agg(
        F.count_if(follow & hit).alias("cf_cited"), F.count_if(follow).alias("cf_n")
    )
    return counts.withColumn("cited_pct", pct("cf_cited", "cf_n"))


def localization(df: DataFrame, keys: Sequence[str], gold: str = "gold", pred: str = "pred", claim: str = "wrong_claim",
                 value: str = "perturbed_value", passage: str = "supporting_source_passage_id",
                 modified: str = "modified_passage_ids") -> DataFrame:
    """Among true positives: does the claim hold the value, is the cited passage a modified one."""
    tp = F.coalesce(F.col(gold) & F.col(pred), F.lit(False))
    stated = (F.length(value) > 0) & (F.length(claim) > 0)
    named = F.col(passage).isNotNull()
    inside = F.coalesce(F.array_contains(modified, F.col(passage)), F.lit(False))
    counts = df.where(tp).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tp"),
        F.count_if(stated & norm_contains(claim, value)).alias("claim_hits"),
        F.count_if(stated).alias("claim_n"),
        F.count_if(named & inside).alias("passage_hits"),
        F.count_if(named).alias("passage_n"),
    )
    return counts.select(
        "*", pct("claim_hits", "claim_n").alias("claim_pct"), pct("passage_hits", "passage_n").alias("passage_pct")
    )


def localization_flags(claim: str, value: str, passage: str, modified: str) -> tuple[Column, Column]:
    """(value in claim, passage among modified); null where an input is missing."""
    stated = (F.length(value) > 0) & (F.length(claim) > 0)
    return (
        F.when(stated, norm_contains(claim, value)),
        F.when(F.col(passage).isNotNull(), F.coalesce(F.array_contains(modified, F.col(passage)), F.lit(False))),
    )


def label_counts(df: DataFrame, keys: Sequence[str] = ("core_id",), label: str = "label") -> DataFrame:
    return df.groupBy(*keys, F.coalesce(F.nullif(label, F.lit("")), F.lit("unlabeled")).alias(label)).agg(
        F.count(F.lit(1)).alias("n")
    )


def entailment_joint(df: DataFrame, generators: Sequence[str], generator: str = "generator",
                     original: str = "entails_original", perturbed: str = "entails_perturbed") -> DataFrame:
    """Counts of the two entailment flags together, one column per generator."""
    named = df.where(F.col(original).isNotNull() & F.col(perturbed).isNotNull())
    return named.groupBy(original, perturbed).agg(
        *[F.count_if(F.col(generator) == g).alias(f"n_{g}") for g in generators]
    )


def follow_matrix(df: DataFrame, generators: Sequence[str], perturber: str = "perturber",
                  generator: str = "generator", label: str = "label") -> DataFrame:
    """Context-follow percentage per perturber (rows) and generator (columns)."""
    hit = _is(label, FOLLOW).cast("int")
    known = df.where(F.col(label).isNotNull())
    return known.groupBy(perturber).agg(
        *[(100.0 * F.avg(F.when(F.col(generator) == g, hit))).alias(f"follow_pct_{g}") for g in generators]
    )


def label_agreement(df: DataFrame, code_label: str = "code_label", model_label: str = "label") -> DataFrame:
    """Cross table of both labels with the share of all disagreements in each cell's table."""
    cells = df.where(F.col(model_label).isNotNull()).groupBy(code_label, model_label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))  # at most labels x labels rows
    differ = F.when(~F.col(code_label).eqNullSafe(F.col(model_label)), F.col("n")).otherwise(0)
    return cells.select(
        code_label,
        model_label,
        "n",
        pct(F.sum(differ).over(whole), F.sum("n").over(whole)).alias("disagreement_pct"),
    )
