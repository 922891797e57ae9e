"""Joins and set operations over runs: resume, latest-wins, labels, unions, differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.operators.ranking import latest, null_safe_join
from verdictframe.schemas import STEP_ORDER
from verdictframe.session import by_merge

__all__ = [
    "attach", "attach_core", "attach_labels", "diagnostic", "excluded", "latest", "merged_records",
    "overlap", "pending", "restrict", "resume", "tagged_union", "validators_of", "flag_membership",
]


def attach_labels(
    verdicts: DataFrame, labels: DataFrame, keys: Sequence[str], label: str = "behavior_label"
) -> DataFrame:
    """Left join on null-safe keys; a missing label stays null and is never refilled from another."""
    return null_safe_join(verdicts, labels.select(*keys, label), list(keys), "left")


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return null_safe_join(df, other.select(*keys, *columns), list(keys), "left")


def attach_core(df: DataFrame, core: DataFrame, columns: Sequence[str], key: str = "core_id") -> DataFrame:
    """Question attributes on every row; unknown questions read ``unknown``."""
    joined = by_merge(df, core.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in columns})


def restrict(df: DataFrame, ids: DataFrame, key: str = "core_id") -> DataFrame:
    """Rows whose key is among ``ids``, which may be as many as the questions: each task holds those of its part only."""
    return df.join(ids.select(key).hint("shuffle_hash"), key, "left_semi")


def flag_membership(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    marked = ids.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(marked.hint("shuffle_hash"), key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def pending(source: DataFrame, done: DataFrame, key_cols: Sequence[str] = ("core_id",)) -> DataFrame:
    """Source rows without a finished row for the same key."""
    finished = done.select(*key_cols).dropna(subset=[key_cols[0]])
    return source.join(finished, list(key_cols), "left_anti")


def resume(source: DataFrame, done: DataFrame, step, key_cols: Sequence[str] = ("core_id",)) -> DataFrame:
    """Finished rows plus the step applied to the pending ones."""
    return done.unionByName(pending(source, done, key_cols).transform(step), allowMissingColumns=True)


def merged_records(steps: DataFrame, key: str = "core_id", step: str = "step") -> DataFrame:
    """The record of the latest step per question; ``steps`` holds all step outputs."""
    pairs = [x for i, s in enumerate(STEP_ORDER) for x in (F.lit(s), F.lit(i))]
    ranked = steps.withColumn("_step_ord", F.create_map(*pairs)[F.col(step)]).dropna(subset=["_step_ord"])
    return latest(ranked, [key], "_step_ord").drop("_step_ord")


def tagged_union(runs: Mapping[tuple, DataFrame], tags: Sequence[str]) -> DataFrame:
    """One table from several, each row carrying the tag values of its run."""
    tagged = [
        df.withColumns({t: F.lit(v) for t, v in zip(tags, values)}) for values, df in runs.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def validators_of(
    candidates: DataFrame, key: str = "core_id", provider: str = "provider", validated: str = "is_validated"
) -> DataFrame:
    """Providers that validated each question, for the union of questions over all sources."""
    names = F.collect_set(F.when(F.col(validated), F.col(provider)))
    return candidates.groupBy(key).agg(F.sort_array(names).alias("validators"))


def excluded(every: DataFrame, chosen: DataFrame, key: str = "core_id") -> DataFrame:
    return every.select(key).distinct().join(chosen.select(key), key, "left_anti")


def diagnostic(core: DataFrame, validated: DataFrame, key: str = "core_id") -> DataFrame:
    return core.join(validated.select(key), key, "left_anti")


def overlap(a, b):
    """True when two id arrays share an element; null arrays share nothing."""
    return F.coalesce(F.arrays_overlap(F.col(a), F.col(b)), F.lit(False))
