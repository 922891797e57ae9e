"""Seeded samples. Order is a hash of (seed, id), so a draw does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictframe.operators.ranking import (
    SMALL_LIMIT,
    first_by_value,
    hash_order,
    null_safe_join,
    rank_by_hash,
    rank_by_value,
    rank_hashed,
    take_quota,
)
from verdictframe.session import checkpointed


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int | Column, seed: int, key: str) -> DataFrame:
    """One row of every stratum per round until ``n`` are taken; strata are visited in hash order.

    An id is taken once: of rows that share ``key`` the one whose stratum comes first stays, so the
    draw of n rows is a part of that of n + 1. The order of the result rows is not defined.
    Small draws rank at most ``n`` rows per stratum and take the top ``n``. Others never sort the
    draw: stratum sizes alone say how many rows each stratum gives.
    """
    named = one_per_id(_named(df, strata), strata, key)
    if isinstance(n, int) and n <= SMALL_LIMIT:
        ranked = rank_by_hash(named, strata, seed, [key], "_round", limit=n)
        ordered = ranked.withColumn("_stratum", hash_order(seed, *strata))
        return ordered.orderBy("_round", "_stratum", key).limit(n).drop("_round", "_stratum")
    return take_quota(named, strata, stratum_quotas(named, strata, n, seed), seed, [key])


def one_per_id(df: DataFrame, strata: Sequence[str], key: str, first: str | None = None) -> DataFrame:
    """One row for each value of ``key``: of the smallest ``first``, then of the first stratum in hash order."""
    order = F.struct(*([F.col(first)] if first else []), hash_order("", *strata), *strata)
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def _named(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in strata})


def stratum_quotas(df: DataFrame, strata: Sequence[str], n: int | Column, seed: int | str) -> DataFrame:
    """Rows each stratum gives to a round-robin draw of ``n``, as (strata, _quota).

    After r whole rounds a stratum of size s has given min(s, r) rows. With sizes in ascending
    order the total is linear between two sizes, which yields the last whole round; the rest goes
    to the first larger strata in hash order. The window runs over the distinct sizes, of which a
    table of N rows has fewer than the square root of 2N.
    """
    total = n if isinstance(n, Column) else F.lit(n)
    counted = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_s"))
    sizes = checkpointed(counted.withColumn("_h", hash_order(seed, *strata)))  # read five times below
    by_size = sizes.groupBy("_s").agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = by_size.select(
        "_s", F.sum("_c").over(up_to).alias("closed"), F.sum(F.col("_s") * F.col("_c")).over(up_to).alias("given")
    )
    k = sizes.agg(F.count(F.lit(1))).scalar()
    whole = steps.where(F.col("given") + (k - F.col("closed")) * F.col("_s") <= total)
    last = whole.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("closed", "given")])
    still_open = k - F.col("closed")
    rounds = F.when(still_open > 0, F.floor((total - F.col("given")) / still_open)).otherwise(F.lit(1 << 62))
    edge = last.select(rounds.alias("r"), (total - F.col("given") - still_open * rounds).alias("e"))
    r, e = edge.select("r").scalar(), edge.select("e").scalar()
    closed = sizes.where(F.col("_s") <= r).select(*strata, F.col("_s").alias("_quota"))
    ranked = rank_hashed(sizes.where(F.col("_s") > r), "_h", "_p")
    return closed.unionByName(ranked.select(*strata, (r + (F.col("_p") <= e).cast("bigint")).alias("_quota")))


def prefer_then_backfill(
    df: DataFrame, preferred: Column, strata: Sequence[str], n: int, seed: int, key: str
) -> DataFrame:
    """Stratified draw from the preferred rows first, the rest (seed + 1) only to fill up to ``n``.

    An id counts once, as preferred if any of its rows is. Both ways below take the same rows.
    """
    pool = F.when(F.coalesce(preferred, F.lit(False)), 0).otherwise(1)
    named = one_per_id(_named(df.withColumn("_pool", pool), strata), ["_pool", *strata], key, first="_pool")
    if n > SMALL_LIMIT:
        first, rest = named.where("_pool = 0"), named.where("_pool = 1")
        short = F.greatest(F.lit(0), F.lit(n) - first.agg(F.count(F.lit(1))).scalar())
        return stratified_sample(first, strata, n, seed, key).unionByName(
            stratified_sample(rest, strata, short, seed + 1, key)
        )
    ranked = []
    for number in (0, 1):
        rows = rank_by_hash(named.where(F.col("_pool") == number), strata, seed + number, [key], "_round", limit=n)
        ranked.append(rows.withColumn("_stratum", hash_order(seed + number, *strata)))
    return ranked[0].unionByName(ranked[1]).orderBy("_pool", "_round", "_stratum", key).limit(n).drop("_round", "_stratum")


def capped_sample(df: DataFrame, strata: Sequence[str], cap: int, seed: int, key: str) -> DataFrame:
    """At most ``cap`` rows per stratum, each with the stratum's population size."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("population"))
    picked = rank_by_hash(df, strata, seed, [key], "_rank", limit=cap).drop("_rank")
    return null_safe_join(picked, sizes, list(strata), "inner")


def matched_sample(
    df: DataFrame, group: str, is_reference: Column, is_candidate: Column, seed: int, key: str
) -> DataFrame:
    """As many candidate rows per group as there are reference rows in it."""
    quota = df.where(is_reference).groupBy(group).agg(F.count(F.lit(1)).alias("_quota"))
    return take_quota(df.where(is_candidate), [group], quota, seed, [key])


def balanced_sample(df: DataFrame, group: str, k: int, seed: int, key: str) -> DataFrame:
    return rank_by_hash(df, [group], seed, [key], "_rank", limit=k).drop("_rank")


def combine_sources(
    df: DataFrame, source: str, seq: str, order: str = "round-robin", seed: int = 17, key: str | None = None
) -> DataFrame:
    """Adds the sort columns (ord1, ord2) that put the union of sources into the asked order."""
    if order == "sequential":
        return df.withColumns({"ord1": F.col(source).cast("bigint"), "ord2": F.col(seq).cast("bigint")})
    if order == "shuffle":
        ids = [source, key or seq]
        return df.withColumns({"ord1": hash_order(seed, *ids), "ord2": F.lit(0).cast("bigint")})
    if order != "round-robin":
        raise ValueError(f"unknown order: {order!r}")
    ranked = rank_by_value(df, [source], seq, out="ord1")
    return ranked.withColumn("ord2", F.col(source).cast("bigint"))


def slice_rows(df: DataFrame, seq: str, offset: int = 0, take: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Rows ``offset`` .. ``offset + take`` in ``seq`` order, equal values in hash order of ``ties``.

    Pages only fit together if (``seq``, ``ties``) tells all rows apart.
    """
    if take is None:
        return rank_by_value(df, [], seq, ties, out="_rank").where(F.col("_rank") > offset).drop("_rank")
    return first_by_value(df, seq, take, ties, offset)


def first_selected(picks: DataFrame, key: str, subset: str, order: str) -> DataFrame:
    """One subset per case: the one selected first."""
    return picks.groupBy(key).agg(F.min_by(subset, order).alias(subset), F.min(order).alias(order))
