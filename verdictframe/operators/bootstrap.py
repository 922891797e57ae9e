"""Cluster bootstrap percentile intervals.

Four methods, cheapest first for large tables:

``cluster_bootstrap``
    Exact multinomial resampling. Clusters with equal sufficient statistics are interchangeable,
    so the number of draws that hit each *distinct* statistics vector is again multinomial, with
    the vector's multiplicity as weight. The vectors are counted in one aggregate, split by hash
    into buckets, and each bucket draws its own part: a binary tree over the buckets halves the
    draws of a replicate at each node by a binomial whose seed is the node's, so a task only walks
    its own path; inside a bucket the draws are multinomial over its vectors. Work is replicates x
    distinct vectors, and a task holds one bucket at a time, however many there are.
``hashed_draws``
    Exact multinomial resampling with one row per draw, each a pure function of (seed, replicate,
    draw). Work is replicates x clusters; use it when a run must be repeatable in another engine.
``hashed_strata`` and ``hashed_rate_interval``
    The same draws for many strata, and for groups that each resample their own answers. Draws for strata are
    hashed a whole replicate at once and travel as packed counts of hits, about 2 bits each.
``poisson_bootstrap``
    Independent Poisson(1) weights per (replicate, cluster): no index and no totals, so a sampling
    scheme with a random total rather than the exact one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.digests import first_words
from verdictframe.operators.ranking import HASH_BITS, dense_index, hash_order, hash_order_of, rank_by_hash
from verdictframe.session import by_merge, checkpointed

_BLOCK_CELLS = 2_000_000  # weight-matrix cells held at once by a task
_VECTORS_PER_BUCKET = 4096
_STRATA_HELD = 1000  # whose sums a task holds, 16 bytes a replicate each
_BROADCAST_CLUSTERS = 1_000_000  # 24 bytes each
_DRAWS_PER_TASK = 10_000_000  # hashed draws that are made by one task
_HITS_HELD = 1 << 25  # hashed draws of a replicate that a task holds at once, 4 bytes each
_CLUSTERS_PER_BLOCK = 8192  # whose hits travel together, one row for each replicate
_ENTRIES_PER_BLOCK = 1 << 17  # statistics of a block's clusters, about 100 bytes each in the task
_BLOCKS_PER_TASK = 4


def percentile_interval(
    replicates: DataFrame,
    by: Sequence[str],
    value: str = "rep",
    level: float = 0.95,
    scale: float = 100.0,
    also: Sequence[Column] = (),
) -> DataFrame:
    """Exact linear-interpolation percentiles of the replicates of each stratum; ``also`` are more aggregates."""
    tail = (1.0 - level) / 2.0
    return replicates.groupBy(*by).agg(
        (scale * F.percentile(F.col(value), F.lit(tail))).alias("ci_low"),
        (scale * F.percentile(F.col(value), F.lit(1.0 - tail))).alias("ci_high"),
        F.count(value).alias("replicates"),
        *also,
    )


def statistic_vectors(stats: DataFrame, by: Sequence[str], cluster: str, population: DataFrame) -> DataFrame:
    """Distinct per-cluster vectors of (stratum, num, den) with how many clusters share them.

    ``stats`` has one row per (stratum, cluster), so a vector is as long as there are strata.
    ``population`` lists the clusters to resample: those without rows are included, rows of
    other clusters are left out.
    """
    return _count_vectors(cluster_vectors(stats, by, cluster), cluster, population)


def cluster_vectors(stats: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """(cluster, vec): the rows of each cluster as one sorted array; write it once where several populations share it."""
    stratum = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    entry = F.struct(
        stratum.alias("s"), F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den")
    )
    return stats.groupBy(cluster).agg(F.sort_array(F.collect_list(entry)).alias("vec"))


def _count_vectors(vectors: DataFrame, cluster: str, population: DataFrame) -> DataFrame:
    every = by_merge(population.select(cluster).distinct(), vectors, cluster, "left")
    counted = every.groupBy("vec").agg(F.count(F.lit(1)).alias("mult"))
    empty = F.array().cast("array<struct<s:string,num:double,den:double>>")
    return counted.withColumn("vec", F.coalesce(F.col("vec"), empty))


def cluster_bootstrap(
    stats: DataFrame,
    by: Sequence[str],
    cluster: str,
    population: DataFrame,
    n_boot: int = 10_000,
    seed: int = 20260627,
    buckets: int | None = None,
    level: float = 0.95,
    scale: float = 100.0,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Point and percentile interval of sum(num)/sum(den) per stratum over the population's clusters.

    ``vectors`` are the ``cluster_vectors`` of ``stats``, if they are written already. All strata share the draws; strata come back as text. ``n_clusters`` counts the clusters that have
    rows in a stratum, ``se`` is the normal approximation's standard error of the point.

    The vector table is checkpointed: it is counted to choose the number of buckets, then read for
    the bucket sizes (one number for every ``_VECTORS_PER_BUCKET`` vectors, broadcast) and the draws.
    """
    per_cluster = cluster_vectors(stats, by, cluster) if vectors is None else vectors
    vectors = checkpointed(_count_vectors(per_cluster, cluster, population))
    buckets = buckets or max(8, -(-vectors.count() // _VECTORS_PER_BUCKET))
    key = F.to_json("vec")
    shipped = vectors.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"),
        "mult",
        key.alias("key"),
        F.col("vec.s").alias("s"),
        F.col("vec.num").alias("num"),
        F.col("vec.den").alias("den"),
    )
    sizes = np.zeros(buckets, dtype=np.int64)
    for r in shipped.groupBy("bucket").agg(F.sum("mult").alias("size")).collect():
        sizes[r["bucket"]] = r["size"]
    shared = stats.sparkSession.sparkContext.broadcast(sizes)
    # a fixed partition count: the table is small in bytes but each bucket is a lot of work; a task adds up
    # its buckets before any row leaves it
    spread = shipped.repartitionById(min(buckets, 4 * _tasks(stats)), F.col("bucket")).sortWithinPartitions("bucket", "key")
    parts = spread.mapInPandas(_task_kernel(n_boot, seed, shared), "s string, b int, num double, den double")
    sums = parts.groupBy("s", "b").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    reps = sums.where(F.col("den") > 0).select("s", (F.col("num") / F.col("den")).alias("rep"))
    interval = percentile_interval(reps, ["s"], level=level, scale=scale)
    point = _points(vectors, scale)
    names = F.split(F.col("s"), "\u001f")
    return point.join(interval, "s", "left").select(
        *[names[i].alias(c) for i, c in enumerate(by)],
        "n", "n_clusters", "point", "se", "ci_low", "ci_high", "replicates",
    )


def _points(vectors: DataFrame, scale: float) -> DataFrame:
    """The estimate itself and its linearised standard error, from the distinct vectors and their counts."""
    entries = vectors.select("mult", F.explode("vec").alias("e")).select("mult", "e.s", "e.num", "e.den")
    m, num, den = F.col("mult"), F.col("num"), F.col("den")
    sums = entries.groupBy("s").agg(
        F.sum(F.when(den > 0, m)).alias("n_clusters"),
        F.sum(m * num).alias("x"),
        F.sum(m * den).alias("y"),
        F.sum(m * num * num).alias("xx"),
        F.sum(m * num * den).alias("xy"),
        F.sum(m * den * den).alias("yy"),
    )
    rate = F.col("x") / F.col("y")
    spread = F.greatest(F.lit(0.0), F.col("xx") - 2 * rate * F.col("xy") + rate * rate * F.col("yy"))
    return sums.select(
        "s",
        F.col("y").cast("bigint").alias("n"),
        "n_clusters",
        (scale * rate).alias("point"),
        (scale * F.sqrt(spread) / F.col("y")).alias("se"),
    )


def near_normal(band: float = 0.15, low: str = "ci_low", high: str = "ci_high") -> Column:
    """Whether both bounds are within ``band`` of the width of point +- 1.96 se; a zero se asks for equality."""
    half = 1.96 * F.col("se")
    room = 2 * band * half + 1e-9
    off = F.greatest(F.abs(F.col(low) - F.col("point") + half), F.abs(F.col(high) - F.col("point") - half))
    return F.coalesce(off <= room, F.lit(False))


def _path_totals(sizes: np.ndarray, bucket: int, n_boot: int, seed: int) -> np.ndarray:
    """Draws that fall to one bucket in each replicate, as every task would compute them."""
    before = np.r_[0, np.cumsum(sizes)]
    totals = np.full(n_boot, before[-1])
    low, high = 0, len(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        whole, left = before[high] - before[low], before[middle] - before[low]
        rng = np.random.default_rng([seed, 0, low, high])
        first = rng.binomial(totals, left / whole if whole else 0.0)
        if bucket < middle:
            totals, high = first, middle
        else:
            totals, low = totals - first, middle
    return totals


def _by_bucket(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one bucket after the other, from frames that are sorted by bucket."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for bucket, rows in frame.groupby("bucket", sort=True):
            if held and held[0]["bucket"].iat[0] != bucket:
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def _task_kernel(n_boot: int, seed: int, sizes: Broadcast):
    """Sums of each (stratum, replicate) over all buckets of a task; ``_STRATA_HELD`` strata at once."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for rows in _by_bucket(frames):
            strata, drawn = _bucket_sums(rows, n_boot, seed, sizes.value)
            for i, s in enumerate(strata):
                if s not in sums:
                    sums[s] = np.zeros((2, n_boot))
                sums[s][0] += drawn[:, i]
                sums[s][1] += drawn[:, len(strata) + i]
            if len(sums) > _STRATA_HELD:
                yield from _emitted(sums)
                sums = {}
        yield from _emitted(sums)

    return kernel


def _emitted(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for s, (num, den) in sums.items():
        yield pd.DataFrame({"s": s, "b": np.arange(len(num), dtype=np.int32), "num": num, "den": den})


def _bucket_sums(rows: pd.DataFrame, n_boot: int, seed: int, sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The strata of a bucket, and per replicate their sums of num, then of den; ``rows`` is sorted by key."""
    bucket = int(rows["bucket"].iat[0])
    strata = sorted({s for names in rows["s"] for s in names})
    if not strata:  # only clusters without rows: they take draws but add nothing
        return [], np.empty((n_boot, 0))
    split = _path_totals(sizes, bucket, n_boot, seed)
    place = {s: i for i, s in enumerate(strata)}
    values = np.zeros((len(rows), 2 * len(strata)))
    for row, (names, nums, dens) in enumerate(zip(rows["s"], rows["num"], rows["den"])):
        at = np.array([place[s] for s in names], dtype=np.intp)
        values[row, at] = nums
        values[row, at + len(strata)] = dens

    rng = np.random.default_rng([seed, 1, bucket])
    draw = _vector_draws(rows["mult"].to_numpy(dtype=np.int64), rng)
    step = max(1, _BLOCK_CELLS // len(rows))
    return strata, np.concatenate([draw(split[at : at + step]) @ values for at in range(0, n_boot, step)])


def _vector_draws(mult: np.ndarray, rng: np.random.Generator):
    """Multinomial draws over vectors, as a function from replicate totals to a weight matrix.

    A vector shared by many clusters takes a binomial share. The clusters behind rare vectors are
    laid out one by one and hit by uniform integers, which is much cheaper than a binomial each. Hits are
    counted one replicate at a time, so the counts stay in the processor's cache.
    """
    heavy = np.flatnonzero(mult >= 32)
    light = np.flatnonzero(mult < 32)
    owner = np.repeat(light, mult[light])
    shares = np.append(mult[heavy], len(owner)) / mult.sum()

    def draw(totals: np.ndarray) -> np.ndarray:
        rows, width = len(totals), len(mult)
        parts = rng.multinomial(totals, shares)
        weights = np.zeros((rows, width))
        if len(owner):
            ends = np.cumsum(parts[:, -1])
            picked = owner[rng.integers(0, len(owner), size=int(ends[-1]))]
            for row, (start, end) in enumerate(zip(ends - parts[:, -1], ends)):
                weights[row] = np.bincount(picked[start:end], minlength=width)
        weights[:, heavy] = parts[:, :-1]
        return weights

    return draw


def draw_index(seed: int | str, replicate: Column, draw: Column, n: Column) -> Column:
    """Cluster index picked by one draw: the first 32 md5 bits of (seed, replicate, draw) modulo n."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), draw.cast("string")))
    # never null, and declared so: a null filter on the join key would compute every hash twice
    return F.coalesce(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint") % n, F.lit(0))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hashed_draws(stats: DataFrame, cluster: str, n_boot: int, seed: int | str) -> DataFrame:
    """(b, num, den) per replicate; ``stats`` has one row per cluster of the population.

    Pass a materialised table: it is counted, indexed for the draws and looked up by them. Up to
    ``_BROADCAST_CLUSTERS`` clusters the lookup is broadcast and no draw is shuffled; beyond that
    draws and clusters are joined by index.
    """
    n = stats.count()
    indexed = dense_index(stats, cluster, "idx").select("idx", "num", "den")
    # by number, because the few bytes of the index would otherwise be coalesced into one task
    spread = indexed.select("idx").repartition(_tasks(stats), "idx")
    draws = spread.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"), F.col("idx").alias("d")
    )
    hits = draws.select("b", draw_index(seed, F.col("b"), F.col("d"), F.lit(n)).alias("idx"))
    joined = hits.join(F.broadcast(indexed) if n <= _BROADCAST_CLUSTERS else indexed, "idx")
    return joined.groupBy("b").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


class BlockedStats(NamedTuple):
    """Statistics of clusters packed by leading bits of the clusters' hash: ``table`` has (idx_block, stats)."""

    table: DataFrame
    bits: int


def _hash_block(cluster: str, bits: int) -> Column:
    """Leading bits of the hash that ``dense_index`` orders by, so indexes of a block are neighbours."""
    return F.shiftright(hash_order_of(F.md5(F.col(cluster).cast("string"))), HASH_BITS - bits).alias("idx_block")


def blocked_stats(stats: DataFrame, by: Sequence[str], cluster: str, population: DataFrame) -> BlockedStats:
    """``stats`` packed for ``hashed_strata``; write it once where several parts of ``population`` share it.

    Pass materialised tables: they are counted first. A row holds the entries of about ``_CLUSTERS_PER_BLOCK`` clusters.
    """
    n, entries = population.count(), stats.count()
    bits = (max(1, -(-n // _CLUSTERS_PER_BLOCK), -(-entries // _ENTRIES_PER_BLOCK)) - 1).bit_length()
    stratum = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in by])
    rows = stats.where(F.col(cluster).isNotNull()).select(
        _hash_block(cluster, bits), F.col(cluster).alias("cluster"), stratum.alias("s"), F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den")
    )
    parts = max(_tasks(stats), -(-(1 << bits) // _BLOCKS_PER_TASK))
    dealt = rows.repartition(parts, "idx_block").sortWithinPartitions("idx_block", "cluster")
    return BlockedStats(checkpointed(dealt.mapInArrow(_pack_blocks, "idx_block bigint, stats binary")), bits)


def hashed_strata(
    stats: DataFrame,
    by: Sequence[str],
    cluster: str,
    population: DataFrame,
    n_boot: int,
    seed: int | str,
    level: float = 0.95,
    scale: float = 100.0,
    blocked: BlockedStats | None = None,
) -> DataFrame:
    """Point and percentile interval per stratum by draws that any engine can repeat.

    All strata share the draws, one for each cluster of the population and replicate, each a hash of (seed,
    replicate, cluster index). A task makes the draws of a replicate (``_HITS_HELD`` at once), counts how often each
    cluster is hit and sends the counts as packed blocks of neighbouring indexes. The index follows a hash of the
    cluster, so its leading bits name the block, and the packed statistics are in blocks already. Both meet there by
    a sorted merge of one row a block, and each replicate weighs the statistics. What is written for a draw is
    about 2 bits (3 to 5 where a replicate takes several parts); a task holds one block at a time, and no stratum,
    replicate or hot cluster lies in one task. One number for each block goes through the driver. Work is replicates
    x clusters.

    ``blocked`` are the ``blocked_stats`` of ``stats``, if they are written already for this population or one that holds it.
    """
    spark = stats.sparkSession
    known = F.col(cluster).isNotNull()
    indexed = checkpointed(dense_index(population.where(known).select(cluster).distinct(), cluster, "idx"))
    # clusters without key are one more, the last one, that takes draws but has no statistics
    n = indexed.count() + int(not population.where(~known).isEmpty())
    table, bits = blocked or blocked_stats(stats, by, cluster, indexed)
    block = _hash_block(cluster, bits)
    blocks = sorted(indexed.groupBy(block).agg(F.min("idx").alias("start")).collect(), key=lambda r: r["start"])
    shared = spark.sparkContext.broadcast((np.array([r["idx_block"] for r in blocks], np.int64), np.array([r["start"] for r in blocks] + [n], np.int64)))
    parts = max(_tasks(stats), -(-len(blocks) // _BLOCKS_PER_TASK))

    chunks = max(1, -(-n // _HITS_HELD))
    jobs = n_boot * chunks if n else 0
    makers = spark.range(0, jobs, 1, max(1, min(jobs, max(_tasks(stats), -(-n * n_boot // _DRAWS_PER_TASK)))))
    hits = makers.mapInArrow(_hit_kernel(seed, chunks, shared), "idx_block bigint, b int, hits binary")
    draws = hits.repartition(parts, "idx_block").groupBy("idx_block").agg(F.collect_list(F.struct("b", "hits")).alias("draws"))
    placed = indexed.select(block, "idx", F.col(cluster).alias("cluster")).repartition(parts, "idx_block")
    places = placed.groupBy("idx_block").agg(F.collect_list(F.struct("idx", "cluster")).alias("places"))

    met = by_merge(by_merge(draws, places, "idx_block"), table.repartition(parts, "idx_block"), "idx_block")
    weighed = met.select("idx_block", "draws", "places", "stats").mapInArrow(_weigh_kernel(n_boot, shared), _WEIGHED)
    sums = weighed.groupBy("s", "b").agg(*[F.sum(c).alias(c) for c in ("num", "den", "known", "clusters")])
    num, den, whole = F.when(F.col("known") > 0, F.col("num")), F.col("den"), F.col("b") < 0
    reps = sums.select(
        "s",
        F.when(~whole & (den > 0), num / den).alias("rep"),
        F.when(whole, den.cast("bigint")).alias("n"),
        F.when(whole, F.col("clusters").cast("bigint")).alias("n_clusters"),
        F.when(whole, F.try_divide(scale * num, den)).alias("point"),
    )
    also = [F.max(c).alias(c) for c in ("n", "n_clusters", "point")]
    out = percentile_interval(reps, ["s"], level=level, scale=scale, also=also)
    names = F.split(F.col("s"), "\u001f")
    return out.select(
        *[F.nullif(names[i], F.lit(_NULL)).cast(stats.schema[c].dataType).alias(c) for i, c in enumerate(by)],
        "n", "n_clusters", "point", "ci_low", "ci_high", F.nullif("replicates", F.lit(0)).alias("replicates"),
    )


_NULL = "\u001e"  # name of a stratum without value
_WEIGHED = "s string, b int, num double, den double, known double, clusters double"


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, its rows as compressed Arrow) from rows that are sorted by block."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        blocks = batch.column("idx_block").to_numpy()
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(blocks)]):
            if low == high:
                continue
            if held and blocks[low] != current:
                yield _frozen(current, held)
                held = []
            current = int(blocks[low])
            held.append(batch.slice(low, high - low).select(["cluster", "s", "num", "den"]))
    if held:
        yield _frozen(current, held)


def _frozen(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    table = table.set_column(1, "s", table.column("s").dictionary_encode())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["idx_block", "stats"])


def _packed(cells: np.ndarray, codec: pa.Codec) -> Iterator[bytes]:
    """Counts as compressed half bytes; what is beyond 15 comes in further parts, to be added."""
    while True:
        halves = np.zeros(len(cells) + len(cells) % 2, dtype=np.uint8)
        np.minimum(cells, 15, out=halves[: len(cells)], casting="unsafe")
        yield codec.compress(halves[::2] | halves[1::2] << 4, asbytes=True)
        if cells.max() <= 15:
            return
        cells = np.maximum(cells - 15, 0)


def _unpacked(packed: bytes, size: int, codec: pa.Codec) -> np.ndarray:
    pairs = np.frombuffer(codec.decompress(packed, -(-size // 2), asbytes=True), dtype=np.uint8)
    return np.stack([pairs & 15, pairs >> 4], axis=1).ravel()[:size]


def _hit_kernel(seed: int | str, chunks: int, shared: Broadcast):
    """(block, replicate, packed counts of hits) of the draws of one replicate, or of one of its ``chunks``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        blocks, starts = shared.value
        n = int(starts[-1])
        for job in (i for batch in batches for i in batch.column(0).to_pylist()):
            b, chunk = divmod(job, chunks)
            hits = first_words(f"{seed}:{b}:", n * chunk // chunks, n * (chunk + 1) // chunks)
            if n < 1 << 32:  # else 32 bits are below it
                hits %= np.uint32(n)
            hits.sort()
            ends = np.append(np.searchsorted(hits, starts[:-1].astype(np.uint32)), len(hits))  # of the same type, or all hits would be copied
            for at in range(0, len(blocks), 256):
                rows = []
                for i in range(at, min(at + 256, len(blocks))):
                    if ends[i] < ends[i + 1]:
                        cells = np.bincount(hits[ends[i] : ends[i + 1]] - starts[i], minlength=starts[i + 1] - starts[i])
                        rows += [(blocks[i], part) for part in _packed(cells, codec)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([b] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                    ["idx_block", "b", "hits"],
                )

    return kernel


def _weigh_kernel(n_boot: int, shared: Broadcast):
    """Sums of each (stratum, replicate) over the blocks of a task; replicate -1 takes every cluster once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        blocks, starts = shared.value
        place = {int(block): i for i, block in enumerate(blocks)}
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                i = place[batch.column("idx_block")[row].as_py()]
                entries = pa.ipc.open_stream(batch.column("stats")[row].as_buffer()).read_all()
                draws, places = batch.column("draws")[row].values, batch.column("places")[row].values
                strata, totals = _block_sums(draws, places, entries, int(starts[i]), int(starts[i + 1]), n_boot, codec)
                for s, own in zip(strata, totals):
                    if s in sums:
                        sums[s] += own
                    else:
                        sums[s] = own
                if len(sums) > _STRATA_HELD // 2:
                    yield from _weighed(sums)
                    sums = {}
        yield from _weighed(sums)

    return kernel


def _weighed(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for s, (num, den, known, clusters) in sums.items():
        b = np.r_[np.arange(len(num) - 1), -1].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([s] * len(b), pa.string()), pa.array(b), *map(pa.array, (num, den, known, clusters))], ["s", "b", "num", "den", "known", "clusters"])


def _block_sums(
    draws: pa.StructArray, places: pa.StructArray, entries: pa.Table, start: int, stop: int, n_boot: int, codec: pa.Codec
) -> tuple[list[str], np.ndarray]:
    """The strata of a block, and for each (num, den, entries with num, clusters) by replicate, the whole block last."""
    owners = entries.column("cluster").combine_chunks()
    found = pc.index_in(owners, value_set=places.field("cluster").cast(owners.type))
    entries, found = entries.filter(found.is_valid()), found.drop_null().to_numpy()
    coded = entries.column("s").combine_chunks()
    strata, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    here = np.unique(codes)  # a population need not have all of them
    strata, codes = [strata[i] for i in here], np.searchsorted(here, codes)
    totals = np.zeros((len(strata), 4, n_boot + 1))
    if not strata:
        return strata, totals
    at = places.field("idx").to_numpy()[found] - start
    order = np.lexsort((at, codes))
    firsts = np.searchsorted(codes[order], np.arange(len(strata)))
    at = at[order]
    num, den = entries.column("num").combine_chunks(), entries.column("den").combine_chunks()
    known = num.is_valid().to_numpy(zero_copy_only=False).astype(float)
    values = np.stack([num.fill_null(0.0).to_numpy(), den.fill_null(0.0).to_numpy(), known])[:, order]
    totals[:, :3, n_boot] = np.add.reduceat(values, firsts, axis=1).T
    codes = codes[order]
    each = np.r_[0, np.flatnonzero((np.diff(at) != 0) | (np.diff(codes) != 0)) + 1]  # a cluster may have several rows
    totals[:, 3, n_boot] = np.bincount(codes[each], weights=np.add.reduceat(values[1], each) > 0, minlength=len(strata))
    finite = np.isfinite(values).all()
    numbers, packed = draws.field("b").to_numpy(), draws.field("hits")
    by_number = np.argsort(numbers, kind="stable")
    for rows in np.split(by_number, np.flatnonzero(np.diff(numbers[by_number])) + 1):
        hits = np.zeros(stop - start)
        for row in rows:
            hits += _unpacked(packed[int(row)].as_py(), stop - start, codec)
        weight = hits[at]
        weighed = values * weight if finite else np.where(weight > 0, values, 0.0) * weight
        totals[:, :3, numbers[rows[0]]] = np.add.reduceat(weighed, firsts, axis=1).T
    return strata, totals


def hashed_rate_interval(df: DataFrame, by: Sequence[str], answer_keys: Sequence[str], event: str, n_boot: int = 1000, seed: int | str = 20260627) -> DataFrame:
    """``rate_interval`` by draws that any engine can repeat, with no group in one task.

    Every group resamples its own answers: these are ranked by hash inside the group, and draw d of replicate b takes the
    answer whose rank is a hash of (seed, group, b, d) modulo the group's size. Work is replicates x answers.
    """
    flag = F.coalesce(F.col(event), F.lit(False)).cast("int")
    per_answer = checkpointed(df.groupBy(*by, *answer_keys).agg(F.sum(flag).alias("num"), F.count(F.lit(1)).alias("den")))
    totals = per_answer.groupBy(*by).agg(F.sum("num").alias("events"), F.sum("den").alias("n"), F.count(F.lit(1)).alias("clusters"))
    grp = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    ranked = rank_by_hash(per_answer.withColumn("_grp", grp), ["_grp"], seed, [*by, *answer_keys], "_rank")
    sizes = totals.select(grp.alias("_grp"), F.col("clusters").alias("_size"))
    indexed = checkpointed(ranked.join(sizes, "_grp").select("_grp", (F.col("_rank") - 1).alias("_idx"), "_size", "num", "den"))
    spread = indexed.select("_grp", "_idx", "_size").repartition(_tasks(df), "_grp", "_idx")
    draws = spread.select("_grp", "_size", F.col("_idx").alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "_grp", F.col("b").cast("string"), F.col("_d").cast("string")))
    hits = draws.select("_grp", "b", F.coalesce(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint") % F.col("_size"), F.lit(0)).alias("_idx"))
    sums = by_merge(hits, indexed, ["_grp", "_idx"]).groupBy("_grp", "b").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    interval = percentile_interval(sums.select("_grp", (F.col("num") / F.col("den")).alias("rep")), ["_grp"])
    joined = totals.withColumn("_grp", grp).join(interval, "_grp", "left")
    none, every = F.col("events") == 0, F.col("events") == F.col("n")
    low, high = rule_of_three(none, every, F.col("n"), F.col("ci_low"), F.col("ci_high"))
    return joined.select(*by, "events", "n", "clusters", (100.0 * F.col("events") / F.col("n")).alias("point"), low.alias("ci_low"), high.alias("ci_high"), "replicates")


# Cumulative Poisson(1) probabilities for 0, 1, 2, ... draws.
_POISSON_CDF = tuple(float(x) for x in np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(13)]))


def poisson_weight(seed: int | str, replicate: Column, cluster: Column) -> Column:
    """Poisson(1) weight from one uniform hash of (seed, replicate, cluster)."""
    u = hash_order(seed, replicate, cluster) / F.lit(float(1 << 60))
    out = F.lit(0)
    for bound in _POISSON_CDF:
        out = out + F.when(u >= bound, 1).otherwise(0)
    return out


def poisson_bootstrap(stats: DataFrame, by: Sequence[str], cluster: str, n_boot: int, seed: int | str) -> DataFrame:
    """(stratum, b, num, den); strata of one cluster share its weight, partial sums combine map-side."""
    spread = stats.repartition(_tasks(stats), cluster).select(
        *by, cluster, "num", "den", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")
    )
    w = poisson_weight(seed, F.col("b"), F.col(cluster))
    weighted = spread.select(*by, "b", (w * F.col("num")).alias("num"), (w * F.col("den")).alias("den"))
    return weighted.groupBy(*by, "b").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def rate_interval(
    df: DataFrame,
    by: Sequence[str],
    answer_keys: Sequence[str],
    event: str,
    n_boot: int = 10_000,
    seed: int = 20260627,
) -> DataFrame:
    """Rate of ``event`` with an answer-clustered interval per group of ``by``.

    Only answers with at least one row count as clusters, each group resamples its own, and a
    rate of 0 or 100 % takes the rule-of-three bound because the bootstrap collapses there.
    """
    flag = F.coalesce(F.col(event), F.lit(False)).cast("int")
    per_answer = df.groupBy(*by, *answer_keys).agg(
        F.sum(flag).alias("num"), F.count(F.lit(1)).alias("den")
    )
    kinds = per_answer.groupBy(*by, "num", "den").agg(F.count(F.lit(1)).alias("mult"))
    totals = kinds.groupBy(*by).agg(
        F.sum(F.col("num") * F.col("mult")).alias("events"),
        F.sum(F.col("den") * F.col("mult")).alias("n"),
        F.sum("mult").alias("clusters"),
    )
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    schema = "grp string, lo double, hi double"
    intervals = kinds.select(group.alias("grp"), "num", "den", "mult").groupBy("grp").applyInPandas(
        _rate_kernel(n_boot, seed), schema
    )
    joined = totals.withColumn("grp", group).join(intervals, "grp", "left")
    rate = 100.0 * F.col("events") / F.col("n")
    none, every = F.col("events") == 0, F.col("events") == F.col("n")
    return joined.select(
        *by,
        "events",
        "n",
        "clusters",
        rate.alias("point"),
        rule_of_three(none, every, F.col("n"), F.col("lo"), F.col("hi"))[0].alias("ci_low"),
        rule_of_three(none, every, F.col("n"), F.col("lo"), F.col("hi"))[1].alias("ci_high"),
        F.when(none, "rule-of-three upper bound (0 events)")
        .when(every, "rule-of-three lower bound (all events)")
        .alias("note"),
    )


def rule_of_three(none: Column, every: Column, n: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Interval bounds with 300/n in place of a collapsed side."""
    return (
        F.when(none, low).when(every, 100.0 - 300.0 / n).otherwise(low),
        F.when(none, 300.0 / n).otherwise(high),
    )


_DRAWS_AT_ONCE = 4_000_000  # numbers of one block of replicates


def _rate_kernel(n_boot: int, seed: int):
    """A group holds one row per distinct (events, verdicts) pair of an answer.

    Replicates are drawn a few at a time, the same ones as at once, so memory follows the pairs only.
    """

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["num", "den"])
        mult = pdf["mult"].to_numpy(dtype=np.int64)
        total = int(mult.sum())
        rng = np.random.default_rng([seed, *key[0].encode()])
        num, den = pdf["num"].to_numpy(float), pdf["den"].to_numpy(float)
        step = max(1, _DRAWS_AT_ONCE // len(mult))
        parts = []
        for at in range(0, n_boot, step):
            draws = rng.multinomial(total, mult / total, size=min(step, n_boot - at)).astype(np.float64)
            parts.append(draws @ num / (draws @ den))
        reps = np.concatenate(parts)
        lo, hi = np.percentile(100.0 * reps, [2.5, 97.5])
        return pd.DataFrame({"grp": [key[0]], "lo": [lo], "hi": [hi]})

    return kernel
