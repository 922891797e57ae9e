"""Exact top-k by inner product: a KD-tree per shard, searched best first with a kth score that travels on."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.common import parts_for
from verdictframe.session import checkpointed

#: Vectors of a shard, queries that a search task holds, vectors of a leaf.
SHARD_ROWS, QUERY_ROWS, LEAF = 16_384, 8_192, 128


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, x), F.lit(False))


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, taken as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


class Tree:
    """Median splits along the widest side; every node has the tight box of its rows."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(rows))
        self.lo, self.hi, self.kids, self.span = [], [], [], []
        stack = [(0, len(rows), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            part = rows[order[a:b]]
            lo, hi = part.min(0), part.max(0)
            node = len(self.span)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([-1, -1])
            self.span.append((a, b))
            if parent >= 0:
                self.kids[parent][side] = node
            if b - a > leaf:
                wide = int((hi - lo).argmax()) if part.shape[1] else 0
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, wide], middle)] if part.shape[1] else order[a:b]
                stack += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.lo, self.hi, self.order = np.array(self.lo), np.array(self.hi), order

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that any point of each node's box can have with each query."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T


def exact(rows: np.ndarray) -> np.ndarray:
    """The numbers as float64 where all inner products are exact in it, else as Python integers."""
    top = float(np.abs(rows).max()) if rows.size else 0.0
    return rows.astype(np.float64) if top * top * max(1, rows.shape[1]) < 2**52 else rows.astype(object)


def search(tree: Tree, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, query: np.ndarray, bounds: np.ndarray, me: int, k: int, kth) -> list[tuple[int, int, int]]:
    """(score, id, row) of the best ``k`` rows but ``me``; what is surely below ``kth`` is left out. Ties go to smaller ids."""
    best: list[tuple] = []  # heap, worst first: (score, -id, -row)
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if kth is not None and -bound < kth:
            break
        left, right = tree.kids[node]
        if left >= 0:
            for child in (left, right):
                if kth is None or bounds[child] >= kth:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        a, b = tree.span[node]
        score = rows[a:b] @ query
        for j in range(b - a) if kth is None else np.flatnonzero(score >= kth):
            if own[a + j] == me:
                continue
            item = (int(score[j]), -int(ids[a + j]), -int(own[a + j]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
            if len(best) == k and (kth is None or best[0][0] > kth):
                kth = best[0][0]
    return [(s, -i, -r) for s, i, r in best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _look(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, id, row, score): for every row of ``asked`` (q, vector, kth, dim, shard, part) the best of its shard."""

    def run(own, queries):
        out = []
        if len(own) and len(queries):
            rows, ask = _matrix(own["vector"]), _matrix(queries["vector"])
            both = exact(np.concatenate([rows, ask]))
            rows, ask = both[: len(rows)], both[len(rows) :]
            tree = Tree(rows)
            rows, ids, number = rows[tree.order], own["id"].to_numpy()[tree.order], own["row"].to_numpy()[tree.order]
            for at in range(0, len(ask), 512):
                bounds = tree.bounds(ask[at : at + 512])
                for i, q, kth in zip(range(at, at + 512), queries["q"].to_numpy()[at : at + 512], queries["kth"].to_numpy()[at : at + 512]):
                    known = None if pd.isna(kth) else int(kth)
                    out += [(int(q), n, r, s) for s, n, r in search(tree, rows, ids, number, ask[i], bounds[i - at], int(q), k, known)]
        return pd.DataFrame(out, columns=["q", "id", "row", "score"]).astype("int64")

    keys = ["dim", "shard", "part"]
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own: both sides come from one table
    return vectors.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "q bigint, id bigint, row bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query``, the ``k`` rows of largest integer inner product.

    Rows are numbered and dealt into shards of about ``shard_rows``; a task builds its shard's tree and
    answers a block of queries. Each query first asks its own shard; its kth score from there goes with
    it to all other shards, where it prunes from the root on. Per shard at most ``k`` rows come back.
    The query set against all rows in blocks is what the operation asks for: queries are sent to each
    shard and, beyond ``query_rows`` of them, shards are sent to each block.

    Rows whose vector or id is null, or holds null or non-finite numbers, take no part. Only vectors of
    one length are compared. A row is no candidate of its own, but rows that repeat its id are; ties
    go to the smaller id. Fewer than ``k`` candidates give fewer rows; an empty table gives none.
    """
    base = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    base = base.select(F.col(id_col).cast("bigint").alias("id"), whole_numbers(F.col(vector_col), scale).alias("vector"), is_query.alias("asks"))
    rows = checkpointed(base.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("row")))
    count, asking = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    shards, parts = parts_for(count, shard_rows), parts_for(asking, query_rows)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    asked = rows.where("asks").select(F.col("row").alias("q"), "vector", "dim", "shard", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).alias("part"))
    spread = rows.select("id", "row", "vector", "dim", "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))
    found = checkpointed(_best(_look(spread, asked.withColumn("kth", F.lit(None).cast("bigint")), k), k))
    if shards > 1:
        kth = found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        others = asked.join(kth, "q", "left").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("to") != F.col("shard"))
        others = others.select("q", "vector", "kth", "dim", F.col("to").cast("bigint").alias("shard"), "part")
        found = _best(found.drop("rank").unionByName(_look(spread, others, k)), k)
    names = rows.where("asks").select(F.col("row").alias("q"), F.col("id").alias("query_id"))
    return found.join(names, "q").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
