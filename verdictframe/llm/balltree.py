"""Ranked lexical search: exact integer inner products of sparse vectors, pruned by ball trees best first."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.common import list_column, parts_for
from verdictframe.session import checkpointed

#: Documents and vector entries of a tree, documents of a leaf, numbers that a tree's centroids may take.
SHARD_ROWS, SHARD_ENTRIES, LEAF, CENTROID_NUMBERS = 16_384, 4_000_000, 64, 16_000_000
#: Terms, with repeats, of a block of queries; one document in so many is searched first for a kth score.
BLOCK_TERMS, FIRST = 2_000_000, 16
#: Slack of a bound against the rounding of doubles, far above it and far below any difference that prunes.
_SLACK = 1e-9
_NO_ID = 2**63 - 1

# ASCII letters in lower case, digits and all bytes of other characters stay; the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order; null has none."""
    return text.translate(_TERM_BYTES).split() if text else []


class Balls:
    """A balanced tree over sparse rows; every node knows its rows' centroid and the radius around it."""

    def __init__(self, start: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int = LEAF):
        n = len(start) - 1
        names, self.term = np.unique(term, return_inverse=True)
        self.place = {int(t): i for i, t in enumerate(names)}
        self.start, self.value, self.order = start.copy(), value.copy(), np.arange(n)
        width = max(1, len(names))
        leaf = max(leaf, 4 * n * width // CENTROID_NUMBERS)
        self.span, self.kids, centroids, radius = [], [], [], []
        stack = [(0, n, -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            node = len(self.span)
            self.span.append((a, b))
            self.kids.append((-1, -1))
            if parent >= 0:
                self.kids[parent] = (node, self.kids[parent][1]) if side == 0 else (self.kids[parent][0], node)
            lo, hi = self.start[a], self.start[b]
            at, t, v = self.start[a:b] - lo, self.term[lo:hi], self.value[lo:hi].astype(np.float64)
            centre = np.bincount(t, weights=v, minlength=width) / (b - a)
            norms = np.add.reduceat(v * v, at)

            def apart(point, size):
                return norms + size - 2 * np.add.reduceat(v * point[t], at)

            size = float(centre @ centre)
            gaps = apart(centre, size)
            centroids.append(centre)
            radius.append(math.sqrt(max(0.0, float(gaps.max())) + _SLACK * (float(norms.max()) + size)))
            if b - a > leaf:
                ends = []
                for _ in range(2):  # the row farthest from the centroid, then the one farthest from that
                    far = int(gaps.argmax())
                    point = np.zeros(width)
                    one = slice(at[far], at[far + 1] if far + 1 < b - a else hi - lo)
                    point[t[one]] = v[one]
                    ends.append(point)
                    gaps = apart(point, float(norms[far]))
                middle = (b - a) // 2
                self._reorder(a, b, np.argpartition(np.add.reduceat(v * (ends[0] - ends[1])[t], at), middle))
                stack += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.centroids, self.radius = np.array(centroids), np.array(radius)

    def _reorder(self, a: int, b: int, order: np.ndarray) -> None:
        starts, sizes = self.start[a:b][order], np.diff(self.start[a : b + 1])[order]
        ends = np.cumsum(sizes)
        take = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        lo, hi = self.start[a], self.start[b]
        self.term[lo:hi], self.value[lo:hi] = self.term[take], self.value[take]
        self.start[a + 1 : b + 1] = lo + ends
        self.order[a:b] = self.order[a:b][order]

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """At least the inner product of the query with any row of each node: <q, centroid> + |q| radius, rounded up.

        Values are positive, so a term that the centroid lacks is in none of the node's rows, and |q| counts
        only the terms that the node has.
        """
        w = weights.astype(np.float64)
        centroids = self.centroids[:, terms]
        return (centroids @ w + np.sqrt((centroids > 0) @ (w * w)) * self.radius) * (1 + _SLACK) + 1

    def search(self, query: dict[int, int], ids: np.ndarray, best: list, k: int, kth: tuple[int, int] | None) -> int:
        """Best-first walk that keeps the ``k`` best (score, -id) of positive score in the heap ``best``.

        Returns the number of leaves it looked into. Rows that are worse than ``kth`` (score, -id) are left out.
        """
        known = [(self.place[t], w) for t, w in query.items() if t in self.place]
        if not known:
            return 0
        terms, weights = np.array([t for t, _ in known]), np.array([w for _, w in known], dtype=np.int64)
        full = np.zeros(self.centroids.shape[1], dtype=np.int64)
        full[terms] = weights
        bounds = self.bounds(terms, weights)
        floor = kth[0] if kth else 1
        if len(best) == k:
            floor = max(floor, best[0][0])
        heap, seen = [(-bounds[0], 0)], 0
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            left, right = self.kids[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-min(-bound, bounds[child]), child))
                continue
            seen += 1
            a, b = self.span[node]
            lo = self.start[a]
            score = np.add.reduceat(self.value[lo : self.start[b]] * full[self.term[lo : self.start[b]]], self.start[a:b] - lo)
            for j in np.flatnonzero(score >= floor):
                item = (int(score[j]), -int(ids[a + j]))
                if kth is not None and item < kth:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    floor = max(floor, best[0][0])
        return seen


def _facts(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str, id_col: str) -> DataFrame:
    """(id, n, terms, tfs): number of terms of each document, and its query terms with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most about BLOCK_TERMS terms

    def run(batches):
        look = shared.value.get
        for b in batches:
            sizes, terms, counts = [], [], []
            for x in b.column(1):
                found = terms_of(x.as_py())
                sizes.append(len(found))
                held = Counter(map(look, found))
                held.pop(None, None)
                terms.append(np.fromiter(held.keys(), np.int32, len(held)))
                counts.append(np.fromiter(held.values(), np.int64, len(held)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), list_column(terms, pa.int32()), list_column(counts, pa.int64())], ["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<bigint>")


def length_terms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 75 + (75 n N) div L, exact also where the product leaves 64 bits."""
    n = n.astype(object) if len(n) and 75 * int(n.max()) * docs >= 2**63 else n
    return (25 + (75 * n * docs) // total).astype(np.int64)


def _search(facts: DataFrame, queries: dict[int, dict[int, int]], docs: int, total: int, k: int, kth: dict[int, tuple[int, int]]) -> DataFrame:
    """(q, score, id): per task the best of its documents; each tree holds one shard of them."""
    shared = facts.sparkSession.sparkContext.broadcast((queries, kth))

    def run(batches):
        asked, least = shared.value
        best: dict[int, list] = {q: [] for q in asked}
        used = np.array(sorted({t for query in asked.values() for t in query}), dtype=np.int64)
        waiting: list[tuple] = []
        rows = entries = 0

        def shard():
            ids, size, value, term = (np.concatenate(x) for x in zip(*waiting))
            start = np.zeros(len(size) + 1, dtype=np.int64)
            np.cumsum(size, out=start[1:])
            tree = Balls(start, term, value)
            ids = ids[tree.order]
            for q, query in asked.items():
                tree.search(query, ids, best[q], k, least.get(q))

        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy()
                size = part.column(2).value_lengths().to_numpy().astype(np.int64)
                term, tf = part.column(2).flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy()
                owner = np.repeat(np.arange(len(n)), size)
                keep = np.isin(term, used)  # a term of weight 0 adds nothing to any score
                owner, term, tf = owner[keep], term[keep], tf[keep]
                value = (1_000_000_000 * tf) // (1000 * tf + 8 * length_terms(n, docs, total)[owner])
                held = np.bincount(owner, minlength=len(n))
                waiting.append((ids[held > 0], held[held > 0], value, term))
                rows, entries = rows + int((held > 0).sum()), entries + len(term)
                if rows >= SHARD_ROWS or entries >= SHARD_ENTRIES:
                    shard()
                    waiting, rows, entries = [], 0, 0
        if rows:
            shard()
        out = [(q, s, -i) for q, heap in best.items() for s, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["q", "score", "id"])

    return facts.mapInArrow(run, "q bigint, score bigint, id bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _weights(facts: DataFrame, docs: int) -> dict[int, int]:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each query term that some document holds."""
    held = facts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    return {r["t"]: math.floor(1000 * math.log((2 * docs + 2) / (2 * r["df"] + 1))) for r in held.collect()}


def _block(docs: DataFrame, asked: list, k: int, text_col: str, id_col: str) -> DataFrame:
    """(q, rank, id, score) for one block of queries, a list of (q, terms)."""
    vocabulary: dict[bytes, int] = {}
    for _, terms in asked:
        for t in terms:
            vocabulary.setdefault(t, len(vocabulary))
    facts = checkpointed(_facts(docs, vocabulary, text_col, id_col))
    count, total, holding = facts.where("n > 0").agg(F.count(F.lit(1)), F.sum("n"), F.count(F.when(F.size("terms") > 0, 1))).first()
    weights = _weights(facts, count)
    queries = {q: {t: c * weights[t] for t, c in Counter(vocabulary[t] for t in terms).items() if weights.get(t, 0) > 0} for q, terms in asked}
    queries = {q: v for q, v in queries.items() if v}
    facts = facts.where(F.size("terms") > 0).select("id", "n", "terms", "tfs")
    # A fixed share of the documents gives every query a kth score; the others send only what can reach it.
    wave = F.pmod(F.xxhash64("id", "n"), F.lit(FIRST))
    shards = parts_for(holding, SHARD_ROWS)  # a task holds about one tree, however the documents lay in files
    first = checkpointed(_ranked(_search(facts.where(wave == 0).repartition(parts_for(shards, FIRST)), queries, count, total, k, {}), k))
    kth = {r["q"]: (r["score"], -r["id"]) for r in first.where(F.col("rank") == k).collect()}
    rest = _search(facts.where(wave != 0).repartition(shards), queries, count, total, k, kth)
    return _ranked(first.drop("rank").unionByName(rest), k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item by an integer score of shared terms.

    A document is a sparse vector over the query terms, an item the sparse vector of its terms' weights
    times their repeats; the score is their inner product. Tasks gather shards of documents, build a
    ball tree over each and walk it best first for every query, so memory is bounded by a shard. Queries
    come in blocks of about ``BLOCK_TERMS`` terms, each of which reads the documents once; a block's
    terms and weights are what the driver and the broadcasts hold. A first wave over one document in
    ``FIRST`` gives each query a kth score, below which the other tasks return nothing.

    A null text, or one without a term, has no score; a document of score 0 isn't listed. Every row is a
    document or an item of its own, so repeated rows are all ranked (equal scores by ascending id,
    null ids last) and repeated items each get their list. An empty table of either kind gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    number = F.monotonically_increasing_id().alias("q")
    asked = checkpointed(items.select(number, F.col(item_id).alias("item"), F.col(item_text).cast("string").cast("binary").alias("text")))
    room = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = parts_for(room, 6 * BLOCK_TERMS)
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "text").collect()
        got = _block(docs, [(r["q"], terms_of(bytes(r["text"]) if r["text"] is not None else None)) for r in rows], k, text_col, id_col)
        got = checkpointed(got) if blocks > 1 else got
        out = got if out is None else out.unionByName(got)
    named = out.join(asked.select("q", "item"), "q")
    return named.select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), "score")
