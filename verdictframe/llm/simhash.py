"""SimHash near-duplicates: fingerprints of word shingles, joined by a binary trie walked against itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import parts_for, roots, row_key, strings
from verdictframe.llm.components import connected_components
from verdictframe.session import checkpointed

#: Rows of one trie task, node pairs held at once, and rows of one key from which its bits are split again.
ROWS_PER_TASK, PAIRS_AT_ONCE, HOT_KEY = 100_000, 1_000_000, 50_000
_COLUMN = np.arange(8, dtype=np.intp) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text's ``width``-word shingles, as a signed number; no words: zero."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1 :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # very long texts a block at a time
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += (np.bincount((block + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, keyed: bool = False) -> DataFrame:
    """(id, fp long) per row of ``docs``, with its ``row_key`` (k1, k2) if ``keyed``; a null text reads as empty and has fingerprint zero."""
    keys = ["k1", "k2"] if keyed else []

    def run(batches):
        for b in batches:
            fps = pa.array([fingerprint(t, width, seed) for t in strings(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps, *b.columns[2:]], ["id", "fp", *keys])

    hashes = [h.alias(k) for k, h in zip(keys, row_key(F.col(id_col), F.col(text_col)))]
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *hashes)
    return ids.mapInArrow(run, ", ".join([f"id {ids.schema['id'].dataType.simpleString()}, fp bigint", *[f"{k} bigint" for k in keys]]))


def _masks(free: list[int], blocks: int) -> list[int]:
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def trie_links(fps: np.ndarray, group: np.ndarray, budget: int, at_once: int = PAIRS_AT_ONCE) -> np.ndarray:
    """For rows sorted by (group, unsigned fp): the smallest row each is chained to by links of at most ``budget`` bits.

    Node pairs of the group's binary trie are walked down together, a level at a time; differing bits
    add up and a pair over the budget is dropped. A pair whose rows are all in one component already
    is dropped too, so a family of near copies costs few pairs once a small budget has chained it.
    Pairs beyond ``at_once`` wait on a stack, which bounds the memory.
    """
    n = len(fps)
    comp = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    spans = np.c_[first, np.r_[first[1:], n]]
    spans = spans[spans[:, 1] - spans[:, 0] > 1]
    if not len(spans):
        return comp
    counts = np.empty((64, n + 1), dtype=np.int32)
    for d in range(64):
        counts[d, 0] = 0
        np.cumsum((fps >> np.uint64(63 - d)) & np.uint64(1), out=counts[d, 1:])
    for allowed in sorted({min(1, budget), min(2, budget), budget}):
        stack = [(0, np.c_[spans, spans, np.zeros(len(spans), dtype=np.int64)])]
        while stack:
            d, pairs = stack.pop()
            change = np.r_[0, np.cumsum(comp[1:] != comp[:-1])]
            found: list[np.ndarray] = []
            while len(pairs) and d <= 64:
                if len(pairs) > at_once:
                    stack.append((d, pairs[at_once:]))
                    pairs = pairs[:at_once]
                a, a2, b, b2, diff = pairs.T
                known = (change[a2 - 1] == change[a]) & (change[b2 - 1] == change[b]) & (comp[a] == comp[b])
                single = ~known & (a2 - a == 1) & (b2 - b == 1)
                if single.any():
                    x, y = a[single], b[single]
                    close = np.bitwise_count(fps[x] ^ fps[y]) <= allowed
                    found.append(np.c_[x[close], y[close]])
                a, a2, b, b2, diff = pairs[~known & ~single].T
                if d == 64 or not len(a):
                    if d == 64 and len(a):  # equal rows
                        found += [np.c_[np.repeat(a, a2 - a), _ranges(a, a2)], np.c_[a, b], np.c_[np.repeat(b, b2 - b), _ranges(b, b2)]]
                    break
                c = counts[d]
                am, bm = a2 - (c[a2] - c[a]), b2 - (c[b2] - c[b])
                same = a == b
                kids = [
                    np.c_[a, am, b, bm, diff],
                    np.c_[am, a2, bm, b2, diff],
                    np.c_[a, am, bm, b2, diff + 1],
                    np.c_[am, a2, b, bm, diff + 1][~same],
                ]
                pairs = np.concatenate(kids)
                pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= allowed)]
                d += 1
            if found:
                links = np.concatenate(found)
                comp = roots(n, links[:, 0], links[:, 1], comp)
    return comp


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = b - a
    return np.arange(size.sum()) + np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size)


def hamming_components(fps: DataFrame, budget: int = 4, rows_per_task: int = ROWS_PER_TASK, hot_key: int = HOT_KEY) -> DataFrame:
    """(node, component) of distinct fingerprints ``fp`` that have links of at most ``budget`` bits.

    Two values within the budget agree in at least one of ``budget + 1`` disjoint bit blocks, so every
    link lies inside a group that shares a block's bits; the trie below such a key is one group. Groups
    of more than ``hot_key`` rows are split by the same rule over the bits that are still free (at most
    three times, after which some 63 bits are shared). A task gets whole groups and returns one star
    per component, at most one row per row read.
    """
    level = fps.select("fp").distinct()
    count = level.count()
    fixed = [0]
    done: list[DataFrame] = []
    for depth in range(3):
        masks = []
        for i, f in enumerate(fixed):
            free = [b for b in range(64) if not f >> b & 1]
            masks += [(i, _signed(f | m)) for m in _masks(free, budget + 1) if m]
        named = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(m).alias("m")) for i, m in masks])
        source = level if depth == 0 else level.withColumnRenamed("t", "p0")
        options = F.explode(named if depth == 0 else F.filter(named, lambda x: x["p"] == F.col("p0")))
        keyed = source.select("fp", options.alias("o")).select("fp", F.col("o.m").alias("t"), F.col("fp").bitwiseAND(F.col("o.m")).alias("k"))
        if depth:  # one set of bits can be reached on two ways
            keyed = keyed.distinct()
        hot = keyed.groupBy("t", "k").count().where(F.col("count") > hot_key) if depth < 2 else None
        if hot is None or not hot.limit(1).count():
            done.append(keyed)
            break
        hot = checkpointed(hot.select("t", "k"))
        done.append(keyed.join(hot, ["t", "k"], "left_anti").select("fp", "t", "k"))
        order = {m: i for i, (_, m) in enumerate(masks)}
        place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
        level = checkpointed(keyed.join(hot, ["t", "k"], "left_semi").select("fp", place[F.col("t")].alias("t")))
        fixed = [m % (1 << 64) for _, m in masks]
    buckets = parts_for(count * (budget + 1), rows_per_task)

    def run(part):
        fp = part["fp"].to_numpy().view(np.uint64)
        t, k = part["t"].to_numpy(), part["k"].to_numpy()
        order = np.lexsort((fp, k, t))
        fp, t, k = fp[order], t[order], k[order]
        group = np.cumsum(np.r_[False, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        comp = trie_links(fp, group, budget)
        linked = comp != np.arange(len(comp))
        signed = fp.view(np.int64)
        return pd.DataFrame({"u": signed[linked], "v": signed[comp[linked]]})

    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    stars = rows.withColumn("b", F.pmod(F.xxhash64("t", "k"), F.lit(buckets))).groupBy("b").applyInPandas(run, "u bigint, v bigint")
    return connected_components(stars)


def _chained(marked: DataFrame, budget: int, *more: Column) -> DataFrame:
    """(fp, low, c) per fingerprint of ``marked``, and aggregates ``more``: its smallest id and its component."""
    distinct = marked.groupBy("fp").agg(F.min("id").alias("low"), *more)
    found = hamming_components(distinct, budget)
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    Component: documents chained by fingerprints that differ in at most ``budget`` bits; its id is the
    smallest id in it (null only if all its ids are null). Null and empty texts have fingerprint zero
    and link like any other. Repeated rows stay, ties need no rule, an empty table gives no rows, and
    columns other than the two named are not read. Copies meet as one fingerprint before any join.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, width, seed))
    named = _chained(marked, budget)
    least = named.groupBy("c").agg(F.min("low").alias("component_id"))
    by_fp = checkpointed(named.select("fp", "c").join(least, "c").select("fp", "component_id"))
    return marked.join(by_fp, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """``docs`` with exactly one row of each SimHash group: that of the smallest id, rows without id last.

    Rows are told apart by id and text, so rows that share an id but not a group stay with their own
    groups. Where a group's smallest id has several texts a hash decides; of equal rows one stays.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, width, seed, keyed=True))
    named = _chained(marked, budget, F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "k1", "k2")).alias("first"))
    kept = named.groupBy("c").agg(F.min("first").alias("first")).select(F.col("first.k1").alias("_k1"), F.col("first.k2").alias("_k2"))
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    rows = docs.withColumns({"_h1": k1, "_h2": k2}).join(kept, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")), "left_semi")
    return rows.dropDuplicates(["_h1", "_h2"]).select(*docs.columns)
