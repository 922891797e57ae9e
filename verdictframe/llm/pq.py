"""Near-duplicate vectors of equal label: inverted lists with residual codes, table lookups, exact cosine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import parts_for, roots
from verdictframe.llm.components import connected_components
from verdictframe.llm.kdtree import usable
from verdictframe.session import checkpointed

#: Vectors that centroids and codebooks are fitted on, about; members of a list; lists at most (the fit's size bounds them).
SAMPLE, LIST_ROWS, MAX_LISTS = 8_192, 512, 512
#: Subspaces, codes of each, rows of a list's chunk, probing rows that meet a chunk in one task.
SUBSPACES, CODES, CHUNK, PROBES = 16, 128, 4_096, 32_768
#: Standard deviations of a random displacement up to which the other side of a list border is probed.
DEVIATIONS = 4.0


def kmeans(rows: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1), 0)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squares(rows, centres).argmin(1)


@dataclass
class Index:
    """Coarse centroids, and a codebook of residuals for each subspace. Its size is set by the parameters alone."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Index:
        centres = kmeans(sample, lists)
        residual = sample - centres[nearest(sample, centres)]
        cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        return cls(centres, [kmeans(residual[:, a:b], codes, 4) for a, b in zip(cuts, cuts[1:])], cuts)

    def encode(self, rows: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, residual codes and their error for each row, and which other lists its neighbours may be in.

        A neighbour at distance r in a random direction passes the border to another list only if the
        row is nearer to it than a few r / sqrt(dimension); ``reach`` is that distance.
        """
        d2 = squares(rows, self.centres)
        own = d2.argmin(1)
        apart = np.sqrt(squares(self.centres, self.centres))[own]
        probes = d2 - d2[np.arange(len(rows)), own][:, None] <= 2 * reach * apart
        probes[np.arange(len(rows)), own] = False
        residual = rows - self.centres[own]
        codes = np.stack([nearest(residual[:, a:b], book) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)], axis=1).astype(np.uint8)
        return own, codes, np.sqrt(((residual - self.decode(codes)) ** 2).sum(1)), probes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded members of one list, by a table of each query's parts."""
        shifted = queries - self.centres[which]
        out = np.zeros((len(queries), len(codes)), dtype=np.float32)
        for s, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            out += squares(shifted[:, a:b], self.books[s]).astype(np.float32)[:, codes[:, s]]
        return out


def _links(index: Index, which: int, a: dict, b: dict, least: float, same: bool):
    """(i, j) of rows of ``a`` and ``b`` with cosine of at least ``least``; within one set each pair once."""
    r = np.sqrt(max(0.0, 2 - 2 * least))
    limit = (r + b["error"] + 1e-4).astype(np.float32) ** 2 + np.float32(1e-4)
    for at in range(0, len(a["unit"]), 512):
        near = index.distances(a["unit"][at : at + 512], which, b["codes"]) <= limit
        if same:
            near &= np.arange(at, at + len(near))[:, None] < np.arange(len(b["unit"]))
        else:  # a pair that both sides would find is taken where the list number is larger
            mine, there = a["list"][at : at + 512], b["probes"]
            near &= (mine[:, None] <= which) | ~there[:, mine].T
        i, j = np.nonzero(near)
        x, y = a["vector"][at + i], b["vector"][j]
        dot = np.einsum("ij,ij->i", x, y)
        cosine = dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        good = cosine >= least
        yield at + i[good], j[good]


def _side(part: pd.DataFrame, lists: int, dim: int, subspaces: int) -> dict:
    vector = np.stack(part["vector"].to_list()).astype(np.float64) if len(part) else np.zeros((0, dim))
    probes = np.zeros((len(part), lists), dtype=bool)
    for i, p in enumerate(part["probes"]):
        probes[i, p] = True
    return {
        "row": part["row"].to_numpy(),
        "size": part["size"].to_numpy(),
        "list": part["own"].to_numpy(),
        "vector": vector,
        "unit": vector / np.sqrt((vector**2).sum(1, keepdims=True)),
        "codes": np.frombuffer(b"".join(part["codes"]), dtype=np.uint8).reshape(len(part), subspaces),
        "error": part["error"].to_numpy(),
        "probes": probes,
    }


def _pairs(coded: DataFrame, index: Index, least: float) -> DataFrame:
    """(kind, a, b): kind 0, b more vectors linked to row a; kind 1, rows a and b are chained.

    Groups are (label, list, chunk of its members, block of the rows that probe it); a task gets some
    groups and returns sums and one star per component, so its result is no larger than what it read.
    """
    lists, dim = len(index.centres), index.centres.shape[1]
    shared = coded.sparkSession.sparkContext.broadcast(index)
    members = coded.groupBy("label", F.col("own").alias("list")).agg(F.count(F.lit(1)).alias("n"))
    chunks = members.select("label", "list", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    other = coded.select("*", F.explode("probes").alias("list"))
    probing = other.groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("blocks"))
    sizes = checkpointed(chunks.join(probing, ["label", "list"], "left").fillna(1, ["blocks"]))
    whole = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), n).cast("int")
    upto = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)).otherwise(F.expr("cast(array() as array<int>)")))
    at_home = coded.withColumn("list", F.col("own")).join(sizes, ["label", "list"]).withColumn("mine", whole(F.col("chunks"), 1))
    home = at_home.select("*", F.lit(0).alias("role"), F.col("mine").alias("chunk"), upto(F.lit(0), F.col("blocks") - 1).alias("block"))
    later = at_home.select("*", F.lit(1).alias("role"), upto(F.col("mine") + 1, F.col("chunks") - 1).alias("chunk"), F.lit(0).alias("block"))
    probe = other.join(sizes, ["label", "list"]).withColumn("mine", F.lit(-1)).select("*", F.lit(1).alias("role"), upto(F.lit(0), F.col("chunks") - 1).alias("chunk"), whole(F.col("blocks"), 2).alias("block"))
    names = ["label", "list", "chunk", "block", "role", "row", "size", "own", "vector", "codes", "error", "probes"]
    rows = home.select(names).unionByName(later.select(names)).unionByName(probe.select(names))
    width = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "list", "chunk", "block"]

    def run(part):
        idx = shared.value
        out_row, out_n, out_a, out_b = [], [], [], []
        for (_, which, _, block), group in part.groupby(keys, sort=False):
            m, p = _side(group[group["role"] == 0], lists, dim, len(idx.books)), _side(group[group["role"] == 1], lists, dim, len(idx.books))
            n = len(m["row"])
            row, size = np.r_[m["row"], p["row"]], np.r_[m["size"], p["size"]]
            links, comp = np.zeros(len(row), dtype=np.int64), np.arange(len(row))
            found = _links(idx, which, m, m, least, True) if block == 0 else ()
            for shift, pairs in ((0, found), (n, _links(idx, which, p, m, least, False))):
                for i, j in pairs:
                    i = i + shift
                    np.add.at(links, i, size[j])
                    np.add.at(links, j, size[i])
                    comp = roots(len(row), i, j, comp)
            some, tied = np.flatnonzero(links), np.flatnonzero(comp != np.arange(len(comp)))
            out_row.append(row[some])
            out_n.append(links[some])
            out_a.append(row[tied])
            out_b.append(row[comp[tied]])
        a, b = np.concatenate([*out_row, *out_a]), np.concatenate([*out_n, *out_b])
        kind = np.repeat([0, 1], [sum(map(len, out_row)), sum(map(len, out_a))])
        return pd.DataFrame({"kind": kind.astype("int32"), "a": a.astype("int64"), "b": b.astype("int64")})

    bucket = F.pmod(F.xxhash64(*keys), F.lit(8 * width))
    return checkpointed(rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, "kind int, a bigint, b bigint"))


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, deviations: float = DEVIATIONS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows link if their labels are equal and not null and their cosine, in double precision, is found to
    be at least ``least``. Equal vectors of a label are one point first, with a count. Centroids and
    codebooks are fitted on about ``sample`` points taken by hash; every point is coded and put in a list.
    A point meets its own list and those whose border is within ``deviations`` standard deviations of a
    random displacement of the threshold's length. Coded distances may exceed the threshold by each
    member's own coding error, so no pair within the probed lists is lost; the rest is exact cosine.

    Vectors that are null, empty or zero, or hold null or non-finite numbers, and rows without label link
    with nothing: no links, a component of their own. Vectors of different length never link. Repeated
    ids are rows of their own; a component takes its smallest id, and ``kept`` compares null-safely. An
    empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col(label_col).isNotNull() & usable(F.col(vector_col)) & F.coalesce(F.exists(F.col(vector_col), lambda x: x != 0), F.lit(False))
    hashes = [F.xxhash64(vector), F.xxhash64(F.lit(7), vector)]
    every = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.when(fine, vector).alias("vector"), hashes[0].alias("h1"), hashes[1].alias("h2"))
    every = checkpointed(every.withColumn("number", F.monotonically_increasing_id()))
    keys = ["label", "h1", "h2"]
    points = every.where("vector is not null").groupBy(keys).agg(F.min("number").alias("row"), F.min("id").alias("low"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
    points = checkpointed(points.withColumn("dim", F.size("vector")))
    found = None
    for dim, n in sorted(points.groupBy("dim").count().collect()):
        if n < 2:
            continue
        own = points.where(F.col("dim") == dim)
        most = own.groupBy("label").count().agg(F.max("count")).first()[0]
        taken = own.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n)) + 1).select("vector").toPandas()["vector"]
        if not len(taken):
            taken = own.limit(1).select("vector").toPandas()["vector"]
        fitted = np.stack(taken.to_list())
        fitted /= np.sqrt((fitted**2).sum(1, keepdims=True))
        index = Index.fit(fitted, min(MAX_LISTS, parts_for(most, LIST_ROWS)))
        shared = spark.sparkContext.broadcast(index)
        reach = deviations * np.sqrt(max(0.0, 2 - 2 * least)) / np.sqrt(dim)

        def code(frames, shared=shared, reach=reach):
            for f in frames:
                rows = np.stack(f["vector"].to_list()) if len(f) else np.zeros((0, 1))
                if not len(f):
                    continue
                unit = rows / np.sqrt((rows**2).sum(1, keepdims=True))
                which, codes, error, probes = shared.value.encode(unit, reach)
                yield f.assign(own=which.astype("int32"), codes=[c.tobytes() for c in codes], error=error, probes=[np.flatnonzero(p).astype("int32") for p in probes])

        schema = "row bigint, label string, size bigint, vector array<double>, own int, codes binary, error double, probes array<int>"
        coded = checkpointed(own.select("row", "label", "size", "vector").mapInPandas(code, schema))
        part = _pairs(coded, index, least)
        found = part if found is None else found.unionByName(part)
    if found is None:  # no dimension has two points: equal vectors are all that can link
        found = spark.createDataFrame([], "kind int, a bigint, b bigint")
    links = found.where("kind = 0").groupBy(F.col("a").alias("row")).agg(F.sum("b").alias("links"))
    tied = connected_components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "row")
    known = points.select(*keys, "row", "low", "size").join(links, "row", "left").join(tied, "row", "left").withColumn("c", F.coalesce("component", "row"))
    lowest = known.groupBy("c").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "c").select(*keys, (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = every.where("vector is not null").select("id", *keys).join(known, keys).select(F.col("id").alias("vec_id"), F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(every.where("vector is null").select(F.col("id").alias("vec_id"), *_alone()))


def _alone():
    return [F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")]
