"""Exact line dedup over batches: levelled sorted runs of line hashes that each batch is anti-joined with."""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from verdictframe.llm.common import strings
from verdictframe.session import checkpointed, ensure_checkpoint_dir

#: Runs of one level that are merged into one of the next.
FANOUT = 2
#: Line occurrences that are looked at for hot lines, about, and the share of them from which a line is hot.
HOT_SAMPLE, HOT_SHARE = 1_000_000, 1 / 1000
_ROWS_AT_ONCE = 100_000


def line_keys(text: str, least: int = 10) -> tuple[list[bytes], list[bytes | None]]:
    """A text's lines, and per line the 16-byte hash of its key, or None if the key is too short."""
    raw = text.encode()
    digest = xxhash.xxh3_128_digest
    keys = [x.strip() for x in raw.lower().split(b"\n")]  # on bytes: A-Z only, and just the six ASCII blanks
    return raw.split(b"\n"), [digest(k) if len(k) >= least and (k.isascii() or len(k.decode()) >= least) else None for k in keys]


def line_hashes(rows: DataFrame, least: int = 10) -> DataFrame:
    """(h, doc, rk) once per row of (doc, rk, text) and distinct key of its text."""

    def run(batches):
        for b in batches:
            hashes: list[bytes] = []
            owners: list[int] = []

            def out():
                at = pa.array(owners, pa.int32())
                return pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), b.column(0).take(at), b.column(1).take(at)], ["h", "doc", "rk"])

            for i, text in enumerate(strings(b.column(2))):
                own = {h for h in line_keys(text, least)[1] if h is not None}
                hashes.extend(own)
                owners.extend([i] * len(own))
                if len(hashes) >= _ROWS_AT_ONCE:
                    yield out()
                    hashes, owners = [], []
            yield out()

    return rows.mapInArrow(run, f"h binary, doc {rows.schema['doc'].dataType.simpleString()}, rk bigint")


class Runs:
    """Levelled runs of (h, first): every line hash seen so far, with the document that holds it first.

    A run is a table bucketed and sorted by hash, so an anti-join or a merge reads what is stored
    bucket by bucket, without a shuffle of it. When a level has ``fanout`` runs they are compacted into
    one run of the next level, so about ``fanout * log(batches)`` runs are open. A hash is in one run at most.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.id = uuid.uuid4().hex
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs-{self.id}"
        self.levels: list[list[DataFrame]] = []
        self._made = 0

    def _write(self, df: DataFrame) -> DataFrame:
        self._made += 1
        name = f"line_runs_{self.id}_{self._made}"
        df.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.folder}/{self._made}").saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only; the files stay and the frame reads them
        return run

    def open(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, new: DataFrame) -> DataFrame:
        """Rows of ``new`` (h, ...) whose hash no run holds."""
        for run in self.open():
            new = new.join(run.select("h").hint("merge"), "h", "left_anti")
        return new

    def add(self, new: DataFrame) -> None:
        """Store a batch's unseen hashes as a run of level 0 and compact the levels that are full."""
        level, run = 0, self._write(new)
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            run, level = self._write(_union(full)), level + 1


def hot_hashes(hashes: DataFrame, sample: int = HOT_SAMPLE, share: float = HOT_SHARE) -> DataFrame:
    """(h) of lines that make up at least ``share`` of a bounded sample: at most 1 / share rows, whatever the input.

    Only the plan depends on which lines these are, never the result.
    """
    every = max(1, hashes.count() // sample)
    some = hashes.where(F.pmod(F.xxhash64("doc", "rk"), F.lit(every)) == 0)
    counts = checkpointed(some.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(2, share * total)).select("h")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, batches: int = 4, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with its text reduced to kept lines, and columns _n_lines and _n_dropped.

    A line's key is the line without ASCII blanks at both ends, A-Z in lower case. Keys of at least
    ``least`` code points are kept in the smallest id that holds them and dropped elsewhere; all other
    lines stay. The table is taken in ``batches`` ranges of ascending id. Each batch reduces its lines
    to (hash, smallest id), drops what the runs hold and becomes a run; so a run's id is the smallest.

    A null or empty text is one empty line. Rows that share an id are one document: none of them loses
    a line to another. Null ids come after all others and share one nameless document. Other columns
    stay as they are; columns of the two result names are replaced. An empty table gives no rows.
    Hot lines shrink map side before the runs; their holders are found by a broadcast of the hot lines,
    of which there are a thousand at most, those of all others by a shuffle. A row gathers no more
    hashes than its own text has lines.
    """
    extra = {"_n_lines", "_n_dropped"}
    names = [c for c in docs.columns if c not in extra]
    docs = docs.select(names).withColumn(text_col, F.col(text_col).cast("string"))
    rk = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    hashes = checkpointed(line_hashes(docs.select(F.col(id_col).alias("doc"), rk.alias("rk"), F.col(text_col).alias("text")), least))
    numeric = hashes.schema["doc"].dataType.typeName() in ("long", "integer", "short", "byte")
    cuts = hashes.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01) if numeric and batches > 1 else []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + F.when(F.col("doc") <= F.lit(int(cut)), 0).otherwise(1)
    runs = Runs(docs.sparkSession, fanout)
    for i in range(len(set(cuts)) + 1):
        batch = hashes.where(number == i) if cuts else hashes
        runs.add(runs.unseen(batch.groupBy("h").agg(F.min("doc").alias("first"))))
    seen = _union(runs.open())
    later = F.col("first").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("first")))
    hot = checkpointed(seen.join(F.broadcast(hot_hashes(hashes)), "h"))
    common = hashes.join(F.broadcast(hot), "h")
    others = hashes.join(F.broadcast(hot.select("h")), "h", "left_anti").join(seen, "h")
    lost = common.unionByName(others).where(later).groupBy("doc", "rk").agg(F.collect_set("h").alias("_lost"))
    both = docs.withColumn("_rk", rk)
    both = both.join(lost.withColumnsRenamed({"doc": "_doc", "rk": "_rk2"}), F.col(id_col).eqNullSafe(F.col("_doc")) & (F.col("_rk") == F.col("_rk2")), "left")
    both = both.select(*names, "_lost")
    place = names.index(text_col)

    def run(parts):
        for b in parts:
            texts, totals, drops = [], [], []
            for text, lost in zip(strings(b.column(place)), b.column(len(names))):
                gone = set(lost.as_py() or ())
                lines, keys = line_keys(text, least) if gone else (text.split("\n"), ())
                if gone:
                    kept = [x for x, k in zip(lines, keys) if k not in gone]
                    drops.append(len(lines) - len(kept))
                    text = b"\n".join(kept).decode()
                else:
                    drops.append(0)
                texts.append(text)
                totals.append(len(lines))
            columns = [b.column(i) for i in range(len(names))]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(drops, pa.int64())], [*names, "_n_lines", "_n_dropped"])

    schema = StructType([docs.schema[c] for c in names]).add("_n_lines", LongType()).add("_n_dropped", LongType())
    return both.mapInArrow(run, schema)
