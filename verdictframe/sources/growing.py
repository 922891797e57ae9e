"""Lines of files that are still being written: a stream that follows them, and its batch twin.

A writer appends lines to ``name.jsonl`` (or to ``name.jsonl.tmp``, which becomes ``name.jsonl`` when it is
done). The file listing of Spark's own file stream takes a file once; this source takes the bytes that were
added, by a position for each file.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from verdictframe.functions.text import is_blank
from verdictframe.sources.records import CORRUPT, with_corrupt

SOURCE = "growing_lines"
LINES = "file string, start bigint, line string, ended boolean"
#: Bytes that a task reads, bytes read at once, lines of a batch handed to Spark.
TASK_BYTES, BLOCK_BYTES, BATCH_LINES = 64 << 20, 4 << 20, 8_192
_PARTIAL = ".tmp"


@dataclass
class Piece(InputPartition):
    """Bytes of one file: lines that begin in [start, end); ``first`` if a line surely begins at start."""

    name: str
    path: str
    start: int
    end: int
    first: bool


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path; Hadoop's ``file:/x`` is a URI too."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_bytes(uri: str, data: bytes) -> None:
    """One file with these bytes; its folder is made if need be."""
    files, path = file_system(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    with files.open_output_stream(path) as f:
        f.write(data)


class Files:
    """The files under a folder, by the name they have when finished; of a pair the finished one is taken."""

    def __init__(self, options):
        uri = options.get("path", "")
        if not uri:
            raise ValueError("the source needs a path")
        self.files, self.root = file_system(uri)
        self.pattern = options.get("pattern", "*.jsonl")
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))

    def sizes(self) -> dict[str, tuple[str, int, int]]:
        """Name to (path, size, time of change)."""
        out: dict[str, tuple[str, int, int]] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File:
                continue
            name = info.path[len(self.root) :].strip("/")
            final = name.removesuffix(_PARTIAL)
            if fnmatch.fnmatch(posixpath.basename(final), self.pattern) and (final not in out or name == final):
                out[final] = (info.path, info.size, info.mtime_ns or 0)
        return out

    def last_line_end(self, path: str, size: int) -> int:
        """The position after the last line end in the first ``size`` bytes, looked for from behind."""
        with self.files.open_input_file(path) as f:
            end = size
            while end > 0:
                start = max(0, end - BLOCK_BYTES)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def pieces(self, name: str, path: str, start: int, end: int) -> list[Piece]:
        return [Piece(name, path, x, min(end, x + self.task_bytes), x == start) for x in range(start, end, self.task_bytes)]

    def lines(self, piece: Piece) -> Iterator[tuple[int, bytes, bool]]:
        """(start, bytes, whether a line end follows) of the lines that begin in a piece."""
        with self.files.open_input_file(piece.path) as f:
            at = piece.start if piece.first else piece.start - 1
            f.seek(at)
            skip, open_ = not piece.first, []  # parts of a line whose end isn't read yet
            while block := f.read(BLOCK_BYTES):
                *ended, rest = block.split(b"\n")
                for part in ended:
                    line = b"".join([*open_, part]) if open_ else part
                    open_ = []
                    if not skip:
                        if at >= piece.end:
                            return
                        yield at, line, True
                    skip = False
                    at += len(line) + 1
                if not skip and at >= piece.end:
                    return
                if rest:
                    open_.append(rest)
            if open_ and not skip and at < piece.end:
                yield at, b"".join(open_), False

    def batches(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes, bool]] = []
        held = 0
        for row in self.lines(piece):
            if not row[1].strip():
                continue
            rows.append(row)
            held += len(row[1])
            if len(rows) >= BATCH_LINES or held >= BLOCK_BYTES:
                yield self._batch(piece.name, rows)
                rows, held = [], 0
        if rows:
            yield self._batch(piece.name, rows)

    @staticmethod
    def _batch(name: str, rows) -> pa.RecordBatch:
        start, line, ended = zip(*rows)
        text = [x.decode("utf-8", "replace") for x in line]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(start, pa.int64()), pa.array(text, pa.string()), pa.array(ended)], ["file", "start", "line", "ended"])


class _Stream(DataSourceStreamReader):
    """The offset of a batch is the position after the last whole line of each file."""

    def __init__(self, options):
        self.options = dict(options)
        self.seen: dict[str, tuple[int, int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, out = Files(self.options), {}
        for name, (path, size, changed) in files.sizes().items():
            known = self.seen.get(name)
            if known is None or known[:2] != (size, changed):
                known = (size, changed, files.last_line_end(path, size))
            self.seen[name] = known
            if known[2]:
                out[name] = known[2]
        return out

    def partitions(self, start: dict, end: dict):
        files = Files(self.options)
        there = files.sizes()
        out: list[Piece] = []
        for name, to in end.items():
            at = start.get(name, 0)
            if to < at:
                raise ValueError(f"{name} was cut from {at} to {to} bytes; only files that grow can be followed")
            if to > at:
                if name not in there:
                    raise ValueError(f"{name} is gone before its lines were read")
                out += files.pieces(name, there[name][0], at, to)
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return Files(self.options).batches(partition)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        files = Files(self.options)
        return [p for name, (path, size, _) in sorted(files.sizes().items()) for p in files.pieces(name, path, 0, size)] or [Piece("", "", 0, 0, True)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return Files(self.options).batches(partition) if partition.path else iter(())


class GrowingLines(DataSource):
    """``spark.read`` or ``spark.readStream`` format: options path, pattern (of the finished name), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def _loader(reader, path: str, pattern: str, task_bytes: int) -> DataFrame:
    return reader.format(SOURCE).option("path", path).option("pattern", pattern).option("taskBytes", task_bytes).load()


def follow(spark: SparkSession, path: str, pattern: str = "*.jsonl", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Stream of (file, start, line, ended): every non-blank line of every file once its line end is there.

    A line that has no end yet waits; its bytes are read in the batch that finds the end. Long additions
    are split over tasks of about ``task_bytes``. A query that starts again from its checkpoint goes on from the
    positions stored there, so nothing is lost or repeated, also when ``x.jsonl.tmp`` has become ``x.jsonl``.
    A file that got shorter fails the query. Offsets name every file, so many small files cost more
    than few large ones; a file that is removed and put back is read anew.
    """
    spark.dataSource.register(GrowingLines)
    return _loader(spark.readStream, path, pattern, task_bytes)


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(file, start, line, ended) of all non-blank lines that the files hold now; an unfinished last line has ended false."""
    spark.dataSource.register(GrowingLines)
    return _loader(spark.read, path, pattern, task_bytes)


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """``lines`` as rows of ``schema`` after file and start; what is no JSON record stays as text in ``_corrupt_record``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.where(~is_blank("line")).select("file", "start", F.from_json("line", with_corrupt(schema), options).alias("r")).select("file", "start", "r.*")


def until_torn(rows: DataFrame) -> DataFrame:
    """Rows of each file before its first line that is no record.

    The first such place of each file is an aggregate over the broken lines only; rows meet it by a join on the
    file, in which a file without broken lines has no partner. No file is sorted or gathered.
    """
    torn = rows.where(F.col(CORRUPT).isNotNull()).groupBy(F.col("file").alias("_file")).agg(F.min("start").alias("_torn"))
    kept = rows.join(torn, F.col("file") == F.col("_file"), "left").where(F.col("_torn").isNull() | (F.col("start") < F.col("_torn")))
    return kept.drop("_file", "_torn", CORRUPT)


def read_until_torn(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Batch twin of ``follow``: records of files that are still being written, each file up to its first broken line."""
    return until_torn(parsed(read_lines(spark, path, **options), schema))
