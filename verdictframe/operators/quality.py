"""Expectations on a table, and file digests against a manifest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.sources.growing import file_system


def expect(df: DataFrame, checks: Mapping[str, tuple[Column, object]]) -> DataFrame:
    """(check, observed, expected, ok) for aggregate expressions, all computed in one pass."""
    observed = df.agg(*[c.cast("string").alias(name) for name, (c, _) in checks.items()])
    entries = [
        F.struct(
            F.lit(name).alias("check"),
            F.col(name).alias("observed"),
            F.lit(str(value)).alias("expected"),
            F.coalesce(F.col(name) == str(value), F.lit(False)).alias("ok"),
        )
        for name, (_, value) in checks.items()
    ]
    return observed.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def assert_all(results: DataFrame) -> DataFrame:
    """The same table, failing the job when a check does not hold."""
    message = F.concat_ws(" ", F.lit("expectation failed:"), "check", F.lit("observed"), "observed")
    return results.withColumn("ok", F.when(F.assert_true("ok", message).isNull(), F.col("ok")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def digests(spark: SparkSession, path: str, glob: str | None = None, block: int = 8 << 20) -> DataFrame:
    """(path, length, sha256) per file, of any size: a task reads a file in blocks of ``block`` bytes.

    The listing needs no content, so the limit of a binary cell doesn't apply, and empty files count. Files are
    dealt over tasks by path.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    listed = [(re.sub("^file:/+", "file:/", unquote(uri)),) for uri in reader.load(path).inputFiles()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.createDataFrame(listed, "path string").repartition(tasks, "path")

    def run(batches):
        for b in batches:
            lengths, found = [], []
            for uri in b.column(0).to_pylist():
                digest, length = hashlib.sha256(), 0
                system, place = file_system(uri)
                with system.open_input_stream(place) as f:
                    while part := f.read(block):
                        digest.update(part)
                        length += len(part)
                lengths.append(length)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.array(found, pa.string())], ["path", "length", "sha256"])

    return files.mapInArrow(run, "path string, length bigint, sha256 string")


def audit_digests(found: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """match, differs, missing (listed only) or unlisted (found only)."""
    listed = manifest.select(key, F.col("sha256").alias("expected"))
    status = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("expected").isNull(), "unlisted")
        .when(F.col("sha256") == F.col("expected"), "match")
        .otherwise("differs")
    )
    return found.join(listed, key, "full").withColumn("status", status)
