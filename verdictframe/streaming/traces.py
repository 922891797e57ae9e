"""Structured Streaming versions of the trace reports.

The default lateness is ten minutes; the batch reports have no notion of late rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.operators.history import pending
from verdictframe.schemas import TRACES

DEFAULT_DELAY = "10 minutes"


def trace_stream(
    spark: SparkSession, path: str, schema: str = TRACES, fmt: str = "json", files_per_trigger: int | None = None
) -> DataFrame:
    """Rows of newly landed files. A file must land whole; growing files are not followed."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def with_event_time(df: DataFrame, source: str = "started_at", out: str = "ts") -> DataFrame:
    """Epoch seconds to TIMESTAMP; a TIMESTAMP_NTZ column is only cast."""
    kind = dict(df.dtypes)[source]
    value = F.col(source).cast("timestamp") if kind.startswith("timestamp") else F.timestamp_seconds(source)
    return df.withColumn(out, value)


def live_status(df: DataFrame, step: str = "step", status: str = "status") -> DataFrame:
    """Counts per (step, status); run it in update mode."""
    return df.groupBy(step, F.coalesce(F.col(status), F.lit("unset")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def status_moves(
    stream: DataFrame, key: str, step: str = "step", status: str = "status", ts: str = "ts", tie: str | None = None, ttl: str = "7 days", delay: str = DEFAULT_DELAY
) -> DataFrame:
    """(step, status, delta): +1 where a record arrives in a status, -1 where it leaves one; append these to files.

    The state store holds the last (step, status) of each record, so a record that moves on is taken from where it was
    counted. A row that is older than the stored one (by ``ts``, then ``tie``) changes nothing. A record
    without a row for ``ttl`` of event time is forgotten, which keeps its count: what it does after that counts
    as a new record. Rows without a key have no record and are left out.
    """
    span = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = stream.where(F.col(key).isNotNull()).withWatermark(ts, delay)
    rows = rows.select(
        F.col(key).alias("_key"), ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), (F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")).alias("tie"),
        F.col(step).cast("string").alias("step"), F.coalesce(F.col(status), F.lit("unset")).alias("status"),
    )

    def move(_, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for f in frames:
            row = _latest_row(f)
            if best is None or row[:2] > best[:2]:
                best = row
        old = tuple(state.get) if state.exists else None
        if old is None or best[:2] > old[:2]:
            state.update(best)
            if old is None or old[2:] != best[2:]:
                left = [old] if old is not None else []
                yield pd.DataFrame({"step": [r[2] for r in (best, *left)], "status": [r[3] for r in (best, *left)], "delta": [1, -1][: 1 + len(left)]})
            old = best
        state.setTimeoutTimestamp(max(int(old[0]) // 1000, state.getCurrentWatermarkMs()) + span)

    return rows.groupBy("_key").applyInPandasWithState(
        move, "step string, status string, delta bigint", "at bigint, tie bigint, step string, status string", "append", "EventTimeTimeout"
    )


def _latest_row(frame: pd.DataFrame) -> tuple:
    """(at, tie, step, status) of the row with the greatest (at, tie), the first of equal ones; a null counts as the oldest.

    A few array steps, as it is called for every record.
    """
    at, tie = (np.where(np.isnan(x), -(2.0**62), x) if x.dtype.kind == "f" else x for x in (frame["at"].to_numpy(), frame["tie"].to_numpy()))
    i = 0
    if len(at) > 1:
        last = np.flatnonzero(at == at.max())
        i = last[0] if len(last) == 1 else last[tie[last].argmax()]
    return int(at[i]), int(tie[i]), frame["step"].to_numpy()[i], frame["status"].to_numpy()[i]


def status_counts_of(moves: DataFrame) -> DataFrame:
    """Records per (step, status) from the appended moves."""
    return moves.groupBy("step", "status").agg(F.sum("delta").alias("n")).where("n <> 0")


def dedup_events(df: DataFrame, ids: Sequence[str] = ("event_id",), ts: str = "ts", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Drops repeats of an event id that arrive within the watermark; state expires with it."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def usage_windows(
    df: DataFrame, keys: Sequence[str] = ("model",), ts: str = "ts", width: str = "1 day", delay: str = DEFAULT_DELAY
) -> DataFrame:
    """Calls, errors, tokens and latency per model and tumbling window."""
    failed = F.coalesce(F.col("error").cast("boolean"), F.lit(False))
    grouped = df.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *keys)
    return grouped.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(failed).alias("errors"),
        F.sum("input_tokens").alias("input_tokens"),
        F.count_if(F.col("input_tokens").isNull()).alias("missing_input_usage"),
        F.sum("latency_ms").alias("sum_call_ms"),
    )


def upsert_steps(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("core_id",), splits: int = 64):
    """Append step outputs whose key is not in ``target`` yet; replaying a batch adds nothing.

    Each batch is written under its own (writer, batch_id) partition with overwrite, and the anti-join
    leaves that partition out, so a batch that is run twice writes the same rows twice over. ``writer``
    follows from the checkpoint: streams that start anew or share the target never meet in a partition.
    Of rows with one key the one with the smallest hash of all columns stays.

    Below that, rows lie in ``splits`` by a hash of their key, and a batch reads only the splits that its own keys fall
    into: a small batch meets a small part of the target. All writers of a target must give the same ``splits``.
    """
    writer = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = f"{target}/writer={writer}/batch_id={batch_id}"
        shown = F.to_json(F.struct(*batch.columns))
        fresh = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.md5(shown)).alias("_r")).select("_r.*")
        fresh = fresh.withColumn("split", F.pmod(F.xxhash64(*keys), F.lit(splits)).cast("int")).persist()
        try:
            met = sorted(r["split"] for r in fresh.select("split").distinct().collect())  # at most ``splits`` numbers
            done, new = stored_in(spark, target, met), fresh
            if done is not None:
                new = pending(fresh, done.where((F.col("writer") != writer) | (F.col("batch_id") != batch_id)), keys)
            new.select(*batch.columns, "split").repartition(max(1, len(met)), "split").write.mode("overwrite").partitionBy("split").parquet(part)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stored_in(spark: SparkSession, target: str, splits: Sequence[int]) -> DataFrame | None:
    """The rows of some splits of a target; the files of all others are pruned by their path. None if there is no target."""
    stored = _stored(spark, target)
    return None if stored is None else stored.where(F.col("split").isin(list(splits)))


def _stored(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.parquet(target)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Drain what has landed into an in-memory table and return it; for results of bounded size."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Drain what has landed into Parquet files (append, exactly once) and read them back."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
