"""Readers and writers for record, trace and report files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from verdictframe.functions.text import is_blank
from verdictframe.schemas import STEP_ORDER

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines as one VARIANT column, for input whose keys may be absent; a broken line fails the read."""
    return spark.read.option("singleVariantColumn", "raw").option("mode", "FAILFAST").json(path)


def read_raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines as text (``line``) and as VARIANT (``raw``), for rules that need the order of keys; a broken line fails the read."""
    lines = spark.read.text(path).where(~is_blank("value"))
    return lines.select(F.col("value").alias("line"), F.parse_json("value").alias("raw"))


def read_growing(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Complete rows of files still being written; unreadable lines are left out.

    Every broken line is dropped, not only those after the first one: lines of a split file have
    no common order to stop at.
    """
    rows = read_with_dead_letters(spark, path, schema)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_with_dead_letters(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """All non-blank rows, broken lines kept as text in ``_corrupt_record``.

    Lines are parsed with ``from_json`` rather than by the JSON reader, which refuses queries that
    need nothing but the broken lines.
    """
    lines = spark.read.text(path).where(~is_blank("value"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.select(F.from_json("value", with_corrupt(schema), options).alias("r")).select("r.*")


def with_corrupt(schema: str | StructType) -> StructType:
    parsed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return StructType([*parsed.fields, StructField(CORRUPT, StringType())])


def prefer_final(files: DataFrame, path: str = "path") -> DataFrame:
    """Of ``x.jsonl`` and ``x.jsonl.tmp`` keep the finished one."""
    name = F.regexp_replace(path, r"\.tmp$", "")
    finished = (~F.endswith(F.col(path), F.lit(".tmp"))).cast("int")
    return files.groupBy(name.alias("file")).agg(F.max_by(path, finished).alias(path))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write JSON lines and return the row count, observed during the same job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def append_jsonl(df: DataFrame, path: str) -> int:
    return write_jsonl(df, path, "append")


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> int:
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get["n"]


def count_lines(spark: SparkSession, path: str | list[str]) -> int:
    """Number of non-blank lines."""
    return spark.read.text(path).where(~is_blank("value")).count()


def land_raw(spark: SparkSession, source: str, target: str, limit: int | None = None) -> int:
    """Copy a landed raw dataset, optionally only its first rows."""
    lines = spark.read.text(source).where(~is_blank("value"))
    seen = Observation()
    rows = lines.limit(limit) if limit is not None else lines
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").text(target)
    return seen.get["n"]


def read_tagged(spark: SparkSession, path: str | list[str], schema: str, tags: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One scan over many runs; a row's tags come from the run folder in its path. A broken line fails the read.

    ``tags`` maps run folder to tag values. It is configuration, so it becomes a literal map in
    the plan instead of a join.
    """
    rows = read_jsonl(spark, path, schema)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    rows = rows.withColumn("run_id", run)
    names = sorted({t for values in tags.values() for t in values})
    for name in names:
        pairs = [F.lit(x) for r, values in tags.items() if name in values for x in (r, values[name])]
        rows = rows.withColumn(name, F.create_map(*pairs)[F.col("run_id")])
    return rows


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", separator: str = ";") -> None:
    """CSV with header; array columns are joined by ``;`` and missing arrays read ''."""
    flat_columns(df, separator).write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def flat_columns(df: DataFrame, separator: str = ";") -> DataFrame:
    """Array columns as joined text, everything else as it is."""
    return df.select(
        *[_joined(F.col(n), separator).alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes]
    )


def _joined(c: Column, separator: str) -> Column:
    return F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), separator), F.lit(""))


def report_json(sections: Mapping[str, DataFrame], most_rows: int = 10_000) -> DataFrame:
    """One-row table with a JSON document; each section is an aggregated result table.

    A section of more than ``most_rows`` rows is no report: it fails, and no more rows than that are gathered.
    """
    parts = []
    for name, df in sections.items():
        rows = F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))
        text = F.concat(F.lit(f'"{name}":['), F.array_join(rows, ","), F.lit("]"))
        too_many = F.raise_error(F.lit(f"section {name} has more than {most_rows} rows")).cast("string")
        parts.append(df.limit(most_rows + 1).agg(F.when(F.count(F.lit(1)) > most_rows, too_many).otherwise(text).alias("part")))
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    body = F.array_join(F.sort_array(F.collect_list("part")), ",")
    return union.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("report"))


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    report_json(sections).write.mode("overwrite").text(path)


def freeze_dataset(df: DataFrame, path: str, manifest: DataFrame, manifest_path: str, overwrite: bool = False) -> int:
    """Write a dataset that refuses to be overwritten, then its one-row manifest."""
    mode = "overwrite" if overwrite else "errorifexists"
    n = write_jsonl(df, path, mode)
    manifest.withColumn("selected_n", F.lit(n)).write.mode(mode).json(manifest_path)
    return n


def dataset_manifest(
    raw: DataFrame, passing: DataFrame, name: str, seed: int, requested: int, selected: DataFrame | None = None, strata: Sequence[str] = (), sample_id: str | None = None
) -> DataFrame:
    """Counts behind a dataset as one row; with ``selected`` also how many rows each stratum has, and the ids.

    A stratum's name joins its columns by ``/``, ``?`` for what is missing. Ids come in order. Both describe a sample that
    was drawn to a requested size, so they are as long as that sample, not as the raw data.
    """
    out = raw.agg(F.count(F.lit(1)).alias("raw_row_count")).select(
        F.lit(name).alias("name"),
        "raw_row_count",
        passing.agg(F.count(F.lit(1))).scalar().alias("passing_gates"),
        F.lit(requested).alias("requested_n"),
        F.lit(seed).alias("seed"),
    )
    if selected is not None and strata:
        named = F.concat_ws("/", *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("?")) for c in strata])
        counted = selected.groupBy(named.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
        out = out.withColumn("strata_counts", counted.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stratum", "n"))))).scalar())
    if selected is not None and sample_id:
        out = out.withColumn("sample_ids", selected.agg(F.sort_array(F.collect_list(F.col(sample_id)))).scalar())
    return out


def manifest_view(entries: DataFrame, keys: Sequence[str] = ("run_id", "key"), value: str = "value", at: str = "ts") -> DataFrame:
    """Current value per (run, key) from appended entries; created_at is kept, updated_at moves."""
    return entries.groupBy(*keys).agg(
        F.max_by(value, at).alias(value), F.min(at).alias("created_at"), F.max(at).alias("updated_at")
    )


def catalogue(rows: DataFrame, dataset: str, updated: str) -> DataFrame:
    """Datasets with row counts, newest first."""
    counted = rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"), F.max(updated).alias("updated_at"))
    return counted.orderBy(F.desc("updated_at"), dataset)


def catalogue_of(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Datasets in the folders under ``root`` with files, rows and time of the last write, newest first.

    A dataset is a folder right under ``root``. No column is read: Parquet counts come from the file footers,
    everything else from the file listing.
    """
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(F.replace(path, F.lit("%20"), F.lit(" ")), r"([^/]+)/[^/]+$", 1)
    rows = spark.read.format(fmt).load(f"{root.rstrip('/')}/*")
    per_file = rows.groupBy(name.alias("dataset"), path.alias("_path"), F.col("_metadata.file_modification_time").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    counted = per_file.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.sum("_n").alias("n"), F.max("_at").alias("updated_at"))
    return counted.orderBy(F.desc("updated_at"), "dataset")


def runs_with_steps(rows: DataFrame, run: str = "run_id", step: str = "step") -> DataFrame:
    """Runs, newest id first, with the steps present in step order."""
    order = F.array(*[F.lit(s) for s in STEP_ORDER])
    known = F.when(F.col(step).isin(*STEP_ORDER), F.col(step))  # other names don't gather, their runs stay
    present = rows.groupBy(run).agg(F.collect_set(known).alias("_s"))
    kept = F.filter(order, lambda s: F.array_contains("_s", s))
    return present.select(run, F.array_join(kept, ",").alias("steps_present")).orderBy(F.desc(run))


def with_file(df: DataFrame, out: str = "file") -> DataFrame:
    return df.withColumn(out, F.col("_metadata.file_path"))


def find(df: DataFrame, key: str | None = None, value=None, seq: str | None = None, index: int | None = None) -> DataFrame:
    """First record with the given id or at the given ordinal."""
    rows = df.where(F.col(key) == value) if key is not None and value is not None else df
    if index is not None:
        rows = rows.where(F.col(seq) == index)
    return (rows.orderBy(seq) if seq else rows).limit(1)
