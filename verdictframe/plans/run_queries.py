"""Usage, reconciliation, manifests, catalogues, digests, reports and the trace streams."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdictframe.functions.text import is_blank
from verdictframe.operators import quality as Q
from verdictframe.operators import usage as U
from verdictframe.plans import tables as T
from verdictframe.plans.record_queries import GATED_SQL, raw_records
from verdictframe.plans.registry import query, round_columns
from verdictframe.operators import raw as RAW
from verdictframe.schemas import STEP_ORDER
from verdictframe.session import checkpointed, ensure_checkpoint_dir
from verdictframe.sources import growing as G
from verdictframe.sources import records as S
from verdictframe.streaming import traces as ST

MEASURES_SQL = """count(*) AS calls, count(*) FILTER (error) AS errors, coalesce(sum(input_tokens), 0)::bigint AS input_tokens,
  coalesce(sum(output_tokens), 0)::bigint AS output_tokens, count(*) FILTER (input_tokens IS NULL) AS missing_input_usage,
  count(*) FILTER (output_tokens IS NULL) AS missing_output_usage, sum(latency_ms)::bigint AS sum_call_ms"""


def _judged(spark, sf_dir):
    judge = F.concat(F.lit("j"), (F.col("run_id") % 3).cast("string"))
    return T.traces(spark, sf_dir).withColumns({"judge": judge, "run_id": F.concat(F.lit("r"), F.col("run_id").cast("string"))})


JUDGED_SQL = f"SELECT * REPLACE ('r' || run_id AS run_id), 'j' || (run_id % 3) AS judge FROM ({T.TRACES})"


@query(
    "usage_rollup",
    f"""SELECT CASE WHEN GROUPING(run_id) = 0 THEN 'run' WHEN GROUPING(judge) = 0 THEN 'judge' ELSE 'total' END AS level, run_id, judge,
  {MEASURES_SQL}, round(sum(latency_ms) / 3600000, 6) AS sum_call_hours FROM ({JUDGED_SQL}) GROUP BY GROUPING SETS ((run_id, judge), (judge), ())""",
)
def usage_rollup(spark, sf_dir):
    per_run = U.usage_by(_judged(spark, sf_dir), ["run_id", "judge"])
    return round_columns(U.usage_rollup(per_run), "sum_call_hours")


@query(
    "usage_with_verdicts",
    f"""WITH t AS ({JUDGED_SQL}), v AS (SELECT run_id, judge, count(*) AS verdicts FROM t WHERE NOT error AND run_id <> 'r4' GROUP BY ALL),
c AS (SELECT run_id, judge, count(*) AS calls, count(*) FILTER (error) AS errors FROM t GROUP BY ALL)
SELECT CASE WHEN GROUPING(run_id) = 0 THEN 'run' WHEN GROUPING(judge) = 0 THEN 'judge' ELSE 'total' END AS level, run_id, judge, sum(calls)::bigint AS calls, sum(errors)::bigint AS errors,
  sum(coalesce(verdicts, 0))::bigint AS verdicts FROM c LEFT JOIN v USING (run_id, judge) GROUP BY GROUPING SETS ((run_id, judge), (judge), ())""",
)
def usage_with_verdicts(spark, sf_dir):
    """Calls, errors and saved verdicts by run, judge and in total; one run has lost its verdicts."""
    t = _judged(spark, sf_dir)
    per_run = U.with_verdicts(U.usage_by(t, ["run_id", "judge"]), t.where(~F.col("error") & (F.col("run_id") != "r4")))
    return U.usage_rollup(per_run, measures=U.VERDICT_MEASURES).select("level", "run_id", "judge", "calls", "errors", "verdicts")


@query(
    "latency_summary",
    f"""SELECT model, count(*) AS calls, count(*) FILTER (error) AS errors, sum(input_tokens)::bigint AS input_tokens, quantile_cont(latency_ms, 0.5) AS p50_ms
FROM ({T.TRACES}) GROUP BY model""",
)
def latency_summary(spark, sf_dir):
    return U.latency_summary(T.traces(spark, sf_dir), ["model"])


@query("latency_summary_sketch")
def latency_summary_sketch(spark, sf_dir):
    return U.latency_summary(T.traces(spark, sf_dir), ["model"], exact=False)


@query(
    "reconcile_runs",
    f"""WITH t AS ({JUDGED_SQL}), c AS (SELECT run_id, count(*) AS calls, count(*) FILTER (error) AS errors, count(DISTINCT judge) AS cp, count(*) - count(DISTINCT event_id) AS dup FROM t GROUP BY run_id),
v AS (SELECT run_id, count(*) AS verdicts, count(DISTINCT judge) AS vp FROM (SELECT CASE WHEN run_id = 'r3' THEN 'r33' ELSE run_id END AS run_id, judge FROM t WHERE NOT error AND NOT (run_id = 'r5' AND event_id % 50 = 7)) GROUP BY run_id)
SELECT run_id, calls, verdicts, errors, calls IS NOT NULL AND verdicts IS NOT NULL AS in_both, coalesce(calls = verdicts + errors, false) AS balanced,
  coalesce(cp = 1 AND vp = 1, false) AS single_pair, coalesce(dup = 0, false) AS events_unique FROM c FULL JOIN v USING (run_id)""",
)
def reconcile_runs(spark, sf_dir):
    """Calls against saved verdicts, with one renamed run and one run that lost verdicts."""
    t = _judged(spark, sf_dir)
    lost = (F.col("run_id") == "r5") & (F.col("event_id") % 50 == 7)
    verdicts = t.where(~F.col("error") & ~lost).withColumn("run_id", F.when(F.col("run_id") == "r3", "r33").otherwise(F.col("run_id")))
    calls = U.call_sides(t, "run_id", "event_id", ["judge"], "error")
    return U.reconcile(calls, U.verdict_sides(verdicts, "run_id", ["judge"]))


@query("tail_events", f"SELECT event_id, model, latency_ms, input_tokens, error FROM ({T.TRACES}) ORDER BY ts DESC, event_id DESC LIMIT 20")
def tail_events(spark, sf_dir):
    return U.tail_events(T.traces(spark, sf_dir), 20, ("ts", "event_id")).select("event_id", "model", "latency_ms", "input_tokens", "error")


@query("events_of", "SELECT event_id, event_type, epoch_us(ts) AS at FROM events WHERE user_id = 7")
def events_of(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return U.events_of(events, 7, "user_id", "at").select("event_id", "event_type", "at")


@query("duplicate_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return Q.duplicates(T.table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query(
    "manifest_view",
    "SELECT user_id AS run_id, event_type AS key, arg_max(value, event_id) AS value, min(event_id) AS created_at, max(event_id) AS updated_at FROM events GROUP BY ALL",
)
def manifest_view(spark, sf_dir):
    entries = T.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), "value", F.col("event_id").alias("ts")
    )
    return S.manifest_view(entries)


@query("catalogue", "SELECT event_type AS dataset, count(*) AS n, max(event_id) AS updated_at FROM events GROUP BY event_type")
def catalogue(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").withColumnRenamed("event_type", "dataset")
    return S.catalogue(events, "dataset", "event_id")


@query(
    "runs_with_steps",
    """WITH x AS (SELECT DISTINCT user_id AS run_id, (event_id % 6)::int AS o FROM events WHERE (user_id + event_id) % 4 <> 0)
SELECT run_id, string_agg(['filter', 'perturb', 'validate', 'generate', 'label_eval', 'judge'][o + 1], ',' ORDER BY o) AS steps_present FROM x GROUP BY run_id""",
)
def runs_with_steps(spark, sf_dir):
    rows = T.table(spark, sf_dir, "events").where((F.col("user_id") + F.col("event_id")) % 4 != 0)
    named = rows.select(F.col("user_id").alias("run_id"), T.pick(F.col("event_id") % 6, STEP_ORDER).alias("step"))
    return S.runs_with_steps(named)


@query(
    "lookup_record",
    "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 1",
)
def lookup_record(spark, sf_dir):
    return S.find(T.table(spark, sf_dir, "conversations"), "conv_id", 3, "turn").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(
    "nonblank_lines",
    "SELECT lang, count(*) FILTER (trim(line) <> '') AS lines FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang",
)
def nonblank_lines(spark, sf_dir):
    lines = T.table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count_if(~is_blank("line")).alias("lines"))


@query(
    "digest_audit",
    """WITH f AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 13 <> 0),
m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(text) END AS expected FROM documents WHERE doc_id % 11 <> 0)
SELECT CASE WHEN sha IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unlisted' WHEN sha = expected THEN 'match' ELSE 'differs' END AS status, count(*) AS n
FROM f FULL JOIN m USING (doc_id) GROUP BY 1""",
)
def digest_audit(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    listed = docs.where("doc_id % 11 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("sha256")))
    out = Q.audit_digests(docs.where("doc_id % 13 <> 0"), listed, "doc_id")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "csv_columns",
    f"SELECT core_id, generator, kind, c1 || ';' || c2 AS cited_passage_ids, m1 || ';' || m2 AS modified_passage_ids, label FROM ({T.ANSWERS})",
)
def csv_columns(spark, sf_dir):
    rows = T.answers(spark, sf_dir).select("core_id", "generator", "kind", "cited_passage_ids", "modified_passage_ids", "label")
    return S.flat_columns(rows)


@query(
    "report_json",
    """SELECT '{"by_lang":[' || (SELECT string_agg(to_json({'lang': lang, 'n': n})::varchar, ',' ORDER BY to_json({'lang': lang, 'n': n})::varchar) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))
  || '],"labels":[' || (SELECT to_json({'quality': q, 'rows': n})::varchar FROM (SELECT sum(quality)::bigint AS q, count(*) AS n FROM labels)) || ']}' AS report""",
)
def report_json(spark, sf_dir):
    langs = T.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    labels = T.table(spark, sf_dir, "labels").agg(F.sum("quality").alias("quality"), F.count(F.lit(1)).alias("rows"))
    return S.report_json({"by_lang": langs, "labels": labels})


@query(
    "dataset_manifest",
    GATED_SQL
    + """ SELECT 'docs' AS name, (SELECT count(*) FROM documents) AS raw_row_count, count(*) FILTER (valid AND seeking AND NOT premise AND checked AND tagged >= 2) AS passing_gates,
  300 AS requested_n, 17 AS seed FROM g""",
)
def dataset_manifest(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    return S.dataset_manifest(raw, raw.where(RAW.passes_gates(F.col("raw"))), "docs", 17, 300)


# ---- sinks and scans: a driver table through the writer and back through the reader --------------

_DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _documents(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))


@query("jsonl_round_trip", "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, sf_dir):
    folder = f"{_work_folder(spark)}/docs"
    S.write_jsonl(_documents(spark, sf_dir), folder)
    return S.read_jsonl(spark, folder, _DOCS).select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


@query(
    "jsonl_append",
    """SELECT lang, count(*) AS n, sum(n_chars)::bigint AS chars, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS first_rows,
  (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS more_rows FROM documents GROUP BY lang""",
)
def jsonl_append(spark, sf_dir):
    """Two writes to one dataset; each reports its own row count."""
    folder, docs = f"{_work_folder(spark)}/docs", _documents(spark, sf_dir)
    first = S.write_jsonl(docs.where("doc_id % 3 = 0"), folder)
    more = S.append_jsonl(docs.where("doc_id % 3 <> 0"), folder)
    stored = S.read_jsonl(spark, folder, _DOCS).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return stored.withColumns({"first_rows": F.lit(first).cast("bigint"), "more_rows": F.lit(more).cast("bigint")})


@query(
    "landed_copy",
    "SELECT doc_id, source, (SELECT count(*) FROM documents) AS landed, (SELECT count(*) FROM documents) AS counted FROM documents",
)
def landed_copy(spark, sf_dir):
    """A raw dataset with blank lines of any kind, landed without them and counted."""
    folder = _work_folder(spark)
    line = F.to_json(F.struct("doc_id", "source"))
    blank = F.when(F.col("doc_id") % 4 == 0, F.array(line, F.lit(" \t"), F.lit(""))).otherwise(F.array(line))
    _documents(spark, sf_dir).select(F.explode(blank).alias("value")).write.text(f"{folder}/raw")
    landed = S.land_raw(spark, f"{folder}/raw", f"{folder}/landed")
    counted = S.count_lines(spark, f"{folder}/landed")
    rows = S.read_jsonl(spark, f"{folder}/landed", "doc_id bigint, source string")
    return rows.withColumns({"landed": F.lit(landed).cast("bigint"), "counted": F.lit(counted).cast("bigint")})


@query("torn_lines", "SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 0")
def torn_lines(spark, sf_dir):
    """A file still being written: every tenth line is torn off."""
    folder = f"{_work_folder(spark)}/docs"
    line = F.to_json(F.struct("doc_id", "lang"))
    _documents(spark, sf_dir).select(F.when(F.col("doc_id") % 10 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value")).write.text(folder)
    return S.read_growing(spark, folder, "doc_id bigint, lang string")


@query(
    "tagged_scan",
    """SELECT 'run' || (doc_id % 3) AS run_id, CASE doc_id % 3 WHEN 0 THEN 'ja' WHEN 1 THEN 'jb' END AS judge, lang, count(*) AS n FROM documents GROUP BY ALL""",
)
def tagged_scan(spark, sf_dir):
    """One scan over three run folders; a run without tags reads null."""
    folder, docs = _work_folder(spark), _documents(spark, sf_dir)
    for i in range(3):
        S.write_jsonl(docs.where(F.col("doc_id") % 3 == i).select("doc_id", "lang"), f"{folder}/run{i}")
    tags = {"run0": {"judge": "ja"}, "run1": {"judge": "jb"}}
    rows = S.read_tagged(spark, [f"{folder}/run{i}" for i in range(3)], "doc_id bigint, lang string", tags)
    return rows.groupBy("run_id", "judge", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "growing_files",
    """WITH d AS (SELECT doc_id, lang, n_chars::bigint AS n_chars, doc_id % (SELECT greatest(8, (count(*) + 19999) // 20000) FROM documents) AS f FROM documents)
SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY f ORDER BY doc_id) <= count(*) OVER (PARTITION BY f) // 2 AS early, 1::bigint AS arrivals, 1::bigint AS in_batch FROM d""",
)
def growing_files(spark, sf_dir):
    """Files followed while they grow: first to the middle of a line, then, by the same query started anew, to a torn end.

    Every line arrives once, those before the tear in the first run, and the rows are those of the batch read.
    """
    folder = _work_folder(spark)
    docs = _documents(spark, sf_dir).select("doc_id", "lang", "n_chars")
    count = docs.count()
    lines = docs.select((F.col("doc_id") % max(8, -(-count // 20_000))).alias("f"), "doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("line"))

    def grow(done: bool):
        def write(key, rows):
            text = [f"{x}\n".encode() for x in rows.sort_values("doc_id")["line"]]
            half = len(text) // 2
            data = b"".join(text) + b'{"doc_id": 1, "la' if done else b"".join(text[:half]) + text[half][:9]
            G.write_bytes(f"{folder}/raw/part-{key[0]}.jsonl.tmp", data)
            return rows[["doc_id"]].head(1)

        return lines.groupBy("f").applyInPandas(write, "doc_id bigint").count()

    def drain():
        rows = G.parsed(G.follow(spark, f"{folder}/raw", task_bytes=1 << 20), "doc_id bigint, lang string, n_chars bigint")
        return ST.run_to_files(rows, f"{folder}/rows", f"{folder}/checkpoint")

    grow(False)
    early = checkpointed(drain().select("file", "start", F.lit(True).alias("early")))
    grow(True)
    streamed, batch = G.until_torn(drain()), G.read_until_torn(spark, f"{folder}/raw", "doc_id bigint, lang string, n_chars bigint")
    both = streamed.withColumns({"s": F.lit(1), "b": F.lit(0)}).unionByName(batch.withColumns({"s": F.lit(0), "b": F.lit(1)}))
    counted = both.groupBy("file", "start", "doc_id", "lang", "n_chars").agg(F.sum("s").alias("arrivals"), F.sum("b").alias("in_batch"))
    return counted.join(early, ["file", "start"], "left").select("doc_id", "lang", "n_chars", F.coalesce("early", F.lit(False)).alias("early"), "arrivals", "in_batch")


@query(
    "catalogue_folders",
    """SELECT 'part' || f AS dataset, count(*) AS n, (5 - f)::int AS place, true AS in_files FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 3 ELSE 4 END AS f FROM documents) GROUP BY f""",
)
def catalogue_folders(spark, sf_dir):
    """Datasets written one after the other, listed newest first from file listing and footers alone."""
    folder, i = _work_folder(spark), F.col("doc_id")
    part = F.when(i % 2 == 0, 1).when(i % 3 == 0, 2).when(i % 5 == 0, 3).otherwise(4)
    for f in range(1, 5):
        _documents(spark, sf_dir).where(part == f).write.parquet(f"{folder}/part{f}")
        time.sleep(1.1)  # file times may have whole seconds
    listed = S.catalogue_of(spark, folder)
    place = F.row_number().over(Window.orderBy(F.desc("updated_at"), "dataset"))  # one row for each dataset
    return listed.select("dataset", "n", place.alias("place"), (F.col("files") > 0).alias("in_files"))


@query(
    "file_digests",
    """WITH d AS (SELECT doc_id, lang || ' ' || source || ' ' || n_chars AS line, doc_id % (SELECT greatest(8, (count(*) + 19999) // 20000) FROM documents) AS f FROM documents)
SELECT f::int AS f, sum(strlen(line) + 1)::bigint AS length, sha256(string_agg(line, chr(10) ORDER BY doc_id) || chr(10)) AS sha256, 'match' AS status FROM d GROUP BY f""",
)
def file_digests(spark, sf_dir):
    """Digests of written files, read in small blocks, and their audit against a manifest made of the first reading."""
    folder, docs = _work_folder(spark), _documents(spark, sf_dir)
    files = max(8, -(-docs.count() // 20_000))
    line = F.concat_ws(" ", "lang", "source", F.col("n_chars").cast("string"))
    rows = docs.select((F.col("doc_id") % files).alias("f"), "doc_id", line.alias("value"))
    rows.repartition(files, "f").sortWithinPartitions("f", "doc_id").select("f", "value").write.partitionBy("f").text(folder)
    manifest = checkpointed(Q.digests(spark, folder, "*.txt"))
    audited = Q.audit_digests(Q.digests(spark, folder, "*.txt", block=1000), manifest.select("path", "sha256"))
    return audited.select(F.regexp_extract("path", r"f=(\d+)", 1).cast("int").alias("f"), "length", "sha256", "status")


@query(
    "frozen_dataset",
    """WITH s AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 20 = 3), k AS (SELECT lang || '/' || coalesce(nullif(CASE WHEN doc_id % 40 = 3 THEN source ELSE '' END, ''), '?') AS stratum, count(*) AS n FROM s GROUP BY 1)
SELECT 'frozen' AS name, (SELECT count(*) FROM documents) AS raw_row_count, (SELECT count(*) FROM documents WHERE doc_id % 2 = 1) AS passing_gates, (SELECT count(*) FROM s) AS selected_n,
  (SELECT string_agg(stratum || '=' || n, ',' ORDER BY stratum) FROM k) AS strata, (SELECT md5(string_agg(doc_id::varchar, ',' ORDER BY doc_id)) FROM s) AS ids, true AS refused, (SELECT count(*) FROM s) AS stored""",
)
def frozen_dataset(spark, sf_dir):
    """A sample frozen with its manifest (strata, ids); freezing it again is refused and changes nothing."""
    folder, docs = _work_folder(spark), _documents(spark, sf_dir)
    sample = docs.where("doc_id % 20 = 3").select("doc_id", "lang", F.when(F.col("doc_id") % 40 == 3, F.col("source")).otherwise("").alias("source"))
    requested = sample.count()
    manifest = S.dataset_manifest(docs, docs.where("doc_id % 2 = 1"), "frozen", 17, requested, sample, ["lang", "source"], "doc_id")
    S.freeze_dataset(sample, f"{folder}/rows", manifest, f"{folder}/manifest")
    try:
        S.freeze_dataset(sample.limit(1), f"{folder}/rows", manifest, f"{folder}/manifest")
        refused = False
    except AnalysisException as error:
        refused = error.getCondition() == "PATH_ALREADY_EXISTS"
    kept = spark.read.schema("name string, raw_row_count bigint, passing_gates bigint, selected_n bigint, strata_counts map<string,bigint>, sample_ids array<bigint>").json(f"{folder}/manifest")
    entries = F.array_sort(F.transform(F.map_entries("strata_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    stored = S.read_jsonl(spark, f"{folder}/rows", "doc_id bigint").count()
    return kept.select(
        "name", "raw_row_count", "passing_gates", "selected_n", F.array_join(entries, ",").alias("strata"),
        F.md5(F.array_join(F.transform("sample_ids", lambda x: x.cast("string")), ",")).alias("ids"), F.lit(refused).alias("refused"), F.lit(stored).cast("bigint").alias("stored"),
    )


@query("csv_round_trip", "SELECT doc_id, lang || ';' || source AS tags, '' AS none, lang || '\"quoted\"' AS odd FROM documents")
def csv_round_trip(spark, sf_dir):
    """Rows with lists through the CSV writer and back."""
    folder = f"{_work_folder(spark)}/csv"
    docs = _documents(spark, sf_dir)
    rows = docs.select("doc_id", F.array("lang", "source").alias("tags"), F.lit(None).cast("array<int>").alias("none"), F.concat("lang", F.lit('"quoted"')).alias("odd"))
    S.write_csv(rows, folder)
    back = spark.read.option("header", "true").option("escape", '"').option("nullValue", "-").schema("doc_id bigint, tags string, none string, odd string").csv(folder)
    return back.withColumn("none", F.coalesce("none", F.lit("")))


@query(
    "final_files",
    """SELECT 'run' || (doc_id % 5) || '/judge.jsonl' AS file, CASE WHEN doc_id % 5 IN (1, 3) THEN 'tmp' ELSE 'final' END AS taken, count(*) AS n FROM documents GROUP BY doc_id % 5""",
)
def final_files(spark, sf_dir):
    """Of a finished file and the partial one beside it the finished one is read, else the partial one."""
    i = F.col("doc_id") % 5
    run = F.concat(F.lit("run"), i.cast("string"), F.lit("/judge.jsonl"))
    both = F.when(i.isin(1, 3), F.array(F.lit(".tmp"))).otherwise(F.array(F.lit(".tmp"), F.lit("")))
    files = _documents(spark, sf_dir).select("doc_id", run.alias("run"), F.explode(both).alias("end")).select("doc_id", F.concat("run", "end").alias("path"))
    taken = S.prefer_final(files.select("path").distinct())
    rows = files.join(taken, "path").groupBy("file", "path").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("file", F.when(F.endswith("path", F.lit(".tmp")), "tmp").otherwise("final").alias("taken"), "n")


# ---- streams ----------------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    schema = T.table(spark, sf_dir, "events").schema
    return T.trace_columns(ST.trace_stream(spark, f"{sf_dir}/events*.parquet", schema, "parquet"))


def _work_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query(
    "stream_usage_window",
    f"""SELECT epoch(date_trunc('day', ts))::bigint AS day, model, count(*) AS calls, count(*) FILTER (error) AS errors, sum(input_tokens)::bigint AS input_tokens,
  count(*) FILTER (input_tokens IS NULL) AS missing_input_usage, sum(latency_ms)::bigint AS sum_call_ms FROM ({T.TRACES}) GROUP BY ALL""",
)
def stream_usage_window(spark, sf_dir):
    """Daily usage per model; complete mode, so windows the watermark still holds are shown too."""
    folder = _work_folder(spark)
    windows = ST.usage_windows(_event_stream(spark, sf_dir))
    out = ST.run_available(windows, f"usage_{uuid.uuid4().hex}", "complete", f"{folder}/checkpoint")
    return out.select(F.unix_seconds("w.start").alias("day"), *[c for c in out.columns if c != "w"])


def _landed_quarters(spark, sf_dir, folder, copies=False):
    """The events landing as four quarters in event time: after each, a stream over all that has landed.

    Every fifth event comes again a quarter later if ``copies``. A quarter keeps the partitions it has.
    """
    events = T.table(spark, sf_dir, "events").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = events.approxQuantile("_t", [0.25, 0.5, 0.75], 0.001)
    number = sum((F.col("_t") > F.lit(int(c))).cast("int") for c in cuts)
    numbered = events.withColumn("_f", number)
    if copies:
        numbered = numbered.unionByName(numbered.where("event_id % 5 = 0").withColumn("_f", F.col("_f") + 1))
    schema = T.table(spark, sf_dir, "events").schema
    for f in range(len(cuts) + 1 + int(copies)):
        numbered.where(F.col("_f") == f).drop("_f", "_t").write.mode("append").parquet(f"{folder}/landed")
        yield ST.trace_stream(spark, f"{folder}/landed", schema, "parquet")


@query(
    "stream_usage_closed",
    f"""WITH t AS ({T.TRACES}) SELECT epoch(date_trunc('day', ts))::bigint AS day, model, count(*) AS calls, count(*) FILTER (error) AS errors, sum(input_tokens)::bigint AS input_tokens,
  count(*) FILTER (input_tokens IS NULL) AS missing_input_usage, sum(latency_ms)::bigint AS sum_call_ms FROM t
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM t) - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def stream_usage_closed(spark, sf_dir):
    """Daily usage over several batches, appended to files as the watermark closes a day; state expires with it."""
    folder = _work_folder(spark)
    for stream in _landed_quarters(spark, sf_dir, folder):
        out = ST.run_to_files(ST.usage_windows(T.trace_columns(stream)), f"{folder}/usage", f"{folder}/checkpoint")
    return out.select(F.unix_seconds("w.start").alias("day"), *[c for c in out.columns if c != "w"])


@query(
    "stream_dedup_batches",
    f"SELECT model, count(*) AS events, sum(latency_ms)::bigint AS sum_call_ms FROM ({T.TRACES}) GROUP BY model",
)
def stream_dedup_batches(spark, sf_dir):
    """Copies that arrive in a later batch than their event are not counted again."""
    folder = _work_folder(spark)
    for stream in _landed_quarters(spark, sf_dir, folder, copies=True):
        events = ST.run_to_files(ST.dedup_events(T.trace_columns(stream)), f"{folder}/events", f"{folder}/checkpoint")
    return events.groupBy("model").agg(F.count(F.lit(1)).alias("events"), F.sum("latency_ms").alias("sum_call_ms"))


@query(
    "stream_upsert_shared",
    """SELECT user_id, count(*) AS rows, (SELECT count(DISTINCT user_id) FROM events WHERE event_id % 2 = 0) AS first_keys
FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id""",
)
def stream_upsert_shared(spark, sf_dir):
    """Two streams of several batches, one after the other, with checkpoints of their own and one target."""
    folder = _work_folder(spark)
    first_keys = None
    for i, half in enumerate(("even", "odd")):
        for stream in _landed_quarters(spark, sf_dir, f"{folder}/{half}"):
            own = stream.where(F.col("event_id") % 2 == i).select("user_id", "event_type")
            ST.upsert_steps(own, f"{folder}/target", f"{folder}/checkpoint-{half}", ["user_id"]).start().awaitTermination()
        if first_keys is None:
            first_keys = spark.read.parquet(f"{folder}/target").count()
    stored = spark.read.parquet(f"{folder}/target")
    counted = stored.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("first_keys", F.lit(first_keys).cast("bigint"))


@query(
    "stream_dedup_count",
    f"SELECT model, count(*) AS events, sum(latency_ms)::bigint AS sum_call_ms FROM ({T.TRACES}) GROUP BY model",
)
def stream_dedup_count(spark, sf_dir):
    """A stream in which every fifth event arrives twice counts each event once."""
    folder = _work_folder(spark)
    copies = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    doubled = _event_stream(spark, sf_dir).withColumn("copy", F.explode(copies)).drop("copy")
    events = ST.run_to_files(ST.dedup_events(doubled), f"{folder}/events", f"{folder}/checkpoint")
    return events.groupBy("model").agg(F.count(F.lit(1)).alias("events"), F.sum("latency_ms").alias("sum_call_ms"))


@query(
    "stream_live_status",
    f"SELECT model AS step, CASE WHEN error THEN 'failed' WHEN input_tokens IS NULL THEN 'unset' ELSE 'ok' END AS status, count(*) AS n FROM ({T.TRACES}) GROUP BY ALL",
)
def stream_live_status(spark, sf_dir):
    folder = _work_folder(spark)
    status = F.when(F.col("error"), "failed").when(F.col("input_tokens").isNotNull(), "ok")
    rows = _event_stream(spark, sf_dir).select(F.col("model").alias("step"), status.alias("status"))
    return ST.run_available(ST.live_status(rows), f"status_{uuid.uuid4().hex}", "complete", f"{folder}/checkpoint")


@query(
    "stream_status_moves",
    """SELECT step, status, count(*) AS n, (SELECT count(DISTINCT user_id) FROM events) AS records FROM (
  SELECT event_type AS step, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 4 = 0 THEN 'unset' ELSE 'ok' END AS status,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1 GROUP BY ALL""",
)
def stream_status_moves(spark, sf_dir):
    """Records that move on over four batches count where they are last; moves are appended to files."""
    folder = _work_folder(spark)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 4 != 0, "ok")
    for stream in _landed_quarters(spark, sf_dir, folder):
        rows = stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("step"), status.alias("status"))
        moves = ST.run_to_files(ST.status_moves(rows, "user_id", tie="event_id", ttl="36500 days"), f"{folder}/moves", f"{folder}/checkpoint")
    records = moves.agg(F.sum("delta").alias("n")).scalar()
    return ST.status_counts_of(moves).withColumn("records", records)


@query("stream_upsert", "SELECT user_id, count(*) AS rows FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    """Step outputs keyed by question: each key is stored once, however often it arrives."""
    folder = _work_folder(spark)
    schema = T.table(spark, sf_dir, "events").schema
    stream = ST.trace_stream(spark, f"{sf_dir}/events*.parquet", schema, "parquet").select("user_id", "event_type")
    ST.upsert_steps(stream, f"{folder}/target", f"{folder}/checkpoint", ["user_id"]).start().awaitTermination()
    stored = spark.read.parquet(f"{folder}/target")
    return stored.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
