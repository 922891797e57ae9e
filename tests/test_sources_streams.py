"""Files in and out, manifests, digests; streams against their batch twins."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from verdictframe import schemas
from verdictframe.operators import quality, responses, status, usage
from verdictframe.operators import steps as steps_
from verdictframe.operators import raw as RAW
from verdictframe.sources import records as S
from verdictframe.streaming import traces as ST


def write_lines(path, lines):
    path.mkdir(parents=True, exist_ok=True)
    (path / "part.jsonl").write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_schemas_parse(spark):
    for ddl in (schemas.CORE, schemas.TRACES, schemas.REVIEW_LABELS):
        assert spark.createDataFrame([], ddl).count() == 0


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.range(7).select(F.col("id"), F.when(F.col("id") > 3, F.lit("x")).alias("s"))
    out = str(tmp_path / "o")
    assert S.write_jsonl(df, out) == 7
    back = S.read_jsonl(spark, out, "id long, s string")
    assert back.exceptAll(df).count() == 0 and back.count() == 7
    assert S.append_jsonl(df.where("id < 2"), out) == 2 and S.count_lines(spark, out) == 9
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_jsonl(df, out)
    assert '"s":null' in spark.read.text(out).agg(F.max("value")).first()[0] or spark.read.text(out).where(F.contains("value", F.lit('"s":null'))).count() > 0


def test_blank_lines_and_torn_tail(spark, tmp_path):
    path = write_lines(tmp_path / "t", ['{"core_id":"a","n":1}', "", "   ", '{"core_id":"b","n":2}', '{"core_id":"c","n'])
    assert S.count_lines(spark, path) == 3
    assert {r["core_id"] for r in rows(S.read_growing(spark, path, "core_id string, n int"))} == {"a", "b"}
    letters = S.read_with_dead_letters(spark, path, "core_id string, n int")
    assert S.read_growing(spark, path, "core_id string, n int").count() == 2
    assert letters.where(F.col(S.CORRUPT).isNotNull()).select(S.CORRUPT).first()[0] == '{"core_id":"c","n'
    with pytest.raises(Exception):
        S.read_jsonl(spark, path, "core_id string, n int").collect()
    files = spark.createDataFrame([("a.jsonl",), ("a.jsonl.tmp",), ("b.jsonl.tmp",)], "path string")
    assert {r["path"] for r in rows(S.prefer_final(files))} == {"a.jsonl", "b.jsonl.tmp"}


def test_rescue_keeps_broken_rows(spark, tmp_path):
    path = write_lines(tmp_path / "r", ['{"core_id":"a"}', "{broken"])
    letters = S.read_with_dead_letters(spark, path, "core_id string")
    out = responses.rescue(letters, F.when(F.col(S.CORRUPT).isNotNull(), F.concat(F.lit("ParseError: "), S.CORRUPT)), "judge")
    got = {r["core_id"]: r["step_status"] for r in rows(out)}
    assert got == {"a": "ok", "unknown": "failed:unexpected:ParseError: {broken"}


def test_landing_and_tagged_scan(spark, tmp_path):
    for run, n in (("judge-a-on-x", 3), ("judge-b-on-x", 2), ("other", 1)):
        write_lines(tmp_path / "runs" / run, [json.dumps({"core_id": f"{run}{i}"}) for i in range(n)])
    tags = {"judge-a-on-x": {"judge": "a", "generator": "x"}, "judge-b-on-x": {"judge": "b", "generator": "x"}}
    out = S.read_tagged(spark, f"{tmp_path}/runs/*/*.jsonl", "core_id string", tags)
    got = {(r["run_id"], r["judge"], r["generator"]): r["n"] for r in rows(out.groupBy("run_id", "judge", "generator").agg(F.count("*").alias("n")))}
    assert got == {("judge-a-on-x", "a", "x"): 3, ("judge-b-on-x", "b", "x"): 2, ("other", None, None): 1}
    assert S.with_file(out).select("file").distinct().count() == 3
    assert S.land_raw(spark, f"{tmp_path}/runs/judge-a-on-x", str(tmp_path / "landed"), 2) == 2


def test_raw_shapes(spark, tmp_path):
    shared = '"question_valid":true,"question":"q"'
    tag = "ANSWER-THE-QUESTION"
    lines = [
        '{"sample_id":"1",%s,"evidence_correct":["%s","%s"],"grounding":[{"cite_1":"A"},{"cite_2":" ","cite_9":"B"},{"text":"C"}]}' % (shared, tag, tag.lower()),
        '{"id":2,%s,"grounding":[{"text":"A","evidence_correct":"%s"},{"text":"B","evidence_correct":"%s"}]}' % (shared, tag, tag),
        '{"sample_id":"3",%s,"question_seeking":null,"evidence_correct":["%s","%s"],"grounding":[{},{}]}' % (shared, tag, tag),
        '{"sample_id":"4",%s,"answer_validate":null,"evidence_correct":["%s","%s"],"grounding":[{},{}]}' % (shared, tag, tag),
        '{"sample_id":"5",%s,"evidence_correct":["%s"],"grounding":[{},{}]}' % (shared, tag),
        '{"sample_id":"6","question_valid":"yes","question_false_premise":"no","question_seeking":2,"evidence_correct":["%s","%s"],"grounding":[{},{}]}' % (tag, tag),
    ]
    raw = S.read_raw(spark, write_lines(tmp_path / "raw", lines))
    core = {r["garage_sample_id"]: r for r in rows(RAW.select_raw(raw))}
    assert set(core) == {"1", "2", "6"}
    assert [p["text"] for p in core["1"]["all_grounding_original"]] == ["A", "B", "C"]
    assert core["1"]["answer_containing_passage_ids"] == [0, 1]
    assert core["1"]["all_grounding_original"][2]["evidence_correct"] is None
    import hashlib

    assert core["2"]["core_id"] == "garage_core_" + hashlib.sha1(b"2").hexdigest()[:12]


def test_digests(spark, tmp_path):
    import hashlib

    for name, body in (("a.bin", b"one"), ("b.bin", b"two"), ("c.bin", b"three")):
        (tmp_path / name).write_bytes(body)
    found = quality.digests(spark, str(tmp_path), "*.bin").withColumn("path", F.element_at(F.split("path", "/"), -1))
    manifest = spark.createDataFrame(
        [("a.bin", hashlib.sha256(b"one").hexdigest()), ("b.bin", "0"), ("d.bin", "0")], "path string, sha256 string"
    )
    got = {r["path"]: r["status"] for r in rows(quality.audit_digests(found, manifest))}
    assert got == {"a.bin": "match", "b.bin": "differs", "c.bin": "unlisted", "d.bin": "missing"}


def test_freeze_refuses_overwrite(spark, tmp_path):
    df = spark.range(5)
    manifest = S.dataset_manifest(df, df.where("id > 1"), "d", 17, 5)
    out, side = str(tmp_path / "d"), str(tmp_path / "m")
    assert S.freeze_dataset(df, out, manifest, side) == 5
    got = rows(spark.read.json(side))[0]
    assert (got["raw_row_count"], got["passing_gates"], got["selected_n"]) == (5, 3, 5)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.freeze_dataset(df, out, manifest, side)
    assert S.freeze_dataset(df.where("id < 2"), out, manifest, side, overwrite=True) == 2


def test_csv_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], 'say "x"'), (2, None, "b,c")], "i int, ids array<int>, s string")
    S.write_csv(df, str(tmp_path / "csv"))
    back = {r["i"]: r for r in rows(spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")))}
    assert back["1"]["ids"] == "1;2" and back["2"]["ids"] is None and back["1"]["s"] == 'say "x"' and back["2"]["s"] == "b,c"
    S.write_report({"cells": df.groupBy("i").count(), "meta": df.agg(F.max("i").alias("m"))}, str(tmp_path / "report"))
    doc = json.loads(spark.read.text(str(tmp_path / "report")).first()[0])
    assert doc == {"cells": [{"i": 1, "count": 1}, {"i": 2, "count": 1}], "meta": [{"m": 2}]}


def test_manifest_keeps_created_at(spark):
    entries = spark.createDataFrame([("r", "k", "old", 5), ("r", "k", "new", 9), ("r", "j", "x", 7)], "run_id string, key string, value string, ts int")
    got = {r["key"]: r for r in rows(S.manifest_view(entries))}
    assert (got["k"]["value"], got["k"]["created_at"], got["k"]["updated_at"]) == ("new", 5, 9)


def test_expectations_and_assert(spark):
    out = quality.expect(spark.range(5), {"rows": (F.count("*"), 5), "max": (F.max("id"), 9)})
    assert {r["check"]: r["ok"] for r in rows(out)} == {"rows": True, "max": False}
    with pytest.raises(Exception, match="expectation failed"):
        quality.assert_all(out).collect()


def test_latest_step_and_generation(spark):
    df = spark.createDataFrame([({"filter": "ok", "judge": "failed:x"},), ({},)], "s map<string,string>").select(status.latest_step("s").alias("l"))
    assert [tuple(r["l"].values()) for r in rows(df)] == [("judge", "failed:x"), ("filter", "")]
    outputs = "array<struct<generator_provider:string,generator_model:string,mode:string,behavior_label:string>>"
    df = spark.createDataFrame([([("p", "m", "a", "x"), ("q", None, "b", "y")],), ([],)], f"o {outputs}")
    got = [r["g"] for r in rows(df.select(status.latest_generation("o").alias("g")))]
    assert got[0] == {"generator": "q", "mode": "b", "behavior_label": "y"} and got[1]["generator"] is None


def test_step_chain_and_resume(spark):
    from verdictframe.operators import history

    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "core_id string, n int")
    steps = {
        "judge": lambda d: d.withColumn("n", F.col("n") * 10),
        "filter": lambda d: d.where("n > 1"),
        "validate": lambda d: d.withColumn("n", F.col("n") + 1),
    }
    assert {r["core_id"]: r["n"] for r in rows(steps_.chain(df, steps))} == {"b": 30, "c": 40}
    assert {r["n"] for r in rows(steps_.chain(df, steps, "validate"))} == {3, 4}
    done = spark.createDataFrame([("b", 99)], "core_id string, n int")
    assert {r["core_id"]: r["n"] for r in rows(history.resume(df, done, steps["judge"]))} == {"a": 10, "b": 99, "c": 30}
    two = spark.createDataFrame([("a", "x"), ("a", "y")], "core_id string, generator string")
    kept = history.pending(two, two.where("generator = 'x'"), ("core_id", "generator"))
    assert [r["generator"] for r in rows(kept)] == ["y"]


def test_provider_family_pairs(spark):
    from verdictframe.functions.scalars import pair_type

    df = spark.createDataFrame([("grok", "a", "grok", "a"), ("grok", "a", "grok", "b"), ("new1", "a", "new2", "a"), ("grok", "a", "kimi", "a")], "jp string, jm string, gp string, gm string")
    assert [r[0] for r in df.select(pair_type("jp", "jm", "gp", "gm")).collect()] == [
        "same_exact_model", "same_provider_family", "same_provider_family", "cross_provider_family"]


# ---- streams ----------------------------------------------------------------------------------

EVENT = "event_id string, run_id string, step string, model string, started_at double, latency_ms long, input_tokens long, error string"


def land(path, name, events):
    os.makedirs(path, exist_ok=True)
    keys = [c.split()[0] for c in EVENT.split(", ")]
    with open(f"{path}/{name}.json", "w") as f:
        f.writelines(json.dumps(dict(zip(keys, e))) + "\n" for e in events)


def events(start, n):
    return [(f"e{i}", "r", "judge", f"m{i % 2}", 1_700_000_000.0 + 60 * i, 10 * i, i if i % 4 else None, "bad" if i % 5 == 0 else None) for i in range(start, start + n)]


def test_usage_windows_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    land(src, "a", events(0, 300))
    land(src, "b", events(300, 300))
    stream = ST.with_event_time(ST.trace_stream(spark, src, EVENT, files_per_trigger=1)).withColumn("error", F.col("error").isNotNull())
    live = ST.run_available(ST.usage_windows(stream, width="1 hour"), "w1", "complete", str(tmp_path / "c1"))
    batch = ST.with_event_time(spark.read.schema(EVENT).json(src)).withColumn("error", F.col("error").isNotNull())
    want = batch.groupBy(F.window("ts", "1 hour").alias("w"), "model").agg(
        F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.sum("input_tokens").alias("input_tokens"),
        F.count_if(F.col("input_tokens").isNull()).alias("missing_input_usage"), F.sum("latency_ms").alias("sum_call_ms"))
    assert live.select(*want.columns).exceptAll(want).count() == 0 and live.count() == want.count()
    assert usage.usage_by(spark.read.schema(EVENT + ", output_tokens long").json(src), ["model"]).agg(F.sum("errors")).first()[0] == 120


def test_append_windows_drop_late_rows(spark, tmp_path):
    """Closed windows only come out, and a row older than the watermark is not counted."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(src, "a", events(0, 200))
    stream = ST.with_event_time(ST.trace_stream(spark, src, EVENT)).withColumn("error", F.col("error").isNotNull())
    windows = ST.usage_windows(stream, width="1 hour").withColumn("start", F.col("w.start")).drop("w")
    first = ST.run_to_files(windows, out, str(tmp_path / "ck"))
    closed = first.agg(F.sum("calls")).first()[0]
    land(src, "b", [("late", "r", "judge", "m0", 1_700_000_000.0, 1, 1, None)] + events(200, 200))
    second = ST.run_to_files(windows, out, str(tmp_path / "ck"))
    first_window = second.where("start <= timestamp_seconds(1700000000)").agg(F.sum("calls")).first()[0]
    assert closed < 200 and first_window == 47  # the hour holds 47 of the events; the late one is left out


def test_dedup_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    land(src, "a", events(0, 50))
    land(src, "b", events(45, 50))
    stream = ST.with_event_time(ST.trace_stream(spark, src, EVENT, files_per_trigger=1))
    out = ST.run_to_files(ST.dedup_events(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    assert out.count() == 95 and out.select("event_id").distinct().count() == 95


def test_live_status(spark, tmp_path):
    src = str(tmp_path / "in")
    land(src, "a", events(0, 40))
    stream = ST.trace_stream(spark, src, EVENT).withColumn("status", F.when(F.col("error").isNotNull(), "failed"))
    out = {r["status"]: r["n"] for r in rows(ST.run_available(ST.live_status(stream), "s1", "complete", str(tmp_path / "c")))}
    assert out == {"failed": 8, "unset": 32}


def test_upsert_is_idempotent(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "t")
    schema = "core_id string, v int"

    def put(name, items):
        os.makedirs(src, exist_ok=True)
        with open(f"{src}/{name}.json", "w") as f:
            f.writelines(json.dumps({"core_id": c, "v": v}) + "\n" for c, v in items)

    def run(checkpoint):
        ST.upsert_steps(ST.trace_stream(spark, src, schema), target, str(tmp_path / checkpoint)).start().awaitTermination()
        return {r["core_id"]: r["v"] for r in rows(spark.read.parquet(target))}

    put("a", [("x", 1), ("y", 1)])
    assert run("c") == {"x": 1, "y": 1}
    put("b", [("y", 2), ("z", 2)])
    assert run("c") == {"x": 1, "y": 1, "z": 2}
    assert spark.read.parquet(target).count() == 3
    # replaying everything from scratch over the same target adds nothing
    assert set(run("c2")) == {"x", "y", "z"} and spark.read.parquet(target).count() == 3
