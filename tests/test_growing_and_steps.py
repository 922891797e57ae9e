"""Files followed while they grow, steps that throw, citation slots in file order."""

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdictframe.operators import raw as RAW
from verdictframe.operators import steps as S
from verdictframe.sources import growing as G
from verdictframe.sources import records as R
from verdictframe.streaming import traces as ST

SCHEMA = "core_id string, n bigint"


def put(path, text, mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, encoding="utf-8") as f:
        f.write(text)


def line(i):
    return json.dumps({"core_id": f"c{i}", "n": i}) + "\n"


def drain(spark, folder, **options):
    rows = G.parsed(G.follow(spark, f"{folder}/raw", **options), SCHEMA)
    return sorted((r.file, r.n) for r in ST.run_to_files(rows, f"{folder}/rows", f"{folder}/checkpoint").collect())


def test_added_lines_arrive_once(spark, tmp_path):
    a, b = f"{tmp_path}/raw/run1/judge.jsonl.tmp", f"{tmp_path}/raw/run2/judge.jsonl"
    put(a, line(1) + line(2) + line(3)[:7])
    put(b, line(10))
    put(f"{tmp_path}/raw/run2/notes.txt", line(99))
    assert drain(spark, tmp_path) == [("run1/judge.jsonl", 1), ("run1/judge.jsonl", 2), ("run2/judge.jsonl", 10)]
    assert len(drain(spark, tmp_path)) == 3  # the torn line waits
    put(a, line(3)[7:] + "\n \n" + "".join(line(i) for i in range(4, 9)))
    os.rename(a, a.removesuffix(".tmp"))  # finished: read on from the same place
    put(f"{tmp_path}/raw/run3/judge.jsonl", line(20) + "é" * 5)
    want = [("run1/judge.jsonl", i) for i in range(1, 9)] + [("run2/judge.jsonl", 10), ("run3/judge.jsonl", 20)]
    assert drain(spark, tmp_path, task_bytes=16) == want
    assert drain(spark, tmp_path, task_bytes=5) == want
    batch = sorted((r.n for r in G.read_until_torn(spark, f"{tmp_path}/raw", SCHEMA, task_bytes=11).collect()))
    assert batch == sorted(n for _, n in want)


def test_a_file_that_shrinks_fails_the_stream(spark, tmp_path):
    path = f"{tmp_path}/raw/x.jsonl"
    put(path, line(1) + line(2))
    drain(spark, tmp_path)
    put(path, line(1), "w")
    with pytest.raises(Exception, match="was cut from"):
        drain(spark, tmp_path)


def test_batch_read_stops_at_the_first_torn_line_of_each_file(spark, tmp_path):
    put(f"{tmp_path}/raw/a.jsonl", line(1) + '{"core_id": "c2", "n"\n' + line(3))
    put(f"{tmp_path}/raw/b.jsonl", line(4) + "\n" + line(5) + line(6).rstrip("\n"))
    put(f"{tmp_path}/raw/c.jsonl.tmp", "{")
    put(f"{tmp_path}/raw/c.jsonl", line(7))
    put(f"{tmp_path}/raw/empty.jsonl", "")
    got = sorted(r.n for r in G.read_until_torn(spark, f"file:{tmp_path}/raw", SCHEMA).collect())
    assert got == [1, 4, 5, 6, 7]  # a whole last record counts without its line end, as in a finished file
    assert G.read_until_torn(spark, f"{tmp_path}/nowhere", SCHEMA).count() == 0


def test_lines_of_pieces_are_the_lines_of_the_file(tmp_path, monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        data = b"".join(rng.choice([b"abc", b"", b"x" * rng.randint(0, 50), b"  "]) + b"\n" for _ in range(rng.randint(0, 20))) + rng.choice([b"", b"tail"])
        (tmp_path / "a.jsonl").write_bytes(data)
        monkeypatch.setattr(G, "BLOCK_BYTES", rng.randint(1, 40))
        files = G.Files({"path": str(tmp_path), "taskBytes": str(rng.randint(1, 60))})
        ((name, (path, size, _)),) = files.sizes().items()
        got = [x for piece in files.pieces(name, path, 0, size) for x in files.lines(piece)]
        want, at = [], 0
        for part in data.split(b"\n"):
            want.append((at, part, True))
            at += len(part) + 1
        want[-1] = (*want[-1][:2], False)
        assert got == [w for w in want if w[1] or w[2]]
        assert files.last_line_end(path, size) == data.rfind(b"\n") + 1


def records(spark, n):
    rows = [(f"c{i}" if i else None, i, {"filter": "ok"} if i % 3 else {"filter": "failed:early"}) for i in range(n)]
    return spark.createDataFrame(rows, "core_id string, n bigint, pipeline_state map<string,string>")


def test_rows_that_throw_stay_alone(spark):
    schema = "core_id string, n bigint, pipeline_state map<string,string>, half double"

    def run(batch):  # fails as a whole, like vectorised code does
        numbers = batch.column(1).to_pylist()
        for x in numbers:
            if x % 10 == 5:
                raise KeyError(f"k{x}" + "!" * 500)
        keep = pa.array([x % 7 != 0 for x in numbers])
        out = batch.filter(keep)
        return out.append_column("half", pa.array([x / 2 for x in out.column(1).to_pylist()], pa.float64()))

    done = {r.n: r for r in S.isolated(records(spark, 500).repartition(3), "judge", S.BatchStep(run, schema, all_rows=True)).collect()}
    assert sorted(done) == [i for i in range(500) if i % 10 == 5 or i % 7]
    assert done[15].half is None and done[16].half == 8.0
    assert done[15].pipeline_state["judge"] == "failed:unexpected:" + f"KeyError: 'k15{'!' * 500}"[:240]
    assert done[16].pipeline_state == {"filter": "ok", "judge": "ok"} and done[15].pipeline_state["filter"] == "failed:early"


def test_failed_rows_pass_by_and_unknown_keys_are_named(spark):
    def fail(row):
        raise ValueError("no")

    schema = "core_id string, n bigint, pipeline_state map<string,string>"
    done = {r.n: r for r in S.chain(records(spark, 6), {"judge": S.BatchStep(S.by_record(fail, schema))}).collect()}
    assert done[3].pipeline_state == {"filter": "failed:early"} and done[4].pipeline_state["judge"] == "failed:unexpected:ValueError: no"
    every = {r.n: r for r in S.chain(records(spark, 6), {"judge": S.BatchStep(S.by_record(fail, schema), all_rows=True)}).collect()}
    assert every[0].core_id == "unknown" and every[1].core_id == "c1"
    assert S.chain(records(spark, 0), {"judge": S.BatchStep(S.by_record(fail, schema))}).count() == 0


def test_a_result_of_another_shape_is_the_rows_problem(spark):
    done = S.isolated(records(spark, 4), "judge", S.BatchStep(lambda b: b.select(["core_id", "n"]), all_rows=True)).collect()
    assert len(done) == 4 and all(r.pipeline_state["judge"].startswith("failed:unexpected:KeyError") for r in done)
    with pytest.raises(ValueError, match="pipeline_state"):
        S.isolated(records(spark, 1), "judge", S.BatchStep(lambda b: b, "core_id string"))


def test_bisection_runs_little_more_than_needed():
    calls = []

    def run(batch):
        calls.append(batch.num_rows)
        if 700 in batch.column(0).to_pylist():
            raise RuntimeError("bad")
        return batch

    batch = pa.RecordBatch.from_pydict({"n": list(range(1024))})
    got = list(S.run_isolated(run, batch, batch.schema))
    assert [p for _, p in got if p] == ["RuntimeError: bad"]
    assert [x for b, _ in got for x in b.column(0).to_pylist()] == list(range(1024))  # order is kept
    assert len(calls) == 21


def test_first_citation_slot_in_file_order(spark, tmp_path):
    rows = [
        {"grounding": [{"cite_2": "two", "cite_10": "ten"}, {"cite_10": "ten", "cite_3": "three"}]},
        {"grounding": [{"cite_9": " ", "cite_7": "seven", "cite_1": "own"}, {"cite_5": 5, "cite_30": "thirty", "cite_4": "four"}]},
        {"grounding": []},
        {"grounding": [{"text": "flat", "cite_1": "own"}, {"cite_é\"x": "odd", "cite_1": "one"}]},
        {"question": "none"},
    ]
    with open(tmp_path / "raw.jsonl", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"sample_id": str(i), **r}) + "\n" for i, r in enumerate(rows))
    core = RAW.to_core(R.read_raw_lines(spark, str(tmp_path)), line="line")
    got = {r.garage_sample_id: [p.text for p in r.all_grounding_original or []] for r in core.collect()}
    assert got == {"0": ["two", "ten"], "1": ["own", "thirty"], "2": [], "3": ["flat", "odd"], "4": []}
    by_name = RAW.to_core(R.read_raw(spark, str(tmp_path)))
    assert by_name.where(F.col("garage_sample_id") == "0").first().all_grounding_original[0].text == "ten"
