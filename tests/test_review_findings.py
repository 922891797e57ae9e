"""Cases that earlier twins did not hold: white space, repeated ids, ties, broken lines, shared targets."""

import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import rows
from verdictframe.functions import text as TX
from verdictframe.operators import assignment, edits, raw, sampling
from verdictframe.sources import records
from verdictframe.streaming import traces as ST


@pytest.mark.parametrize("value, want", [("yes\n", True), ("\ttrue", True), (" 1 ", True), ("no\n", False)])
def test_truthy_strips_white_space(spark, value, want):
    one = spark.createDataFrame([(json.dumps({"a": value}),)], "t string").select(F.parse_json("t").alias("v"))
    assert one.select(raw.truthy(F.variant_get("v", "$.a", "variant"))).first()[0] is want


def test_strip_is_that_of_python(spark):
    values = ["x\n", "\t x y ", "\x1cx", "", " \n", "x"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", TX.strip("v").alias("s"))
    assert {r.i: r.s for r in got.collect()} == {i: v.strip() for i, v in enumerate(values)}


def test_identical_after_strip(spark):
    spec = {"original_value": "x\n", "perturbed_value": "x", "perturbation_type": "numeric"}
    one = spark.createDataFrame([(json.dumps(spec),)], "t string").select(F.parse_json("t").alias("parsed"))
    assert edits.parse_spec(one).first()["spec_status"] == "failed:identical_values"


def test_sample_takes_an_id_once(spark):
    df = spark.range(60).select((F.col("id") % 20).alias("k"), (F.col("id") % 3).cast("string").alias("s"))
    for n in (15, 30, 2000):
        got = [r.k for r in sampling.stratified_sample(df, ["s"], n, 17, "k").collect()]
        assert len(got) == len(set(got)) == min(n, 20)


def test_draws_nest_around_the_small_limit(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("s"), (F.col("id") % 5 == 0).alias("p"))
    before: set = set()
    for n in (999, 1000, 1001, 1002):
        got = {r.k for r in sampling.prefer_then_backfill(df, F.col("p"), ["s"], n, 17, "k").collect()}
        assert len(got) == n and before < got
        before = got


def test_pages_with_ties_fit_together(spark):
    df = spark.range(2500).select("id", (F.col("id") % 3).alias("seq"))
    pages = [{r.id for r in sampling.slice_rows(df, "seq", a, b, ["id"]).collect()} for a, b in ((0, 900), (900, 300), (1200, None))]
    assert sum(map(len, pages)) == len(set().union(*pages)) == 2500
    assert {r.id for r in sampling.slice_rows(df, "seq", 0, 1000, ["id"]).collect()} < {r.id for r in sampling.slice_rows(df, "seq", 0, 1001, ["id"]).collect()}


def test_broken_lines_fail_the_read(spark, tmp_path):
    os.makedirs(tmp_path / "run1")
    with open(tmp_path / "run1" / "v.json", "w") as f:
        f.write('{"a": 1}\n{"a": ')
    with pytest.raises((PySparkException, Py4JJavaError)):
        records.read_tagged(spark, str(tmp_path / "run1"), "a int", {"run1": {"judge": "j"}}).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        records.read_raw(spark, str(tmp_path / "run1")).collect()


def test_streams_share_a_target(spark, tmp_path):
    target = str(tmp_path / "target")
    for name, ids in (("a", "vwxyz"), ("b", "zabc")):
        os.makedirs(tmp_path / name)
        for i, c in enumerate(ids):  # a file each, so several batches
            with open(tmp_path / name / f"{i}.json", "w") as f:
                f.write(json.dumps({"core_id": c, "v": name}) + "\n")
        stream = ST.trace_stream(spark, str(tmp_path / name), "core_id string, v string", files_per_trigger=2)
        ST.upsert_steps(stream, target, str(tmp_path / f"c-{name}")).start().awaitTermination()
    got = {r["core_id"]: r["v"] for r in rows(spark.read.parquet(target))}
    assert got == {**dict.fromkeys("vwxyz", "a"), **dict.fromkeys("abc", "b")}


def test_any_number_of_providers(spark):
    df = spark.range(600).select((F.col("id") % 300).alias("core_id"), F.concat(F.lit("p"), F.format_string("%02d", (F.col("id") * 7 + F.floor(F.col("id") / 300)) % 20)).alias("provider"), F.lit("k").alias("kind"), F.lit(True).alias("is_validated"))
    got = assignment.assign_balanced(df, 200)
    counts = {r["provider"]: r["count"] for r in got.groupBy("provider").count().collect()}
    assert sum(counts.values()) == 200 == got.select("core_id").distinct().count()
    assert set(counts.values()) == {10} and len(counts) == 20
    assert assignment.assign_balanced(df.limit(0), 200).count() == 0


def test_match_carries_no_more_of_a_text_than_decides(spark, monkeypatch):
    """Long questions meet short examples by their beginning, ranges follow the characters, and the cases found are the same."""
    import random

    from verdictframe.operators import prefixes, review

    rnd = random.Random(5)
    examples = [("x", "what is"), ("x", "what is the capital"), ("y", "who was it"), ("y", "?!")]
    stems = ["what is", "what is the capital", "what is the capital of peru", "what", "who was", "who was it", "who was itt", "", "zzz", "what is the capitals"]
    cases = [(i, rnd.choice("xyz"), s + rnd.choice(["", " " + "tail " * 400])) for i, s in enumerate(stems * 12)]
    c, e = spark.createDataFrame(cases, "case_id long, cell string, question string"), spark.createDataFrame(examples, "cell string, question string")
    norm = lambda s: " ".join("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())
    want = {i for i, cell, q in cases for x, t in examples if cell == x and norm(t) and (norm(q).startswith(norm(t)) or norm(t).startswith(norm(q)))}
    seen = {}
    inner = prefixes.beside

    def spy(rows, *args, **more):
        seen["longest"] = rows.agg({"_q": "max"}).count() and max(len(r["_q"]) for r in rows.collect())
        return inner(rows, *args, **more)

    monkeypatch.setattr(review, "beside", spy)
    assert {r["case_id"] for r in review.match_examples(c, e).collect()} == want
    assert seen["longest"] == len("what is the capital") + 1
    long = spark.createDataFrame([("g", f"{i:03d}" + "a" * 500) for i in range(200)], "g string, t string")
    short = spark.createDataFrame([("g", f"{i:03d}a") for i in range(0, 200, 3)], "g string, t string")
    got = prefixes.beside(long, short, "g", "t", chars_per_task=5_000)
    assert got.rdd.getNumPartitions() >= 20 and {r["t"][:3] for r in got.collect()} == {f"{i:03d}" for i in range(0, 200, 3)}


def test_the_queue_draws_without_questions(spark, monkeypatch):
    """Samples of the queue shuffle a few columns of a case, never its text."""
    from verdictframe.operators import review

    seen = []
    inner = review.stratified_sample
    monkeypatch.setattr(review, "stratified_sample", lambda df, *a, **k: seen.append(df.columns) or inner(df, *a, **k))
    kinds = ["true_positive", "apparent_fp", "false_negative", "true_negative"]
    rows = [(f"c{i}", "g0", f"g{i % 2}", kinds[i % 4], i % 2 == 0, True, "what is it") for i in range(40)]
    cases = spark.createDataFrame(rows, "case_id string, judge string, generator string, category string, same_deployment boolean, is_validated boolean, question string")
    examples = spark.createDataFrame([("g0_on_g0", "what is it")], "cell string, question string")
    out = review.build_queue(cases, examples).collect()
    assert seen and all("question" not in c for c in seen)
    assert {r["case_id"] for r in out if r["paper_example"]} == {f"c{i}" for i in range(0, 40, 2)}
