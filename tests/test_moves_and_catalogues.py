"""Records that move between statuses, balanced assignment with types, catalogues, digests and manifests."""

import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from verdictframe.operators import assignment as A
from verdictframe.operators import quality, usage
from verdictframe.sources import records as S
from verdictframe.streaming import traces as ST

EVENTS = "core_id string, ts timestamp, n long, step string, status string"


def moves(spark, folder, events, **options):
    """The appended moves after each list of events has landed and the stream was started again."""
    for rows in events:
        frame = spark.createDataFrame(rows, "core_id string, ts string, n long, step string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.write.mode("append").parquet(f"{folder}/in")
        stream = ST.status_moves(ST.trace_stream(spark, f"{folder}/in", EVENTS, "parquet"), "core_id", tie="n", **options)
        out = ST.run_to_files(stream, f"{folder}/out", f"{folder}/checkpoint")
    return {(r.step, r.status): r.n for r in ST.status_counts_of(out).collect()}


def test_a_record_counts_where_it_is_last(spark, tmp_path):
    first = [("a", "2026-01-01 10:00:00", 1, "filter", "ok"), ("b", "2026-01-01 10:00:00", 1, "filter", None), (None, "2026-01-01 10:00:00", 1, "filter", "ok")]
    second = [("a", "2026-01-01 11:00:00", 2, "perturb", "failed"), ("a", "2026-01-01 10:30:00", 9, "filter", "ok"), ("c", "2026-01-01 11:00:00", 1, "filter", "ok")]
    third = [("a", "2026-01-01 12:00:00", 3, "perturb", "ok"), ("c", "2026-01-01 11:00:00", 0, "judge", "ok"), ("b", "2026-01-01 12:00:00", 2, "filter", None)]
    assert moves(spark, f"{tmp_path}/one", [first]) == {("filter", "ok"): 1, ("filter", "unset"): 1}
    assert moves(spark, f"{tmp_path}/all", [first, second, third]) == {("filter", "ok"): 1, ("filter", "unset"): 1, ("perturb", "ok"): 1}


def test_forgotten_records_keep_their_count(spark, tmp_path):
    days = [[("a", "2026-01-01 00:00:00", 1, "filter", "ok")], [("b", "2026-02-01 00:00:00", 1, "filter", "ok")], [("c", "2026-02-02 00:00:00", 1, "filter", "ok")], [("a", "2026-02-03 00:00:00", 2, "judge", "ok")]]
    assert moves(spark, f"{tmp_path}/short", days, ttl="2 days")[("filter", "ok")] == 3
    assert moves(spark, f"{tmp_path}/long", days, ttl="90 days") == {("filter", "ok"): 2, ("judge", "ok"): 1}


def one_by_one(questions, targets):
    """Provider and type counts of the rule applied to one question after the other."""
    lack, typed = dict(targets), {}
    for providers in sorted(questions, key=len):
        free = [(p, t) for p, t in providers if lack[p] > 0]
        if free:
            p, t = max(free, key=lambda x: 100 * lack[x[0]] + max(0, max(1, targets[x[0]] // 10) - typed.get(x, 0)))
            lack[p] -= 1
            typed[p, t] = typed.get((p, t), 0) + 1
    return {p: targets[p] - n for p, n in lack.items()}, typed


@pytest.mark.parametrize("target", [120, 600, 2500])
def test_assignment_equals_the_rule_one_by_one(spark, target):
    rng = random.Random(target)
    kinds = ["number", "date", "name", "place", None]
    questions = [[(p, rng.choices(kinds, [60, 20, 10, 5, 5])[0]) for p in "abc" if rng.random() < {"a": 0.7, "b": 0.5, "c": 0.3}[p]] for _ in range(2000)]
    rows = [(i, p, k, True) for i, q in enumerate(questions) for p, k in q] + [(i, "a", "date", False) for i in range(50)]
    df = spark.createDataFrame(rows, "core_id int, provider string, kind string, is_validated boolean")
    chosen = A.assign_balanced(df, target)
    got = {r.provider: r["count"] for r in chosen.groupBy("provider").count().collect()}
    capacity = {p: sum(x == p for q in questions for x, _ in q) for p in "abc"}
    targets = A.capacity_targets(capacity, target)
    named = [[(p, k or "unknown") for p, k in q] for q in questions if q]
    want, typed = one_by_one(named, targets)
    assert got == {p: n for p, n in want.items() if n}
    by_type = {(r.provider, r.kind): r["count"] for r in chosen.na.fill("unknown", ["kind"]).groupBy("provider", "kind").count().collect()}
    for cell, n in typed.items():  # the same but for chance: questions come in another order
        assert abs(by_type.get(cell, 0) - n) <= 8 + 3 * n**0.5, (cell, n, by_type.get(cell, 0))
    assert chosen.select("core_id").distinct().count() == chosen.count()


def test_units_go_to_the_largest_score():
    rng = random.Random(2)
    for _ in range(1000):
        names = [f"p{i}" for i in range(rng.randint(1, 4))]
        lack, typed = {p: rng.randint(0, 30) for p in names}, {p: rng.choice([0, 0, 3, 50, 250]) for p in names}
        left, kinds, want, units = dict(lack), dict(typed), dict.fromkeys(names, 0), rng.randint(0, 60)
        for _ in range(units):
            free = [p for p in names if left[p] > 0]
            if free:
                best = max(free, key=lambda p: 100 * left[p] + max(0, kinds[p]))
                want[best], left[best], kinds[best] = want[best] + 1, left[best] - 1, kinds[best] - 1
        assert A._take(lack, typed, units) == want


def test_gap_fill_takes_produced_records(spark):
    chosen = spark.createDataFrame([("q1", "a", 2)], "core_id string, provider string, validators long")
    fill = spark.createDataFrame(
        [("q1", None, 1, [1]), ("q2", None, 2, []), ("q3", "f", 3, [1]), ("q4", "g", 4, [1]), ("q3", "f", 5, [2]), ("q5", "f", 6, None), ("q6", "f", 7, [1]), (None, "f", 8, [1])],
        "core_id string, provider string, seq int, passages array<int>",
    )
    got = {r.core_id: r for r in A.with_gap_fill(chosen, fill, 3, "seq", "passages").collect()}
    assert sorted(got) == ["q1", "q3", "q4"] and got["q3"].passages == [2] and {r.origin for r in got.values()} == {"validated", "gap_fill"}
    assert [got[q].provider for q in ("q1", "q3", "q4")] == ["a", "f", "f"] and got["q1"].passages is None
    assert A.with_gap_fill(chosen, fill, 99, "seq", "passages").count() == 4
    assert A.with_gap_fill(chosen, fill, 1, "seq", "passages").count() == 1


def test_catalogue_reads_no_column(spark, tmp_path):
    for name, n in (("old", 5), ("new one", 3)):
        spark.range(n).withColumn("x", F.lit("y")).repartition(2).write.parquet(f"{tmp_path}/{name}")
        time.sleep(1.1)
    listed = S.catalogue_of(spark, str(tmp_path))
    assert [(r.dataset, r.n) for r in listed.collect()] == [("new one", 3), ("old", 5)]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_digests_of_files_beyond_one_cell(spark, tmp_path):
    bodies = {"a b%.bin": os.urandom(50_000), "empty.bin": b"", "é.bin": b"x" * 4097}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength", None)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        with pytest.raises(Exception, match="maxLength|BINARY|too long|exceeds"):
            spark.read.format("binaryFile").load(str(tmp_path)).select(F.length("content")).collect()
        found = quality.digests(spark, str(tmp_path), "*.bin", block=1000).collect()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        else:
            spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert sorted((r.length, r.sha256) for r in found) == sorted((len(b), hashlib.sha256(b).hexdigest()) for b in bodies.values())


def test_manifest_with_strata_and_ids(spark):
    df = spark.createDataFrame([("b", "x", None), ("a", "x", "1"), ("c", "", "1"), ("d", "x", "1")], "id string, p string, q string")
    row = S.dataset_manifest(df, df, "m", 1, 4, df, ["p", "q"], "id").first()
    assert row.strata_counts == {"x/?": 1, "x/1": 2, "?/1": 1} and row.sample_ids == ["a", "b", "c", "d"]
    assert "strata_counts" not in S.dataset_manifest(df, df, "m", 1, 4).columns


def test_runs_without_verdicts_count_none(spark):
    per_run = spark.createDataFrame([("r1", "j", 3), ("r2", "j", 4)], "run_id string, judge string, calls long")
    saved = spark.createDataFrame([("r1", "j")] * 3, "run_id string, judge string")
    got = {r.run_id: r.verdicts for r in usage.with_verdicts(per_run, saved).collect()}
    assert got == {"r1": 3, "r2": 0}


def test_beginnings_equal_brute_force_over_many_ranges(spark):
    from verdictframe.operators.prefixes import beside

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aäb") for _ in range(rng.randint(0, 5)))
    cases = [(rng.choice("xyz"), word()) for _ in range(300)] + [("x", None), (None, "a"), ("w", "a")] + [("x", "ab")] * 200
    for n in (0, 1, 5, 40):
        examples = [(rng.choice("xy"), word()) for _ in range(n)] + [("x", "b" * 9)] * min(1, n)
        schema = "cell string, q string"
        got = beside(spark.createDataFrame(cases, schema), spark.createDataFrame(examples, schema), "cell", "q", rows_per_task=7).collect()
        want = {(c, q) for c, q in cases for d, e in examples if c == d and q is not None and (q.startswith(e) or e.startswith(q))}
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_long_examples_are_single_rows(spark):
    from verdictframe.operators import review

    long = "what is " + "x" * 10_000
    cases = spark.createDataFrame([(1, "c", long[:9_000]), (2, "c", long + " more"), (3, "c", "what is y"), (4, "d", long), (5, "c", "!!")], "case_id int, cell string, question string")
    examples = spark.createDataFrame([("c", long), ("c", "?!")], "cell string, question string")
    out = review.match_examples(cases, examples)
    assert sorted(r.case_id for r in out.collect()) == [1, 2, 5]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_small_batch_reads_few_splits_of_the_target(spark, tmp_path):
    def upsert(ids, name):
        spark.createDataFrame([(f"c{i}", i) for i in ids], "core_id string, n int").write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = spark.readStream.schema("core_id string, n int").parquet(f"{tmp_path}/{name}")
        ST.upsert_steps(stream, f"{tmp_path}/target", f"{tmp_path}/checkpoint-{name}", splits=32).start().awaitTermination()

    upsert(range(2000), "a")
    upsert([5, 3000], "b")  # one key is there already
    upsert([2999], "a")
    stored = spark.read.parquet(f"{tmp_path}/target")
    assert sorted(r.n for r in stored.collect()) == [*range(2000), 2999, 3000]
    met = [r[0] for r in spark.sql("SELECT pmod(xxhash64(k), 32) FROM VALUES ('c5'), ('c3000') AS t(k)").collect()]
    some = ST.stored_in(spark, f"{tmp_path}/target", met)
    plan = some._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [split" in plan.toString()
    assert some.select(F.input_file_name()).distinct().count() <= 6 < stored.select(F.input_file_name()).distinct().count()
    assert ST.stored_in(spark, f"{tmp_path}/nothing", [1]) is None


def test_latest_row_of_a_frame():
    """By time, then tie, then place; a record of one row is that row, and the types fit the state."""
    import random

    import pandas as pd

    rnd = random.Random(2)
    for n in (1, 2, 3, 40):
        for _ in range(50):
            data = [(rnd.randrange(3), rnd.randrange(3), f"s{i}", "ok") for i in range(n)]
            got = ST._latest_row(pd.DataFrame(data, columns=["at", "tie", "step", "status"]))
            assert got == max(data, key=lambda r: r[:2]) and [type(x) for x in got] == [int, int, str, str]
    assert ST._latest_row(pd.DataFrame({"at": [None, 5.0, 5.0], "tie": [9.0, None, 0.0], "step": ["a", "b", "c"], "status": ["x", "y", "z"]}))[2:] == ("c", "z")
