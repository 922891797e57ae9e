"""Published tables that must hold as identities."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from verdictframe.functions.scalars import pct
from verdictframe.operators import behavior, bootstrap, labels, matrix, paired, review, usage
from verdictframe.operators.assignment import SEPARATOR, _level_off, _plan_classes, capacity_targets
from verdictframe.plans import verdict_queries as V

CELLS = """full GPT GPT 134 9 39 115 93.706 77.457 84.81 7.258
full GPT Grok 131 38 28 102 77.515 82.39 79.878 27.143
full GPT Gemini 140 30 25 101 82.353 84.848 83.582 22.901
full Grok GPT 136 15 39 109 90.066 77.714 83.436 12.097
full Grok Grok 128 31 31 110 80.503 80.503 80.503 21.986
full Grok Gemini 142 22 22 110 86.585 86.585 86.585 16.667
full Gemini GPT 151 19 24 105 88.824 86.286 87.536 15.323
full Gemini Grok 136 37 23 104 78.613 85.535 81.928 26.241
full Gemini Gemini 151 25 14 107 85.795 91.515 88.563 18.939
validated GPT GPT 125 8 35 104 93.985 78.125 85.324 7.143
validated GPT Grok 120 34 27 93 77.922 81.633 79.734 26.772
validated GPT Gemini 124 28 25 94 81.579 83.221 82.392 22.951
validated Grok GPT 126 14 36 98 90.0 77.778 83.444 12.5
validated Grok Grok 117 29 30 99 80.137 79.592 79.863 22.656
validated Grok Gemini 127 21 21 102 85.811 85.811 85.811 17.073
validated Gemini GPT 140 17 22 95 89.172 86.42 87.774 15.179
validated Gemini Grok 125 35 22 93 78.125 85.034 81.433 27.344
validated Gemini Gemini 135 23 14 100 85.443 90.604 87.948 18.699
gap_fill GPT GPT 9 1 4 11 90.0 69.231 78.261 8.333
gap_fill GPT Grok 11 4 1 9 73.333 91.667 81.481 30.769
gap_fill GPT Gemini 16 2 0 7 88.889 100.0 94.118 22.222
gap_fill Grok GPT 10 1 3 11 90.909 76.923 83.333 8.333
gap_fill Grok Grok 11 2 1 11 84.615 91.667 88.0 15.385
gap_fill Grok Gemini 15 1 1 8 93.75 93.75 93.75 11.111
gap_fill Gemini GPT 11 2 2 10 84.615 84.615 84.615 16.667
gap_fill Gemini Grok 11 2 1 11 84.615 91.667 88.0 15.385
gap_fill Gemini Gemini 16 2 0 7 88.889 100.0 94.118 22.222"""
MARGINS = {
    "full": (82.757, 83.508, 86.009, 85.261, 80.77, 86.243, 84.625, 83.824, 0.801),
    "validated": (82.483, 83.039, 85.718, 85.514, 80.343, 85.384, 84.378, 83.431, 0.947),
    "gap_fill": (84.62, 88.361, 88.911, 82.07, 85.827, 93.995, 86.793, 87.55, -0.757),
}
UNPAIRED = """full GPT -6.162 -17.764 3.08
full Grok -1.646 7.604 -4.508
full Gemini 5.605 -1.843 3.831
validated GPT -4.302 -17.718 4.261
validated Grok -2.203 7.869 -4.764
validated Gemini 4.877 -2.562 3.344"""
RUNS = """20260531-175601-judge-gpt-on-gpt GPT 299 297 2 623884 35814 2 741135
20260531-175608-judge-grok-on-gpt Grok 299 299 0 621745 35996 0 3115974
20260531-175617-judge-gemini-on-gpt Gemini 299 299 0 650468 33154 0 1783847
20260531-212107-judge-gpt-on-grok GPT 300 299 1 612242 35385 1 740704
20260531-212120-judge-gemini-on-grok Gemini 300 300 0 636937 32067 0 1700641
20260531-212359-judge-grok-on-grok Grok 300 300 0 608631 34941 0 3533986
20260531-230842-judge-gpt-on-gemini GPT 297 296 1 618308 34936 1 779882
20260531-230848-judge-grok-on-gemini Grok 297 296 1 611995 34089 1 3548605
20260531-230857-judge-gemini-on-gemini Gemini 297 297 0 642748 31799 0 1635497"""
BEHAVIORS = """context_follow 1212 100.0 84.6 1025 0 187 0 recall 84.6
both_claims 135 97.8 65.2 88 0 44 3 recall 66.7
memory_override 42 0.0 0.0 0 0 0 42 fpr 0.0
conflict_awareness 54 5.6 90.7 3 46 0 5 fpr 90.2
refusal_or_insufficient 400 6.0 38.2 23 130 1 246 fpr 34.6
unrelated_or_failed 606 0.0 4.1 0 25 0 581 fpr 4.1
UNLABELED 9 0.0 88.9 0 8 0 1 fpr 88.9"""


def verdict_rows(spark, lines, head):
    """Verdict rows that reproduce the published cell counts."""
    schema = ", ".join(f"{n} string" for n in head) + ", tp int, fp int, fn int, tn int"
    counted = spark.createDataFrame(lines, schema)
    kinds = [("tp", True, True), ("fp", False, True), ("fn", True, False), ("tn", False, False)]
    cells = F.array(*[F.struct(F.col(k).alias("k"), F.lit(g).alias("gold"), F.lit(p).alias("pred")) for k, g, p in kinds])
    spread = counted.select(*head, F.explode(cells).alias("c")).where("c.k > 0")
    return spread.select(*head, "c.gold", "c.pred", F.explode(F.sequence(F.lit(1), F.col("c.k"))).alias("i"))


@pytest.fixture(scope="module")
def cells(spark):
    lines = [line.split() for line in CELLS.splitlines()]
    parsed = [(p, j, g, *map(int, v[:4])) for p, j, g, *v in lines]
    verdicts = verdict_rows(spark, parsed, ["population", "judge", "generator"])
    return matrix.with_metrics(matrix.confusion(verdicts, ["population", "judge", "generator"]), 3).cache()


def test_confusion_cells(cells):
    got = {(r["population"], r["judge"], r["generator"]): r for r in rows(cells)}
    for line in CELLS.splitlines():
        p, j, g, tp, fp, fn, tn, *metrics = line.split()
        row = got[p, j, g]
        assert [row[k] for k in ("tp", "fp", "fn", "tn")] == [int(x) for x in (tp, fp, fn, tn)]
        assert row["n"] == sum(int(x) for x in (tp, fp, fn, tn))
        assert [row[k] for k in ("precision", "recall", "f1", "fpr")] == pytest.approx([float(x) for x in metrics], abs=1e-9)


def test_full_is_validated_plus_gap(cells):
    count = {p: n for p, n in cells.groupBy("population").agg(F.sum("n")).collect()}
    assert count["full"] == 2683 and count["full"] == count["validated"] + count["gap_fill"]


def test_by_population_equals_published_cells(spark, cells):
    lines = [line.split() for line in CELLS.splitlines() if not line.startswith("full")]
    parsed = [(p, j, g, *map(int, v[:4])) for p, j, g, *v in lines]
    v = verdict_rows(spark, parsed, ["population", "judge", "generator"]).withColumn("is_validated", F.col("population") == "validated")
    got = matrix.by_population(v.drop("population"), ["judge", "generator"])
    want = cells.select("population", "judge", "generator", *matrix.COUNTS)
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == 27


def test_margins(cells):
    got = {(r["population"], r["margin"], r["name"]): r["value"] for r in rows(matrix.margins(cells, by=["population"]))}
    names = ["GPT", "Grok", "Gemini"]
    for p, want in MARGINS.items():
        have = [got[p, "row", n] for n in names] + [got[p, "column", n] for n in names]
        have += [got[p, m, "all"] for m in ("diagonal", "off_diagonal", "difference")]
        assert have == pytest.approx(want, abs=5.1e-4)


def test_unpaired(cells):
    got = {(r["population"], r["judge"]): r for r in rows(matrix.unpaired_effects(cells, by=["population"]))}
    for line in UNPAIRED.splitlines():
        p, j, *want = line.split()
        row = got[p, j]
        assert [row[f"{m}_delta"] for m in ("recall", "fpr", "f1")] == pytest.approx([float(x) for x in want], abs=1.1e-3)


def test_usage_rollup(spark):
    parsed = [(r[0], r[1], *map(int, r[2:])) for r in (line.split() for line in RUNS.splitlines())]
    schema = "run_id string, judge string, calls long, verdicts long, errors long, input_tokens long, output_tokens long, missing_input_usage long, sum_call_ms long"
    per_run = spark.createDataFrame(parsed, schema)
    measures = ("calls", "verdicts", "errors", "input_tokens", "output_tokens", "missing_input_usage", "sum_call_ms")
    got = {(r["level"], r["judge"]): r for r in rows(usage.usage_rollup(per_run, measures=measures).where("level <> 'run'"))}
    want = {
        ("judge", "GPT"): (896, 892, 4, 1854434, 106135, 4, 2261721),
        ("judge", "Grok"): (896, 895, 1, 1842371, 105026, 1, 10198565),
        ("judge", "Gemini"): (896, 896, 0, 1930153, 97020, 0, 5119985),
        ("total", None): (2688, 2683, 5, 5626958, 308181, 5, 17580271),
    }
    assert {k: tuple(v[m] for m in measures) for k, v in got.items()} == want
    assert got["total", None]["sum_call_hours"] == pytest.approx(4.883, abs=1e-3)
    assert per_run.where("calls <> verdicts + errors").count() == 0


def test_behavior_blocks(spark):
    parsed = []
    for line in BEHAVIORS.splitlines():
        b, _, _, _, tp, fp, fn, tn, *_ = line.split()
        parsed.append((None if b == "UNLABELED" else b, int(tp), int(fp), int(fn), int(tn)))
    v = verdict_rows(spark, parsed, ["behavior"]).withColumns(
        {"judge": F.lit("a"), "generator": F.lit("b"), "core_id": F.concat_ws("-", "gold", "pred", "i")}
    )
    got = {r["behavior"]: r for r in rows(behavior.behavior_blocks(v, ["core_id"]))}
    for line in BEHAVIORS.splitlines():
        b, n, gold, flag, *_, metric, point = line.split()
        assert got[b]["n_verdicts"] == int(n) and got[b]["headline_metric"] == metric
        have = [got[b][k] for k in ("gold_pos_pct", "flag_pct", "headline")]
        assert have == pytest.approx([float(gold), float(flag), float(point)], abs=0.0501)
    assert sum(r["tp"] for r in got.values()) == 1139 and sum(r["tn"] for r in got.values()) == 878


def test_rule_of_three(spark):
    v = spark.range(42).select(F.lit("g").alias("b"), F.col("id").alias("a"), F.lit(False).alias("e"))
    none = rows(bootstrap.rate_interval(v, ["b"], ["a"], "e", 200))[0]
    assert (none["point"], none["ci_low"]) == (0.0, 0.0) and round(none["ci_high"], 1) == 7.1
    every = rows(bootstrap.rate_interval(v.withColumn("e", F.lit(True)), ["b"], ["a"], "e", 200))[0]
    assert every["ci_high"] == 100.0 and every["ci_low"] == pytest.approx(100 - 300 / 42)
    bounds = review.event_bounds(F.col("e"), F.col("n"))
    got = spark.createDataFrame([(0, 25), (0, 31), (3, 9)], "e int, n int").select(*[b.alias(n) for b, n in zip(bounds, "lh")])
    assert [r["h"] for r in rows(got)] == [12.0, pytest.approx(300 / 31), None]


def test_rates(spark):
    got = spark.createDataFrame([(47, 83, 106, 216), (142, 274, 11, 25), (126, 134, 101, 134)], "a int, b int, c int, d int")
    out = [tuple(r) for r in got.select(pct("a", "b"), pct("c", "d")).collect()]
    assert out[0][0] - out[0][1] == pytest.approx(7.553, abs=1e-3)
    assert out[1][0] - out[1][1] == pytest.approx(7.825, abs=1e-3)
    assert out[2] == (pytest.approx(94.03, abs=1e-3), pytest.approx(75.373, abs=1e-3))


def test_self_affinity_published_counts(spark):
    parts = [("g", "g", 47, 83), ("g", "x", 106, 216)]
    data = [(g, p, "context_follow" if i < k else "unrelated_or_failed") for g, p, k, n in parts for i in range(n)]
    df = spark.createDataFrame(data, "generator string, perturber string, label string")
    assert rows(labels.self_affinity(df))[0]["delta_pp"] == pytest.approx(7.553, abs=1e-3)


def test_capacity_targets():
    assert capacity_targets({"a": 92, "b": 155, "c": 256}, 300) == {"a": 92, "b": 100, "c": 108}
    assert capacity_targets({"a": 3, "b": 4}, 10) == {"a": 3, "b": 4}
    assert capacity_targets({"a": 100, "b": 100, "c": 100}, 10) == {"a": 4, "b": 3, "c": 3}


def test_level_off_equals_unit_steps():
    for heights, units in [((5, 9, 9), 7), ((0, 3, 8), 20), ((4, 4, 4), 5), ((10, 1, 6), 0), ((7,), 3)]:
        left = dict(enumerate(heights))
        for _ in range(units):
            best = max(left, key=lambda p: left[p])
            if left[best] <= 0:
                break
            left[best] -= 1
        taken = _level_off(dict(enumerate(heights)), units)
        assert {p: heights[p] - k for p, k in taken.items()} == left


def test_plan_is_single_validators_first():
    plan = _plan_classes([(SEPARATOR.join("ab"), 2, 100), ("a", 1, 5), ("b", 1, 50)], {"a": 30, "b": 40})
    assert [p[0] for p in plan][:2] == ["a", "b"]
    taken = {}
    for _, provider, lo, hi, *_ in plan:
        taken[provider] = taken.get(provider, 0) + hi - lo
    assert taken == {"a": 30, "b": 40}


def test_decision_pending_on_published_counts(spark):
    data = [("same_fp", 60, 11, 1, 0), ("cross_fp", 61, 0, 0, 0)]
    df = spark.createDataFrame(data, "audit_group string, n int, reviewed int, alternate int, false_alarm int")
    assert rows(review.decide(df))[0]["decision"] == "pending"
    ready = [("same_fp", 10, 10, 1, 8), ("cross_fp", 10, 10, 4, 5)]
    assert rows(review.decide(spark.createDataFrame(ready, df.schema)))[0]["decision"] == "C"
    assert rows(review.decide(spark.createDataFrame([("same_fp", 10, 10, 1, 8), ("cross_fp", 10, 10, 2, 5)], df.schema)))[0]["decision"] == "A"
    assert rows(review.decide(spark.createDataFrame([("same_fp", 10, 10, 5, 8), ("cross_fp", 10, 10, 6, 5)], df.schema)))[0]["decision"] == "B"


def test_paired_deltas_on_fixture(spark):
    """Expected deltas at sf0.01: all, gold-positive, gold-negative, then validated only."""
    answers = V._answers(spark, "/root/testdata/sf0.01")
    for df, want in ((answers, (0.3150, -0.1746, 0.5606)), (answers.where("is_validated"), (0.2324, -0.4351, 0.5657))):
        have = [rows(paired.paired_delta(d))[0]["delta_pp"] for d in (df, df.where("gold"), df.where("NOT gold"))]
        assert have == pytest.approx(want, abs=5.1e-5)
