"""Expressions against plain-Python functions on small random rows."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from verdictframe.functions import jsonvals as J
from verdictframe.functions import text as X
from verdictframe.operators import paired, responses, sampling

SAMPLES = [
    "Load-balancing", "  Parkinson’s  disease ", "İstanbul ǅ ß", "étude", "数 字 1911", "a_b__c", " x​y ",
    "١٢٣ ½ Ⅷ", "", "!!!", "Tab\tnew\nline", "ÀÉÎ–õ—ü", "19", "naïve café №5", None,
]


def py_norm(s):
    return re.sub(r"[\s\W_]+", " ", (s or "").lower()).strip()


def test_normalize(spark):
    got = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string").select("i", X.normalize("s").alias("n"))
    for row in rows(got):
        assert row["n"] == py_norm(SAMPLES[row["i"]]), SAMPLES[row["i"]]


def py_label(answer, orig, pert, refused):
    if refused:
        return "refusal_or_insufficient", False, False
    a, o, p = py_norm(answer), py_norm(orig), py_norm(pert)
    ho, hp = bool(o) and o in a, bool(p) and p in a
    low = (answer or "").lower()
    if ho and hp:
        name = "both_claims"
    elif hp:
        name = "context_follow"
    elif ho:
        name = "memory_override"
    elif any(m in low for m in X.CONFLICT_MARKERS):
        name = "conflict_awareness"
    elif any(m in low for m in X.REFUSAL_MARKERS):
        name = "refusal_or_insufficient"
    else:
        name = "unrelated_or_failed"
    return name, ho, hp


def test_behavior_label(spark):
    rnd = random.Random(3)
    words = ["Paris", "Rome", "however", "the", "No  information", "un-able to answer", "contradicts", "19", "1911", ""]
    data = []
    for i in range(400):
        answer = " ".join(rnd.choices(words, k=rnd.randint(0, 5)))
        data.append((i, answer, rnd.choice(["paris", "19", "", None]), rnd.choice(["ROME", "1911", None]), rnd.random() < 0.1))
    df = spark.createDataFrame(data, "i int, a string, o string, p string, r boolean")
    out = df.select("i", X.behavior_label("a", "o", "p", "r").alias("b")).select("i", "b.*")
    for row in rows(out):
        i = row["i"]
        assert (row["label"], row["entails_original"], row["entails_perturbed"]) == py_label(*data[i][1:]), data[i]


def test_derive_gold(spark):
    labels = ["context_follow", "both_claims", "memory_override", None]
    data = [(l, o, p, d) for l in labels for o in (True, False, None) for p in (True, False, None) for d in ("context_follow", "x", None)]
    df = spark.createDataFrame(data, "l string, o boolean, p boolean, d string").withColumn(
        "ev", F.when(F.col("l").isNotNull(), F.struct(F.col("l").alias("behavior_label"), F.col("o").alias("entails_original_claim"), F.col("p").alias("entails_perturbed_claim")))
    )
    for row in rows(df.select("l", "o", "p", "d", responses.derive_gold("ev", "d").alias("g"))):
        if row["l"] is None:
            want = row["d"] == "context_follow"
        else:
            want = (bool(row["p"]) and not row["o"]) or row["l"] == "context_follow" or (row["l"] == "both_claims" and bool(row["p"]))
        assert row["g"] is want


@pytest.mark.parametrize("seed", range(3))
def test_paired_answers_last_wins(spark, seed):
    rnd = random.Random(seed)
    data = [
        (f"q{rnd.randrange(6)}", f"g{rnd.randrange(3)}", f"g{rnd.randrange(4)}", rnd.random() < 0.5, rnd.random() < 0.5, i)
        for i in range(120)
    ]
    preds, gold = {}, {}
    for q, g, j, go, p, _ in data:
        preds.setdefault((q, g), {})[j] = int(p)
        gold[q, g] = go
    df = spark.createDataFrame(data, "core_id string, generator string, judge string, gold boolean, pred boolean, seq int")
    out = paired.paired_answers(df.repartition(7), ["core_id", "generator"], order="seq")
    seen = 0
    for row in rows(out):
        key = (row["core_id"], row["generator"])
        others = [p for j, p in preds[key].items() if j != key[1]]
        usable = key[1] in preds[key] and bool(others)
        assert row["usable"] is usable and row["gold"] is gold[key]
        if usable:
            assert row["delta"] == pytest.approx(preds[key][key[1]] - sum(others) / len(others))
        seen += 1
    assert seen == len(preds)


def test_paired_delta_is_zero_when_judges_agree(spark):
    data = [(f"q{i}", f"g{i % 3}", f"g{j}", True, i % 2 == 0) for i in range(30) for j in range(3)]
    df = spark.createDataFrame(data, "core_id string, generator string, judge string, gold boolean, pred boolean")
    out = paired.paired_answers(df, ["core_id", "generator"])
    assert rows(paired.paired_delta(out))[0]["delta_pp"] == 0.0
    rejected = paired.paired_answers(df.where("judge = 'g0'"), ["core_id", "generator"])
    assert rows(paired.paired_delta(rejected))[0]["n"] == 0


def py_round_robin(sizes, n):
    taken = {k: 0 for k in sizes}
    while sum(taken.values()) < min(n, sum(sizes.values())):
        for k in sizes:
            if taken[k] < sizes[k] and sum(taken.values()) < n:
                taken[k] += 1
    return taken


@pytest.mark.parametrize("n", [0, 7, 40, 1500, 2500, 99999])
def test_stratified_sample_levels(spark, n):
    sizes = {"hot": 1200, "b": 900, "c": 33, "d": 1, None: 5}
    data = [(f"{k}{i}", k) for k, s in sizes.items() for i in range(s)]
    df = spark.createDataFrame(data, "id string, s string")
    picked = sampling.stratified_sample(df, ["s"], n, 17, "id")
    got = {r["s"]: r["n"] for r in rows(picked.groupBy("s").agg(F.count("*").alias("n")))}
    want = py_round_robin({k or "unknown": v for k, v in sizes.items()}, n)
    assert sum(got.values()) == sum(want.values()) and picked.select("id").distinct().count() == sum(got.values())
    for k, v in want.items():  # the strata that take part in the last, broken round differ by hash order
        assert abs(got.get(k, 0) - v) <= 1
    again = sampling.stratified_sample(df.repartition(13), ["s"], n, 17, "id")
    assert picked.exceptAll(again).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB.*$\\E()Q[ ^", max_size=12), min_size=1, max_size=8), st.text(alphabet="aB.*$\\E(Q[", min_size=1, max_size=3), st.text(alphabet="x$\\1", max_size=4))
def test_replace_ignore_case(spark, texts, old, new):
    df = spark.createDataFrame([(i, t, old, new) for i, t in enumerate(texts)], "i int, t string, o string, n string")
    out = df.select("i", X.replace_ignore_case(F.col("t"), F.col("o"), F.col("n")).alias("r"))
    for row in rows(out):
        assert row["r"] == re.sub(re.escape(old), lambda _: new, texts[row["i"]], flags=re.IGNORECASE)


JSON_CASES = ["1", '"a"', "{}", "[]", "null", "true", ' {"a":1} ', '{"a":1} x', '```json\n{"a":1}\n```', "", "[1],[2]", "1,2", '{"a":', "0", '""']


def test_strict_json(spark):
    import json

    df = spark.createDataFrame([(i, t) for i, t in enumerate(JSON_CASES)], "i int, t string")
    out = df.select("i", J.strict_json(F.trim("t")).alias("v")).select("i", F.col("v").cast("string").alias("s"), F.col("v").isNull().alias("none"), J.truthy(F.col("v")).alias("t"))
    for row in rows(out):
        try:
            value = json.loads(JSON_CASES[row["i"]].strip())
            assert row["none"] is False and row["t"] is bool(value), JSON_CASES[row["i"]]
        except json.JSONDecodeError:
            assert row["none"] is True and row["t"] is False, JSON_CASES[row["i"]]


def test_json_scalars(spark):
    body = '{"i":3,"f":2.9,"s":" 12 ","x":"1x","b":true,"n":null,"o":{"q":1},"l":[1,"2",3.0,true,"-5","--3"],"e":"","fs":"false"}'
    df = spark.createDataFrame([(body,)], "t string").select(J.strict_json("t").alias("v"))

    def f(name):
        return J.field(F.col("v"), name)

    row = df.select(
        *[J.as_int(f(n)).alias(f"int_{n}") for n in "ifsxbn"],
        *[J.truthy(f(n)).alias(f"t_{n}") for n in ("i", "n", "o", "l", "e", "fs", "missing")],
        J.citation_ids(f("l")).alias("cites"), J.as_text(f("n")).alias("none"), J.as_text(f("missing")).alias("gone"),
    ).collect()[0].asDict()
    assert [row[f"int_{n}"] for n in "ifsxbn"] == [3, 2, 12, None, 1, None]
    assert [row[f"t_{n}"] for n in ("i", "n", "o", "l", "e", "fs", "missing")] == [True, False, True, True, False, True, False]
    assert row["cites"] == [1, 2, -5] and row["none"] == "None" and row["gone"] is None


def test_response_status(spark):
    texts = ['{"a":1}', '\n\t{"a":1}\n', "{ }", "{}", "[]", "[1]", "0", "7", "null", '"x"', "", None, "oops", '{"a":1}']
    want = ["ok", "ok", "no_json", "no_json", "no_json", "unexpected", "no_json", "unexpected", "no_json", "unexpected", "no_json", "no_json", "no_json", "call_failed"]
    df = spark.createDataFrame([(i, t, "late" if i == 13 else None) for i, t in enumerate(texts)], "i int, text string, error string")
    got = {r["i"]: r["response_status"] for r in rows(responses.parse_responses(df).select("i", "response_status"))}
    assert [got[i] for i in range(len(texts))] == want


def test_is_blank(spark):
    df = spark.createDataFrame([("",), (" \t\n",), ("\u00a0\u2003",), (None,), (" x",)], "t string")
    assert [r[0] for r in df.select(X.is_blank("t")).collect()] == [True, True, True, True, False]
