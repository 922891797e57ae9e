"""Hot groups: a third of the rows share one key. Results stay whole, plans stay split."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from verdictframe.operators import history, matrix, paired, ranking, review, sampling, usage
from verdictframe.operators.assignment import assign_balanced

N = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(N, numPartitions=8).select("id", key.alias("k"), (F.col("id") * 7919 % 1000).alias("v")).cache()


def plain_ranks(df, groups, order):
    from pyspark.sql.window import Window

    return df.withColumn("want", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def test_hash_rank_is_exact(hot):
    got = ranking.rank_by_hash(hot, ["k"], 3, ["id"], "r")
    want = plain_ranks(hot.withColumn("h", ranking.hash_order(3, "id")), ["k"], ["h", "id"])
    assert got.join(want, "id").where("r <> want").count() == 0 and got.count() == N


def test_hash_rank_spreads_the_hot_group(hot):
    """No (group, bucket) pair, which is what a sort task sees, holds much of the hot group."""
    bucket = F.shiftright(ranking.hash_order(3, "id"), 52)
    largest = hot.groupBy("k", bucket).count().agg(F.max("count")).first()[0]
    assert largest < 0.02 * N / 3


@pytest.mark.parametrize("limit", [5, 5000])
def test_limited_rank(hot, limit):
    got = ranking.rank_by_hash(hot, ["k"], 3, ["id"], "r", limit=limit)
    sizes = {r["k"]: r["n"] for r in rows(hot.groupBy("k").agg(F.count("*").alias("n")))}
    assert {r["k"]: r["n"] for r in rows(got.groupBy("k").agg(F.count("*").alias("n")))} == {k: min(n, limit) for k, n in sizes.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("WindowGroupLimit" in plan) is (limit <= ranking.SMALL_LIMIT)


def test_value_rank_with_ties_and_nulls(spark, hot):
    df = hot.withColumn("v", F.when(F.col("id") % 11 != 0, F.when(F.col("v") < 400, 7).otherwise(F.col("v"))))
    got = ranking.rank_by_value(df, ["k"], "v", ["id"], "r")
    tied = df.withColumn("h", ranking.hash_order("", "id"))
    want = plain_ranks(tied, ["k"], ["v", "h"]).select("id", "want")
    assert got.join(want, "id").where("r <> want").count() == 0 and got.count() == N
    assert got.exceptAll(ranking.rank_by_value(df.repartition(5), ["k"], "v", ["id"], "r")).count() == 0
    whole = ranking.rank_by_value(df, [], "id", out="r")
    assert whole.where("r <> id + 1").count() == 0


def test_a_common_value_is_split(spark, hot, monkeypatch):
    """No window partition holds more than a sliver of the rows that share one value."""
    seen = {}
    inner = ranking._bucket_rank

    def spy(df, *args, **more):
        seen["largest"] = df.groupBy("_bucket").count().agg(F.max("count")).first()[0]
        return inner(df, *args, **more)

    monkeypatch.setattr(ranking, "_bucket_rank", spy)
    df = hot.withColumn("v", F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 2 == 0, 500).otherwise(F.col("v")))
    assert ranking.rank_by_value(df, [], "v", ["id"], "r").agg(F.max("r")).first()[0] == N
    assert seen["largest"] < 0.01 * N


@pytest.mark.parametrize("groups", [[], ["k"]])
def test_buckets_grow_in_number(spark, hot, groups, monkeypatch):
    """With room for a few rows a bucket there are more of them, inside common values too; ranks stay exact."""
    df = hot.withColumn("v", F.when(F.col("id") % 11 != 0, F.when(F.col("v") < 400, 7).otherwise(F.col("v"))))
    want = plain_ranks(df.withColumn("h", ranking.hash_order("", "id")), groups, ["v", "h"]).select("id", "want")
    got = ranking.rank_by_value(df, groups, "v", ["id"], "r", rows_per_bucket=20)
    assert got.join(want, "id").where("r <> want").count() == 0 and got.count() == N
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 10)
    hashed = df.withColumn("h", ranking.hash_order(3, "id"))
    assert hashed.groupBy(ranking._hash_bucket(df, F.col("h"))).count().agg(F.max("count")).first()[0] < 40
    want = plain_ranks(hashed, groups, ["h"]).select("id", "want")
    assert ranking.rank_by_hash(df, groups, 3, ["id"], "r").join(want, "id").where("r <> want").count() == 0


def test_null_groups(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"))
    got = ranking.rank_by_hash(df, ["k"], 1, ["id"], "r")
    assert rows(got.groupBy("k").agg(F.max("r").alias("m"), F.count("*").alias("n")).orderBy("k")) == [
        {"k": None, "m": 50, "n": 50}, {"k": "a", "m": 50, "n": 50}
    ]


def test_slices(hot):
    got = sampling.slice_rows(hot.select("id"), "id", 12_345, 4_000)
    assert rows(got.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")))[0] == {"a": 12345, "b": 16344, "n": 4000}
    assert sampling.slice_rows(hot, "id", N - 10, 500).count() == 10


def test_combine_round_robin_with_one_large_source(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2900, 0).otherwise(1).alias("src"))
    out = sampling.combine_sources(df, "src", "id").orderBy("ord1", "ord2").limit(8)
    assert [r["id"] for r in rows(out)] == [0, 2900, 1, 2901, 2, 2902, 3, 2903]


def test_latest_on_hot_key(hot):
    out = {r["k"]: r["id"] for r in rows(history.latest(hot, ["k"], "id"))}
    assert out["hot"] == max(i for i in range(N) if i % 3 == 0)
    plan = history.latest(hot, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_hot_answer_collapses_map_side(spark):
    """One answer with a third of all verdicts, each judge repeated: last wins, one row comes out."""
    v = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("core_id"), F.lit("g0").alias("generator"),
        F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("judge"), F.lit(True).alias("gold"),
        (F.col("id") > 8990).alias("pred"), "id",
    )
    out = paired.paired_answers(v, ["core_id", "generator"], order="id")
    hot = rows(out.where("core_id = 0"))[0]
    assert hot["usable"] and hot["same"] == 1.0 and hot["cross"] == 1.0
    assert out.count() == 6001


def test_confusion_sums_to_n_under_repartition(hot):
    v = hot.select("k", (F.col("v") % 2 == 0).alias("gold"), (F.col("v") % 3 == 0).alias("pred"))
    one = matrix.confusion(v, ["k"])
    assert one.where("tp + fp + tn + fn <> n").count() == 0
    assert one.exceptAll(matrix.confusion(v.repartition(17), ["k"])).count() == 0


def test_matched_and_capped(hot):
    reference = F.col("v") < 100
    out = sampling.matched_sample(hot, "k", reference, ~reference, 5, "id")
    need = {r["k"]: r["n"] for r in rows(hot.where(reference).groupBy("k").agg(F.count("*").alias("n")))}
    have = {r["k"]: r["n"] for r in rows(out.groupBy("k").agg(F.count("*").alias("n")))}
    assert have == need and out.where(reference).count() == 0
    capped = sampling.capped_sample(hot, ["k"], 12, 5, "id")
    assert capped.groupBy("k").count().agg(F.max("count")).first()[0] == 12
    assert capped.where("k = 'hot'").first()["population"] == N // 3


def test_assignment_invariants(spark):
    """Class of all three providers holds most questions; providers end level and on target."""
    rows_ = spark.range(6000).select(
        F.col("id").cast("string").alias("core_id"), F.explode(F.array(*[F.lit(p) for p in "abc"])).alias("provider"), "id"
    )
    valid = (F.col("id") % 3 != 0) | (F.col("provider") == "a") & (F.col("id") % 30 != 0)
    kind = F.concat(F.lit("t"), ((F.col("id") + F.ascii("provider")) % 4).cast("string"))
    df = rows_.select("core_id", "provider", kind.alias("kind"), valid.alias("is_validated"))
    out = assign_balanced(df, 3000).cache()
    assert out.count() == 3000 and out.select("core_id").distinct().count() == 3000
    assert out.where("NOT is_validated").count() == 0
    got = {r["provider"]: r["n"] for r in rows(out.groupBy("provider").agg(F.count("*").alias("n")))}
    assert got == {"a": 1000, "b": 1000, "c": 1000}
    spread = rows(out.groupBy("provider", "kind").agg(F.count("*").alias("n")))
    assert len(spread) == 12 and all(150 <= r["n"] <= 350 for r in spread)
    single = rows(out.where("validators = 1").agg(F.count("*").alias("n")))[0]["n"]
    assert single == 1000  # single-validator questions are taken first, up to the target
    again = assign_balanced(df.repartition(13), 3000)
    assert out.select("core_id", "provider").exceptAll(again.select("core_id", "provider")).count() == 0


def test_example_match_equals_brute_force(spark):
    import random

    rnd = random.Random(1)
    texts = ["", "what", "what is", "what is the capital", "what is the capital of peru", "who", "w", "when was it", "What  IS the!"]
    cases = [(f"c{i}", rnd.choice("xy"), rnd.choice(texts)) for i in range(60)]
    examples = [(rnd.choice("xy"), t) for t in texts if t]
    got = {r["case_id"] for r in rows(review.match_examples(
        spark.createDataFrame(cases, "case_id string, cell string, question string"),
        spark.createDataFrame(examples, "cell string, question string")))}
    norm = lambda s: " ".join("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())
    want = {c for c, cell, q in cases for ecell, e in examples
            if cell == ecell and (norm(q).startswith(norm(e)) or norm(e).startswith(norm(q)))}
    assert got == want


def test_latency_median_of_hot_model(hot):
    t = hot.select(F.col("k").alias("model"), F.col("v").alias("latency_ms"), F.lit(False).alias("error"), F.lit(1).alias("input_tokens"))
    out = {r["model"]: r["p50_ms"] for r in rows(usage.latency_summary(t, ["model"]))}
    want = hot.where("k = 'hot'").agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert out["hot"] == want


def test_strata_are_spread_where_their_cluster_lies(spark):
    """Rows are dealt by cluster before they are spread over strata; nothing is shuffled after that."""
    answers = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("core_id"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("generator"), (F.col("id") % 2 == 0).alias("gold"),
        F.lit(True).alias("is_validated"), F.lit(True).alias("usable"), (F.col("id") % 5 / 2).alias("delta"), F.lit(1.0).alias("same"), F.lit(0.5).alias("cross"), F.lit("context_follow").alias("behavior"),
    )
    strata = paired.stratum_stats(answers, "core_id", populations=paired.population_names())
    slices = paired.slice_stats(answers, "core_id", {"all": None, "follow": ["context_follow"]})
    for out in (strata, slices):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("Generate")[0] and "Generate" in plan
    total = rows(strata.where("`group` = 'all' AND metric = 'flag_rate_delta' AND population = 'full'").agg(F.sum("den").alias("n"), F.sum("num").alias("x"), F.countDistinct("core_id").alias("c"), F.count("*").alias("r")))[0]
    assert total["n"] == 4000 and total["x"] == 4000.0 and total["c"] == total["r"]
    assert slices.where("`group` = 'follow' AND metric = 'all_flag_delta'").agg(F.sum("den")).first()[0] == 4000


def test_cuts_of_few_groups_go_to_all_tasks(spark, hot, monkeypatch):
    """Rows aren't shuffled by their group to meet its cuts; many groups' cuts are joined, with the same ranks."""
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = ranking._split_by_value(hot.withColumn("_tie", F.lit(0).cast("bigint")), ["k"], "v", "_tie", 0, "_bucket")
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        few = ranking.rank_by_value(hot, ["k"], "v", ["id"], "r")
        assert few._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") <= 2  # offsets, and the window
        monkeypatch.setattr(ranking, "_BROADCAST_CUTS", 0)
        many = ranking.rank_by_value(hot, ["k"], "v", ["id"], "r")
        assert few.count() == N and few.exceptAll(many).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)


def test_membership_is_not_broadcast(spark, hot):
    """Ids may be as many as the questions; restricting to them sends no table to every task."""
    ids = spark.range(0, 50, 2).select("id").unionByName(spark.range(0, 50, 4).select("id"))
    v = hot.where("id < 100").withColumnRenamed("v", "value")
    kept, flagged = history.restrict(v, ids, "id"), history.flag_membership(v, ids, "id", "member")
    named = history.attach_core(v, ids.distinct().withColumn("c", F.lit("known")), ["c"], "id")
    for out in (kept, flagged, named):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in rows(kept)) == list(range(0, 50, 2))
    assert flagged.count() == 100 and flagged.where("member").count() == 25 and named.where("c = 'unknown'").count() == 75
