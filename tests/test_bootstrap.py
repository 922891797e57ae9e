"""Bootstrap intervals: distribution, shared draws, populations, determinism."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from verdictframe.operators import bootstrap as B
from verdictframe.operators.paired import interval_covers_zero


def make(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    data = [(int(i), float(rng.integers(-2, 3)) / 2, int(rng.integers(1, 4))) for i in range(n) if i % 5]
    stats = spark.createDataFrame(data, "c long, num double, den long")
    both = stats.withColumn("g", F.lit("x")).unionByName(stats.where("c % 2 = 0").withColumn("g", F.lit("y")))
    return both, spark.range(n).withColumnRenamed("id", "c"), data


def numpy_interval(num, den, n_boot=4000, seed=1):
    w = np.random.default_rng(seed).multinomial(len(num), np.full(len(num), 1 / len(num)), size=n_boot)
    d = w @ den
    reps = (w @ num)[d > 0] / d[d > 0]
    return 100 * np.percentile(reps, [2.5, 97.5])


def test_matches_plain_multinomial(spark):
    stats, population, data = make(spark)
    out = {r["g"]: r for r in rows(B.cluster_bootstrap(stats, ["g"], "c", population, n_boot=4000, seed=9, buckets=5))}
    num, den = np.zeros(400), np.zeros(400)
    for c, a, b in data:
        num[c], den[c] = a, b
    for g, keep in (("x", np.ones(400, bool)), ("y", np.arange(400) % 2 == 0)):
        lo, hi = numpy_interval(num * keep, den * keep)
        point = 100 * (num * keep).sum() / (den * keep).sum()
        assert out[g]["point"] == pytest.approx(point) and out[g]["replicates"] == 4000
        assert out[g]["n"] == (den * keep).sum()
        width = hi - lo
        assert out[g]["ci_low"] == pytest.approx(lo, abs=0.08 * width)
        assert out[g]["ci_high"] == pytest.approx(hi, abs=0.08 * width)
        assert out[g]["ci_low"] <= point <= out[g]["ci_high"]


def test_result_does_not_depend_on_partitioning(spark):
    stats, population, _ = make(spark, 120)
    first = rows(B.cluster_bootstrap(stats, ["g"], "c", population, 300, 3).orderBy("g"))
    second = rows(B.cluster_bootstrap(stats.repartition(11), ["g"], "c", population.repartition(3), 300, 3).orderBy("g"))
    assert first == second


def test_population_restricts_and_pads(spark):
    stats, population, data = make(spark, 100)
    inside = population.where("c < 50")
    out = rows(B.cluster_bootstrap(stats.where("g = 'x'"), ["g"], "c", inside, 500, 3))[0]
    assert out["n"] == sum(b for c, _, b in data if c < 50)
    lonely = rows(B.cluster_bootstrap(stats.where("c = 1"), ["g"], "c", population, 500, 3))[0]
    # one cluster with rows out of 100: replicates that miss it are dropped
    assert 200 < lonely["replicates"] < 450


def test_strata_share_draws(spark):
    stats, population, _ = make(spark, 90)
    copy = stats.where("g = 'x'").withColumn("g", F.lit("z"))
    out = {r["g"]: r for r in rows(B.cluster_bootstrap(stats.unionByName(copy), ["g"], "c", population, 400, 3))}
    assert (out["x"]["ci_low"], out["x"]["ci_high"]) == (out["z"]["ci_low"], out["z"]["ci_high"])


@pytest.mark.parametrize("mult", [[1, 1, 1, 5], [100, 1, 40, 2], [1000], [31, 32, 33]])
def test_vector_draws_are_multinomial(mult):
    mult = np.array(mult)
    draw = B._vector_draws(mult, np.random.default_rng(4))
    totals = np.full(4000, int(mult.sum()))
    weights = draw(totals)
    assert (weights.sum(axis=1) == totals).all()
    p = mult / mult.sum()
    assert weights.mean(axis=0) == pytest.approx(mult, rel=0.03, abs=0.05)
    assert weights.var(axis=0) == pytest.approx(mult * (1 - p), rel=0.12, abs=0.05)


def test_hashed_draws_join_and_broadcast_agree(spark, monkeypatch):
    stats, population, _ = make(spark, 80)
    one = population.join(stats.where("g = 'x'").drop("g"), "c", "left").na.fill(0)
    fast = rows(B.hashed_draws(one, "c", 20, 7).orderBy("b"))
    monkeypatch.setattr(B, "_BROADCAST_CLUSTERS", 0)
    assert rows(B.hashed_draws(one, "c", 20, 7).orderBy("b")) == fast


def test_poisson_weights(spark):
    w = spark.range(20000).select(B.poisson_weight(1, F.lit(0), F.col("id")).alias("w"))
    got = w.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v"), F.max("w").alias("x")).first()
    assert got["m"] == pytest.approx(1, abs=0.03) and got["v"] == pytest.approx(1, abs=0.05) and got["x"] >= 5


def test_covers_zero(spark):
    df = spark.createDataFrame([(-1.0, 1.0), (0.5, 1.0), (-2.0, -1.0), (0.0, 3.0), (None, None)], "ci_low double, ci_high double")
    assert [r[0] for r in df.select(interval_covers_zero()).collect()] == [True, False, False, True, False]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_and_clusters_meet_without_broadcast(spark):
    """Files of few bytes hold many clusters: neither draws nor vectors are joined by a table sent through the driver."""
    stats, population, _ = make(spark, 60)
    plan = plan_of(B.hashed_strata(stats, ["g"], "c", population, 10, 3))
    assert "SortMergeJoin [idx" in plan and "BroadcastHashJoin [idx" not in plan
    answers = stats.select("c", F.col("c").alias("a"), (F.col("num") > 0).alias("e"), "g")
    plan = plan_of(B.hashed_rate_interval(answers, ["g"], ["a"], "e", 10, 3))
    assert "SortMergeJoin [_grp" in plan and "BroadcastHashJoin [_grp#" not in plan.split("SortMergeJoin [_grp")[1].split("\n")[0]
    assert "BroadcastHashJoin" not in plan_of(B.statistic_vectors(stats, ["g"], "c", population))


def test_a_task_adds_up_its_buckets(spark):
    """Buckets that share a task give one row for each stratum and replicate, also when a bucket lies in two frames."""
    import pandas as pd

    buckets = {b: pd.DataFrame({"bucket": b, "mult": [3, 40, 1], "key": ["a", "b", "c"], "s": [["x"], ["x", "y"], []], "num": [[1.0], [0.5, 2.0], []], "den": [[1.0], [2.0, 3.0], []]}) for b in (0, 1, 2)}
    sizes = np.array([44, 44, 44])
    want = sum(B._bucket_sums(rows, 50, 3, sizes)[1] for rows in buckets.values())
    frames = [pd.concat([buckets[0], buckets[1][:2]]), pd.concat([buckets[1][2:], buckets[2]])]
    out = pd.concat(B._task_kernel(50, 3, spark.sparkContext.broadcast(sizes))(iter(frames)))
    assert len(out) == 2 * 50 and not out.duplicated(["s", "b"]).any()
    for i, s in enumerate("xy"):
        assert out[out.s == s].num.tolist() == want[:, i].tolist() and out[out.s == s].den.tolist() == want[:, 2 + i].tolist()


def test_populations_share_their_vectors(spark):
    stats, population, _ = make(spark, 120)
    vectors = B.cluster_vectors(stats, ["g"], "c")
    for inside in (population, population.where("c % 3 = 0")):
        shared = rows(B.cluster_bootstrap(stats, ["g"], "c", inside, 300, 3, vectors=vectors).orderBy("g"))
        assert shared == rows(B.cluster_bootstrap(stats, ["g"], "c", inside, 300, 3).orderBy("g"))


def exchanged_bytes(df):
    """Bytes of all rows that crossed a shuffle of a collected DataFrame's final plan."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().get("dataSize") if kind == "ShuffleExchangeExec" else None
        children = node.children()
        return (own.get().value() if own and own.isDefined() else 0) + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_draw_takes_bits(spark):
    """Draws are exchanged as packed counts: two bytes a draw at most, everything included, where a row took over twenty."""
    n, n_boot = 4000, 300
    stats = spark.range(n).select(F.col("id").alias("c"), F.lit("x").alias("g"), (F.col("id") % 3).cast("double").alias("num"), F.lit(2).alias("den"))
    out = B.hashed_strata(stats, ["g"], "c", stats, n_boot, 3)
    assert out.collect()[0]["replicates"] == n_boot
    assert 0 < exchanged_bytes(out) < 2 * n * n_boot


def test_written_steps_leave_no_shuffle_files(spark):
    import time

    from verdictframe.session import checkpointed, shuffles_freed

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), shuffles_freed(spark):
        counts = checkpointed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        1 / 0
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and counts.count() == 7 and spark.conf.get(key) == was


@pytest.mark.parametrize("prefix", ["7:0:", "20260627:99:", "\u00e9:", "y" * 50, "y" * 51, "y" * 70])
def test_first_words_are_md5(prefix):
    import hashlib

    from verdictframe.functions.digests import first_words

    for start, stop in ((0, 1), (0, 1200), (9_990, 10_015), (99_995, 100_003), (5_399_999, 5_400_002), (7, 7)):
        want = [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(start, stop)]
        assert first_words(prefix, start, stop).tolist() == want


@pytest.mark.parametrize("cells", [[0], [1, 0, 15], [16, 0, 47, 2], [300, 15, 0, 1, 31]])
def test_counts_beyond_half_a_byte(cells):
    import pyarrow as pa

    codec = pa.Codec("zstd", compression_level=1)
    parts = list(B._packed(np.array(cells), codec))
    assert sum(B._unpacked(p, len(cells), codec).astype(int) for p in parts).tolist() == cells


def plain_strata(stats, population, n_boot, seed):
    """``hashed_strata`` row by row: {stratum: (n, clusters, point, low, high, replicates)}."""
    import hashlib

    keys = sorted({p for p in population if p is not None}, key=lambda k: (hashlib.md5(str(k).encode()).hexdigest()[:15], k))
    index, size = {k: i for i, k in enumerate(keys)}, len(keys) + (None in population)
    sums = {}
    for stratum, k, num, den in stats:
        if k in index:
            own = sums.setdefault(stratum, {}).setdefault(index[k], [None, None])
            for i, x in enumerate((num, den)):
                own[i] = own[i] if x is None else (own[i] or 0) + x
    hits = [[int(hashlib.md5(f"{seed}:{b}:{d}".encode()).hexdigest()[:8], 16) % size for d in range(size)] for b in range(n_boot)]
    out = {}
    for stratum, own in sums.items():
        num, den = (lambda at: [own[i][0] for i in at if i in own and own[i][0] is not None]), (lambda at: sum(own[i][1] or 0 for i in at if i in own))
        reps = [100 * sum(num(at)) / den(at) for at in hits if den(at) > 0 and num(at)]
        low, high = np.percentile(reps, [2.5, 97.5]) if reps else (None, None)
        every = range(size)
        out[stratum] = (den(every), sum((x[1] or 0) > 0 for x in own.values()), 100 * sum(num(every)) / den(every) if num(every) and den(every) else None, low, high, len(reps) or None)
    return out


@pytest.mark.parametrize("held, per_block, entries", [(1 << 25, 8192, 1 << 17), (7, 3, 1 << 17), (30, 8192, 5)])
@pytest.mark.parametrize("key", ["bigint", "string"])
def test_hashed_strata_row_by_row(spark, monkeypatch, held, per_block, entries, key):
    """Parts of a replicate and blocks of any size give what single draws give, also for odd rows."""
    for name, value in (("_HITS_HELD", held), ("_CLUSTERS_PER_BLOCK", per_block), ("_ENTRIES_PER_BLOCK", entries)):
        monkeypatch.setattr(B, name, value)
    rng = np.random.default_rng(8)
    as_key = (lambda i: f"k{i}") if key == "string" else int
    strata = [("x", 1), ("x", None), ("", 2), (None, 2)]
    data = [(*strata[rng.integers(4)], as_key(i), float(rng.integers(-4, 5)) / 2, int(rng.integers(0, 4))) for i in rng.integers(0, 60, size=150)]
    data += [("nothing", 1, as_key(3), 1.0, 0), ("unknown", 1, as_key(4), None, 2), ("x", 1, as_key(5), None, 3), ("x", 1, as_key(6), 1.0, None), ("x", 1, None, 1.0, 1), ("far", 9, as_key(99), 1.0, 1)]
    population = [as_key(i) for i in range(2, 50)] + [None, as_key(2)]
    stats = spark.createDataFrame(data, f"g string, h int, c {key}, num double, den long")
    people = spark.createDataFrame([(p,) for p in population], f"c {key}")
    got = rows(B.hashed_strata(stats, ["g", "h"], "c", people, 40, 5))
    want = plain_strata([((g, h), c, num, den) for g, h, c, num, den in data], population, 40, 5)
    assert {(r["g"], r["h"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, clusters, point, low, high, replicates = want[r["g"], r["h"]]
        assert (r["n"], r["n_clusters"], r["replicates"]) == (n, clusters, replicates)
        for column, value in (("point", point), ("ci_low", low), ("ci_high", high)):
            assert r[column] == (None if value is None else pytest.approx(value)), (column, r)


def test_populations_share_blocked_stats(spark):
    stats, population, _ = make(spark, 120)
    blocked = B.blocked_stats(stats, ["g"], "c", population)
    for inside in (population, population.where("c % 3 = 0"), population.where("c < 0")):
        shared = rows(B.hashed_strata(stats, ["g"], "c", inside, 30, 3, blocked=blocked).orderBy("g"))
        assert shared == rows(B.hashed_strata(stats, ["g"], "c", inside, 30, 3).orderBy("g"))
