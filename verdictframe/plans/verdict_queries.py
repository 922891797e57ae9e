"""Confusion matrices, paired contrasts, bootstraps and behaviour blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions.scalars import pair_type
from verdictframe.operators import bootstrap as B
from verdictframe.operators import matrix as M
from verdictframe.operators import paired as P
from verdictframe.operators.behavior import behavior_blocks, headline_intervals
from verdictframe.operators.quality import expect
from verdictframe.operators.ranking import hash_order
from verdictframe.plans import tables as T
from verdictframe.plans.registry import query, round_columns, rounded
from verdictframe.session import checkpointed, shuffles_freed

CELLS_SQL = """count(*) AS n, count(*) FILTER (gold) AS gold_pos, count(*) FILTER (gold AND pred) AS tp,
  count(*) FILTER (NOT gold AND pred) AS fp, count(*) FILTER (NOT gold AND NOT pred) AS tn,
  count(*) FILTER (gold AND NOT pred) AS fn"""
PR_SQL = """*, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r"""
METRICS_SQL = """100 * p AS "precision", 100 * r AS recall,
  100 * CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1,
  CASE WHEN fp + tn > 0 THEN 1e2 * fp / (fp + tn) END AS fpr"""


def cells_cte(source: str, keys: str = "judge, generator") -> str:
    """CTEs v, c (counts), m (metrics) over a verdict table."""
    return f"""WITH v AS ({source}), c AS (SELECT {keys}, {CELLS_SQL} FROM v GROUP BY {keys}),
m AS (SELECT {keys}, n, gold_pos, tp, fp, tn, fn, {METRICS_SQL} FROM (SELECT {PR_SQL} FROM c))"""


def _cells(spark, sf_dir, source=T.verdicts):
    fill = {"judge": T.JUDGES, "generator": T.JUDGES}
    return M.with_metrics(M.confusion(source(spark, sf_dir), ["judge", "generator"], fill=fill))


@query(
    "confusion_matrix",
    cells_cte(T.VERDICTS)
    + """ SELECT judge, generator, n, gold_pos, tp, fp, tn, fn, round("precision", 6) AS "precision",
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr FROM m""",
)
def confusion_matrix(spark, sf_dir):
    return round_columns(_cells(spark, sf_dir), "precision", "recall", "f1", "fpr")


@query(
    "confusion_matrix_empty_cells",
    f"""WITH v AS (SELECT * FROM ({T.DOC_VERDICTS}) WHERE judge <> 'g1' OR generator <> 'g2'),
c AS (SELECT judge, generator, {CELLS_SQL} FROM v GROUP BY ALL),
grid AS (SELECT 'g' || j AS judge, 'g' || g AS generator FROM range(3) a(j), range(3) b(g)),
f AS (SELECT judge, generator, coalesce(n, 0) AS n, coalesce(gold_pos, 0) AS gold_pos, coalesce(tp, 0) AS tp,
  coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, coalesce(fn, 0) AS fn FROM grid LEFT JOIN c USING (judge, generator))
SELECT judge, generator, n, gold_pos, tp, fp, tn, fn, round(100 * p, 6) AS "precision", round(100 * r, 6) AS recall,
  round(100 * CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
  round(CASE WHEN fp + tn > 0 THEN 1e2 * fp / (fp + tn) END, 6) AS fpr FROM (SELECT {PR_SQL} FROM f)""",
)
def confusion_matrix_empty_cells(spark, sf_dir):
    def without_one(s, d):
        return T.doc_verdicts(s, d).where((F.col("judge") != "g1") | (F.col("generator") != "g2"))

    return round_columns(_cells(spark, sf_dir, without_one), "precision", "recall", "f1", "fpr")


@query(
    "matrix_margins",
    cells_cte(T.VERDICTS)
    + """, x AS (SELECT judge, generator, round(f1, 3) AS f1 FROM m),
d AS (SELECT avg(f1) FILTER (judge = generator) AS diagonal, avg(f1) FILTER (judge <> generator) AS off_diagonal FROM x)
SELECT margin, name, round(value, 6) AS value FROM (
SELECT 'row' AS margin, judge AS name, avg(f1) AS value FROM x GROUP BY judge
UNION ALL SELECT 'column', generator, avg(f1) FROM x GROUP BY generator
UNION ALL SELECT 'diagonal', 'all', diagonal FROM d
UNION ALL SELECT 'off_diagonal', 'all', off_diagonal FROM d
UNION ALL SELECT 'difference', 'all', diagonal - off_diagonal FROM d)""",
)
def matrix_margins(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("f1", F.round("f1", 3))
    return round_columns(M.margins(cells), "value")


POPULATION_SQL = f"""WITH v AS (SELECT *, CASE WHEN is_validated THEN 'validated' ELSE 'gap_fill' END AS pop FROM ({T.VERDICTS})),
a AS (SELECT 'full' AS population, judge, generator, gold, pred FROM v
  UNION ALL SELECT pop, judge, generator, gold, pred FROM v),
c AS (SELECT population, judge, generator, {CELLS_SQL} FROM a GROUP BY ALL),
m AS (SELECT population, judge, generator, n, gold_pos, tp, fp, tn, fn, {METRICS_SQL} FROM (SELECT {PR_SQL} FROM c))"""


@query(
    "population_matrices",
    POPULATION_SQL
    + """ SELECT population, judge, generator, n, gold_pos, tp, fp, tn, fn, round("precision", 6) AS "precision",
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr FROM m""",
)
def population_matrices(spark, sf_dir):
    cells = M.with_metrics(M.by_population(T.verdicts(spark, sf_dir), ["judge", "generator"]))
    return round_columns(cells, "precision", "recall", "f1", "fpr")


def _unpaired_sql(metric: str) -> str:
    return f"""round(max({metric}) FILTER (judge = generator), 6) AS {metric}_own,
  round(avg({metric}) FILTER (judge <> generator), 6) AS {metric}_cross,
  round(max(coalesce({metric}, 0)) FILTER (judge = generator) - avg(coalesce({metric}, 0)) FILTER (judge <> generator), 6) AS {metric}_delta"""


@query(
    "unpaired_effects",
    POPULATION_SQL
    + f""" SELECT population, judge, {_unpaired_sql('recall')}, {_unpaired_sql('fpr')}, {_unpaired_sql('f1')}
FROM m GROUP BY population, judge""",
)
def unpaired_effects(spark, sf_dir):
    cells = M.with_metrics(M.by_population(T.verdicts(spark, sf_dir), ["judge", "generator"]))
    out = M.unpaired_effects(cells, by=["population"], metrics=("recall", "fpr", "f1"))
    return round_columns(out, *[c for c in out.columns if c not in ("population", "judge")])


ANSWERS_SQL = f"""WITH v AS ({T.VERDICTS}),
a AS (SELECT core_id, generator, l_linenumber, l_partkey, l_suppkey, bool_or(gold) AS gold, bool_or(is_validated) AS is_validated,
  max(behavior) AS behavior, max(pred::int) FILTER (judge = generator) AS same,
  sum(pred::int) FILTER (judge <> generator) / count(*) FILTER (judge <> generator) AS "cross" FROM v GROUP BY ALL),
u AS (SELECT *, same IS NOT NULL AND "cross" IS NOT NULL AS usable, same - "cross" AS delta FROM a)"""
ANSWERS_SQL = ANSWERS_SQL.replace("GROUP BY ALL)", "GROUP BY core_id, generator, l_linenumber, l_partkey, l_suppkey)")
POINT_SQL = """count(*) FILTER (usable) AS n, count(*) FILTER (NOT usable) AS dropped,
  round(100 * avg(same) FILTER (usable), 6) AS same_pct, round(100 * avg("cross") FILTER (usable), 6) AS cross_pct,
  round(100 * avg(delta) FILTER (usable), 6) AS delta_pp"""


def _answers(spark, sf_dir):
    return P.paired_answers(T.verdicts(spark, sf_dir), T.ANSWER_KEYS, carry=["is_validated", "behavior"])


def _points(answers, by):
    return round_columns(P.paired_delta(answers, by), "same_pct", "cross_pct", "delta_pp")


@query("paired_delta_global", ANSWERS_SQL + f" SELECT gold, is_validated, {POINT_SQL} FROM u GROUP BY gold, is_validated")
def paired_delta_global(spark, sf_dir):
    return _points(_answers(spark, sf_dir), ["gold", "is_validated"])


@query("paired_delta_by_generator", ANSWERS_SQL + f" SELECT generator, gold, {POINT_SQL} FROM u GROUP BY generator, gold")
def paired_delta_by_generator(spark, sf_dir):
    return _points(_answers(spark, sf_dir), ["generator", "gold"])


@query(
    "paired_delta_last_wins",
    f"""WITH v AS (SELECT * FROM ({T.VERDICTS}) WHERE judge <> 'g2' OR l_linenumber <> 3),
l AS (SELECT core_id, generator, judge, arg_max(pred, o) AS pred, arg_max(gold, o) AS gold, max(o) AS o
  FROM (SELECT *, (l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey) * 4 + pred::int * 2 + gold::int AS o FROM v) GROUP BY core_id, generator, judge),
a AS (SELECT core_id, generator, arg_max(gold, o) AS gold, max(pred::int) FILTER (judge = generator) AS same,
  sum(pred::int) FILTER (judge <> generator) / count(*) FILTER (judge <> generator) AS "cross" FROM l GROUP BY core_id, generator),
u AS (SELECT *, same IS NOT NULL AND "cross" IS NOT NULL AS usable, same - "cross" AS delta FROM a)
SELECT generator, {POINT_SQL} FROM u GROUP BY generator""",
)
def paired_delta_last_wins(spark, sf_dir):
    v = T.verdicts(spark, sf_dir).where((F.col("judge") != "g2") | (F.col("l_linenumber") != 3))
    row = F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")
    order = row * 4 + F.col("pred").cast("int") * 2 + F.col("gold").cast("int")
    answers = P.paired_answers(v.withColumn("ord", order), ["core_id", "generator"], order="ord")
    return _points(answers, ["generator"])


SLICES = {
    "all": None,
    "follow": ["context_follow"],
    "follow_both": ["context_follow", "both_claims"],
    "committed": ["context_follow", "both_claims", "memory_override"],
}


@query(
    "paired_slices",
    ANSWERS_SQL
    + """, s(slice, label) AS (VALUES ('all', NULL), ('follow', 'context_follow'), ('follow_both', 'context_follow'),
  ('follow_both', 'both_claims'), ('committed', 'context_follow'), ('committed', 'both_claims'), ('committed', 'memory_override')),
x AS (SELECT slice, gold, delta FROM u JOIN s ON slice = 'all' OR behavior = label WHERE usable AND is_validated),
y AS (SELECT slice, CASE WHEN gold THEN 'recall_delta' ELSE 'avoided_flag_delta' END AS metric, delta FROM x
  UNION ALL SELECT slice, 'all_flag_delta', delta FROM x)
SELECT slice, metric, count(*) AS n, CASE WHEN count(*) >= 1500 THEN round(100 * avg(delta), 6) END AS delta_pp
FROM y GROUP BY slice, metric""",
)
def paired_slices(spark, sf_dir):
    answers = _answers(spark, sf_dir).where("is_validated")
    stats = P.slice_stats(answers, "core_id", SLICES)
    points = stats.groupBy(F.col("group").alias("slice"), "metric").agg(
        F.sum("den").alias("n"), (100 * F.sum("num") / F.sum("den")).alias("delta_pp")
    )
    return round_columns(P.suppress_small(points, "n", 1500, ["delta_pp"]), "delta_pp")


@query(
    "stratum_points",
    ANSWERS_SQL
    + """, p AS (SELECT population, * FROM (SELECT *, unnest(['full', CASE WHEN is_validated THEN 'validated' ELSE 'gap_fill' END]) AS population FROM u WHERE usable)),
g AS (SELECT population, unnest(['all', generator]) AS grp, gold, same, "cross", delta FROM p),
m AS (SELECT population, grp, unnest([CASE WHEN gold THEN 'recall_delta' ELSE 'fpr_delta' END, 'flag_rate_delta']) AS metric, same, "cross", delta FROM g)
SELECT population, grp, metric, count(*) AS n, round(100 * avg(same), 6) AS same_pct,
  round(100 * avg("cross"), 6) AS cross_pct, round(100 * avg(delta), 6) AS delta_pp FROM m GROUP BY population, grp, metric""",
)
def stratum_points(spark, sf_dir):
    stats = P.stratum_stats(_answers(spark, sf_dir), "core_id", populations=P.population_names())
    n = F.sum("den")
    out = stats.groupBy("population", F.col("group").alias("grp"), "metric").agg(
        n.alias("n"),
        (100 * F.sum("same_sum") / n).alias("same_pct"),
        (100 * F.sum("cross_sum") / n).alias("cross_pct"),
        (100 * F.sum("num") / n).alias("delta_pp"),
    )
    return round_columns(out, "same_pct", "cross_pct", "delta_pp")


STATS_SQL = ANSWERS_SQL + """, pop AS (SELECT DISTINCT core_id FROM v),
s AS (SELECT core_id, coalesce(sum(delta) FILTER (usable AND gold), 0) AS num,
  count(*) FILTER (usable AND gold) AS den FROM pop LEFT JOIN u USING (core_id) GROUP BY core_id)"""


def _gold_stats(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    return P.cluster_stats(answers.where("gold"), "core_id", T.verdicts(spark, sf_dir))


@query("cluster_stats", STATS_SQL + " SELECT core_id, round(num, 6) AS num, den FROM s")
def cluster_stats(spark, sf_dir):
    return round_columns(_gold_stats(spark, sf_dir), "num")


N_DRAWS, DRAW_SEED = 10_000, 20260627
SUPPLIER_SQL = ANSWERS_SQL + """, pop AS (SELECT DISTINCT l_suppkey FROM v),
s AS (SELECT l_suppkey, coalesce(sum(delta) FILTER (usable AND gold), 0) AS num,
  count(*) FILTER (usable AND gold) AS den FROM pop LEFT JOIN u USING (l_suppkey) GROUP BY l_suppkey)"""
INTERVAL_SQL = """SELECT (SELECT sum(den)::bigint FROM s) AS n, round((SELECT 100 * sum(num) / sum(den) FROM s), 6) AS point,
  round(100 * quantile_cont(rep, 0.025), 6) AS ci_low, round(100 * quantile_cont(rep, 0.975), 6) AS ci_high, count(*) AS replicates,
  quantile_cont(rep, 0.025) <= 0 AND quantile_cont(rep, 0.975) >= 0 AS covers_zero FROM r WHERE total > 0"""


def _supplier_stats(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    return checkpointed(P.cluster_stats(answers.where("gold"), "l_suppkey", T.verdicts(spark, sf_dir)))


def _interval(stats, reps):
    usable = reps.where(F.col("den") > 0).select((F.col("num") / F.col("den")).alias("rep"))
    interval = B.percentile_interval(usable, [])
    point = stats.agg(F.sum("den").alias("n"), (100 * F.sum("num") / F.sum("den")).alias("point"))
    total, value = point.select("n").scalar(), point.select("point").scalar()
    out = interval.select(
        total.alias("n"), value.alias("point"), "ci_low", "ci_high", "replicates",
        P.interval_covers_zero().alias("covers_zero"),
    )
    return round_columns(out, "point", "ci_low", "ci_high")


@query(
    "bootstrap_ci",
    SUPPLIER_SQL
    + f""", i AS (SELECT *, row_number() OVER (ORDER BY left(md5(l_suppkey::varchar), 15), l_suppkey) - 1 AS idx FROM s),
n AS (SELECT count(*) AS n FROM s),
d AS (SELECT b, ('0x' || left(md5(concat_ws(':', '{DRAW_SEED}', b, idx)), 8))::bigint % n AS hit FROM i, n, range({N_DRAWS}) r(b)),
r AS (SELECT b, sum(num) / sum(den) AS rep, sum(den) AS total FROM d JOIN i ON hit = i.idx GROUP BY b) {INTERVAL_SQL}""",
)
def bootstrap_ci(spark, sf_dir):
    """Suppliers as clusters; draws are hashes, so SQL can repeat them."""
    stats = _supplier_stats(spark, sf_dir)
    return _interval(stats, B.hashed_draws(stats, "l_suppkey", N_DRAWS, DRAW_SEED))


def _weight_sql(u: str) -> str:
    return " + ".join(f"({u} >= {bound!r}::double)::int" for bound in B._POISSON_CDF)


@query(
    "bootstrap_poisson",
    SUPPLIER_SQL
    + f""", w AS (SELECT b, num, den, ('0x' || left(md5(concat_ws(':', '{DRAW_SEED}', b, l_suppkey)), 15))::bigint / 1152921504606846976::double AS u
  FROM s, range({N_DRAWS}) r(b)),
x AS (SELECT b, num, den, {_weight_sql('u')} AS weight FROM w),
r AS (SELECT b, sum(weight * num) / sum(weight * den) AS rep, sum(weight * den) AS total FROM x GROUP BY b) {INTERVAL_SQL}""",
)
def bootstrap_poisson(spark, sf_dir):
    stats = _supplier_stats(spark, sf_dir)
    return _interval(stats, B.poisson_bootstrap(stats, [], "l_suppkey", N_DRAWS, DRAW_SEED))


# Draws over questions: SQL repeats every one of them, so there are fewer replicates than a report has.
N_REPEATED = 100
QUESTION_DRAWS_SQL = f"""i AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY left(md5(core_id::varchar), 15), core_id) - 1 AS idx, count(*) OVER (PARTITION BY population) AS size FROM c),
d AS (SELECT population, b, ('0x' || left(md5(concat_ws(':', seed, b, idx)), 8))::bigint % size AS hit, count(*) AS w FROM i, range({N_REPEATED}) r(b) GROUP BY ALL)"""


@query(
    "bootstrap_blocks_repeated",
    ANSWERS_SQL
    + f""", c AS (SELECT DISTINCT core_id, population, {DRAW_SEED} + CASE population WHEN 'full' THEN 0 WHEN 'validated' THEN 101 ELSE 202 END AS seed FROM (
  SELECT core_id, unnest(['full', CASE WHEN is_validated THEN 'validated' ELSE 'gap_fill' END]) AS population FROM v)),
{QUESTION_DRAWS_SQL},
g AS (SELECT core_id, unnest(['all', generator]) AS grp, gold, delta FROM u WHERE usable),
m AS (SELECT core_id, grp, unnest([CASE WHEN gold THEN 'recall_delta' ELSE 'fpr_delta' END, 'flag_rate_delta']) AS metric, delta FROM g),
s AS (SELECT population, idx, grp, metric, sum(delta) AS num, count(*) AS den FROM m JOIN i USING (core_id) GROUP BY ALL),
r AS (SELECT s.population, grp, metric, b, sum(w * num) / sum(w * den) AS rep FROM s JOIN d ON s.population = d.population AND s.idx = d.hit GROUP BY ALL),
q AS (SELECT population, grp, metric, sum(den)::bigint AS n, count(*) AS n_clusters, 100 * sum(num) / sum(den) AS point FROM s GROUP BY ALL),
b AS (SELECT population, grp, metric, 100 * quantile_cont(rep, 0.025) AS lo, 100 * quantile_cont(rep, 0.975) AS hi, count(*) AS replicates FROM r GROUP BY ALL)
SELECT population, grp, metric, n, n_clusters, round(point, 6) AS point, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, replicates, lo <= 0 AND hi >= 0 AS covers_zero FROM q JOIN b USING (population, grp, metric)""",
)
def bootstrap_blocks_repeated(spark, sf_dir):
    """All strata of the three populations over questions, by draws that SQL repeats one by one."""
    by, out = ["grp", "metric"], None
    with shuffles_freed(spark):
        stats = checkpointed(P.stratum_stats(_answers(spark, sf_dir), "core_id").withColumnRenamed("group", "grp"))
        clusters = checkpointed(T.verdicts(spark, sf_dir).select("core_id", "is_validated").distinct())
        blocked = B.blocked_stats(stats, by, "core_id", clusters)
        valid = F.coalesce(F.col("is_validated"), F.lit(False))
        for offset, (name, population) in enumerate({"full": clusters, "validated": clusters.where(valid), "gap_fill": clusters.where(~valid)}.items()):
            # written one after the other, so that only one population's draws are on disk
            part = checkpointed(B.hashed_strata(stats, by, "core_id", population, N_REPEATED, DRAW_SEED + 101 * offset, blocked=blocked)).withColumn("population", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return round_columns(out.withColumn("covers_zero", P.interval_covers_zero()), "point", "ci_low", "ci_high")


@query(
    "rate_ci_repeated",
    f"""WITH v AS ({T.DOC_VERDICTS}), a AS (SELECT judge, generator, behavior, core_id, count(*) FILTER (pred) AS num, count(*) AS den FROM v WHERE gold GROUP BY ALL),
g AS (SELECT *, concat_ws('|', coalesce(judge, ''), coalesce(generator, ''), coalesce(behavior, '')) AS grp FROM a),
i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY left(md5(concat_ws(':', '{DRAW_SEED}', judge, generator, behavior, core_id)), 15), core_id) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS size FROM g),
d AS (SELECT grp, b, ('0x' || left(md5(concat_ws(':', '{DRAW_SEED}', grp, b, idx)), 8))::bigint % size AS hit FROM i, range({N_REPEATED}) r(b)),
r AS (SELECT d.grp, b, sum(num) / sum(den) AS rep FROM d JOIN i ON d.grp = i.grp AND d.hit = i.idx GROUP BY ALL),
b AS (SELECT grp, 100 * quantile_cont(rep, 0.025) AS lo, 100 * quantile_cont(rep, 0.975) AS hi, count(*) AS replicates FROM r GROUP BY grp),
t AS (SELECT grp, judge, generator, behavior, sum(num)::bigint AS events, sum(den)::bigint AS n, count(*) AS clusters FROM g GROUP BY ALL)
SELECT judge, generator, behavior, events, n, clusters, round(100.0 * events / n, 6) AS point, round(CASE WHEN events = 0 THEN lo WHEN events = n THEN 100 - 300.0 / n ELSE lo END, 6) AS ci_low,
  round(CASE WHEN events = 0 THEN 300.0 / n ELSE hi END, 6) AS ci_high, replicates FROM t JOIN b USING (grp)""",
)
def rate_ci_repeated(spark, sf_dir):
    """Rates per judge, generator and behaviour with intervals over their own answers, by draws that SQL repeats."""
    rows = T.doc_verdicts(spark, sf_dir).where("gold")
    out = B.hashed_rate_interval(rows, ["judge", "generator", "behavior"], ["core_id"], "pred", N_REPEATED, DRAW_SEED)
    return round_columns(out, "point", "ci_low", "ci_high")


@query(
    "bootstrap_poisson_questions",
    STATS_SQL
    + f""", w AS (SELECT b, num, den, ('0x' || left(md5(concat_ws(':', '{DRAW_SEED}', b, core_id)), 15))::bigint / 1152921504606846976::double AS u FROM s, range({N_REPEATED}) r(b)),
x AS (SELECT b, num, den, {_weight_sql('u')} AS weight FROM w),
r AS (SELECT b, sum(weight * num) / sum(weight * den) AS rep, sum(weight * den) AS total FROM x GROUP BY b) {INTERVAL_SQL}""",
)
def bootstrap_poisson_questions(spark, sf_dir):
    stats = checkpointed(_gold_stats(spark, sf_dir))
    return _interval(stats, B.poisson_bootstrap(stats, [], "core_id", N_REPEATED, DRAW_SEED))


def _checked(out):
    """Random bounds as what SQL can vouch for: their order and their distance from the normal ones."""
    low, high, point = F.col("ci_low"), F.col("ci_high"), F.col("point")
    in_order = F.coalesce((low <= point + 1e-9) & (point <= high + 1e-9), F.lit(False))
    # beside the point, a replicate is lost only if it draws no cluster with rows, which needs a handful of them
    return out.withColumns({"in_order": in_order, "near_normal": (F.col("n_clusters") < 100) | B.near_normal()}).drop("ci_low", "ci_high", "se")


@query(
    "bootstrap_clusters",
    STATS_SQL
    + f""" SELECT 'all' AS grp, sum(den)::bigint AS n, count(*) FILTER (den > 0) AS n_clusters, round(100 * sum(num) / sum(den), 6) AS point,
  {N_DRAWS} AS replicates, true AS in_order, true AS near_normal FROM s""",
)
def bootstrap_clusters(spark, sf_dir):
    """Questions as clusters, multinomial draws; the bounds are held against the normal approximation."""
    stats = checkpointed(_gold_stats(spark, sf_dir).withColumn("grp", F.lit("all")))
    out = B.cluster_bootstrap(stats, ["grp"], "core_id", stats, N_DRAWS, DRAW_SEED)
    return round_columns(_checked(out), "point")


@query(
    "paired_slices_ci",
    ANSWERS_SQL
    + f""", s(slice, label) AS (VALUES ('all', NULL), ('follow', 'context_follow'), ('follow_both', 'context_follow'),
  ('follow_both', 'both_claims'), ('committed', 'context_follow'), ('committed', 'both_claims'), ('committed', 'memory_override')),
x AS (SELECT slice, core_id, gold, delta FROM u JOIN s ON slice = 'all' OR behavior = label WHERE usable AND is_validated),
y AS (SELECT slice, core_id, CASE WHEN gold THEN 'recall_delta' ELSE 'avoided_flag_delta' END AS metric, delta FROM x
  UNION ALL SELECT slice, core_id, 'all_flag_delta', delta FROM x)
SELECT slice, metric, count(*) AS n, count(DISTINCT core_id) AS n_clusters, round(100 * avg(delta), 6) AS point, {N_DRAWS} AS replicates,
  true AS in_order, true AS near_normal FROM y GROUP BY slice, metric""",
)
def paired_slices_ci(spark, sf_dir):
    """Overlapping slices share the draws over the questions that count as validated."""
    answers = _answers(spark, sf_dir).where("is_validated")
    stats = checkpointed(P.slice_stats(answers, "core_id", SLICES).withColumnRenamed("group", "slice"))
    out = B.cluster_bootstrap(stats, ["slice", "metric"], "core_id", stats, N_DRAWS, DRAW_SEED)
    return round_columns(_checked(out), "point")


@query("bootstrap_blocks")
def bootstrap_blocks(spark, sf_dir):
    """All strata of the full and validated populations with 10,000 shared multinomial replicates."""
    stats = checkpointed(P.stratum_stats(_answers(spark, sf_dir), "core_id"))
    clusters = checkpointed(T.verdicts(spark, sf_dir).select("core_id", "is_validated").distinct())
    valid = F.col("is_validated")
    populations = {"full": clusters, "validated": clusters.where(valid), "gap_fill": clusters.where(~valid)}
    vectors = checkpointed(B.cluster_vectors(stats, ["group", "metric"], "core_id"))
    out = None
    for offset, (name, population) in enumerate(populations.items()):
        part = B.cluster_bootstrap(
            stats,
            ["group", "metric"],
            "core_id",
            population,
            seed=DRAW_SEED + 101 * offset,
            vectors=vectors,
        ).withColumn("population", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("covers_zero", P.interval_covers_zero())


BLOCKS_SQL = """, b AS (SELECT coalesce(behavior, 'UNLABELED') AS behavior, * EXCLUDE (behavior) FROM v),
t AS (SELECT behavior, count(*) AS n_verdicts, count(DISTINCT {key}) AS n_answers,
  count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (NOT gold AND pred) AS fp,
  count(*) FILTER (gold AND NOT pred) AS fn, count(*) FILTER (NOT gold AND NOT pred) AS tn,
  count(*) FILTER (judge = generator) AS sn, count(*) FILTER (judge = generator AND pred) AS sf,
  count(*) FILTER (judge <> generator) AS cn, count(*) FILTER (judge <> generator AND pred) AS cf FROM b GROUP BY behavior)
SELECT behavior, n_verdicts, n_answers, round(1e2 * (tp + fn) / n_verdicts, 6) AS gold_pos_pct,
  round(1e2 * (tp + fp) / n_verdicts, 6) AS flag_pct, tp, fp, fn, tn,
  CASE WHEN 2 * (tp + fn) >= n_verdicts THEN 'recall' ELSE 'fpr' END AS headline_metric,
  round(CASE WHEN 2 * (tp + fn) >= n_verdicts THEN CASE WHEN tp + fn > 0 THEN 1e2 * tp / (tp + fn) END
    ELSE CASE WHEN fp + tn > 0 THEN 1e2 * fp / (fp + tn) END END, 6) AS headline,
  CASE WHEN sn > 0 THEN round(1e2 * sf / sn, 6) END AS same_flag_pct, CASE WHEN cn > 0 THEN round(1e2 * cf / cn, 6) END AS cross_flag_pct FROM t"""
_BLOCK_COLUMNS = ("gold_pos_pct", "flag_pct", "headline", "same_flag_pct", "cross_flag_pct")


@query(
    "behavior_blocks",
    f"WITH v AS ({T.VERDICTS})"
    + BLOCKS_SQL.format(key="(core_id, generator, l_linenumber, l_partkey, l_suppkey)"),
)
def blocks(spark, sf_dir):
    return round_columns(behavior_blocks(T.verdicts(spark, sf_dir), T.ANSWER_KEYS), *_BLOCK_COLUMNS)


@query("behavior_blocks_documents", f"WITH v AS ({T.DOC_VERDICTS})" + BLOCKS_SQL.format(key="(core_id, generator)"))
def blocks_documents(spark, sf_dir):
    return round_columns(behavior_blocks(T.doc_verdicts(spark, sf_dir), ["core_id", "generator"]), *_BLOCK_COLUMNS)


@query("behavior_headline_ci")
def headline_ci(spark, sf_dir):
    return headline_intervals(T.verdicts(spark, sf_dir), T.ANSWER_KEYS)


@query(
    "rate_ci_rule_of_three",
    f"""WITH v AS ({T.DOC_VERDICTS}), r AS (SELECT judge, generator, lang, pred, core_id FROM (SELECT *, behavior AS lang FROM v) WHERE gold),
t AS (SELECT judge, generator, lang, count(*) AS n, count(*) FILTER (pred) AS events, count(DISTINCT core_id) AS clusters FROM r GROUP BY ALL)
SELECT judge, generator, lang, n, events, clusters, true AS in_order, round(1e2 * events / n, 6) AS point,
  CASE WHEN events = n AND events > 0 THEN round(1e2 - 3e2 / n, 6) END AS all_event_low,
  CASE WHEN events = 0 THEN round(3e2 / n, 6) END AS no_event_high FROM t""",
)
def rate_ci(spark, sf_dir):
    """Bounds of collapsed intervals exactly; of the resampled ones, that they stand around the point."""
    rows = T.doc_verdicts(spark, sf_dir).withColumnRenamed("behavior", "lang").where("gold")
    out = B.rate_interval(rows, ["judge", "generator", "lang"], ["core_id"], "pred")
    none, every = F.col("events") == 0, F.col("events") == F.col("n")
    around = (F.col("ci_low") <= F.col("point") + 1e-9) & (F.col("point") <= F.col("ci_high") + 1e-9)
    return out.select(
        "judge", "generator", "lang", "n", "events", "clusters", around.alias("in_order"), rounded("point").alias("point"),
        F.when(every & ~none, rounded("ci_low")).alias("all_event_low"),
        F.when(none, rounded("ci_high")).alias("no_event_high"),
    )


PROVIDERS = ["azure-gpt", "grok", "other-a", "other-b"]


@query(
    "pair_type_counts",
    """WITH p AS (SELECT ['azure-gpt', 'grok', 'other-a', 'other-b'] AS names),
v AS (SELECT names[(l_suppkey % 4 + 1)::int] AS jp, 'm' || (l_partkey % 2) AS jm, names[(l_orderkey % 4 + 1)::int] AS gp, 'm' || (l_linenumber % 2) AS gm FROM lineitem, p),
f AS (SELECT *, CASE jp WHEN 'azure-gpt' THEN 1 WHEN 'grok' THEN 2 ELSE 0 END AS jf, CASE gp WHEN 'azure-gpt' THEN 1 WHEN 'grok' THEN 2 ELSE 0 END AS gf FROM v)
SELECT CASE WHEN jp = gp AND jm = gm THEN 'same_exact_model' WHEN jf = gf THEN 'same_provider_family' ELSE 'cross_provider_family' END AS pair_type,
  count(*) AS n FROM f GROUP BY 1""",
)
def pair_type_counts(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    rows = li.select(
        T.pick(F.col("l_suppkey") % 4, PROVIDERS).alias("jp"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 2).cast("string")).alias("jm"),
        T.pick(F.col("l_orderkey") % 4, PROVIDERS).alias("gp"),
        F.concat(F.lit("m"), (F.col("l_linenumber") % 2).cast("string")).alias("gm"),
    )
    return rows.groupBy(pair_type("jp", "jm", "gp", "gm").alias("pair_type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "expectations",
    f"""WITH v AS ({T.VERDICTS}), o AS (SELECT count(*)::varchar AS verdicts, count(DISTINCT judge)::varchar AS judges,
  (count(*) FILTER (gold AND pred) + count(*) FILTER (NOT gold AND pred) + count(*) FILTER (gold AND NOT pred)
   + count(*) FILTER (NOT gold AND NOT pred) = count(*))::varchar AS reconciles, count(*) FILTER (core_id IS NULL)::varchar AS missing FROM v)
SELECT 'verdicts' AS "check", verdicts AS observed, (SELECT 3 * count(*) FROM lineitem)::varchar AS expected, verdicts = (SELECT 3 * count(*) FROM lineitem)::varchar AS ok FROM o
UNION ALL SELECT 'judges', judges, '3', judges = '3' FROM o
UNION ALL SELECT 'cells_reconcile', reconciles, 'true', reconciles = 'true' FROM o
UNION ALL SELECT 'missing_ids', missing, '0', missing = '0' FROM o""",
)
def expectations(spark, sf_dir):
    cell = {k: F.count_if(c) for k, c in {
        "tp": F.col("gold") & F.col("pred"), "fp": ~F.col("gold") & F.col("pred"),
        "fn": F.col("gold") & ~F.col("pred"), "tn": ~F.col("gold") & ~F.col("pred")}.items()}
    return expect(
        T.verdicts(spark, sf_dir),
        {
            "verdicts": (F.count(F.lit(1)), 3 * T.table(spark, sf_dir, "lineitem").count()),  # one for each judge
            "judges": (F.count_distinct("judge"), 3),
            "cells_reconcile": (cell["tp"] + cell["fp"] + cell["fn"] + cell["tn"] == F.count(F.lit(1)), "true"),
            "missing_ids": (F.count_if(F.col("core_id").isNull()), 0),
        },
    )
