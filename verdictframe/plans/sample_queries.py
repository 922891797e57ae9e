"""Seeded samples, combined orders, slices, joins over runs, review queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.operators import assignment as A
from verdictframe.operators import history as H
from verdictframe.operators import review as R
from verdictframe.operators import sampling as SM
from verdictframe.operators.ranking import dense_index, latest, rank_by_value
from verdictframe.plans import tables as T
from verdictframe.plans.registry import query, round_columns

SEED = 17
DOC_ORDER = "md5('17:' || doc_id)"


@query(
    "stratified_sample",
    f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {DOC_ORDER}, doc_id) AS rn FROM documents)
SELECT doc_id, lang, source FROM r ORDER BY rn, md5('17:' || lang || ':' || source), doc_id LIMIT 300""",
)
def stratified_sample(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return SM.stratified_sample(docs, ["lang", "source"], 300, SEED, "doc_id")


@query(
    "stratified_sample_large",
    """WITH r AS (SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS o_orderstatus, row_number() OVER (PARTITION BY coalesce(nullif(o_orderstatus, 'P'), 'unknown')
  ORDER BY md5('17:' || o_orderkey), o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_orderstatus FROM r ORDER BY rn, md5('17:' || o_orderstatus), o_orderkey LIMIT 7000""",
)
def stratified_sample_large(spark, sf_dir):
    """A draw too large for a top-k: stratum sizes give the quotas, bucket offsets the ranks."""
    orders = T.table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    return SM.stratified_sample(orders, ["o_orderstatus"], 7000, SEED, "o_orderkey")


@query(
    "prefer_backfill",
    """WITH r AS (SELECT doc_id, lang, pool, row_number() OVER (PARTITION BY pool, lang ORDER BY md5((17 + pool) || ':' || doc_id), doc_id) AS rn
  FROM (SELECT *, CASE WHEN n_chars > 2500 THEN 0 ELSE 1 END AS pool FROM documents))
SELECT doc_id, lang, pool AS _pool FROM r ORDER BY pool, rn, md5((17 + pool) || ':' || lang), doc_id LIMIT 400""",
)
def prefer_backfill(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return SM.prefer_then_backfill(docs, F.col("n_chars") > 2500, ["lang"], 400, SEED, "doc_id").select("doc_id", "lang", "_pool")


@query(
    "prefer_backfill_large",
    """WITH r AS (SELECT o_orderkey, o_orderpriority, pool, row_number() OVER (PARTITION BY pool, o_orderpriority ORDER BY md5((17 + pool) || ':' || o_orderkey), o_orderkey) AS rn
  FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS pool FROM orders))
SELECT o_orderkey, o_orderpriority, pool AS _pool FROM r ORDER BY pool, rn, md5((17 + pool) || ':' || o_orderpriority), o_orderkey LIMIT 9001""",
)
def prefer_backfill_large(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    out = SM.prefer_then_backfill(orders, F.col("o_orderstatus") == "F", ["o_orderpriority"], 9001, SEED, "o_orderkey")
    return out.select("o_orderkey", "o_orderpriority", "_pool")


def _sources(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("src"))


ORDERED_SQL = """WITH r AS (SELECT o_orderkey, o_custkey % 3 AS src, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) AS idx FROM orders)
SELECT o_orderkey, src, idx::bigint AS ord1, src AS ord2 FROM r"""


@query("combine_round_robin", ORDERED_SQL)
def combine_round_robin(spark, sf_dir):
    return SM.combine_sources(_sources(spark, sf_dir), "src", "o_orderkey")


@query("combine_sequential", "SELECT o_orderkey, o_custkey % 3 AS src, o_custkey % 3 AS ord1, o_orderkey AS ord2 FROM orders")
def combine_sequential(spark, sf_dir):
    return SM.combine_sources(_sources(spark, sf_dir), "src", "o_orderkey", "sequential")


@query(
    "combine_shuffle",
    """SELECT o_orderkey, o_custkey % 3 AS src, ('0x' || left(md5('17:' || (o_custkey % 3) || ':' || o_orderkey), 15))::bigint AS ord1, 0::bigint AS ord2 FROM orders""",
)
def combine_shuffle(spark, sf_dir):
    return SM.combine_sources(_sources(spark, sf_dir), "src", "o_orderkey", "shuffle", SEED)


@query(
    "capped_sample",
    f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {DOC_ORDER}, doc_id) AS rn,
  count(*) OVER (PARTITION BY lang, source) AS population FROM documents)
SELECT doc_id, lang, source, population FROM r WHERE rn <= 12""",
)
def capped_sample(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return SM.capped_sample(docs, ["lang", "source"], 12, SEED, "doc_id")


@query(
    "matched_sample",
    """WITH q AS (SELECT lang, count(*) AS quota FROM documents WHERE source = 'src1' GROUP BY lang),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('17:' || doc_id), doc_id) AS rn FROM documents WHERE source <> 'src1' AND n_chars > 500)
SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE rn <= quota""",
)
def matched_sample(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    reference = F.col("source") == "src1"
    return SM.matched_sample(docs, "lang", reference, ~reference & (F.col("n_chars") > 500), SEED, "doc_id").select("doc_id", "lang")


@query(
    "balanced_sample",
    f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {DOC_ORDER}, doc_id) AS rn FROM documents) SELECT doc_id, source FROM r WHERE rn <= 10",
)
def balanced_sample(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "source")
    return SM.balanced_sample(docs, "source", 10, SEED, "doc_id")


@query(
    "cell_spread_sample",
    f"""WITH v AS (SELECT core_id, judge, generator, judge || generator || core_id AS case_id FROM ({T.DOC_VERDICTS}) WHERE gold AND pred),
r AS (SELECT *, row_number() OVER (PARTITION BY judge, generator ORDER BY md5('17:' || case_id), case_id) AS rn FROM v)
SELECT case_id, judge, generator FROM r ORDER BY rn, md5('17:' || judge || ':' || generator), case_id LIMIT 15""",
)
def cell_spread_sample(spark, sf_dir):
    v = T.doc_verdicts(spark, sf_dir).where("gold AND pred")
    v = v.select(F.concat("judge", "generator", F.col("core_id").cast("string")).alias("case_id"), "judge", "generator")
    return SM.stratified_sample(v, ["judge", "generator"], 15, SEED, "case_id")


@query(
    "first_selected",
    """WITH p AS (SELECT doc_id, 'long' AS subset, 1 AS turn FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, 'english', 2 FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 'labelled', 3 FROM labels) SELECT doc_id, arg_min(subset, turn) AS subset, min(turn) AS turn FROM p GROUP BY doc_id""",
)
def first_selected(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    picks = H.tagged_union(
        {
            ("long", 1): docs.where("n_chars > 3000").select("doc_id"),
            ("english", 2): docs.where("lang = 'en'").select("doc_id"),
            ("labelled", 3): T.table(spark, sf_dir, "labels").select("doc_id"),
        },
        ["subset", "turn"],
    )
    return SM.first_selected(picks, "doc_id", "subset", "turn")


@query("slice_offset_take", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 4000 OFFSET 5000")
def slice_offset_take(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return SM.slice_rows(orders, "o_orderkey", 5000, 4000)


@query("head_copy", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def head_copy(spark, sf_dir):
    return SM.slice_rows(T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 0, 100)


@query("slice_rest", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 9000")
def slice_rest(spark, sf_dir):
    return SM.slice_rows(T.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 9000)


@query("rank_by_skewed_value", """SELECT l_returnflag, count(*) AS n, sum(r)::bigint AS ranks, round(sum(r * l_quantity), 3) AS weighted FROM
  (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, left(md5(':' || concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::bigint)), 15)) AS r FROM lineitem) GROUP BY l_returnflag""")
def rank_by_skewed_value(spark, sf_dir):
    """Exact ranks in three huge groups of few distinct values, split by quantile and tie hash."""
    li = T.table(spark, sf_dir, "lineitem").withColumn("cents", F.floor(F.col("l_extendedprice")).cast("bigint"))
    ranked = rank_by_value(li, ["l_returnflag"], "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"], "r")
    return ranked.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("r").alias("ranks"), F.round(F.sum(F.col("r") * F.col("l_quantity")), 3).alias("weighted")
    )


@query("dense_index", "SELECT o_orderkey, row_number() OVER (ORDER BY left(md5(o_orderkey::varchar), 15), o_orderkey) - 1 AS idx FROM orders")
def dense(spark, sf_dir):
    return dense_index(T.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


# ---- joins and sets over runs -------------------------------------------------------------------


@query(
    "latest_wins",
    "SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id",
)
def latest_wins(spark, sf_dir):
    return latest(T.table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "role", "turn", F.md5("text").alias("digest"))


@query(
    "merged_records",
    """WITH s AS (SELECT o_orderkey AS core_id, 'filter' AS step, 0 AS o FROM orders UNION ALL SELECT o_orderkey, 'perturb', 1 FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'judge', 5 FROM orders WHERE o_orderkey % 6 = 0) SELECT core_id, arg_max(step, o) AS step FROM s GROUP BY core_id""",
)
def merged_records(spark, sf_dir):
    keys = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("core_id"))
    steps = H.tagged_union(
        {("filter",): keys, ("perturb",): keys.where("core_id % 2 = 0"), ("judge",): keys.where("core_id % 6 = 0")}, ["step"]
    )
    return H.merged_records(steps)


@query(
    "resume_anti",
    """SELECT o_orderkey AS core_id, o_custkey AS payload, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) THEN 'kept' ELSE 'new' END AS state FROM orders""",
)
def resume_anti(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("core_id"), F.col("o_custkey").alias("payload"))
    heavy = T.table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("core_id"))
    done = H.restrict(orders, heavy).withColumn("state", F.lit("kept"))
    return H.resume(orders, done, lambda df: df.withColumn("state", F.lit("new")))


@query(
    "tagged_union",
    "SELECT run, role, count(*) AS n FROM (SELECT 'a' AS run, role FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT 'b', role FROM conversations WHERE turn > 0) GROUP BY run, role",
)
def tagged_union(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    union = H.tagged_union({("a",): c.where("conv_id % 2 = 0"), ("b",): c.where("turn > 0")}, ["run"])
    return union.groupBy("run", "role").agg(F.count(F.lit(1)).alias("n"))


def candidates(spark, sf_dir):
    """Every document by up to three providers, validated by rule."""
    docs = T.table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(p) for p in T.JUDGES])
    rows = docs.select("doc_id", "n_chars", "lang", F.explode(names).alias("provider"))
    digit = F.substring("provider", 2, 1).cast("bigint")
    return rows.select(
        F.col("doc_id").alias("core_id"),
        "provider",
        F.concat(F.lit("t"), ((F.col("doc_id") + digit) % 5).cast("string")).alias("kind"),
        ((F.col("n_chars") + digit * 7) % (digit + 2) == 0).alias("is_validated"),
        F.col("doc_id").alias("seq"),
    )


CANDIDATES_SQL = """SELECT doc_id AS core_id, 'g' || j AS provider, 't' || ((doc_id + j) % 5) AS kind, (n_chars + j * 7) % (j + 2) = 0 AS is_validated FROM documents, range(3) r(j)"""


@query(
    "validators_of",
    f"SELECT core_id, coalesce(string_agg(provider, ',' ORDER BY provider) FILTER (is_validated), '') AS validators FROM ({CANDIDATES_SQL}) GROUP BY core_id",
)
def validators_of(spark, sf_dir):
    out = H.validators_of(candidates(spark, sf_dir))
    return out.select("core_id", F.array_join("validators", ",").alias("validators"))


@query(
    "set_difference",
    """SELECT 'excluded' AS kind, count(*) AS n, sum(doc_id)::bigint AS ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'diagnostic', count(*), sum(doc_id)::bigint FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def set_difference(spark, sf_dir):
    docs, labels = T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "labels")
    sides = H.tagged_union(
        {
            ("excluded",): H.excluded(docs, labels, "doc_id"),
            ("diagnostic",): H.diagnostic(labels, labels.where("quality = 1"), "doc_id").select("doc_id"),
        },
        ["kind"],
    )
    return sides.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "attach_labels",
    f"""WITH l AS (SELECT core_id, generator, s, max(behavior) AS behavior_label FROM (SELECT *, nullif(l_linenumber % 4, 0) AS s FROM ({T.VERDICTS})) WHERE l_partkey % 3 <> 0 GROUP BY ALL),
v AS (SELECT *, nullif(l_linenumber % 4, 0) AS s FROM ({T.VERDICTS}))
SELECT coalesce(l.behavior_label, 'UNLABELED') AS behavior_label, count(*) AS n FROM v LEFT JOIN l
  ON v.core_id = l.core_id AND v.generator = l.generator AND v.s IS NOT DISTINCT FROM l.s GROUP BY 1""",
)
def attach_labels(spark, sf_dir):
    """Labels by (question, generator, sample), where a missing sample id matches a missing one."""
    keys = ["core_id", "generator", "sample_id"]
    v = T.verdicts(spark, sf_dir).withColumn("sample_id", F.nullif(F.col("l_linenumber") % 4, F.lit(0)))
    labels = v.where("l_partkey % 3 <> 0").groupBy(*keys).agg(F.max("behavior").alias("behavior_label"))
    out = H.attach_labels(v.drop("behavior"), labels, keys)
    return out.groupBy(F.coalesce("behavior_label", F.lit("UNLABELED")).alias("behavior_label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "restrict_validated",
    f"""WITH ids AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), v AS ({T.VERDICTS})
SELECT judge, count(*) AS n, count(*) FILTER (core_id IN (SELECT o_orderkey FROM ids)) AS member,
  count(*) FILTER (gold AND core_id IN (SELECT o_orderkey FROM ids)) AS gold_member FROM v GROUP BY judge""",
)
def restrict_validated(spark, sf_dir):
    ids = T.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("core_id"))
    v = T.verdicts(spark, sf_dir)
    flagged = H.flag_membership(v, ids, "core_id", "member").groupBy("judge").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("member").alias("member")
    )
    kept = H.restrict(v, ids).groupBy("judge").agg(F.count_if("gold").alias("gold_member"))
    return flagged.join(kept, "judge")


@query(
    "attach_core",
    f"""WITH o AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P')
SELECT judge, coalesce(o_orderpriority, 'unknown') AS o_orderpriority, count(*) AS n, count(*) FILTER (pred) AS flagged
FROM ({T.VERDICTS}) v LEFT JOIN o ON core_id = o_orderkey GROUP BY ALL""",
)
def attach_core(spark, sf_dir):
    core = T.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "core_id")
    out = H.attach_core(T.verdicts(spark, sf_dir), core, ["o_orderpriority"])
    return out.groupBy("judge", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if("pred").alias("flagged"))


@query(
    "attach_answer",
    """WITH v AS (SELECT conv_id, turn, j FROM conversations, range(3) r(j) WHERE role = 'assistant' AND (conv_id + j) % 4 <> 0)
SELECT j::int AS judge, count(*) AS n, sum(length(text))::bigint AS chars FROM v JOIN conversations USING (conv_id, turn) GROUP BY j""",
)
def attach_answer(spark, sf_dir):
    turns = T.table(spark, sf_dir, "conversations")
    judged = turns.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("judge"))
    out = H.attach(judged.where("(conv_id + judge) % 4 <> 0"), turns, ["conv_id", "turn"], ["text"])
    return out.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "gap_fill",
    """WITH pool AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id FROM pool ORDER BY doc_id LIMIT greatest(0, 500 - (SELECT count(*) FROM labels))""",
)
def gap_fill(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select("doc_id")
    return A.gap_fill(T.table(spark, sf_dir, "labels"), docs, 500, "doc_id", "doc_id")


@query("balanced_assignment")
def balanced_assignment(spark, sf_dir):
    """One validated record per question, providers level, about a third of all questions."""
    rows = candidates(spark, sf_dir)
    target = T.table(spark, sf_dir, "documents").count() // 3
    return A.assign_balanced(rows, target)


@query(
    "balanced_assignment_totals",
    f"""WITH v AS (SELECT * FROM ({CANDIDATES_SQL}) WHERE is_validated), d AS (SELECT count(DISTINCT core_id) AS questions FROM v)
SELECT least(d.questions, (SELECT count(*) FROM documents) // 3) AS chosen, 0::bigint AS repeated FROM d""",
)
def balanced_assignment_totals(spark, sf_dir):
    chosen = balanced_assignment(spark, sf_dir)
    per = chosen.groupBy("core_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("chosen"), F.count_if(F.col("n") > 1).alias("repeated"))


@query(
    "balanced_assignment_targets",
    f"""WITH v AS (SELECT DISTINCT core_id, provider FROM ({CANDIDATES_SQL}) WHERE is_validated), t AS (SELECT count(*) // 3 AS target FROM documents),
c AS (SELECT provider, count(*) AS capacity FROM v GROUP BY provider), b AS (SELECT provider, capacity, least(capacity, target // (SELECT count(*) FROM c)) AS base FROM c, t),
h AS (SELECT provider, base, capacity - base AS room FROM b), s AS (SELECT (SELECT target FROM t) - sum(base) AS slack, max(room) AS top FROM h),
l AS (SELECT min(level) AS level FROM (SELECT level, (SELECT sum(greatest(0, room - level)) FROM h) AS gone FROM (SELECT unnest(range(0, top + 1)) AS level FROM s)) WHERE gone <= (SELECT slack FROM s)),
g AS (SELECT provider, base + greatest(0, room - level) AS even, room >= level AND level > 0 AS more, row_number() OVER (PARTITION BY room >= level AND level > 0 ORDER BY provider) AS r,
  (SELECT slack FROM s) - sum(greatest(0, room - level)) OVER () AS rest FROM h, l)
SELECT provider, (even + CASE WHEN more AND r <= rest THEN 1 ELSE 0 END)::bigint AS target, (even + CASE WHEN more AND r <= rest THEN 1 ELSE 0 END)::bigint AS n, 5::bigint AS kinds, true AS spread FROM g""",
)
def balanced_assignment_targets(spark, sf_dir):
    """Chosen records of each provider against its target, their change types and whether these are spread."""
    rows = candidates(spark, sf_dir)
    valid = rows.where("is_validated")
    capacity = {r["provider"]: r["n"] for r in valid.groupBy("provider").agg(F.count_distinct("core_id").alias("n")).orderBy("provider").collect()}
    targets = A.capacity_targets(capacity, T.table(spark, sf_dir, "documents").count() // 3)
    wanted = spark.createDataFrame(list(targets.items()), "provider string, target bigint")
    chosen = balanced_assignment(spark, sf_dir).groupBy("provider", "kind").agg(F.count(F.lit(1)).alias("k"))
    per = chosen.groupBy("provider").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("k").alias("least"))
    spread = F.col("least") >= F.least(F.greatest(F.lit(1), F.floor(F.col("target") / 10)), F.floor(F.col("target") / 10))
    return wanted.join(per, "provider", "left").select("provider", "target", "n", "kinds", spread.alias("spread"))


# ---- review ---------------------------------------------------------------------------------


def review_case_rows(spark, sf_dir):
    from verdictframe.functions.scalars import confusion_cell

    v = T.doc_verdicts(spark, sf_dir)
    return v.select(
        R.case_id("judge", "generator", "core_id").alias("case_id"), "core_id", "judge", "generator", "behavior",
        confusion_cell("gold", "pred").alias("cell"), R.category("gold", "pred").alias("category"), "is_validated",
        (F.col("judge") == F.col("generator")).alias("same_deployment"), F.col("text").alias("question"),
        *_labels(),
    )


def _labels():
    answers = ["yes", "no", "unclear", ""]
    i, j = F.col("core_id"), F.substring("judge", 2, 1).cast("bigint")
    return (
        T.pick((i + j) % 5, answers).alias("human_gold_ok"),
        T.pick((F.floor(i / 2) + j) % 4, answers).alias("human_judge_ok"),
        T.pick(i % 3, ["yes", "no"]).alias("human_judge_detected_target"),
        T.pick((i + j) % 4, ["yes", "no"]).alias("human_alternate_valid_error"),
        T.pick(i % 7, ["yes"]).alias("human_artifact"),
        T.pick((i + j) % 3, ["yes", "no"]).alias("human_false_alarm"),
    )


CASES_SQL = f"""SELECT judge || '-on-' || generator || '__' || core_id AS case_id, core_id, judge, generator, behavior, is_validated, judge = generator AS same_deployment, text AS question,
  CASE WHEN gold AND pred THEN 'TP' WHEN gold THEN 'FN' WHEN pred THEN 'FP' ELSE 'TN' END AS cell,
  CASE WHEN gold AND pred THEN 'true_positive' WHEN gold THEN 'false_negative' WHEN pred THEN 'apparent_fp' ELSE 'true_negative' END AS category,
  ['yes', 'no', 'unclear', ''][((core_id + j) % 5 + 1)::int] AS human_gold_ok, ['yes', 'no', 'unclear', ''][((core_id // 2 + j) % 4 + 1)::int] AS human_judge_ok,
  ['yes', 'no'][(core_id % 3 + 1)::int] AS detected, ['yes', 'no'][((core_id + j) % 4 + 1)::int] AS alternate, ['yes'][(core_id % 7 + 1)::int] AS artifact, ['yes', 'no'][((core_id + j) % 3 + 1)::int] AS false_alarm
FROM (SELECT *, substr(judge, 2, 1)::bigint AS j FROM ({T.DOC_VERDICTS}))"""
DONE_SQL = "coalesce(human_gold_ok, '') <> '' AND coalesce(human_judge_ok, '') <> ''"


@query(
    "review_summary",
    f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY behavior, cell) AS population,
  row_number() OVER (PARTITION BY behavior, cell ORDER BY md5('17:' || case_id), case_id) AS rn FROM ({CASES_SQL})),
s AS (SELECT *, {DONE_SQL} AS done FROM c WHERE rn <= 12)
SELECT behavior, cell, count(*) AS sampled, max(population) AS population, count(*) FILTER (done) AS reviewed,
  count(*) FILTER (done AND human_gold_ok = 'yes') AS gold_yes, count(*) FILTER (done AND human_gold_ok = 'no') AS gold_no, count(*) FILTER (done AND human_gold_ok = 'unclear') AS gold_unclear,
  count(*) FILTER (done AND human_judge_ok = 'yes') AS judge_yes, count(*) FILTER (done AND human_judge_ok = 'no') AS judge_no, count(*) FILTER (done AND human_judge_ok = 'unclear') AS judge_unclear,
  count(*) FILTER (done AND human_gold_ok = 'yes' AND human_judge_ok = 'yes') AS cell_valid FROM s GROUP BY behavior, cell""",
)
def review_summary(spark, sf_dir):
    sampled = SM.capped_sample(review_case_rows(spark, sf_dir), ["behavior", "cell"], 12, SEED, "case_id")
    return R.review_summary(sampled)


@query(
    "flag_audit",
    f"""SELECT CASE WHEN category = 'apparent_fp' AND same_deployment THEN 'same_fp' WHEN category = 'apparent_fp' THEN 'cross_fp' ELSE category END AS audit_group,
  count(*) AS n, count(*) FILTER (done) AS reviewed, count(*) FILTER (done AND b = 'target') AS target, count(*) FILTER (done AND b = 'alternate') AS alternate,
  count(*) FILTER (done AND b = 'artifact') AS artifact, count(*) FILTER (done AND b = 'false_alarm') AS false_alarm, count(*) FILTER (done AND b = 'unclear') AS unclear
FROM (SELECT category, same_deployment, coalesce(false_alarm, '') <> '' AS done, CASE WHEN detected = 'yes' THEN 'target' WHEN alternate = 'yes' THEN 'alternate'
  WHEN artifact = 'yes' THEN 'artifact' WHEN false_alarm = 'yes' THEN 'false_alarm' ELSE 'unclear' END AS b FROM ({CASES_SQL})) GROUP BY 1""",
)
def flag_audit(spark, sf_dir):
    cases = review_case_rows(spark, sf_dir)
    return R.flag_audit(cases, R.audit_group(), R.is_done("human_false_alarm"), R.classify_flag())


@query(
    "audit_decision",
    f"""WITH f AS (SELECT CASE WHEN same_deployment THEN 's' ELSE 'c' END AS g, coalesce(false_alarm, '') <> '' AS done, CASE WHEN detected = 'yes' THEN 'target' WHEN alternate = 'yes' THEN 'alternate'
  WHEN artifact = 'yes' THEN 'artifact' WHEN false_alarm = 'yes' THEN 'false_alarm' ELSE 'unclear' END AS b FROM ({CASES_SQL}) WHERE category = 'apparent_fp'),
t AS (SELECT count(*) FILTER (g = 's') AS sn, count(*) FILTER (g = 'c') AS cn, count(*) FILTER (g = 's' AND done) AS sr, count(*) FILTER (g = 'c' AND done) AS cr,
  count(*) FILTER (g = 's' AND done AND b = 'alternate') AS sa, count(*) FILTER (g = 'c' AND done AND b = 'alternate') AS ca,
  count(*) FILTER (g = 's' AND done AND b = 'false_alarm') AS sf, count(*) FILTER (g = 'c' AND done AND b = 'false_alarm') AS cf FROM f)
SELECT round(sa / sr, 6) AS alternate_same, round(ca / cr, 6) AS alternate_cross, round(sf / sr, 6) AS false_alarm_same, round(cf / cr, 6) AS false_alarm_cross,
  CASE WHEN sr < greatest(5, sn // 2) OR cr < greatest(5, cn // 2) THEN 'pending' WHEN sa / sr < 0.25 AND ca / cr < 0.25 THEN 'A' WHEN ca / cr - sa / sr > 0.15 THEN 'C' ELSE 'B' END AS decision FROM t""",
)
def audit_decision(spark, sf_dir):
    out = R.decide(flag_audit(spark, sf_dir))
    return round_columns(out, *[c for c in out.columns if c != "decision"])


@query(
    "audit_tallies",
    f"""WITH d AS (SELECT cell, same_deployment, human_gold_ok AS g, human_judge_ok AS j FROM ({CASES_SQL}) WHERE {DONE_SQL}),
f AS (SELECT *, CASE cell
  WHEN 'TP' THEN CASE WHEN g = 'yes' AND j = 'yes' THEN 'genuine TP' WHEN g = 'no' THEN 'gold mislabel (answer did not adopt)' WHEN j = 'no' THEN 'right verdict, wrong reason' ELSE 'unclear' END
  WHEN 'FP' THEN CASE WHEN g = 'no' THEN 'gold mislabel (answer DID adopt -> really TP)' WHEN g = 'yes' AND j = 'no' THEN 'genuine false alarm' WHEN g = 'yes' AND j = 'yes' THEN 'judge caught a real / alternate error' ELSE 'unclear' END
  WHEN 'FN' THEN CASE WHEN g = 'no' THEN 'gold too aggressive (answer did not adopt)' WHEN g = 'yes' AND j = 'no' THEN 'genuine miss' WHEN g = 'yes' AND j = 'yes' THEN 'INCONSISTENT (gold+ but judge right to be silent)' ELSE 'unclear' END
  ELSE CASE WHEN g = 'yes' AND j = 'yes' THEN 'genuine TN' WHEN j = 'no' THEN 'judge MISSED a real error' WHEN g = 'no' THEN 'gold mislabel (answer DID adopt)' ELSE 'unclear' END END AS finding FROM d)
SELECT cell, finding, CASE WHEN same_deployment THEN 'same' ELSE 'cross' END AS arm, count(*) AS n, count(*) FILTER (g <> 'yes') AS gold_issues FROM f GROUP BY ALL""",
)
def audit_tallies(spark, sf_dir):
    return R.audit_tallies(review_case_rows(spark, sf_dir))


@query(
    "review_join",
    f"""WITH c AS (SELECT case_id, core_id, human_gold_ok FROM ({CASES_SQL})), l AS (SELECT case_id, human_gold_ok AS g FROM c WHERE core_id % 4 <> 0)
SELECT case_id, coalesce(g, '') AS human_gold_ok, core_id % 4 <> 0 AND coalesce(g, '') <> '' AS reviewed FROM c LEFT JOIN l USING (case_id)""",
)
def review_join(spark, sf_dir):
    """A rebuilt queue takes over the labels of the previous one; new cases read ''."""
    cases = review_case_rows(spark, sf_dir).select("case_id", "core_id", "human_gold_ok")
    previous = cases.where("core_id % 4 <> 0").select("case_id", "human_gold_ok")
    out = R.carry_labels(cases, previous, ["human_gold_ok"])
    return out.select("case_id", "human_gold_ok", R.is_done("human_gold_ok").alias("reviewed"))


QUEUE_SQL = f"""WITH c AS ({CASES_SQL}), v AS (SELECT * FROM c WHERE is_validated),
e AS (SELECT 'g' || (item_id % 3) || '_on_g' || (item_id % 2) AS cell, {T.norm_sql('text')} AS wq FROM benchmark),
x AS (SELECT DISTINCT case_id FROM (SELECT case_id, judge || '_on_' || generator AS cell, {T.norm_sql('question')} AS cq FROM c) JOIN e USING (cell)
  WHERE starts_with(cq, wq) OR starts_with(wq, cq)),
f AS (SELECT case_id, generator FROM v WHERE category = 'apparent_fp' AND same_deployment),
q AS (SELECT generator, count(*) AS quota FROM f GROUP BY generator),
r AS (SELECT case_id, generator, row_number() OVER (PARTITION BY generator ORDER BY md5('17:' || case_id)) AS rn FROM v WHERE category = 'apparent_fp' AND NOT same_deployment),
m AS (SELECT case_id, row_number() OVER (PARTITION BY generator ORDER BY md5('17:' || case_id)) AS rn FROM v WHERE category = 'false_negative'),
s AS (SELECT *, row_number() OVER (PARTITION BY category, judge, generator ORDER BY md5('17:' || case_id)) AS rn FROM v WHERE category IN ('true_positive', 'true_negative')),
z AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rn, md5('17:' || judge || ':' || generator), case_id) AS place FROM s),
p AS (SELECT case_id, 'same_fp' AS subset, 1 AS priority, 1 AS turn FROM f
  UNION ALL SELECT case_id, 'cross_fp', 2, 2 FROM r JOIN q USING (generator) WHERE rn <= quota
  UNION ALL SELECT case_id, 'false_negative', 4, 3 FROM m WHERE rn <= 10
  UNION ALL SELECT case_id, CASE category WHEN 'true_positive' THEN 'sanity_tp' ELSE 'sanity_tn' END, 5, CASE category WHEN 'true_positive' THEN 4 ELSE 5 END FROM z WHERE place <= 15
  UNION ALL SELECT case_id, 'paper_example', 3, 6 FROM x)
SELECT case_id, arg_min(subset, turn) AS subset, arg_min(priority, turn) AS priority, bool_or(subset = 'paper_example') AS paper_example FROM p GROUP BY case_id"""


@query("review_queue", QUEUE_SQL)
def review_queue(spark, sf_dir):
    """The prioritised queue over all cases, in review order."""
    cases = review_case_rows(spark, sf_dir)
    examples = T.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("g"), (F.col("item_id") % 3).cast("string"), F.lit("_on_g"), (F.col("item_id") % 2).cast("string")).alias("cell"),
        F.col("text").alias("question"),
    )
    queue = R.build_queue(cases, examples, SEED).join(cases.drop("question"), "case_id")
    return R.order_queue(queue, T.JUDGES, T.JUDGES).select("case_id", "subset", "priority", "paper_example")


@query(
    "order_queue",
    f"""SELECT row_number() OVER (ORDER BY p, NOT same_deployment, generator, CASE judge WHEN 'g2' THEN 0 WHEN 'g0' THEN 1 ELSE 2 END, core_id) AS place, case_id
FROM (SELECT *, core_id % 3 AS p FROM ({CASES_SQL}) WHERE cell = 'FP')""",
)
def order_queue(spark, sf_dir):
    cases = review_case_rows(spark, sf_dir).where("cell = 'FP'").withColumn("priority", F.col("core_id") % 3)
    ordered = R.queue_order(["g0", "g1", "g2"], ["g2", "g0", "g1"])
    packed = ordered * (1 << 40) + F.col("core_id")  # one unique number, so that no bucket is hot
    ranked = rank_by_value(cases.withColumn("_o", packed), [], "_o", out="place")
    return ranked.select("place", "case_id")
