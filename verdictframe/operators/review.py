"""Human review: case queues, priorities, coverage, adjudication tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.scalars import confusion_cell
from verdictframe.functions.text import (
    META_MARKERS,
    clip,
    col,
    has_marker,
    normalize,
)
from verdictframe.operators.bootstrap import rule_of_three
from verdictframe.operators.prefixes import beside
from verdictframe.operators.ranking import rank_by_hash
from verdictframe.operators.sampling import matched_sample, stratified_sample
from verdictframe.session import checkpointed

REFUSAL_CONFLICT = ("refusal_or_insufficient", "conflict_awareness")
# Confusion cells by the names the flag audit uses.
CATEGORY_OF = {"TP": "true_positive", "FP": "apparent_fp", "FN": "false_negative", "TN": "true_negative"}


def case_id(judge: Column | str, generator: Column | str, core_id: Column | str, prefix: str = "garage_core_") -> Column:
    short = F.replace(F.coalesce(col(core_id).cast("string"), F.lit("")), F.lit(prefix), F.lit(""))
    return F.concat(col(judge), F.lit("-on-"), col(generator), F.lit("__"), short)


def category(gold: Column | str, pred: Column | str) -> Column:
    pairs = [F.lit(x) for item in CATEGORY_OF.items() for x in item]
    return F.create_map(*pairs)[confusion_cell(gold, pred)]


def artifact_tag(cell: Column | str, behavior: Column | str, claim: Column | str, markers=META_MARKERS) -> Column:
    """Only for false positives on refusals and conflicts: is the claim about the passages?"""
    applies = (col(cell) == "FP") & col(behavior).isin(*REFUSAL_CONFLICT)
    tag = F.when(has_marker(claim, markers), "likely_artifact").otherwise("substantive_claim")
    return F.when(F.coalesce(applies, F.lit(False)), tag).otherwise("")


def supporting_text(text: Column | str) -> Column:
    return clip(F.coalesce(col(text), F.lit("")), 1000)


def is_done(*labels: Column | str) -> Column:
    """Reviewed when every given label is filled in."""
    out = F.lit(True)
    for c in labels:
        out = out & (F.length(F.coalesce(col(c), F.lit(""))) > 0)
    return out


def derive_finding(cell: Column | str, gold_ok: Column | str, judge_ok: Column | str) -> Column:
    """Plain-English finding from the cell and the two human answers."""
    c, g, j = col(cell), col(gold_ok), col(judge_ok)
    both, gold_no, judge_no = (g == "yes") & (j == "yes"), g == "no", j == "no"
    gold_yes_judge_no = (g == "yes") & judge_no
    return (
        F.when((c == "TP") & both, "genuine TP")
        .when((c == "TP") & gold_no, "gold mislabel (answer did not adopt)")
        .when((c == "TP") & judge_no, "right verdict, wrong reason")
        .when((c == "FP") & gold_no, "gold mislabel (answer DID adopt -> really TP)")
        .when((c == "FP") & gold_yes_judge_no, "genuine false alarm")
        .when((c == "FP") & both, "judge caught a real / alternate error")
        .when((c == "FN") & gold_no, "gold too aggressive (answer did not adopt)")
        .when((c == "FN") & gold_yes_judge_no, "genuine miss")
        .when((c == "FN") & both, "INCONSISTENT (gold+ but judge right to be silent)")
        .when((c == "TN") & both, "genuine TN")
        .when((c == "TN") & judge_no, "judge MISSED a real error")
        .when((c == "TN") & gold_no, "gold mislabel (answer DID adopt)")
        .otherwise("unclear")
    )


def classify_flag(detected: str = "human_judge_detected_target", alternate: str = "human_alternate_valid_error",
                  artifact: str = "human_artifact", false_alarm: str = "human_false_alarm") -> Column:
    """One bucket per reviewed flag, in this order of precedence."""
    return (
        F.when(F.col(detected) == "yes", "target")
        .when(F.col(alternate) == "yes", "alternate")
        .when(F.col(artifact) == "yes", "artifact")
        .when(F.col(false_alarm) == "yes", "false_alarm")
        .otherwise("unclear")
    )


def attach_review(cases: DataFrame, labels: DataFrame, columns: Sequence[str], key: str = "case_id", how: str = "left") -> DataFrame:
    """Cases with their human labels; an unreviewed case reads ''."""
    joined = cases.join(labels.select(key, *columns), key, how)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def carry_labels(new: DataFrame, previous: DataFrame, columns: Sequence[str], key: str = "case_id") -> DataFrame:
    """A rebuilt queue keeps the labels people already gave."""
    return attach_review(new.drop(*columns), previous, columns, key)


def review_summary(reviewed: DataFrame, by: Sequence[str] = ("behavior", "cell"), population: str = "population",
                   gold_ok: str = "human_gold_ok", judge_ok: str = "human_judge_ok") -> DataFrame:
    """Sampled, population, reviewed, yes / no / unclear counts and fully valid cases per group."""
    done = is_done(gold_ok, judge_ok)

    def count(c: str, value: str) -> Column:
        return F.count_if(done & (F.col(c) == value))

    return reviewed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sampled"),
        F.max(population).alias("population"),
        F.count_if(done).alias("reviewed"),
        *[count(gold_ok, v).alias(f"gold_{v}") for v in ("yes", "no", "unclear")],
        *[count(judge_ok, v).alias(f"judge_{v}") for v in ("yes", "no", "unclear")],
        F.count_if(done & (F.col(gold_ok) == "yes") & (F.col(judge_ok) == "yes")).alias("cell_valid"),
    )


def audit_group(category_column: str = "category", same: str = "same_deployment") -> Column:
    c = F.col(category_column)
    return (
        F.when((c == "apparent_fp") & F.col(same), "same_fp")
        .when(c == "apparent_fp", "cross_fp")
        .otherwise(c)
    )


def flag_audit(reviewed: DataFrame, group: Column, done: Column, bucket: Column) -> DataFrame:
    """Members, reviewed and bucket counts per audit group."""
    rows = reviewed.select(group.alias("audit_group"), done.alias("_done"), bucket.alias("_bucket"))
    names = ("target", "alternate", "artifact", "false_alarm", "unclear")
    return rows.groupBy("audit_group").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("_done").alias("reviewed"),
        *[F.count_if(F.col("_done") & (F.col("_bucket") == b)).alias(b) for b in names],
    )


def decide(summary: DataFrame, same: str = "same_fp", cross: str = "cross_fp") -> DataFrame:
    """Decision A, B, C or pending from the two flagged groups of a flag audit."""
    def side(name: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("audit_group") == name, F.col(column))), F.lit(0))

    columns = ("n", "reviewed", "alternate", "false_alarm")
    row = summary.agg(*[side(g, c).alias(f"{p}_{c}") for p, g in (("s", same), ("c", cross)) for c in columns])

    def enough(p: str) -> Column:
        return F.col(f"{p}_reviewed") >= F.greatest(F.lit(5), F.floor(F.col(f"{p}_n") / 2))

    def rate(p: str, c: str) -> Column:
        return F.when(F.col(f"{p}_reviewed") > 0, F.col(f"{p}_{c}") / F.col(f"{p}_reviewed")).otherwise(0.0)

    alt_same, alt_cross = rate("s", "alternate"), rate("c", "alternate")
    ready = (F.col("s_n") > 0) & (F.col("c_n") > 0) & enough("s") & enough("c")
    verdict = (
        F.when(~ready, "pending")
        .when((alt_same < 0.25) & (alt_cross < 0.25), "A")
        .when(alt_cross - alt_same > 0.15, "C")
        .otherwise("B")
    )
    return row.select(
        alt_same.alias("alternate_same"), alt_cross.alias("alternate_cross"),
        rate("s", "false_alarm").alias("false_alarm_same"), rate("c", "false_alarm").alias("false_alarm_cross"),
        verdict.alias("decision"),
    )


def audit_tallies(reviewed: DataFrame, cell: str = "cell", same: str = "same_deployment",
                  gold_ok: str = "human_gold_ok", judge_ok: str = "human_judge_ok") -> DataFrame:
    """Findings per cell and arm over reviewed cases, with gold issues counted."""
    done = reviewed.where(is_done(gold_ok, judge_ok))
    finding = derive_finding(cell, gold_ok, judge_ok)
    arm = F.when(F.col(same), "same").otherwise("cross")
    return done.groupBy(F.col(cell).alias("cell"), finding.alias("finding"), arm.alias("arm")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(gold_ok) != "yes").alias("gold_issues")
    )


def event_bounds(events: Column, n: Column) -> tuple[Column, Column]:
    """Rule-of-three bounds of events/n where it is 0 or all; null elsewhere."""
    none, every = (events == 0) & (n > 0), (events == n) & (n > 0)
    blank = F.lit(None).cast("double")
    return rule_of_three(none, every, n, blank, blank)


def match_examples(
    cases: DataFrame, examples: DataFrame, cell: str = "cell", question: str = "question", key: str = "case_id"
) -> DataFrame:
    """Cases of an example's cell whose question starts like the example's, or the other way round.

    Questions and examples are sorted together by cell and text and merged (``prefixes.beside``), so there is one
    row for each distinct text, whatever its length, and a common cell or opening never pairs many cases
    with many examples. An example without letters or digits matches nothing.

    One character beyond the longest example already tells that a question is longer than all of them, so what
    follows it decides nothing and isn't carried. Cases meet the found texts by digest.
    """
    wanted = checkpointed(examples.select(F.col(cell).cast("string").alias("_cell"), normalize(question).alias("_q")).where(F.length("_q") > 0))
    longest = wanted.agg(F.coalesce(F.max(F.length("_q")), F.lit(0))).first()[0]
    opening = F.left(normalize(question), F.lit(longest + 1))
    asked = checkpointed(cases.select(key, F.col(cell).cast("string").alias("_cell"), opening.alias("_q")).withColumn("_d", F.sha2("_q", 256)))
    found = beside(asked, wanted, "_cell", "_q").select("_cell", F.sha2("_q", 256).alias("_d"))
    return asked.select(key, "_cell", "_d").join(found, ["_cell", "_d"], "left_semi").select(key).distinct()


def build_queue(cases: DataFrame, examples: DataFrame, seed: int = 20260627, n_false_negative: int = 10,
                n_sanity: int = 15, key: str = "case_id") -> DataFrame:
    """Prioritised review queue: (case, subset, priority, paper_example); first selection wins.

    Subsets are drawn from a table of the few columns they need, written once; only the match reads questions.
    """
    slim = checkpointed(cases.select(key, "judge", "generator", "category", "same_deployment", "is_validated"))
    valid = slim.where("is_validated")
    flagged = F.col("category") == "apparent_fp"
    same = F.col("same_deployment")
    cells = ["judge", "generator"]

    def tagged(df: DataFrame, subset: str, priority: int, turn: int) -> DataFrame:
        return df.select(key, F.lit(subset).alias("subset"), F.lit(priority).alias("priority"), F.lit(turn).alias("turn"))

    wrong = valid.where(F.col("category") == "false_negative")
    marked = match_examples(cases.withColumn("cell", F.concat_ws("_on_", *cells)), examples)
    picks = [
        tagged(valid.where(flagged & same), "same_fp", 1, 1),
        tagged(matched_sample(valid, "generator", flagged & same, flagged & ~same, seed, key), "cross_fp", 2, 2),
        tagged(rank_by_hash(wrong, ["generator"], seed, [key], "_r", limit=n_false_negative), "false_negative", 4, 3),
        tagged(stratified_sample(valid.where(F.col("category") == "true_positive"), cells, n_sanity, seed, key), "sanity_tp", 5, 4),
        tagged(stratified_sample(valid.where(F.col("category") == "true_negative"), cells, n_sanity, seed, key), "sanity_tn", 5, 5),
        tagged(marked, "paper_example", 3, 6),
    ]
    union = picks[0]
    for p in picks[1:]:
        union = union.unionByName(p)
    chosen = union.groupBy(key).agg(
        F.min_by(F.struct("subset", "priority"), "turn").alias("_s"),
        F.max(F.col("subset") == "paper_example").alias("paper_example"),
    )
    return chosen.select(key, "_s.subset", "_s.priority", "paper_example")


def queue_order(generators: Sequence[str], judges: Sequence[str]) -> Column:
    """Number that sorts by priority, same before cross, then generator and judge in the given order."""

    def place(c: str, names: Sequence[str]) -> Column:
        position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
        return F.coalesce(F.nullif(position, F.lit(0)), F.lit(len(names) + 1))

    g, j = len(generators) + 2, len(judges) + 2
    cross = (~F.col("same_deployment")).cast("bigint")
    return ((F.col("priority") * 2 + cross) * g + place("generator", generators)) * j + place("judge", judges)


def order_queue(queue: DataFrame, generators: Sequence[str], judges: Sequence[str], key: str = "core_id") -> DataFrame:
    return queue.orderBy(queue_order(generators, judges), key)
