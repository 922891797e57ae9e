"""Work expansion, model responses as a table, and their projection into record fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions import jsonvals as J
from verdictframe.functions.text import behavior_label, col, is_blank, let, strip
from verdictframe.schemas import BEHAVIOR_LABELS, GATES, LEVELS, VERDICTS

RESPONSE_FIELDS = "text string, input_tokens bigint, output_tokens bigint, error string"


def expand_work(
    df: DataFrame, models: Sequence[str], model_col: str, modes: Sequence[str] | None = None, answer: str | None = None
) -> DataFrame:
    """Every row once per mode and model; rows with a blank answer are skipped.

    The lists are literals, so the expansion is an explode inside the scan stage, not a join.
    """
    rows = df.where(~is_blank(answer)) if answer else df
    if modes:
        rows = rows.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return rows.withColumn(model_col, F.explode(F.array(*[F.lit(m) for m in models])))


def score_requests(
    requests: DataFrame,
    scorer: Callable[[pd.DataFrame], pd.DataFrame],
    keys: str,
) -> DataFrame:
    """Run a user's batch scorer over the request table.

    ``scorer`` gets a pandas batch and returns one row per request with text, input_tokens,
    output_tokens and error; ``keys`` is the DDL of the request columns to carry over.
    """
    names = [part.split()[0] for part in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answered = scorer(batch).reset_index(drop=True)
            kept = batch[names].reset_index(drop=True)
            yield pd.concat([kept, answered[["text", "input_tokens", "output_tokens", "error"]]], axis=1)

    return requests.mapInPandas(run, f"{keys}, {RESPONSE_FIELDS}")


def parse_responses(df: DataFrame, text: str = "text", error: str = "error") -> DataFrame:
    """Adds ``parsed`` (VARIANT) and ``response_status``: ok, no_json, call_failed or unexpected."""
    trimmed = strip(text)
    staged = df.withColumn("parsed", J.strict_json(trimmed))
    # a valid JSON text shows its type in its first character
    is_object, empty_object = trimmed.rlike(r"^\s*\{"), trimmed.rlike(r"^\s*\{\s*\}\s*$")
    status = (
        F.when(F.col(error).isNotNull(), "call_failed")
        .when(F.col("parsed").isNull() | empty_object, "no_json")
        .when(is_object, "ok")
        .when(J.truthy(F.col("parsed")), "unexpected")
        .otherwise("no_json")
    )
    return staged.withColumn("response_status", status)


def validation_fields(parsed: Column | str) -> Column:
    """Validation struct; every gate is null when nothing was parsed."""

    def fields(v: Column) -> Column:
        return let(J.truthy(v), lambda has: given(v, has))

    def given(v: Column, has: Column) -> Column:
        reasons = F.filter(J.as_array(J.field(v, "rejection_reasons")), J.truthy)
        return F.struct(
            *[F.when(has, J.truthy(J.field(v, g))).alias(g) for g in GATES],
            J.as_string(J.field(v, "plausibility")).alias("plausibility"),
            F.lit(None).cast("boolean").alias("human_audited"),
            F.transform(reasons, J.as_text).alias("rejection_reasons"),
        )

    return let(col(parsed), fields)


def answer_fields(
    df: DataFrame,
    parsed: str = "parsed",
    status: str = "response_status",
    original: str = "original_value",
    perturbed: str = "perturbed_value",
) -> DataFrame:
    """Answer columns; a failed call leaves an empty answer labelled unrelated_or_failed."""
    v, ok = F.col(parsed), F.col(status) == "ok"
    answer = J.field(v, "answer")
    notes = J.field(v, "notes")
    staged = df.withColumns(
        {
            "answer_text": F.when(ok & J.truthy(answer), J.as_text(answer)).otherwise(""),
            "is_refusal": ok & J.truthy(J.field(v, "is_refusal")),
            "cited_passage_ids": F.when(ok, J.citation_ids(J.field(v, "cited_passage_ids"))).otherwise(
                F.array().cast("array<int>")
            ),
            "notes": F.when(~ok, F.col(status)).when(J.json_type(notes) != "VOID", F.left(J.as_text(notes), F.lit(500))),
        }
    )
    label = behavior_label("answer_text", original, perturbed, "is_refusal")
    staged = staged.withColumn("_b", F.when(ok, label))
    return staged.withColumns(
        {
            "behavior_label": F.coalesce(F.col("_b.label"), F.lit("unrelated_or_failed")),
            "entails_original_claim": F.col("_b.entails_original"),
            "entails_perturbed_claim": F.col("_b.entails_perturbed"),
        }
    ).drop("_b")


def label_eval_fields(answer_text: Column | str, parsed: Column | str) -> Column:
    """Label evaluation struct, null when the response is rejected; blank answers get a fixed one."""

    def evaluated(v: Column) -> Column:
        label = J.choice(J.field(v, "behavior_label"), BEHAVIOR_LABELS)
        fields = F.struct(
            label.alias("behavior_label"),
            J.truthy(J.field(v, "entails_original_claim")).alias("entails_original_claim"),
            J.truthy(J.field(v, "entails_perturbed_claim")).alias("entails_perturbed_claim"),
            J.clipped_if_truthy(J.field(v, "rationale"), 600).alias("rationale"),
            J.choice(J.field(v, "confidence"), LEVELS).alias("confidence"),
        )
        return F.when(label.isNotNull(), fields)

    blank = F.struct(
        F.lit("unrelated_or_failed").alias("behavior_label"),
        F.lit(False).alias("entails_original_claim"),
        F.lit(False).alias("entails_perturbed_claim"),
        F.lit("generator produced no answer text").alias("rationale"),
        F.lit("high").alias("confidence"),
    )
    return F.when(is_blank(answer_text), blank).otherwise(let(col(parsed), evaluated))


def verdict_fields(parsed: Column | str) -> Column:
    """Verdict struct, null when the verdict is off the menu."""

    def fields(v: Column) -> Column:
        verdict = J.choice(J.field(v, "verdict"), VERDICTS)
        found = F.struct(
            verdict.alias("verdict"),
            J.truthy(J.field(v, "contains_factual_error")).alias("contains_factual_error"),
            J.clipped_if_truthy(J.field(v, "wrong_claim"), 600).alias("wrong_claim"),
            J.as_int(J.field(v, "supporting_source_passage_id")).cast("int").alias("supporting_source_passage_id"),
            J.clipped_if_truthy(J.field(v, "explanation"), 600).alias("explanation"),
            J.choice(J.field(v, "confidence"), LEVELS).alias("confidence"),
        )
        return F.when(verdict.isNotNull(), found)

    return let(col(parsed), fields)


def derive_gold(label_eval: Column | str, deterministic_label: Column | str) -> Column:
    """True when the answer asserts the perturbed value; the evaluation wins over string matching."""
    ev = col(label_eval)
    perturbed = F.coalesce(ev["entails_perturbed_claim"], F.lit(False))
    original = F.coalesce(ev["entails_original_claim"], F.lit(False))
    label = F.coalesce(ev["behavior_label"], F.lit(""))
    evaluated = (perturbed & ~original) | (label == "context_follow") | ((label == "both_claims") & perturbed)
    return F.when(ev.isNotNull(), evaluated).otherwise(
        F.coalesce(col(deterministic_label) == "context_follow", F.lit(False))
    )


def roll_up_status(
    df: DataFrame,
    keys: Sequence[str],
    ok: Column,
    failed: str = "failed:all_failed",
    records: DataFrame | None = None,
    skipped: str = "skipped:no_calls",
) -> DataFrame:
    """ok, ok_partial or ``failed`` per record, from one row per call.

    With ``records`` (all record keys) those without any call read ``skipped``.
    """
    good = F.coalesce(ok, F.lit(False))
    counted = df.groupBy(*keys).agg(F.count_if(good).alias("n_ok"), F.count_if(~good).alias("n_failed"))
    status = (
        F.when((F.col("n_ok") > 0) & (F.col("n_failed") == 0), "ok").when(F.col("n_ok") > 0, "ok_partial").otherwise(failed)
    )
    if records is None:
        return counted.withColumn("status", status)
    every = records.select(*keys).join(counted, list(keys), "left")
    known = F.when(F.col("n_ok").isNull(), skipped).otherwise(status)
    return every.withColumn("status", known).na.fill(0, ["n_ok", "n_failed"])


def stamp(state: Column | str, step: str, value: Column) -> Column:
    """Map with ``step`` set to ``value``; an earlier entry of the step is replaced."""
    kept = F.map_filter(col(state), lambda k, _: k != step)
    return F.map_concat(kept, F.create_map(F.lit(step), value))


def rescue(df: DataFrame, problem: Column, step: str, key: str = "core_id") -> DataFrame:
    """Stub rows ``failed:unexpected:<message>`` for rows with a problem, others as they are."""
    message = F.concat(F.lit("failed:unexpected:"), F.left(problem, F.lit(240)))
    return df.withColumns(
        {
            "step_status": F.when(problem.isNotNull(), message).otherwise(F.lit("ok")),
            key: F.coalesce(F.col(key).cast("string"), F.lit("unknown")),
            "step": F.lit(step),
        }
    )
