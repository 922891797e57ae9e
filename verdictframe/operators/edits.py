"""Passage edits: what is sent out, how edits are applied, what still leaks, how requests read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions import jsonvals as J
from verdictframe.functions.text import (
    col,
    contains_normalized,
    let,
    normalize,
    replace_ignore_case,
    strip,
)
from verdictframe.operators.raw import ANSWER_TAG, RELATED_TAG
from verdictframe.schemas import CHANGE_TYPES, MENTION_KINDS, PASSAGE

REWRITE_LABELS = (ANSWER_TAG, RELATED_TAG)


def passage_label(evidence_correct: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(evidence_correct, F.lit("")), F.lit("UNLABELED")))


def passages_to_send(passages: Column | str) -> Column:
    return F.filter(col(passages), lambda p: passage_label(p["evidence_correct"]).isin(*REWRITE_LABELS))


def select_grounding(
    mode: Column | str, original: Column | str, perturbed: Column | str, closed_book: Column | None = None
) -> Column:
    """Passages of the mode; null when a mode that needs passages has none, empty for closed book."""
    chosen = F.when(col(mode) == "rag_perturbed", col(perturbed)).when(col(mode) == "rag_original", col(original))
    nothing = F.array().cast(f"array<{PASSAGE}>") if closed_book is None else closed_book
    return F.when(col(mode) == "closed_book", nothing).when(F.size(chosen) > 0, chosen)


def explode_passages(df: DataFrame, passages: str, keys: Sequence[str], variant: str | None = None) -> DataFrame:
    """One row per passage with its position; ``variant`` tags original and perturbed sets."""
    rows = df.select(*keys, F.posexplode(passages).alias("pos", "p")).select(*keys, "pos", "p.*")
    return rows.withColumn("variant", F.lit(variant)) if variant else rows


def nest_passages(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """Passage rows back to one ordered array per record (a record's own passages, never more)."""
    packed = F.sort_array(F.collect_list(F.struct("pos", *fields)))
    nested = rows.groupBy(*keys).agg(packed.alias(out))
    return nested.withColumn(out, F.transform(F.col(out), lambda p: F.struct(*[p[f].alias(f) for f in fields])))


def parse_spec(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Perturbation spec columns plus ``spec_status``: ok or the first check that failed."""
    v = F.col(parsed)
    parts = {n: J.field(v, n) for n in ("original_value", "perturbed_value", "perturbation_type")}
    named = df.withColumns({f"_{n}": strip(J.as_text(x)) for n, x in parts.items()})
    old, new, kind = F.col("_original_value"), F.col("_perturbed_value"), F.col("_perturbation_type")
    status = (
        F.when(~J.truthy(v), "failed:no_json")
        .when(~J.is_object(v) | old.isNull() | new.isNull() | kind.isNull(), "failed:bad_spec")
        .when((old == "") | (new == ""), "failed:empty_values")
        .when(old == new, "failed:identical_values")
        .when(~kind.isin(*CHANGE_TYPES), F.concat(F.lit("failed:unknown_type:"), kind))
        .otherwise("ok")
    )
    staged = named.withColumn("spec_status", status)
    good = F.col("spec_status") == "ok"
    extra = ("perturbation_subtype", "atomic_claim_original", "atomic_claim_perturbed", "plausibility", "deducibility_note")
    return staged.withColumns(
        {
            "original_value": F.when(good, old),
            "perturbed_value": F.when(good, new),
            "perturbation_type": F.when(good, kind),
            **{n: F.when(good, J.as_string(J.field(v, n))) for n in extra},
        }
    ).drop("_original_value", "_perturbed_value", "_perturbation_type")


def parse_edits(df: DataFrame, keys: Sequence[str], parsed: str = "parsed") -> DataFrame:
    """Edit rows; malformed entries are skipped and the last entry per passage wins."""
    entries = df.select(*keys, F.posexplode(J.as_array(J.field(F.col(parsed), "doc_modifications"))).alias("pos", "e"))
    e = F.col("e")
    texts = ("modified_text", "original_span", "perturbed_span", "mention_kind", "skip_reason")
    kind = J.field(e, "mention_kind")
    wellformed = F.coalesce(J.as_string(kind).isin(*MENTION_KINDS), F.lit(False)) | kind.isNull() | (
        J.json_type(kind) == "VOID"
    )
    for name in texts:
        wellformed = wellformed & J.is_string_or_null(J.field(e, name))
    rows = entries.where(J.is_object(e) & wellformed).select(
        *keys,
        "pos",
        J.as_int(J.field(e, "passage_id")).cast("int").alias("passage_id"),
        J.truthy(J.field(e, "was_modified")).alias("was_modified"),
        *[J.as_string(J.field(e, n)).alias(n) for n in texts],
    )
    rows = rows.where(F.col("passage_id").isNotNull())
    last = F.max_by(F.struct("was_modified", *texts), "pos").alias("m")
    return rows.groupBy(*keys, "passage_id").agg(last).select(*keys, "passage_id", "m.*")


def apply_edits(
    passages: DataFrame,
    edits: DataFrame,
    keys: Sequence[str],
    original_value: str = "original_value",
    perturbed_value: str = "perturbed_value",
    sent: str = "sent",
) -> DataFrame:
    """Perturbed text per passage: the edit, else the backstop replacement, else a copy.

    The backstop acts on passages that were not sent and still hold the original value. It is
    detected after normalisation but replaced literally, so a spelling variant survives and is
    left for ``leaks``.
    """
    wanted = edits.select(*keys, "passage_id", F.col("was_modified").alias("_m"), "modified_text")
    joined = passages.join(wanted, [*keys, "passage_id"], "left")
    edited = F.coalesce(F.col("_m"), F.lit(False)) & (F.length("modified_text") > 0)
    old, new = F.col(original_value), F.col(perturbed_value)
    leaked = contains_normalized(normalize("text"), normalize(old))
    backstop = ~edited & ~F.coalesce(F.col(sent), F.lit(False)) & leaked
    staged = joined.withColumns({"_edited": edited, "backstop": F.coalesce(backstop, F.lit(False))})
    text = (
        F.when(F.col("_edited"), F.col("modified_text"))
        .when(F.col("backstop"), replace_ignore_case(F.col("text"), old, new))
        .otherwise(F.col("text"))
    )
    return staged.withColumns(
        {"perturbed_text": text, "modified": F.col("_edited") | F.col("backstop")}
    ).drop("_m", "_edited", "modified_text")


def leaks(text: Column | str, original_value: Column | str) -> Column:
    return contains_normalized(normalize(text), normalize(original_value))


def leaked_ids(passages: Column | str, original_value: Column | str) -> Column:
    """Ids of passages that still hold the original value, for nested records."""

    def scan(needle: Column) -> Column:
        hits = F.filter(col(passages), lambda p: contains_normalized(normalize(p["text"]), needle))
        return F.transform(hits, lambda p: p["passage_id"])

    return let(normalize(original_value), scan)


def id_list(ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: x.cast("string")), ", "), F.lit("]"))


def leakage_status(ids: Column | str) -> Column:
    return F.when(F.size(col(ids)) > 0, F.concat(F.lit("failed:leakage:"), id_list(col(ids)))).otherwise("ok")


def missing_entries(sent: Column | str, edited: Column | str) -> Column:
    """Sent passage ids without an edit entry."""
    return F.array_except(col(sent), col(edited))


def edit_status(leaked: Column | str, missing: Column | str) -> Column:
    gaps = F.concat(F.lit("failed:missing_doc_entries:"), id_list(col(missing)))
    return (
        F.when(F.size(col(leaked)) > 0, leakage_status(leaked)).when(F.size(col(missing)) > 0, gaps).otherwise("ok")
    )


def override_leakage_gate(validation: Column | str, leaked: Column | str) -> Column:
    """A leak found by matching beats the model's own gate and adds a reason."""
    v, ids = col(validation), col(leaked)
    reason = F.concat(F.lit("deterministic_leakage:"), id_list(ids))
    reasons = F.coalesce(v["rejection_reasons"], F.array().cast("array<string>"))
    fixed = v.withField("no_original_answer_leakage", F.lit(False)).withField(
        "rejection_reasons", F.array_append(reasons, reason)
    )
    return F.when(F.size(ids) > 0, fixed).otherwise(v)


def passage_diffs(
    original: DataFrame, perturbed: DataFrame, edits: DataFrame, keys: Sequence[str] = ("core_id",)
) -> DataFrame:
    """Original passages with their perturbed text (or their own) and the matching edit."""
    on = [*keys, "passage_id"]
    right = perturbed.select(*on, F.col("text").alias("_pt"), F.col("was_modified").alias("_pm"))
    spans = edits.select(*on, "original_span", "perturbed_span")
    joined = original.join(right, on, "left").join(spans, on, "left")
    return joined.select(
        *on,
        F.coalesce(F.nullif("evidence_correct", F.lit("")), F.lit("UNLABELED")).alias("label"),
        F.col("evidence_cited").alias("cited"),
        F.col("text").alias("original_text"),
        F.coalesce("_pt", "text").alias("perturbed_text"),
        F.coalesce("_pm", F.lit(False)).alias("was_modified"),
        "original_span",
        "perturbed_span",
    )


def modified_detail(
    records: DataFrame,
    original: DataFrame,
    perturbed: DataFrame,
    edits: DataFrame,
    keys: Sequence[str] = ("core_id",),
    ids: str = "modified_passage_ids",
) -> DataFrame:
    """One row per modified passage id, in list order, with both texts and the edited spans."""
    on = [*keys, "passage_id"]
    listed = records.select(*keys, F.posexplode(ids).alias("pos", "passage_id"))
    before = original.select(*on, F.col("text").alias("_o"))
    after = perturbed.select(*on, F.col("text").alias("_p"))
    spans = edits.where("was_modified").select(*on, "original_span", "perturbed_span")
    joined = listed.join(before, on, "left").join(after, on, "left").join(spans, on, "left")
    return joined.select(
        *on,
        "pos",
        F.coalesce("_o", F.lit("")).alias("original_text"),
        F.coalesce("_p", F.lit("")).alias("perturbed_text"),
        "original_span",
        "perturbed_span",
    )


def _blocks(passages: Column, with_label: bool = False) -> Column:
    def one(p: Column) -> Column:
        head = F.concat(F.lit("["), p["passage_id"].cast("string"), F.lit("] "))
        if with_label:
            head = F.concat(head, F.lit("["), passage_label(p["evidence_correct"]), F.lit("] "))
        return F.concat(head, F.coalesce(p["text"], F.lit("")))

    return F.array_join(F.transform(passages, one), "\n\n")


def render_passages(passages: Column | str, with_label: bool = False) -> Column:
    """``[id] text`` blocks joined by blank lines."""
    return _blocks(col(passages), with_label)


def render_selected(passages: Column | str, ids: Column | str) -> Column:
    return _blocks(F.filter(col(passages), lambda p: F.array_contains(col(ids), p["passage_id"])))


def render_modified(passages: Column | str, ids: Column | str, fallback: int = 5) -> Column:
    """The modified passages, else the first few, else a note that there are none."""
    wanted = F.coalesce(col(ids), F.array().cast("array<int>"))
    chosen = F.filter(col(passages), lambda p: F.array_contains(wanted, p["passage_id"]))
    none = F.lit("(no perturbed passages available)")

    def show(kept: Column) -> Column:
        head = F.slice(col(passages), 1, fallback)
        return F.when(F.size(kept) > 0, _blocks(kept)).when(F.size(head) > 0, _blocks(head)).otherwise(none)

    return let(chosen, show)


def render_request(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places of a user's template with columns."""
    import re

    parts: list[Column] = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece[1:-1] in values:
            parts.append(F.coalesce(values[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)
