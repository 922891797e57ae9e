"""Raw question records (one VARIANT column) to gated, normalised core records.

Raw rows are kept as VARIANT because a missing key and a null value mean different things, and
because evidence labels come either as top-level arrays or inside each passage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions import jsonvals as J
from verdictframe.functions.scalars import stable_id
from verdictframe.functions.text import col, is_blank, let, strip
from verdictframe.schemas import PASSAGE

# Evidence labels, the id prefix and the passage minimum of the record format.
ANSWER_TAG = "ANSWER-THE-QUESTION"
RELATED_TAG = "RELATED-INFORMATION"
CITED_TAG = "YES"
ID_PREFIX = "garage_core_"
MIN_ANSWER_PASSAGES = 2


def truthy(value: Column) -> Column:
    """Truth of a raw field: strings must read true, yes or 1; other values follow JSON truth."""
    text = F.lower(strip(value.cast("string")))
    return F.when(J.json_type(value) == "STRING", text.isin("true", "yes", "1")).otherwise(J.truthy(value))


def passages(raw: Column) -> Column:
    return J.as_array(J.field(raw, "grounding"))


def _is_tag(value: Column, tag: str) -> Column:
    return F.coalesce(F.upper(J.as_string(value)) == tag, F.lit(False))


def _is_array(value: Column) -> Column:
    return F.coalesce(F.startswith(J.json_type(value), F.lit("ARRAY")), F.lit(False))


def count_answer_passages(raw: Column) -> Column:
    """Passages tagged as answering; a top-level array wins over labels inside the passages."""

    def count(r: Column) -> Column:
        top = J.field(r, "evidence_correct")
        inside = F.filter(passages(r), lambda p: _is_tag(J.field(p, "evidence_correct"), ANSWER_TAG))
        parallel = F.filter(J.as_array(top), lambda x: _is_tag(x, ANSWER_TAG))
        return F.when(_is_array(top), F.size(parallel)).otherwise(F.size(inside))

    return let(raw, count)


def passes_gates(raw: Column) -> Column:
    """Valid, seeking unless said otherwise, no false premise, validated if stated, two answers."""

    def gates(r: Column) -> Column:
        seeking, checked = J.field(r, "question_seeking"), J.field(r, "answer_validate")
        return (
            truthy(J.field(r, "question_valid"))
            & (seeking.isNull() | truthy(seeking))
            & ~truthy(J.field(r, "question_false_premise"))
            & (checked.isNull() | truthy(checked))
            & (count_answer_passages(r) >= MIN_ANSWER_PASSAGES)
        )

    return let(raw, gates)


def slot_order(line: Column) -> Column:
    """For each passage of a raw JSON line its keys in file order, which VARIANT doesn't keep."""
    read = F.from_json(line, "struct<grounding:array<map<string,string>>>")["grounding"]
    return F.transform(read, lambda p: F.map_keys(p))


def passage_text(passage: Column, position: Column, order: Column | None = None) -> Column:
    """``text``, else the citation slot of this position, else the first non-blank slot.

    ``order`` has the passage's keys in file order. Without it, "first" is by name, as VARIANT sorts keys.
    """
    slots = F.try_variant_get(passage, "$", "map<string,variant>")

    def chosen(present: Column) -> Column:
        by_name = F.try_element_at(F.map_values(present), F.lit(1))
        first = by_name
        if order is not None:
            there = F.filter(order, lambda k: F.map_contains_key(present, k))
            first = F.coalesce(present[F.get(there, F.lit(0))], by_name)
        own = present[F.concat(F.lit("cite_"), (position + 1).cast("string"))]
        return F.coalesce(J.as_string(own), J.as_string(first))

    present = F.map_filter(slots, lambda k, v: F.startswith(k, F.lit("cite_")) & ~is_blank(J.as_string(v)))
    flat = F.nullif(J.as_string(J.field(passage, "text")), F.lit(""))
    return F.coalesce(flat, let(present, chosen), F.lit(""))


def top_labels(raw: Column, name: str) -> Column:
    """The parallel label array, null when there is none."""
    top = J.field(raw, name)
    return F.when(_is_array(top), J.as_array(top))


def evidence_at(labels: Column, name: str, position: Column, passage: Column) -> Column:
    """Label from the parallel array, or from the passage when the array is missing or too short."""
    inside = F.coalesce(position < F.size(labels), F.lit(False))
    return F.when(inside, J.as_string(F.get(labels, position))).otherwise(J.as_string(J.field(passage, name)))


def sample_id(raw: Column) -> Column:
    """First of sample_id, id and question_id that is neither missing nor empty nor zero."""
    options = [J.field(raw, n) for n in ("sample_id", "id", "question_id")]
    return F.coalesce(*[F.when(J.truthy(v), J.as_text(v)) for v in options], F.lit(""))


def grounding(raw: Column, line: Column | None = None) -> Column:
    names = ("evidence_relevant", "evidence_correct", "evidence_cited")

    def one(labels: Column, orders: Column | None, p: Column, i: Column) -> Column:
        given = J.as_int(J.field(p, "passage_id"))
        date = J.field(p, "passage_date")
        return F.struct(
            F.coalesce(given.cast("int"), i).alias("passage_id"),
            passage_text(p, i, None if orders is None else F.get(orders, i)).alias("text"),
            J.as_string(J.field(p, "provider")).alias("provider"),
            F.when(J.truthy(date), J.as_string(date)).otherwise(J.as_string(J.field(p, "date"))).alias("passage_date"),
            *[evidence_at(labels[n], n, i, p).alias(n) for n in names],
            F.lit(False).alias("was_modified"),
        )

    # the label arrays are read once per record, not once per passage
    tops = F.struct(*[top_labels(raw, n).alias(n) for n in names])
    def build(labels: Column, orders: Column | None = None) -> Column:
        return F.transform(passages(raw), lambda p, i: one(labels, orders, p, i))

    built = let(tops, lambda labels: build(labels)) if line is None else let(tops, lambda labels: let(slot_order(line), lambda orders: build(labels, orders)))
    return built.cast(f"array<{PASSAGE}>")


def to_core(df: DataFrame, raw: str = "raw", keep: Sequence[str] = (), line: str | None = None) -> DataFrame:
    """Core columns from raw rows; ``keep`` carries further columns such as the row sequence.

    ``line`` names the column with the raw JSON text (``read_raw_lines`` has it); citation slots are then taken in
    file order.
    """
    r = F.col(raw)

    def text(name: str) -> Column:
        return J.as_string(J.field(r, name))

    staged = df.select(*keep, r, sample_id(r).alias("garage_sample_id"), grounding(r, F.col(line) if line else None).alias("all_grounding_original"))
    tagged = F.filter(
        F.col("all_grounding_original"), lambda p: F.upper(F.coalesce(p["evidence_correct"], F.lit(""))) == ANSWER_TAG
    )
    return staged.select(
        *keep,
        stable_id("garage_sample_id", ID_PREFIX).alias("core_id"),
        "garage_sample_id",
        F.coalesce(text("question"), F.lit("")).alias("question"),
        *[text(n).alias(n) for n in ("question_date", "question_category", "question_complexity",
                                     "question_popularity", "question_type")],
        F.coalesce(F.nullif(text("answer_generate"), F.lit("")), text("answer"), F.lit("")).alias("answer_generate"),
        "all_grounding_original",
        F.transform(tagged, lambda p: p["passage_id"]).alias("answer_containing_passage_ids"),
        F.create_map(F.lit("filter"), F.lit("ok")).alias("pipeline_state"),
    )


def select_raw(df: DataFrame, raw: str = "raw", keep: Sequence[str] = (), line: str | None = None) -> DataFrame:
    return to_core(df.where(passes_gates(F.col(raw))), raw, keep, line)


def has_cited_answer(grounding_column: Column | str = "all_grounding_original") -> Column:
    """Some passage both answers the question and is cited."""
    return F.exists(
        col(grounding_column),
        lambda p: (F.upper(F.coalesce(p["evidence_correct"], F.lit(""))) == ANSWER_TAG)
        & (F.upper(F.coalesce(p["evidence_cited"], F.lit(""))) == CITED_TAG),
    )
