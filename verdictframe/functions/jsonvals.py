"""JSON values from model responses, as VARIANT expressions with strict rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions.text import col, let, strip


def strict_json(text: Column | str) -> Column:
    """The whole string as one JSON value, else null: no code fences, no trailing text."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), col(text), F.lit("]")))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    return let(items, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))


def field(value: Column, name: str) -> Column:
    """Member of an object as VARIANT: SQL null when absent, variant null when given as null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def json_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(json_type(value), F.lit("OBJECT")), F.lit(False))


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))


def truthy(value: Column) -> Column:
    """Truth of a JSON value: non-empty strings are true, "false" included; absent is false."""
    return F.coalesce(_typed(value, _truth), F.lit(False))


def _typed(value: Column, body) -> Column:
    """``body(type, text)`` with both looked at once."""
    pair = F.struct(json_type(value).alias("k"), value.cast("string").alias("t"))
    return let(pair, lambda p: body(p["k"], p["t"]))


def _truth(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", F.length(text) > 0)
        .when(_is_number(kind), text.try_cast("double") != 0)
        .when(F.startswith(kind, F.lit("ARRAY")), text != "[]")
        .when(F.startswith(kind, F.lit("OBJECT")), text != "{}")
    )


def as_text(value: Column) -> Column:
    """Text of a JSON value; given-as-null reads 'None', booleans are capitalised, absent is null."""
    return _typed(
        value, lambda kind, text: F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
    )


def as_string(value: Column) -> Column:
    """String members only; any other type reads null."""
    return _typed(value, lambda kind, text: F.when(kind == "STRING", text))


def is_string_or_null(value: Column) -> Column:
    return value.isNull() | json_type(value).isin("STRING", "VOID")


def as_int(value: Column) -> Column:
    """Guarded integer: numbers truncate, digit strings parse, anything else is null."""
    return _typed(
        value,
        lambda kind, text: F.when(kind == "BIGINT", text.try_cast("bigint"))
        .when(_is_number(kind), text.try_cast("double").try_cast("bigint"))
        .when(kind == "BOOLEAN", (text == "true").cast("bigint"))
        .when((kind == "STRING") & strip(text).rlike(r"^[+-]?[0-9]+$"), strip(text).try_cast("bigint")),
    )


def as_array(value: Column) -> Column:
    """Elements of an array member, the empty array for anything else."""
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), empty)


def citation_ids(value: Column) -> Column:
    """Integers and digit strings of a list, in order; floats and booleans are left out."""
    kept = F.filter(
        as_array(value),
        lambda x: json_type(x).isin("BIGINT", "STRING") & x.cast("string").rlike(r"^-*[0-9]+$"),
    )
    return F.filter(F.transform(kept, lambda x: x.cast("string").try_cast("int")), lambda x: x.isNotNull())


def choice(value: Column, menu: tuple[str, ...]) -> Column:
    """The string if it is on the menu, else null."""
    return let(as_string(value), lambda text: F.when(text.isin(*menu), text))


def clipped_if_truthy(value: Column, limit: int) -> Column:
    return F.when(truthy(value), F.left(as_text(value), F.lit(limit)))
