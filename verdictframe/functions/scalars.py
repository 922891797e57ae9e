"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions.text import col
from verdictframe.schemas import GATES, PROVIDER_FAMILY, UNKNOWN_FAMILY


def stable_id(c: Column | str, prefix: str = "", length: int = 12) -> Column:
    """``prefix`` plus the first hex digits of sha1; null counts as the empty string."""
    return F.concat(F.lit(prefix), F.left(F.sha1(F.coalesce(col(c), F.lit(""))), F.lit(length)))


def pct(n: Column | str, d: Column | str) -> Column:
    """100 n / d, null when the denominator is zero."""
    return F.when(col(d) != 0, F.lit(100.0) * col(n) / col(d))


def ratio_or_zero(n: Column, d: Column) -> Column:
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def r1(c: Column | str) -> Column:
    return F.round(col(c), 1)


def r3(c: Column | str) -> Column:
    return F.round(col(c), 3)


def first_nonblank(*columns: Column | str) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns])


def epoch_minute(c: Column | str) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm`` in the session time zone; null and 0 give ''."""
    seconds = col(c)
    text = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")
    return F.when(seconds.isNull() | (seconds == 0), F.lit("")).otherwise(text)


def ms_to_hours(c: Column | str) -> Column:
    return col(c) / F.lit(3_600_000.0)


def latency_ms(started: Column | str, ended: Column | str) -> Column:
    return ((col(ended) - col(started)) * 1000).cast("bigint")


def gates_pass(validation: Column | str = "validation", gates=GATES) -> Column:
    """Two-valued: a null gate never passes."""
    source = col(validation)
    out = F.lit(True)
    for gate in gates:
        out = out & F.coalesce(source[gate], F.lit(False))
    return out


def gates_pass_or_unset(validation: Column | str = "validation", gates=GATES) -> Column:
    """Three-valued: null unless every gate is set."""
    source = col(validation)
    all_set, every = F.lit(True), F.lit(True)
    for gate in gates:
        all_set = all_set & source[gate].isNotNull()
        every = every & source[gate]
    return F.when(all_set, every)


def provider_family(provider: Column | str, families: dict[str, str] = PROVIDER_FAMILY) -> Column:
    """Family by a literal map; providers outside it share one unknown family."""
    pairs = [F.lit(x) for item in families.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[col(provider)], F.lit(UNKNOWN_FAMILY))


def pair_type(
    judge_provider: Column | str,
    judge_model: Column | str,
    generator_provider: Column | str,
    generator_model: Column | str,
    families: dict[str, str] = PROVIDER_FAMILY,
) -> Column:
    same_model = col(judge_provider).eqNullSafe(col(generator_provider)) & col(judge_model).eqNullSafe(
        col(generator_model)
    )
    same_family = provider_family(judge_provider, families) == provider_family(generator_provider, families)
    return (
        F.when(same_model, "same_exact_model")
        .when(same_family, "same_provider_family")
        .otherwise("cross_provider_family")
    )


def confusion_cell(gold: Column | str, pred: Column | str) -> Column:
    g, p = F.coalesce(col(gold), F.lit(False)), F.coalesce(col(pred), F.lit(False))
    return F.when(g & p, "TP").when(g, "FN").when(p, "FP").otherwise("TN")


def rename_values(c: Column | str, mapping: dict[str, str], default: Column | str | None = None) -> Column:
    """Literal mapping; unmapped values keep their own text unless ``default`` is given."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    fallback = col(c) if default is None else (F.lit(default) if isinstance(default, str) else default)
    return F.coalesce(F.create_map(*pairs)[col(c)], fallback)
