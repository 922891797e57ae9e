"""Text matching as Catalyst expressions: normalisation, containment, markers, labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a hedged or refused answer.
CONFLICT_MARKERS = (
    "however",
    "but the passages",
    "but the documents",
    "according to the passages",
    "but according to my",
    "contradict",
    "inconsistent",
    "uncertain",
    "may not be accurate",
    "differs from",
    "disagrees with",
)
REFUSAL_MARKERS = (
    "cannot determine",
    "insufficient",
    "not enough information",
    "passages do not",
    "no information",
    "unable to answer",
)
# Phrases of a claim about the passages rather than about facts.
META_MARKERS = (
    "passage",
    "do not discuss",
    "does not discuss",
    "do not mention",
    "does not mention",
    "do not address",
    "does not address",
    "don't",
    "not provide",
    "insufficient",
    "cannot answer",
    "cannot fully",
    "no information",
    "not contain",
    "not specifically",
    "not discussed",
    "inference",
    "provided evidence",
    "not enough",
    "do not state",
    "does not state",
    "not specify",
)
META_MARKERS_FLAG_AUDIT = META_MARKERS + ("do not specify",)
# Rejection-reason keywords, first hit wins.
REASON_KEYWORDS = (
    ("contextual anchors", "contextual anchor"),
    ("contextual anchors", "anchors"),
    ("leakage (paraphrase)", "still contains"),
    ("leakage (paraphrase)", "still appears"),
    ("leakage (paraphrase)", "leaks"),
    ("leakage (deterministic)", "deterministic_leakage"),
    ("not answer-causal", "not materially"),
    ("not answer-causal", "does not change"),
    ("not answer-causal", "would not change"),
    ("inconsistent context", "globally consistent is false"),
    ("inconsistent context", "still support"),
    ("implausible perturbation", "implausible"),
    ("implausible perturbation", "conflicts with real-world"),
    ("type mismatch", "type_valid is false"),
    ("type mismatch", "grammar"),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    """Null, empty or nothing but white space of any kind."""
    return ~F.coalesce(col(c), F.lit("")).rlike(r"(?U)\S")


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends; ``trim`` knows the space only."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it.

    A plain column expression is copied to every place that uses it, and again by predicate
    pushdown, so a costly one inside a lambda over passages would run once per passage.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(c: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits to one space, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def contains_normalized(haystack: Column, needle: Column) -> Column:
    """Containment of two already normalised strings; an empty needle never matches."""
    return (F.length(needle) > 0) & F.contains(haystack, needle)


def norm_contains(haystack: Column | str, needle: Column | str) -> Column:
    return contains_normalized(normalize(haystack), normalize(needle))


def marker_pattern(markers: Sequence[str]) -> str:
    return "|".join(re.escape(m) for m in markers)


def has_marker(c: Column | str, markers: Sequence[str]) -> Column:
    return F.lower(F.coalesce(col(c), F.lit(""))).rlike(marker_pattern(markers))


def behavior_label(
    answer: Column | str,
    original: Column | str,
    perturbed: Column | str,
    is_refusal: Column | str,
) -> Column:
    """struct(label, entails_original, entails_perturbed) from string matching alone."""
    refused = F.coalesce(col(is_refusal), F.lit(False))
    texts = F.struct(
        normalize(answer).alias("a"), normalize(original).alias("o"), normalize(perturbed).alias("p")
    )

    def labelled(found: Column) -> Column:
        label = (
            F.when(refused, "refusal_or_insufficient")
            .when(found["o"] & found["p"], "both_claims")
            .when(found["p"], "context_follow")
            .when(found["o"], "memory_override")
            .when(has_marker(answer, CONFLICT_MARKERS), "conflict_awareness")
            .when(has_marker(answer, REFUSAL_MARKERS), "refusal_or_insufficient")
            .otherwise("unrelated_or_failed")
        )
        return F.struct(
            label.alias("label"),
            (~refused & found["o"]).alias("entails_original"),
            (~refused & found["p"]).alias("entails_perturbed"),
        )

    hits = let(
        texts,
        lambda t: F.struct(
            contains_normalized(t["a"], t["o"]).alias("o"), contains_normalized(t["a"], t["p"]).alias("p")
        ),
    )
    return let(hits, labelled)


def bucket_reason(c: Column | str, keywords: Sequence[tuple[str, str]] = REASON_KEYWORDS) -> Column:
    low = F.lower(col(c))
    out = None
    for label, keyword in keywords:
        hit = F.contains(low, F.lit(keyword))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("other")


def replace_ignore_case(text: Column, old: Column, new: Column) -> Column:
    """Literal, case-insensitive replacement; both sides may hold any regex character."""
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(old, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    literal = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(text, quoted, literal)


def clip(c: Column | str, limit: int = 1000) -> Column:
    """At most ``limit`` characters, the last three an ellipsis when something was cut."""
    return F.when(F.length(col(c)) > limit, F.concat(F.left(col(c), F.lit(limit - 3)), F.lit("..."))).otherwise(
        col(c)
    )


def truncate(c: Column | str, limit: int) -> Column:
    return F.left(col(c), F.lit(limit))


def search(columns: Sequence[Column | str], query: str) -> Column:
    """True when any column holds ``query``, ignoring case; a blank query matches everything."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(wanted))
    return out
