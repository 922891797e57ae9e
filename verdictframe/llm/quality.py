"""Quality rules whose cutoffs are certified on labelled holdouts by exact binomial bounds.

All of it is DataFrame functions: measures, calibration and verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.text import let
from verdictframe.session import checkpointed

#: Share of good documents that all rules together may reject in a stratum, and the chance that any certificate is wrong.
RISK, ERROR = 0.05, 0.05
#: A cutoff is proposed if it rejects bad documents at least so many times as often as good ones.
LIFT = 2.0
#: Each rule with its cutoffs, loosest first: a document whose value is beyond a cutoff fails at that cutoff.
RULES: tuple[tuple[str, tuple[float, ...]], ...] = (
    ("symbols_per_word", (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    ("chars_per_word", (12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0)),
    ("short_words", (-2.5, -3.0, -3.5, -4.0, -4.5, -5.0)),
    ("duplicate_lines", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)),
    ("repeated_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
)
#: Strata up to this number are sent to all tasks; more are joined by shuffle.
BROADCAST_STRATA = 100_000
_SPACE, _SYMBOLS, _WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 3


def _words(text: Column) -> Column:
    inner = F.trim(text, F.lit(_SPACE))
    return F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def _window_hashes(words: Column) -> Column:
    last = F.size(words) - _WINDOW
    places = F.when(last >= 1, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(_WINDOW)]))


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Number of words that lie in a window of three which the text holds twice or more.

    Hashes of the windows tell most texts without a repeat. Otherwise 33 bits of a hash and its place in one
    number are sorted, which leaves the places of windows that share those bits; these are sorted by the words
    themselves, so equal ones stand together. A word counts once, in however many such windows it lies.
    """
    low = F.lit((1 << 31) - 1).cast("bigint")
    keys = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, 31).bitwiseOR(i.cast("bigint"))))

    def covered(sorted_):
        near = lambda i, x: F.coalesce(F.get(sorted_, i)["w"] == x["w"], F.lit(False))
        twice = F.filter(sorted_, lambda x, j: near(j - 1, x) | near(j + 1, x))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(_WINDOW)])))))

    def of(sorted_):
        near = lambda i, x: F.coalesce(F.shiftright(F.get(sorted_, i), 31) == F.shiftright(x, 31), F.lit(False))
        places = F.transform(F.filter(sorted_, lambda x, j: near(j - 1, x) | near(j + 1, x)), lambda x: x.bitwiseAND(low).cast("int"))
        windows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(_WINDOW)]).alias("w"), i.alias("i")))
        return let(F.array_sort(windows), covered)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(keys, of))


def measures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "source") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words for each row of ``docs``.

    Words are runs without the six ASCII white-space characters; n_lines counts lines with a word. A null text
    has none. A null stratum is the stratum ''. Every step is linear in the text but for the sort of windows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    rows = rows.withColumn("words", _words(text))
    rows = rows.withColumn("hashes", _window_hashes(F.col("words")))
    rows = rows.select(
        "doc_id",
        "stratum",
        F.size("words").alias("n_words"),
        _repeat_words(F.col("words"), F.col("hashes")).alias("n_repeat_words"),
        F.char_length(F.translate(text, _SPACE, "")).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, _SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
    )
    long = lambda c: F.col(c).cast("bigint").alias(c.split(".")[-1])
    return rows.select("doc_id", "stratum", *map(long, ("n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "n_repeat_words")))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def levels(rules=RULES) -> Column:
    """For each rule at how many of its cutoffs a row of ``measures`` fails."""
    words = F.greatest(F.lit(1), F.col("n_words"))
    value = {
        "symbols_per_word": F.col("n_symbols") / words,
        "chars_per_word": F.col("word_chars") / words,
        "short_words": -(F.col("word_chars") / words),
        "duplicate_lines": F.col("n_dup_lines") / F.greatest(F.lit(1), F.col("n_lines")),
        "repeated_words": F.col("n_repeat_words") / words,
    }
    return F.array(*[sum((value[name] > F.lit(c)).cast("int") for c in cutoffs) for name, cutoffs in rules])


def critical_count(n: Column, risk: float, error: Column) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= error, the exact sum of its terms; -1 if there is none."""

    def step(a, i):
        total = a["total"] + F.exp(a["log"])
        ratio = (n - i) * risk / ((i + 1) * (1 - risk))
        return F.struct(F.when(total <= error, i).otherwise(a["best"]).alias("best"), (a["log"] + F.log(ratio)).alias("log"), total.alias("total"))

    start = F.struct(F.lit(-1).cast("bigint").alias("best"), (n * math.log1p(-risk)).alias("log"), F.lit(0.0).alias("total"))
    # Up to the mean, where the sum is far above any error that is asked for.
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.floor(n * risk).cast("bigint")), start, step)["best"]


def holdout(id_: Column) -> Column:
    """Whether a label certifies (about half do, by the md5 of its id as text) or only proposes."""
    return F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) < "8"


def certified(facts: DataFrame, labels: DataFrame, rules=RULES, risk: float = RISK, error: float = ERROR, lift: float = LIFT, label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, rule, level): the strictest certified cutoff of each rule; none for a stratum without enough labels.

    ``facts`` has (doc_id, stratum, levels). A document beyond the k strictest cutoffs of a rule has level k, so
    level 1 stands for the strictest cutoff: what reaches the returned level goes. Labels outside the holdout propose cutoffs that reject bad documents
    ``lift`` times as often as good ones. On the holdout, a cutoff that rejects k of a stratum's n good
    documents is certified if P(Binomial(n, risk / rules) <= k) <= error / tests, where tests counts all cutoffs
    of all rules in all strata with a holdout. So with probability 1 - ``error`` no rule of any stratum rejects more
    than its part of ``risk`` of good documents, and all rules together no more than ``risk``.

    Documents are counted by (id, stratum, levels) before they meet the labels, so a hot id is a few rows.
    """
    good = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg((F.max(label_col) > 0).alias("good"))
    some = facts.groupBy("doc_id", "stratum", "levels").agg(F.count(F.lit(1)).alias("n"))
    seen = some.join(good, "doc_id").withColumn("holdout", holdout(F.col("doc_id")))
    cells = checkpointed(seen.select("stratum", "holdout", "good", "n", F.posexplode("levels").alias("rule", "level")).groupBy("stratum", "holdout", "good", "rule", "level").agg(F.sum("n").alias("n")))

    def counts(rows, *keys):
        of = lambda name, when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias(name)
        return rows.groupBy("stratum", *keys).agg(of("held", F.col("holdout") & F.col("good")), of("fit_good", ~F.col("holdout") & F.col("good")), of("fit_bad", ~F.col("holdout") & ~F.col("good")))

    totals = counts(cells.where("rule = 0"))
    rejected = counts(cells.select("*", F.explode(F.sequence(F.lit(1), F.col("level"))).alias("cut")).where("level > 0"), "rule", "cut")
    strata = totals.where("held > 0").count()
    tests = max(1, strata * sum(len(cutoffs) for _, cutoffs in rules))
    limit = totals.where("held > 0").withColumn("most", critical_count(F.col("held"), risk / len(rules), F.lit(error / tests)))
    limit = limit.select("stratum", "most", F.col("fit_good").alias("all_good"), F.col("fit_bad").alias("all_bad"))
    both = rejected.join(limit, "stratum").where(F.col("held") <= F.col("most"))
    # Shares as products, so that a stratum without good or bad documents needs no case of its own.
    proposed = both.where((F.col("fit_bad") > 0) & (F.col("fit_bad") * F.col("all_good") >= lift * F.col("fit_good") * F.col("all_bad")))
    return proposed.groupBy("stratum", "rule").agg(F.min("cut").alias("level"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "source", rules=RULES, **options) -> DataFrame:
    """``measures`` of each row of ``docs`` with base_failed, failed_rules (names) and kept.

    A document that passes the base rules goes only if it is beyond a cutoff that its stratum's labels certify
    (``certified``; ``options`` are its own). A null or empty text has no words and fails the base rules.
    Without labels, or too few, only the base rules reject. Several labels of one id make it good if any
    says so; labels of null id or null quality don't count. Repeated rows get equal results, null ids
    too; an empty table gives no rows; other columns are not read.
    """
    facts = checkpointed(measures(docs, text_col, id_col, stratum_col).withColumn("base_failed", base_failed()).withColumn("levels", levels(rules)))
    cuts = checkpointed(certified(facts.where(~F.col("base_failed")), labels, rules, **options))
    limits = cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "level"))).alias("cuts"))  # one entry for each rule
    if cuts.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    names = F.array(*[F.lit(name) for name, _ in rules])
    beyond = F.filter(F.transform("levels", lambda x, i: F.when(x >= F.try_element_at(F.col("cuts"), i), F.get(names, i))), lambda x: x.isNotNull())
    failed = F.when(F.col("base_failed") | F.col("cuts").isNull(), F.expr("cast(array() as array<string>)")).otherwise(beyond)
    out = facts.join(limits, "stratum", "left").withColumn("failed_rules", failed)
    return out.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
