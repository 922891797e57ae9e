"""Personal data by patterns, and more of it by contexts that are learned from what the patterns found.

All of it is DataFrame functions: matching, scoring of the pattern-instance graph and masking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.text import let
from verdictframe.llm.common import row_key
from verdictframe.session import checkpointed

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; distinct seeds a context needs; share of a context's instances that must be of its kind; score that an instance needs.
ROUNDS, SEEDS, CONFIDENCE, SCORE = 3, 3, 0.8, 0.8

# Possessive forms that start only where a run starts: they match what the plain forms match, in linear time and without deep recursion.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_CARD = r"[0-9 -]{2,}+"  # on a view of the text whose separators all stand between digits
_TOKEN = r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"
# A number in groups: digits with the separators of phones and cards, not cut out of a word.
_RUN = r"(?<![\p{L}\p{N}])[+(]{0,2}[0-9][ ().0-9-]*[0-9](?![\p{L}\p{N}])"
_SMALL = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SPANS = "array<struct<kind:int,start:int,end:int>>"
#: Code points of a chunk: work on places in a text is done chunk by chunk, so it grows in step with the text.
_CHUNK = 1024
#: How far back the words before a span are looked for, at first and if the first of them may be cut.
_BACK = (80, 1_280, 20_480)
#: Stands in for the characters of base spans; no pattern takes it but that of tokens.
_BLANK = "\u0001"


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _running(steps: Column) -> Column:
    """Sums of all numbers before each place of ``steps``, an array of bigint.

    An array that grows by one number is copied each time, so sums run inside blocks of about the square root
    of the length and then over the blocks.
    """

    def sums(numbers):
        start = F.expr("named_struct('at', 0L, 'out', cast(array() as array<bigint>))")
        return F.aggregate(numbers, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def blocks(all_):
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda b: sums(F.slice(all_, b * size + 1, size)))

        def joined(parts):
            before = sums(F.transform(parts, lambda p: p["at"]))["out"]
            return F.flatten(F.zip_with(parts, before, lambda p, x: F.transform(p["out"], lambda y: x + y)))

        return F.when(F.size(all_) > 0, let(cut, joined)).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(steps, blocks)


def _matches(text: Column, pattern: str, keep=None) -> Column:
    """start, end (code points, end exclusive) and text of the matches of ``pattern``, leftmost first."""

    def of(hits):
        gaps = F.split(text, pattern, -1)
        sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.char_length(g) + F.char_length(h)).cast("bigint"))

        def placed(steps):
            def one(before, i):
                end = (before + F.get(steps, i)).cast("int")
                return F.struct((end - F.char_length(F.get(hits, i))).alias("start"), end.alias("end"), F.get(hits, i).alias("hit"))

            return F.transform(_running(steps), one)

        return let(sizes, placed)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)
    return found if keep is None else F.filter(found, keep)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    from_right = F.split(F.reverse(digits), "(?!^)(?!$)")
    total = F.aggregate(
        F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _as_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), m["hit"].alias("hit")))


def base_spans(text: Column) -> Column:
    """start, kind, end and text of the spans that the four fixed patterns find, by start and then kind."""
    nothing = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,hit:string>>)")
    joined = F.regexp_replace(text, "(?<![0-9])[ -]|[ -](?![0-9])", "\u0001")

    def card(m):
        d = _digits(m["hit"])
        return F.char_length(d).between(12, 19) & _luhn(d)

    def phone(m):
        return F.char_length(_digits(m["hit"])).between(9, 15)

    found = {
        "email": (text.contains("@"), _matches(text, _EMAIL)),
        "ip": (text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _matches(text, _IP, lambda m: m["hit"].rlike(rf"^{_SMALL}(?:\.{_SMALL}){{3}}$"))),
        "card": (text.rlike("[0-9](?:[ -]?[0-9]){11}"), _matches(joined, _CARD, card)),
        "phone": (text.rlike(r"\+[0-9]"), _matches(text, _PHONE, phone)),
    }
    parts = [F.when(there, _as_kind(spans, kind)).otherwise(nothing) for kind, (there, spans) in found.items()]
    return F.array_sort(F.concat(*parts))


def _ordered(spans: Column) -> Column:
    by = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(by, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _context(text: Column, start: Column) -> Column:
    """The two words before a place, in lower case without marks; empty if there aren't two."""
    return let(_chunks(text), lambda chunks: let(_spaced(chunks), lambda spaced: _context_in(chunks, spaced, start)))


def _spaced(chunks: Column) -> Column:
    """For each chunk whether it has white space."""
    return F.transform(chunks, lambda c: c.rlike(r"[ \t-\r]"))


def _context_in(chunks: Column, spaced: Column, start: Column) -> Column:
    last = F.floor((start - 1) / _CHUNK).cast("int")

    def before(size):
        back = -(-size // _CHUNK)
        first = F.greatest(F.lit(0), last - back)
        window = F.array_join(F.slice(chunks, first + 1, back + 1), "")
        at = start - first * _CHUNK
        return F.substring(window, F.greatest(F.lit(1), at + 1 - size), F.least(F.lit(size), at))

    # Most words are short, so little is looked at first, and more where the first of the two words may be cut. All that
    # stands before is looked at where a word of over 20,480 characters ends, which few places of a text can have; inside
    # such a word there is no context.
    shown = F.substring(F.array_join(F.slice(chunks, 1, F.greatest(F.lit(0), last + 1)), ""), F.lit(1), start)
    for size in reversed(_BACK):
        seen = before(size)
        cut = (start > size) & seen.rlike(r"^[^ \t-\r]*+[ \t]*+[^ \t-\r]*+[ \t]*+$")
        shown = F.when(cut, shown).otherwise(seen)
    back = _BACK[-1] // _CHUNK
    near = F.array_contains(F.slice(spaced, F.greatest(F.lit(0), last - back) + 1, back + 1), True)
    shown = F.when((start > 0) & near, shown).otherwise("")
    return F.trim(F.regexp_replace(F.regexp_extract(F.lower(shown), r"(?<![^ \t-\r])([^ \t-\r]++[ \t]++[^ \t-\r]++)[ \t]*+$", 1), r"[^\p{L} ]", ""))


def _redrawn(text: Column, spans: Column, shown) -> Column:
    """``text`` with ``shown(piece)`` in place of each piece that a span (kind, start, end) has in a chunk.

    Spans are cut at chunk ends; a piece has kind, size and whether it ``opens``, that is begins a span
    outside all earlier ones. Pieces and one mark for each chunk are sorted together, so the marks' places
    tell which pieces belong to a chunk.
    """

    def pieces(s):
        def one(c):
            at, to = F.greatest(s["start"] - c * _CHUNK, F.lit(0)), F.least(s["end"] - c * _CHUNK, F.lit(_CHUNK))
            return F.struct(c.alias("chunk"), at.alias("at"), (s["start"] >= c * _CHUNK).alias("first"), s["kind"].alias("kind"), to.alias("to"))

        return F.transform(F.sequence(F.floor(s["start"] / _CHUNK).cast("int"), F.floor((s["end"] - 1) / _CHUNK).cast("int")), one)

    def chunk(text_, own):
        start = F.expr("named_struct('pos', 0, 'out', cast(array() as array<string>))")

        def step(a, x):
            gap = F.substring(text_, a["pos"] + 1, F.greatest(F.lit(0), x["at"] - a["pos"]))
            piece = F.struct(x["kind"].alias("kind"), F.greatest(F.lit(0), x["to"] - F.greatest(x["at"], a["pos"])).alias("size"), (x["first"] & (x["at"] >= a["pos"])).alias("opens"))
            return F.struct(F.greatest(a["pos"], x["to"]).alias("pos"), F.concat(a["out"], F.array(gap, shown(piece))).alias("out"))

        return let(F.aggregate(own, start, step), lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text_, done["pos"] + 1, _CHUNK)))

    def of(chunks):
        marks = F.transform(F.sequence(F.lit(0), F.size(chunks)), lambda c: F.struct(c.alias("chunk"), F.lit(-1).alias("at"), F.lit(False).alias("first"), F.lit(0).alias("kind"), F.lit(0).alias("to")))

        def sorted_(all_):
            places = F.filter(F.transform(all_, lambda x, i: F.when(x["at"] < 0, i)), lambda i: i.isNotNull())
            return let(places, lambda p: F.transform(chunks, lambda t, c: let(F.slice(all_, F.get(p, c) + 2, F.get(p, c + 1) - F.get(p, c) - 1), lambda own: F.when(F.size(own) > 0, chunk(t, own)).otherwise(t))))

        return F.array_join(let(F.array_sort(F.concat(F.flatten(F.transform(spans, pieces)), marks)), sorted_), "")

    return let(_chunks(text), of)


def _without(text: Column, spans: Column) -> Column:
    """``text`` with the characters of the spans blanked."""
    return _redrawn(text, spans, lambda piece: F.repeat(F.lit(_BLANK), piece["size"]))


def _fits(kind: Column, surface: Column) -> Column:
    """Whether a surface has the look of a kind: enough for a learned context, not enough alone."""
    n = F.char_length(_digits(surface))
    return (
        F.when(kind == 0, surface.rlike(r"^[^@]+@[^@]+$"))
        .when(kind == 1, surface.rlike(r"^[0-9]+([.:][0-9]+){3}$"))
        .when(kind == 2, n.between(12, 19) & ~surface.rlike(r"\p{L}"))
        .otherwise(n.between(7, 15) & ~surface.rlike(r"\p{L}"))
    )


def _facts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Per row: hash key, base spans, and the occurrences with their contexts.

    Occurrences are base spans, other tokens with digits or @, and numbers in groups with spaces between.
    Of a token and a number that start at one place only the longer counts as an instance of the context.
    Unseen identifiers are looked for among tokens of 4 to 40 digits (or with an @) and numbers of 7 to 19:
    no kind's look allows more digits than that, so longer ones could not be labelled by any context.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    rows = rows.withColumn("hits", F.when(F.col("text").rlike("[0-9@]"), base_spans(F.col("text"))).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int,hit:string>>)")))
    rows = rows.withColumn("base", F.transform("hits", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    rows = rows.withColumn("view", F.when(F.size("base") > 0, _without(F.col("text"), F.col("base"))).otherwise(F.col("text")))
    number = lambda m: m["hit"].contains(" ") & F.char_length(_digits(m["hit"])).between(7, 19)
    view, hits = F.col("view"), F.col("hits")
    runs = F.when(view.rlike("[0-9][().-]* [ ().-]*[0-9]"), _matches(view, _RUN, number)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)"))
    # What touches a base span has a blank in it.
    other = _matches(view, _TOKEN, lambda m: ~m["hit"].contains(_BLANK) & (F.char_length(_digits(m["hit"])).between(4, 40) | m["hit"].contains("@")))

    def placed(chunks, spaced):
        known = F.transform(hits, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("surface"), _context_in(chunks, spaced, s["start"]).alias("context"), F.lit(True).alias("counts")))

        def new(found):  # by start, longer ones first: what follows a longer one at the same place is its start
            shorter = lambda m, i: F.coalesce(F.get(found, i - 1)["start"] == m["start"], F.lit(False))
            return F.transform(found, lambda m, i: F.struct(F.lit(None).cast("int").alias("kind"), m["start"].alias("start"), (-m["back"]).alias("end"), m["hit"].alias("surface"), _context_in(chunks, spaced, m["start"]).alias("context"), (~shorter(m, i)).alias("counts")))

        order = F.transform(F.concat(other, runs), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), m["hit"].alias("hit")))
        return F.concat(known, let(F.array_sort(order), new))

    nothing = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,surface:string,context:string,counts:boolean>>)")
    return rows.withColumn("seen", F.when(F.col("text").rlike("[0-9@]"), let(_chunks(F.col("text")), lambda c: let(_spaced(c), lambda spaced: placed(c, spaced)))).otherwise(nothing)).drop("text", "view", "hits")


def learned(occurrences: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, confidence: float = CONFIDENCE, score: float = SCORE) -> DataFrame:
    """(surface, kind): unseen identifiers that high-confidence contexts vouch for.

    ``occurrences`` has (context, surface, kind, counts), kind null where no pattern matched, counts false
    for the start of a longer surface at the same place. The graph has an
    edge for each distinct (context, surface). A context's confidence for a kind is the mean score of
    its surfaces that count, if at least ``seeds`` of them are of that kind; a surface's score is the mean over all
    its contexts, and one that reaches ``score`` counts as found in the next round. Contexts and surfaces are
    counted by hash aggregates over distinct edges, however often one of them occurs.
    """
    edges = checkpointed(occurrences.where("context <> ''").groupBy("context", "surface").agg(F.max("kind").alias("kind"), F.max("counts").alias("counts")))
    new = edges.where("kind is null").select("context", "surface")
    degree = new.groupBy("surface").agg(F.count(F.lit(1)).alias("contexts"))
    found = None
    for _ in range(rounds):
        if found is None:
            scored = edges.withColumn("now", F.col("kind"))
        else:
            scored = edges.join(found.withColumnRenamed("kind", "later"), "surface", "left").withColumn("now", F.coalesce("kind", "later"))
        counts = [F.count(F.when(F.col("counts") & (F.col("now") == k), 1)).alias(f"n{k}") for k in range(len(KINDS))]
        totals = scored.groupBy("context").agg(F.count(F.when(F.col("counts"), 1)).alias("all"), F.count(F.when(F.col("kind").isNull(), 1)).alias("new"), *counts)
        best = F.greatest(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(k).alias("kind")) for k in range(len(KINDS))])
        good = totals.withColumn("b", best).where((F.col("b.n") >= seeds) & (F.col("new") > 0) & (F.col("b.n") >= confidence * F.col("all"))).select("context", F.col("b.kind").alias("kind"), (F.col("b.n") / F.col("all")).alias("weight"))
        votes = new.join(good, "context").where(_fits(F.col("kind"), F.col("surface"))).groupBy("surface", "kind").agg(F.sum("weight").alias("weight"))
        strong = votes.join(degree, "surface").where(F.col("weight") >= score * F.col("contexts"))
        found = checkpointed(strong.groupBy("surface").agg(F.max_by("kind", "weight").alias("kind")))
    return found


def personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, k1, k2, base, spans) per row of ``docs``; spans are arrays of (kind, start, end), sorted.

    ``base`` has what the patterns match; ``spans`` adds tokens and numbers in groups of the same look that stand where the
    corpus shows personal data of that kind to stand. A null or empty text has none. Repeated rows get
    equal results; an empty table gives no rows; other columns are not read. k1 and k2 are a hash of id and
    text, so rows need no id of their own.
    """
    facts = checkpointed(_facts(docs, text_col, id_col))
    occurrences = facts.where(F.size("seen") > 0).select("k1", "k2", F.explode("seen").alias("o")).select("k1", "k2", "o.*")
    found = learned(occurrences.select("context", "surface", "kind", "counts"), **options)
    more = occurrences.where("kind is null").drop("kind").join(found, "surface")
    more = more.groupBy("k1", "k2", "kind", "start").agg(F.max("end").alias("end"))  # the whole number, not its start
    more = more.groupBy("k1", "k2").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    both = facts.join(more, ["k1", "k2"], "left")
    added = F.coalesce("more", F.expr(f"cast(array() as {_SPANS})"))
    return both.select("doc_id", "k1", "k2", "base", _ordered(F.concat("base", added)).alias("spans"))


def masked_text(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that overlap become one mark."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return _redrawn(text, spans, lambda piece: F.when(piece["opens"], F.get(marks, piece["kind"])).otherwise(""))


def mask(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with personal data masked in its text; null texts stay null, all other columns as they are."""
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    found = personal_data(docs, text_col, id_col, **options).where(F.size("spans") > 0).groupBy("k1", "k2").agg(F.first("spans").alias("_spans"))
    named = found.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    both = docs.withColumns({"_h1": k1, "_h2": k2}).join(named, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")), "left")
    text = F.col(text_col).cast("string")
    return both.withColumn(text_col, F.when(F.col("_spans").isNotNull(), masked_text(text, F.col("_spans"))).otherwise(text)).select(*docs.columns)
