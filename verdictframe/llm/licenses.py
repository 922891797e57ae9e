"""Licence scan by a positional index of rare words: postings meet at relative positions, key phrases decide.

All of it is DataFrame functions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.session import checkpointed

# Words of licence texts as commonly published, and the phrases without which a text isn't that licence.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}
MANDATORY = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy",
    "apache": "under the apache license",
    "gpl": "gnu general public license",
    "lgpl": "gnu lesser general public license",
    "bsd": "redistribution and use in source and binary forms",
    "isc": "permission to use copy modify",
    "mpl": "mozilla public license",
    "unlicense": "free and unencumbered software released into the public domain",
}
#: Rarest words of each template that are looked up in a file, and share of a template's rare weight that must stand in place.
RAREST, MATCH = 12, 0.6
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_BREAK, text.lower()) if w]


def _postings() -> dict[str, list[tuple[str, int, bool]]]:
    """word -> (template, position, whether the key phrase needs it)."""
    out: dict[str, list[tuple[str, int, bool]]] = {}
    for label, text in TEMPLATES.items():
        words, key = _words(text), MANDATORY[label].split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        for i, w in enumerate(words):
            out.setdefault(w, []).append((label, i, at <= i < at + len(key)))
    return out


POSTINGS = _postings()
#: The rarest part of each key phrase: no text without one of these can pass the check of its phrase.
_GATE = "permission|apache|gnu|redistribution|mozilla|unencumbered"


def text_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case. Only words of plain letters are compared, so others may change case."""
    return F.filter(F.split(F.lower(text), _BREAK), lambda w: w != "")


def base_places(words: Column) -> Column:
    """(label, start) of each phrase of PHRASES in an array of words, in order."""
    ends: dict[str, list[tuple[str, list[str]]]] = {}
    for label, phrase in PHRASES.items():
        *before, last = phrase.split()
        ends.setdefault(last, []).append((label, before))

    def place(w, i):
        out = None
        for last, phrases in ends.items():
            for label, before in phrases:
                there = w == last
                for back, word in enumerate(reversed(before), 1):
                    there = there & (F.get(words, i - back) == word)
                named = F.struct(F.lit(label).alias("label"), (i - len(before)).alias("start"))
                out = F.when(there, named) if out is None else out.when(there, named)
        return out

    return F.filter(F.transform(words, place), lambda x: x.isNotNull())


def _facts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Per row: a number of its own, word count, base places, licence words in it, and where they stand if it may hold a template."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_words(text).alias("words"))
    words = F.col("words")
    vocabulary = F.array(*[F.lit(w) for w in sorted(POSTINGS)])
    no_base = F.expr("cast(array() as array<struct<label:string,start:int>>)")
    no_seen = F.expr("cast(array() as array<struct<word:string,pos:int>>)")
    last = [p.split()[-1] for p in PHRASES.values()]
    seen = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: x["word"].isin(sorted(POSTINGS)))
    has = lambda names: F.arrays_overlap(words, F.array(*[F.lit(n) for n in sorted(set(names))]))
    return rows.select(
        "doc_id",
        "row",
        F.size(words).cast("bigint").alias("n_words"),
        F.when(has(last), base_places(words)).otherwise(no_base).alias("base"),
        F.array_intersect(vocabulary, words).alias("held"),
        F.when(has(_GATE.split("|")), seen).otherwise(no_seen).alias("seen"),
    )


def _looked_up(label: str, idf: dict[str, float], rarest: int) -> Column:
    """(least, full): IDF from which a held word of the template is looked up, and the weight of all places of those words."""
    words = _words(TEMPLATES[label])
    ordered = sorted(set(words), key=lambda w: (-idf[w], w))
    own = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(idf[w]).alias("idf"), F.lit(idf[w] * words.count(w)).alias("all")) for w in ordered])
    there = F.filter(own, lambda x: F.array_contains("held", x["word"]))
    least = F.coalesce(F.get(there, F.lit(rarest - 1))["idf"], F.lit(0.0))  # words as rare as the last one count too
    return F.struct(least.alias("least"), F.aggregate(there, F.lit(0.0), lambda a, x: a + F.when(x["idf"] >= least, x["all"]).otherwise(0.0)).alias("full"))


def _template_hits(facts: DataFrame, idf: dict[str, float], rarest: int, match: float) -> DataFrame:
    """(row, label, score) of templates whose rare words stand in place and whose key phrase is whole.

    A row's number keeps it apart from its equals, so each word counts once at its place. Every template
    has rare words of its own, so none loses its places to another's.
    """
    bounds = F.array(*[_looked_up(label, idf, rarest) for label in TEMPLATES])
    files = facts.where(F.size("seen") > 0).select("row", "seen", bounds.alias("bounds"))
    words = files.select("row", F.explode("seen").alias("s"), "bounds").select("row", "s.word", "s.pos", "bounds")
    number = {label: i for i, label in enumerate(TEMPLATES)}
    entry = lambda t, p, m: F.struct(F.lit(t).alias("label"), F.lit(number[t]).alias("n"), F.lit(p).alias("at"), F.lit(m).alias("key"), F.lit(idf[_words(TEMPLATES[t])[p]]).alias("weight"))
    postings = F.create_map(*[x for w, ps in sorted(POSTINGS.items()) for x in (F.lit(w), F.array(*[entry(*p) for p in ps]))])
    met = words.select("row", "pos", "bounds", F.explode(postings[F.col("word")]).alias("p"))
    met = met.select("row", "p.label", "p.key", "p.weight", (F.col("pos") - F.col("p.at")).alias("offset"), F.get("bounds", F.col("p.n")).alias("b"))
    met = met.withColumn("rare", F.col("weight") >= F.col("b.least")).where("rare OR key").select("*", "b.full")
    aligned = met.groupBy("row", "label", "offset").agg(F.count(F.when(F.col("key"), 1)).alias("keys"), F.coalesce(F.sum(F.when(F.col("rare"), F.col("weight"))), F.lit(0.0)).alias("in_place"), F.max("full").alias("full"))
    needed = F.create_map(*[F.lit(x) for label, key in MANDATORY.items() for x in (label, len(key.split()))])
    whole = aligned.where(F.col("keys") == needed[F.col("label")])
    # full is the weight that the template's rare words in the file could have at most.
    best = whole.groupBy("row", "label").agg(F.max("in_place").alias("in_place"), F.max("full").alias("full"))
    return best.where(F.col("in_place") >= match * F.col("full")).select("row", "label", F.least(F.lit(1.0), F.col("in_place") / F.col("full")).alias("score"))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rarest: int = RAREST, match: float = MATCH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, base (places), base_labels, labels, score.

    Base labels are those of phrases that stand in the text. The method adds the label of every template
    whose key phrase stands whole in the text and with which, at one relative position, those of its own
    words that the file holds and that have the ``rarest`` highest IDF (equals of the last one included)
    agree by at least ``match`` of their weight. IDF counts every document. score is 1 with a base label,
    else the best agreement of an added one, else 0.

    A null or empty text has no words and no labels. Repeated rows get equal results, an empty table
    gives none, other columns are not read. The only numbers that reach the driver are document counts
    of the licence words, whose number is fixed.
    """
    facts = checkpointed(_facts(docs, text_col, id_col))
    total = facts.count()
    counts = facts.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    df = {r["word"]: r["n"] for r in counts}
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in POSTINGS}
    hits = _template_hits(facts, idf, rarest, match)
    more = hits.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    both = facts.drop("held", "seen").join(more, "row", "left")
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    labels = F.array_union(base, F.coalesce("more", F.expr("cast(array() as array<string>)")))
    return both.select("doc_id", "n_words", "base", joined(base).alias("base_labels"), joined(labels).alias("labels"), score.alias("score"))
