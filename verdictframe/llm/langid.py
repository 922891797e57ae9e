"""Language mixtures: EM over per-word n-gram likelihoods, with the language set chosen by penalised likelihood."""

from __future__ import annotations

import math
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from verdictframe.llm.common import strings

#: Labelled documents of each language that the model is fitted on, about; n-gram buckets.
SAMPLE_DOCS, BUCKETS = 2_000, 1 << 16
#: EM rounds over all languages, which only tell what a larger set can gain; most rounds for a set, and the change that ends them.
FIRST_ROUNDS, MOST_ROUNDS, SETTLED = 6, 200, 1e-4
#: Gain in log-likelihood asked of another language, in units of log(words).
PENALTY = 2.0
UNKNOWN = "und"
_CHARS_AT_ONCE = 1_000_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a mark, else 0."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.int8, sys.maxunicode + 1)


def word_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all letter trigrams (with word ends), the first gram of each word, the text of each word.

    A word begins with a letter; marks go on extending it, and marks without a letter before them are no word.
    """
    codes = np.frombuffer(("\n".join(["", *[t.lower().replace("\n", " ") for t in texts], ""])).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _letters()[codes]
    letter = kind > 0
    if (kind == 1).any():
        place = np.arange(len(kind), dtype=np.int32)
        letter &= np.maximum.accumulate(np.where(kind == 2, place, np.int32(-1))) > np.maximum.accumulate(np.where(kind == 0, place, np.int32(-1)))
    c = np.where(letter, codes, 0).astype(np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    inside = letter[1:-1]
    grams = (h >> np.uint32(16))[inside]
    begins = inside & ~letter[:-2]
    first = (np.cumsum(inside) - 1)[begins]
    owner = (np.cumsum(codes == 10) - 1)[1:-1][begins]
    return grams, first, owner


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text: language, its share, and the shares of all languages."""
        out: list[np.ndarray] = []
        at, room = 0, max(50_000, _CHARS_AT_ONCE * 8 // max(8, len(self.langs)))
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= room):
                chars += len(texts[end])
                end += 1
            out.append(self.mixture(texts[at:end]))
            at = end
        shares = np.concatenate(out) if out else np.zeros((0, len(self.langs)))
        best = shares.argmax(1) if self.langs and len(shares) else np.zeros(len(texts), dtype=int)
        score = shares.max(1) if self.langs and len(shares) else np.zeros(len(texts))
        return [self.langs[b] if s > 0 else UNKNOWN for b, s in zip(best, score)], score, shares

    def mixture(self, texts: list[str]) -> np.ndarray:
        n, langs = len(texts), len(self.langs)
        shares = np.zeros((n, langs))
        grams, first, owner = word_grams(texts)
        if not len(first) or not langs:
            return shares
        words = np.add.reduceat(self.logp[grams], first, axis=0)
        has, start = np.unique(owner, return_index=True)
        count = np.diff(np.r_[start, len(owner)])
        log_words = np.log(count + 1)
        top = words.max(1, keepdims=True)
        lik = np.exp(np.maximum(words - top, -60)).astype(np.float32)
        # one language: the best by likelihood, exactly
        single = np.add.reduceat(np.maximum(words - top, -60), start, axis=0)
        best = single.argmax(1)
        chosen, score = np.zeros((len(has), langs)), single.max(1)
        chosen[np.arange(len(has)), best] = 1
        # No set of two or more can beat that where not even all languages, free of a penalty for the third, would.
        most = _most(lik, start, count)
        rows = np.flatnonzero(most - PENALTY * log_words > score)
        if len(rows):
            take = np.concatenate([np.arange(start[r], start[r] + count[r]) for r in rows])
            some = np.r_[0, np.cumsum(count[rows])[:-1]]
            chosen[rows] = _best_sets(lik[take], some, count[rows], log_words[rows], chosen[rows], score[rows], most[rows])
        shares[has] = chosen
        return shares


def _most(lik: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A log-likelihood that no mixture of each document exceeds.

    The log-likelihood is concave in the shares, so a few rounds of EM and the largest slope at the shares
    they reach bound its maximum.
    """
    pi, value = _em(lik, start, count, np.ones((len(start), lik.shape[1]), dtype=bool), FIRST_ROUNDS)
    mass = np.einsum("ij,ij->i", lik, np.repeat(pi, count, axis=0).astype(np.float32))
    slope = np.add.reduceat(lik / np.maximum(mass, 1e-30)[:, None], start, axis=0).max(1)
    return value + np.maximum(0, slope - count) + 1e-3 * count


def _best_sets(lik, start, count, log_words, chosen, score, most) -> np.ndarray:
    """Shares over the language set of best penalised likelihood that single additions and removals reach."""
    chosen, score, langs = chosen.copy(), score.copy(), lik.shape[1]
    member = chosen > 0
    live = np.arange(len(count))
    while len(live):
        take = np.concatenate([np.arange(start[r], start[r] + count[r]) for r in live])
        some = np.r_[0, np.cumsum(count[live])[:-1]]
        part, size, words = lik[take], count[live], log_words[live]
        now, shares, moved = score[live].copy(), chosen[live].copy(), np.full(len(live), -1)
        for k in range(langs):
            tried = member[live]
            tried[:, k] ^= True
            number = tried.sum(1)
            # What could at most be reached with so many languages decides whether EM is worth it.
            rows = np.flatnonzero((number > 0) & (most[live] - PENALTY * (number - 1) * words > now))
            if not len(rows):
                continue
            inner = np.concatenate([np.arange(some[r], some[r] + size[r]) for r in rows])
            pi, value = _em(part[inner], np.r_[0, np.cumsum(size[rows])[:-1]], size[rows], tried[rows], MOST_ROUNDS)
            value -= PENALTY * (number[rows] - 1) * words[rows]
            better = value > now[rows] + 1e-6
            now[rows[better]], shares[rows[better]], moved[rows[better]] = value[better], pi[better], k
        held = np.flatnonzero(moved >= 0)
        member[live[held], moved[held]] ^= True
        score[live[held]], chosen[live[held]] = now[held], shares[held]
        live = live[held]
    return chosen


def _em(lik: np.ndarray, start: np.ndarray, count: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture shares of each document over its allowed languages, and their log-likelihood; ends early when settled."""
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = lik * np.repeat(pi, count, axis=0).astype(np.float32)
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-30)
        before, pi = pi, np.add.reduceat(joint, start, axis=0) / count[:, None]
        if np.abs(pi - before).max() < SETTLED:
            break
    mass = np.einsum("ij,ij->i", lik, np.repeat(pi, count, axis=0).astype(np.float32))
    return pi / np.maximum(pi.sum(1, keepdims=True), 1e-30), np.add.reduceat(np.log(np.maximum(mass, 1e-30)), start)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """n-gram model of every language of ``labelled``.

    Per language about ``sample_docs`` documents are taken by a hash of their id (all, if there are
    fewer), so no text is shuffled and the bound doesn't grow. Their n-grams are counted whole, map
    side first; what reaches the driver is one number for each language and bucket.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32))
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("langid")), F.lit(1_000_000))
    cut = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, math.ceil(1_000_000 * min(1.0, sample_docs / n)))])
    place = {k: i for i, k in enumerate(langs)}

    def run(batches):
        total = np.zeros((BUCKETS, len(langs)), dtype=np.int64)
        for b in batches:
            owner_lang = np.array([place[x.as_py()] for x in b.column(1)], dtype=np.int64)
            texts = list(strings(b.column(0)))
            for at in range(0, len(texts), 100):
                grams, first, owner = word_grams(texts[at : at + 100])
                if len(first):
                    size = np.diff(np.r_[first, len(grams)])
                    lang = np.repeat(owner_lang[at : at + 100][owner], size)
                    np.add.at(total, (grams, lang), 1)
        g, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(k, pa.int32()), pa.array(total[g, k], pa.int64())], ["g", "k", "n"])

    counted = rows.where(draw < cut[F.col("lang")]).select("text", "lang").mapInArrow(run, "g int, k int, n bigint").groupBy("g", "k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BUCKETS, len(langs)), 0.1)
    counts[counted["g"].to_numpy(int), counted["k"].to_numpy(int)] += counted["n"].to_numpy(float)
    return Model(langs, (np.log(counts) - np.log(counts.sum(0))).astype(np.float32))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is 0 modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the main language of each whole text and its share of the text's words.

    Every word votes by its n-gram likelihoods; EM splits the words among a set of languages, and languages
    join or leave the set one at a time while the likelihood, less ``PENALTY * log(words)`` for each language
    beyond the first, grows. A text that is null or has no letter (marks and signs are none) is ``und`` with score 0, as is every text if no language was learned; ties
    go to the smaller language. Texts are taken whole whatever their length. Other columns stay; those
    of the result's names are replaced.
    """
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers
    place = kept.index(text_col)

    def run(batches):
        for b in batches:
            lang, score, _ = shared.value.predict(list(strings(b.column(place))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], [*kept, *names])

    schema = StructType([docs.schema[c] for c in kept]).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.select(kept).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without texts of no language: those ``und``, or whose main language has less than ``least`` of the words."""
    marked = identify(docs, model, text_col, ("_lang", "_share"))
    return marked.where((F.col("_lang") != UNKNOWN) & (F.col("_share") >= least)).select(*docs.columns)
