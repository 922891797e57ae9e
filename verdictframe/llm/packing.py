"""Best-fit packing of token pieces by a grouping genetic algorithm on migrating islands."""

from __future__ import annotations

import json
import os
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import parts_for
from verdictframe.session import checkpointed

#: Tokens of a sequence, pieces of one sub-problem, islands and epochs of it, individuals of an island and children an epoch.
CAPACITY, BLOCK, ISLANDS, EPOCHS, POPULATION, CHILDREN = 2048, 2048, 2, 3, 5, 8
#: A sequence filled less than this goes on to the next level, where remainders of many blocks meet.
WELL_FILLED = 0.985
#: Words that a task keeps with their ids (and those of one more slice), bytes of text that it encodes at once.
_CACHE_WORDS, _BYTES_AT_ONCE = 300_000, 4_000_000
#: Words that the pre-tokenizer cuts into a run of letters and a run of marks.
_SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[.,!?;:|%$#&*()\-]*)$"
_PIECE = ("doc_id", "row", "piece", "start", "length", "ids_crc32")


class _Store:
    """Token ids of strings in one flat array; strings not met for longest go when there are too many."""

    def __init__(self, room: int):
        self.room, self.turn = room, 0
        self.strings = pa.array([], pa.string())
        self.start, self.size, self.seen, self.ids = (np.zeros(0, np.int64) for _ in range(4))

    def places(self, strings_: pa.Array, learn) -> np.ndarray:
        """The place of each of some distinct strings; ``learn`` gives (sizes, ids) of those that aren't here."""
        if len(self.strings) > self.room:
            self._forget()
        self.turn += 1
        place = pc.index_in(strings_, value_set=self.strings)
        missing = np.flatnonzero(pc.is_null(place).to_numpy(zero_copy_only=False))
        out = place.fill_null(0).to_numpy().astype(np.int64)
        if len(missing):
            new = strings_.take(pa.array(missing))
            size, ids = learn(new.to_pylist())
            out[missing] = len(self.start) + np.arange(len(missing))
            self.strings = pa.concat_arrays([self.strings, new])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids.astype(np.uint32), ids])
            self.seen = np.concatenate([self.seen, np.zeros(len(missing), np.int64)])
        self.seen[out] = self.turn
        return out

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.seen, kind="stable")[: self.room // 2])
        self.strings = self.strings.take(pa.array(keep))
        self.ids = self.ids[_ranges(self.start[keep], self.size[keep])]
        self.size, self.seen = self.size[keep], self.seen[keep]
        self.start = np.cumsum(self.size) - self.size


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of several ranges, one after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class Encoder:
    """Token ids by the installed tokenizer, word by word.

    The vocabulary's pre-tokenizer never joins text across a space or a line end, so the ids of a text
    are those of its words in turn. Words are split off and numbered by Arrow kernels, so Python sees
    distinct ones only, and ids are gathered by NumPy. Words of Latin letters with marks after them are
    split as the pre-tokenizer would, and their letters go straight to the tokenizer's model; everything
    else takes the whole tokenizer. A task keeps the ids of recent words, up to a fixed number.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        letters_alone = len(cuts) == 2 and spec["model"].get("end_of_word_suffix") and cuts[0]["type"] == "Split" and r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in str(cuts[0]["pattern"].get("Regex"))
        self.simple = steps == ["NFC", "Replace", "Lowercase"] and letters_alone and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"]
        if self.simple:
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.bytes = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "÷"}
            self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            ends = [i for token, i in spec["model"]["vocab"].items() if token.endswith(spec["model"]["end_of_word_suffix"])]
            self.ends = np.zeros(max(ends) + 1, dtype=bool)
            self.ends[ends] = True
        self.words, self.letters = _Store(_CACHE_WORDS), _Store(_CACHE_WORDS)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words by the whole tokenizer."""
        got = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.array([len(x) for x in got], dtype=np.int64), np.fromiter((i for x in got for i in x), np.uint32)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words of letters: one run of the model over many words, cut where a token ends a word."""
        sizes, out = [], []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            text = " ".join(part)
            if not text.isascii():
                for letter, shown in self.bytes.items():
                    text = text.replace(letter, shown)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cut = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(cut) != len(part):
                raise ValueError("the vocabulary doesn't end every word with a token of its own")
            sizes.append(np.diff(cut, prepend=0))
            out.append(ids)
        return np.concatenate(sizes), np.concatenate(out)

    def _learned(self, distinct: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For distinct words two runs of ids each, letters and marks: (starts, sizes) of both within one flat array."""
        n = len(distinct)
        start, size = [np.zeros(n, np.int64), np.zeros(n, np.int64)], [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        flat, at = [], 0

        def put(side, rows, store, strings_, learn, back=None):
            nonlocal at
            if not len(rows):
                return
            place = store.places(strings_, learn)
            place = place if back is None else place[back]
            start[side][rows], size[side][rows] = store.start[place] + at, store.size[place]
            flat.append(store.ids)
            at += len(store.ids)

        rest = np.arange(n)
        if self.simple:
            parts = pc.extract_regex(distinct, _SIMPLE)
            whole = pc.is_valid(parts).to_numpy(zero_copy_only=False)
            rows, rest = np.flatnonzero(whole), np.flatnonzero(~whole)
            fields = dict(zip(("letters", "marks"), parts.take(pa.array(rows)).flatten()))
            for side, strings_, store, learn in ((0, pc.utf8_lower(fields["letters"]), self.letters, self._letters), (1, fields["marks"], self.words, self._words)):
                code = strings_.dictionary_encode()
                back, values = code.indices.to_numpy(), code.dictionary
                empty = pc.equal(values, "").to_numpy(zero_copy_only=False)
                held, number = np.flatnonzero(~empty), np.cumsum(~empty) - 1
                some = ~empty[back]
                put(side, rows[some], store, values.take(pa.array(held)), learn, number[back[some]])
        put(0, rest, self.words, distinct.take(pa.array(rest)), self._words)
        return start, size, np.concatenate(flat) if flat else np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array, close: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text and all their ids, one text after the other; ``close`` ends each text."""
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        code = lists.flatten().dictionary_encode()
        count, word = lists.value_lengths().to_numpy().astype(np.int64), code.indices.to_numpy()
        start, size, flat = self._learned(code.dictionary)
        flat = np.append(flat, np.uint32(close or 0))
        # Two runs a word, and one that closes each text.
        owner = np.repeat(np.arange(len(count)), 2 * count)
        place = np.arange(2 * len(word)) + owner
        runs_start, runs_size = np.full(2 * len(word) + len(count), len(flat) - 1), np.full(2 * len(word) + len(count), close is not None, dtype=np.int64)
        for side in (0, 1):
            runs_start[place[side::2]], runs_size[place[side::2]] = start[side][word], size[side][word]
        ids = flat[_ranges(runs_start, runs_size)]
        done = np.r_[0, np.cumsum(runs_size)][np.cumsum(2 * count + 1)]
        return np.diff(done, prepend=0), ids


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``_BYTES_AT_ONCE`` bytes together, with the place of the first; a longer text is one alone."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + _BYTES_AT_ONCE, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32, ids) per piece of every document of ``docs``.

    A document is its ids and a closing id 0; only documents longer than ``capacity`` are cut, into
    pieces of ``capacity`` ids. ``ids`` holds them as little-endian unsigned 32-bit numbers (left out
    unless ``keep_ids``), ids_crc32 is their checksum, ``row`` numbers the input rows (by task and
    place), so repeated rows stay apart.
    """

    def run(batches):
        encoder = _encoder(tokenizer)
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for at, texts in _slices(b.column(1)):
                size, ids = encoder.encode(texts, 0)
                pieces = -(-size // capacity)
                owner = np.repeat(np.arange(len(size)), pieces)
                piece = _ranges(np.zeros(len(size), np.int64), pieces)
                start = piece * capacity
                length = np.minimum(size[owner] - start, capacity)
                place = (np.cumsum(size) - size)[owner] + start
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                cuts = [raw[4 * x : 4 * (x + n)] for x, n in zip(place.tolist(), length.tolist())]
                columns = [b.column(0).take(pa.array(owner + at)), pa.array(owner + row), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cuts], pa.int64())]
                if keep_ids:
                    columns.append(pa.array([bytes(x) for x in cuts], pa.binary()))
                row += len(size)
                yield pa.RecordBatch.from_arrays(columns, [*_PIECE, "ids"][: len(columns)])
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [rows.schema[0].dataType.simpleString(), "bigint", "int", "bigint", "bigint", "bigint"]
    schema = [f"{c} {k}" for c, k in zip(_PIECE, kinds)] + ["ids binary"] * keep_ids
    return rows.mapInArrow(run, ", ".join(schema))


class Bins:
    """One packing of the items: bin contents and free room, with best fit by a bit set of the rooms in use."""

    def __init__(self, size: list[int], capacity: int):
        self.size, self.capacity = size, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def index(self) -> None:
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0
        for b, r in enumerate(self.room):
            self._open(b, r)

    def _open(self, b: int, r: int) -> None:
        if r in self.by_room and self.by_room[r]:
            self.by_room[r].append(b)
        else:
            self.by_room[r] = [b]
            self.mask |= 1 << r

    def best_fit(self, items: list[int]) -> None:
        """Put ``items`` where they leave the least room, in the order given."""
        size, room = self.size, self.room
        for i in items:
            s = size[i]
            up = self.mask >> s
            if up:
                r = s + (up & -up).bit_length() - 1
                same = self.by_room[r]
                b = same.pop()
                if not same:
                    self.mask &= ~(1 << r)
                self.bins[b].append(i)
            else:
                b, r = len(self.bins), self.capacity
                self.bins.append([i])
                room.append(r)
            room[b] = r - s
            self._open(b, r - s)

    def fitness(self) -> float:
        """Mean squared filling: fewer and fuller bins are better even while their number is equal."""
        return sum((1 - r / self.capacity) ** 2 for r in self.room) / max(1, len(self.room))

    def keep(self, which: list[int]) -> Bins:
        child = Bins(self.size, self.capacity)
        child.bins = [list(self.bins[b]) for b in which]
        child.room = [self.room[b] for b in which]
        return child

    def genes(self) -> list[int]:
        out = [0] * len(self.size)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def from_genes(genes: list[int], size: list[int], capacity: int) -> Bins:
    out = Bins(size, capacity)
    out.bins = [[] for _ in range(max(genes, default=-1) + 1)]
    out.room = [capacity] * len(out.bins)
    for i, b in enumerate(genes):
        out.bins[b].append(i)
        out.room[b] -= size[i]
    return out


def fewest(size: list[int], capacity: int) -> int:
    """A number of bins that no packing can go below."""
    return max(-(-sum(size) // capacity), sum(2 * s > capacity for s in size))


def _decreasing(items, size, rng: random.Random | None = None, noise: float = 0.0) -> list[int]:
    if rng is None:
        return sorted(items, key=lambda i: -size[i])
    return sorted(items, key=lambda i: -size[i] * (1 + noise * rng.random()))


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Whole well-filled bins of ``b`` enter ``a``; bins of ``a`` they overlap go, and their other items are best-fitted."""
    full = sorted(range(len(b.bins)), key=lambda x: b.room[x])
    full = full[: max(1, len(full) // 2)]
    picked = rng.sample(full, rng.randint(1, max(1, len(full) // 2)))
    inside = {i for x in picked for i in b.bins[x]}
    stay, loose = [], []
    for x, items in enumerate(a.bins):
        if inside.isdisjoint(items):
            stay.append(x)
        else:
            loose += [i for i in items if i not in inside]
    child = a.keep(stay)
    child.bins += [list(b.bins[x]) for x in picked]
    child.room += [b.room[x] for x in picked]
    child.index()
    child.best_fit(_decreasing(loose, a.size))
    return child


def mutate(a: Bins, rng: random.Random) -> Bins:
    """The emptiest bins and a few others are taken apart and their items best-fitted in a shaken order."""
    order = sorted(range(len(a.bins)), key=lambda x: -a.room[x])
    gone = set(order[: max(1, len(order) // 20)]) | set(rng.sample(range(len(order)), max(1, len(order) // 20)))
    child = a.keep([x for x in range(len(a.bins)) if x not in gone])
    child.index()
    child.best_fit(_decreasing([i for x in gone for i in a.bins[x]], a.size, rng, 0.3))
    return child


def evolve(size: list[int], capacity: int, population: list[list[int]], migrant: list[int] | None, seed: int, individuals: int, children: int) -> list[list[int]]:
    """One epoch of one island: its population, best first."""
    rng = random.Random(seed)
    people = [from_genes(g, size, capacity) for g in population]
    if migrant:
        people.append(from_genes(migrant, size, capacity))
    low = fewest(size, capacity)
    while not people or len(people) < individuals and len(people[0].bins) > low:
        new = Bins(size, capacity)
        new.index()
        new.best_fit(_decreasing(range(len(size)), size, rng if people or seed % 2 else None, 0.1 * len(people)))
        people.append(new)
    rank = lambda x: (len(x.bins), -x.fitness())
    people.sort(key=rank)
    for _ in range(children):
        if len(people[0].bins) <= low or len(people) < 2:
            break
        a, b = rng.sample(people, 2)
        child = crossover(a, b, rng)
        if rng.random() < 0.5:
            child = mutate(child, rng)
        people = sorted([*people, child], key=rank)[:individuals]
    return [x.genes() for x in people]


def _epoch(state: DataFrame, capacity: int, epoch: int, individuals: int, children: int) -> DataFrame:
    def run(frames):
        import pandas as pd

        for part in frames:
            rows = []
            for r in part.itertuples(index=False):
                size = [int(x) for x in r.size_of]
                population = [[int(x) for x in g] for g in r.population] if r.population is not None else []
                migrant = [int(x) for x in r.migrant] if r.migrant is not None else None
                got = evolve(size, capacity, population, migrant, (r.block * 1009 + r.island) * 31 + epoch, individuals, children)
                rows.append((r.block, r.island, size, got, max(got[0]) + 1, max(got[0]) + 1 <= fewest(size, capacity)))
            yield pd.DataFrame(rows, columns=["block", "island", "size_of", "population", "n_bins", "solved"])

    return state.mapInPandas(run, "block bigint, island int, size_of array<int>, population array<array<int>>, n_bins int, solved boolean")


def _solve(blocks: DataFrame, capacity: int, islands: int, epochs: int, individuals: int, children: int) -> DataFrame:
    """(block, genes): the best packing that any island of a block found."""
    nothing = [F.lit(None).cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("migrant")]
    sizes = blocks.select("block", F.transform("items", lambda x: x["length"].cast("int")).alias("size_of"))
    width = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = sizes.select("block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "size_of", *nothing).repartition(width, "block", "island")
    ended: list[DataFrame] = []
    for epoch in range(epochs):
        now = checkpointed(_epoch(state, capacity, epoch, individuals, children))
        solved = now.where("solved").select("block").distinct()
        ended.append(now.select("block", "n_bins", F.col("population")[0].alias("genes")))
        if epoch == epochs - 1:
            break
        left = now.join(solved, "block", "left_anti")
        if not left.limit(1).count():
            break
        elite = left.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("population")[0].alias("migrant"))
        state = left.select("block", "island", "size_of", "population").join(elite, ["block", "island"]).select("block", "island", "size_of", "population", "migrant").repartition(width, "block", "island")
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    return every.groupBy("block").agg(F.min_by("genes", "n_bins").alias("genes"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, individuals: int = POPULATION, children: int = CHILDREN) -> DataFrame:
    """(row, piece, sequence_id, offset) for every row of ``pieces`` (row, piece, length), as few sequences as found.

    Rows are dealt by hash into blocks of about ``block`` pieces, each block to several islands. An
    island breeds whole packings for an epoch; between epochs its best one migrates to the next island,
    until an island meets the lower bound. Sequences that a block leaves poorly filled are taken apart
    and their pieces meet those of other blocks at the next level, until one block holds them all or a
    level no longer halves them. The driver sees two counts a level. Pieces of full length, ties and
    repeated lengths need no special case; no pieces give no rows.
    """
    left = pieces.select("row", "piece", "length")
    done: list[DataFrame] = []
    count, level, before = left.count(), 0, None
    while count:
        blocks_n = parts_for(count, block)
        dealt = left.withColumn("block", F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(blocks_n)))
        blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "row", "piece"))).alias("items"))
        blocks = checkpointed(blocks)
        best = _solve(blocks, capacity, islands, epochs, individuals, children)
        placed = blocks.join(best, "block").select("block", F.explode(F.arrays_zip("items", "genes")).alias("x")).select("block", "x.items.*", F.col("x.genes").alias("bin"))
        bins = placed.groupBy("block", "bin").agg(F.sum("length").alias("filled"), F.sort_array(F.collect_list(F.struct("row", "piece", "length"))).alias("items"))
        bins = checkpointed(bins.withColumn("open", (F.col("filled") < int(WELL_FILLED * capacity)) if blocks_n > 1 else F.lit(False)))
        rest = bins.where("open").select(F.explode("items").alias("i")).select("i.row", "i.piece", "i.length")
        before, count = count, rest.count()
        if blocks_n > 1 and 2 * count > before:
            bins, count = bins.withColumn("open", F.lit(False)), 0
        number = (F.lit(level) * (1 << 56) + F.col("block") * (1 << 16) + F.col("bin")).alias("sequence_id")
        offset = F.aggregate(F.slice("items", 1, F.col("pos")), F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
        full = bins.where(~F.col("open")).select(number, "items", F.posexplode("items").alias("pos", "i"))
        done.append(full.select("i.row", "i.piece", "sequence_id", offset.alias("offset")))
        left, level = rest, level + 1
    if not done:
        return left.select("row", "piece", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True, **options) -> DataFrame:
    """Every piece of every document with its place: (doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset).

    A null or empty text is the one id 0. Repeated rows and null ids are packed like any other row.
    Extra columns are not read. The pieces are written once to the checkpoint folder; with
    ``keep_ids=False`` only their checksum is, and the column ``ids`` is left out.
    """
    pieces = checkpointed(tokenized(docs, tokenizer, capacity, keep_ids=keep_ids))
    return pieces.join(pack(pieces, capacity, **options), ["row", "piece"]).drop("row")
