"""SentencePiece ids with the byte spans of the original text, and back.

The text is normalised here by longest prefixes of the model's compiled character map, which records where
every normalised byte comes from; the installed library segments what is normalised.
"""

from __future__ import annotations

import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from verdictframe.llm.common import list_column, strings

SPACE = "▁"
_CACHE_CHUNKS, _LONG_CHUNK, _CHARS_AT_ONCE = 200_000, 48, 400_000
_REPLACEMENT = "�".encode()


class CharacterMap:
    """The compiled map of a model: a double-array trie of prefixes and the strings that replace them."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``text`` from ``at`` that the map replaces, and what replaces it."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        length, value = found
        return length, self.strings[value : self.strings.index(b"\0", value)]


class Pieces:
    """A model: its own normalisation with alignment, the library's segmentation, and decoding."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        rules = spec.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.trim, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix = spec.trainer_spec.treat_whitespace_as_suffix
        kind = proto.ModelProto.SentencePiece
        self.symbols = sorted((p.piece.encode() for p in spec.pieces if p.type == kind.USER_DEFINED), key=len, reverse=True)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = [1 if p.type == kind.BYTE else len(p.piece.encode()) for p in spec.pieces]
        self.unknown = {i for i, p in enumerate(spec.pieces) if p.type == kind.UNKNOWN}
        # The same pieces and scores without normalisation: what comes in is segmented as it is.
        rules.name, rules.precompiled_charsmap = "identity", b""
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        #: Whether no piece crosses from text to a following space mark, so that words segment alone.
        self.by_word = not self.symbols and not self.suffix and spec.trainer_spec.byte_fallback and not any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces)
        self.plain = not self.map.units and not self.trim and self.escape and not self.suffix and not self.symbols
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the place in the source's bytes."""
        if not text:
            return "", np.zeros(1, dtype=np.int64)
        if self.plain:
            return self._plain(text)
        raw = text.encode()
        mark = SPACE.encode() if self.escape else b" "
        chunks: list[tuple[int, int, bytes]] = []
        at = 0
        while at < len(raw):
            symbol = next((s for s in self.symbols if raw.startswith(s, at)), None)
            found = (len(symbol), symbol) if symbol else self.map.longest(raw, at)
            if found is None:
                lead = raw[at]
                length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = (length, raw[at : at + length])
            chunks.append((at, at + found[0], found[1]))
            at += found[0]
        if self.trim:
            while chunks and chunks[0][2] in (b" ", b""):
                chunks.pop(0)
        if not chunks:
            return "", np.full(1, len(raw) if self.trim else 0, dtype=np.int64)
        out, places = bytearray(), []
        first = chunks[0][0]
        if self.prefix and not self.suffix:
            out += mark
            places += [first] * len(mark)
        after_space, end = self.trim, first
        for begin, stop, piece in chunks:
            if self.trim and after_space:
                piece = piece.lstrip(b" ")
            if piece:
                for byte in piece:
                    put = mark if byte == 0x20 else bytes((byte,))
                    out += put
                    places += [begin] * len(put)
                after_space = self.trim and piece.endswith(b" ")
            end = stop
            if not self.trim:
                after_space = False
        if self.trim:
            while out.endswith(mark):
                end = places[len(out) - len(mark)]
                del out[len(out) - len(mark) :]
                del places[len(out) :]
        if self.prefix and self.suffix:
            out += mark
            places += [end] * len(mark)
        return out.decode(), np.array([*places, end], dtype=np.int64)

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        first = np.flatnonzero((raw & 0xC0) != 0x80)
        width = np.diff(np.r_[first, len(raw)])
        width[raw[first] == 0x20] = 3
        places = np.repeat(first, width)
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE), np.r_[np.zeros(3 * self.prefix, dtype=np.int64), places, len(raw)]

    def _words(self, text: str) -> list[str]:
        """Runs of marks with the word after them."""
        parts = text.split(SPACE)
        if "" not in parts[1:]:
            return ([parts[0]] if parts[0] else []) + [SPACE + p for p in parts[1:]]
        out, run = [parts[0]] if parts[0] else [], ""
        for p in parts[1:]:
            run += SPACE
            if p:
                out.append(run + p)
                run = ""
        return out + [run] if run else out

    def _sizes(self, chunk: str, ids: list[int]) -> bytes:
        sizes = [self.size[i] for i in ids]
        if not self.unknown.isdisjoint(ids):  # the length of an unknown piece is what the others leave
            pieces = self.segmenter.encode(chunk, out_type=str)
            sizes = [len(p.encode()) if i in self.unknown else s for i, s, p in zip(ids, sizes, pieces)]
        return array("i", sizes).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: ids, and start and end of each piece in the text's UTF-8 bytes."""
        normal = [self.normalize(t) for t in texts]
        words = [self._words(n) if self.by_word else [n] if n else [] for n, _ in normal]
        known = self.known
        new = list({w for ws in words for w in ws if w not in known})
        for w, ids in zip(new, self.segmenter.encode(new, num_threads=1)):
            known[w] = (array("i", ids).tobytes(), self._sizes(w, ids))
        out = []
        for ws, (_, places) in zip(words, normal):
            got = [known[w] for w in ws]
            ids = np.frombuffer(b"".join([g[0] for g in got]), dtype=np.int32)
            ends = np.cumsum(np.frombuffer(b"".join([g[1] for g in got]), dtype=np.int32), dtype=np.int64)
            edge = places[np.r_[0, ends]].astype(np.int32)
            out.append((ids, edge[:-1], edge[1:]))
        for w in new:
            if len(w) > _LONG_CHUNK:
                del known[w]
        if len(known) > _CACHE_CHUNKS:
            self.known = {}
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.decoder.decode(ids.tolist())


@lru_cache(2)
def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def encoded(docs: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ids, starts, ends (arrays) and decoded, per row.

    ``starts`` and ``ends`` are byte offsets into the row's own text; pieces of one character that falls
    back to bytes are empty but the last, and a space put before the text has no width. ``decoded`` is
    the text that the ids alone give back. A null or empty text has no ids. Texts are taken whole, a few
    at a time; the memory of a task is bounded by its longest text. Rows may repeat; an empty table gives
    none; columns outside ``keep`` are not read.
    """
    names = ["ids", "starts", "ends", "decoded"]

    def run(batches):
        pieces = load(model)
        for b in batches:
            texts, at = list(strings(b.column(len(keep)))), 0
            while at < len(texts):
                end, chars = at + 1, len(texts[at])
                while end < len(texts) and chars + len(texts[end]) <= _CHARS_AT_ONCE:
                    chars += len(texts[end])
                    end += 1
                got = pieces.encode(texts[at:end])
                lists = [list_column([g[i] for g in got], pa.int32()) for i in range(3)]
                back = pa.array([pieces.decode(g[0]) for g in got], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, end - at) for i in range(len(keep))), *lists, back], [*keep, *names])
                at = end

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    numbers = ArrayType(IntegerType())
    schema = StructType([docs.schema[c] for c in keep]).add("ids", numbers).add("starts", numbers).add("ends", numbers).add("decoded", StringType())
    return rows.mapInArrow(run, schema)
