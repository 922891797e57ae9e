"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table, and a record index."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.session import checkpointed, ensure_checkpoint_dir

#: Text bytes of a frame and stored bytes of a bundle from which the next one begins; a larger record has a frame of its own.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 64 << 20, 3
# Fixed values of the seekable format: the skippable frame's magic, the footer's magic.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit has the HTTP header of the full payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _head(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}, end + 4


def parse(raw: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC header, HTTP header, payload) of the records of a frame from ``at`` on."""
    while at < len(raw):
        head, body = _head(raw, at)
        size = int(head["content-length"])
        http, start = _head(raw, body)
        yield head, http, raw[start : body + size]
        at = body + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: stored and plain size of each frame, the number of frames, and the magic."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(file) -> list[tuple[int, int]]:
    """(offset, stored size) of each frame, from the end of an open bundle."""
    end = file.size()
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE or flags:
        raise ValueError("not a bundle with a plain seek table")
    file.seek(end - 9 - 8 * count)
    sizes = struct.unpack(f"<{2 * count}I", file.read(8 * count))[::2]
    offsets = [0]
    for s in sizes:
        offsets.append(offsets[-1] + s)
    return list(zip(offsets, sizes))


@dataclass
class Bundle:
    """A bundle being written. Its name is new for every attempt, so a lost task leaves no half of a file that is used."""

    filesystem: fs.FileSystem
    folder: str
    frame_bytes: int
    frames: list[tuple[int, int]] = field(default_factory=list)
    index: list[tuple] = field(default_factory=list)
    waiting: list[bytes] = field(default_factory=list)
    plain: int = 0
    stored: int = 0

    def __post_init__(self):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = self.filesystem.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, record_id: int | None, raw: bytes) -> None:
        if self.plain and self.plain + len(raw) > self.frame_bytes:
            self.flush()
        self.index.append((self.name, record_id, len(self.frames), self.stored, self.plain, len(raw)))
        self.waiting.append(raw)
        self.plain += len(raw)

    def flush(self) -> None:
        if self.waiting:
            frame = self.press.compress(b"".join(self.waiting))
            self.file.write(frame)
            self.frames.append((len(frame), self.plain))
            self.stored, self.plain, self.waiting = self.stored + len(frame), 0, []

    def close(self) -> list[tuple]:
        self.flush()
        self.file.write(seek_table(self.frames))
        self.file.close()
        return self.index


INDEX = pa.schema([("bundle", pa.string()), ("page_id", pa.int64()), ("frame", pa.int64()), ("frame_at", pa.int64()), ("record_at", pa.int64()), ("length", pa.int64())])


def revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, sha, refers_to) of rows that repeat a payload of at least ``least_bytes`` bytes held by a larger id.

    Payloads meet as hashes, reduced map side to one row per hash; the join back carries only ids.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    slim = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size")).where(F.col("size") >= least_bytes)
    keep = slim.groupBy("sha").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("refers_to").isNotNull())
    again = slim.join(keep, "sha").where(F.col("id").isNull() | (F.col("id") < F.col("refers_to")))
    return again.select("id", "sha", "refers_to").distinct()


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per row of ``pages`` into bundles under ``folder``; returns the index, written too.

    The index maps page_id to bundle, frame number, the frame's offset in the bundle, the record's
    offset in the plain frame and its length. Of rows with equal payloads of at least ``least_bytes``
    bytes the largest id is a response and smaller or null ids revisit it (rows that repeat the largest id
    are responses too); if all ids are null, all are responses. A null payload is empty, a null url has no
    target header. Other columns are not read. No rows give an empty index and no bundle. Bundles that a
    lost task left behind are not in the index. A task holds one frame and a bundle's index at a time.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("payload")).withColumn("sha", F.sha1(F.encode("payload", "UTF-8")))
    again = revisits(pages, least_bytes, id_col, payload_col).withColumnsRenamed({"id": "id2", "sha": "sha2"})
    marked = rows.join(again, rows["id"].eqNullSafe(again["id2"]) & (rows["sha"] == again["sha2"]), "left").select("id", "url", "payload", F.col("sha2").isNotNull().alias("again"), F.col("refers_to").cast("bigint"))

    def run(batches):
        filesystem, path = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(path, recursive=True)
        bundle = None
        for b in batches:
            for page, url, payload, again, refers in zip(*b.columns):
                bundle = bundle or Bundle(filesystem, path, frame_bytes)
                bundle.add(page.as_py(), record(page.as_py(), url.as_py(), payload.as_py().encode(), refers.as_py(), again.as_py()))
                if bundle.stored >= bundle_bytes:
                    yield from _index(bundle)
                    bundle = None
        if bundle:
            yield from _index(bundle)

    def _index(bundle):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*bundle.close()), INDEX.types)], schema=INDEX)

    schema = "bundle string, page_id bigint, frame bigint, frame_at bigint, record_at bigint, length bigint"
    return checkpointed(marked.mapInArrow(run, schema))


def read_record(folder: str, bundle: str, frame_at: int, record_at: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record by its index entry: reads and decompresses only its frame."""
    filesystem, path = fs.FileSystem.from_uri(folder)
    with filesystem.open_input_file(f"{path}/{bundle}") as file:
        size = dict(read_seek_table(file))[frame_at]
        file.seek(frame_at)
        return next(parse(zstandard.ZstdDecompressor().decompress(file.read(size)), record_at))


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles in ``index``, frame by frame by each bundle's own seek table.

    Returns page_id, url, payload (null for a revisit), payload_bytes and payload_digest (both of the full
    payload), record_type, refers_to. A response whose payload doesn't have the digest it names is an error.
    """
    names = index.select("bundle").distinct()

    def run(batches):
        filesystem, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0):
                with filesystem.open_input_file(f"{path}/{name.as_py()}") as file:
                    for at, size in read_seek_table(file):
                        file.seek(at)
                        raw = zstandard.ZstdDecompressor().decompress(file.read(size))
                        yield _rows(parse(raw))

    schema = "page_id bigint, url string, payload string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return names.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bundle").mapInArrow(run, schema)


def _rows(records) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(7)]
    for head, http, payload in records:
        full = head["warc-type"] == "response"
        named = head["warc-payload-digest"].removeprefix("sha1:")
        if full and digest(payload) != named:
            raise ValueError(f"record {head['warc-record-id']} doesn't have the payload it names")
        refers = None if full else page_of(head["warc-refers-to"])
        row = (page_of(head["warc-record-id"]), head.get("warc-target-uri"), payload.decode() if full else None, int(http["content-length"]), named, head["warc-type"], refers)
        for column, value in zip(out, row):
            column.append(value)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def new_folder(spark) -> str:
    """A folder of its own for bundles, beside the checkpoints that all executors share."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base if ':' in base else 'file://' + base}/warc-{uuid.uuid4().hex}"
