"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole WARC records, and a seek table in a skippable
frame at the end (the public seekable format): for each frame its compressed and decompressed size. The index maps a
record identifier to a bundle, a frame and an offset inside the decompressed frame, so that one record is read with
one seek and the decompression of one frame.

Bundles have names of their own for each attempt of a task, and only those named in the written index count: a task
that runs twice, or is lost with its executor, leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import list_values
from .storage import MOST_HOT, Bloom, Work

# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

FRAME_BYTES, BUNDLE_BYTES, READ_BYTES, LEVEL = 1 << 18, 64 << 20, 16 << 20, 3
LEAST_REVISIT = 100
INDEX = "page_id bigint, record_id string, bundle string, frame int, at bigint, length bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, unique: bool = True) -> str:
    """The identifier of a page's record; that of a page whose id others have too, or without one, ends in a part of its own."""
    return f"<urn:page:{'none' if page_id is None else page_id}{'' if unique else ':' + uuid.uuid4().hex}>"


def page_of(identifier: str) -> int | None:
    x = identifier[len("<urn:page:") : -1].split(":")[0]
    return None if x == "none" else int(x)


def warc_record(identifier: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, named: bool = True) -> bytes:
    """A response record with its payload, or a revisit record that names the page of the response with an equal payload
    and, if that page has one record (``named``), the record."""
    kind = "revisit" if revisit else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=URI_SAFE)}"]), f"WARC-Payload-Digest: sha256:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"{REFERS_TO_PAGE}: {refers_to}"] if revisit else []),
        *([f"WARC-Refers-To: {record_id(refers_to)}"] if revisit and named else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: The header that names the page of a revisit's response.
REFERS_TO_PAGE = "X-Refers-To-Page"
#: Characters a target URI keeps; others, line ends among them, are percent-encoded.
URI_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """The headers of a record, its payload and the length of the full payload."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return head, payload, said


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with the compressed and decompressed size of each frame."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source, size: int) -> np.ndarray:
    """(start, compressed size, decompressed size) of each frame of an open bundle."""
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table of the expected kind at the end of the bundle")
    source.seek(size - 9 - 8 * count)
    sizes = np.frombuffer(source.read(8 * count), "<u4").reshape(-1, 2).astype(np.int64)
    return np.column_stack([np.concatenate([[0], np.cumsum(sizes[:, 0])[:-1]]) if count else np.zeros(0, np.int64), sizes])


class Bundle:
    """A bundle being written."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.frames, self.buffer, self.rows, self.size = store.open_output_stream(path, compression=None), [], bytearray(), [], 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, page_id: int | None, identifier: str, record: bytes) -> None:
        if self.buffer and len(self.buffer) + len(record) > FRAME_BYTES:
            self.flush()
        self.rows.append((page_id, identifier, self.uri, len(self.frames), len(self.buffer), len(record)))
        self.buffer += record

    def flush(self) -> None:
        if self.buffer:
            frame = self.packer.compress(bytes(self.buffer))
            self.out.write(frame)
            self.frames.append((len(frame), len(self.buffer)))
            self.size += len(frame)
            self.buffer = bytearray()

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.rows


def _as_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(names), kinds, strict=True)], names)


def _write(folder: str, repeated):
    names, kinds = ["page_id", "record_id", "bundle", "frame", "at", "length"], [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            alone = [~Bloom.passing(repeated.value, list_values(batch.column(k))[0]) for k in (6, 7)]
            for i in range(batch.num_rows):
                page, url, html, digest, refers, revisit = (batch.column(k)[i].as_py() for k in range(6))
                bundle = bundle or Bundle(folder)
                identifier = record_id(page, page is not None and alone[0][i])
                bundle.add(page, identifier, warc_record(identifier, url, (html or "").encode(), digest, refers, revisit, bool(alone[1][i])))
                if bundle.size >= BUNDLE_BYTES:
                    yield _as_batch(bundle.close(), names, kinds)
                    bundle = None
        if bundle:
            yield _as_batch(bundle.close(), names, kinds)

    return run


def write_archives(pages: DataFrame, work: Work | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a WARC record for each row of ``pages`` (page_id, url, html) and returns the written index.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads of ``least`` bytes or more, that
    with the smallest page_id is a response (all rows that repeat it are), the others are revisits of it. A null
    page_id is never the smallest, unless all are null; these rows then are responses. A null url leaves the header out.
    A very long page is a frame by itself. An empty table gives no archives. Columns of other names are ignored.
    Records of rows that share a page_id, or have none, have identifiers with a part of their own, so that all differ.
    """
    work = work or Work(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    repeated = Bloom(work.cut(pages.filter("page_id is not null").groupBy("page_id").count().filter("count > 1").select("page_id"), "repeated"), "page_id")
    pages = pages.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    firsts = pages.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = work.cut(firsts, "firsts")
    # pages with a payload that many have get its first page where they are, and are then dealt out by their own number
    often = F.col("n") * MOST_HOT > pages.count()
    marked = pages.join(F.broadcast(firsts.filter(often).select("digest", F.col("first").alias("of_many"))), "digest", "left")
    marked = marked.withColumn("find", F.when(F.col("of_many").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    marked = marked.join(firsts.filter(~often).select(F.col("digest").alias("find"), "first"), "find", "left").withColumn("first", F.coalesce("of_many", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"), repeated.places("page_id").alias("own"), repeated.places("first").alias("of"))
    return work.cut(marked.mapInArrow(_write(work.path("bundles"), repeated.words), INDEX), "index")


def _read(with_payload: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source, table, frame, data = None, None, None, None, b""
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, held = [], 0
            for uri, number, at, length in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if uri != now:
                    store, path = fs.FileSystem.from_uri(uri)
                    if source:
                        source.close()
                    source, now, frame = store.open_input_file(path), uri, None
                    table = read_seek_table(source, source.size())
                if number != frame:
                    source.seek(int(table[number, 0]))
                    data, frame = unpacker.decompress(source.read(int(table[number, 1])), max_output_size=int(table[number, 2])), number
                head, payload, said = parse_record(data[at : at + length])
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                response = head["warc-type"] == "response"
                if response and (len(payload) != said or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"record {head['warc-record-id']} of {uri} is damaged")
                refers = None if response else int(head[REFERS_TO_PAGE.lower()])
                rows.append((page_of(head["warc-record-id"]), said, digest, head["warc-type"], refers, head.get("warc-target-uri"), payload if with_payload and response else None))
                held += len(payload) * with_payload
                if held > FRAME_BYTES * 16:
                    yield _as_batch(rows, names, kinds)
                    rows, held = [], 0
            yield _as_batch(rows, names, kinds)
        if source:
            source.close()

    return run


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of an index or of a part of it, read by seeking. Responses are checked against their digests; a
    revisit has the length and digest of the full payload and no payload of its own. A task reads some READ_BYTES: the
    bytes of the records decide on the number of tasks, not the small rows of the index."""
    places = index.select("bundle", "frame", "at", "length")
    tasks = max(1, -(-(places.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    places = places.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "at")
    return places.mapInArrow(_read(with_payload), RECORD)
