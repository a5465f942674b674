"""WARC archives in seekable Zstandard bundles.

``write`` turns rows (page_id, url, html) into WARC/1.1 records. Every task writes bundles of its own: records are
grouped into frames of about ``FRAME`` bytes, each compressed on its own, and a footer (a skippable frame) holds the
seek table with the compressed size, the size and the checksum of every frame. The index, a Parquet table beside
the bundles, maps each record identifier to its bundle, frame and offset within the frame. ``read`` takes any rows of
the index, opens the bundles at their footers, and decompresses only the frames asked for.

Of records with equal payloads of at least ``min_bytes`` the one with the largest page_id is the response; the others
are revisits that refer to it and hold its HTTP header, but no payload. Smaller ones are all responses. Payloads are
the html in UTF-8, empty for null.

A bundle's name holds the task attempt, and the index only names bundles of tasks that ended well: a lost executor's or
a speculative attempt's bundle is never read. Bundles go to the shared folder through pyarrow's file systems.

Rows that share the largest page_id of their payload are all responses. A row with a null page_id revisits a row that
has one; among null ids alone all are responses. A null url is written as ``urn:x-no-url``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwise.llm.common import join_params, pinned, spread, utf8

FRAME = 1 << 20
BUNDLE = 1 << 30
LEVEL = 3
#: Fixed values of the seekable format: skippable frame magic, seek table magic, descriptor with checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "record_id string, page_id bigint, bundle string, frame int, offset bigint, size bigint"


# --- bundles --------------------------------------------------------------------------------------------------------

class BundleWriter:
    """Appends records to frames of one bundle file."""

    def __init__(self, sink, frame_bytes: int = FRAME):
        self.frame_bytes = frame_bytes
        self.sink, self.frame, self.table, self.written = sink, bytearray(), [], 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, record: bytes) -> tuple[int, int]:
        """-> (frame, offset within it)."""
        at = len(self.table), len(self.frame)
        self.frame += record
        if len(self.frame) >= self.frame_bytes:
            self.flush()
        return at

    def flush(self) -> None:
        if self.frame:
            data = self.zstd.compress(bytes(self.frame))
            self.sink.write(data)
            self.table.append((len(data), len(self.frame), xxhash.xxh64_intdigest(bytes(self.frame)) & 0xFFFFFFFF))
            self.written += len(data)
            self.frame.clear()

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class BundleReader:
    """Frames of one bundle file, found by its footer."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, descriptor, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        width = 12 if descriptor & CHECKSUMS else 8
        raw = source.read_at(n * width, size - 9 - n * width)
        self.table, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", raw, i * width)
            check = struct.unpack_from("<I", raw, i * width + 8)[0] if width == 12 else None
            self.table.append((at, packed, plain, check))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain, check = self.table[number]
        data = zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=plain)
        if len(data) != plain or check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} does not match its seek table entry")
        return data


# --- records --------------------------------------------------------------------------------------------------------

def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(text: str | None) -> str:
    """A header value without spaces and control characters."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in utf8(c)) for c in text) if text else "urn:x-no-url"


def record(record_id: str, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return utf8("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of one record; a response's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[:int(headers["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    number = lambda h: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+)", headers.get(h, ""))) else None
    return {"page_id": number("WARC-Record-ID"), "url": headers["WARC-Target-URI"], "record_type": kind, "payload_digest": digest,
            "payload_bytes": size, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def write(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``folder``; returns the index, which is stored there too."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha2("html", 256))
    # Aggregated before the shuffle: a payload of any frequency is one row per task.
    shared = (keyed.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1 and first is not null").select("sha", "first"))
    marked = join_params(keyed, shared, ["sha"]).select(
        "page_id", "url", "html", F.expr("if(page_id <=> first, null, first)").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        bundle, path, number, serial = None, None, 0, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if bundle is None or bundle.written >= BUNDLE:
                    if bundle is not None:
                        bundle.close()
                    path = f"bundle-{task.partitionId():05d}-{number:03d}-{task.taskAttemptId()}.warc.zst"
                    bundle, number = BundleWriter(fs.open_output_stream(f"{base}/{path}", compression=None), frame_bytes), number + 1
                rid = f"urn:page:{r['page_id']}:{task.partitionId()}:{serial}"     # repeated and null ids stay apart
                serial += 1
                data = record(rid, r["url"], utf8(r["html"]), r["refers_to"])
                frame, offset = bundle.add(data)
                out.append((rid, r["page_id"], path, frame, offset, len(data)))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                             names=["record_id", "page_id", "bundle", "frame", "offset", "size"])
        if bundle is not None:
            bundle.close()

    marked.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of ``index`` rows: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload."""
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "size")).alias("at"))   # bounded by FRAME
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
             ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        last, reader = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["bundle"] != last:
                    last, reader = r["bundle"], BundleReader(fs.open_input_file(f"{base}/{r['bundle']}"))
                data = reader.frame(r["frame"])
                records = [parse(data[x["offset"]:x["offset"] + x["size"]]) for x in r["at"]]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in records], t) for c, t in kinds], names=[c for c, _ in kinds])

    return spread(pinned(frames), 16, "bundle", "frame").sortWithinPartitions("bundle", "frame").mapInArrow(
        run, "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary")
