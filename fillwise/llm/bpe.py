"""Byte-level BPE encoding and decoding over overlapping chunks.

Texts longer than ``CHUNK`` characters are cut into overlapping chunks, one row each, dealt out over all tasks.
Each task pre-tokenises its chunk from the chunk's own start, which may lie inside a pre-token, and encodes those pieces.
Two neighbouring chunks resynchronise at the first pre-token boundary of their overlap that both have: matching
depends only on what follows a boundary, so from there on they agree. Left of that point the one chunk's ids count,
right of it the other's. Boundaries too near the end of a chunk, which more text could change, are left out. A chunk
starts so that its overlap holds a place where white space follows another character; there every pre-tokenisation
has a boundary, so a common one always exists. A text without such a place stays in one chunk.

Texts up to ``CHUNK`` characters are encoded where they are read. ``decode`` concatenates the raw bytes of the ids.

Null and empty texts have no ids. Repeated rows give one row of output each; a null doc_id is an id like any other.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16_384
OVERLAP = 256
#: White space after another character: a boundary of every pre-tokenisation.
SEAM = re.compile(r"(?<=\S)[ \n]")


class Codec:
    """Pre-tokeniser, piece encoder and byte table of one Python worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # White space as Unicode defines it, which is what the tiktoken library's engine takes \s for.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            tokens[i] = b
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(b"".join(tokens), np.uint8)

    def boundaries(self, text: str, start: int, lo: int, hi: int) -> list[int]:
        """Boundaries from ``lo`` to before ``hi`` of the pre-tokens from ``start`` on; those from ``lo`` on need a start
        that is a boundary only, so matching begins at the last seam before ``lo``."""
        seam = max((m.start() for m in SEAM.finditer(text, max(start, lo - 4 * OVERLAP), lo)), default=start)
        out = []
        for m in self.pattern.finditer(text, seam):
            if m.start() >= hi:
                break
            if m.start() >= lo:
                out.append(m.start())
        return out

    def encode(self, text: str) -> bytes:
        """Ids (little-endian 32-bit) of a text that starts and ends at pre-token boundaries."""
        return np.array(self.encoding.encode_ordinary(text), "<i4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, in order."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.table[at].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def chunk_spans(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text; neighbours overlap around a seam."""
    spans, start = [], 0
    while True:
        seam = SEAM.search(text, start + chunk)
        if not seam or seam.end() + overlap >= len(text):
            return [*spans, (start, len(text))]
        spans.append((start, seam.end() + overlap))
        start = max(start + 1, seam.start() - overlap // 2)


def encode_chunk(c: Codec, text: str, start: int, head: int, tail: int, last: bool) -> tuple[bytes, list[tuple[int, int]]]:
    """Ids of a chunk that starts at ``start`` of its text, and (position, ids before it) of its boundaries in both overlaps.

    ``head`` and ``tail``: positions before and from which boundaries may be shared with a neighbour.
    """
    head, tail = head - start, tail - start
    at = c.boundaries(text, 0, 0, min(head, tail))
    if not last:        # not too near the end: what follows may still turn "'r" into "'re"
        at += c.boundaries(text, 0, max(head, tail) if head <= tail else tail, len(text) - 2)
    # Not behind white space: a piece that ends in white space could be matched otherwise without what follows it.
    shared = [p for p in at if p == 0 or not text[p - 1].isspace()]
    parts: list[bytes] = []
    marks: list[tuple[int, int]] = []
    before = 0
    for p, q in zip(shared, [*shared[1:], len(text) if last else shared[-1]]):
        marks.append((start + p, before))
        parts.append(c.encode(text[p:q]))
        before += len(parts[-1]) // 4
    return b"".join(parts), marks


def stitch(chunks: list[tuple[bytes, list[tuple[int, int]]]]) -> bytes:
    """Ids of the text from its chunks in order."""
    out: list[bytes] = []
    frm = chunks[0][1][0][0] if chunks[0][1] else 0
    for (ids, marks), (_, after) in zip(chunks, chunks[1:]):
        place = dict(marks)
        to = min(p for p, _ in after if p in place and p >= frm)
        out.append(ids[4 * place[frm]:4 * place[to]])
        frm = to
    ids, marks = chunks[-1]
    return b"".join([*out, ids[4 * dict(marks)[frm]:] if marks else b""])


def _ids_array(rows: list[bytes]) -> pa.Array:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    flat = np.frombuffer(b"".join(rows), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int | None = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id and ids (array<int>) of the whole text. ``chunk`` None: no text is cut."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [c.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _ids_array(ids)], names=["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                spans = chunk_spans(r["text"], chunk)
                n = len(spans)
                heads = [0, *[e for _, e in spans[:-1]]]
                tails = [*[s for s, _ in spans[1:]], len(r["text"])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([r["doc_id"]] * n, b.schema.field("doc_id").type), "h": pa.array([r["h"]] * n, pa.int64()),
                    "no": pa.array(range(n), pa.int32()), "start": pa.array([s for s, _ in spans], pa.int64()),
                    "head": pa.array([max(h, 1) for h in heads], pa.int64()), "tail": pa.array(tails, pa.int64()),
                    "last": pa.array([k == n - 1 for k in range(n)]), "text": pa.array([r["text"][s:e] for s, e in spans])})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for r in b.to_pylist():
                ids, marks = encode_chunk(c, r["text"], r["start"], r["head"], r["tail"], r["last"])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([r["doc_id"]], b.schema.field("doc_id").type), "h": pa.array([r["h"]], pa.int64()), "no": pa.array([r["no"]], pa.int32()),
                    "ids": pa.array([ids], pa.binary()), "at": pa.array([[p for p, _ in marks]], pa.list_(pa.int64())), "before": pa.array([[n for _, n in marks]], pa.list_(pa.int64()))})

    def join(t: pa.Table) -> pa.Table:
        """One document's chunks; a repeated row has each chunk as often as it occurs."""
        rows = sorted(t.select(["no", "ids", "at", "before"]).to_pylist(), key=lambda r: r["no"])
        n = sum(r["no"] == 0 for r in rows)
        ids = stitch([(r["ids"], list(zip(r["at"], r["before"]))) for r in rows[::n]])
        return pa.table({"doc_id": t.column("doc_id").slice(0, 1).combine_chunks().take(pa.array([0] * n)), "ids": _ids_array([ids] * n)})

    schema = f"doc_id {id_type}, ids array<int>"
    if chunk is None:
        return rows.mapInArrow(whole, schema)
    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, schema)
    cuts = (rows.filter(F.length("text") > chunk).withColumn("h", F.xxhash64("text"))
            .mapInArrow(cut, f"doc_id {id_type}, h bigint, no int, start bigint, head bigint, tail bigint, last boolean, text string"))
    done = cuts.repartition("h", "no").mapInArrow(pieces, f"doc_id {id_type}, h bigint, no int, ids binary, at array<bigint>, before array<bigint>")
    return short.union(done.groupBy("doc_id", "h").applyInArrow(join, schema))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary) added: the bytes of ``ids``, in order."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                ids = b.column("ids")
                flat, cuts = ids.flatten().to_numpy(), np.asarray(ids.offsets) - ids.offsets[0].as_py()
                data, ends = c.decode(flat), np.concatenate([[0], np.cumsum(c.sizes[flat])])[cuts].tolist()
                out = [data[s:e] for s, e in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded binary")
