"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts anywhere else in the collection.

The suffix order, the collection's Burrows-Wheeler symbols and the common prefixes are built column by column for many
texts at once: each round inserts the next symbol (from the right) of every text, sorts the texts stably by it on top of
the previous round's order, and takes each common prefix as one more than the smallest prefix between the two neighbours
in the previous order. The columns are a sequential file of the task (in memory up to ``SPOOL`` bytes), read once from
front to back; order and prefixes of one round are all that is held besides.

Run over whole documents this needs as many rounds as the longest has bytes. So the texts inserted are *pieces*.
Of each window of ``length`` bytes the K-byte gram (K: a sixth of it) with the smallest hash (leftmost among equals) is its anchor. Windows in a
row with the same anchor form a piece of at most 2 * length - K bytes. The anchor depends on the window's bytes alone, so
equal windows have equal anchors at equal offsets: aligned at their anchors, equal windows start in the same column
of pieces with the same anchor, and a round has to order only the suffixes that start in its column. At most
2 * length - K rounds find every repeat, whatever the length of the documents.

1. Every text gives its pieces as hashes (about one row in 170 bytes); anchors seen once are dropped after an aggregation.
2. Equal pieces are counted, not compared: all their windows repeat. An anchor with one distinct piece is done.
3. One occurrence of each distinct piece of the other anchors is cut out of its text and dealt out by anchor; tasks
   build the suffix order of whole anchors, many to a collection, and report windows whose neighbours share ``length`` bytes.
4. An anchor with more than ``HOT`` distinct pieces (a passage in very many documents, each time between other words)
   is split down to its windows, counted by hash with map-side aggregation. No anchor gathers in one task.

Null texts are empty. Each row is a document, also a repeated one, whose text then occurs twice. Rows are told apart
by doc_id and text hash; doc_id may be null.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwise.llm.common import pinned, utf8

LENGTH = 400
#: Cutting whole texts: no passage of 50 words is shorter than this, unless its words have fewer than 3 letters.
PASSAGE = 200


def gram_size(length: int) -> int:
    """Bytes of an anchor: the largest power of two up to a sixth of the window."""
    return 1 << ((length // 6).bit_length() - 1)


K = gram_size(LENGTH)
REACH = LENGTH - K                 # an anchor lies at most so far into a window
BLOCK = 1 << 19                    # bytes of text hashed at once
HOT = 20_000                       # distinct pieces of one anchor, beyond which it is split
COLLECTION = 8_192                 # pieces ordered together, at least one whole anchor
SPOOL = 64 << 20
POS_BITS = 22
MIX = np.uint64(0xD6E8FEB86659FD93)
NO_ID = -(1 << 63)                 # stands for a null doc_id in keys


# --- anchors and pieces ---------------------------------------------------------------------------------------------

def gram_hashes(buf: np.ndarray, size: int = K) -> np.ndarray:
    """64-bit hash of the ``size`` bytes (a power of two) from each position, by doubling."""
    h = buf.astype(np.uint64) + np.uint64(1)
    factor, n = 0x9E3779B97F4A7C15, 1
    while n < size:
        h = h[:-n] * np.uint64(factor) + h[n:]
        factor, n = factor * factor % (1 << 64), 2 * n
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def window_minimum(v: np.ndarray, width: int) -> np.ndarray:
    m, n = v, 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    return np.minimum(m[:len(v) - width + 1], m[width - n:]) if n < width else m


def pieces(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in texts that lie back to back, ending at ``ends``.

    -> first window, number of windows, anchor position, anchor hash of each run.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none
    h = gram_hashes(buf, gram_size(length))
    at = np.uint64((1 << POS_BITS) - 1)
    best = window_minimum((h & ~at) | np.arange(len(h), dtype=np.uint64), length - gram_size(length) + 1)
    sizes = np.diff(np.concatenate([[0], ends]))
    limit = np.repeat(ends, sizes)[:len(best)]
    ok = np.flatnonzero(np.arange(length, length + len(best)) <= limit)
    if not len(ok):
        return none, none, none, none
    anchor = (best[ok] & at).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    count = np.diff(np.concatenate([first, [len(ok)]]))
    anchor = anchor[first]
    return ok[first], count, anchor, h[anchor].view(np.int64)


def _blocks(datas: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts (number, offset, bytes) in blocks of about BLOCK bytes; a longer text is cut with length - 1 bytes of overlap."""
    block, size = [], 0
    for i, data in enumerate(datas):
        for s in range(0, max(1, len(data) - length + 1), BLOCK):
            part = data[s:s + BLOCK + length - 1]
            if len(part) < length:
                continue
            block.append((i, s, part))
            size += len(part)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def text_runs(datas: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Rows (text number, first window, windows per piece, repetitions, anchor hash, piece hash) of texts.

    Equal pieces in a row (periodic text) are one row.
    """
    out = []
    for block in _blocks(datas, length):
        joined = b"".join(p for _, _, p in block)
        sizes = np.array([len(p) for _, _, p in block])
        ends = np.cumsum(sizes)
        start, count, _, mh = pieces(np.frombuffer(joined, np.uint8), ends, length)
        if not len(start):
            continue
        digest = xxhash.xxh3_64_intdigest
        ph = np.fromiter((digest(joined[a:b]) for a, b in zip(start.tolist(), (start + count + length - 1).tolist())), np.uint64, len(start)).view(np.int64)
        which = np.searchsorted(ends, start, side="right")
        same = np.zeros(len(start), bool)
        same[1:] = (ph[1:] == ph[:-1]) & (mh[1:] == mh[:-1]) & (count[1:] == count[:-1]) & (start[1:] == start[:-1] + count[:-1]) & (which[1:] == which[:-1])
        first = np.flatnonzero(~same)
        reps = np.diff(np.concatenate([first, [len(start)]]))
        number, offset = np.array([i for i, _, _ in block]), np.array([s for _, s, _ in block])
        w = which[first]
        out.append(np.stack([number[w], start[first] - (ends - sizes)[w] + offset[w], count[first], reps, mh[first], ph[first]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 6), np.int64)


# --- suffix order of aligned pieces, column by column ---------------------------------------------------------------

def range_minimum(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(d[lo..hi]) of closed ranges, by doubling up to the longest range asked for."""
    out = d[hi].copy()
    size = hi - lo + 1
    table, n = d, 1
    todo = np.flatnonzero(size > 1)
    while len(todo):
        mine = todo[size[todo] < 2 * n]
        out[mine] = np.minimum(table[lo[mine]], table[hi[mine] - n + 1])
        todo = todo[size[todo] >= 2 * n]
        table, n = np.minimum(table[:-n], table[n:]) if len(todo) else table, 2 * n
    return out


def repeated_windows(texts: list[bytes], left: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each piece and window offset from its anchor, whether another piece of its group has the same window there.

    ``left``: bytes before each piece's anchor. ``group``: anchor numbers. -> bool (columns 0..reach, pieces); the
    window of piece i that starts at byte s is in column reach - left[i] + s.
    """
    reach = length - gram_size(length)
    m, width = len(texts), reach + length
    first = reach - left
    size = np.fromiter(map(len, texts), np.int64, m)
    last = first + size - 1
    rows = np.zeros((m, width), np.uint8)
    for i, t in enumerate(texts):
        rows[i, first[i]:first[i] + len(t)] = np.frombuffer(t, np.uint8)
    found = np.zeros((reach + 1, m), bool)
    entering = np.argsort(-last, kind="stable")
    enter_at = -last[entering]
    order, prefix = np.zeros(0, np.int64), np.zeros(0, np.int32)
    with tempfile.SpooledTemporaryFile(max_size=SPOOL) as columns:
        columns.write(np.ascontiguousarray(rows.T[::-1]).tobytes())
        del rows
        columns.seek(0)
        for c in range(width - 1, -1, -1):
            symbol = np.frombuffer(columns.read(m), np.uint8)
            new = entering[np.searchsorted(enter_at, -c):np.searchsorted(enter_at, -c, side="right")]
            if len(new):            # their suffixes so far are empty and come first
                order, prefix = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.int32), prefix])
            live = np.flatnonzero(first[order] <= c)
            if not len(live):
                order, prefix = order[:0], prefix[:0]
                continue
            # The symbols in this order are the round's Burrows-Wheeler symbols: each stands before its suffix.
            key = group[order[live]] * 256 + symbol[order[live]]
            by = np.argsort(key, kind="stable")
            pos, key = live[by], key[by]
            shared = np.zeros(len(pos), np.int32)
            same = np.flatnonzero(key[1:] == key[:-1]) + 1
            shared[same] = range_minimum(prefix, pos[same - 1] + 1, pos[same]) + 1
            order, prefix = order[pos], shared
            if c <= reach:
                twin = shared >= length
                found[c, order[twin]] = True
                found[c, order[np.flatnonzero(twin) - 1]] = True
    return found


def true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


# --- the Spark job --------------------------------------------------------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            datas = [utf8(t or "") for t in part.column("text").to_pylist()]
            k2 = np.fromiter((xxhash.xxh3_64_intdigest(d) for d in datas), np.uint64, len(datas)).view(np.int64)
            r = text_runs(datas, length)
            n = r[:, 0]
            k1 = part.column("k1").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[n]), pa.array(k2[n]), pa.array(r[:, 1]), pa.array((r[:, 3] << 16) | r[:, 2]), pa.array(r[:, 4]), pa.array(r[:, 5])],
                names=["k1", "k2", "start", "run", "mh", "ph"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: what is shuffled shrinks to less than half."""
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            datas = [utf8(t or "") for t in part.column("text").to_pylist()]
            k2 = np.fromiter((xxhash.xxh3_64_intdigest(d) for d in datas), np.uint64, len(datas)).view(np.int64)
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(k2), pa.array([z.compress(d) for d in datas], pa.binary())],
                                             names=[*names, "k2", "z"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a text: (k1, k2, start, run, mh, ph, n, dn, left, piece).

    Repeated rows of a document follow each other and are cut once; another one would only repeat a piece whose
    count already says that it repeats.
    """
    z = zstandard.ZstdDecompressor()
    before = None
    for b in batches:
        for row in b.to_pylist():
            if before == (before := (row["k1"], row["k2"])):
                continue
            data = z.decompress(row["z"])
            rows = row["want"]
            texts = [data[r["start"]:r["start"] + (r["run"] & 0xFFFF) + length - 1] for r in rows]
            left = []
            for t in texts:      # the anchor again, from the piece's first window
                h = gram_hashes(np.frombuffer(t[:length], np.uint8), gram_size(length))
                left.append(int(np.argmin(h >> np.uint64(POS_BITS))))
            yield pa.RecordBatch.from_pydict({
                "k1": pa.array([row["k1"]] * len(rows), pa.int64()), "k2": pa.array([row["k2"]] * len(rows), pa.int64()),
                **{c: pa.array([r[c] for r in rows], pa.int64()) for c in ("start", "run", "mh", "ph", "n", "dn")},
                "left": pa.array(left, pa.int64()), "piece": pa.array(texts, pa.binary())})


def _order(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by anchor -> removed spans (k1, k2, s, e) of pieces that occur once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < COLLECTION:
            continue
        t = pa.Table.from_batches(held)
        mh = t.column("mh").to_numpy()
        whole = int(np.searchsorted(mh, mh[-1]))           # the last anchor may go on
        if whole:
            yield _spans(t.slice(0, whole), length)
        held = t.slice(whole).combine_chunks().to_batches()
    if held:
        yield _spans(pa.Table.from_batches(held), length)


def _spans(t: pa.Table, length: int) -> pa.RecordBatch:
    mh, left, n, start, k1, k2 = (t.column(c).to_numpy() for c in ("mh", "left", "n", "start", "k1", "k2"))
    group = np.cumsum(np.concatenate([[0], np.diff(mh) != 0]))
    texts = t.column("piece").to_pylist()
    found = repeated_windows(texts, left, group, length)
    reach = length - gram_size(length)
    out: list[tuple] = []
    for i in np.flatnonzero((n == 1) & found.any(axis=0)).tolist():
        shift = int(start[i]) - (reach - int(left[i]))
        out += [(k1[i], k2[i], shift + a, shift + b + length - 1) for a, b in true_runs(found[:, i])]
    cols = list(zip(*out)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "s", "e"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Single windows of the pieces of very common anchors."""
    for b in batches:
        for r in b.to_pylist():
            count = r["run"] & 0xFFFF
            w = np.fromiter((xxhash.xxh3_64_intdigest(r["piece"][i:i + length], seed=(r["left"] - i) & 0xFFFF) for i in range(count)), np.uint64, count).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "mh": pa.array([r["mh"]] * count, pa.int64()), "w": pa.array(w), "n": pa.array([r["n"]] * count, pa.int64()),
                "k1": pa.array([r["k1"]] * count, pa.int64()), "k2": pa.array([r["k2"]] * count, pa.int64()),
                "s": pa.array(r["start"] + np.arange(count)), "e": pa.array(r["start"] + np.arange(count) + length)})


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans) of the texts with repeated bytes; spans: array of struct(s, e), half-open, overlapping."""
    runs = pinned(docs.select(_key(), "text").mapInArrow(partial(_runs, length=length), "k1 bigint, k2 bigint, start bigint, run bigint, mh bigint, ph bigint"))
    reps = F.shiftright("run", 16)
    seen = (runs.groupBy("mh").agg(F.sum(reps).alias("n"), F.min("ph").alias("lo"), F.max("ph").alias("hi"))
            .filter("n > 1").select("mh", (F.col("lo") != F.col("hi")).alias("several")))
    again = pinned(runs.join(seen, "mh"))
    span = [F.col("start").alias("s"), (F.col("start") + reps * F.col("run").bitwiseAND(0xFFFF) + (length - 1)).alias("e")]
    done = again.filter("not several").select("k1", "k2", *span)

    distinct = pinned(again.filter("several").groupBy("mh", "ph").agg(F.sum(reps).alias("n"), F.min(F.struct("k1", "k2", "start", "run")).alias("at")))
    per_anchor = distinct.groupBy("mh").agg(F.count(F.lit(1)).alias("dn"))
    copies = again.filter("several").join(distinct.filter("n > 1").select("mh", "ph"), ["mh", "ph"], "left_semi").select("k1", "k2", *span)

    # One occurrence of each distinct piece, cut out of its text.
    want = (distinct.join(per_anchor, "mh").select("at.k1", "at.k2", F.struct("at.start", "at.run", "mh", "ph", "n", "dn").alias("p"))
            .groupBy("k1", "k2").agg(F.collect_list("p").alias("want")))
    texts = docs.select(_key(), "text").mapInArrow(_packed, "k1 bigint, k2 bigint, z binary")
    cut = want.join(texts, ["k1", "k2"]).mapInArrow(
        partial(_cut, length=length), "k1 bigint, k2 bigint, start bigint, run bigint, mh bigint, ph bigint, n bigint, dn bigint, left bigint, piece binary")
    hot = not per_anchor.filter(F.col("dn") > HOT).isEmpty()
    if hot:
        cut = pinned(cut)
    found = (cut.filter(F.col("dn") <= HOT).repartition("mh").sortWithinPartitions("mh")
             .mapInArrow(partial(_order, length=length), "k1 bigint, k2 bigint, s bigint, e bigint"))
    parts = done.union(copies).union(found)
    if hot:
        w = cut.filter(F.col("dn") > HOT).mapInArrow(partial(_windows, length=length), "mh bigint, w bigint, n bigint, k1 bigint, k2 bigint, s bigint, e bigint")
        twice = w.groupBy("mh", "w").agg(F.sum("n").alias("all")).filter("all > 1").select("mh", "w")
        parts = parts.union(w.filter("n = 1").join(twice, ["mh", "w"], "left_semi").select("k1", "k2", "s", "e"))
    return parts.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _removed(size: int, spans) -> np.ndarray:
    """Mask of the removed bytes."""
    edge = np.zeros(size + 1, np.int64)
    if spans:
        np.add.at(edge, [x["s"] for x in spans], 1)
        np.subtract.at(edge, [x["e"] for x in spans], 1)
    return np.cumsum(edge)[:-1] > 0


def _with_spans(docs: DataFrame, length: int, *keep: str) -> DataFrame:
    """``keep`` columns, text compressed in z, and spans of each row of ``docs`` (doc_id, text and keep)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    fields = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    rows = docs.select(*keep, _key(), "text").mapInArrow(_packed, f"{fields}k1 bigint, k2 bigint, z binary")
    return rows.join(repeats(docs, length), ["k1", "k2"], "left")


def dedup(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed (array of maximal half-open byte spans), kept (binary).

    With ``passage``, another column ``passages`` has the maximal spans that are covered by repeats of so many bytes.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = _with_spans(docs, length, "doc_id")
    if passage:
        rows = rows.join(repeats(docs, passage).withColumnRenamed("spans", "short"), ["k1", "k2"], "left")
    span = "array<struct<s: bigint, e: bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sizes, removed, kept, short = [], [], [], []
                for k, (packed, spans) in enumerate(zip(part.column("z").to_pylist(), part.column("spans").to_pylist())):
                    data = z.decompress(packed)
                    gone = _removed(len(data), spans)
                    sizes.append(len(data))
                    removed.append([{"s": s, "e": e} for s, e in true_runs(gone)])
                    kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                    if passage:
                        short.append([{"s": s, "e": e} for s, e in true_runs(_removed(len(data), part.column("short")[k].as_py()))])
                kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary()), *([pa.array(short, kind)] if passage else [])],
                    names=["doc_id", "n_bytes", "removed", "kept", *(["passages"] if passage else [])])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, removed {span}, kept binary" + (f", passages {span}" if passage else ""))


def cut_repeats(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """``docs`` with its columns, the repeated bytes taken out of ``text`` and ``n_chars`` (if there) counted anew.

    A character goes when all its bytes go, so texts stay valid. Null texts stay null.
    """
    packed = docs.select("doc_id", "text", F.struct("*").alias("row"))
    row = packed.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = []
                for packed, spans in zip(part.column("z").to_pylist(), part.column("spans").to_pylist()):
                    data = z.decompress(packed)
                    if spans:
                        raw = np.frombuffer(data, np.uint8)
                        begins = np.flatnonzero((raw & 0xC0) != 0x80)
                        size = np.diff(np.concatenate([begins, [len(raw)]]))
                        lost = np.add.reduceat(_removed(len(raw), spans).astype(np.int64), begins) == size
                        data = raw[~np.repeat(lost, size)].tobytes()
                    texts.append(data.decode("utf-8"))
                yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(texts, pa.string())], names=["rest", "t"])

    others = [f.name for f in row.fields if f.name != "text"]
    null = F.col("row.text").isNull().alias("was_null")
    slim = packed.select("doc_id", "text", F.struct(null, *[F.col("row").getField(c).alias(c) for c in others]).alias("rest"))
    kind = slim.schema["rest"].dataType.simpleString()
    done = _with_spans(slim, length, "rest").mapInArrow(run, f"rest {kind}, t string")
    text = F.when(~F.col("rest.was_null"), F.col("t"))
    value = {"text": text, "n_chars": F.when(~F.col("rest.was_null"), F.length("t")).cast("long")}
    return done.select(*[(value[f.name] if f.name in value else F.col("rest").getField(f.name)).alias(f.name) for f in row.fields])
