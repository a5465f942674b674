"""Target-distribution importance resampling: documents drawn by how much more likely the target makes their n-grams.

Features are the runs of 1 to ``N`` consecutive words of a text, hashed into ``BUCKETS`` buckets. A bucket's gain is the
logarithm of its smoothed share in the target over its share in the documents; a document's weight is the sum over its
features. Gumbel noise from the document's id turns the weights into scores whose largest are a draw without replacement.

A batch's texts are joined with a sentinel that is no word character, and one regular expression pass finds all words of
the batch, sentinels included. ``searchsorted`` of the words' places in the documents' offsets (the sentinels' places) tells
each word's document, and n-grams whose first word lies in another document than their last are masked before the bincount.

A feature's CRC-32 comes from its words': crc(a + " " + b) = shift(crc(a), 1 + len(b)) ^ crc(" " + b), where ``shift`` is
linear and read from tables, so all features of a batch are hashed in a few array operations.

Two scans of the documents: one sums the buckets (at most BUCKETS rows a task are shuffled), one adds up the gains. The
table of BUCKETS gains is all that the driver holds. Ranks come from range partitions and their sizes.

Null, empty and wordless texts have no features, weight 0 and are never drawn. Repeated rows are drawn each. A null doc_id
counts as an empty id and comes last in ties. Ties of score go to the smaller doc_id, then by weight and features.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwise.llm.common import pinned, utf8

N = 3
BUCKETS = 10_000
SEED = 42
#: Documents are drawn in percent of those with at least so many words.
PERCENT, LEAST_WORDS = 5, 20
#: Words of text in lower-case ASCII, where bytes from 0x80 belong to letters beyond ASCII; or the sentinel.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")
NO_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")
SENTINEL = b"\x00"
#: Bytes of text joined at once; a longer text goes in pieces that start with the N - 1 words before them.
BLOCK = 4 << 20
#: Words a worker remembers the checksums of; it starts anew beyond that.
REMEMBERED = 500_000
SHIFTS = 64
RANGE_ROWS = 1_000_000


# --- checksums of n-grams -------------------------------------------------------------------------------------------

def _shift_tables() -> np.ndarray:
    """[n, byte place, byte]: what a CRC-32 becomes when n more bytes follow, by the bytes of the checksum."""
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    step ^= step[0]                                    # without the initial and final complement
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])
    out = [now]
    for _ in range(SHIFTS):
        out.append(now := step[now & 255] ^ (now >> np.uint32(8)))
    return np.stack(out)


class Checksums:
    """CRC-32 of words and of n-grams, vectorised over a block; remembers a bounded number of words."""

    def __init__(self):
        self.tables = _shift_tables().reshape(-1)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {SENTINEL: 0}
        self.whole = self.after = np.zeros(1, np.uint32)         # crc of the word; of a space and the word
        self.length = np.zeros(1, np.int32)                      # of both

    def words(self, words: list[bytes]) -> np.ndarray:
        """Row of each word; the sentinel's is 0."""
        coded = pa.array(words, pa.binary()).dictionary_encode()
        different = coded.dictionary.to_pylist()
        rows = np.fromiter(map(self.known.get, different, repeat(-1)), np.int32, len(different))
        new = np.flatnonzero(rows < 0).tolist()
        if new and len(self.known) > REMEMBERED:
            self.forget()
            return self.words(words)
        if new:
            fresh = [different[k] for k in new]
            rows[new] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known.update(zip(fresh, rows[new].tolist()))
            self.whole = np.concatenate([self.whole, np.fromiter(map(zlib.crc32, fresh), np.uint32, len(fresh))])
            self.after = np.concatenate([self.after, np.fromiter(map(zlib.crc32, fresh, repeat(zlib.crc32(b" "))), np.uint32, len(fresh))])
            self.length = np.concatenate([self.length, np.fromiter(map(len, fresh), np.int32, len(fresh)) + 1])
        return rows[coded.indices.to_numpy()]

    def shift(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        if len(by) and by.max() > SHIFTS:
            crc, by = crc.copy(), by.copy()
            while len(far := np.flatnonzero(by > SHIFTS)):
                crc[far] = self._shifted(crc[far], np.full(len(far), SHIFTS, np.int32))
                by[far] -= SHIFTS
        return self._shifted(crc, by)

    def _shifted(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        at = crc.view(np.uint8).reshape(-1, 4)                   # little-endian: place 0 is the lowest byte
        base = by << 10
        out = self.tables[base + at[:, 0]]
        for place in (1, 2, 3):
            out ^= self.tables[base + (256 * place + at[:, place].astype(np.int32))]
        return out


def features(texts: list[bytes], checksums: Checksums, n: int = N, context: np.ndarray | None = None):
    """Features of a batch of texts without the sentinel -> (text number, checksum) of each, and each text's number of words.

    ``context``: so many words at the start of a text only precede others; features that end in them don't count.
    """
    found = checksums.words(WORD.findall(SENTINEL.join(texts)))
    offsets = np.flatnonzero(found == 0)                             # the sentinels' places among the words
    at = np.flatnonzero(found)
    of = np.searchsorted(offsets, at)
    words = np.bincount(of, minlength=len(texts))
    first = np.cumsum(words) - words                                 # each text's first word
    place = np.arange(len(at)) - first[of]
    found = found[at]
    least = np.zeros(len(at), np.int64) if context is None else context[of]
    crc, after, length = checksums.whole[found], checksums.after[found], checksums.length[found]
    out_of, out_crc = [], []
    for k in range(n):                                               # the run of k + 1 words that ends at each word
        if k:
            crc = np.concatenate([crc[:1], checksums.shift(crc[:-1], length[1:]) ^ after[1:]])
        inside = place >= np.maximum(least, k)
        out_of.append(of[inside])
        out_crc.append(crc[inside])
    return np.concatenate(out_of), np.concatenate(out_crc), words - (0 if context is None else context)


# --- batches --------------------------------------------------------------------------------------------------------

def blocks(datas: list[bytes], n: int) -> Iterator[tuple[list[int], list[bytes], np.ndarray]]:
    """Texts in blocks of about BLOCK bytes: their numbers, bytes and words of context.

    A text longer than a block is cut behind a byte that is no word character; each further piece begins with the n - 1
    words before it, as context.
    """
    numbers: list[int] = []
    parts: list[bytes] = []
    context: list[int] = []
    size = 0
    for i, data in enumerate(datas):
        at, before = 0, []
        while True:
            end = len(data)
            if end - at > BLOCK:
                cut = NO_WORD.search(data, at + BLOCK)
                end = cut.end() if cut else end
            piece = data[at:end]
            numbers.append(i)
            parts.append(b" ".join([*before, piece]))
            context.append(len(before))
            size += len(piece)
            if size >= BLOCK:
                yield numbers, parts, np.array(context)
                numbers, parts, context, size = [], [], [], 0
            if end == len(data):
                break
            before = [*before, *WORD.findall(piece)][1 - n:] if n > 1 else []
            at = end
    if numbers:
        yield numbers, parts, np.array(context)


def _datas(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for i in range(0, batch.num_rows, 512):
        part = batch.slice(i, 512)
        yield part, [utf8(t or "").lower().replace(SENTINEL, b" ") for t in part.column("text").to_pylist()]   # bytes: A-Z only


def bucket_counts(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checksums, total = Checksums(), np.zeros(buckets, np.int64)
        for b in batches:
            for _, datas in _datas(b):
                for _, parts, context in blocks(datas, n):
                    _, crc, _ = features(parts, checksums, n, context)
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]                  # at most one row a bucket
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))."""
    b = len(source)
    s_all, t_all = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the first 8 hexadecimal digits of sha256(``seed:doc_id``)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, n: int = N, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    buckets = np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checksums = Checksums()
        for b in batches:
            for part, datas in _datas(b):
                n_words, n_features, weight = (np.zeros(len(datas), np.int64) for _ in range(3))
                for numbers, parts, context in blocks(datas, n):
                    of, crc, words = features(parts, checksums, n, context)
                    of = np.array(numbers)[of]
                    np.add.at(n_words, numbers, words)
                    n_features += np.bincount(of, minlength=len(datas))
                    weight += np.bincount(of, gain[crc % buckets], len(datas)).astype(np.int64)   # exact below 2^53
                ids = part.column("doc_id")
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in (n_words, n_features, weight, score))],
                                                 names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             n: int = N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score and rank (null where not drawn).

    ``target``: a table with a column ``text``.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    scored = pinned(weights(docs, gain, n, seed))
    fits = F.col("n_words") >= least_words
    drawn = scored.filter(fits).count() * percent // 100
    order = [(~fits).cast("int"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-scored.count() // RANGE_ROWS))
    # The range bounds are sampled: rows and their range are written once, so both uses agree.
    dealt = pinned(scored.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))          # one row a range
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    return (dealt.join(F.broadcast(before), "part").withColumn("place", place)
            .select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank")))
