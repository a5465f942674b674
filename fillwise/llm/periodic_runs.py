"""Periodic runs of words: maximal stretches that repeat with a smallest period, found on a harmonic grid.

A run with period q and at least 2q words holds a multiple of q (counted from the text's start) among its first q words.
So for each q the places 0, q, 2q, ... are candidates, n ln n in all. From a candidate i the words before and behind i and
i + q are compared as far as they agree; with at least q words of agreement that is a run. The extensions are exact: two
queries to run-length grammars (``recompression``) of the words, forwards and backwards.

As a run of at least LEAST words agrees with itself q words on in at least LEAST / 2 words, LEAST / 4 of them lie before or
behind the candidate. Candidates where neither three words before nor three behind agree (by a hash) are passed over; texts
without any candidate need no grammar. Of equal stretches the smallest period counts.

Each text is a job of its own: nothing is shuffled. Texts are taken in blocks, grid points in chunks of bounded size.
Null and wordless texts have no words and no runs. doc_id may be null; repeated rows are each answered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwise.llm.recompression import Grammar

#: Fewest words of a run; at least twice its period, too.
LEAST = 12
#: Words that must agree (by hash) before or behind a candidate: LEAST / 4.
GRAM = 3
#: Bytes of text taken at once, at least one text, and grid points looked at together.
BLOCK = 4 << 20
POINTS = 1 << 21
#: Candidates kept between the search for them and the queries.
HELD = 1 << 22
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
WORD = "[^\\x20\\x09-\\x0D]+"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of texts, their numbers (equal words, equal numbers), and where each text's words begin and end."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    full = pc.not_equal(flat, "")
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    flat = flat.filter(full).combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat.filter(full)
    return flat, flat.dictionary_encode().indices.to_numpy().astype(np.int64), kept[ends]


def grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of texts of so many words, in chunks: (text number, place, period)."""
    halves = sizes // 2
    text = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    count = sizes[text] // period
    total = np.cumsum(count)
    at = 0
    while at < len(count):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + POINTS, side="right")))
        c = count[at:to]
        rank = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        q = np.repeat(period[at:to], c)
        yield np.repeat(text[at:to], c), rank * q, q
        at = to


def _gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the GRAM words from each place; places with fewer words behind them are left out."""
    h = np.zeros(max(0, len(words) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        h = (h * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(h)].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
    return h


def candidates(words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grid points (text, place in the text, period) near which GRAM words seem to agree."""
    sizes, begins = np.diff(ends), ends[:-1]
    if not len(words):
        return
    gram = _gram_hashes(words)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = owner[GRAM - 1:] == owner[:len(gram)]
    twice = pd.Series(gram + owner[:len(gram)].astype(np.uint64) * np.uint64(0x165667B19E3779F9)).duplicated().to_numpy() & whole
    may = np.zeros(len(sizes), bool)
    may[owner[:len(gram)][twice]] = True                                     # the others agree nowhere
    may &= sizes >= LEAST
    some = np.flatnonzero(may)
    for t, i, q in grid(sizes[some]):
        t = some[t]
        x = begins[t] + i
        ahead = i + q + GRAM <= sizes[t]
        ahead[ahead] = gram[x[ahead]] == gram[(x + q)[ahead]]
        behind = (i >= GRAM) & ~ahead
        behind[behind] = gram[x[behind] - GRAM] == gram[(x + q)[behind] - GRAM]
        hit = ahead | behind
        if hit.any():
            yield t[hit], i[hit], q[hit]


def find_runs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period."""
    has, found = np.zeros(len(ends) - 1, bool), []
    for chunk in candidates(words, ends):
        has[chunk[0]] = True
        if found is not None:
            found.append(chunk)
            if sum(len(t) for t, _, _ in found) > HELD:                       # too many to keep: they are looked for again
                found = None
    texts = np.flatnonzero(has)
    if not len(texts):
        return np.zeros((0, 4), np.int64)
    sizes, begins = np.diff(ends)[texts], ends[:-1][texts]
    # The texts with candidates, each followed by a symbol that occurs nowhere else.
    place = np.cumsum(sizes + 1) - sizes - 1
    joined = np.empty(int(sizes.sum()) + len(texts), np.int64)
    top = int(words.max()) + 1
    joined[place + sizes] = top + np.arange(len(texts))
    spots = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[np.repeat(place, sizes) + spots] = words[np.repeat(begins, sizes) + spots]
    forward, backward = Grammar(joined), Grammar(joined[::-1])
    rows = []
    for t, i, q in candidates(words, ends) if found is None else found:
        x = place[np.searchsorted(texts, t)] + i
        n = forward.extension(x, x + q)
        m = backward.extension(len(joined) - x - q, len(joined) - x)
        row = np.stack([t, i - m, n + m + q, q], axis=1)[n + m >= q]
        rows.append(row[np.concatenate([[True], (row[1:] != row[:-1]).any(axis=1)])[:len(row)]])   # a run's candidates follow each other
    rows = np.unique(np.concatenate(rows), axis=0)                            # smallest period first among equal stretches
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first & (rows[:, 2] >= LEAST)]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapsed(flat: pa.Array, ends: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Texts of the words that no run holds behind its first period, joined by one space."""
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, ends[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
    np.subtract.at(edge, ends[rows[:, 0]] + rows[:, 1] + rows[:, 2], 1)
    kept = np.cumsum(edge)[:-1] == 0
    to = np.concatenate([[0], np.cumsum(kept)])[ends]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(to, pa.int64()), flat.filter(pa.array(kept))), " ")


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, side="right")))
        yield batch.slice(at, to - at)
        at = to


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (by start, then period) and the text without repetitions."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _blocks(b):
                flat, words, ends = words_of(part.column("text"))
                rows = find_runs(words, ends)
                at = np.searchsorted(rows[:, 0], np.arange(part.num_rows + 1))
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3)], names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends)), runs, collapsed(flat, ends, rows).cast(pa.string())],
                                                 names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where every tenth text, by the CRC-32 of its id, repeats its words from some word on.

    With h the checksum and g = h // 10, words from a = g % n on have the period 1 + (n - a) // (3 + g % 8). Texts of other
    documents, of null ids and without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # A transform over an array of one element binds the words once.
    text = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(text, F.col("text"))).otherwise(F.col("text")).alias("text"))
