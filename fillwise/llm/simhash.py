"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit set where more than half of the XXH64 hashes of its shingles have it set. Fingerprints
link when they differ in at most ``MAX_BITS`` bits.

Candidates come from a table of Hamming distances to reference fingerprints (the pivots). By the triangle
inequality two fingerprints within d bits differ by at most d in every coordinate, so a pair with a larger
coordinate difference is discarded; survivors are verified on the fingerprints themselves.

The pivots are laid out so that the table also says which pairs to look at. Around one base pivot, the pivots of
quarter q flip the first 1, 2, ... 16 bits of that quarter of the base. The steps between their distances depend on
quarter q alone, so fingerprints that agree in a quarter have equal steps there. Two fingerprints at most two bits
apart agree in at least two of the four quarters: rows are dealt out by their steps in each of the six pairs of
quarters, and only rows of one bucket are compared. A further ``SPREAD`` pivots far from each other do the discarding.

Equal fingerprints are collapsed first (aggregated before the shuffle), so copies of a text cost one row, whatever
their number. A bucket emits a spanning forest of its links, never its pairs. Its rows are taken as sorted blocks of
``BLOCK`` and compared block by block, so memory does not grow with the bucket; a bucket of more than ``SPLIT``
fingerprints is dealt out again as pairs of blocks over many tasks.

Null or empty texts have fingerprint zero and link with each other. Rows with a null doc_id get a fingerprint but
are no document that could be kept or reached: their component_id is the smallest doc_id among the rows their
fingerprint reaches, or null. Repeated rows share a component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwise.llm.common import pinned, utf8
from fillwise.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SPREAD = 32           # pivots that discard pairs
BLOCK = 1_024         # fingerprints compared with each other at once
SPLIT = 8 * BLOCK     # larger buckets are dealt out by pairs of blocks
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one whole text; 0 without a word."""
    words = utf8(text).translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):   # bounded however long the text
        counts += np.unpackbits(h[i:i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, and its ``text_hash`` if there is one; fp holds the 64 bits as a signed BIGINT."""
    kept = [c for c in ("doc_id", "text_hash") if c in docs.columns]
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fp)], names=[*kept, "fp"])

    return docs.select(*kept, "text").mapInArrow(run, f"{fields}, fp bigint")


# --- pivots ---------------------------------------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15
QUARTER_PIVOTS = np.array([[BASE ^ (((1 << n) - 1) << (16 * q)) for n in range(17)] for q in range(4)], np.uint64)
SPREAD_PIVOTS = np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "big"), SEED) for i in range(SPREAD)], np.uint64)
QUARTER_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def distance_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, one row per fingerprint and one column per pivot."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :])


def bucket_keys(fp: np.ndarray) -> np.ndarray:
    """One BIGINT per fingerprint and pair of quarters: the steps (+1 or -1) of both rows of the pivot table."""
    steps = [np.diff(distance_table(fp, QUARTER_PIVOTS[q]).astype(np.int8), axis=1) > 0 for q in range(4)]
    packed = [np.packbits(s, axis=1).astype(np.int64) @ np.array([256, 1]) for s in steps]
    return np.stack([(i << 32) | (packed[a] << 16) | packed[b] for i, (a, b) in enumerate(QUARTER_PAIRS)], axis=1)


def _bucketed(batches):
    for b in batches:
        fp = b.column("fp").to_numpy()
        keys = bucket_keys(fp.view(np.uint64))
        n = keys.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, n))], names=["key", "fp"])


def close_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of x and y at most MAX_BITS apart: discard by the largest coordinate difference, verify the rest."""
    tx, ty = distance_table(x, SPREAD_PIVOTS).astype(np.int8), distance_table(y, SPREAD_PIVOTS).astype(np.int8)
    i, j = np.nonzero(np.abs(tx[:, None, 0] - ty[None, :, 0]) <= MAX_BITS)
    for p in range(1, SPREAD):
        if not len(i):
            break
        ok = np.abs(tx[i, p] - ty[j, p]) <= MAX_BITS
        i, j = i[ok], j[ok]
    ok = np.bitwise_count(x[i] ^ y[j]) <= MAX_BITS
    return i[ok], j[ok]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of links (a, b between 0 and n) that join two trees not joined before."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        u, v = root(u), root(v)
        if u != v:
            parent[max(u, v)] = min(u, v)
            keep.append(k)
    return np.array(keep, np.int64)


def bucket_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among sorted, different fingerprints, compared block by block."""
    us, vs = [], []
    for s in range(0, len(fp), BLOCK):
        for t in range(s, len(fp), BLOCK):
            i, j = close_pairs(fp[s:s + BLOCK], fp[t:t + BLOCK])
            i, j = i + s, j + t
            i, j = i[i < j], j[i < j]
            if len(i):
                local, where = np.unique(np.concatenate([i, j]), return_inverse=True)
                k = forest(where[:len(i)], where[len(i):], len(local))
                us.append(i[k])
                vs.append(j[k])
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    k = forest(u, v, len(fp))
    return fp[u[k]].view(np.int64), fp[v[k]].view(np.int64)


def _many_buckets(batches):
    """Whole buckets, sorted by key, several to a batch: links of each."""
    rest = None
    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = rest["key"].iloc[-1]
        whole, rest = rest[rest["key"] != last], rest[rest["key"] == last]
        yield _links_of(whole)
    if rest is not None:
        yield _links_of(rest)


def _links_of(pdf: pd.DataFrame) -> pd.DataFrame:
    key, fp = pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
    edges = np.flatnonzero(np.diff(key)) + 1
    start, end = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
    out_a, out_b = [], []
    # Buckets of two rows, by far the most, are compared together; the pivots discard, the fingerprints verify.
    two = start[end - start == 2]
    if len(two):
        x, y = fp[two], fp[two + 1]
        ok = (np.abs(distance_table(x, SPREAD_PIVOTS).astype(np.int8) - distance_table(y, SPREAD_PIVOTS).astype(np.int8)).max(axis=1) <= MAX_BITS)
        ok &= np.bitwise_count(x ^ y) <= MAX_BITS
        out_a.append(x[ok].view(np.int64))
        out_b.append(y[ok].view(np.int64))
    for s, e in zip(start[end - start > 2], end[end - start > 2]):
        a, b = bucket_links(np.sort(fp[s:e]))
        out_a.append(a)
        out_b.append(b)
    return pd.DataFrame({"a": np.concatenate(out_a) if out_a else np.zeros(0, np.int64),
                         "b": np.concatenate(out_b) if out_b else np.zeros(0, np.int64)})


def _block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks of a large bucket."""
    x = pdf[pdf["side"] == 0]["fp"].to_numpy().view(np.uint64)
    y = pdf[pdf["side"] == 1]["fp"].to_numpy().view(np.uint64)
    if pdf["lo"].iloc[0] == pdf["hi"].iloc[0]:
        y = x
    if not len(x) or not len(y):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    fps = np.unique(np.concatenate([x, y]))
    us, vs = [], []
    for s in range(0, len(x), BLOCK):
        for t in range(0, len(y), BLOCK):
            i, j = close_pairs(x[s:s + BLOCK], y[t:t + BLOCK])
            u, v = np.searchsorted(fps, x[i + s]), np.searchsorted(fps, y[j + t])
            u, v = u[u != v], v[u != v]
            k = forest(u, v, len(fps))
            us.append(u[k])
            vs.append(v[k])
    u, v = np.concatenate(us), np.concatenate(vs)
    k = forest(u, v, len(fps))
    return pd.DataFrame({"a": fps[u[k]].view(np.int64), "b": fps[v[k]].view(np.int64)})


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) links that connect all fingerprints at most MAX_BITS apart; ``distinct``: different fp."""
    dealt = pinned(distinct.select("fp").mapInArrow(_bucketed, "key bigint, fp bigint"))
    size = pinned(dealt.groupBy("key").count().filter("count > 1"))
    small = dealt.join(size.filter(F.col("count") <= SPLIT).select("key"), "key")
    small = small.repartition("key").sortWithinPartitions("key").mapInPandas(_many_buckets, "a bigint, b bigint")
    # Large buckets: block numbers from the fingerprint's hash, every pair of blocks a group of its own.
    large = dealt.join(size.filter(F.col("count") > SPLIT), "key").withColumn("blocks", F.ceil(F.col("count") / SPLIT).cast("int") + 1)
    mine = large.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = mine.select("key", "fp", F.explode(F.expr("""transform(sequence(0, blocks - 1), o -> struct(
        least(block, o) as lo, greatest(block, o) as hi, int(block > o) as side))""")).alias("p")).select("key", "fp", "p.*")
    return small.union(pairs.groupBy("key", "lo", "hi").applyInPandas(_block_pair, "a bigint, b bigint"))


def groups(fps: DataFrame) -> DataFrame:
    """(fp, component, component_id) of every fingerprint of ``fps`` (pinned doc_id, fp): the smallest doc_id reachable."""
    distinct = pinned(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # Links between fingerprints; the component of fingerprints first, its smallest document after.
    comp = pinned(components(links(distinct)))
    named = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.select("fp", "component").join(smallest, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    fps = pinned(fingerprints(docs.select("doc_id", "text")))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(groups(fps), "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but one row of each group: the document with the smallest doc_id.

    Rows are told apart by doc_id and text, so that of rows which share an id but belong to different groups each is
    judged with its own group. A null doc_id comes last. Of equal ids in a group the smallest text hash stays, of repeated
    rows the one with the smallest row hash.
    """
    text = F.xxhash64("text").alias("text_hash")
    fps = pinned(fingerprints(docs.select("doc_id", "text", text)))
    of = fps.groupBy("doc_id", "text_hash", "fp").agg(F.count(F.lit(1)).alias("n")).join(groups(fps), "fp")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    # A document and text belong to one group, so the winners are told by these: no join on a group, however large it is.
    best = of.groupBy("component").agg(F.min(place).alias("best")).select(
        F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash"), F.lit(True).alias("first"))
    judged = of.join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash")), "left")
    gone = pinned(judged.filter("first is null or n > 1").select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), F.coalesce("first", F.lit(False)).alias("first"), "n"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), text)
    left = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left").filter("first is null or first")
    if gone.filter("n > 1").isEmpty():
        return left.select("row.*")
    order = Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64(F.to_json("row")))
    repeated = left.filter("n > 1").withColumn("r", F.row_number().over(order)).filter("r = 1")
    return left.filter("n is null or n = 1").select("row.*").union(repeated.select("row.*"))
