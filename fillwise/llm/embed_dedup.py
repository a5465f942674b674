"""Embedding near-dedup by sorted projection passes.

In each pass a vector's key is the concatenation of ``BITS`` random-hyperplane hash bits. Vectors are range-partitioned
and sorted by it, so that near ones tend to stand near each other, and each is compared, by cosine in double
precision, with the ``NEIGHBOURS`` vectors before it; partitions hand the rows at their ends to a second comparison.
Pairs at or above ``COSINE`` are links. Passes use independent hyperplanes; their first number is the least that
misses a link at the threshold with probability ``MISS`` if vectors lie evenly around the origin (it grows with the
logarithm of the number of vectors).

Where vectors crowd in one direction, windows fill up with unlinked ones. So each pass measures for each vector the bits
that narrow its surroundings down to a window: a link that agrees on them is met, the likelier the farther the vector
lies from their planes. Vectors whose chance of a miss over all passes is above ``MISS`` are crowded. Links to other vectors are met from the other side, so the crowded ones are
compared among themselves: pair by pair where that is cheaper, by as many further passes as their measure asks for
otherwise, until none is left. Pairs of one component need no further link and are skipped.
Components are taken over the links of all passes.

The passes only have to connect. Within a component every pair is then judged exactly, so that n_links counts all
links of a vector also where far more than NEIGHBOURS vectors lie together. Components of more than ``CELL`` vectors
are cut into cells by the angle to the component's first vector: by the triangle inequality some pairs of cells lie
within the threshold angle and others beyond it altogether. Those are counted or left out as they stand; the
rest are compared cell by cell, each pair of cells a group of its own.

Equal vectors are collapsed first and counted with their multiplicity. Null or zero vectors, vectors with a null or
non-finite component and rows with a null vec_id link with nothing. Vectors of different lengths do not link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwise.llm.common import MOST_TASKS, pinned
from fillwise.llm.components import components
from fillwise.llm.simhash import forest

COSINE = 0.9
BITS = 64
NEIGHBOURS = 64
MISS = 0.003
CELL = 512
BLOCK = 4096                               # crowded vectors compared pair by pair in one group
ROW_PASS = 512                             # pairs compared in blocks at about the cost of one vector in one pass
GRID = np.linspace(0, 8, 4097)             # logarithms of the normal distribution function
LOG_NORMAL = np.log([(1 + math.erf(t / math.sqrt(2))) / 2 for t in GRID])
UNKNOWN = BITS + 1                         # bits of a vector with fewer than NEIGHBOURS on one side in its partition
ANGLE = math.acos(COSINE)
BINS = 16                                  # cells per threshold angle
SAFE = 1e-7                                # rounding of angles


def passes(n: int) -> int:
    """Passes after which a pair at the threshold is missed with probability MISS among ``n`` vectors."""
    apart = math.log2(max(n / NEIGHBOURS, 2))                      # bits that narrow n down to a window
    found = (1 - ANGLE / math.pi) ** apart
    return math.ceil(math.log(MISS) / math.log1p(-found))


def planes(number: int, dims: int) -> np.ndarray:
    return np.random.default_rng([number, dims]).standard_normal((dims, BITS))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long list<float> vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)                   # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def order_keys(x: np.ndarray, number: int) -> np.ndarray:
    """Order-preserving BIGINT of the hash bits of one pass."""
    bits = np.packbits(x @ planes(number, x.shape[1]) >= 0, axis=1)
    return (np.ascontiguousarray(bits).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _keyed(numbers: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array([len(v) for v in b.column("v")]) if b.num_rows else np.zeros(0, int)
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = unit(matrix(part.column("v")))
                for p in numbers:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), p, np.int32)), pa.array(np.full(len(x), d, np.int32)), pa.array(order_keys(x, p)), part.column("id"), part.column("v")],
                        names=["p", "d", "key", "id", "v"])
    return run


def neighbour_links(x: np.ndarray, lane: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at most NEIGHBOURS apart, of one lane (pass and length), at or above COSINE; the later one from ``fresh`` on."""
    us, vs = [], []
    for o in range(1, min(NEIGHBOURS, len(x) - 1) + 1):
        lo = max(fresh, o)
        ok = (np.einsum("ij,ij->i", x[lo:], x[lo - o:len(x) - o]) >= COSINE) & (lane[lo:] == lane[lo - o:len(x) - o])
        at = np.flatnonzero(ok) + lo
        us.append(at - o)
        vs.append(at)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))


def narrowing_bits(key: np.ndarray, lane: np.ndarray, fresh: int) -> np.ndarray:
    """Of each row from ``fresh`` on: key bits that keep all rows but the NEIGHBOURS before it out; UNKNOWN for the
    first rows of a lane or partition. The bits for the rows after it are those of the row NEIGHBOURS further on.
    """
    at = np.arange(fresh, len(key))
    back = np.maximum(at - NEIGHBOURS, 0)
    differ = (key[at] ^ key[back]).view(np.uint64)
    bits = np.full(len(at), 1)                                     # 1 + the leading bits that agree
    for half in (32, 16, 8, 4, 2, 1):
        same = differ >> np.uint64(64 - half) == 0
        bits[same] += half
        differ = np.where(same, differ << np.uint64(half), differ)
    bits[key[at] == key[back]] = BITS
    bits[(at < NEIGHBOURS) | (lane[at] != lane[back])] = UNKNOWN
    return bits


def log_miss(x: np.ndarray, bits: np.ndarray, number: int) -> np.ndarray:
    """Logarithm of the chance that a pass does not show each vector a partner at the threshold, in a random direction from it."""
    far = np.abs(x @ planes(number, x.shape[1])) / math.tan(ANGLE)
    alike = np.cumsum(np.interp(far, GRID, LOG_NORMAL), axis=1)
    met = np.exp(alike[np.arange(len(x)), np.minimum(bits, BITS) - 1])
    return np.where(bits == UNKNOWN, 0.0, np.log1p(-np.minimum(met, 1 - 1e-9)))


def _window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> links (kind 0), the rows at both ends of the partition (kind 1: its first, 2: its last) and log_miss (3)."""
    part = TaskContext.get().partitionId()
    none = pa.array([], pa.list_(pa.float32()))

    def rows(kind, a, b, lane, v, log=None):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)),
                                           pa.array(np.asarray(lane, np.int64)), pa.array(np.full(n, part, np.int32)), v, pa.array(np.zeros(n) if log is None else log)],
                                          names=["kind", "a", "b", "lane", "part", "v", "log"])

    held: pa.Table | None = None
    seen, bits = 0, np.zeros(0, int)
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        fresh = 0 if held is None else held.num_rows
        ids = t.column("id").to_numpy()
        lane = (t.column("p").to_numpy().astype(np.int64) << 32) | t.column("d").to_numpy()
        vectors = t.column("v").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        bits = np.concatenate([bits, narrowing_bits(t.column("key").to_numpy(), lane, fresh)])
        done = max(0, t.num_rows - NEIGHBOURS)                     # rows whose surroundings on both sides are here
        wider = np.maximum(bits[:done], bits[NEIGHBOURS:])
        sizes = np.unique(lane & 0xFFFFFFFF)
        for d in sizes:                                            # one length but at the border of two
            at = np.flatnonzero((lane & 0xFFFFFFFF) == d)
            x = unit(matrix(vectors.take(pa.array(at))))
            i, j = neighbour_links(x, lane[at], int((at < fresh).sum()))
            keep = forest(i, j, len(at))
            for q in np.unique(lane[at[at < done]]):
                mine = np.flatnonzero((lane[at] == q) & (at < done))
                yield rows(3, ids[at[mine]], np.zeros(len(mine)), np.zeros(len(mine)), pa.array([None] * len(mine), none.type),
                           log_miss(x[mine], wider[at[mine]], int(q >> 32)))
            yield rows(0, ids[at[i[keep]]], ids[at[j[keep]]], np.zeros(len(keep)), pa.array([None] * len(keep), none.type))
        if seen < NEIGHBOURS:
            head = min(t.num_rows - fresh, NEIGHBOURS - seen)
            pick = np.arange(fresh, fresh + head)
            yield rows(1, ids[pick], seen + np.arange(head), lane[pick], vectors.take(pa.array(pick)))
        seen += b.num_rows
        held, bits = t.slice(done), bits[done:]
    if held is not None:
        t = held.combine_chunks()
        lane = (t.column("p").to_numpy().astype(np.int64) << 32) | t.column("d").to_numpy()
        v = t.column("v").combine_chunks()
        yield rows(3, t.column("id").to_numpy(), np.zeros(t.num_rows), np.zeros(t.num_rows), pa.array([None] * t.num_rows, none.type))
        yield rows(2, t.column("id").to_numpy(), np.arange(t.num_rows), lane, v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)


def _seam(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last rows of a partition and the first of the next one."""
    pdf = pdf.sort_values(["kind", "b"], ascending=[False, True])
    out = []
    for _, g in pdf.groupby("lane"):
        last = int((g["kind"] == 2).sum())
        x = unit(np.stack(g["v"].to_numpy()).astype(np.float64))
        i, j = neighbour_links(x, np.zeros(len(x)), last)
        cross = i < last
        ids = g["a"].to_numpy()
        out.append(pd.DataFrame({"a": ids[i[cross]], "b": ids[j[cross]]}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def _sweep(vectors: DataFrame, numbers: range) -> tuple[DataFrame, DataFrame]:
    """Passes over ``vectors`` (id, v; pinned): links (a, b), and (id, log) of each one's chance that they miss a link."""
    rows = vectors.select("id", "v").mapInArrow(_keyed(numbers), "p int, d int, key bigint, id bigint, v array<float>")
    found = pinned(rows.repartitionByRange("p", "d", "key", "id").sortWithinPartitions("p", "d", "key", "id")
                   .mapInArrow(_window, "kind int, a bigint, b bigint, lane bigint, part int, v array<float>, log double"))
    ends = found.filter("kind in (1, 2)").withColumn("seam", F.when(F.col("kind") == 2, F.col("part")).otherwise(F.col("part") - 1))
    return (found.filter("kind = 0").select("a", "b").union(ends.groupBy("seam").applyInPandas(_seam, "a bigint, b bigint")),
            found.filter("kind = 3").groupBy(F.col("a").alias("id")).agg(F.sum("log").alias("log")))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links found, enough to connect all that were; ``distinct``: id, v (pinned)."""
    done = passes(distinct.count())
    found, log = _sweep(distinct, range(done))
    while True:
        crowded = pinned(log.filter(F.col("log") > math.log(MISS)))
        if crowded.isEmpty():
            return found
        found = pinned(found)
        comp = components(found).withColumnRenamed("node", "id")
        left = pinned(distinct.join(crowded, "id").join(comp, "id", "left").select("id", "v", "log", F.coalesce("component", "id").alias("component")))
        per = left.groupBy("component").count().agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") ** 2).alias("same")).first()
        pairs = (float(per["n"]) ** 2 - per["same"]) / 2           # pairs of different components
        if not pairs:
            return found
        log_each = left.agg(F.percentile_approx("log", 0.9)).first()[0] / done
        need = math.ceil(math.log(MISS) / log_each) - done if log_each < 0 else math.inf
        if pairs <= ROW_PASS * max(need, 1) * per["n"]:
            return found.union(_across(left, per["n"]))
        need = max(1, min(need, done))                             # at most twice the passes so far, then measured again
        new, more = _sweep(left, range(done, done + need))
        done += need
        found = found.union(new)
        log = left.select("id", "log").union(more).groupBy("id").agg(F.sum("log").alias("log")).join(left.select("id"), "id")


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks -> a spanning forest of the links between different components."""
    x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if pdf["itself"].iloc[0]:
        y = x
    if not len(x) or not len(y):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    ux, uy = (unit(np.stack(z["v"].to_numpy()).astype(np.float64)) for z in (x, y))
    cx, cy = x["component"].to_numpy(), y["component"].to_numpy()
    us, vs = [], []
    for s in range(0, len(ux), CELL):
        i, j = np.nonzero((ux[s:s + CELL] @ uy.T >= COSINE) & (cx[s:s + CELL, None] != cy))
        names, at = np.unique(np.concatenate([cx[i + s], cy[j]]), return_inverse=True)
        keep = forest(at[:len(i)], at[len(i):], len(names))
        us.append(x["id"].to_numpy()[i[keep] + s])
        vs.append(y["id"].to_numpy()[j[keep]])
    return pd.DataFrame({"a": np.concatenate(us), "b": np.concatenate(vs)})


def _across(left: DataFrame, n: int) -> DataFrame:
    """(a, b): links between different components of ``left`` (id, v, component; pinned), every pair judged once.

    Components above BLOCK vectors have blocks of their own, which are not compared with each other.
    """
    sizes = left.groupBy("component").count().filter(F.col("count") > BLOCK).select("component", F.lit(True).alias("big"))
    rows = left.join(sizes, "component", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    rows = pinned(rows.select("id", "v", "component", F.size("v").alias("d"), "big", F.when(F.col("big"), F.col("component")).otherwise(0).alias("home")))
    homes = rows.groupBy("d", "big", "home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    per = homes.groupBy("d").agg(F.collect_list(F.struct("big", "home", "parts")).alias("homes"))
    mine = rows.join(F.broadcast(per), "d").withColumn("part", F.expr("pmod(xxhash64(id), filter(homes, h -> h.big = big and h.home = home)[0].parts)").cast("int"))
    mine = mine.withColumn("me", F.struct("big", "home", "part"))
    others = F.expr("""flatten(transform(filter(homes, h -> not (big and h.big and h.home = home)),
                                         h -> transform(sequence(0, h.parts - 1), q -> named_struct('big', h.big, 'home', h.home, 'part', q))))""")
    name = F.concat_ws("/", "d", "lo.big", "lo.home", "lo.part", "hi.big", "hi.home", "hi.part")
    pairs = (mine.select("d", "id", "v", "component", "me", F.explode(others).alias("other"))
             .select("d", "id", "v", "component", F.least("me", "other").alias("lo"), F.greatest("me", "other").alias("hi"),
                     (F.col("me") > F.col("other")).cast("int").alias("side"), (F.col("me") == F.col("other")).alias("itself"))
             .select(name.alias("pair"), "id", "v", "component", "side", "itself"))
    k = -(-n // BLOCK)
    return pinned(pairs.repartition(min(MOST_TASKS, k * (k + 1) // 2), "pair").groupBy("pair").applyInPandas(_blocks, "a bigint, b bigint"))


# --- all links within a component -----------------------------------------------------------------------------------

def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of small components, sorted by component -> (id, more): copies of other vectors that each is linked with."""
    held: pa.Table | None = None

    def count(t: pa.Table) -> pa.RecordBatch:
        comp, ids, n = (t.column(c).to_numpy() for c in ("component", "id", "n"))
        vectors = t.column("v").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        edges = np.concatenate([[0], np.flatnonzero(np.diff(comp)) + 1, [len(comp)]])
        more = np.zeros(len(ids), np.int64)
        for s, e in zip(edges[:-1], edges[1:]):
            x = unit(matrix(vectors.slice(s, e - s)))
            more[s:e] = (x @ x.T >= COSINE) @ n[s:e] - n[s:e]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(more)], names=["id", "more"])

    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        comp = t.column("component").to_numpy()
        whole = int(np.searchsorted(comp, comp[-1]))
        if whole:
            yield count(t.slice(0, whole))
        held = t.slice(whole)
    if held is not None:
        yield count(held)


def _cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of cells -> (id, more)."""
    x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    itself = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
    if not len(x) or not len(y) and not itself:
        return pd.DataFrame({"id": np.zeros(0, np.int64), "more": np.zeros(0, np.int64)})
    ux = unit(np.stack(x["v"].to_numpy()).astype(np.float64))
    if itself:
        n = x["n"].to_numpy()
        return pd.DataFrame({"id": x["id"], "more": (ux @ ux.T >= COSINE) @ n - n})
    near = ux @ unit(np.stack(y["v"].to_numpy()).astype(np.float64)).T >= COSINE
    return pd.DataFrame({"id": np.concatenate([x["id"], y["id"]]), "more": np.concatenate([near @ y["n"].to_numpy(), near.T @ x["n"].to_numpy()])})


def _bin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cell by the angle to the component's first vector."""
    for b in batches:
        x, y = unit(matrix(b.column("v"))), unit(matrix(b.column("pivot")))
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, y), -1, 1))
        names = ["component", "id", "n", "v"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array((angle * BINS / ANGLE).astype(np.int32))], names=[*names, "bin"])


def counted(members: DataFrame) -> DataFrame:
    """(id, more) of ``members`` (component, id, n, v; pinned): copies of other vectors each is linked with."""
    size = pinned(members.groupBy("component").count())
    small = members.join(size.filter(F.col("count") <= CELL).select("component"), "component")
    small = small.repartition("component").sortWithinPartitions("component").mapInArrow(_small, "id bigint, more bigint")
    large = size.filter(F.col("count") > CELL).select("component")
    if large.isEmpty():
        return small
    first = members.filter("id = component").join(large, "component").select("component", F.col("v").alias("pivot"))
    big = pinned(members.join(first, "component").select("component", "id", "n", "v", "pivot")
                 .mapInArrow(_bin, "component bigint, id bigint, n bigint, v array<float>, bin int"))
    cells = big.groupBy("component", "bin").agg(F.sum("n").alias("all"), F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    per = cells.groupBy("component").agg(F.collect_list(F.struct("bin", "all", "parts")).alias("cells"))    # at most 113 bins
    at = big.join(per, "component")
    # Bins i and j span angles up to (i + j + 2) * ANGLE / BINS from each other: certain links up to BINS - 2 - i.
    sure = at.select("id", F.expr(f"""aggregate(cells, 0L, (s, c) -> s + if(c.bin <= {BINS - 2} - bin, c.all, 0L))
                                      - if(2 * bin <= {BINS - 2}, n, 0L)""").alias("more"))
    mine = at.withColumn("part", F.expr("pmod(xxhash64(id), filter(cells, c -> c.bin = bin)[0].parts)").cast("int"))
    mine = mine.withColumn("me", F.col("bin") * (1 << 20) + F.col("part"))
    others = F.expr(f"""flatten(transform(filter(cells, c -> c.bin > {BINS - 2} - bin and abs(c.bin - bin) <= {BINS}),
                                          c -> transform(sequence(0, c.parts - 1), q -> c.bin * {1 << 20} + q)))""")
    pairs = (mine.select("component", "id", "n", "v", "me", F.explode(others).alias("other"))
             .select("component", "id", "n", "v", F.least("me", "other").alias("lo"), F.greatest("me", "other").alias("hi"), (F.col("me") > F.col("other")).cast("int").alias("side")))
    unsure = pairs.groupBy("component", "lo", "hi").applyInPandas(_cells, "id bigint, more bigint")
    return small.union(sure).union(unsure)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.filter(usable)
    distinct = pinned(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")))
    comp = pinned(components(links(distinct.select("id", "v"))))
    members = pinned(distinct.join(comp.withColumnRenamed("node", "id"), "id").select("component", "id", "n", "v"))
    more = counted(members).groupBy("id").agg(F.sum("more").alias("more"))
    named = (distinct.join(comp.withColumnRenamed("node", "id"), "id", "left").join(more, "id", "left")
             .select("v", F.coalesce("component", "id").alias("component_id"), (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    joined = good.join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
