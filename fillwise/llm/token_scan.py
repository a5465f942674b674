"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document id.

A token file holds nothing but fixed-width little-endian ids, every document closed by the end id. ``scan`` cuts
the files into blocks of ``BLOCK`` ids, searches each block for the end id with one vectorised comparison, and stitches
documents that cross blocks with a prefix scan over one row per block: the ends before it, and the place of the last one.
No file is read twice, and no task reads more than a block at once, so one huge file spreads like many small ones.

``write`` makes such files from encoded documents. It also stores which documents a file holds, in order, without any
offsets, so that counts can be named by doc_id. File names hold the task attempt, so a lost attempt's file is never read.

Ids after the last end of a file are one more, unterminated document. An empty document counts 0. Repeated rows are
documents of their own; doc_id may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwise.llm.common import pinned, spread

BLOCK = 1 << 20
WIDTH = "<u2"          # ids below 65 536


def write(encoded: DataFrame, folder: str, end_id: int, width: str = WIDTH) -> DataFrame:
    """Token files below ``folder`` from (doc_id, ids); returns (file, ordinal, doc_id), pinned."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], width).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():05d}-{task.taskAttemptId()}.bin"
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        sink, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            sink = sink or fs.open_output_stream(f"{base}/{name}", compression=None)
            ids = b.column("ids")
            numbers = ids.flatten().to_numpy()
            if len(numbers) and (numbers.min() < 0 or numbers.max() > np.iinfo(width).max or (numbers == end_id).any()):
                raise ValueError(f"ids must fit {width} and differ from the end id {end_id}")
            flat, cuts = numbers.astype(width), (np.asarray(ids.offsets) - ids.offsets[0].as_py()).tolist()
            sink.write(b"".join(flat[s:e].tobytes() + end for s, e in zip(cuts, cuts[1:])))
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(range(n, n + b.num_rows), pa.int64()), b.column("doc_id")], names=["file", "ordinal", "doc_id"])
            n += b.num_rows
        if sink is not None:
            sink.close()

    return pinned(encoded.select("doc_id", "ids").mapInArrow(run, f"file string, ordinal bigint, doc_id {kind}"))


def _ends(folder: str, end_id: int, block: int, width: str):
    """Rows (file, block, total) -> one row per end id, with the end before it in its block; a last row closes the block."""
    size = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                at = r["block"] * block
                with fs.open_input_file(f"{base}/{r['file']}") as f:
                    ids = np.frombuffer(f.read_at(min(block, r["total"] - at) * size, at * size), width)
                ends = np.flatnonzero(ids == end_id) + at
                n = len(ends)
                pos = np.append(ends, r["total"])                     # the closing row counts ends and shows the last
                before = np.concatenate([[-1], ends])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]] * (n + 1)), pa.array(np.full(n + 1, r["block"])), pa.array(np.arange(n + 1)), pa.array(pos), pa.array(before), pa.array(np.arange(n + 1) == n)],
                    names=["file", "block", "i", "pos", "before", "closing"])
    return run


def files(spark, folder: str, width: str = WIDTH, names: DataFrame | None = None) -> DataFrame:
    """(file, total): the token files below ``folder`` and their numbers of ids; ``names`` (file) picks some."""
    size = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            found = b.column("file").to_pylist()
            info = fs.get_file_info([f"{base}/{x}" for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([x.size // size for x in info], pa.int64())], names=["file", "total"])

    if names is None:
        fs, base = pafs.FileSystem.from_uri(folder)
        listed = [(x.base_name,) for x in fs.get_file_info(pafs.FileSelector(base)) if x.base_name.endswith(".bin")]
        names = spark.createDataFrame(listed, "file string")
    return names.mapInArrow(run, "file string, total bigint")


def scan(token_files: DataFrame, folder: str, end_id: int, block: int = BLOCK, width: str = WIDTH) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated): the documents of ``token_files`` (file, total)."""
    blocks = token_files.filter("total > 0").select("file", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {block}"))).alias("block"))
    found = pinned(spread(pinned(blocks), 8, "file", "block").mapInArrow(
        _ends(folder, end_id, block, width), "file string, block bigint, i bigint, pos bigint, before bigint, closing boolean"))
    # Prefix scan: one row per block.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (found.filter("closing").select("file", "block", F.col("i").alias("n"), "before")
               .select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
                       F.coalesce(F.max("before").over(earlier), F.lit(-1)).alias("carry"), F.max("block").over(Window.partitionBy("file")).alias("last")))
    docs = found.join(carried, ["file", "block"])
    start = F.greatest("before", "carry") + 1
    return (docs.filter(~F.col("closing") | (F.col("block") == F.col("last")) & (start < F.col("pos")))
            .select("file", (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("pos") - start).alias("n_tokens"), (~F.col("closing")).alias("terminated")))


def named(documents: DataFrame, order: DataFrame) -> DataFrame:
    """``scan``'s rows with the doc_id of ``write``'s: doc_id, n_tokens, file, ordinal, start, terminated."""
    return documents.join(order, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start", "terminated")
