"""Ordered scans per key that stay parallel when one key holds most rows.

``keyed_scan`` gives every row its 1-based position within its key (in the
given order) plus running sums / maxima.  A plain
``Window.partitionBy(key).orderBy(...)`` would put a hot key — say one
endpoint with a third of all requests — into a single task.  Instead:

1. range-partition on ``(key, order…)``: a hot key is split across many
   contiguous, similarly sized partitions;
2. compute the running values locally inside each (partition, key) piece —
   each piece is bounded by the partition size;
3. aggregate one row per (partition, key) piece (tiny), turn it into
   per-piece offsets with a window over pieces, and add the offsets back.

The range-partitioned rows are checkpointed once so that both uses see the
same piece ids.

This is the distributed prefix-scan; everything stays in DataFrame ops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwise.session import checkpoint_dir


#: Bytes expected, or rows counted, for each range partition.
PIECE_BYTES, PIECE_ROWS = 256 << 20, 2_000_000


def keyed_scan(df: DataFrame, key: str, order: Sequence[str], sums: Sequence[str] = (),
               maxes: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Add ``_seq`` (1-based position within ``key``), ``_cum_<c>`` running sums and
    ``_cmax_<c>`` running maxima, ordered by ``order`` (must be a total order per key)."""
    spark = df.sparkSession
    # AQE can't split a range partition, so pieces follow the size.  Where the optimiser expects little, no job is run for
    # it; its estimates of joins and written frames are far too high, so the rows are counted where it expects more.
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if num_partitions is None and expected_bytes(df) > n * PIECE_BYTES:
        n = max(n, -(-df.count() // PIECE_ROWS))
    order_cols = [F.col(c) for c in order]
    r = (df.repartitionByRange(n, F.col(key), *order_cols)
           .withColumn("_pid", F.spark_partition_id()))
    # The piece id must be identical in both uses of ``r`` below.  Range
    # bounds are sampled per execution, and column pruning can stop Spark
    # from reusing one exchange for both branches, so the assignment is
    # pinned once with a reliable checkpoint in the shared checkpoint folder
    # (which also cuts lineage: a lost executor cannot re-draw the bounds).
    checkpoint_dir(spark)
    r = r.checkpoint(eager=True)
    piece = Window.partitionBy("_pid", key).orderBy(*order_cols)
    running = piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("_lseq", F.row_number().over(piece))
    for c in sums:
        r = r.withColumn(f"_lsum_{c}", F.sum(c).over(running))
    for c in maxes:
        r = r.withColumn(f"_lmax_{c}", F.max(c).over(running))

    totals = r.groupBy("_pid", key).agg(
        F.count(F.lit(1)).alias("_pn"),
        *[F.sum(c).alias(f"_psum_{c}") for c in sums],
        *[F.max(c).alias(f"_pmax_{c}") for c in maxes])
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", key,
        F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_off_n"),
        *[F.sum(f"_psum_{c}").over(before).alias(f"_off_sum_{c}") for c in sums],
        *[F.max(f"_pmax_{c}").over(before).alias(f"_off_max_{c}") for c in maxes])

    out = r.join(offsets, ["_pid", key], "left")
    out = out.withColumn("_seq", F.col("_off_n") + F.col("_lseq"))
    for c in sums:
        out = out.withColumn(f"_cum_{c}", _add_nullable(F.col(f"_off_sum_{c}"), F.col(f"_lsum_{c}")))
    for c in maxes:
        out = out.withColumn(f"_cmax_{c}", F.greatest(F.col(f"_off_max_{c}"), F.col(f"_lmax_{c}")))
    drop = ["_pid", "_lseq", "_off_n"] + [f"_lsum_{c}" for c in sums] + [f"_off_sum_{c}" for c in sums] \
        + [f"_lmax_{c}" for c in maxes] + [f"_off_max_{c}" for c in maxes]
    return out.drop(*drop)


def expected_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of ``df``; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _add_nullable(a: Column, b: Column) -> Column:
    """SQL running-sum semantics: NULL only while every value so far is NULL."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
