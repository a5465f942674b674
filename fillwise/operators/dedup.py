"""Keep-latest dedup (the ``FINAL`` read) and the dedup-aware insert path.

``latest`` is the foundation operator: every analytic query reads the event
table through it.  It is a ``row_number() = 1`` over the key, which Spark
plans as a *partial* WindowGroupLimit before the shuffle (each map task keeps
only its best row per key) and a final one after it.  A key that holds a
third of all rows therefore ships one row per map task, not a third of the
table, and no single task ever sorts the hot key's full history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwise.schema import DEDUP_KEY, DEDUP_ORDER

# Version first, then every other column: a total order, so equal versions
# resolve alike on every run and in every engine.
LATEST_ORDER = DEDUP_ORDER


def _order_cols(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order]


def latest(df: DataFrame, key: Sequence[str] = DEDUP_KEY,
           order: Sequence[str] = LATEST_ORDER) -> DataFrame:
    """Rows with the highest ``order`` per ``key`` (W1 ``latest_events``)."""
    w = Window.partitionBy(*key).orderBy(*_order_cols(order))
    return (df.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") == 1)
              .drop("_rn"))


def latest_progress(progress: DataFrame) -> DataFrame:
    """W2 ``latest_progress``: the newest checkpoint per (program_id, event_type).

    An aggregate (``max_by``) rather than a window: partial aggregation
    collapses each key map-side, so the shuffle carries one row per key and
    map task even when one program owns most checkpoints.
    """
    ordering = F.struct("updated_at", "total_collected", "last_signature")
    return (progress.groupBy("program_id", "event_type")
            .agg(F.max_by(F.struct("last_signature", "total_collected", "updated_at"),
                          ordering).alias("p"))
            .select("program_id", "event_type", "p.last_signature", "p.total_collected",
                    "p.updated_at"))


def new_events(batch: DataFrame, stored: DataFrame,
               key: Sequence[str] = DEDUP_KEY) -> DataFrame:
    """J4 ``new_events``: batch rows whose key is not stored yet, batch itself deduped.

    The stored side is first cut down to the keys the batch mentions
    (``left_semi``), then the batch is anti-joined against that — the Spark
    form of ``WHERE signature IN (batch)``.  Neither side goes through the
    driver; Catalyst chooses broadcast only when the batch is measurably small.
    """
    batch_keys = batch.select(*key).distinct()
    seen = stored.select(*key).join(batch_keys, list(key), "left_semi")
    return latest(batch, key).join(seen, list(key), "left_anti")


def event_exists(ev: DataFrame, signature: str, event_type: str) -> DataFrame:
    """P8 ``event_exists``: a one-row frame ``exists`` (point lookup, LIMIT 1)."""
    hit = (ev.where((F.col("signature") == signature) & (F.col("event_type") == event_type))
             .select(F.lit(1).alias("one")).limit(1))
    return hit.agg((F.count(F.lit(1)) > 0).alias("exists"))
