"""Pre-aggregated views (A20, A21) and the one-document dashboard bundle.

A view is kept as *partial* aggregates, one set per ingest batch
(``batch_id``), written with dynamic partition overwrite so a replayed batch
replaces its own partials.  Reading a view re-sums the partials, which is
exact because partial sums are DECIMAL and counts are integers.  Partials
must be computed from deduplicated batches (see ``streaming.live``), or a
re-delivered event would be counted twice.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwise.functions.core import MONEY, is_created, is_fulfilled, non_blank, period_hours, since_hours
from fillwise.operators import analytics as A
from fillwise.session import checkpoint_dir


def daily_partials(ev: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """A20 partials: per batch and day, counts and DECIMAL volume sums."""
    return (ev.groupBy(batch_col, F.to_date("block_time").alias("date"))
            .agg(F.count_if(is_created()).alias("created_count"),
                 F.sum(F.when(is_created(), F.col("give_amount_usd").cast(MONEY))).alias("created_volume"),
                 F.count_if(is_fulfilled()).alias("fulfilled_count"),
                 F.sum(F.when(is_fulfilled(), F.col("take_amount_usd").cast(MONEY))).alias("fulfilled_volume")))


def read_daily_view(partials: DataFrame) -> DataFrame:
    """A20 read: re-sum partials per day (same columns as ``daily_volumes``)."""
    return (partials.groupBy("date")
            .agg(F.sum("created_count").cast("bigint").alias("created_count"),
                 F.coalesce(F.sum("created_volume").cast("double"), F.lit(0.0)).alias("created_volume_usd"),
                 F.sum("fulfilled_count").cast("bigint").alias("fulfilled_count"),
                 F.coalesce(F.sum("fulfilled_volume").cast("double"), F.lit(0.0)).alias("fulfilled_volume_usd")))


def token_partials(ev: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """A21 partials: per batch and give-token symbol of created orders."""
    return (ev.where(is_created() & non_blank("give_token_symbol"))
            .groupBy(batch_col, F.col("give_token_symbol").alias("symbol"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.sum(F.col("give_amount_usd").cast(MONEY)).alias("volume")))


def read_token_view(partials: DataFrame) -> DataFrame:
    """A21 read: per-symbol order count and USD volume."""
    return (partials.groupBy("symbol")
            .agg(F.sum("order_count").cast("bigint").alias("order_count"),
                 F.coalesce(F.sum("volume").cast("double"), F.lit(0.0)).alias("volume_usd")))


def size_partials(ev: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """A6 partials: per batch and hour, how often each order size occurs per event type."""
    return A.size_counts(ev, F.col(batch_col), F.date_trunc("hour", "block_time").cast("timestamp_ntz").alias("hour"))


def read_period_view(partials: DataFrame, period: str, as_of: str) -> DataFrame:
    """A6 read: period statistics, exact median included, from the partials alone.

    ``as_of`` must be a whole hour, since the partials know no shorter time.
    """
    if dt.datetime.fromisoformat(as_of) != dt.datetime.fromisoformat(as_of).replace(minute=0, second=0, microsecond=0):
        raise ValueError("as_of must be a whole hour")
    return A.period_from_counts(since_hours(partials, period_hours(period), as_of, "hour"), period)


def write_partials(partials: DataFrame, path: str) -> None:
    """Replace exactly the batches present in ``partials`` (idempotent on replay)."""
    (partials.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def with_batches(ev: DataFrame, rows_per_batch: int = 500) -> DataFrame:
    """Assign events to ingest batches by slot (stands in for the micro-batch id)."""
    return ev.withColumn("batch_id", F.floor(F.col("slot") / rows_per_batch).cast("bigint"))


#: What the parts of the bundle read of an event.
BUNDLE_COLUMNS = tuple(dict.fromkeys([*A.RECENT_COLUMNS, "event_type", "block_time", "give_token_symbol", "give_amount_usd", "take_amount_usd"]))


def dashboard_bundle(spark: SparkSession, ev: DataFrame, days: int = 30, tokens: int = 10,
                     recent: int = 100, target: int = 50000,
                     as_of: str | None = None) -> DataFrame:
    """One row holding stats, daily volumes, top tokens, recent events and progress, plus JSON.

    Each part is a bounded aggregate or top-k; the one-row parts are joined on
    a constant key (one row each), and arrays keep their display order by
    sorting on an explicit position.  The deduplicated events are written down
    once, in the columns that the parts read.
    """
    checkpoint_dir(spark)
    ev = ev.select(*BUNDLE_COLUMNS).checkpoint(eager=True)
    one = F.lit(1).alias("_k")
    stats = A.total_stats(ev).select(one, F.struct("*").alias("stats"))
    daily = A.daily_volumes(ev, days, as_of).agg(
        F.sort_array(F.collect_list(F.struct("date", "created_count", "created_volume_usd",
                                             "fulfilled_count", "fulfilled_volume_usd"))).alias("daily")
    ).select(one, "daily")

    def ordered(df: DataFrame, order, name: str) -> DataFrame:
        pos = df.withColumn("position", F.row_number().over(Window.orderBy(*order)))
        cols = [c for c in pos.columns if c != "position"]
        return pos.agg(F.transform(F.sort_array(F.collect_list(F.struct("position", *cols))),
                                   lambda s: s.dropFields("position")).alias(name)).select(one, name)

    toks = ordered(A.top_tokens(ev, tokens), [F.desc("volume_usd"), F.asc("symbol")], "tokens")
    rec = ordered(A.recent_orders(ev, recent), [F.desc("block_time"), F.asc("signature"), F.asc("event_type")],
                  "recent")
    prog = A.collection_progress_pct(ev, target).select(one, F.struct("*").alias("progress"))
    out = stats.join(daily, "_k").join(toks, "_k").join(rec, "_k").join(prog, "_k").drop("_k")
    return out.withColumn("json", F.to_json(F.struct("stats", "daily", "tokens", "recent", "progress")))
