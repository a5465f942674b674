"""Order lifecycle: created ⟷ fulfilled per ``order_id``.

The primary form is conditional aggregation: one ``groupBy(order_id)`` with
FILTER-style arguments, i.e. one shuffle of partially aggregated rows.  An
order with a huge number of fill events (a hot key) is collapsed map-side by
the partial aggregate before it reaches the shuffle.  ``lifecycle_join`` is
the full-outer-join form kept as a cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwise.functions.core import check_limit, is_created, is_fulfilled
from fillwise.operators.dedup import latest
from fillwise.schema import DEDUP_KEY


LIFECYCLE_COLUMNS = ["order_id", "created_at", "created_signature", "fulfilled_at",
                     "fulfilled_signature", "maker", "taker", "give_token", "take_token",
                     "amount_usd", "time_to_fill_seconds"]


def _first_of(value: str, cond: Column) -> Column:
    """Deterministic ``anyIf``: the non-null value of the earliest matching event."""
    ordering = F.when(cond & F.col(value).isNotNull(), F.struct("block_time", "signature"))
    return F.min_by(F.col(value), ordering)


def _fill_seconds(created_at: str, fulfilled_at: str) -> Column:
    micros = F.timestamp_diff("MICROSECOND", F.col(created_at), F.col(fulfilled_at))
    return F.when(F.col(created_at).isNotNull() & F.col(fulfilled_at).isNotNull(),
                  F.floor(micros / F.lit(1_000_000)).cast("bigint"))


def lifecycles(ev: DataFrame) -> DataFrame:
    """A10 over every order: first create / first fill time and signature, parties, fill time."""
    agg = ev.groupBy("order_id").agg(
        F.min(F.when(is_created(), F.col("block_time"))).alias("created_at"),
        F.min_by(F.col("signature"), F.when(is_created(), F.struct("block_time", "signature")))
         .alias("created_signature"),
        F.min(F.when(is_fulfilled(), F.col("block_time"))).alias("fulfilled_at"),
        F.min_by(F.col("signature"), F.when(is_fulfilled(), F.struct("block_time", "signature")))
         .alias("fulfilled_signature"),
        _first_of("maker", is_created()).alias("maker"),
        _first_of("taker", is_fulfilled()).alias("taker"),
        _first_of("give_token_symbol", is_created()).alias("give_token"),
        _first_of("take_token_symbol", is_created()).alias("take_token"),
        _first_of("give_amount_usd", is_created()).alias("amount_usd"),
    )
    return (agg.withColumn("amount_usd", F.when(F.col("amount_usd") != 0, F.col("amount_usd")))
               .withColumn("time_to_fill_seconds", _fill_seconds("created_at", "fulfilled_at"))
               .select(*LIFECYCLE_COLUMNS))


def order_lifecycle(raw: DataFrame, order_id: str) -> DataFrame:
    """A10 for one order of the stored (not yet deduplicated) rows; zero rows means 'not found'.

    The order id is pushed into one scan that finds the keys which ever
    carried it; only those keys' rows are deduplicated, so a key whose latest
    version names another order is left out as it should be.
    """
    mine = F.col("order_id") == order_id
    keys = raw.where(mine).select(*DEDUP_KEY).distinct()
    return lifecycles(latest(raw.join(keys, list(DEDUP_KEY), "left_semi")).where(mine))


def recent_fills(ev: DataFrame, limit: int = 20) -> DataFrame:
    """Orders with a fill, newest fill first."""
    limit = check_limit(limit, 20, 50)
    return (lifecycles(ev).where(F.col("fulfilled_at").isNotNull())
            .orderBy(F.desc("fulfilled_at"), F.asc("order_id"))
            .limit(limit))


def with_status(lc: DataFrame) -> DataFrame:
    """P15: 'fulfilled' once a fill exists, else 'created' ('cancelled' never occurs)."""
    return lc.withColumn("status", F.when(F.col("fulfilled_at").isNotNull(), F.lit("fulfilled"))
                         .otherwise(F.lit("created")))


def orders_combined(ev: DataFrame) -> DataFrame:
    """The combined order view (every order) with its status."""
    return with_status(lifecycles(ev))


def fill_speed_buckets(ev: DataFrame) -> DataFrame:
    """Fills under 60 s, under 300 s, slower, unknown — count and share (%)."""
    lc = lifecycles(ev).where(F.col("fulfilled_at").isNotNull())
    t = F.col("time_to_fill_seconds")
    bucket = (F.when(t.isNull(), "unknown").when(t < 60, "under_1m")
              .when(t < 300, "under_5m").otherwise("slower"))
    counts = lc.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("fills"))
    from pyspark.sql import Window
    return counts.withColumn(
        "share_pct", F.round(F.col("fills") * 100.0 / F.sum("fills").over(Window.partitionBy()), 4))


def lifecycle_join(ev: DataFrame) -> DataFrame:
    """The same lifecycle as a full outer join of per-type pre-aggregates."""
    def side(cond: Column, party: str, extra: dict[str, str]):
        cols = [F.min("block_time").alias("at"),
                F.min_by("signature", F.struct("block_time", "signature")).alias("sig"),
                _first_of(party, F.lit(True)).alias(party)]
        cols += [_first_of(src, F.lit(True)).alias(dst) for dst, src in extra.items()]
        return ev.where(cond).groupBy("order_id").agg(*cols)
    c = side(is_created(), "maker", {"give_token": "give_token_symbol", "take_token": "take_token_symbol",
                                "amount_usd": "give_amount_usd"})
    c = c.withColumnsRenamed({"at": "created_at", "sig": "created_signature"})
    f = side(is_fulfilled(), "taker", {}).withColumnsRenamed({"at": "fulfilled_at", "sig": "fulfilled_signature"})
    j = c.join(f, "order_id", "full_outer")
    return (j.withColumn("amount_usd", F.when(F.col("amount_usd") != 0, F.col("amount_usd")))
             .withColumn("time_to_fill_seconds", _fill_seconds("created_at", "fulfilled_at"))
             .select(*LIFECYCLE_COLUMNS))
