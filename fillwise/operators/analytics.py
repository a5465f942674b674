"""Dashboard measures over the deduped event table ``ev``.

Every function takes ``ev`` (already through ``dedup.latest``) and returns a
DataFrame.  Conditional measures are single-pass aggregates with FILTER-style
``when`` arguments, so Spark runs one partial aggregate per map task and one
small final merge; grouped measures shuffle only their (pre-aggregated)
groups.  Top-k ends in ``orderBy().limit()``, which Spark turns into
TakeOrderedAndProject — a per-partition top-k heap, never a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwise.functions.core import (MONEY, check_limit, is_created, is_fulfilled, money_sum,
                                     non_blank, period_hours, since_days, since_hours)
from fillwise.operators.sequence import keyed_scan
from fillwise.schema import chains_df
from fillwise.session import checkpoint_dir


def _created_fulfilled_measures(created_vol: str = "give_amount_usd",
                                fulfilled_vol: str = "take_amount_usd"):
    return [
        F.count_if(is_created()).alias("created_count"),
        F.coalesce(money_sum(F.when(is_created(), F.col(created_vol))), F.lit(0.0)).alias("created_volume_usd"),
        F.count_if(is_fulfilled()).alias("fulfilled_count"),
        F.coalesce(money_sum(F.when(is_fulfilled(), F.col(fulfilled_vol))), F.lit(0.0)).alias("fulfilled_volume_usd"),
    ]


def total_stats(ev: DataFrame) -> DataFrame:
    """A1: totals of both event types and their USD volumes (one row)."""
    m = _created_fulfilled_measures()
    return ev.agg(m[0].alias("total_created"), m[2].alias("total_fulfilled"),
                  m[1].alias("total_created_volume_usd"), m[3].alias("total_fulfilled_volume_usd"))


def daily_volumes(ev: DataFrame, days: int = 30, as_of: str | None = None) -> DataFrame:
    """A2: A1's measures per calendar day over the last ``days`` days, ascending."""
    days = check_limit(days, 30, 365)
    return (since_days(ev, days, as_of)
            .groupBy(F.to_date("block_time").alias("date"))
            .agg(*_created_fulfilled_measures())
            .orderBy("date"))


def top_tokens(ev: DataFrame, limit: int = 10) -> DataFrame:
    """A3: created orders per give-token symbol, by USD volume."""
    limit = check_limit(limit, 10, 50)
    return (ev.where(is_created() & non_blank("give_token_symbol"))
            .groupBy(F.col("give_token_symbol").alias("symbol"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.coalesce(money_sum(F.col("give_amount_usd")), F.lit(0.0)).alias("volume_usd"))
            .orderBy(F.desc("volume_usd"), F.asc("symbol"))
            .limit(limit))


def chain_names(df: DataFrame, spark: SparkSession, id_col: str = "chain_id") -> DataFrame:
    """Attach ``chain_name`` (fallback ``Chain <id>``) from the 10-row chain table.

    The chain table has a fixed size, so the broadcast is always bounded.
    """
    ch = F.broadcast(chains_df(spark).withColumnRenamed("chain_id", "_cid")
                     .withColumnRenamed("chain_name", "_cname"))
    return (df.join(ch, F.col(id_col) == F.col("_cid"), "left")
              .withColumn("chain_name", F.coalesce(F.col("_cname"),
                                                   F.concat(F.lit("Chain "), F.col(id_col).cast("string"))))
              .drop("_cid", "_cname"))


def _chain_side(ev: DataFrame, spark: SparkSession, chain_col: str, usd_col: str) -> DataFrame:
    agg = (ev.where(is_created() & F.col(chain_col).isNotNull())
           .groupBy(F.col(chain_col).alias("chain_id"))
           .agg(F.count(F.lit(1)).alias("order_count"),
                F.coalesce(money_sum(F.col(usd_col)), F.lit(0.0)).alias("volume_usd")))
    # Join after aggregation: at most one row per chain id reaches the join.
    return (chain_names(agg, spark)
            .select("chain_id", "chain_name", "order_count", "volume_usd")
            .orderBy(F.desc("order_count"), F.asc("chain_id")))


def chains_source(ev: DataFrame, spark: SparkSession) -> DataFrame:
    """A4: created orders per source (give) chain."""
    return _chain_side(ev, spark, "give_chain_id", "give_amount_usd")


def chains_destination(ev: DataFrame, spark: SparkSession) -> DataFrame:
    """A5: created orders per destination (take) chain."""
    return _chain_side(ev, spark, "take_chain_id", "take_amount_usd")


def chain_breakdown(ev: DataFrame, spark: SparkSession) -> DataFrame:
    """U3 + W7: both sides with a ``side`` label and each chain's share of its side (%).

    Both sides come from one scan: the rows are expanded to (side, chain, usd)
    by ``stack`` and aggregated once.
    """
    sides = ev.where(is_created()).select(F.expr(
        "stack(2, 'source', give_chain_id, give_amount_usd, "
        "'destination', take_chain_id, take_amount_usd) AS (side, chain_id, usd)"))
    agg = (sides.where(F.col("chain_id").isNotNull())
           .groupBy("side", "chain_id")
           .agg(F.count(F.lit(1)).alias("order_count"),
                F.coalesce(money_sum(F.col("usd")), F.lit(0.0)).alias("volume_usd")))
    w = Window.partitionBy("side")
    return (chain_names(agg, spark)
            .withColumn("share_pct", F.round(F.col("order_count") * 100.0 / F.sum("order_count").over(w), 4))
            .select("side", "chain_id", "chain_name", "order_count", "volume_usd", "share_pct"))


def exact_median(df: DataFrame, column: str, n: str | None = None) -> DataFrame:
    """One row ``median``: the exact median of ``column``, NULL without values.

    ``n`` names a column that says how often each row's value occurs, each
    value in one row; without it the values are counted first.  The distinct
    values are ordered by range partitions, and the running count picks the
    one or two in the middle; no task holds them all.
    """
    counts = df.where(F.col(column).isNotNull()).withColumnRenamed(column, "value")
    counts = counts.select("value", F.col(n).alias("n")) if n else counts.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    scan = keyed_scan(counts.withColumn("k", F.lit(0)), "k", ["value"], sums=["n"])
    upto, total = F.col("_cum_n"), F.max("_cum_n")
    size = scan.agg(total.alias("total"))
    middle = (scan.crossJoin(F.broadcast(size))                                   # one row
              .where((upto >= F.floor((F.col("total") + 1) / 2)) & (upto - F.col("n") < F.floor(F.col("total") / 2) + 1)))
    return middle.agg(((F.min("value") + F.max("value")) / 2).alias("median"))


def size_counts(ev: DataFrame, *by: Column) -> DataFrame:
    """How often each order size occurs per event type (and ``by``).

    Counts of disjoint rows merge by adding ``n``, and counts, sums, means and
    medians of the size all follow from them exactly.
    """
    usd = F.when(is_created(), F.col("give_amount_usd"))
    return ev.groupBy(*by, "event_type", usd.alias("usd")).agg(F.count(F.lit(1)).alias("n"))


def period_from_counts(counts: DataFrame, period: str) -> DataFrame:
    """A6 from size counts (rows ``event_type, usd, n``) of one period."""
    checkpoint_dir(counts.sparkSession)
    # Added up once and written down: the measures and the median read it, not what lies behind.
    counts = counts.groupBy("event_type", "usd").agg(F.sum("n").alias("n")).checkpoint(eager=True)
    of = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0))
    money = F.col("usd").cast(MONEY) * F.col("n").cast("decimal(18,0)")
    sized = is_created() & (F.col("usd") > 0)
    agg = counts.agg(
        of(is_created()).alias("total_created"), of(is_fulfilled()).alias("total_fulfilled"),
        F.coalesce(F.sum(money).cast("double"), F.lit(0.0)).alias("total_volume_usd"),
        F.coalesce(F.round(F.try_divide(F.sum(F.when(sized, money)).cast("double"), of(sized)), 4), F.lit(0.0)).alias("avg_order_size"),
    ).crossJoin(exact_median(counts.where(sized), "usd", "n").select(            # one row each
        F.coalesce(F.round("median", 4), F.lit(0.0)).alias("median_order_size")))
    return agg.select(
        F.lit(period).alias("period"), "total_created", "total_fulfilled", "total_volume_usd",
        F.when(F.col("total_created") > 0,
               F.round(F.col("total_fulfilled") * 100.0 / F.col("total_created"), 4))
         .otherwise(F.lit(0.0)).alias("fill_rate"),
        "avg_order_size", "median_order_size")


def period_stats(ev: DataFrame, period: str = "24h", as_of: str | None = None) -> DataFrame:
    """Counts, volume, fill rate and order size (mean, median) over a period; ``ev`` is read once."""
    return period_from_counts(size_counts(since_hours(ev, period_hours(period), as_of)), period)


def top_makers(ev: DataFrame, limit: int = 10) -> DataFrame:
    """Makers of created orders, by USD volume."""
    limit = check_limit(limit, 10, 50)
    return (ev.where(is_created() & non_blank("maker"))
            .groupBy(F.col("maker").alias("address"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.coalesce(money_sum(F.col("give_amount_usd")), F.lit(0.0)).alias("volume_usd"))
            .orderBy(F.desc("volume_usd"), F.asc("address"))
            .limit(limit))


def top_takers(ev: DataFrame, limit: int = 10) -> DataFrame:
    """Takers of fulfilled orders, by order count; volume from fulfilled USD."""
    limit = check_limit(limit, 10, 50)
    return (ev.where(is_fulfilled() & non_blank("taker"))
            .groupBy(F.col("taker").alias("address"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.coalesce(money_sum(F.col("fulfilled_amount_usd")), F.lit(0.0)).alias("volume_usd"))
            .orderBy(F.desc("order_count"), F.asc("address"))
            .limit(limit))


def leaderboard(board: DataFrame, order_by: str) -> DataFrame:
    """1-based rank and medal class over a (small, already limited) leaderboard."""
    w = Window.orderBy(F.desc(order_by), F.asc("address"))
    rank = F.row_number().over(w)
    return (board.withColumn("rank", rank)
            .withColumn("medal", F.when(F.col("rank") == 1, "gold").when(F.col("rank") == 2, "silver")
                        .when(F.col("rank") == 3, "bronze").otherwise("other")))


def token_pairs(ev: DataFrame, limit: int = 20) -> DataFrame:
    """(give symbol, take symbol) pairs of created orders, by count."""
    limit = check_limit(limit, 20, 50)
    return (ev.where(is_created() & non_blank("give_token_symbol") & non_blank("take_token_symbol"))
            .groupBy(F.col("give_token_symbol").alias("give_token"),
                     F.col("take_token_symbol").alias("take_token"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.coalesce(money_sum(F.col("give_amount_usd")), F.lit(0.0)).alias("volume_usd"))
            .orderBy(F.desc("order_count"), F.asc("give_token"), F.asc("take_token"))
            .limit(limit))


def unique_order_count(ev: DataFrame, event_type: str | None = None) -> DataFrame:
    """Number of deduped rows (optionally of one event type)."""
    if event_type is not None:
        ev = ev.where(F.col("event_type") == event_type)
    return ev.agg(F.count(F.lit(1)).alias("cnt"))


def order_counts(ev: DataFrame) -> DataFrame:
    """Created, fulfilled and total in one row (one pass)."""
    return ev.agg(F.count_if(is_created()).alias("created"), F.count_if(is_fulfilled()).alias("fulfilled"),
                  F.count(F.lit(1)).alias("total"))


def collection_progress_pct(ev: DataFrame, target: int = 50000) -> DataFrame:
    """``min(100, (created + fulfilled) / target × 100)`` overall and per type."""
    c = order_counts(ev)
    return c.select(
        "created", "fulfilled", "total",
        F.least(F.lit(100.0), F.round(F.col("total") * 100.0 / target, 4)).alias("pct_total"),
        F.least(F.lit(100.0), F.round(F.col("created") * 100.0 / (target / 2), 4)).alias("pct_created"),
        F.least(F.lit(100.0), F.round(F.col("fulfilled") * 100.0 / (target / 2), 4)).alias("pct_fulfilled"))


def collection_rate_eta(ev: DataFrame, target: int = 50000) -> DataFrame:
    """Events per minute between first and last insert; minutes left to ``target``."""
    agg = ev.agg(F.count(F.lit(1)).alias("collected"),
                 F.min("created_at").alias("first_insert"), F.max("created_at").alias("last_insert"))
    minutes = (F.unix_micros(F.col("last_insert").cast("timestamp"))
               - F.unix_micros(F.col("first_insert").cast("timestamp"))) / 60e6
    rate = F.round(F.try_divide(F.col("collected").cast("double"), minutes), 6)
    return agg.select(
        "collected", "first_insert", "last_insert", rate.alias("events_per_minute"),
        F.round(F.try_divide(F.greatest(F.lit(0), F.lit(target) - F.col("collected")).cast("double"),
                             rate), 4).alias("eta_minutes"))


def token_usd_coverage(ev: DataFrame, limit: int = 20) -> DataFrame:
    """Created rows per (address, symbol) incl. null groups; USD sum stays NULL if none."""
    return (ev.where(is_created())
            .groupBy("give_token_address", "give_token_symbol")
            .agg(F.count(F.lit(1)).alias("cnt"), money_sum(F.col("give_amount_usd")).alias("total_usd"))
            .orderBy(F.desc("cnt"), F.asc_nulls_last("give_token_address"),
                     F.asc_nulls_last("give_token_symbol"))
            .limit(limit))


SAMPLE_COLUMNS = ["order_id", "give_token_address", "give_token_symbol", "give_amount", "give_amount_usd"]


def usd_present(ev: DataFrame, n: int = 5) -> DataFrame:
    """P10: a sample of created rows with a positive USD value (ordered for determinism)."""
    return (ev.where(is_created() & (F.col("give_amount_usd") > 0)).select(*SAMPLE_COLUMNS, "signature")
            .orderBy("signature").limit(n).drop("signature"))


def usd_missing(ev: DataFrame, n: int = 5) -> DataFrame:
    """P10: a sample of created rows whose USD value is NULL or 0."""
    missing = F.col("give_amount_usd").isNull() | (F.col("give_amount_usd") == 0)
    return (ev.where(is_created() & missing).select(*SAMPLE_COLUMNS, "signature")
            .orderBy("signature").limit(n).drop("signature"))


RECENT_COLUMNS = ["order_id", "event_type", "signature", "block_time", "give_token_symbol",
                  "give_amount_usd", "take_token_symbol", "take_amount_usd", "maker", "taker"]


def recent_orders(ev: DataFrame, limit: int = 50) -> DataFrame:
    """L1: newest events, 10 columns, ``block_time`` descending (key as tie-breaker)."""
    limit = check_limit(limit, 50, 200)
    return (ev.select(*RECENT_COLUMNS)
            .orderBy(F.desc("block_time"), F.asc("signature"), F.asc("event_type"))
            .limit(limit))


def positive_volume_tokens(ev: DataFrame) -> DataFrame:
    """P14 + W8: the token list the dashboard shows.

    Tokens with volume > 0 (first 6); if no token has volume, the first 8 by
    order count.  ``bar_pct`` is each row's count relative to the first row.
    """
    stats = (ev.where(is_created() & non_blank("give_token_symbol")).groupBy(F.col("give_token_symbol").alias("symbol"))
             .agg(F.count(F.lit(1)).alias("order_count"),
                  F.coalesce(money_sum(F.col("give_amount_usd")), F.lit(0.0)).alias("volume_usd")))
    by_vol = [F.desc("volume_usd"), F.asc("symbol")]
    by_cnt = [F.desc("order_count"), F.asc("symbol")]
    # Two bounded top lists over all tokens; the second counts only if the first is empty.
    with_volume = stats.where(F.col("volume_usd") > 0).orderBy(*by_vol).limit(6).withColumn("_list", F.lit(0))
    most_orders = stats.orderBy(*by_cnt).limit(8).withColumn("_list", F.lit(1))
    shown = (with_volume.unionByName(most_orders)
             .withColumn("_first", F.min("_list").over(Window.partitionBy())).where(F.col("_list") == F.col("_first")))
    order = Window.partitionBy().orderBy(F.when(F.col("_list") == 0, F.col("volume_usd")).otherwise(F.col("order_count")).desc(), F.asc("symbol"))
    shown = shown.withColumn("rank", F.row_number().over(order))
    first = F.first("order_count").over(Window.partitionBy().orderBy("rank"))
    return (shown.withColumn("bar_pct", F.round(F.col("order_count") * 100.0 / first, 4))
            .select("rank", "symbol", "order_count", "volume_usd", "bar_pct"))
