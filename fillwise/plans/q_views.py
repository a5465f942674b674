"""Registered view and bundle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwise.operators import views as V
from fillwise.plans.catalog import load_ev, register
from fillwise.plans.q_analytics import AS_OF, FIXTURE_AS_OF
from fillwise.plans.oracle import money_sum_sql as ms, with_ev


@register("mv_daily_volumes", with_ev(f"""
SELECT CAST(block_time AS DATE) AS date, count_if(event_type = 'created') AS created_count,
       coalesce({ms("CASE WHEN event_type = 'created' THEN give_amount_usd END")}, 0.0) AS created_volume_usd,
       count_if(event_type = 'fulfilled') AS fulfilled_count,
       coalesce({ms("CASE WHEN event_type = 'fulfilled' THEN take_amount_usd END")}, 0.0) AS fulfilled_volume_usd
FROM ev GROUP BY 1"""))
def q_mv_daily_volumes(spark, sf):
    """Per-batch partial sums, re-summed on read (equals daily volumes over all days)."""
    return V.read_daily_view(V.daily_partials(V.with_batches(load_ev(spark, sf))))


@register("mv_token_stats", with_ev(f"""
SELECT give_token_symbol AS symbol, count(*) AS order_count, coalesce({ms("give_amount_usd")}, 0.0) AS volume_usd
FROM ev WHERE event_type = 'created' AND give_token_symbol IS NOT NULL AND give_token_symbol != ''
GROUP BY 1"""))
def q_mv_token_stats(spark, sf):
    """Per-batch partial token stats, re-summed on read."""
    return V.read_token_view(V.token_partials(V.with_batches(load_ev(spark, sf))))


@register("dashboard_bundle")
def q_dashboard_bundle(spark, sf):
    """One nested row (rows-only check; every part has its own oracle query)."""
    return V.dashboard_bundle(spark, load_ev(spark, sf), as_of=FIXTURE_AS_OF)


@register("dashboard_bundle_parts", with_ev(f"""
SELECT (SELECT count(*) FROM ev WHERE event_type = 'created') AS total_created,
       (SELECT count(*) FROM ev WHERE event_type = 'fulfilled') AS total_fulfilled,
       (SELECT count(DISTINCT CAST(block_time AS DATE)) FROM recent_days) AS days,
       (SELECT count(*) FROM recent_days WHERE event_type = 'created') AS created_in_days,
       (SELECT string_agg(symbol, ',' ORDER BY volume_usd DESC, symbol) FROM top) AS tokens,
       (SELECT string_agg(signature, ',' ORDER BY block_time DESC, signature, event_type) FROM newest) AS recent""",
    f"""recent_days AS (SELECT * FROM ev WHERE block_time >= CAST(CAST({AS_OF} AS DATE) - INTERVAL 30 DAY AS TIMESTAMP))""",
    f"""top AS (SELECT give_token_symbol AS symbol, coalesce({ms("give_amount_usd")}, 0.0) AS volume_usd FROM ev
      WHERE event_type = 'created' AND give_token_symbol IS NOT NULL AND give_token_symbol != ''
      GROUP BY 1 ORDER BY volume_usd DESC, symbol LIMIT 10)""",
    """newest AS (SELECT * FROM ev ORDER BY block_time DESC, signature, event_type LIMIT 100)"""))
def q_dashboard_bundle_parts(spark, sf):
    """The bundle's nested parts read back: totals, days, tokens and recent events in their order."""
    b = V.dashboard_bundle(spark, load_ev(spark, sf), as_of=FIXTURE_AS_OF)
    return b.select("stats.total_created", "stats.total_fulfilled", F.size("daily").cast("bigint").alias("days"),
                    F.aggregate("daily", F.lit(0).cast("bigint"), lambda n, d: n + d["created_count"]).alias("created_in_days"),
                    F.array_join(F.transform("tokens", lambda t: t["symbol"]), ",").alias("tokens"),
                    F.array_join(F.transform("recent", lambda r: r["signature"]), ",").alias("recent"))
