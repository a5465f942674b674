"""Registered dashboard queries."""

from __future__ import annotations

from fillwise.operators import analytics as A
from fillwise.plans.catalog import load_ev, register
from fillwise.plans.oracle import CHAINS, money_sum_sql as ms, with_ev

FIXTURE_AS_OF = "2001-11-05 00:00:00"      # the driver tables' "now"
AS_OF = f"TIMESTAMP '{FIXTURE_AS_OF}'"


@register("scan_events", with_ev("SELECT * FROM ev"))
def q_scan_events(spark, sf):
    return load_ev(spark, sf)


@register("total_stats", with_ev(f"""
SELECT count_if(event_type = 'created') AS total_created,
       count_if(event_type = 'fulfilled') AS total_fulfilled,
       coalesce({ms("CASE WHEN event_type = 'created' THEN give_amount_usd END")}, 0.0) AS total_created_volume_usd,
       coalesce({ms("CASE WHEN event_type = 'fulfilled' THEN take_amount_usd END")}, 0.0) AS total_fulfilled_volume_usd
FROM ev"""))
def q_total_stats(spark, sf):
    return A.total_stats(load_ev(spark, sf))


_DAILY_MEASURES = f"""count_if(event_type = 'created') AS created_count,
       coalesce({ms("CASE WHEN event_type = 'created' THEN give_amount_usd END")}, 0.0) AS created_volume_usd,
       count_if(event_type = 'fulfilled') AS fulfilled_count,
       coalesce({ms("CASE WHEN event_type = 'fulfilled' THEN take_amount_usd END")}, 0.0) AS fulfilled_volume_usd"""


@register("daily_volumes", with_ev(f"""
SELECT CAST(block_time AS DATE) AS date, {_DAILY_MEASURES}
FROM ev WHERE block_time >= CAST(CAST({AS_OF} AS DATE) - INTERVAL 30 DAY AS TIMESTAMP)
GROUP BY 1 ORDER BY 1"""))
def q_daily_volumes(spark, sf):
    return A.daily_volumes(load_ev(spark, sf), 30, FIXTURE_AS_OF)


@register("daily_volumes_365", with_ev(f"""
SELECT CAST(block_time AS DATE) AS date, {_DAILY_MEASURES}
FROM ev WHERE block_time >= CAST(CAST({AS_OF} AS DATE) - INTERVAL 365 DAY AS TIMESTAMP)
GROUP BY 1 ORDER BY 1"""))
def q_daily_volumes_365(spark, sf):
    return A.daily_volumes(load_ev(spark, sf), 365, FIXTURE_AS_OF)


@register("top_tokens", with_ev(f"""
SELECT give_token_symbol AS symbol, count(*) AS order_count,
       coalesce({ms("give_amount_usd")}, 0.0) AS volume_usd
FROM ev WHERE event_type = 'created' AND give_token_symbol IS NOT NULL AND give_token_symbol != ''
GROUP BY 1 ORDER BY volume_usd DESC, symbol ASC LIMIT 10"""))
def q_top_tokens(spark, sf):
    return A.top_tokens(load_ev(spark, sf), 10)


def _chain_sql(chain_col: str, usd_col: str) -> str:
    return with_ev(f"""
SELECT a.chain_id, coalesce(c.chain_name, 'Chain ' || CAST(a.chain_id AS VARCHAR)) AS chain_name,
       a.order_count, a.volume_usd
FROM (SELECT {chain_col} AS chain_id, count(*) AS order_count,
             coalesce({ms(usd_col)}, 0.0) AS volume_usd
      FROM ev WHERE event_type = 'created' AND {chain_col} IS NOT NULL GROUP BY 1) a
LEFT JOIN chains c ON a.chain_id = c.chain_id
ORDER BY a.order_count DESC, a.chain_id""", CHAINS)


@register("chains_source", _chain_sql("give_chain_id", "give_amount_usd"))
def q_chains_source(spark, sf):
    return A.chains_source(load_ev(spark, sf), spark)


@register("chains_destination", _chain_sql("take_chain_id", "take_amount_usd"))
def q_chains_destination(spark, sf):
    return A.chains_destination(load_ev(spark, sf), spark)


@register("chain_breakdown", with_ev(f"""
SELECT a.side, a.chain_id, coalesce(c.chain_name, 'Chain ' || CAST(a.chain_id AS VARCHAR)) AS chain_name,
       a.order_count, a.volume_usd,
       round(a.order_count * 100.0 / sum(a.order_count) OVER (PARTITION BY a.side), 4) AS share_pct
FROM (SELECT side, chain_id, count(*) AS order_count, coalesce({ms("usd")}, 0.0) AS volume_usd
      FROM (SELECT 'source' AS side, give_chain_id AS chain_id, give_amount_usd AS usd
            FROM ev WHERE event_type = 'created'
            UNION ALL
            SELECT 'destination', take_chain_id, take_amount_usd FROM ev WHERE event_type = 'created') s
      WHERE chain_id IS NOT NULL GROUP BY 1, 2) a
LEFT JOIN chains c ON a.chain_id = c.chain_id""", CHAINS))
def q_chain_breakdown(spark, sf):
    return A.chain_breakdown(load_ev(spark, sf), spark)


def _period_sql(period: str, hours: int) -> str:
    size = "CASE WHEN event_type = 'created' AND give_amount_usd > 0 THEN give_amount_usd END"
    return with_ev(f"""
SELECT '{period}' AS period, total_created, total_fulfilled, total_volume_usd,
       CASE WHEN total_created > 0 THEN round(total_fulfilled * 100.0 / total_created, 4) ELSE 0.0 END AS fill_rate,
       avg_order_size, median_order_size
FROM (SELECT count_if(event_type = 'created') AS total_created,
             count_if(event_type = 'fulfilled') AS total_fulfilled,
             coalesce({ms("CASE WHEN event_type = 'created' THEN give_amount_usd END")}, 0.0) AS total_volume_usd,
             coalesce(round({ms(size)} / count({size}), 4), 0.0) AS avg_order_size,
             coalesce(round(median({size}), 4), 0.0) AS median_order_size
      FROM ev WHERE block_time >= {AS_OF} - INTERVAL {hours} HOUR)""")


@register("period_stats", _period_sql("all", 87600))
def q_period_stats(spark, sf):
    return A.period_stats(load_ev(spark, sf), "all", FIXTURE_AS_OF)


@register("period_stats_30d", _period_sql("30d", 720))
def q_period_stats_30d(spark, sf):
    return A.period_stats(load_ev(spark, sf), "30d", FIXTURE_AS_OF)


@register("period_stats_unknown", _period_sql("fortnight", 24))
def q_period_stats_unknown(spark, sf):
    return A.period_stats(load_ev(spark, sf), "fortnight", FIXTURE_AS_OF)


_MAKERS = f"""SELECT maker AS address, count(*) AS order_count, coalesce({ms("give_amount_usd")}, 0.0) AS volume_usd
FROM ev WHERE event_type = 'created' AND maker IS NOT NULL AND maker != ''
GROUP BY 1 ORDER BY volume_usd DESC, address ASC LIMIT 10"""

_TAKERS = f"""SELECT taker AS address, count(*) AS order_count, coalesce({ms("fulfilled_amount_usd")}, 0.0) AS volume_usd
FROM ev WHERE event_type = 'fulfilled' AND taker IS NOT NULL AND taker != ''
GROUP BY 1 ORDER BY order_count DESC, address ASC LIMIT 10"""


@register("top_makers", with_ev(_MAKERS))
def q_top_makers(spark, sf):
    return A.top_makers(load_ev(spark, sf), 10)


@register("top_takers", with_ev(_TAKERS))
def q_top_takers(spark, sf):
    return A.top_takers(load_ev(spark, sf), 10)


def _board_sql(inner: str, order_col: str) -> str:
    return with_ev(f"""
SELECT *, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' ELSE 'other' END AS medal
FROM (SELECT *, row_number() OVER (ORDER BY {order_col} DESC, address ASC) AS rank FROM ({inner}) b) r""")


@register("leaderboard_makers", _board_sql(_MAKERS, "volume_usd"))
def q_leaderboard_makers(spark, sf):
    return A.leaderboard(A.top_makers(load_ev(spark, sf), 10), "volume_usd")


@register("leaderboard_takers", _board_sql(_TAKERS, "order_count"))
def q_leaderboard_takers(spark, sf):
    return A.leaderboard(A.top_takers(load_ev(spark, sf), 10), "order_count")


@register("token_pairs", with_ev(f"""
SELECT give_token_symbol AS give_token, take_token_symbol AS take_token, count(*) AS order_count,
       coalesce({ms("give_amount_usd")}, 0.0) AS volume_usd
FROM ev WHERE event_type = 'created' AND give_token_symbol IS NOT NULL AND give_token_symbol != ''
  AND take_token_symbol IS NOT NULL AND take_token_symbol != ''
GROUP BY 1, 2 ORDER BY order_count DESC, give_token, take_token LIMIT 20"""))
def q_token_pairs(spark, sf):
    return A.token_pairs(load_ev(spark, sf), 20)


@register("unique_order_count", with_ev("SELECT count(*) AS cnt FROM ev"))
def q_unique_order_count(spark, sf):
    return A.unique_order_count(load_ev(spark, sf))


@register("unique_order_count_fulfilled",
          with_ev("SELECT count(*) AS cnt FROM ev WHERE event_type = 'fulfilled'"))
def q_unique_order_count_fulfilled(spark, sf):
    return A.unique_order_count(load_ev(spark, sf), "fulfilled")


@register("by_event_type", with_ev("SELECT * FROM ev WHERE event_type = 'created'"))
def q_by_event_type(spark, sf):
    from pyspark.sql import functions as F
    return load_ev(spark, sf).where(F.col("event_type") == "created")


_COUNTS = """SELECT count_if(event_type = 'created') AS created, count_if(event_type = 'fulfilled') AS fulfilled,
       count(*) AS total FROM ev"""


@register("order_counts", with_ev(_COUNTS))
def q_order_counts(spark, sf):
    return A.order_counts(load_ev(spark, sf))


@register("collection_progress_pct", with_ev(f"""
SELECT created, fulfilled, total,
       least(100.0, round(total * 100.0 / 50000, 4)) AS pct_total,
       least(100.0, round(created * 100.0 / 25000.0, 4)) AS pct_created,
       least(100.0, round(fulfilled * 100.0 / 25000.0, 4)) AS pct_fulfilled
FROM ({_COUNTS}) c"""))
def q_collection_progress_pct(spark, sf):
    return A.collection_progress_pct(load_ev(spark, sf), 50000)


@register("collection_rate_eta", with_ev("""
SELECT collected, first_insert, last_insert, events_per_minute,
       round(greatest(0, 50000 - collected) / events_per_minute, 4) AS eta_minutes
FROM (SELECT collected, first_insert, last_insert,
             round(collected / ((epoch_us(last_insert) - epoch_us(first_insert)) / 60e6), 6) AS events_per_minute
      FROM (SELECT count(*) AS collected, min(created_at) AS first_insert, max(created_at) AS last_insert FROM ev) a) b"""))
def q_collection_rate_eta(spark, sf):
    return A.collection_rate_eta(load_ev(spark, sf), 50000)


@register("token_usd_coverage", with_ev(f"""
SELECT give_token_address, give_token_symbol, count(*) AS cnt, {ms("give_amount_usd")} AS total_usd
FROM ev WHERE event_type = 'created' GROUP BY 1, 2
ORDER BY cnt DESC, give_token_address ASC NULLS LAST, give_token_symbol ASC NULLS LAST LIMIT 20"""))
def q_token_usd_coverage(spark, sf):
    return A.token_usd_coverage(load_ev(spark, sf))


@register("usd_present", with_ev("""
SELECT order_id, give_token_address, give_token_symbol, give_amount, give_amount_usd
FROM ev WHERE event_type = 'created' AND give_amount_usd > 0 ORDER BY signature LIMIT 5"""))
def q_usd_present(spark, sf):
    return A.usd_present(load_ev(spark, sf))


@register("usd_missing", with_ev("""
SELECT order_id, give_token_address, give_token_symbol, give_amount, give_amount_usd
FROM ev WHERE event_type = 'created' AND (give_amount_usd IS NULL OR give_amount_usd = 0)
ORDER BY signature LIMIT 5"""))
def q_usd_missing(spark, sf):
    return A.usd_missing(load_ev(spark, sf))


@register("recent_orders", with_ev("""
SELECT order_id, event_type, signature, block_time, give_token_symbol, give_amount_usd,
       take_token_symbol, take_amount_usd, maker, taker
FROM ev ORDER BY block_time DESC, signature ASC, event_type ASC LIMIT 50"""))
def q_recent_orders(spark, sf):
    return A.recent_orders(load_ev(spark, sf), 50)


_PV_TOKENS = f"""t AS (SELECT give_token_symbol AS symbol, count(*) AS order_count,
                  coalesce({ms("give_amount_usd")}, 0.0) AS volume_usd
           FROM ev WHERE event_type = 'created' AND give_token_symbol IS NOT NULL AND give_token_symbol != ''
           GROUP BY 1)"""
_PV_RANKED = """r AS (SELECT *, max(volume_usd) OVER () > 0 AS hv,
             row_number() OVER (ORDER BY volume_usd DESC, symbol ASC) AS rv,
             row_number() OVER (ORDER BY order_count DESC, symbol ASC) AS rc FROM t)"""
_PV_SHOWN = """s AS (SELECT *, CASE WHEN hv THEN rv ELSE rc END AS rank FROM r
      WHERE CASE WHEN hv THEN volume_usd > 0 AND rv <= 6 ELSE rc <= 8 END)"""


@register("positive_volume", with_ev("""
SELECT rank, symbol, order_count, volume_usd,
       round(order_count * 100.0 / first_value(order_count) OVER (ORDER BY rank), 4) AS bar_pct
FROM s""", _PV_TOKENS, _PV_RANKED, _PV_SHOWN))
def q_positive_volume(spark, sf):
    return A.positive_volume_tokens(load_ev(spark, sf))
