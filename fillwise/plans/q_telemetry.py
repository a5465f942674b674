"""Registered telemetry queries (W9–W12, A22, A23, S11) over the request log derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwise.functions.core import mask_keys
from fillwise.operators import decode as X
from fillwise.operators import telemetry as T
from fillwise.plans.catalog import load_ev, register
from fillwise.plans.oracle import with_ev
from fillwise.sources import rawtx as R
from fillwise.sources import tpch

LOG = """log AS (SELECT event_id AS request_id, event_type AS endpoint, ts, value AS latency_ms,
  (event_type <> 'error' AND value > 20) AS ok FROM events)"""

_ROLLING = """rl AS (SELECT request_id, endpoint, ts,
  round(CAST(sum(CAST(latency_ms AS DECIMAL(28,6))) OVER w AS DOUBLE) / count(latency_ms) OVER w, 6) AS rolling_latency_ms
  FROM log WHERE ok WINDOW w AS (PARTITION BY endpoint ORDER BY ts, request_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""

_RUNS = """f AS (SELECT request_id, endpoint, ts,
    lag(ts) OVER (PARTITION BY endpoint ORDER BY ts, request_id) AS prev_ts,
    row_number() OVER (PARTITION BY endpoint ORDER BY ts, request_id) AS seq
  FROM log WHERE NOT ok),
g AS (SELECT *, max(CASE WHEN prev_ts IS NULL OR date_diff('microsecond', prev_ts, ts) > 60000000 THEN seq END)
    OVER (PARTITION BY endpoint ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS start_seq FROM f),
runs AS (SELECT request_id, endpoint, ts, seq - start_seq + 1 AS failure_run FROM g)"""

_TOTALS = """ep AS (SELECT p.endpoint, p.requests, p.failures, coalesce(r.last_failure_run, 0) AS last_failure_run,
    coalesce(r.last_failure_run, 0) < 5
      OR date_diff('microsecond', r.last_failure, (SELECT max(ts) FROM log)) > 60000000 AS healthy
  FROM (SELECT endpoint, count(*) AS requests, count_if(NOT ok) AS failures FROM log GROUP BY 1) p
  LEFT JOIN (SELECT endpoint, arg_max(failure_run, {'t': ts, 'r': request_id}) AS last_failure_run, max(ts) AS last_failure
             FROM runs GROUP BY 1) r ON p.endpoint = r.endpoint),
totals AS (SELECT endpoint, requests, failures, last_failure_run, healthy, CAST(NULL AS BIGINT) AS healthy_endpoints FROM ep
  UNION ALL
  SELECT 'ALL', CAST(sum(requests) AS BIGINT), CAST(sum(failures) AS BIGINT), NULL, NULL, count_if(healthy) FROM ep)"""


def _log(spark, sf):
    return tpch.request_log(spark, sf)


@register("rolling_latency", f"WITH {LOG}, {_ROLLING} SELECT * FROM rl")
def q_rolling_latency(spark, sf):
    return T.rolling_latency(_log(spark, sf), 100)


@register("requests_last_second", f"""WITH {LOG}
SELECT request_id, endpoint, ts, n AS requests_last_second, n < 4.0 AS has_headroom
FROM (SELECT request_id, endpoint, ts, count(*) OVER (PARTITION BY endpoint ORDER BY epoch_us(ts)
        RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW) AS n FROM log) t""")
def q_requests_last_second(spark, sf):
    return T.requests_last_second(_log(spark, sf), max_rps=5)


@register("failure_run", f"WITH {LOG}, {_RUNS} SELECT * FROM runs")
def q_failure_run(spark, sf):
    return T.failure_runs(_log(spark, sf))


@register("counter_rate", f"""WITH {LOG}
SELECT endpoint, date_trunc('minute', ts) AS window_start, count(*) AS requests, count(*) / 1.0 AS per_minute
FROM log GROUP BY 1, 2""")
def q_counter_rate(spark, sf):
    return T.counter_rate(_log(spark, sf))


@register("endpoint_totals", f"WITH {LOG}, {_RUNS}, {_TOTALS} SELECT * FROM totals")
def q_endpoint_totals(spark, sf):
    return T.endpoint_totals(_log(spark, sf))


_PARSED = """docs AS (SELECT o_orderkey AS slot, 'created' AS event_type, 'c-' || CAST(o_orderkey AS VARCHAR) AS signature,
         o_orderstatus != 'P' AND o_orderkey % 17 != 0 AS ok FROM orders
  UNION ALL SELECT l_orderkey, 'fulfilled', 'f-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR),
         l_linenumber != 7 FROM lineitem),
parsed AS (SELECT *, CASE WHEN slot % 71 = 0 THEN 'failed' WHEN ok THEN 'success' ELSE 'no_events' END AS outcome FROM docs)"""


def _documents(spark, sf):
    """The landed documents, of which some lost their message."""
    return R.damaged(R.raw_transactions_from_tpch(spark, sf, "hex"))


@register("batch_outcome", f"""WITH {_PARSED},
b AS (SELECT event_type, signature, outcome, CAST(floor(slot / 500) AS BIGINT) AS batch_id FROM parsed),
fi AS (SELECT event_type, batch_id, count(*) AS inserted FROM (
         SELECT event_type, signature, min(batch_id) AS batch_id FROM b WHERE outcome = 'success' GROUP BY 1, 2) m GROUP BY 1, 2),
per AS (SELECT event_type, batch_id, count_if(outcome = 'success') AS processed, count_if(outcome = 'failed') AS errors FROM b GROUP BY 1, 2),
j AS (SELECT per.event_type, per.batch_id, processed, coalesce(inserted, 0) AS inserted,
             processed - coalesce(inserted, 0) AS duplicates, errors
      FROM per LEFT JOIN fi ON per.event_type = fi.event_type AND per.batch_id = fi.batch_id WHERE processed > 0 OR errors > 0)
SELECT *, CAST(sum(inserted) OVER w AS BIGINT) AS total_inserted,
       CAST(sum(duplicates) OVER w AS BIGINT) AS total_duplicates,
       CAST(sum(processed) OVER w AS BIGINT) AS total_processed,
       CAST(sum(errors) OVER w AS BIGINT) AS total_errors
FROM j WINDOW w AS (PARTITION BY event_type ORDER BY batch_id ROWS UNBOUNDED PRECEDING)""")
def q_batch_outcome(spark, sf):
    """Events decoded from documents of which some failed, each collector by its own signatures."""
    docs = _documents(spark, sf)
    kind = F.when(F.col("signature").startswith("c-"), "created").otherwise("fulfilled")
    failed = X.parse_outcomes(spark, docs, "hex").where("outcome = 'failed'").select(kind.alias("event_type"), "slot")
    return T.batch_outcomes(X.decode_events(spark, docs, "hex"), failed, 500)


@register("endpoint_names", r"""
SELECT endpoint, 'https://' || endpoint || '.example/rpc?api-key=***&v=1' AS name FROM (SELECT DISTINCT event_type AS endpoint FROM events) e""")
def q_endpoint_names(spark, sf):
    """The endpoints' addresses as they are shown: with the API key masked."""
    key = F.concat(F.lit("Api_Key="), F.substring(F.sha2("endpoint", 256), 1, 12), F.lit("-x"))
    url = F.concat(F.lit("https://"), F.col("endpoint"), F.lit(".example/rpc?"), key, F.lit("&v=1"))
    return _log(spark, sf).select("endpoint").distinct().select("endpoint", mask_keys(url).alias("name"))


@register("metrics_long", with_ev("""
SELECT 'orders_events_total' AS metric, 'gauge' AS type, event_type AS label, CAST(count(*) AS DOUBLE) AS value,
       'orders_events_total{type="' || event_type || '"} ' || CAST(count(*) AS VARCHAR) AS line
FROM ev GROUP BY event_type
UNION ALL SELECT 'orders_parse_total', 'counter', r.outcome, CAST(count(p.outcome) AS DOUBLE),
       'orders_parse_total{result="' || r.outcome || '"} ' || CAST(count(p.outcome) AS VARCHAR)
FROM (VALUES ('success'), ('failed'), ('no_events')) r(outcome) LEFT JOIN parsed p ON p.outcome = r.outcome GROUP BY r.outcome
UNION ALL SELECT 'orders_rpc_current_rps', 'gauge', endpoint, CAST(n AS DOUBLE), 'orders_rpc_current_rps{endpoint="' || endpoint || '"} ' || CAST(n AS VARCHAR)
FROM (SELECT endpoint, count_if(ts > (SELECT max(ts) - INTERVAL 1 SECOND FROM log)) AS n FROM log GROUP BY 1) c
UNION ALL SELECT 'orders_rpc_requests_total', 'counter', NULL, CAST(requests AS DOUBLE),
       'orders_rpc_requests_total ' || CAST(requests AS VARCHAR) FROM totals WHERE endpoint = 'ALL'
UNION ALL SELECT 'orders_rpc_failures_total', 'counter', NULL, CAST(failures AS DOUBLE),
       'orders_rpc_failures_total ' || CAST(failures AS VARCHAR) FROM totals WHERE endpoint = 'ALL'
UNION ALL SELECT 'orders_rpc_healthy_endpoints', 'gauge', NULL, CAST(healthy_endpoints AS DOUBLE),
       'orders_rpc_healthy_endpoints ' || CAST(healthy_endpoints AS VARCHAR) FROM totals WHERE endpoint = 'ALL'
UNION ALL SELECT 'orders_rpc_latency_ms', 'gauge', endpoint, CAST(v AS DOUBLE),
       'orders_rpc_latency_ms{endpoint="' || endpoint || '"} ' || CAST(v AS VARCHAR)
FROM (SELECT endpoint, CAST(round(arg_max(rolling_latency_ms, {'t': ts, 'r': request_id})) AS BIGINT) AS v
      FROM rl GROUP BY 1) l""", LOG, _ROLLING, _RUNS, _TOTALS, _PARSED))
def q_metrics_long(spark, sf):
    return T.metrics_long(spark, load_ev(spark, sf), _log(spark, sf), X.parse_outcomes(spark, _documents(spark, sf), "hex"))
