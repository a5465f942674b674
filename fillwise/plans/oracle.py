"""DuckDB SQL that rebuilds the derived inputs from the driver's views.

Each oracle query in ``fillwise.plans.catalog`` is ``WITH <ctes> SELECT …``;
the CTEs below produce the same rows the Spark side derives in
``fillwise.sources.tpch`` and the same dedup as ``operators.dedup.latest``.
"""

from __future__ import annotations

from fillwise.operators.dedup import LATEST_ORDER
from fillwise.sources.tpch import CHAIN_ID_CYCLE


def _chain_case(expr: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(CHAIN_ID_CYCLE) if v is not None)
    return f"CAST(CASE ({expr}) % {len(CHAIN_ID_CYCLE)} {arms} END AS BIGINT)"


EV_RAW = f"""
ev_raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'created' AS event_type,
         'c-' || CAST(o_orderkey AS VARCHAR) AS signature, o_orderkey AS slot,
         o_orderdate AS block_time,
         CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE c_name END AS maker,
         CAST(NULL AS VARCHAR) AS give_token_address,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN ''
              ELSE o_orderpriority END AS give_token_symbol,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS DECIMAL(38,0)) AS give_amount,
         CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN 0.0
              ELSE o_totalprice END AS give_amount_usd,
         {_chain_case('c_nationkey')} AS give_chain_id,
         CAST(NULL AS VARCHAR) AS take_token_address,
         CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderstatus END AS take_token_symbol,
         CAST(NULL AS DECIMAL(38,0)) AS take_amount,
         CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_totalprice END AS take_amount_usd,
         {_chain_case('o_orderkey')} AS take_chain_id,
         CAST(NULL AS VARCHAR) AS receiver, CAST(NULL AS VARCHAR) AS taker,
         CAST(NULL AS DECIMAL(38,0)) AS fulfilled_amount,
         CAST(NULL AS DOUBLE) AS fulfilled_amount_usd,
         o_orderdate AS created_at, CAST(0 AS BIGINT) AS _version
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR), 'fulfilled',
         'f-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), l_orderkey,
         l_shipdate, NULL, NULL, NULL, NULL, NULL, NULL, NULL, p_type, NULL, l_extendedprice,
         {_chain_case('s_nationkey')}, NULL,
         CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE s_name END, NULL,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE),
         l_shipdate, l_partkey
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
                LEFT JOIN part ON l_partkey = p_partkey
)"""

_ORDER_SQL = ", ".join(f"{c} DESC NULLS LAST" for c in LATEST_ORDER)

EV = f"""
ev AS (
  SELECT * FROM ev_raw
  QUALIFY row_number() OVER (PARTITION BY signature, event_type ORDER BY {_ORDER_SQL}) = 1
)"""

CHAINS = """
chains AS (
  SELECT * FROM (VALUES (1, 'Ethereum'), (10, 'Optimism'), (56, 'BSC'), (100, 'Gnosis'),
    (137, 'Polygon'), (250, 'Fantom'), (8453, 'Base'), (42161, 'Arbitrum'),
    (43114, 'Avalanche'), (7565164, 'Solana')) AS t(chain_id, chain_name)
)"""


def with_ev(body: str, *extra: str) -> str:
    """``WITH ev_raw, ev[, extra…] <body>``."""
    ctes = [EV_RAW, EV, *extra]
    return "WITH " + ",".join(ctes) + "\n" + body


def money_sum_sql(expr: str) -> str:
    """Order-independent money sum: exact DECIMAL sum, reported as DOUBLE."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(28,6))) AS DOUBLE)"
