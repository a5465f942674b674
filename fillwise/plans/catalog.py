"""Named queries: each is a Spark builder ``(spark, sf_dir) -> DataFrame`` plus,
where SQL can say it, the DuckDB oracle text over the driver's views.

Registered parameters are the dashboard defaults unless noted; every query
reads the whole derived tables (no key subsets, no row caps beyond the
top-k / sample sizes that are the feature itself).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fillwise.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_ev(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The deduped event table derived from the driver tables (S3 ``scan_events``).

    ``dealt``: see ``tpch.raw_order_events``; for steps that carry all columns.  The narrow source rows are then dealt by
    key and each kind of event is deduped apart, which is the same since the kind is part of the key.
    """
    from fillwise.operators.dedup import latest
    from fillwise.sources.tpch import created_events, fulfilled_events, raw_order_events
    if dealt:
        return latest(created_events(spark, sf_dir, "key")).unionByName(latest(fulfilled_events(spark, sf_dir, "key")))
    return latest(raw_order_events(spark, sf_dir))


# Importing the query modules fills QUERIES / ORACLE.
from fillwise.plans import q_analytics, q_decode, q_io, q_lifecycle, q_telemetry, q_views  # noqa: E402,F401
from fillwise.plans import q_landing, q_streaming  # noqa: E402,F401
