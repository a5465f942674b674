"""fillwise — order-event analytics expressed as Spark DataFrame jobs.

Public entry points live in the sub-packages:

* ``fillwise.sources``   — reading / landing tables (parquet, JSON, CSV, wire form)
* ``fillwise.operators`` — dedup, filters, aggregations, lifecycle, decode, telemetry
* ``fillwise.functions`` — Column-level helpers (little-endian ints, time windows, money sums)
* ``fillwise.plans``     — named queries and their DuckDB oracle SQL
* ``fillwise.streaming`` — Structured Streaming ingestion and live measures
"""

from fillwise.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
