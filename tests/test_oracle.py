"""Registered queries against their DuckDB oracle on sf0.001 (the driver checks sf0.01)."""

import pytest

import __spark_entry__ as E
from compare import rows_of

FAST = ["total_stats", "daily_volumes_365", "top_tokens", "chains_source", "chain_breakdown", "period_stats",
        "period_stats_unknown", "top_makers", "top_takers", "leaderboard_makers", "token_pairs",
        "unique_order_count", "order_counts", "collection_rate_eta", "token_usd_coverage", "usd_missing",
        "recent_orders", "positive_volume", "order_lifecycle", "recent_fills", "lifecycle_join",
        "fill_speed_buckets", "new_events", "dedup_insert", "normalise_event", "page_signatures",
        "latest_progress", "progress_read", "search_orders", "page_orders", "merge_live", "export_csv",
        "wire_roundtrip", "camel_project", "decode_events_hex", "decode_create_full", "borsh_columns",
        "primary_transfer", "parse_stats", "unknown_tokens", "rolling_latency", "requests_last_second",
        "failure_run", "endpoint_totals", "batch_outcome", "mv_daily_volumes", "mv_token_stats", "metrics_long",
        "endpoint_names", "borsh_wide_numbers", "read_during_swap", "dashboard_bundle_parts"]


def test_every_query_has_a_builder_and_oracle_keys_match():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and df.columns == ["total_created", "total_fulfilled", "total_created_volume_usd",
                                             "total_fulfilled_volume_usd"]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, duck, sf, name):
    sdf = E.queries()[name](spark, sf)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, drows)
