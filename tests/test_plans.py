"""Physical-plan checks: pushdown, pruning, bounded broadcasts, no Python in SQL measures."""

import datetime as dt

from fillwise.operators import analytics as A
from fillwise.plans.catalog import load_ev
from fillwise.sources import io as IO
from fillwise.sources import tpch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_measures_have_no_python_and_dedup_limits_before_shuffle(spark, sf):
    p = plan(A.total_stats(load_ev(spark, sf)))
    assert "Python" not in p and "ArrowEval" not in p
    assert p.count("WindowGroupLimit") >= 2          # partial limit before the exchange, final after


def test_scan_reads_only_needed_columns(spark, sf):
    p = plan(A.top_makers(load_ev(spark, sf)))
    assert "o_orderpriority" not in p.split("FileScan parquet")[1].split("ReadSchema")[1].split("\n")[0]


def test_chain_lookup_is_broadcast(spark, sf):
    p = plan(A.chains_source(load_ev(spark, sf), spark))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_key_filter_reaches_the_scan(spark, tmp_path):
    raw = tpch.raw_order_events(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "ev")
    IO.append_events(raw, path)
    from fillwise.operators.dedup import latest
    df = latest(spark.read.parquet(path)).where("event_type = 'created'")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,created)]" in plan(df)


def test_time_filter_prunes_months_when_times_are_immutable(spark, tmp_path):
    # Precondition of immutable_time: a key's block_time never changes.  The
    # adapter's duplicate lineitems break it, so land one version per key.
    from fillwise.operators.dedup import latest
    raw = latest(tpch.raw_order_events(spark, "/root/testdata/sf0.001"))
    path = str(tmp_path / "ev")
    IO.append_events(raw, path)
    pruned = IO.read_events_since(spark, path, 24 * 30, "2001-11-05 00:00:00", immutable_time=True)
    full = IO.read_events_since(spark, path, 24 * 30, "2001-11-05 00:00:00", immutable_time=False)
    assert "PartitionFilters: [isnotnull(ym" in plan(pruned)
    assert "PartitionFilters: []" in plan(full)
    assert pruned.count() == full.count()
    _ = dt


def test_init_schema_is_idempotent(spark, tmp_path):
    """CREATE DATABASE / TABLE IF NOT EXISTS, twice, then the tables accept the schemas."""
    loc = str(tmp_path / "wh")
    IO.init_schema(spark, "fillwise_t", loc)
    IO.init_schema(spark, "fillwise_t", loc)
    cols = [c.name for c in spark.catalog.listColumns("order_events", "fillwise_t")]
    assert cols[:3] == ["order_id", "event_type", "signature"] and cols[-2:] == ["batch_id", "ym"]
    IO.append_events(tpch.raw_order_events(spark, "/root/testdata/sf0.001"), f"{loc}/order_events", 0)
    spark.sql("MSCK REPAIR TABLE fillwise_t.order_events")
    assert spark.table("fillwise_t.order_events").count() == tpch.raw_order_events(spark, "/root/testdata/sf0.001").count()
    assert spark.table("fillwise_t.collection_progress").count() == 0


def test_order_id_reaches_the_scan(spark, tmp_path):
    from fillwise.operators import lifecycle as L
    raw = tpch.raw_order_events(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "ev")
    IO.append_events(raw, path)
    assert "EqualTo(order_id,7)" in plan(L.order_lifecycle(IO.stored(spark, path), "7"))
