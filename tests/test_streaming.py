"""Streaming ingest: replayed files and replayed batches are counted once; stream = batch."""

from pyspark.sql import functions as F

from fillwise.operators.dedup import latest
from fillwise.sources import io as IO
from fillwise.sources import tpch
from fillwise.streaming import ingest as I


def test_replayed_batch_id_is_idempotent(spark, tmp_path, sf):
    raw = tpch.raw_order_events(spark, sf)
    first, second = raw.where(F.col("slot") % 2 == 0), raw.where(F.col("slot") % 2 == 1)
    path = str(tmp_path / "t")
    a = IO.dedup_insert(spark, first, path, 0)
    b = IO.dedup_insert(spark, second, path, 1)
    again = IO.dedup_insert(spark, second, path, 1)          # crash before commit → same batch rerun
    assert b == again
    stored = spark.read.parquet(path)
    assert stored.count() == a["inserted"] + b["inserted"] == latest(raw).count()
    dup = IO.dedup_insert(spark, first, path, 2)              # at-least-once redelivery
    assert dup["inserted"] == 0 and dup["duplicates"] == first.count()


def test_backfill_stream_equals_batch_and_resumes(spark, sf):
    root = I.scratch_dir(spark, "test")
    raw = tpch.raw_order_events(spark, sf)
    I.land_event_files(raw, f"{root}/landing", parts=4, replay_part=1)
    paths = I.IngestPaths.under(root)
    target = 2000
    I.collect_until_target(spark, I.landing_glob(f"{root}/landing"), paths, target, max_files_per_trigger=1)
    partial = spark.read.parquet(paths.table).count()
    assert partial >= target
    rep = I.run_ingest(spark, I.landing_glob(f"{root}/landing"), paths, max_files_per_trigger=2)  # resume
    stored = spark.read.parquet(paths.table)
    assert stored.count() == latest(raw).count()
    assert stored.groupBy("signature", "event_type").count().where("count > 1").count() == 0
    # A batch paused mid-way is replayed under its batch_id and still counts once.
    assert I.collected(spark, paths.progress) == latest(raw).count() >= partial + rep.inserted


def test_replayed_batches_keep_progress_and_live_totals_exact(spark, sf):
    from fillwise.streaming import live as L
    raw, paths = tpch.raw_order_events(spark, sf), I.IngestPaths.under(I.scratch_dir(spark, "test"))
    report = I.IngestReport()
    I.store_batch(spark, raw, 0, paths, "p", report)
    once = IO.stored(spark, paths.table).count()
    I.store_batch(spark, raw, 0, paths, "p", report)
    assert report.total == I.collected(spark, paths.progress) == once == latest(raw).count()
    ck, out = I.scratch_dir(spark, "ck"), I.scratch_dir(spark, "out")
    for _ in range(2):
        q = (L.table_stream(spark, paths.table).writeStream.foreachBatch(L.live_stats_sink(spark, paths.table, out))
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
        r = L.read_live_stats(spark.read.parquet(out)).first()
        assert r.total_created + r.total_fulfilled == once
        I.store_batch(spark, raw, 0, paths, "p", report)       # replay: the same batch under new file names


def test_append_then_insert_uses_one_layout(spark, sf, tmp_path):
    raw, path = tpch.raw_order_events(spark, sf), str(tmp_path / "t")
    IO.append_events(raw, path)
    assert IO.dedup_insert(spark, raw, path, 1)["inserted"] == 0
    assert IO.read_events(spark, path).count() == latest(raw).count()
    IO.compact_events(spark, path, str(tmp_path / "new"))
    IO.swap_table(spark, path, str(tmp_path / "new"), str(tmp_path / "old"))
    assert IO.stored(spark, path).count() == latest(raw).count()


def test_unreadable_table_is_an_error_not_an_empty_one(spark, tmp_path):
    import pytest
    path = tmp_path / "t" / "batch_id=0" / "ym=200101"
    path.mkdir(parents=True)
    (path / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        IO.batch_rows_written(spark, str(tmp_path / "t"), 0)


def test_one_month_is_written_by_several_tasks(spark, sf, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        raw = tpch.raw_order_events(spark, sf).withColumn("block_time", F.expr("TIMESTAMP_NTZ '2001-01-01 00:00:00'"))
        IO.append_events(raw, str(tmp_path / "t"), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t").rglob("*.parquet"))) > 1


def test_insert_reads_only_the_months_of_the_batch(spark, sf, tmp_path):
    raw, path = latest(tpch.raw_order_events(spark, sf)), str(tmp_path / "t")
    IO.append_events(raw, path, 0)
    batch = raw.where("block_time >= TIMESTAMP_NTZ '2001-06-01 00:00:00' AND block_time < TIMESTAMP_NTZ '2001-07-01 00:00:00'")
    rows = IO.stored_before(spark, path, 1, batch, immutable_time=True)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "ym#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert IO.dedup_insert(spark, batch, path, 1, immutable_time=True)["inserted"] == 0


def test_compacted_state_keeps_values_and_survives_a_replay(spark, sf, tmp_path):
    from fillwise.streaming import live as L
    ev, path = latest(tpch.raw_order_events(spark, sf)), str(tmp_path / "state")
    parts = [ev.where(F.col("slot") % 3 != 0), ev.where("event_type = 'created'"), ev]

    def sink(n):
        """What the stream emits for batch n: the state so far of the orders that the batch touches."""
        so_far = parts[0]
        for part in parts[1:n + 1]:
            so_far = so_far.unionByName(part)
        touched = parts[n].select("order_id").distinct()
        L.upsert_by_key(path, ["order_id"])(L.lifecycle_partials(so_far).join(touched, "order_id", "left_semi"), n)

    for n in range(3):
        sink(n)
    rows = lambda: sorted(map(str, L.lifecycle_rows(L.read_lifecycle_state(spark, path)).collect()))
    before, stored = rows(), spark.read.parquet(path).count()
    L.compact_upserts(spark, path, ["order_id"], str(tmp_path / "old"))
    assert rows() == before and spark.read.parquet(path).count() < stored
    sink(2)
    assert rows() == before
