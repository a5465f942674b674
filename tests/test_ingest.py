"""Insert against the key store, quarantine, observed counters, append-mode windows, keyed lifecycle state."""

import datetime as dt
import json
import re
import time

import pytest
from pyspark.sql import functions as F
from tests_helpers import T0, events

from fillwise.operators import analytics as A
from fillwise.operators import lifecycle as LC
from fillwise.operators import views as V
from fillwise.operators.dedup import latest
from fillwise.schema import EVENT_DOC, QUARANTINE, STORED_PROGRESS
from fillwise.sources import io as IO
from fillwise.sources import rawtx as R
from fillwise.sources import tpch
from fillwise.sources.keystore import KeyStore
from fillwise.streaming import ingest as I
from fillwise.streaming import live as L
from fillwise.streaming.metrics import BatchMetrics, read_metrics


def keys(spark, low, high, kind="created"):
    return spark.range(low, high).select(F.concat(F.lit("s"), "id").alias("signature"), F.lit(kind).alias("event_type"), F.lit(200101).alias("ym"))


def test_key_store_knows_what_earlier_batches_inserted(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), buckets=4, fanout=3)
    for n in range(11):
        assert store.seen(keys(spark, 10 * n, 10 * n + 15), n).count() == (5 if n else 0)
        store.add(keys(spark, 10 * n, 10 * n + 15), n)
    assert len(store.runs(11)) < 7 and any(r.startswith("2_") for r in store.runs(11))
    assert store.seen(keys(spark, 0, 1000), 11).count() == 115
    assert store.seen(keys(spark, 0, 1000, "fulfilled"), 11).count() == 0
    assert store.seen(keys(spark, 0, 1000), 4).count() == 45          # as batch 4 saw it, when it is tried again
    store.add(keys(spark, 100, 105), 10)                              # another attempt of batch 10 replaces its keys
    again = KeyStore(spark, str(tmp_path), buckets=99)                # the bucket count is the store's own
    assert again.buckets == 4 and again.seen(keys(spark, 0, 1000), 11).count() == 105
    again.drop_merged(11)
    assert again.seen(keys(spark, 0, 1000), 11).count() == 105 and sorted(again._names("_done")) == sorted(again.runs(11))


def test_a_run_without_its_marker_does_not_count(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), buckets=2)
    store.add(keys(spark, 0, 5), 0)
    store._fs.delete(store._path(f"{store.root}/_done/0_0_0"), False)
    assert store.seen(keys(spark, 0, 9), 1).count() == 0


def test_stored_keys_are_not_shuffled(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), buckets=8)
    for n in range(3):
        store.add(keys(spark, 100 * n, 100 * n + 100), n)
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            seen = store.seen(keys(spark, 50, 400), 3)
            tree = seen._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        lines = tree.split("\n")
        scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        depth = lines[scan].index("FileScan")
        above = []
        for line in reversed(lines[:scan]):
            at = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if at < depth:
                above.append(line)
                depth = at
            if "Join" in line:
                break
        assert "Join" in above[-1] and not any("Exchange" in line or "Sort" in line for line in above), tree
        assert seen.count() == 250


def test_lookups_open_the_buckets_and_folders_they_need(spark, sf, tmp_path):
    raw = tpch.raw_order_events(spark, sf)
    paths, report = I.IngestPaths.under(str(tmp_path)), I.IngestReport()
    for n in range(3):
        I.store_batch(spark, raw.where(F.col("slot") % 3 == n), n, paths, "p", report)
    store = KeyStore(spark, paths.keys)
    wanted = [r[0] for r in latest(raw).orderBy("signature").limit(2).select("signature").collect()]
    # All files of other buckets are spoiled: a lookup does not open them.
    mine = {re.search(r"_(\d{5})\.c000", r[0])[1] for r in store.find(wanted).select(F.input_file_name()).collect()}
    spoiled = [p for p in (tmp_path / "event_keys" / "keys").rglob("*.parquet") if re.search(r"_(\d{5})\.c000", p.name)[1] not in mine]
    whole = {p: p.read_bytes() for p in spoiled}
    for p in spoiled:
        p.write_bytes(b"spoiled")
    assert len(spoiled) >= 3 and {r.signature for r in store.find(wanted).collect()} == set(wanted)
    for p, data in whole.items():
        p.write_bytes(data)
    found = store.rows(paths.table, wanted)
    assert sorted(r.signature for r in found.collect()) == sorted(r.signature for r in IO.lookup_in_list(IO.stored(spark, paths.table), wanted).collect())
    assert len(found.inputFiles()) and sorted(r.signature for r in store.rows(paths.table, ["none"]).collect()) == []
    partitions = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "batch_id" in partitions and "ym" in partitions


def test_small_batches_stay_flat(spark, tmp_path):
    store, took = KeyStore(spark, str(tmp_path), buckets=4, fanout=4), []
    for n in range(40):
        t = time.perf_counter()
        assert store.seen(keys(spark, 10 * n - 5, 10 * n + 10), n).count() == (5 if n else 0)
        store.add(keys(spark, 10 * n, 10 * n + 10), n)
        took.append(time.perf_counter() - t)
    assert sorted(took[-16:])[8] < 2 * sorted(took[4:20])[8], took


def test_insert_with_the_store_equals_insert_against_the_table(spark, sf, tmp_path):
    raw = tpch.raw_order_events(spark, sf)
    paths, report = I.IngestPaths.under(str(tmp_path / "a")), I.IngestReport()
    for n in range(4):
        part = raw.where((F.col("slot") % 4 == n) | (F.col("slot") % 7 == 0))
        I.store_batch(spark, part, n, paths, "p", report)
        counts = IO.dedup_insert(spark, part, str(tmp_path / "b"), n)
        assert {k: report.last[k] for k in counts} == counts
    rows = lambda p: sorted(map(str, IO.stored(spark, p).drop("batch_id").collect()))
    assert rows(paths.table) == rows(str(tmp_path / "b"))
    totals = [r[0] for r in IO.stored(spark, paths.progress, STORED_PROGRESS).orderBy("batch_id").select("total_collected").collect()]
    assert totals[-1] == report.total == latest(raw).count() and totals == sorted(totals)


def documents(tmp_path, spark, sf):
    raw = R.damaged(R.raw_transactions_from_tpch(spark, sf, "base58").where("slot < 600"))
    R.landed_lines(raw).repartitionByRange(3, "slot").select("value").write.text(str(tmp_path / "in"))
    return raw


def test_raw_stream_sets_bad_documents_aside_and_replays(spark, sf, tmp_path):
    raw = documents(tmp_path, spark, sf)
    slots = [r[0] for r in raw.select("slot").collect()]
    malformed, failed = sum(s % 83 == 0 for s in slots), sum(s % 71 == 0 and s % 83 != 0 for s in slots)
    assert malformed and failed
    paths = I.IngestPaths.under(str(tmp_path / "out"))
    report = I.run_ingest(spark, str(tmp_path / "in" / "*.txt"), paths, raw=True)
    bad = IO.stored(spark, paths.quarantine, QUARANTINE)
    assert {r[0]: r[1] for r in bad.groupBy("reason").count().collect()} == {"malformed": malformed, "failed": failed}
    assert report.errors == malformed + failed == IO.stored(spark, paths.progress, STORED_PROGRESS).agg(F.sum("errors")).first()[0]
    stored = IO.stored(spark, paths.table)
    assert stored.where("slot % 83 = 0 OR slot % 71 = 0").count() == 0 and stored.count() == report.inserted > 0
    assert [json.loads(r[0])["slot"] % 71 for r in bad.where("reason = 'failed'").select("line").collect()] == [0] * failed
    seen = {r.batch_id: (r.delivered, r.malformed) for r in read_metrics(spark, paths.metrics).collect()}
    assert sum(d for d, _ in seen.values()) == len(slots) and sum(m for _, m in seen.values()) == malformed
    # A batch that is tried again replaces what it set aside.
    lines = R.read_raw_transactions(spark, str(tmp_path / "in")).persist()
    assert I.write_quarantine(lines, str(tmp_path / "q"), 5) == malformed + failed
    I.write_quarantine(lines, str(tmp_path / "q"), 5)
    assert spark.read.parquet(str(tmp_path / "q")).count() == malformed + failed


def test_missing_block_time_is_the_landing_time(spark, sf, tmp_path):
    raw = R.created_transactions(spark, sf, "hex").where("slot < 200").withColumn("blockTime", F.lit(None).cast("bigint"))
    raw.write.json(str(tmp_path / "in"))
    paths = I.IngestPaths.under(str(tmp_path / "out"))
    I.run_ingest(spark, str(tmp_path / "in" / "*.json"), paths, raw=True, encoding="hex")
    times = {r[0] for r in IO.stored(spark, paths.table).select("block_time").distinct().collect()}
    landed = {dt.datetime.fromtimestamp(int(p.stat().st_mtime), dt.timezone.utc).replace(tzinfo=None) for p in (tmp_path / "in").glob("*.json")}
    assert times and times <= landed


def test_windows_are_written_once_and_late_rows_counted(spark, tmp_path):
    def land(name, minutes):
        rows = events(spark, [{"order_id": str(m), "event_type": "created", "signature": f"{name}-{k}", "block_time": T0 + dt.timedelta(minutes=m)}
                              for k, m in enumerate(minutes)])
        rows = rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("block_time", "created_at")})
        rows.coalesce(1).write.json(str(tmp_path / "in" / name))
        time.sleep(1.1)                                              # files are read in the order of their times
    land("a", [0, 0, 1, 300])
    land("b", [301, 600])
    land("c", [2, 601])                                              # minute 2 comes ten hours late
    stream = spark.readStream.schema(EVENT_DOC).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*" / "*.json"))
    metrics = BatchMetrics(spark, str(tmp_path / "metrics"))
    q = L.closed_windows(L.collection_rate(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    metrics.follow(q)
    q.awaitTermination()
    metrics.close()
    got = sorted(((r.minute.start - T0).seconds // 60, r.created_per_min) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 2), (1, 1), (300, 1), (301, 1)]               # 600 and 601 are still open
    assert read_metrics(spark, str(tmp_path / "metrics")).agg(F.sum("late_rows")).first()[0] == 1


def test_lifecycle_state_needs_no_earlier_output(spark, sf, tmp_path):
    """Either side first, over two runs of the stream; the first run's output is gone before the second."""
    ev = latest(tpch.raw_order_events(spark, sf))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run(rows):
        rows.coalesce(2).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT_DOC).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = (L.live_lifecycle(stream).writeStream.outputMode("update").foreachBatch(L.upsert_by_key(out, ["order_id"]))
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()

    first = (F.col("event_type") == "fulfilled") == (F.col("slot") % 2 == 0)
    run(ev.where(first))
    IO.drop_batches(spark, out, 10 ** 6)
    run(ev.where(~first))
    got = {r.order_id: (r.created_at, r.fulfilled_at, r.maker, r.taker) for r in L.lifecycle_rows(L.read_lifecycle_state(spark, out)).collect()}
    want = {r.order_id: (r.created_at, r.fulfilled_at, r.maker, r.taker) for r in LC.orders_combined(ev).where("fulfilled_at IS NOT NULL AND created_at IS NOT NULL").collect()}
    assert got == want and got


def test_period_view_needs_whole_hours_and_equals_the_events(spark, sf):
    ev = latest(tpch.raw_order_events(spark, sf))
    parts = V.size_partials(V.with_batches(ev, 100))
    for period in ("30d", "all", "1h"):
        assert V.read_period_view(parts, period, "2001-11-05 00:00:00").first() == A.period_stats(ev, period, "2001-11-05 00:00:00").first()
    with pytest.raises(ValueError):
        V.read_period_view(parts, "24h", "2001-11-05 00:30:00")


def test_a_period_without_orders_has_zeros(spark):
    none = events(spark, [{"order_id": "a", "event_type": "created", "signature": "s"}])
    r = A.period_stats(none, "24h", "2010-01-01 00:00:00").first()
    assert (r.total_created, r.total_fulfilled, r.total_volume_usd, r.fill_rate, r.avg_order_size, r.median_order_size) == (0, 0, 0.0, 0.0, 0.0, 0.0)


def test_compaction_rewrites_only_months_with_superseded_rows(spark, sf, tmp_path):
    from fillwise.sources.snapshots import Snapshots
    raw, path = latest(tpch.raw_order_events(spark, sf)), str(tmp_path / "t")
    month = lambda m: (F.col("block_time") >= F.lit(f"{m}-01 00:00:00").cast("timestamp_ntz")) & (F.col("block_time") < F.add_months(F.lit(f"{m}-01"), 1).cast("timestamp_ntz"))
    IO.append_events(raw, path, 0)
    newer = raw.where(month("1997-03")).withColumn("_version", F.col("_version") + 10 ** 6).withColumn("taker", F.lit("new"))
    IO.append_events(newer, path, 1)
    s = Snapshots(spark, path)
    old, want = s.events(), sorted(map(str, s.events().collect()))
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert s.compact() == [199703] and s.compact() == []
    assert {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet") if str(p) in before} == before   # nothing is touched
    assert sorted(map(str, s.events().collect())) == want == sorted(map(str, old.collect()))
    assert s.read().count() == raw.count() and s.read(0).count() == raw.count() + newer.count()
    # A compaction that failed before publishing leaves rows that nobody sees; a batch inserted meanwhile is seen.
    IO.write_batch(IO.table_rows(newer), path, -11, "overwrite")
    IO.append_events(newer.withColumn("signature", F.concat(F.lit("x"), "signature")), path, 2)
    assert s.read().count() == raw.count() + newer.count()
    assert s.vacuum() == 2 and s.read().count() == raw.count() + newer.count()
