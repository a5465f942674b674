"""Registered streaming queries (ST1–ST7, ST11–ST14, S6).

Each query lands files derived from the driver tables under the shared
checkpoint folder, runs its stream to completion (``availableNow``) and
returns the sink's final state as a batch DataFrame, so the result can be
compared with the batch oracle.  The backfill ingest (10 parts by slot,
newest first, one part delivered twice) runs once per session and data dir.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwise.operators import views as V
from fillwise.operators.dedup import LATEST_ORDER
from fillwise.operators.progress import progress_with_count
from fillwise.plans.catalog import load_ev, register
from fillwise.plans.oracle import money_sum_sql as ms, with_ev
from fillwise.plans.q_analytics import FIXTURE_AS_OF, _period_sql
from fillwise.plans.q_decode import _EVENTS_SQL
from fillwise.plans.q_io import _NORMALISED
from fillwise.plans.q_lifecycle import LIFECYCLE_CTE
from fillwise.plans.q_telemetry import LOG
from fillwise.schema import EVENT_COLUMNS, EVENT_DOC, QUARANTINE, STORED_PROGRESS
from fillwise.session import release
from fillwise.sources import io as IO
from fillwise.sources import rawtx as R
from fillwise.sources import tpch
from fillwise.streaming import ingest as I
from fillwise.streaming import live as L
from fillwise.streaming.metrics import read_metrics

_RUNS: dict = {}


def _landed_rows(spark, sf):
    """About how many events or documents the tables give: orders and line items."""
    return tpch.read_table(spark, sf, "orders").count() + tpch.read_table(spark, sf, "lineitem").count()


def _backfill(spark, sf):
    """Land the adapter rows and ingest them once (memoised per session and data dir)."""
    key = ("backfill", id(spark), sf)
    if key not in _RUNS:
        root = I.scratch_dir(spark, "backfill")
        raw = tpch.raw_order_events(spark, sf)
        parts = I.file_count(_landed_rows(spark, sf), 10)
        I.land_event_files(raw, f"{root}/landing", parts=parts, replay_part=3, newest_first=True, replay_of=10, compression="gzip")
        paths = I.IngestPaths.under(root)
        report = I.run_ingest(spark, I.landing_glob(f"{root}/landing"), paths, max_files_per_trigger=I.files_per_batch(parts, 10, 3))
        _RUNS[key] = (paths, report)
    return _RUNS[key]


def _by_year(spark, sf):
    """A live tail in event-time order: deduped events in time-ranged files, oldest first."""
    key = ("by_year", id(spark), sf)
    if key not in _RUNS:
        root = I.scratch_dir(spark, "tail")
        files = I.file_count(_landed_rows(spark, sf), 8)
        I.land_files(load_ev(spark, sf, dealt=True), f"{root}/t", files, ["block_time"], newest_first=False, compression="gzip")
        _RUNS[key] = f"{root}/t/*.json.gz", I.files_per_batch(files, 8, 1)
    return _RUNS[key]


def _log_tail(spark, sf):
    key = ("log_tail", id(spark), sf)
    if key not in _RUNS:
        root = I.scratch_dir(spark, "logtail")
        I.land_files(tpch.request_log(spark, sf), f"{root}/t", 4, ["ts"], newest_first=False, time_col="ts", compression="gzip")
        _RUNS[key] = f"{root}/t/*.json.gz"
    return _RUNS[key]


def _tail_stream(spark, sf):
    source, at_once = _by_year(spark, sf)
    return spark.readStream.schema(EVENT_DOC).option("maxFilesPerTrigger", at_once).json(source)


def _run_update(df, path, key, spark, checkpoint):
    q = (df.writeStream.outputMode("update").foreachBatch(L.upsert_by_key(path, key))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return L.read_upserts(spark, path, key)


_STORED = _NORMALISED.replace("FROM ev_raw", "FROM ev")


@register("stream_ingest", with_ev(_STORED))
def q_stream_ingest(spark, sf):
    """ST1 + ST2 + ST14: newest-first backfill with a replayed part, ingested exactly once."""
    paths, _ = _backfill(spark, sf)
    return spark.read.parquet(paths.table).select(*EVENT_COLUMNS)


@register("stream_dedup_counts", with_ev("""
SELECT d.delivered, i.inserted, d.delivered - i.inserted AS duplicates
FROM (SELECT count(*) + count_if(slot % 10 = 3) AS delivered FROM ev_raw) d, (SELECT count(*) AS inserted FROM ev) i"""))
def q_stream_dedup_counts(spark, sf):
    """ST2 / S5 counters of the backfill: delivered rows, inserted once, duplicates skipped."""
    paths, _ = _backfill(spark, sf)
    return IO.stored(spark, paths.progress, STORED_PROGRESS).agg(
        F.sum("delivered").alias("delivered"), F.sum("inserted").alias("inserted"),
        (F.sum("delivered") - F.sum("inserted")).alias("duplicates"))


@register("progress_after_ingest", with_ev("SELECT 'fillwise' AS program_id, count(*) AS total_collected FROM ev"))
def q_progress_after_ingest(spark, sf):
    """S6 + ST12: the newest checkpoint row after the backfill equals the stored count."""
    paths, _ = _backfill(spark, sf)
    return IO.progress_totals(IO.stored(spark, paths.progress, STORED_PROGRESS)).select("program_id", "total_collected")


@register("progress_recount", with_ev("""
SELECT 'fillwise' AS program_id, 'all' AS event_type, count(*) AS total_collected, count(*) AS exact_count FROM ev"""))
def q_progress_recount(spark, sf):
    """J8 over the collected table: the checkpoint's total next to the exact count of the deduplicated events."""
    paths, _ = _backfill(spark, sf)
    collected = IO.read_events(spark, paths.table).select(F.lit("fillwise").alias("program_id"), F.lit("all").alias("event_type"))
    totals = IO.progress_totals(IO.stored(spark, paths.progress, STORED_PROGRESS))
    return progress_with_count(totals, collected).drop("last_signature")


@register("replayed_batch_progress", with_ev("""
SELECT 'fillwise' AS program_id, count(*) AS total_collected, count(*) AS stored FROM ev"""))
def q_replayed_batch_progress(spark, sf):
    """S5 + S6: each of two batches is delivered twice under its id; total and table count once."""
    raw, paths, report = tpch.raw_order_events(spark, sf), I.IngestPaths.under(I.scratch_dir(spark, "replay")), I.IngestReport()
    for batch_id in (0, 1):
        events = raw.where(F.col("slot") % 2 == batch_id).persist()        # as the stream's sink keeps its batch
        try:
            for _ in range(2):
                I.store_batch(spark, events, batch_id, paths, "fillwise", report)
        finally:
            events.unpersist()
    stored = IO.stored(spark, paths.table).agg(F.count(F.lit(1)).alias("stored"))
    return IO.progress_totals(IO.stored(spark, paths.progress, STORED_PROGRESS)).select("program_id", "total_collected").crossJoin(stored)


@register("append_then_dedup_insert", with_ev("""
SELECT (SELECT count(*) FROM ev_raw) AS appended, 0 AS inserted, (SELECT count(*) FROM ev) AS latest"""))
def q_append_then_dedup_insert(spark, sf):
    """S4 then S5 on the same table: nothing is inserted again, and the table still reads."""
    root, raw = f"{I.scratch_dir(spark, 'append-insert')}/t", tpch.raw_order_events(spark, sf)
    IO.append_events(raw, root)
    IO.dedup_insert(spark, raw, root, 1)
    batches = IO.stored(spark, root).agg(F.count_if(F.col("batch_id") == IO.APPENDED).alias("appended"),
                                         F.count_if(F.col("batch_id") == 1).cast("int").alias("inserted"))
    return batches.crossJoin(IO.read_events(spark, root).agg(F.count(F.lit(1)).alias("latest")))


@register("stream_mv_tokens", with_ev(f"""
SELECT give_token_symbol AS symbol, count(*) AS order_count, coalesce({ms("give_amount_usd")}, 0.0) AS volume_usd
FROM ev WHERE event_type = 'created' AND give_token_symbol IS NOT NULL AND give_token_symbol != ''
GROUP BY 1"""))
def q_stream_mv_tokens(spark, sf):
    """ST6 + A21: token partials written by the ingest sink, re-summed."""
    paths, _ = _backfill(spark, sf)
    return V.read_token_view(spark.read.parquet(paths.token_view))


@register("period_stats_view", _period_sql("30d", 720))
def q_period_stats_view(spark, sf):
    """A6 over the size partials that ingest wrote: no event is read."""
    paths, _ = _backfill(spark, sf)
    return V.read_period_view(spark.read.parquet(paths.size_view), "30d", FIXTURE_AS_OF)


@register("collect_until_target", with_ev("""
SELECT count(*) >= 1000 AS reached, TRUE AS stopped_early, TRUE AS stayed, (SELECT count(*) FROM ev) AS resumed FROM ev"""))
def q_collect_until_target(spark, sf):
    """ST8 + ST9 + L4: collection stops at its target before all is read, stays there when asked again and, resumed,
    ends with every event once."""
    root = I.scratch_dir(spark, "target")
    parts = I.file_count(_landed_rows(spark, sf), 6)
    I.land_event_files(tpch.raw_order_events(spark, sf), f"{root}/landing", parts=parts, replay_part=1, replay_of=6, compression="gzip")
    paths, source = I.IngestPaths.under(root), I.landing_glob(f"{root}/landing")
    I.collect_until_target(spark, source, paths, 1000)
    reached = I.collected(spark, paths.progress)
    again = I.collect_until_target(spark, source, paths, 1000)
    I.run_ingest(spark, source, paths, max_files_per_trigger=I.files_per_batch(parts, 6, 3))
    return IO.stored(spark, paths.table).agg(
        F.lit(reached >= 1000).alias("reached"), (F.lit(reached) < F.count(F.lit(1))).alias("stopped_early"),
        F.lit(again.batches == 0).alias("stayed"), F.count(F.lit(1)).alias("resumed"))


@register("stream_dedup", with_ev("SELECT event_type, count(*) AS events FROM ev GROUP BY 1"))
def q_stream_dedup(spark, sf):
    """ST2: a tail whose files are each delivered twice, deduplicated within the watermark."""
    root = I.scratch_dir(spark, "wmdedup")
    files = I.file_count(2 * _landed_rows(spark, sf), 6)
    I.land_files(load_ev(spark, sf, dealt=True), f"{root}/t", files, ["block_time"], newest_first=False, copies=2, compression="gzip")
    stream = (spark.readStream.schema(EVENT_DOC).option("maxFilesPerTrigger", I.files_per_batch(files, 6, 2))
              .json(f"{root}/t/*.json.gz"))
    q = (L.stream_dedup(stream).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/_ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@register("stream_mv_daily", with_ev(f"""
SELECT CAST(block_time AS DATE) AS date, count_if(event_type = 'created') AS created_count,
       coalesce({ms("CASE WHEN event_type = 'created' THEN give_amount_usd END")}, 0.0) AS created_volume_usd,
       count_if(event_type = 'fulfilled') AS fulfilled_count,
       coalesce({ms("CASE WHEN event_type = 'fulfilled' THEN take_amount_usd END")}, 0.0) AS fulfilled_volume_usd
FROM ev GROUP BY 1"""))
def q_stream_mv_daily(spark, sf):
    """ST6 + A20: per-batch partials written by the ingest sink, re-summed."""
    paths, _ = _backfill(spark, sf)
    return V.read_daily_view(spark.read.parquet(paths.daily_view))


def _raw_backfill(spark, sf):
    """Raw documents as JSON lines, some without a message, some broken off, collected once (memoised)."""
    key = ("raw", id(spark), sf)
    if key not in _RUNS:
        root = I.scratch_dir(spark, "rawstream")
        dealt = tuple(I.file_count(tpch.read_table(spark, sf, t).count(), least, I.DOCS_PER_FILE) for t, least in (("orders", 2), ("lineitem", 6)))
        files = sum(dealt)
        lines = R.landed_lines(R.damaged(R.raw_transactions_from_tpch(spark, sf, "hex", dealt)))
        lines.select("value").write.options(compression="gzip", **I.FAST).text(f"{root}/landing")
        release(spark)
        paths = I.IngestPaths.under(root)
        report = I.run_ingest(spark, f"{root}/landing/*.txt.gz", paths, raw=True, encoding="hex",
                              max_files_per_trigger=I.files_per_batch(files, 8, 3, I.DOC_FILES_PER_BATCH))
        _RUNS[key] = (paths, report)
    return _RUNS[key]


_RAW_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in LATEST_ORDER if c not in ("_version", "created_at"))


@register("raw_stream_ingest", f"""WITH ev_raw AS (
  SELECT *, NULL AS created_at, NULL AS _version FROM ({_EVENTS_SQL}) e
  WHERE slot % 71 != 0 AND slot % 83 != 0
  QUALIFY row_number() OVER (PARTITION BY signature, event_type ORDER BY {_RAW_ORDER}) = 1)
SELECT * EXCLUDE (created_at, _version) FROM ({_NORMALISED}) n""")
def q_raw_stream_ingest(spark, sf):
    """ST1 from raw documents: decoded inside the stream, malformed and failed ones set aside."""
    paths, _ = _raw_backfill(spark, sf)
    return IO.stored(spark, paths.table).select(*[c for c in EVENT_COLUMNS if c not in ("created_at", "_version")])


_DOC_SLOTS = "docs AS (SELECT o_orderkey AS slot FROM orders UNION ALL SELECT l_orderkey FROM lineitem)"


@register("quarantine", f"""WITH {_DOC_SLOTS}
SELECT CASE WHEN slot % 83 = 0 THEN 'malformed' ELSE 'failed' END AS reason, count(*) AS documents
FROM docs WHERE slot % 83 = 0 OR slot % 71 = 0 GROUP BY 1""")
def q_quarantine(spark, sf):
    """S1 + A15: what collection could not read, by reason."""
    paths, _ = _raw_backfill(spark, sf)
    return IO.stored(spark, paths.quarantine, QUARANTINE).groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))


@register("batch_errors", f"""WITH {_DOC_SLOTS}
SELECT count_if(slot % 83 = 0 OR slot % 71 = 0) AS errors, TRUE AS batches_agree FROM docs""")
def q_batch_errors(spark, sf):
    """A22 in the stream: each batch's stored error count is the number of its quarantine rows."""
    paths, _ = _raw_backfill(spark, sf)
    kept = IO.stored(spark, paths.quarantine, QUARANTINE).groupBy("batch_id").agg(F.count(F.lit(1)).alias("kept"))
    both = IO.stored(spark, paths.progress, STORED_PROGRESS).join(kept, "batch_id", "full").na.fill(0, ["errors", "kept"])
    return both.agg(F.sum("errors").alias("errors"), F.bool_and(F.col("errors") == F.col("kept")).alias("batches_agree"))


@register("progress_metrics", with_ev(f"""
SELECT (SELECT count(*) + count_if(slot % 10 = 3) FROM ev_raw) AS delivered, (SELECT count(*) FROM docs) AS lines,
       (SELECT count_if(slot % 83 = 0) FROM docs) AS malformed, TRUE AS batches_agree""", _DOC_SLOTS))
def q_progress_metrics(spark, sf):
    """ST12: the counters that the listener stored of each batch, against what the tables hold of it."""
    events, _ = _backfill(spark, sf)
    raw, _ = _raw_backfill(spark, sf)
    a = (read_metrics(spark, events.metrics).select("batch_id", F.col("delivered").alias("seen"))
         .join(IO.stored(spark, events.progress, STORED_PROGRESS).select("batch_id", F.col("delivered").alias("held")), "batch_id", "full"))
    kept = (IO.stored(spark, raw.quarantine, QUARANTINE).where("reason = 'malformed'").groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("held")))
    b = (read_metrics(spark, raw.metrics).select("batch_id", F.col("delivered").alias("lines"), F.col("malformed").alias("seen"))
         .join(kept, "batch_id", "full").na.fill(0, ["held"]))
    agree = F.bool_and(F.col("seen").eqNullSafe(F.col("held")))
    return (a.agg(F.sum("seen").alias("delivered"), agree.alias("a"))
            .crossJoin(b.agg(F.sum("lines").alias("lines"), F.sum("seen").alias("malformed"), agree.alias("b")))   # one row each
            .select("delivered", "lines", "malformed", (F.col("a") & F.col("b")).alias("batches_agree")))


_LIVE_STATS_SQL = with_ev(f"""
SELECT count_if(event_type = 'created') AS total_created, count_if(event_type = 'fulfilled') AS total_fulfilled,
       coalesce({ms("CASE WHEN event_type = 'created' THEN give_amount_usd END")}, 0.0) AS total_created_volume_usd,
       coalesce({ms("CASE WHEN event_type = 'fulfilled' THEN take_amount_usd END")}, 0.0) AS total_fulfilled_volume_usd
FROM ev""")


@register("live_stats", _LIVE_STATS_SQL)
def q_live_stats(spark, sf):
    """ST3: totals kept current over the stream of the ingest table's new files."""
    paths, _ = _backfill(spark, sf)
    return _live_stats(spark, paths)


def _live_stats(spark, paths, rounds=1, between=lambda: None):
    root = I.scratch_dir(spark, "livestats")
    for n in range(rounds):
        if n:
            between()
        q = (L.table_stream(spark, paths.table).writeStream
             .foreachBatch(L.live_stats_sink(spark, paths.table, f"{root}/out"))
             .option("checkpointLocation", f"{root}/_ck").trigger(availableNow=True).start())
        q.awaitTermination()
    return L.read_live_stats(spark.read.parquet(f"{root}/out"))


@register("replayed_live_stats", _LIVE_STATS_SQL)
def q_replayed_live_stats(spark, sf):
    """ST3: an ingest batch is replayed after the live totals saw it; they count it once."""
    raw, paths, report = tpch.raw_order_events(spark, sf), I.IngestPaths.under(I.scratch_dir(spark, "replaylive")), I.IngestReport()

    def store(b):
        events = raw.where(F.col("slot") % 2 == b).persist()               # as the stream's sink keeps its batch
        try:
            I.store_batch(spark, events, b, paths, "fillwise", report)
        finally:
            events.unpersist()
    store(0)
    store(1)
    return _live_stats(spark, paths, 2, lambda: store(1))


@register("live_daily", with_ev(f"""
SELECT CAST(CAST(block_time AS DATE) AS TIMESTAMP) AS day_start, count_if(event_type = 'created') AS created_count,
       {ms("CASE WHEN event_type = 'created' THEN give_amount_usd END")} AS created_volume_usd,
       count_if(event_type = 'fulfilled') AS fulfilled_count,
       {ms("CASE WHEN event_type = 'fulfilled' THEN take_amount_usd END")} AS fulfilled_volume_usd
FROM ev GROUP BY 1"""))
def q_live_daily(spark, sf):
    """ST5: daily measures over an event-time-ordered tail with a 1-hour watermark (update + upsert)."""
    root = I.scratch_dir(spark, "livedaily")
    res = _run_update(L.live_daily(_tail_stream(spark, sf)), f"{root}/out", ["day"], spark, f"{root}/_ck")
    return res.select(F.col("day.start").cast("timestamp_ntz").alias("day_start"), "created_count",
                      F.col("created_volume").cast("double").alias("created_volume_usd"), "fulfilled_count",
                      F.col("fulfilled_volume").cast("double").alias("fulfilled_volume_usd"))


@register("collection_rate_1m", with_ev("""
SELECT date_trunc('minute', block_time) AS minute_start, count_if(event_type = 'created') AS created_per_min,
       count_if(event_type = 'fulfilled') AS fulfilled_per_min
FROM ev GROUP BY 1"""))
def q_collection_rate_1m(spark, sf):
    """ST7: created / fulfilled per 1-minute event-time window over the live tail."""
    root = I.scratch_dir(spark, "rate")
    res = _run_update(L.collection_rate(_tail_stream(spark, sf)), f"{root}/out", ["minute"], spark, f"{root}/_ck")
    return res.select(F.col("minute.start").cast("timestamp_ntz").alias("minute_start"), "created_per_min",
                      "fulfilled_per_min")


@register("collection_rate_sliding", with_ev("""
SELECT minute_start, count_if(event_type = 'created') AS created_per_min, count_if(event_type = 'fulfilled') AS fulfilled_per_min
FROM (SELECT event_type, unnest([half, half - INTERVAL 30 SECOND]) AS minute_start FROM (
  SELECT event_type, time_bucket(INTERVAL 30 SECOND, block_time) AS half FROM ev) h) w GROUP BY 1"""))
def q_collection_rate_sliding(spark, sf):
    """ST7: the same per-minute counts in windows that slide by 30 seconds."""
    root = I.scratch_dir(spark, "slide")
    rate = L.collection_rate(_tail_stream(spark, sf), slide="30 seconds")
    res = _run_update(rate, f"{root}/out", ["minute"], spark, f"{root}/_ck")
    return res.select(F.col("minute.start").cast("timestamp_ntz").alias("minute_start"), "created_per_min",
                      "fulfilled_per_min")


@register("live_endpoint_rps", f"""WITH {LOG}
SELECT endpoint, date_trunc('second', ts) AS second_start, count(*) AS requests FROM log GROUP BY 1, 2""")
def q_live_endpoint_rps(spark, sf):
    """ST13: requests per endpoint per second over the request-log tail (10 s watermark)."""
    root = I.scratch_dir(spark, "rps")
    schema = "request_id BIGINT, endpoint STRING, ts TIMESTAMP_NTZ, latency_ms DOUBLE, ok BOOLEAN"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(_log_tail(spark, sf))
    res = _run_update(L.live_endpoint_rps(stream), f"{root}/out", ["endpoint", "second"], spark, f"{root}/_ck")
    return res.select("endpoint", F.col("second.start").cast("timestamp_ntz").alias("second_start"), "requests")


@register("live_lifecycle", with_ev("""
SELECT order_id, created_at, created_signature, fulfilled_at, fulfilled_signature, maker, taker, time_to_fill_seconds
FROM lc WHERE created_at IS NOT NULL AND fulfilled_at IS NOT NULL""", LIFECYCLE_CTE))
def q_live_lifecycle(spark, sf):
    """ST11: per-order state in the state store; a row exists once both sides are seen."""
    root = I.scratch_dir(spark, "lifecycle")
    q = (L.live_lifecycle(_tail_stream(spark, sf)).writeStream.outputMode("update")
         .foreachBatch(L.upsert_by_key(f"{root}/state", ["order_id"]))
         .option("checkpointLocation", f"{root}/_ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return L.lifecycle_rows(L.read_lifecycle_state(spark, f"{root}/state"))


def _run_closed(spark, windows, name):
    """The windows that the watermark closed, written in append mode."""
    root = I.scratch_dir(spark, name)
    L.closed_windows(windows, f"{root}/out", f"{root}/_ck").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@register("live_daily_closed", with_ev(f"""
SELECT CAST(CAST(block_time AS DATE) AS TIMESTAMP) AS day_start, count_if(event_type = 'created') AS created_count,
       {ms("CASE WHEN event_type = 'created' THEN give_amount_usd END")} AS created_volume_usd,
       count_if(event_type = 'fulfilled') AS fulfilled_count,
       {ms("CASE WHEN event_type = 'fulfilled' THEN take_amount_usd END")} AS fulfilled_volume_usd
FROM ev GROUP BY 1 HAVING CAST(CAST(block_time AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(block_time) - INTERVAL 1 HOUR FROM ev)"""))
def q_live_daily_closed(spark, sf):
    """ST5 in append mode: each day written once, when the watermark has passed it; no upsert log."""
    res = _run_closed(spark, L.live_daily(_tail_stream(spark, sf)), "dailyclosed")
    return res.select(F.col("day.start").cast("timestamp_ntz").alias("day_start"), "created_count",
                      F.col("created_volume").cast("double").alias("created_volume_usd"), "fulfilled_count",
                      F.col("fulfilled_volume").cast("double").alias("fulfilled_volume_usd"))


@register("collection_rate_closed", with_ev("""
SELECT date_trunc('minute', block_time) AS minute_start, count_if(event_type = 'created') AS created_per_min,
       count_if(event_type = 'fulfilled') AS fulfilled_per_min
FROM ev GROUP BY 1 HAVING date_trunc('minute', block_time) + INTERVAL 1 MINUTE <= (SELECT max(block_time) - INTERVAL 1 HOUR FROM ev)"""))
def q_collection_rate_closed(spark, sf):
    """ST7 in append mode."""
    res = _run_closed(spark, L.collection_rate(_tail_stream(spark, sf)), "rateclosed")
    return res.select(F.col("minute.start").cast("timestamp_ntz").alias("minute_start"), "created_per_min", "fulfilled_per_min")


@register("endpoint_rps_closed", f"""WITH {LOG}
SELECT endpoint, date_trunc('second', ts) AS second_start, count(*) AS requests FROM log
GROUP BY 1, 2 HAVING date_trunc('second', ts) + INTERVAL 1 SECOND <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 SECOND FROM log)""")
def q_endpoint_rps_closed(spark, sf):
    """ST13 in append mode."""
    schema = "request_id BIGINT, endpoint STRING, ts TIMESTAMP_NTZ, latency_ms DOUBLE, ok BOOLEAN"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(_log_tail(spark, sf))
    res = _run_closed(spark, L.live_endpoint_rps(stream), "rpsclosed")
    return res.select("endpoint", F.col("second.start").cast("timestamp_ntz").alias("second_start"), "requests")


@register("live_recent")
def q_live_recent(spark, sf):
    """ST4: the kept list after the tail (newest 5 per batch merged ahead, 20 kept; rows-only)."""
    root = I.scratch_dir(spark, "recent")
    q = (_tail_stream(spark, sf).writeStream.foreachBatch(L.live_recent_sink(spark, f"{root}/out"))
         .option("checkpointLocation", f"{root}/_ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return L.read_recent_list(spark, f"{root}/out")


@register("live_recent_newest", with_ev("""
SELECT row_number() OVER (ORDER BY block_time DESC, signature, event_type) AS position, signature, event_type
FROM ev ORDER BY block_time DESC, signature, event_type LIMIT 5"""))
def q_live_recent_newest(spark, sf):
    """ST4: the head of the kept list is the newest five events of the whole tail."""
    return (q_live_recent(spark, sf).where("position <= 5")
            .select(F.col("position").cast("bigint").alias("position"), "signature", "event_type"))
