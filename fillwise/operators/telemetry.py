"""Endpoint telemetry over a request log.

Request log columns: ``request_id, endpoint, ts, latency_ms, ok``.  Ordered
per-endpoint measures go through ``sequence.keyed_scan`` so a dominant
endpoint is still spread over many tasks; lookbacks become equi-joins on
the scan position (``_seq - N``) instead of per-key windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwise.operators.sequence import keyed_scan
from fillwise.session import checkpoint_dir

ORDER = ["ts", "request_id"]
LAT = "decimal(28,6)"
FAILURE_WINDOW_SECONDS = 60
FAILURE_THRESHOLD = 5
RESULTS = ("success", "failed", "no_events")


def rolling_latency(log: DataFrame, n: int = 100) -> DataFrame:
    """Mean latency of the last ``n`` successful requests per endpoint, at every successful request."""
    base = log.where(F.col("ok")).select("request_id", "endpoint", "ts",
                      F.col("latency_ms").cast(LAT).alias("lat"),
                      F.col("latency_ms").isNotNull().cast("bigint").alias("has"))
    s = keyed_scan(base, "endpoint", ORDER, sums=["lat", "has"])
    prev = s.select("endpoint", (F.col("_seq") + n).alias("_seq"),
                    F.col("_cum_lat").alias("_p_lat"), F.col("_cum_has").alias("_p_has"))
    j = s.join(prev, ["endpoint", "_seq"], "left")
    total = F.col("_cum_lat") - F.coalesce(F.col("_p_lat"), F.lit(0).cast(LAT))
    cnt = F.col("_cum_has") - F.coalesce(F.col("_p_has"), F.lit(0))
    return j.select("request_id", "endpoint", "ts",
                    F.round(F.try_divide(total.cast("double"), cnt), 6).alias("rolling_latency_ms"))


def requests_last_second(log: DataFrame, max_rps: int = 5, headroom: float = 0.8) -> DataFrame:
    """Requests of the same endpoint with ``ts`` in ``(t - 1 s, t]`` at each request, and
    whether the endpoint still has headroom (``< headroom × max_rps``).

    As-of counting without a range join: probes at ``t`` and ``t - 1 s`` are
    merged into the ordered request stream; the running count of requests
    at each probe is the number of requests at or before it.
    """
    data = log.select("endpoint", "ts", "request_id", F.lit(0).alias("kind"),
                      F.lit(1).alias("is_req"), F.lit(None).cast("bigint").alias("probe_of"),
                      F.lit(None).cast("int").alias("probe_side"))
    at = log.select("endpoint", "ts", "request_id", F.lit(1).alias("kind"), F.lit(0).alias("is_req"),
                    F.col("request_id").alias("probe_of"), F.lit(0).alias("probe_side"))
    back = log.select("endpoint", (F.col("ts") - F.expr("INTERVAL 1 SECOND")).alias("ts"), "request_id",
                      F.lit(1).alias("kind"), F.lit(0).alias("is_req"),
                      F.col("request_id").alias("probe_of"), F.lit(1).alias("probe_side"))
    s = keyed_scan(data.unionByName(at).unionByName(back), "endpoint", ["ts", "kind", "request_id", "probe_side"],
                   sums=["is_req"])
    probes = s.where(F.col("kind") == 1)
    now = probes.where(F.col("probe_side") == 0).select("probe_of", "endpoint", "ts",
                                                       F.col("_cum_is_req").alias("_upto_now"))
    ago = probes.where(F.col("probe_side") == 1).select("probe_of", F.col("_cum_is_req").alias("_upto_ago"))
    j = now.join(ago, "probe_of")
    recent = (F.col("_upto_now") - F.coalesce(F.col("_upto_ago"), F.lit(0))).cast("bigint")
    return j.select(F.col("probe_of").alias("request_id"), "endpoint", "ts", recent.alias("requests_last_second"),
                    (recent < F.lit(headroom * max_rps)).alias("has_headroom"))


def failure_runs(log: DataFrame, window_seconds: int = FAILURE_WINDOW_SECONDS) -> DataFrame:
    """Consecutive-failure count per endpoint, reset to 1 after a gap > ``window_seconds``.

    Sessionisation in three set steps: position of each failure (scan),
    previous failure's time (equi-join on position − 1), session start
    position carried forward (scan with running max).
    """
    f = log.where(~F.col("ok")).select("request_id", "endpoint", "ts")
    s = keyed_scan(f, "endpoint", ORDER)
    prev = s.select("endpoint", (F.col("_seq") + 1).alias("_seq"), F.col("ts").alias("_prev_ts"))
    j = s.join(prev, ["endpoint", "_seq"], "left")
    gap = F.timestamp_diff("MICROSECOND", F.col("_prev_ts"), F.col("ts"))
    starts = j.withColumn("_start", F.when(F.col("_prev_ts").isNull() | (gap > window_seconds * 1_000_000),
                                           F.col("_seq")))
    s2 = keyed_scan(starts.drop("_seq"), "endpoint", ORDER, maxes=["_start"])
    return s2.select("request_id", "endpoint", "ts",
                     (F.col("_seq") - F.col("_cmax__start") + 1).alias("failure_run"))


def counter_rate(log: DataFrame, minutes: int = 1) -> DataFrame:
    """Requests per endpoint in tumbling ``minutes`` windows, as a per-minute rate."""
    w = F.window("ts", f"{minutes} minute")
    return (log.groupBy("endpoint", w.alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"))
            .select("endpoint", F.col("w.start").alias("window_start"), "requests",
                    (F.col("requests") / F.lit(float(minutes))).alias("per_minute")))


def endpoint_totals(log: DataFrame, threshold: int = FAILURE_THRESHOLD, as_of: str | None = None,
                    window_seconds: int = FAILURE_WINDOW_SECONDS) -> DataFrame:
    """Per endpoint requests, failures, latest failure run and healthy flag; plus an 'ALL' row.

    An endpoint is unhealthy while its latest failure run reaches the breaker
    threshold and its last failure lies within the failure window before
    ``as_of`` (default: the log's last time).  An old run does not count.
    """
    per = log.groupBy("endpoint").agg(F.count(F.lit(1)).alias("requests"),
                                      F.count_if(~F.col("ok")).alias("failures"), F.max("ts").alias("last_ts"))
    # One row an endpoint from here on.
    now = F.lit(as_of).cast(log.schema["ts"].dataType) if as_of else F.max("last_ts").over(Window.partitionBy())
    last_run = (failure_runs(log, window_seconds).groupBy("endpoint")
                .agg(F.max_by("failure_run", F.struct("ts", "request_id")).alias("last_failure_run"),
                     F.max("ts").alias("last_failure")))
    since = F.timestamp_diff("MICROSECOND", F.col("last_failure"), F.col("now"))
    ep = (per.withColumn("now", now).join(last_run, "endpoint", "left")
          .withColumn("last_failure_run", F.coalesce(F.col("last_failure_run"), F.lit(0).cast("bigint")))
          .withColumn("healthy", (F.col("last_failure_run") < threshold) | (since > window_seconds * 1_000_000))
          .drop("last_ts", "now", "last_failure"))
    total = ep.agg(F.lit("ALL").alias("endpoint"), F.sum("requests").alias("requests"),
                   F.sum("failures").alias("failures"), F.lit(None).cast("bigint").alias("last_failure_run"),
                   F.lit(None).cast("boolean").alias("healthy"),
                   F.count_if(F.col("healthy")).alias("healthy_endpoints"))
    return ep.withColumn("healthy_endpoints", F.lit(None).cast("bigint")).unionByName(total)


def batch_outcomes(events: DataFrame, failed: DataFrame, batch_rows: int = 500) -> DataFrame:
    """Per collector (event type) and batch: processed, inserted, duplicates, errors, running totals.

    A row is inserted by the first batch that delivers its key; later
    deliveries count as duplicates.  ``failed``: (event_type, slot) of the
    documents that could not be read; a batch may hold nothing else.  Running
    totals use the keyed scan.  Deliveries are counted per batch and key, so
    that both counts of a batch come from one pass over ``events``; the row a
    batch that results is written down, since the scan reads it several times.
    """
    batch = F.floor(F.col("slot") / batch_rows).cast("bigint")
    b = events.groupBy("event_type", "signature", batch.alias("batch_id")).agg(F.count(F.lit(1)).alias("n"))
    errors = failed.groupBy("event_type", batch.alias("batch_id")).agg(F.count(F.lit(1)).alias("errors"))
    first = F.min("batch_id").over(Window.partitionBy("event_type", "signature"))
    per = (b.withColumn("first", F.when(F.col("batch_id") == first, 1).otherwise(0)).groupBy("event_type", "batch_id")
           .agg(F.sum("n").alias("processed"), F.sum("first").alias("inserted")))
    checkpoint_dir(events.sparkSession)
    j = (per.join(errors, ["event_type", "batch_id"], "full")
         .na.fill(0, ["processed", "inserted", "errors"])
         .withColumn("duplicates", F.col("processed") - F.col("inserted"))).checkpoint(eager=True)
    s = keyed_scan(j, "event_type", ["batch_id"], sums=["inserted", "duplicates", "processed", "errors"])
    return s.select("event_type", "batch_id", "processed", "inserted", "duplicates", "errors",
                    F.col("_cum_inserted").alias("total_inserted"),
                    F.col("_cum_duplicates").alias("total_duplicates"),
                    F.col("_cum_processed").alias("total_processed"),
                    F.col("_cum_errors").alias("total_errors"))


def current_rps(log: DataFrame, as_of: str | None = None) -> DataFrame:
    """W10 at one moment: requests of each endpoint in the second up to ``as_of`` (default: the log's last time).

    Endpoints without one have 0.
    """
    ts = log.schema["ts"].dataType
    now = log.select(F.lit(as_of).cast(ts).alias("now")).limit(1) if as_of else log.agg(F.max("ts").alias("now"))
    recent = (F.col("ts") <= F.col("now")) & (F.col("ts") > F.col("now") - F.expr("INTERVAL 1 SECOND"))
    return (log.join(F.broadcast(now)).groupBy("endpoint").agg(F.count_if(recent).alias("current_rps")))   # one row beside each


def metrics_long(spark: SparkSession, ev: DataFrame, log: DataFrame, outcomes: DataFrame, prefix: str = "orders") -> DataFrame:
    """Exposition lines ``name{label="v"} value`` for orders, parse outcomes and endpoint counters.

    ``outcomes``: one row a document (``parse_outcomes``).  Each block is a
    small aggregate; the blocks are stacked with ``unionByName``.
    """
    def line(metric, mtype, label_key, label_val, value):
        labels = F.when(label_val.isNull(), F.lit("")).otherwise(
            F.concat(F.lit("{" + label_key + '="'), label_val, F.lit('"}')))
        return [F.lit(metric).alias("metric"), F.lit(mtype).alias("type"),
                label_val.alias("label"), value.cast("double").alias("value"),
                F.concat(F.lit(metric), labels, F.lit(" "), value.cast("string")).alias("line")]

    orders = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        *line(f"{prefix}_events_total", "gauge", "type", F.col("event_type"), F.col("n")))
    # One row; its three gauges are stacked, so the scan behind it runs once.
    names = ("requests", "counter", f"{prefix}_rpc_requests_total"), ("failures", "counter", f"{prefix}_rpc_failures_total"), \
        ("healthy_endpoints", "gauge", f"{prefix}_rpc_healthy_endpoints")
    totals = (endpoint_totals(log).where(F.col("endpoint") == "ALL")
              .select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("type"), F.col(c).cast("bigint").alias("n"))
                                          for c, t, m in names])).alias("x")).select("x.*"))
    totals = totals.select("metric", "type", F.lit(None).cast("string").alias("label"), F.col("n").cast("double").alias("value"),
                           F.concat_ws(" ", "metric", F.col("n").cast("string")).alias("line"))
    lat = (rolling_latency(log).groupBy("endpoint")
           .agg(F.max_by("rolling_latency_ms", F.struct("ts", "request_id")).alias("v"))
           .select(*line(f"{prefix}_rpc_latency_ms", "gauge", "endpoint", F.col("endpoint"),
                         F.round(F.col("v")).cast("bigint"))))
    counts = outcomes.agg(*[F.count_if(F.col("outcome") == r).alias(r) for r in RESULTS])
    parse = (counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("result"), F.col(r).alias("n")) for r in RESULTS])).alias("x"))
             .select("x.*").select(*line(f"{prefix}_parse_total", "counter", "result", F.col("result"), F.col("n"))))
    rps = current_rps(log).select(*line(f"{prefix}_rpc_current_rps", "gauge", "endpoint", F.col("endpoint"), F.col("current_rps")))
    return orders.unionByName(parse).unionByName(totals).unionByName(rps).unionByName(lat)
