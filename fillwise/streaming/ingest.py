"""Resumable collection as Structured Streaming (ST1, ST2, ST6, ST8–ST10, ST12, ST14).

Landed documents (raw transactions or already-decoded events) are read by a
file stream with a fixed schema.  Every micro-batch goes through
``foreachBatch``: malformed lines and failed documents to the quarantine
table, the others decoded (raw only) → dedup insert into the event table
against the bucketed key store (``sources.keystore``) → partial view
aggregates (ST6) → a checkpoint row in ``collection_progress``.  Each output
is replaced when the batch is tried again.  The stream's own offsets live in
``checkpointLocation``, so stop / restart resumes where it left off (ST9).

A batch costs what it holds: the stored keys are not shuffled, the inserted
rows are computed once and kept for all outputs, and the running total needs
the previous batch's row only.

Backfill arrives newest-first (ST14).  A file source does not care about
arrival order, so there is no watermark on the ingest path: a 1-hour
watermark would drop almost the whole history as late data.  Watermarks
are used only by the live-tail measures in ``streaming.live``.
"""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.operators import views as V
from fillwise.operators.decode import decode_events, is_well_formed
from fillwise.schema import DEDUP_KEY, EVENT_COLUMNS, EVENT_DOC, QUARANTINE, STORED_PROGRESS
from fillwise.session import checkpoint_dir, release
from fillwise.sources import io as IO
from fillwise.sources.keystore import KeyStore
from fillwise.sources.rawtx import CORRUPT, RAW_LINES
from fillwise.streaming.metrics import BatchMetrics, observed

def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/fillwise-{name}-{uuid.uuid4().hex[:12]}"


@dataclass
class IngestPaths:
    table: str
    progress: str
    checkpoint: str
    daily_view: str
    token_view: str
    size_view: str
    keys: str
    quarantine: str
    metrics: str

    @classmethod
    def under(cls, root: str) -> "IngestPaths":
        return cls(table=f"{root}/order_events", progress=f"{root}/collection_progress",
                   checkpoint=f"{root}/_checkpoints/ingest", daily_view=f"{root}/mv_daily_partials",
                   token_view=f"{root}/mv_token_partials", size_view=f"{root}/mv_size_partials", keys=f"{root}/event_keys",
                   quarantine=f"{root}/quarantine", metrics=f"{root}/batch_metrics")


@dataclass
class IngestReport:
    """ST12: running counters of this process and the last batch's numbers.

    The stored progress table is the record; this keeps a fixed number of
    values however long the stream runs.
    """
    batches: int = 0
    delivered: int = 0
    inserted: int = 0
    duplicates: int = 0
    errors: int = 0
    total: int = 0
    last: dict = field(default_factory=dict)
    metrics: BatchMetrics | None = None

    def add(self, batch_id: int, counts: dict, total: int) -> None:
        self.batches += 1
        self.delivered += counts["batch_rows"]
        self.inserted += counts["inserted"]
        self.duplicates += counts["duplicates"]
        self.errors += counts["errors"]
        self.total = total
        self.last = {"batch_id": batch_id, **counts, "total": total}


def unreadable(raw: DataFrame) -> DataFrame:
    """Quarantine rows of raw documents: lines that are no document, and documents without a message.

    ``raw``: rows of ``RAW_LINES``.
    """
    return with_reason(raw).where(F.col("reason").isNotNull()).select(*UNREADABLE)


UNREADABLE = ("reason", "signature", "line")


def with_reason(raw: DataFrame) -> DataFrame:
    """``raw`` with ``reason`` and ``line`` where a document is unreadable, and NULL elsewhere."""
    malformed = F.col(CORRUPT).isNotNull()
    reason = F.when(malformed, "malformed").when(~is_well_formed(), "failed")
    whole = F.to_json(F.struct(*[c for c in RAW_LINES.fieldNames() if c != CORRUPT]))
    return raw.select("*", reason.alias("reason"), F.when(malformed, F.col(CORRUPT)).when(~is_well_formed(), whole).alias("line"))


def decoded_or_aside(spark: SparkSession, raw: DataFrame, encoding: str) -> DataFrame:
    """The decoded events of ``raw``, and one row with ``reason`` and ``line`` for each unreadable document.

    The documents, which are much wider than what is made of them, are parsed once and not kept.
    """
    marked = with_reason(raw)
    whole = F.col("reason").isNull()                        # what a broken line gave before it broke off is not decoded
    marked = marked.withColumns({c: F.when(whole, F.col(c)) for c in ("meta", "transaction")})
    return decode_events(spark, marked, encoding, ("reason", "line")).drop("ix_pos")


def write_quarantine(raw: DataFrame, path: str, batch_id: int) -> int:
    """Store the unreadable rows of a batch, replacing an earlier attempt; returns how many there are."""
    bad = unreadable(raw)
    errors = bad.count()
    if errors:
        _quarantined(bad, path, batch_id)
    return errors


def _quarantined(bad: DataFrame, path: str, batch_id: int) -> None:
    (bad.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


class TargetReached(Exception):
    """Ends a stream between batches; the batch that it refuses is not committed and comes first on resuming."""


def _events_sink(spark: SparkSession, paths: IngestPaths, program_id: str, report: IngestReport,
                 decode: bool, encoding: str, target: int | None):
    def sink(batch: DataFrame, batch_id: int) -> None:
        if target is not None and report.total >= target:
            raise TargetReached(f"{report.total} of {target} events are stored")
        errors, aside = 0, ()
        if decode:
            batch, aside = decoded_or_aside(spark, batch, encoding), ("reason", "line")
        kept = batch.select(*[c for c in EVENT_COLUMNS if c in batch.columns], *aside).persist()
        try:
            events = kept
            if decode:
                errors = kept.where(F.col("reason").isNotNull()).count()
                if errors:
                    _quarantined(kept.where(F.col("reason").isNotNull()).select(*UNREADABLE), paths.quarantine, batch_id)
                events = kept.where(F.col("reason").isNull()).drop(*aside)
            store_batch(spark, events, batch_id, paths, program_id, report, errors)
        finally:
            kept.unpersist()
    return sink


def at_once(spark: SparkSession, *steps):
    """Run independent steps side by side, so that small jobs don't wait for one another; their results in order.

    All of them have ended when it returns or raises the first error.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [r.result() for r in running]


def store_batch(spark: SparkSession, events: DataFrame, batch_id: int, paths: IngestPaths, program_id: str,
                report: IngestReport, errors: int = 0) -> None:
    """Insert a batch, its keys, view partials and progress row; doing it again changes nothing.

    The rows to insert are computed once, by writing them; keys, partials and
    counts read them there, each its own columns, side by side.  Keys are
    stored after the rows: a batch that failed in between is tried again
    under its id and ignores its own keys.
    """
    keys = KeyStore(spark, paths.keys)
    delivered = events.count()
    fresh = IO.latest_of_table(events, delivered).join(keys.seen(events, batch_id), list(DEDUP_KEY), "left_anti")
    IO.write_batch(IO.table_rows(fresh), paths.table, batch_id, "overwrite")
    rows = IO.stored_batch(spark, paths.table, batch_id)       # a few columns at a time, instead of all of them kept
    # ST6: partial view aggregates of exactly the rows this batch inserted.
    _, _, _, _, n = at_once(
        spark,
        lambda: keys.add(rows, batch_id),
        lambda: V.write_partials(V.daily_partials(rows), paths.daily_view),
        lambda: V.write_partials(V.token_partials(rows), paths.token_view),
        lambda: V.write_partials(V.size_partials(rows), paths.size_view),
        lambda: rows.agg(F.count(F.lit(1)).alias("inserted"),
                         F.max_by("signature", F.struct("block_time", "signature")).alias("last")).first())
    counts = {"batch_rows": delivered, "inserted": n["inserted"], "duplicates": delivered - n["inserted"], "errors": errors}
    total = IO.progress_write(spark, paths.progress, batch_id, program_id, "all", n["last"], delivered, n["inserted"], errors)
    report.add(batch_id, counts, total)


def start_ingest(spark: SparkSession, source: str, paths: IngestPaths, *, raw: bool = False,
                 encoding: str = "base58", max_files_per_trigger: int = 1, program_id: str = "fillwise",
                 available_now: bool = True, report: IngestReport | None = None, target: int | None = None):
    """ST1: start the collection stream; returns ``(query, report)``.

    ``available_now`` processes what is landed and stops (backfill, ST8);
    otherwise the query keeps polling every 2 seconds (live tail).  Raw
    documents without a block time take their file's modification time, which
    is the same when a batch is tried again.  What each batch delivered is
    observed in the stream and stored by a listener (``streaming.metrics``).
    """
    report = report if report is not None else IngestReport()
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).option("mode", "PERMISSIVE")
    if raw:
        stream = reader.schema(RAW_LINES).option("columnNameOfCorruptRecord", CORRUPT).json(source)
        stream = stream.select("*", F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ingest_time"))
    else:
        stream = reader.schema(EVENT_DOC).json(source)
    report.metrics = BatchMetrics(spark, paths.metrics)
    writer = (observed(stream, CORRUPT if raw else None).writeStream
              .foreachBatch(_events_sink(spark, paths, program_id, report, raw, encoding, target))
              .option("checkpointLocation", paths.checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    query = writer.start()
    report.metrics.follow(query)
    return query, report


def run_ingest(spark: SparkSession, source: str, paths: IngestPaths, **kw) -> IngestReport:
    """ST1 backfill: ingest everything landed so far, then return the counters."""
    q, report = start_ingest(spark, source, paths, **kw)
    q.awaitTermination()
    report.metrics.close()
    if q.exception() is not None:
        raise q.exception()
    return report


def collect_until_target(spark: SparkSession, source: str, paths: IngestPaths, target: int,
                         max_files_per_trigger: int = 1, **kw) -> IngestReport:
    """ST8 + L4: keep running bounded ingest rounds until ``target`` events are stored.

    Already at target → returns at once.  Each round is an ``availableNow`` run
    of at most ``max_files_per_trigger`` files per batch, so the remainder
    resumes from the checkpoint on the next call.  The stored count is the
    sum of the progress rows, one per batch, not a scan of the table.
    """
    report = IngestReport()
    while True:
        before = collected(spark, paths.progress)
        if before >= target:
            return report
        q, report = start_ingest(spark, source, paths, max_files_per_trigger=max_files_per_trigger,
                                 report=report, target=target, **kw)
        # Pause (ST9) between batches: the first batch after the target is refused.
        try:
            q.awaitTermination()
        except StreamingQueryException as e:
            if TargetReached.__name__ not in str(e):
                raise
        finally:
            report.metrics.close()
        if collected(spark, paths.progress) == before:
            return report          # nothing new landed


def collected(spark: SparkSession, progress: str) -> int:
    """Events inserted so far, by the progress rows."""
    rows = IO.stored(spark, progress, STORED_PROGRESS)
    return int(rows.agg(F.coalesce(F.sum("inserted"), F.lit(0)).alias("n")).first()["n"])


def two_streams(spark: SparkSession, sources: dict[str, str], root: str, parallel: bool = True,
                **kw) -> dict[str, IngestReport]:
    """ST10: one collection stream per program (e.g. created / fulfilled), own checkpoints.

    In parallel both queries run at once in the same session, a scheduler
    pool each: under ``spark.scheduler.mode=FAIR`` (``session.get_spark`` sets
    it, with the shares of ``pools.xml``) neither waits for the other's tasks.
    In sequence the second starts after the first ends.
    """
    reports, queries = {}, []
    for name, src in sources.items():
        paths = IngestPaths.under(f"{root}/{name}")
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        q, rep = start_ingest(spark, src, paths, program_id=name, **kw)
        reports[name] = rep
        queries.append(q)
        if not parallel:
            q.awaitTermination()
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    for q, report in zip(queries, reports.values()):
        q.awaitTermination()
        report.metrics.close()
        if q.exception() is not None:
            raise q.exception()
    return reports


ROWS_PER_FILE = 125_000           # landed files and batches are bounded, however large the tables
FILES_PER_BATCH = 256            # enough files for all cores; fewer batches look the stored keys up less often
DOCS_PER_FILE = 100_000          # a raw document is some ten times as large as an event
DOC_FILES_PER_BATCH = 160


FAST = {"zlib.compress.level": "BEST_SPEED"}      # writer option: gzip takes about half the time and a sixth more space


def file_count(rows: int, least: int, per_file: int | None = None) -> int:
    """How many files ``rows`` rows are landed in: ``least``, and more where a file would grow too large."""
    return max(least, -(-rows // (per_file or ROWS_PER_FILE)))


def files_per_batch(files: int, least: int, per_trigger: int, most: int | None = None) -> int:
    """Files a batch takes when ``files`` instead of ``least`` were landed: the same share of them, up to a bound."""
    return max(per_trigger, min(most or FILES_PER_BATCH, -(-per_trigger * files // least)))


def land_files(df: DataFrame, landing: str, files: int, by: list[str], newest_first: bool = False,
               time_col: str = "block_time", arrive_after: float | None = None, copies: int = 1,
               compression: str = "none", fast: bool = False) -> float:
    """Land ``df`` as ``files`` JSON files in one parallel write and fix their arrival order.

    Rows are range-partitioned on ``by`` (rows sharing those values share a
    file) and written ``copies`` times each.  The file source picks files up in modification-time order, so
    after the write every file gets a modification time ranked by its newest
    ``time_col`` value (descending for a newest-first backfill, ascending for
    a live tail).  Only one row per *file* reaches the driver.  ``fast``
    compresses less well in less time.  Returns the
    last arrival time used, so a later landing can arrive after this one.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(files, *[F.col(c) for c in by])
    if copies > 1:
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy")).drop("_copy")
    dealt.write.mode("overwrite").options(compression=compression, **(FAST if fast else {})).json(landing)
    release(spark)
    per_file = (spark.read.schema(df.schema).json(landing)
                .groupBy(F.input_file_name().alias("f")).agg(F.max(time_col).alias("t")).collect())
    ordered = sorted(per_file, key=lambda r: (r["t"] is None, r["t"]), reverse=newest_first)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    start = arrive_after if arrive_after is not None else 1_600_000_000_000.0
    t = start
    for r in ordered:
        path = jvm.org.apache.hadoop.fs.Path(r["f"])
        t += 1000
        path.getFileSystem(conf).setTimes(path, int(t), -1)
    return t


def land_event_files(events: DataFrame, landing: str, parts: int = 10, replay_part: int | None = 3,
                     newest_first: bool = True, replay_of: int | None = None, compression: str = "none") -> float:
    """Backfill fixture (FIXTURES §4): ``parts`` files split by slot, newest first, plus the rows of
    one ``slot % replay_of`` class (default ``parts``) delivered a second time (at-least-once replay).

    Every duplicate of a key shares its slot, so a key never spans two files.  A replay file holds no more rows than
    one of the others.
    """
    last = land_files(events, f"{landing}/main", parts, ["slot"], newest_first=newest_first, compression=compression, fast=True)
    if replay_part is not None:
        again = events.where((F.col("slot") % (replay_of or parts)) == replay_part)
        files = max(1, parts // 5, -(-parts // (replay_of or parts)))
        last = land_files(again, f"{landing}/replay", files, ["slot"], arrive_after=last, compression=compression, fast=True)
    return last


def landing_glob(landing: str) -> str:
    return os.path.join(landing, "*", "*.json*")
