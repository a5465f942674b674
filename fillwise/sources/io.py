"""Landing, normalising and serialising event rows.

The stored table has one layout, ``batch_id=N/ym=yyyyMM``.  A batch writes
under its own id with dynamic partition overwrite, so a retried batch
replaces exactly what it wrote before; plain appends and compacted rows are
batch ``APPENDED``.  Readers always go through ``dedup.latest``.  Only a
missing folder counts as "nothing stored"; any other failure is raised.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.operators.dedup import latest, new_events
from fillwise.schema import CHAIN_ID, DEDUP_KEY, EVENT_COLUMNS, STORED_EVENTS, STORED_PROGRESS, TABLE_PARTITIONS
from fillwise.session import release

APPENDED = -1
U64_MAX = 18446744073709551615
STRING_FIELDS = ("maker", "give_token_address", "give_token_symbol", "take_token_address",
                 "take_token_symbol", "receiver", "taker")
AMOUNT_FIELDS = ("give_amount", "take_amount", "fulfilled_amount")
USD_FIELDS = ("give_amount_usd", "take_amount_usd", "fulfilled_amount_usd")


# ---------------------------------------------------------------------------
# P9 normalise_event / S4 append_events
# ---------------------------------------------------------------------------
def _falsy_to_null(c: str, kind: str) -> Column:
    col = F.col(c)
    if kind == "string":
        return F.when(col != "", col)
    if kind == "double":
        return F.when(~F.isnan(col) & (col != 0), col)
    return F.when(col != 0, col)


def normalise_events(df: DataFrame) -> DataFrame:
    """Falsy → NULL ('' / 0 / NaN), chain ids outside u64 → NULL, time floored to seconds.

    Unknown input columns are dropped (the table schema wins), missing
    optional columns become NULL.
    """
    present = set(df.columns)
    cols = []
    for name in EVENT_COLUMNS:
        if name not in present:
            if name == "created_at":
                cols.append(F.current_timestamp().alias(name))
            elif name == "_version":
                cols.append(F.unix_timestamp().alias(name))
            else:
                cols.append(F.lit(None).alias(name))
            continue
        if name in STRING_FIELDS:
            cols.append(_falsy_to_null(name, "string").alias(name))
        elif name in AMOUNT_FIELDS:
            cols.append(_falsy_to_null(name, "amount").cast("decimal(38,0)").alias(name))
        elif name in USD_FIELDS:
            cols.append(_falsy_to_null(name, "double").alias(name))
        elif name in ("give_chain_id", "take_chain_id"):
            # u64 range check as in the source system.
            c = F.col(name).cast(CHAIN_ID)
            in_range = (c >= 0) & (c <= F.lit(str(U64_MAX)).cast(CHAIN_ID))
            cols.append(F.when(in_range, c).alias(name))
        elif name == "block_time":
            cols.append(F.date_trunc("second", F.col(name)).cast(df.schema[name].dataType).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def with_month(df: DataFrame) -> DataFrame:
    """Add the ``ym`` partition column (yyyyMM of ``block_time``)."""
    return df.withColumn("ym", F.date_format("block_time", "yyyyMM").cast("int"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder was created yet, in whatever file system ``path`` names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored(spark: SparkSession, path: str, schema=STORED_EVENTS) -> DataFrame:
    """The rows stored under ``path``; no rows while the folder does not exist.  Read failures raise."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def stored_batch(spark: SparkSession, path: str, batch_id: int, schema=STORED_EVENTS) -> DataFrame:
    """The rows of one batch; only its own folders are listed."""
    folder = f"{path.rstrip('/')}/batch_id={int(batch_id)}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(folder)


def drop_batches(spark: SparkSession, path: str, before: int) -> None:
    """Delete the folders ``batch_id=N`` of batches earlier than ``before``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) < before:
            fs.delete(status.getPath(), True)


def table_rows(batch: DataFrame) -> DataFrame:
    """Normalised rows in the stored column types."""
    return with_month(normalise_events(batch)).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED_EVENTS.fields if f.name != "batch_id"])


def write_batch(rows: DataFrame, path: str, batch_id: int, mode: str) -> None:
    """Write ``rows`` (with ``ym``) under one batch id.

    ``rebalance`` gathers a month's rows for few files but lets AQE split a
    month that holds most of them, so a live tail is not one writer task.
    """
    w = (rows.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint")).hint("rebalance", "ym")
         .sortWithinPartitions("ym", "signature", "event_type").write.mode(mode))
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy(*TABLE_PARTITIONS).parquet(path)
    release(rows.sparkSession)


def append_events(batch: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Normalise and append a batch under ``path``.

    With a ``batch_id`` replaying the same batch replaces its own files
    (idempotent on retry) instead of adding copies; without one the rows are
    added to batch ``APPENDED``.
    """
    if batch_id is None:
        write_batch(table_rows(batch), path, APPENDED, "append")
    else:
        write_batch(table_rows(batch), path, batch_id, "overwrite")


ROWS_PER_SORT = 1_000_000         # stored rows a task sorts in memory; few sorted pieces make the sort by month cheap
ROWS_PER_PASS = 50_000_000        # stored rows that compaction shuffles at a time
HOT_SEEN = 25                     # a key found so often in the sample holds a good part of a piece's rows


def hot_keys(rows: DataFrame, key: Sequence[str] = DEDUP_KEY) -> list:
    """Keys that hold about ``ROWS_PER_SORT`` rows or more, found in a sample of the key columns.

    Four times ``HOT_SEEN`` rows of such a key are expected in the sample, so none is missed in practice.  The list
    has at most one key for a quarter piece of rows.  It only chooses how a key's rows are shuffled.
    """
    found = rows.select(*key).sample(min(1.0, 4 * HOT_SEEN / ROWS_PER_SORT), seed=1)
    return found.groupBy(*key).count().where(F.col("count") >= HOT_SEEN).select(*key).collect()


def latest_of_table(rows: DataFrame, n: int | None = None) -> DataFrame:
    """``latest`` over ``n`` rows (default: counted), as a whole stored table, whose file splits are too large to be sorted in memory.

    The wide rows go to pieces of bounded size by their key and are sorted there, once.  ``latest`` alone would sort
    each file split before the shuffle as well, which only spares the shuffle of a hot key's rows: that way is kept
    for the hot keys.
    """
    n = rows.count() if n is None else n                             # from the files' footers
    if n <= ROWS_PER_SORT:
        return latest(rows)
    pieces, hot = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_SORT)), hot_keys(rows)
    if not hot:
        return latest(rows.repartition(pieces, *DEDUP_KEY))
    keys = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*DEDUP_KEY).schema).toDF(*[f"hot_{c}" for c in DEDUP_KEY]))
    same = F.lit(True)
    for c in DEDUP_KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"hot_{c}"))
    others = rows.join(keys, same, "left_anti").repartition(pieces, *DEDUP_KEY)
    return latest(others).unionByName(latest(rows.join(keys, same, "left_semi")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """S3: the stored table through keep-latest dedup (``FROM orders FINAL``)."""
    return latest_of_table(stored(spark, path).drop("batch_id"))


def stored_before(spark: SparkSession, path: str, batch_id: int, batch: DataFrame | None = None,
                  immutable_time: bool = False) -> DataFrame:
    """Rows of earlier batches.

    With ``immutable_time`` (chain data: a key's block time never changes)
    only the months that ``batch`` touches are read, so a batch costs its own
    months and not the whole history.  The month list is one value per
    calendar month.
    """
    rows = stored(spark, path).where(F.col("batch_id") < batch_id)
    if immutable_time and batch is not None:
        months = [r["ym"] for r in with_month(batch).select("ym").distinct().collect()]
        rows = rows.where(F.col("ym").isin([m for m in months if m is not None]))
    return rows.drop("batch_id")


def dedup_insert(spark: SparkSession, batch: DataFrame, path: str, batch_id: int,
                 immutable_time: bool = False) -> dict:
    """Insert only keys not stored yet; return batch / inserted / duplicate counts.

    Rows of this batch land in ``batch_id=N`` (dynamic partition overwrite),
    so a replayed batch replaces its own earlier attempt; the anti join only
    looks at *earlier* batches for the same reason.  ``inserted`` is counted
    from what was actually written.  The stored keys are read from the table
    itself; ``streaming.ingest`` keeps them in a bucketed ``KeyStore`` instead.
    """
    total = batch.count()
    append_events(new_events(batch, stored_before(spark, path, batch_id, batch, immutable_time)), path, batch_id)
    inserted = batch_rows_written(spark, path, batch_id)
    return {"batch_rows": total, "inserted": inserted, "duplicates": total - inserted}


def batch_rows_written(spark: SparkSession, path: str, batch_id: int) -> int:
    """Rows stored under ``batch_id=N`` (0 when the batch wrote nothing)."""
    return stored_batch(spark, path, batch_id).count()


def insert_counts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """S5 as a query: batch rows, rows inserted, duplicates (one row)."""
    fresh = new_events(batch, stored)
    b = batch.agg(F.count(F.lit(1)).alias("batch_rows")).withColumn("_k", F.lit(1))
    n = fresh.agg(F.count(F.lit(1)).alias("inserted")).withColumn("_k", F.lit(1))
    return (b.join(n, "_k").drop("_k")
            .withColumn("duplicates", F.col("batch_rows") - F.col("inserted")))


def compact_events(spark: SparkSession, path: str, out: str) -> None:
    """Write the table without superseded rows to ``out``, in the same layout.

    Since the dedup key does not contain the month, dedup runs over the whole
    table.  A table of more than ``ROWS_PER_PASS`` rows is taken in passes by
    the hash of the signature, each over the whole table, so that a part of
    it is in shuffle files at a time.  ``swap_table`` puts the copy in place
    afterwards (single writer).
    """
    passes = -(-stored(spark, path).count() // ROWS_PER_PASS)
    if passes <= 1:
        write_batch(read_events(spark, path), out, APPENDED, "overwrite")
        return
    left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/batch_id={APPENDED}")   # of an earlier attempt
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)
    for k in range(passes):
        rows = stored(spark, path).drop("batch_id").where(F.pmod(F.xxhash64("signature"), F.lit(passes)) == k)
        write_batch(latest_of_table(rows), out, APPENDED, "append")


def swap_table(spark: SparkSession, path: str, compacted: str, retired: str) -> None:
    """Rename ``path`` to ``retired`` and ``compacted`` to ``path``.

    If the second rename fails the first is undone, so readers find a table.
    """
    jvm = spark.sparkContext._jvm
    table, copy, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, compacted, retired))
    fs = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(copy):
        raise ValueError(f"nothing compacted at {compacted}")
    if not fs.rename(table, old):
        raise RuntimeError(f"cannot retire {path}")
    if not fs.rename(copy, table):
        fs.rename(old, table)
        raise RuntimeError(f"cannot move {compacted} to {path}")


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def init_schema(spark: SparkSession, database: str, location: str) -> None:
    """``CREATE DATABASE/TABLE IF NOT EXISTS`` for the two tables, in the layout that ingest writes."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema, parts in (("order_events", STORED_EVENTS, ", ".join(TABLE_PARTITIONS)),
                                ("collection_progress", STORED_PROGRESS, "batch_id")):
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {database}.{name} ({_ddl(schema)})
            USING parquet PARTITIONED BY ({parts}) LOCATION '{location}/{name}'""")


# ---------------------------------------------------------------------------
# S6 progress, S2 signature pages, P2, P12
# ---------------------------------------------------------------------------
def progress_read(latest_progress: DataFrame, keys: DataFrame) -> DataFrame:
    """S6 read: latest checkpoint per requested key, default ``(NULL, 0)`` when absent."""
    return (keys.join(latest_progress, ["program_id", "event_type"], "left")
            .select("program_id", "event_type", "last_signature",
                    F.coalesce(F.col("total_collected"), F.lit(0).cast("bigint")).alias("total_collected")))


def progress_write(spark: SparkSession, path: str, batch_id: int, program_id: str, event_type: str,
                   last_signature: str | None, delivered: int, inserted: int, errors: int = 0) -> int:
    """S6 write: this batch's checkpoint row; returns the running total.

    The total is the previous batch's total plus what this one inserted, and
    the row replaces an earlier attempt of the same batch: a replay counts
    once.  Only the previous batch's row is read; all earlier rows are summed
    where that batch left none.
    """
    mine = (F.col("program_id") == program_id) & (F.col("event_type") == event_type)
    last = stored_batch(spark, path, batch_id - 1, STORED_PROGRESS).where(mine).select("total_collected").first()
    if last is None and batch_id > 0:
        last = (stored(spark, path, STORED_PROGRESS).where((F.col("batch_id") < batch_id) & mine)
                .agg(F.sum("inserted")).first())
    total = int((last[0] if last else 0) or 0) + inserted
    row = spark.createDataFrame(
        [(program_id, event_type, last_signature, total, delivered, inserted, errors, batch_id)],
        "program_id STRING, event_type STRING, last_signature STRING, total_collected BIGINT, "
        "delivered BIGINT, inserted BIGINT, errors BIGINT, batch_id BIGINT").withColumn("updated_at", F.current_timestamp())
    (row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))
    return total


def progress_totals(progress: DataFrame) -> DataFrame:
    """S6 + ST12: newest checkpoint per (program, event type) of the stored progress."""
    newest = F.max_by(F.struct("last_signature", "updated_at"), F.col("batch_id"))
    return (progress.groupBy("program_id", "event_type")
            .agg(newest.alias("p"), F.sum("inserted").cast("bigint").alias("total_collected"))
            .select("program_id", "event_type", "p.last_signature", "total_collected", "p.updated_at"))


def page_signatures(sigs: DataFrame, limit: int = 1000, before: tuple | None = None) -> DataFrame:
    """Newest-first keyset page; ``has_more`` by reading ``limit + 1`` rows.

    ``before`` is the cursor ``(slot, signature)`` of the previous page's last row.
    """
    df = sigs
    if before is not None:
        slot, sig = before
        df = df.where((F.col("slot") < slot) | ((F.col("slot") == slot) & (F.col("signature") < sig)))
    probe = df.orderBy(F.desc("slot"), F.desc("signature")).limit(limit + 1)
    from pyspark.sql import Window
    w_all = Window.partitionBy()
    ranked = probe.withColumn("_n", F.count(F.lit(1)).over(w_all))
    ranked = ranked.withColumn("_pos", F.row_number().over(Window.orderBy(F.desc("slot"), F.desc("signature"))))
    return (ranked.where(F.col("_pos") <= limit)
            .withColumn("has_more", F.col("_n") > limit)
            .drop("_n", "_pos"))


def valid_signatures(sigs: DataFrame) -> DataFrame:
    """Count of signatures without error, failed ones, all."""
    return sigs.agg(F.count_if(~F.coalesce(F.col("err"), F.lit(False))).alias("valid"),
                    F.count_if(F.coalesce(F.col("err"), F.lit(False))).alias("failed"),
                    F.count(F.lit(1)).alias("total"))


def lookup_in_list(ev: DataFrame, signatures: Sequence[str]) -> DataFrame:
    """``signature IN (list)`` — a literal ``isin`` for short lists."""
    return ev.where(F.col("signature").isin(list(signatures)))


# ---------------------------------------------------------------------------
# S9 CSV, S12 wire form, S13 camelCase responses
# ---------------------------------------------------------------------------
# The export's column titles.
CSV_HEADERS = ["Order ID", "Type", "Give Token", "Give Amount USD", "Take Token", "Take Amount USD",
               "Maker", "Taker", "Time", "Transaction"]


def number_text(c: Column) -> Column:
    """Plain decimal text of a USD value (6 places, trailing zeros dropped)."""
    return F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def csv_rows(rows: DataFrame) -> DataFrame:
    """The export's 10 text columns; NULL becomes ''."""
    def txt(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))
    return rows.select(
        txt(F.col("order_id")).alias(CSV_HEADERS[0]),
        txt(F.col("event_type")).alias(CSV_HEADERS[1]),
        txt(F.col("give_token_symbol")).alias(CSV_HEADERS[2]),
        txt(number_text(F.col("give_amount_usd"))).alias(CSV_HEADERS[3]),
        txt(F.col("take_token_symbol")).alias(CSV_HEADERS[4]),
        txt(number_text(F.col("take_amount_usd"))).alias(CSV_HEADERS[5]),
        txt(F.col("maker")).alias(CSV_HEADERS[6]),
        txt(F.col("taker")).alias(CSV_HEADERS[7]),
        F.date_format("block_time", "yyyy-MM-dd HH:mm:ss").alias(CSV_HEADERS[8]),
        txt(F.col("signature")).alias(CSV_HEADERS[9]),
    )


def export_csv(rows: DataFrame, path: str) -> None:
    """Write ``csv_rows`` with a header and every cell quoted (inner quotes escaped)."""
    (csv_rows(rows).write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("emptyValue", "").option("escape", '"').csv(path))


def _amount_text(c: str) -> Column:
    return F.when(F.col(c) != 0, F.col(c).cast("string"))


WIRE_FIELDS = ["order_id", "event_type", "signature", "slot", "block_time", "maker", "give_token_symbol",
               "give_amount", "give_amount_usd", "give_chain_id", "take_token_symbol", "take_amount",
               "take_amount_usd", "take_chain_id", "taker", "fulfilled_amount", "fulfilled_amount_usd"]
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def to_wire(ev: DataFrame) -> DataFrame:
    """Amounts as decimal text (0 → absent), time as ISO-8601 UTC with millis."""
    out = []
    for c in WIRE_FIELDS:
        if c in AMOUNT_FIELDS:
            out.append(_amount_text(c).alias(c))
        elif c == "block_time":
            out.append(F.date_format(F.col(c), ISO_MILLIS).alias(c))
        else:
            out.append(F.col(c))
    return ev.select(*out)


def wire_json(ev: DataFrame) -> DataFrame:
    """S12 as JSON text (one document per event)."""
    return to_wire(ev).select(F.to_json(F.struct(*WIRE_FIELDS)).alias("json"))


def from_wire(wire: DataFrame, time_type: str = "timestamp_ntz") -> DataFrame:
    """S12 inverse: parse the JSON text back to typed columns (bad values → NULL; chain ids over the whole unsigned range)."""
    schema = ("order_id STRING, event_type STRING, signature STRING, slot BIGINT, block_time STRING, "
              "maker STRING, give_token_symbol STRING, give_amount STRING, give_amount_usd DOUBLE, "
              "give_chain_id DECIMAL(20,0), take_token_symbol STRING, take_amount STRING, take_amount_usd DOUBLE, "
              "take_chain_id DECIMAL(20,0), taker STRING, fulfilled_amount STRING, fulfilled_amount_usd DOUBLE")
    p = wire.select(F.from_json("json", schema).alias("w")).select("w.*")
    parse_time = F.to_timestamp_ntz if time_type == "timestamp_ntz" else F.to_timestamp
    return p.select(*[
        F.col(c).try_cast("decimal(38,0)").alias(c) if c in AMOUNT_FIELDS
        else parse_time(F.col(c), F.lit(ISO_MILLIS)).alias(c) if c == "block_time"
        else F.col(c)
        for c in WIRE_FIELDS])


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def camel_project(df: DataFrame, zero_fill: Sequence[str] = ()) -> DataFrame:
    """snake_case → camelCase; ``zero_fill`` columns get ``Number(x) || 0`` (NULL/NaN → 0)."""
    cols = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in zero_fill:
            col = F.coalesce(F.nanvl(col.cast("double"), F.lit(0.0)), F.lit(0.0))
        cols.append(col.alias(camel(c)))
    return df.select(*cols)


def read_events_since(spark: SparkSession, path: str, hours: int, as_of: str,
                      immutable_time: bool = False) -> DataFrame:
    """P6 over the stored table with month pruning when it is exact.

    Default: dedup first, then the time filter (a newer version of a key may
    carry another ``block_time``, so filtering first could resurrect an old
    version).  With ``immutable_time=True`` (chain data: a key's block time
    never changes) the filter — plus the derived ``ym`` partition predicate —
    is applied to the scan, so Spark reads only the months in range.
    """
    import datetime as dt

    from fillwise.functions.core import since_hours
    raw = stored(spark, path).drop("batch_id")
    if not immutable_time:
        return since_hours(latest(raw), hours, as_of)
    bound = dt.datetime.fromisoformat(as_of) - dt.timedelta(hours=int(hours))
    pruned = raw.where(F.col("ym") >= bound.year * 100 + bound.month)
    return latest(since_hours(pruned, hours, as_of))
