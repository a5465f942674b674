"""Derive the engine's input tables from the driver's TPC-H-style parquet tables.

The mapping is deterministic, so the DuckDB oracle can rebuild the very same
rows with plain SQL (see ``fillwise.plans.oracle``).  Everything here is a
projection plus the joins Catalyst plans itself: orders ⋈ customer and
lineitem ⋈ supplier ⋈ part are equi joins on keys; at scale they become
sort-merge joins (or broadcast joins when AQE measures a small side), never
driver-side lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.functions.core import epoch_ntz
from fillwise.sources.io import hot_keys

# Chain ids handed out by ``key % 12`` (11 -> NULL, 999999 is unknown).
CHAIN_ID_CYCLE = [1, 10, 56, 100, 137, 250, 8453, 42161, 43114, 7565164, 999999, None]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chain_of(index: Column) -> Column:
    ids = F.array(*[F.lit(v).cast("bigint") for v in CHAIN_ID_CYCLE])
    return F.get(ids, (index % len(CHAIN_ID_CYCLE)).cast("int"))


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


ROWS_PER_PIECE = 250_000          # event rows a task holds when it sorts them


def pieces(spark: SparkSession, rows: int) -> int:
    """How many pieces ``rows`` rows are dealt into, so that a task's share does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PIECE))


def _dealt(df: DataFrame, dealt: bool | str, rows: DataFrame, key: list[str], signature: Column) -> DataFrame:
    """``df`` in even pieces by the number of ``rows``: a file split holds ever more rows the larger the table is.

    ``dealt="key"``: by ``signature``, so that ``dedup.latest`` finds each key's rows together and the wide event rows
    need no shuffle of their own; evenly where some ``key`` of ``rows`` holds about a piece's rows.
    """
    if not dealt:
        return df
    n = pieces(df.sparkSession, rows.count())
    return df.repartition(n, signature) if dealt == "key" and not hot_keys(rows, key) else df.repartition(n)


def created_events(spark: SparkSession, sf_dir: str, dealt: bool | str = False) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("o_orderkey")
    null_s = F.lit(None).cast("string")
    null_d = F.lit(None).cast("double")
    null_a = F.lit(None).cast("decimal(38,0)")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left")
    signature = F.concat(F.lit("c-"), k.cast("string"))
    return (_dealt(joined, dealt, o, ["o_orderkey"], signature)
            .select(
                k.cast("string").alias("order_id"),
                F.lit("created").alias("event_type"),
                signature.alias("signature"),
                k.alias("slot"),
                F.col("o_orderdate").alias("block_time"),
                F.when(k % 97 == 0, F.lit("")).otherwise(F.col("c_name")).alias("maker"),
                null_s.alias("give_token_address"),
                F.when(k % 31 == 0, null_s).when(k % 37 == 0, F.lit(""))
                 .otherwise(F.col("o_orderpriority")).alias("give_token_symbol"),
                (_money("o_totalprice") * 100).cast("decimal(38,0)").alias("give_amount"),
                F.when(k % 43 == 0, null_d).when(k % 47 == 0, F.lit(0.0))
                 .otherwise(F.col("o_totalprice")).alias("give_amount_usd"),
                _chain_of(F.col("c_nationkey")).alias("give_chain_id"),
                null_s.alias("take_token_address"),
                F.when(k % 41 == 0, null_s).otherwise(F.col("o_orderstatus")).alias("take_token_symbol"),
                null_a.alias("take_amount"),
                F.when(k % 53 == 0, null_d).otherwise(F.col("o_totalprice")).alias("take_amount_usd"),
                _chain_of(k).alias("take_chain_id"),
                null_s.alias("receiver"),
                null_s.alias("taker"),
                null_a.alias("fulfilled_amount"),
                null_d.alias("fulfilled_amount_usd"),
                F.col("o_orderdate").alias("created_at"),
                F.lit(0).cast("bigint").alias("_version"),
            ))


def fulfilled_events(spark: SparkSession, sf_dir: str, dealt: bool | str = False) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_discount", "l_shipdate")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    k = F.col("l_orderkey")
    null_s = F.lit(None).cast("string")
    null_d = F.lit(None).cast("double")
    null_a = F.lit(None).cast("decimal(38,0)")
    joined = (li.join(s, li.l_suppkey == s.s_suppkey, "left")
              .join(p, li.l_partkey == p.p_partkey, "left"))
    signature = F.concat(F.lit("f-"), k.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return (_dealt(joined, dealt, li, ["l_orderkey", "l_linenumber"], signature)
            .select(
                k.cast("string").alias("order_id"),
                F.lit("fulfilled").alias("event_type"),
                signature.alias("signature"),
                k.alias("slot"),
                F.col("l_shipdate").alias("block_time"),
                null_s.alias("maker"),
                null_s.alias("give_token_address"),
                null_s.alias("give_token_symbol"),
                null_a.alias("give_amount"),
                null_d.alias("give_amount_usd"),
                F.lit(None).cast("bigint").alias("give_chain_id"),
                null_s.alias("take_token_address"),
                F.col("p_type").alias("take_token_symbol"),
                null_a.alias("take_amount"),
                F.col("l_extendedprice").alias("take_amount_usd"),
                _chain_of(F.col("s_nationkey")).alias("take_chain_id"),
                null_s.alias("receiver"),
                F.when(k % 89 == 0, null_s).otherwise(F.col("s_name")).alias("taker"),
                null_a.alias("fulfilled_amount"),
                (_money("l_extendedprice") * (F.lit(1) - _money("l_discount")))
                .cast("double").alias("fulfilled_amount_usd"),
                F.col("l_shipdate").alias("created_at"),
                F.col("l_partkey").alias("_version"),
            ))


def raw_order_events(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """All landed events (duplicates included) — the stored table before dedup.

    ``dealt``: the joined source rows, which are narrow, are first dealt into pieces of about ``ROWS_PER_PIECE``, so
    that whatever sorts the wide event rows task by task (``dedup.latest`` before its shuffle) needs no disk.
    """
    return created_events(spark, sf_dir, dealt).unionByName(fulfilled_events(spark, sf_dir, dealt))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature index rows: one per order, failed when the order status is 'P'."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("c-"), F.col("o_orderkey").cast("string")).alias("signature"),
        F.col("o_orderkey").alias("slot"),
        F.timestamp_diff("SECOND", epoch_ntz(), F.col("o_orderdate")).alias("blockTime"),
        (F.col("o_orderstatus") == "P").alias("err"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint request log derived from ``events``."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("endpoint"),
        F.col("ts"),
        F.col("value").alias("latency_ms"),
        ((F.col("event_type") != "error") & (F.col("value") > 20)).alias("ok"),
    )


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only checkpoint log derived from ``events`` (one checkpoint per event).

    ``total_collected`` grows with ``event_id`` so the log needs no window.
    """
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("program_id"),
        F.col("event_type"),
        F.col("event_id").cast("string").alias("last_signature"),
        (F.col("event_id") + 1).alias("total_collected"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("seq"),
    )
