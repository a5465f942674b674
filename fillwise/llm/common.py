"""Helpers shared by the corpus operators: the shared folder, checkpoints, text bytes, guarded joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.session import checkpoint_dir

#: Largest number of rows of a parameter table that is sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
#: Most tasks that rows are dealt over by number.
MOST_TASKS = 20_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; later reads neither recompute it nor depend on one executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_params(rows: DataFrame, params: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a table of one row per group to ``rows``.

    The table is counted first. Up to ``BROADCAST_ROWS`` rows it is broadcast, so a group that holds a third of
    all rows costs nothing; beyond that it is an ordinary join, whose skewed partitions AQE splits.
    """
    small = params.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(params) if small else params, keys, how)


def spread(rows: DataFrame, per_task: int, *keys: str) -> DataFrame:
    """Deal small rows that stand for much work over tasks of about ``per_task`` rows.

    AQE sizes partitions by bytes and would put such rows into one task; a stated number of partitions stays.
    """
    n = rows.count()
    return rows.repartition(max(1, min(MOST_TASKS, -(-n // per_task))), *keys)


def utf8(text: str) -> bytes:
    """UTF-8 bytes of a text; lone surrogates (not valid in Spark strings anyway) become ``?``."""
    return text.encode("utf-8", "replace")
