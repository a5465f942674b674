"""Collection progress: latest checkpoint joined with an exact recount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress_with_count(checkpoints: DataFrame, collected: DataFrame) -> DataFrame:
    """Newest checkpoint per key ⟕ the exact number of collected rows for that key.

    ``checkpoints``: one row per (program_id, event_type).  ``collected``: the
    collected rows, without duplicates, with their program_id and event_type.
    Both sides are aggregates on the same key, so the join moves one row per
    key; the recount is exact rather than a running ``+= inserted``.
    """
    exact = collected.groupBy("program_id", "event_type").agg(F.count(F.lit(1)).alias("exact_count"))
    return (checkpoints.join(exact, ["program_id", "event_type"], "left")
            .select("program_id", "event_type", "last_signature", "total_collected",
                    F.coalesce(F.col("exact_count"), F.lit(0).cast("bigint")).alias("exact_count")))
