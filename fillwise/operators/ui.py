"""Table work the dashboard does on event rows: search, display columns, paging,
live merge (P11, P13, L3, J9).  All of it is expressed over the whole event
table so it scales with it; the browser-side versions only saw 50 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwise.operators.analytics import RECENT_COLUMNS

SEARCH_COLUMNS = ("order_id", "signature", "maker", "taker", "give_token_symbol", "take_token_symbol")


def recent_order():
    """Display order of event rows: newest first, key as tie-breaker."""
    return [F.desc("block_time"), F.asc("signature"), F.asc("event_type")]


def search_predicate(q: str, columns=SEARCH_COLUMNS) -> Column:
    """Case-insensitive substring match over ``columns``; NULL columns never match.

    ``contains`` (not LIKE), so ``%`` and ``_`` in the query are literal.
    """
    needle = F.lower(F.lit(q))
    hits = [F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False)) for c in columns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def search_orders(ev: DataFrame, q: str = "", event_type: str = "all") -> DataFrame:
    """Event rows matching the search text and the type filter (all/created/fulfilled)."""
    if event_type not in ("all", "created", "fulfilled"):
        raise ValueError(f"unknown type filter {event_type!r}")
    df = ev
    if event_type != "all":
        df = df.where(F.col("event_type") == event_type)
    if q:
        df = df.where(search_predicate(q))
    return df


def display_columns(ev: DataFrame) -> DataFrame:
    """The token / amount / address a table row shows for its event type.

    Blank strings count as missing, like the UI's ``||`` fallbacks.
    """
    created = F.col("event_type") == "created"
    give, take = F.nullif(F.col("give_token_symbol"), F.lit("")), F.nullif(F.col("take_token_symbol"), F.lit(""))
    return ev.select(
        "order_id", "event_type", "signature", "block_time",
        F.when(created, F.coalesce(give, F.lit("-")))
         .otherwise(F.coalesce(take, give, F.lit("-"))).alias("display_token"),
        F.when(created, F.col("give_amount_usd")).otherwise(F.col("take_amount_usd")).alias("display_amount_usd"),
        F.when(created, F.col("maker")).otherwise(F.col("taker")).alias("display_address"),
    )


def page_orders(rows: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """L3: one page of ``rows`` (newest first) plus ``total_pages = ceil(n / size)``.

    The page is ``orderBy().offset().limit()`` — a bounded per-partition
    top-(offset+size), no global sort.  The count is a one-row aggregate joined
    on a constant key (bounded: one row).  Deep pages should use
    ``page_after`` (keyset) instead of large offsets.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size must be >= 1")
    part = (rows.select(*RECENT_COLUMNS).orderBy(*recent_order())
            .offset((page - 1) * size).limit(size).withColumn("_k", F.lit(1)))
    total = rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(1).alias("_k"), F.ceil(F.col("n") / F.lit(size)).cast("bigint").alias("total_pages"))
    return part.join(F.broadcast(total), "_k").drop("_k")


def page_after(rows: DataFrame, cursor_time, cursor_signature: str, cursor_type: str, size: int = 10) -> DataFrame:
    """Keyset page: the rows after the cursor (last row of the page before) in display order."""
    t, g, e = F.lit(cursor_time), F.lit(cursor_signature), F.lit(cursor_type)
    same = F.col("block_time") == t
    after = ((F.col("block_time") < t) | (same & (F.col("signature") > g))
             | (same & (F.col("signature") == g) & (F.col("event_type") > e)))
    return rows.where(after).select(*RECENT_COLUMNS).orderBy(*recent_order()).limit(size)


def merge_live(update: DataFrame, snapshot: DataFrame, key: str = "order_id", keep: int = 20) -> DataFrame:
    """Update rows first, then snapshot rows whose ``key`` is not in the update; first ``keep``.

    Both inputs carry a ``position`` column (their display order).  The
    update is a handful of rows, the snapshot a bounded list.
    """
    fresh = update.withColumn("_src", F.lit(0))
    stale = snapshot.join(update.select(key).distinct(), key, "left_anti").withColumn("_src", F.lit(1))
    merged = fresh.unionByName(stale)
    return (merged.orderBy("_src", "position").limit(keep)
            .withColumn("source", F.when(F.col("_src") == 0, "update").otherwise("snapshot"))
            .drop("_src"))


def with_position(rows: DataFrame, order=None) -> DataFrame:
    """Number a bounded (already limited) list 1..n in display order."""
    from pyspark.sql import Window
    w = Window.orderBy(*(order or recent_order()))
    return rows.withColumn("position", F.row_number().over(w))
