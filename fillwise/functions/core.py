"""Column helpers shared by the operators: money sums, time bounds, validation."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dashboard period names -> hours; anything else means 24 h.
PERIOD_HOURS = {"1h": 1, "24h": 24, "7d": 24 * 7, "30d": 24 * 30, "all": 24 * 365 * 10}

MONEY = T.DecimalType(28, 6)



def epoch_ntz() -> Column:
    """The Unix epoch as a TIMESTAMP_NTZ literal: epoch seconds <-> wall-clock UTC, no session zone."""
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def money_sum(c: Column) -> Column:
    """Exact, order-independent sum of a USD column (DECIMAL sum reported as DOUBLE).

    A DOUBLE sum depends on the order rows arrive in, so two runs on a cluster
    can differ in the last bits; a DECIMAL(28,6) sum (micro-dollars) cannot.
    """
    return F.sum(c.cast(MONEY)).cast("double")


def money_avg(c: Column) -> Column:
    """Mean of a USD column from the exact sum, rounded to 4 places."""
    return F.round(F.try_divide(money_sum(c), F.count(c)), 4)


def is_created() -> Column:
    return F.col("event_type") == "created"


def is_fulfilled() -> Column:
    return F.col("event_type") == "fulfilled"


def non_blank(c: str | Column) -> Column:
    """P5 ``non_blank``: ``c IS NOT NULL AND c != ''``."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & (col != "")


def ts_literal(df: DataFrame, column: str, value: str | _dt.datetime | None) -> Column:
    """A timestamp typed like ``df[column]`` (TIMESTAMP or TIMESTAMP_NTZ); ``None`` is now."""
    if value is None:
        return F.current_timestamp().cast(df.schema[column].dataType)
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    kind = "TIMESTAMP_NTZ" if isinstance(df.schema[column].dataType, T.TimestampNTZType) else "TIMESTAMP"
    return F.expr(f"{kind} '{value}'")


def since_hours(df: DataFrame, hours: int, as_of: str | None = None,
                column: str = "block_time") -> DataFrame:
    """``column >= as_of - hours``."""
    bound = ts_literal(df, column, as_of) - F.make_dt_interval(F.lit(0), F.lit(int(hours)))
    return df.where(F.col(column) >= bound)


def since_days(df: DataFrame, days: int, as_of: str | None = None,
               column: str = "block_time") -> DataFrame:
    """``column >= to_date(as_of) - days`` (midnight of the first day)."""
    first_day = F.date_sub(F.to_date(ts_literal(df, column, as_of)), int(days))
    return df.where(F.col(column) >= first_day.cast(df.schema[column].dataType))


def period_hours(period: str) -> int:
    """Unknown period names fall back to 24 h (Q21)."""
    return PERIOD_HOURS.get(period, 24)


def check_limit(value: int, default: int, maximum: int) -> int:
    """Q20: limits must be within ``1..maximum``; ``None`` means the default."""
    if value is None:
        return default
    value = int(value)
    if not 1 <= value <= maximum:
        raise ValueError(f"limit must be within 1..{maximum}, got {value}")
    return value


def mask_keys(text: Column) -> Column:
    """``text`` with the value of every API key replaced by ``***``."""
    return F.regexp_replace(text, r"(?i)api[-_]?key=[\w-]+", "api-key=***")
