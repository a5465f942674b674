"""Shared helpers for the tests."""

import datetime as dt

from pyspark.sql import types as T

from fillwise.schema import ORDER_EVENTS

T0 = dt.datetime(2001, 1, 1)


def events(spark, rows):
    full = []
    for r in rows:
        d = {f.name: None for f in ORDER_EVENTS.fields}
        d.update({"slot": 1, "created_at": T0, "_version": 0, "block_time": T0})
        d.update(r)
        full.append(tuple(d[f.name] for f in ORDER_EVENTS.fields))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in ORDER_EVENTS.fields])
    return spark.createDataFrame(full, schema)
