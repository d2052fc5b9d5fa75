"""Time columns as integers: whole numbers as they are, dates and timestamps as microseconds (UTC session)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_clock(df: DataFrame, time: str) -> bool:
    kind = df.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return True
    if isinstance(kind, T.IntegralType):
        return False
    raise TypeError(f"time column {time} has type {kind.simpleString()}: integers, dates and timestamps have an order of time")


def ticks(df: DataFrame, time: str) -> Column:
    """The time column as a long."""
    c = F.col(f"`{time}`")
    return F.unix_micros(c.cast("timestamp")) if is_clock(df, time) else c.cast("long")


def from_ticks(df: DataFrame, time: str, value: Column) -> Column:
    """A long back in the time column's type (timestamps for dates)."""
    kind = df.schema[time].dataType
    if not is_clock(df, time):
        return value.cast(kind)
    stamp = F.timestamp_micros(value)
    return stamp if isinstance(kind, T.TimestampType) else stamp.cast("timestamp_ntz")


def length(value: int | datetime.timedelta) -> int:
    """A length of time in ticks."""
    if isinstance(value, datetime.timedelta):
        return value // datetime.timedelta(microseconds=1)
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError("a length of time is an int or a timedelta")
    return value
