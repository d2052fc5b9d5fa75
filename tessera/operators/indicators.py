"""Technical indicators over ordered rows of each key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _last(by: str, time: str, n: int):
    return Window.partitionBy(by).orderBy(time).rowsBetween(1 - n, 0)


def _full(value: Column, column: str, frame, n: int) -> Column:
    return F.when(F.count(column).over(frame) == n, value)


def sma(df: DataFrame, by: str, time: str, column: str, n: int) -> DataFrame:
    """Mean of the last n rows; null before there are n."""
    w = _last(by, time, n)
    return df.withColumn(f"sma_{n}", _full(F.avg(column).over(w), column, w, n))


def bollinger(df: DataFrame, by: str, time: str, column: str, n: int = 20, width: float = 2.0) -> DataFrame:
    """Mean of the last n rows and the bands `width` sample deviations around it."""
    w = _last(by, time, n)
    mean, spread = F.avg(column).over(w), F.stddev_samp(column).over(w)
    return df.withColumns({"boll_mid": _full(mean, column, w, n), "boll_low": _full(mean - width * spread, column, w, n), "boll_high": _full(mean + width * spread, column, w, n)})


def rsi(df: DataFrame, by: str, time: str, column: str, n: int = 14) -> DataFrame:
    """Relative strength index by simple means of the last n gains and losses."""
    step = F.col(column) - F.lag(column).over(Window.partitionBy(by).orderBy(time))
    w = _last(by, time, n)
    gain = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))  # noqa: E731  a key's first row has none
    rows = df.withColumn("__up", gain(step)).withColumn("__down", gain(-step))
    up, down = F.avg("__up").over(w), F.avg("__down").over(w)
    value = F.when(up + down > 0, 100 * up / (up + down))
    return rows.withColumn(f"rsi_{n}", _full(value, "__up", w, n)).drop("__up", "__down")


def ema(df: DataFrame, by: str, time: str, column: str, spans: tuple[int, ...] = (12, 26)) -> DataFrame:
    """Exponential means with the given spans; the recursion runs in order within each key."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"ema_{s}", T.DoubleType()) for s in spans]])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(time, kind="stable")
        return frame.assign(**{f"ema_{s}": frame[column].ewm(span=s, adjust=False).mean() for s in spans})

    return df.groupBy(by).applyInPandas(run, schema)


def macd(df: DataFrame, by: str, time: str, column: str, fast: int = 12, slow: int = 26) -> DataFrame:
    """Difference of a fast and a slow exponential mean."""
    return ema(df, by, time, column, (fast, slow)).withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
