"""Event-time windows: specifications, triggers and their evaluation."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import sqltext
from tessera.operators.timeaxis import from_ticks, length, ticks

Length = int | datetime.timedelta


@dataclass
class EventWindow:
    """Windows over `order_by` within `partition_by`; aggregation_dict maps output names to SQL aggregates."""

    order_by: str
    partition_by: str
    aggregation_dict: dict[str, str] = field(default_factory=dict, kw_only=True)

    def add_aggregation(self, name: str, sql: str) -> None:
        if name in self.aggregation_dict:
            raise ValueError(f"{name} is aggregated already")
        self.aggregation_dict[name] = sql

    def get_new_cols(self) -> list[str]:
        return list(self.aggregation_dict)

    def aggregates(self):
        return [F.expr(sqltext.to_spark(sql)).alias(name) for name, sql in self.aggregation_dict.items()]

    def sql_aggregations(self) -> str:
        return ", ".join(f"{sqltext.to_spark(sql)} as {name}" for name, sql in self.aggregation_dict.items())


@dataclass
class HoppingWindow(EventWindow):
    """A window of `size` every `hop`, aligned to zero (the epoch)."""

    hop: Length
    size: Length


@dataclass
class TumblingWindow(EventWindow):
    """Adjacent windows of `size`, aligned to zero (the epoch)."""

    size: Length

    @property
    def hop(self) -> Length:
        return self.size


@dataclass
class SlidingWindow(EventWindow):
    """For each event, the events of the last `size_before`: (t - size_before, t], and those up to `size_after` later.

    With rows=True both count events: the size_before events that end with this one, and the size_after ones after it.
    """

    size_before: Length
    size_after: Length = 0
    rows: bool = field(default=False, kw_only=True)

    def frame(self) -> str:
        back, ahead = length(self.size_before) - 1, length(self.size_after)
        return f"{'ROWS' if self.rows else 'RANGE'} BETWEEN {back} PRECEDING AND {f'{ahead} FOLLOWING' if ahead else 'CURRENT ROW'}"


@dataclass
class SessionWindow(EventWindow):
    """Events whose gaps are at most `timeout`."""

    timeout: Length


class OnEventTrigger:
    """A row for each event, with the window's aggregates so far."""


@dataclass
class OnCompletionTrigger:
    """A row for each window and key; `delay` is how long a stream waits for late events."""

    delay: Length | None = None


def windowed(df: DataFrame, window: EventWindow, trigger) -> DataFrame:
    """Columns [time, key, *aggregates].

    On completion the time is the window's start (for sessions, the first event's time).  Equal times are peers: each
    sees the others.  Rows without time are left out.
    """
    time, by = window.order_by, window.partition_by
    df = df.where(F.col(f"`{time}`").isNotNull())
    rows = df.withColumn("__t", ticks(df, time))
    on_event = isinstance(trigger, OnEventTrigger)
    if isinstance(window, SlidingWindow):
        return _along(rows, window, f"PARTITION BY `{by}` ORDER BY __t {window.frame()}")
    if isinstance(window, SessionWindow):
        key = Window.partitionBy(f"`{by}`").orderBy("__t")
        gap = F.col("__t") - F.lag("__t").over(key)
        rows = rows.withColumn("__new", F.when(gap > length(window.timeout), 1).otherwise(0))
        rows = rows.withColumn("__w", F.sum("__new").over(key.rangeBetween(Window.unboundedPreceding, 0)))
        if on_event:
            return _along(rows, window, f"PARTITION BY `{by}`, __w ORDER BY __t RANGE UNBOUNDED PRECEDING")
        out = rows.groupBy(f"`{by}`", "__w").agg(F.min(f"`{time}`").alias("__start"), *window.aggregates())
        return out.select(F.col("__start").alias(time), F.col(f"`{by}`"), *window.get_new_cols())
    if isinstance(window, TumblingWindow) and on_event:
        rows = rows.withColumn("__w", F.floor(F.col("__t") / length(window.size)))
        return _along(rows, window, f"PARTITION BY `{by}`, __w ORDER BY __t RANGE UNBOUNDED PRECEDING")
    if isinstance(window, (HoppingWindow, TumblingWindow)):
        if on_event:
            raise ValueError("hopping windows have no on-event trigger")
        hop, size = length(window.hop), length(window.size)
        first = F.floor(F.col("__t") / hop) * hop
        if hop == size:
            rows = rows.withColumn("__w", first)
        else:
            rows = rows.withColumn("__w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(-(-size // hop) - 1)), lambda k: first - k * hop))).where(F.col("__t") < F.col("__w") + size)
        out = rows.groupBy("__w", f"`{by}`").agg(*window.aggregates())
        return out.select(from_ticks(df, time, F.col("__w")).alias(time), F.col(f"`{by}`"), *window.get_new_cols())
    raise TypeError(f"no such window: {type(window).__name__}")


def _along(rows: DataFrame, window: EventWindow, frame: str) -> DataFrame:
    aggregates = [F.expr(sqltext.over(sql, frame)).alias(name) for name, sql in window.aggregation_dict.items()]
    return rows.select(F.col(f"`{window.order_by}`"), F.col(f"`{window.partition_by}`"), *aggregates)


def shift(df: DataFrame, time: str, n: int, by: list[str], fill_value=None, tiebreak: list[str] | None = None) -> DataFrame:
    """Every column but time and keys moved n rows later (earlier if negative) within its key, in order of time."""
    order = Window.partitionBy(*[f"`{b}`" for b in by]).orderBy(f"`{time}`", *(tiebreak or []))
    fixed = {time, *by}

    def moved(c: str):
        fill = fill_value
        return (F.lag(f"`{c}`", n, fill) if n >= 0 else F.lead(f"`{c}`", -n, fill)).over(order).alias(c)

    return df.select(*[F.col(f"`{c}`") if c in fixed else moved(c) for c in df.columns])


def pattern_recognize(df: DataFrame, time: str, anchors: list[tuple[str, str]], duration_limits: list[Length], partition_by: str | None = None) -> DataFrame:
    """Event sequences: a row per event of the first kind from which the others follow, each the earliest strictly later within its limit.

    anchors: (name, SQL condition) in order; duration_limits: one fewer.  Columns: the key, then each
    anchor's time.  Found from the last anchor back to the first with one window each, over one shuffle; no backtracking.
    """
    if len(anchors) < 2 or len(duration_limits) != len(anchors) - 1:
        raise ValueError("two anchors at least, and a limit between each two")
    rows = df.where(F.col(f"`{time}`").isNotNull()).withColumn("__t", ticks(df, time))
    keys = [f"`{partition_by}`"] if partition_by else [F.lit(0)]
    later = Window.partitionBy(*keys).orderBy("__t").rangeBetween(1, Window.unboundedFollowing)
    names = [n for n, _ in anchors]
    tests = [F.expr(sqltext.to_spark(sql)) for _, sql in anchors]
    rows = rows.withColumn("__m", F.when(tests[-1], F.struct(F.col("__t").alias(f"t{len(anchors) - 1}"))))
    for i in range(len(anchors) - 2, -1, -1):
        rows = rows.withColumn("__n", F.first("__m", ignorenulls=True).over(later))
        near = F.col("__n")[f"t{i + 1}"] - F.col("__t") <= length(duration_limits[i])
        rest = [F.col("__n")[f"t{j}"].alias(f"t{j}") for j in range(i + 1, len(anchors))]
        # An event that opens nothing must not hide later ones, but the earliest match of the next kind decides.
        chain = F.when(F.col("__n").isNotNull() & near, F.struct(F.col("__t").alias(f"t{i}"), *rest))
        rows = rows.withColumn("__m", F.when(tests[i], chain) if i == 0 else F.when(tests[i], F.coalesce(chain, F.struct(F.col("__t").alias(f"t{i}"), *[F.lit(None).cast("long").alias(f"t{j}") for j in range(i + 1, len(anchors))]))))
    found = rows.where(F.col("__m").isNotNull())
    for j in range(1, len(anchors)):
        found = found.where(F.col("__m")[f"t{j}"].isNotNull())
    out = [from_ticks(df, time, F.col("__m")[f"t{j}"]).alias(n) for j, n in enumerate(names)]
    return found.select(*([F.col(f"`{partition_by}`")] if partition_by else []), *out)
