"""Structured Streaming forms of the event-time operators."""

from __future__ import annotations

import datetime
import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.timeaxis import length
from tessera.operators.windows import EventWindow, HoppingWindow, OnCompletionTrigger, SessionWindow, TumblingWindow
from tessera.storage import fresh_path


def _interval(value: int | datetime.timedelta | None) -> str:
    return f"{length(value) if value is not None else 0} microseconds"


def windowed(stream: DataFrame, window: EventWindow, trigger: OnCompletionTrigger) -> DataFrame:
    """Tumbling, hopping and session windows of a stream: a row a window and key once the watermark passes it.

    The trigger's delay is how late an event may come.  Columns [time (window start), key, *aggregates].
    Session gaps equal to the timeout keep a session together, as in the batch operator: the gap is widened by a microsecond.
    """
    kind = stream.schema[window.order_by].dataType
    late = stream.withColumn(window.order_by, F.col(window.order_by).cast("timestamp")).withWatermark(window.order_by, _interval(trigger.delay))
    if isinstance(window, SessionWindow):
        frame = F.session_window(window.order_by, f"{length(window.timeout) + 1} microseconds")
    elif isinstance(window, TumblingWindow):
        frame = F.window(window.order_by, _interval(window.size))
    elif isinstance(window, HoppingWindow):
        frame = F.window(window.order_by, _interval(window.size), _interval(window.hop))
    else:
        raise TypeError(f"{type(window).__name__} has no completion on a stream")
    out = late.groupBy(frame.alias("__w"), window.partition_by).agg(*window.aggregates())
    return out.select(F.col("__w")["start"].cast("timestamp" if isinstance(kind, T.DateType) else kind).alias(window.order_by), window.partition_by, *window.get_new_cols())


def stateful(stream: DataFrame, by: Sequence[str], start: Callable[[], object], step: Callable, schema: str | T.StructType, idle: str | None = None) -> DataFrame:
    """A state per key: step(state, key, frame) returns (state, frame or None) for each micro-batch's rows of the key.

    States are pickled.  With `idle` a key's state is dropped when it has had no rows for that long.
    """
    held = cloudpickle.dumps((start, step))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, advance = pickle.loads(held)
        own = pickle.loads(state.get[0]) if state.exists else first()
        frame = pd.concat(list(frames), ignore_index=True)
        own, out = advance(own, key, frame)
        state.update((cloudpickle.dumps(own),))
        if idle:
            state.setTimeoutDuration(idle)
        if out is not None and len(out):
            yield out

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy(*by).applyInPandasWithState(run, schema, "state binary", "append", timeout)


def processing_time(df: DataFrame, partition: str, offset: str, time: str, name: str = "processing_time") -> DataFrame:
    """The latest event time seen so far in each partition, by offset: what a reader's clock would have shown."""
    along = Window.partitionBy(partition).orderBy(offset).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(time).over(along))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source has now, into Parquet in the shared folder, and read that."""
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    query = writer.option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
