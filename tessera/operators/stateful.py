"""Batch functions and stateful executors over Arrow batches."""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tessera.storage import broadcastable

#: Rows of the driver-side sample from which output types are taken when only names are given.
SAMPLE_ROWS = 64


class Executor:
    """A stateful operator: `execute` gets lists of Arrow tables, `done` is called once at the end; both may return None."""

    def execute(self, batches: list[pa.Table], stream_id: int, executor_id: int):
        raise NotImplementedError

    def done(self, executor_id: int):
        return None


@dataclass(frozen=True)
class PassThroughPartitioner:
    """Batches stay where they are."""


@dataclass(frozen=True)
class HashPartitioner:
    """Rows of a key (or keys) meet in one executor."""

    key: str | tuple[str, ...]


@dataclass(frozen=True)
class RangePartitioner:
    """Each executor gets a stretch of the key's values."""

    key: str
    total: int | None = None


@dataclass(frozen=True)
class BroadcastPartitioner:
    """Each executor gets all rows, which must be few enough to broadcast."""


@dataclass(frozen=True)
class FunctionPartitioner:
    """f(df) is a column of executor numbers; they count modulo the number of executors."""

    f: Callable[[DataFrame], Column]


@dataclass(frozen=True)
class SingleChannelStrategy:
    """One executor sees all batches; only for results that are small by then."""


@dataclass(frozen=True)
class CustomChannelsStrategy:
    """A number of executors."""

    channels: int


@dataclass(frozen=True)
class DatasetStrategy(CustomChannelsStrategy):
    """As many executors as a dataset has parts."""


@dataclass(frozen=True)
class TaggedCustomChannelsStrategy(CustomChannelsStrategy):
    """A number of executors; Spark places tasks by itself, so the tag is kept for the reader alone."""

    tag: str = ""


def dealt(df: DataFrame, partitioner=None, placement=None) -> DataFrame:
    """df partitioned as asked for; without a wish, as it comes."""
    n = [placement.channels] if isinstance(placement, CustomChannelsStrategy) else []
    if isinstance(partitioner, (BroadcastPartitioner, FunctionPartitioner)):
        channels = n[0] if n else 1 if isinstance(placement, SingleChannelStrategy) else df.sparkSession.sparkContext.defaultParallelism
        if isinstance(partitioner, FunctionPartitioner):
            return df.repartitionById(channels, F.pmod(partitioner.f(df), F.lit(channels)).cast("int"))
        if not broadcastable(df):
            raise ValueError("the rows are too many to send to every executor: see spark.sql.autoBroadcastJoinThreshold")
        copies = df.withColumn("__channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
        return copies.repartitionById(channels, F.col("__channel")).drop("__channel")
    if isinstance(placement, SingleChannelStrategy):
        return df.coalesce(1)
    if isinstance(partitioner, HashPartitioner):
        keys = [partitioner.key] if isinstance(partitioner.key, str) else partitioner.key
        return df.repartition(*n, *[F.col(f"`{k}`") for k in keys])
    if isinstance(partitioner, RangePartitioner):
        return df.repartitionByRange(*(n or [partitioner.total] if n or partitioner.total else []), F.col(f"`{partitioner.key}`"))
    return df.repartition(*n) if n else df


def tables(value) -> list[pa.Table]:
    """Arrow tables of what a user's function returned: nothing, one or several tables, batches or pandas frames."""
    if value is None:
        return []
    if isinstance(value, pa.Table):
        return [value]
    if isinstance(value, pa.RecordBatch):
        return [pa.Table.from_batches([value])]
    if isinstance(value, (list, tuple)):
        return [t for v in value for t in tables(v)]
    if hasattr(value, "to_arrow"):
        return [value.to_arrow()]
    return [pa.Table.from_pandas(value, preserve_index=False)]


def declared(new_schema, sample: Callable[[], list[pa.Table]]) -> T.StructType:
    """The output type: a DDL string or StructType, or names whose types a run on a small sample gives."""
    if isinstance(new_schema, T.StructType):
        return new_schema
    if isinstance(new_schema, str):
        return T._parse_datatype_string(new_schema)
    got = [t for t in sample() if t.num_columns]
    if not got:
        raise ValueError("the function returned nothing for a sample: give the schema with types")
    return from_arrow_schema(got[0].select(list(new_schema)).schema)


def shaped(value, schema: pa.Schema):
    """Batches of what a function returned, in the declared columns and types."""
    for t in tables(value):
        yield from t.select(schema.names).cast(schema).to_batches()


def transform(df: DataFrame, f: Callable, new_schema, required_columns: Sequence[str]) -> DataFrame:
    """f over Arrow tables of the required columns, batch by batch; f gets a pandas frame if it is marked `wants = "pandas"`."""
    part = df.select(*[F.col(f"`{c}`") for c in required_columns])
    given = (lambda t: f(t.to_pandas())) if getattr(f, "wants", "arrow") == "pandas" else f
    schema = declared(new_schema, lambda: tables(given(part.limit(SAMPLE_ROWS).toArrow())))
    kind = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            yield from shaped(given(pa.Table.from_batches([batch])), kind)

    return part.mapInArrow(run, schema)


def _fresh(executor):
    return executor() if isinstance(executor, type) or (callable(executor) and not hasattr(executor, "execute")) else copy.deepcopy(executor)


def stateful(df: DataFrame, executor, new_schema, required_columns: Sequence[str], partitioner=None, placement=None) -> DataFrame:
    """An executor (or factory) per task over its batches, dealt by a partitioner and a placement."""
    part = df.select(*[F.col(f"`{c}`") for c in required_columns])

    def sampled():
        own = _fresh(executor)
        got = tables(own.execute([part.limit(SAMPLE_ROWS).toArrow()], 0, 0))
        return got + tables(own.done(0))

    schema = declared(new_schema, sampled)
    kind = to_arrow_schema(schema)
    part = dealt(part, partitioner, placement)

    def run(batches):
        own, channel = _fresh(executor), TaskContext.get().partitionId()
        for batch in batches:
            yield from shaped(own.execute([pa.Table.from_batches([batch])], 0, channel), kind)
        yield from shaped(own.done(channel), kind)

    return part.mapInArrow(run, schema)


def per_key(df: DataFrame, f: Callable, new_schema: str | T.StructType, by: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """f over a pandas frame of each key, its rows in order."""
    order = list(order_by)

    def run(frame):
        return f(frame.sort_values(order, kind="stable") if order else frame)

    return df.groupBy(*by).applyInPandas(run, new_schema)


def cogroup(left: DataFrame, right: DataFrame, key: str, executor, new_schema, left_columns: Sequence[str], right_columns: Sequence[str]) -> DataFrame:
    """An executor per key over the key's rows of both streams (stream 0 left, 1 right), then done."""
    a, b = left.select(*left_columns), right.select(*right_columns)

    def called(x: pa.Table, y: pa.Table) -> list[pa.Table]:
        own = _fresh(executor)
        out = []
        for stream_id, t in enumerate((x, y)):
            if t.num_rows:
                out += tables(own.execute([t], stream_id, 0))
        return out + tables(own.done(0))

    schema = declared(new_schema, lambda: called(a.limit(SAMPLE_ROWS).toArrow(), b.limit(SAMPLE_ROWS).toArrow()))
    kind = to_arrow_schema(schema)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return pa.Table.from_batches([r for t in called(x, y) for r in shaped(t, kind)], schema=kind)

    return a.groupBy(key).cogroup(b.groupBy(key)).applyInArrow(run, schema)


def mingle(frames: Sequence[DataFrame], executor, new_schema, required_columns: Sequence[Sequence[str]]) -> DataFrame:
    """An executor per task over batches of several frames; stream_id tells which frame a batch is of."""
    parts = [f.select(*c) for f, c in zip(frames, required_columns, strict=True)]
    tagged = None
    for i, p in enumerate(parts):
        one = p.select(F.lit(i).alias("__stream"), F.struct(*p.columns).alias(f"s{i}"))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    tagged = tagged.select("__stream", *[f"s{i}" for i in range(len(parts))])

    def sampled():
        own = _fresh(executor)
        got = [t for i, p in enumerate(parts) for t in tables(own.execute([p.limit(SAMPLE_ROWS).toArrow()], i, 0))]
        return got + tables(own.done(0))

    schema = declared(new_schema, sampled)
    kind = to_arrow_schema(schema)
    count = len(parts)

    def run(batches):
        own, channel = _fresh(executor), TaskContext.get().partitionId()
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for i in range(count):
                part = t.filter(pa.compute.equal(t["__stream"], i))
                if part.num_rows:
                    flat = part.select([f"s{i}"]).flatten()
                    yield from shaped(own.execute([flat.rename_columns([n.removeprefix(f"s{i}.") for n in flat.column_names])], i, channel), kind)
        yield from shaped(own.done(channel), kind)

    return tagged.mapInArrow(run, schema)
