"""Streams: immutable lazy tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import Expression, sqltext, unwrap
from tessera.operators import algebra, asof, clustering, stateful, vectors, windows
from tessera.operators.timeaxis import length
from tessera.storage import broadcastable, listed, settle

JOINS = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti", "right": "right", "outer": "full", "full": "full"}
FUNCTIONS: dict[str, Callable[[Column], Column]] = {"min": F.min, "max": F.max, "mean": F.avg, "avg": F.avg, "sum": F.sum, "count": F.count}


def _list(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _sql(text: str, df: DataFrame) -> Column:
    return F.expr(sqltext.to_spark(text, df))


class Row:
    """What a with_columns function gets: x["c"] is an expression."""

    def __init__(self, stream: Stream):
        self.stream = stream

    def __getitem__(self, name: str) -> Expression:
        return self.stream[name]


class Stream:
    """A lazy table.  Every verb returns a new stream; nothing runs before collect, compute or a write."""

    def __init__(self, df: DataFrame, time: str | None = None):
        self.df = df
        self.time = time if time in df.columns else None

    @property
    def schema(self) -> list[str]:
        return self.df.columns

    def __getitem__(self, name: str) -> Expression:
        self._has([name])
        return Expression(F.col(f"`{name}`"))

    def __repr__(self) -> str:
        return f"{type(self).__name__}[{', '.join(self.schema)}]"

    def _has(self, names: Sequence[str]) -> None:
        if lacking := [n for n in names if n not in self.df.columns]:
            raise KeyError(f"no column {', '.join(map(str, lacking))} in {self.schema}")

    def _new(self, df: DataFrame) -> Stream:
        return OrderedStream(df, self.time) if self.time in df.columns else Stream(df)

    # Results

    def collect(self):
        """Run and return a pandas frame (empty, with columns, if there are no rows)."""
        return self.df.toPandas()

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def compute(self) -> Dataset:
        """Run and keep the result on the cluster."""
        return Dataset(settle(self.df))

    def explain(self, mode: str = "formatted") -> str:
        """Print and return the physical plan."""
        said = self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted" if mode in ("graph", "text") else mode))
        print(said)
        return said

    def _written(self, location: str, lines: int, kind: str, **options) -> Stream:
        location = location.rstrip("/*") if location.endswith("*") else location
        self.df.write.mode("overwrite").option("maxRecordsPerFile", lines).options(**options).format(kind).save(location)
        spark = self.df.sparkSession
        return Stream(spark.createDataFrame([(f,) for f in listed(spark, location, f".{kind}")], "filename string"))

    def write_csv(self, table_location: str, output_line_limit: int = 1_000_000) -> Stream:
        """Write a folder of CSV files with headers; decimals are written as doubles.  A stream of file names."""
        plain = self.df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in self.df.schema])
        return Stream(plain)._written(table_location, output_line_limit, "csv", header=True)

    def write_parquet(self, table_location: str, output_line_limit: int = 5_000_000) -> Stream:
        """Write a folder of Parquet files.  A stream of file names."""
        return self._written(table_location, output_line_limit, "parquet")

    # Rows and columns

    def filter(self, condition: Expression | Column | str) -> Stream:
        return self.filter_sql(condition) if isinstance(condition, str) else self._new(self.df.filter(unwrap(condition)))

    def filter_sql(self, condition: str) -> Stream:
        return self._new(self.df.filter(_sql(condition, self.df)))

    def select(self, columns: Sequence[str] | set[str]) -> Stream:
        names = [c for c in self.schema if c in columns] if isinstance(columns, (set, frozenset)) else _list(columns)
        self._has(list(columns))
        return self._new(self.df.select(*[F.col(f"`{c}`") for c in names]))

    def drop(self, columns: Sequence[str]) -> Stream:
        """Without some columns; absent ones are ignored, the time column stays."""
        names = _list(columns)
        if self.time in names:
            raise ValueError(f"{self.time} is the stream's time column")
        return self._new(self.df.drop(*names))

    def rename(self, names: Mapping[str, str]) -> Stream:
        self._has(list(names))
        if clash := [n for n in names.values() if n in self.schema and n not in names]:
            raise ValueError(f"columns {clash} exist")
        return type(self)(self.df.withColumnsRenamed(dict(names)), names.get(self.time, self.time))

    def with_columns(self, new: Mapping[str, Expression | Column | Callable], required_columns: Sequence[str] | set[str] = (), foldable: bool = True) -> Stream:
        """New columns from expressions or functions.

        A function of a row whose result is an expression stays in the plan; any other gets pandas frames of the required
        columns (all if none are named) and returns a series.  Its type is given by (function, "type"), or by the
        function's return annotation if that is a type in DDL; else 64 rows tell it when the plan is made, and rows of another type fail.
        `foldable` has no effect: the optimizer decides.
        """
        if clash := [n for n in new if n in self.schema]:
            raise ValueError(f"columns {clash} exist")
        out = {}
        for name, value in new.items():
            kind = None
            if isinstance(value, tuple) and len(value) == 2 and callable(value[0]):
                value, kind = value
            if callable(value) and not isinstance(value, (Expression, Column)):
                value = self._function(value, [c for c in self.schema if c in set(required_columns)] or self.schema, kind)
            out[name] = unwrap(value) if isinstance(value, (Expression, Column)) else F.lit(value)
        return self._new(self.df.withColumns(out))

    def with_column(self, name: str, value, required_columns: Sequence[str] = ()) -> Stream:
        return self.with_columns({name: value}, required_columns)

    def _function(self, f: Callable, required: list[str], kind: str | T.DataType | None):
        noted = getattr(f, "__annotations__", {}).get("return")
        kind = kind if kind is not None else noted if isinstance(noted, (str, T.DataType)) else None
        if kind is None:
            failed = None
            try:
                got = f(Row(self))
            except Exception as error:  # a function of frames, or one that is wrong: then it fails on a frame, too
                got, failed = None, error
            if isinstance(got, (Expression, Column)):
                return got
            sample = self.df.select(*[F.col(f"`{c}`") for c in required]).limit(stateful.SAMPLE_ROWS).toPandas()
            try:
                given = f(sample)
            except Exception as error:
                raise error from failed
            kind = stateful.from_arrow_schema(pa.schema([("x", pa.array(given).type)])).fields[0].dataType

        def column(frame: pd.DataFrame) -> pd.Series:
            return pd.Series(f(frame))

        column.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
        return F.pandas_udf(column, kind)(F.struct(*[F.col(f"`{c}`") for c in required]))

    def with_columns_sql(self, text: str, foldable: bool = True) -> Stream:
        """New columns from "expression as name, ..."."""
        return self.with_columns({name: F.expr(sql) for sql, name in sqltext.aliased(text, self.df)})

    def clip(self, limits: Mapping[str, tuple[float, float]]) -> Stream:
        """Columns held between bounds; null stays null."""
        self._has(list(limits))
        c = {n: F.col(f"`{n}`") for n in limits}
        return self._new(self.df.withColumns({n: F.when(c[n] < lo, F.lit(lo)).when(c[n] > hi, F.lit(hi)).otherwise(c[n]) for n, (lo, hi) in limits.items()}))

    def transform(self, f: Callable, new_schema, required_columns: Sequence[str] | set[str], foldable: bool = True) -> Stream:
        """f over Arrow tables of the required columns; new_schema is DDL, a StructType, or names (types from a sample)."""
        return self._new(stateful.transform(self.df, f, new_schema, [c for c in self.schema if c in set(required_columns)]))

    def transform_sql(self, text: str, groupby: Sequence[str] = (), foldable: bool = True) -> Stream:
        """Groups and "expression as name, ...": a full aggregation if there are groups or aggregates, else a projection."""
        parts = list(sqltext.aliased(text, self.df))
        exprs = [F.expr(sql).alias(name) for sql, name in parts]
        calls = {t.lower() for sql, _ in parts for t in sqltext.tokens(sql)}
        if groupby or calls & sqltext.AGGREGATES:
            return Stream(self.df.groupBy(*_list(groupby)).agg(*exprs) if groupby else self.df.agg(*exprs))
        return self._new(self.df.select(*exprs))

    def stateful_transform(self, executor, new_schema, required_columns: Sequence[str] | set[str], partitioner=None, placement_strategy=None, by: Sequence[str] | str | None = None) -> Stream:
        """An executor per task over batches of the required columns; `by` is short for a hash partitioner."""
        if by:
            partitioner = stateful.HashPartitioner(tuple(_list(by)))
        return self._new(stateful.stateful(self.df, executor, new_schema, [c for c in self.schema if c in set(required_columns)], partitioner, placement_strategy))

    # Whole tables

    def spread(self) -> Stream:
        """The same rows, dealt out evenly if there are fewer parts than cores: for small tables that are dear to work on.

        Larger tables stay as they are.  Meant right after reading: parts of a stream with shuffles are not known before it runs.
        """
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        return self._new(self.df.repartition(cores)) if self.df.rdd.getNumPartitions() < cores else self

    def union(self, other: Stream) -> Stream:
        """All rows of both; the columns must be the same."""
        if set(self.schema) != set(other.schema):
            raise ValueError(f"columns differ: {self.schema} and {other.schema}")
        return self._new(self.df.unionByName(other.df))

    def intersect(self, other: Stream) -> Stream:
        return self._new(self.df.intersect(other.df.select(*self.schema)))

    def except_(self, other: Stream) -> Stream:
        return self._new(self.df.subtract(other.df.select(*self.schema)))

    def intersect_all(self, other: Stream) -> Stream:
        """Rows of both, as often as in the one where they are rarer."""
        return self._new(self.df.intersectAll(other.df.select(*self.schema)))

    def except_all(self, other: Stream) -> Stream:
        """Rows of this stream less those of the other, one for one."""
        return self._new(self.df.exceptAll(other.df.select(*self.schema)))

    def distinct(self, keys: Sequence[str] | str | None = None) -> Stream:
        names = self.schema if keys is None else _list(keys)
        self._has(names)
        return self._new(self.df.select(*names).distinct())

    def sort(self, columns: Sequence[str] | str, descending: Sequence[bool] | None = None) -> Stream:
        return self._new(self.df.orderBy(*_order(_list(columns), descending)))

    def limit(self, n: int) -> Stream:
        return self._new(self.df.limit(n))

    head = limit

    def top_k(self, columns: Sequence[str] | str, k: int, descending: Sequence[bool] | None = None) -> Stream:
        """The first k rows in order, nulls last."""
        return self._new(self.df.orderBy(*_order(_list(columns), descending)).limit(k))

    def join(self, right: Stream, on=None, left_on=None, right_on=None, suffix: str = "_2", how: str = "inner", maintain_sort_order: str | None = None, broadcast: bool = False) -> Stream:
        """Equi-join; right keys are dropped, right columns that collide get the suffix.

        Catalyst and adaptive execution pick the strategy from sizes; `broadcast` asks for the right side to be sent to all tasks
        and is honoured only where its estimated size is below spark.sql.autoBroadcastJoinThreshold.
        """
        if how not in JOINS:
            raise ValueError(f"unknown join {how!r}: one of {', '.join(JOINS)}")
        lk, rk = (_list(on), _list(on)) if on is not None else (_list(left_on), _list(right_on))
        self._has(lk)
        right._has(rk)
        if how in ("semi", "anti"):
            other = right.df.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(rk)])
            names: list[str] = []
        else:
            other = asof.renamed(self.df, right.df, rk, suffix).withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(rk)})
            names = [c for c in other.columns if not c.startswith("__k")]
        if broadcast and broadcastable(other):
            other = F.broadcast(other)
        condition = F.lit(True)
        for i, k in enumerate(lk):
            condition = condition & (F.col(f"`{k}`") == F.col(f"__k{i}"))
        joined = self.df.join(other, condition, JOINS[how])
        keys = {k: F.coalesce(F.col(f"`{k}`"), F.col(f"__k{i}")).alias(k) for i, k in enumerate(lk)} if how in ("right", "outer", "full") else {}
        out = joined.select(*[keys.get(c, F.col(f"`{c}`")) for c in self.schema], *[F.col(f"`{c}`") for c in names])
        if maintain_sort_order == "left" and self.time:
            out = out.orderBy(f"`{self.time}`")
        elif maintain_sort_order == "right" and right.time in names:
            out = out.orderBy(f"`{right.time}`")
        return self._new(out)

    def join_where(self, right: Stream, condition: str, suffix: str = "_2", how: str = "inner") -> Stream:
        """Join on a SQL condition over both sides' columns; right columns that collide have the suffix there and in the result.

        A condition with an equality between the sides is planned as an equi-join.  Without one each pair of rows is looked at, which is done only
        with a right side that is small enough to be sent to all tasks.
        """
        if how not in ("inner", "left", "semi", "anti"):
            raise ValueError(f"unknown join {how!r} on a condition")
        other = right.df.withColumnsRenamed({c: c + suffix for c in right.schema if c in self.schema})
        found = self.df.join(other, _sql(condition, None), JOINS[how])
        spread = found._jdf.queryExecution().sparkPlan().toString()
        if "NestedLoop" in spread or "Cartesian" in spread:
            if not broadcastable(other):
                raise ValueError("the condition has no equality between the sides, and the right one is too large to be sent to all tasks")
            found = self.df.join(F.broadcast(other), _sql(condition, None), JOINS[how])
        return self._new(found)

    # Aggregates

    def groupby(self, keys: Sequence[str] | str, orderby: Sequence[str | tuple[str, str]] | str | None = None) -> GroupedStream:
        names = _list(keys)
        self._has(names)
        order = [(o, "asc") if isinstance(o, str) else tuple(o) for o in ([orderby] if isinstance(orderby, str) else orderby or [])]
        if odd := [o for o, _ in order if o not in names]:
            raise ValueError(f"orderby {odd} are not group keys")
        return GroupedStream(self, names, order)

    def cube(self, keys: Sequence[str]) -> GroupedStream:
        return GroupedStream(self, _list(keys), [], self.df.cube(*keys))

    def rollup(self, keys: Sequence[str]) -> GroupedStream:
        return GroupedStream(self, _list(keys), [], self.df.rollup(*keys))

    def agg(self, aggregations: Mapping[str, str | Sequence[str]]) -> Stream:
        return Stream(self.df.agg(*_aggregates(self.df, aggregations)))

    aggregate = agg

    def agg_sql(self, text: str) -> Stream:
        return Stream(self.df.agg(*_sql_aggregates(text, self.df)))

    def count(self, collect: bool = True):
        out = Stream(self.df.agg(F.count("*").alias("count")))
        return out.collect() if collect else out

    def _all(self, function: str, columns, collect: bool):
        out = self.agg({c: function for c in _list(columns)})
        return out.collect() if collect else out

    def sum(self, columns, collect: bool = True):
        return self._all("sum", columns, collect)

    def max(self, columns, collect: bool = True):
        return self._all("max", columns, collect)

    def min(self, columns, collect: bool = True):
        return self._all("min", columns, collect)

    def mean(self, columns, collect: bool = True):
        return self._all("mean", columns, collect)

    def count_distinct(self, column: str) -> Stream:
        """Exact; the result keeps the column's name."""
        return Stream(self.df.agg(F.count_distinct(f"`{column}`").alias(column)))

    def approximate_count_distinct(self, column: str, rsd: float = 0.05) -> Stream:
        return Stream(self.df.agg(F.approx_count_distinct(f"`{column}`", rsd).alias(column)))

    def approximate_quantile(self, columns, quantiles: Sequence[float] | float, sample_factor: int = 1) -> Stream:
        """A row a quantile; `sample_factor` is accepted and not needed."""
        names = _list(columns)
        self._has(names)
        return Stream(algebra.approximate_quantile(self.df, names, [quantiles] if isinstance(quantiles, (int, float)) else quantiles))

    def approximate_median(self, columns, sample_factor: int = 1) -> Stream:
        return self.approximate_quantile(columns, [0.5])

    def gramian(self, columns: Sequence[str], demean: Sequence[float] | None = None) -> Stream:
        self._has(columns)
        return Stream(algebra.gramian(self.df, _list(columns), demean))

    def covariance(self, columns: Sequence[str]) -> Stream:
        self._has(columns)
        return Stream(algebra.covariance(self.df, _list(columns)))

    # Vectors

    def _vectors(self, probes, vec_column, left, right):
        frame = probes.df if isinstance(probes, Stream) else probes if isinstance(probes, DataFrame) else self.df.sparkSession.createDataFrame(probes)
        return frame, vec_column or left, vec_column or right

    def vector_nn_join(self, probe_df, vec_column: str | None = None, vec_column_left: str | None = None, vec_column_right: str | None = None, k: int = 1, suffix: str = "_probe", probe_side: str = "right") -> Stream:
        """probe_side "right": the k nearest rows of each probe; "left": the k nearest probes of each row.  Exact cosine, as `similarity`."""
        if probe_side not in ("left", "right"):
            raise ValueError("probe_side is left or right")
        frame, mine, theirs = self._vectors(probe_df, vec_column, vec_column_left, vec_column_right)
        return Stream((vectors.nearest_to_probes if probe_side == "right" else vectors.nearest_probes)(self.df, frame, mine, theirs, k, suffix))

    def vector_range_join(self, probe_df, threshold: float, vec_column: str | None = None, vec_column_left: str | None = None, vec_column_right: str | None = None, suffix: str = "_probe") -> Stream:
        frame, mine, theirs = self._vectors(probe_df, vec_column, vec_column_left, vec_column_right)
        return Stream(vectors.within(self.df, frame, mine, theirs, threshold, suffix))

    def inverted_lists(self, vec_column: str, lists: int, sample_rows: int = 100_000) -> clustering.InvertedLists:
        """An index of all rows by the nearest of `lists` centres, which are fitted on a sample; see `search_lists`."""
        self._has([vec_column])
        return clustering.inverted_lists(self.df, vec_column, lists, sample_rows)

    @staticmethod
    def search_lists(index: clustering.InvertedLists, probes: Stream, vec_column: str, k: int, looked_at: int, suffix: str = "_probe") -> Stream:
        """The k rows nearest to each probe in the `looked_at` lists nearest to it, by exact cosine."""
        return Stream(clustering.search(index, probes.df, vec_column, k, looked_at, suffix))

    # Time

    def ordered(self, time: str) -> OrderedStream:
        """The same rows with a declared time column."""
        self._has([time])
        return OrderedStream(self.df, time)

    def windowed_transform(self, window: windows.EventWindow, trigger) -> Stream:
        if self.time is None:
            raise ValueError("windows need a time column: use ordered(...) or a sorted reader")
        return self._new(windows.windowed(self.df, window, trigger))


class OrderedStream(Stream):
    """A stream with a time column.  It need not lie sorted: operators sort within keys."""

    def __init__(self, df: DataFrame, time: str | None):
        super().__init__(df, time)
        if self.time is None:
            raise KeyError(f"no time column {time} in {df.columns}")

    def _sides(self, right: Stream, on, left_on, right_on, by, left_by, right_by):
        if right.time is None:
            raise ValueError("the right side has no time column")
        lo, ro = on or left_on or self.time, on or right_on or right.time
        lb, rb = _list(by or left_by or []), _list(by or right_by or [])
        if not lb or len(lb) != len(rb):
            raise ValueError("by names the keys of both sides")
        self._has([lo, *lb])
        right._has([ro, *rb])
        return lo, ro, lb, rb

    def join_asof(self, right: Stream, on=None, left_on=None, right_on=None, by=None, left_by=None, right_by=None, suffix: str = "_2", bucket=None) -> Stream:
        """Each row with the last right row of its key at or before its time, nulls if none.

        `bucket` splits keys by stretches of time against skew; "auto" counts rows by key at once and splits only if a key is too full for a task.
        """
        sides = self._sides(right, on, left_on, right_on, by, left_by, right_by)
        stretch = asof.fitting_bucket(self.df, right.df, *sides) if bucket == "auto" else length(bucket) if bucket else None
        return self._new(asof.join_asof(self.df, right.df, *sides, suffix, stretch))

    def join_range(self, right: Stream, before, on=None, left_on=None, right_on=None, by=None, left_by=None, right_by=None, suffix: str = "_2") -> Stream:
        """Each row with all right rows of its key in [time - before, time]."""
        return self._new(asof.join_range(self.df, right.df, *self._sides(right, on, left_on, right_on, by, left_by, right_by), length(before), suffix))

    def shift(self, n: int, by: Sequence[str] | str | None = None, fill_value=None) -> Stream:
        """Every other column moved n rows later within its key; without a key all rows form one order, in one task."""
        return self._new(windows.shift(self.df, self.time, n, _list(by or []), fill_value))

    def pattern_recognize(self, anchors: Sequence[tuple[str, str]], duration_limits: Sequence, partition_by: str | None = None) -> Stream:
        return Stream(windows.pattern_recognize(self.df, self.time, list(anchors), list(duration_limits), partition_by))

    def ordered_stateful_transform(self, f: Callable, new_schema: str | T.StructType, by: Sequence[str] | str) -> Stream:
        """f over a pandas frame of each key, in order of time."""
        return self._new(stateful.per_key(self.df, f, new_schema, _list(by), [self.time]))


class GroupedStream:
    def __init__(self, source: Stream, keys: list[str], order: list[tuple[str, str]], groups: GroupedData | None = None):
        self.source, self.keys, self.order = source, keys, order
        self.groups = source.df.groupBy(*[F.col(f"`{k}`") for k in keys]) if groups is None else groups

    def _out(self, df: DataFrame) -> Stream:
        order = [F.col(f"`{c}`").asc_nulls_last() if way == "asc" else F.col(f"`{c}`").desc_nulls_last() for c, way in self.order]
        return Stream(df.orderBy(*order) if order else df)

    def agg(self, aggregations: Mapping[str, str | Sequence[str]]) -> Stream:
        """{column: function or functions}, "*": "count"; results are named column_function, and count."""
        return self._out(self.groups.agg(*_aggregates(self.source.df, aggregations)))

    aggregate = agg

    def agg_sql(self, text: str) -> Stream:
        return self._out(self.groups.agg(*_sql_aggregates(text, self.source.df)))

    def count_distinct(self, column: str) -> Stream:
        return self._out(self.groups.agg(F.count_distinct(f"`{column}`").alias(column)))

    def cogroup(self, right: GroupedStream, executor, new_schema, required_cols_left: Sequence[str], required_cols_right: Sequence[str]) -> Stream:
        """An executor per key over both streams' rows; both are grouped by one column of the same name."""
        if self.keys != right.keys or len(self.keys) != 1:
            raise ValueError("cogroup takes two streams grouped by the same column")
        return Stream(stateful.cogroup(self.source.df, right.source.df, self.keys[0], executor, new_schema, required_cols_left, required_cols_right))


class Dataset:
    """A computed result that stays on the cluster, in the shared folder."""

    def __init__(self, df: DataFrame):
        self.df = df

    def to_df(self):
        return self.df.toPandas()

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def to_dict(self) -> dict[int, list[str]]:
        """The files in which each part of the result lies."""
        return dict(enumerate([f] for f in sorted(self.df.inputFiles())))

    def to_ray_dataset(self):
        """Needs ray; Ray reads the result's files by itself."""
        import ray

        return ray.data.read_parquet(sorted(self.df.inputFiles()))

    def length(self) -> int:
        return self.df.count()

    def __len__(self) -> int:
        return self.length()


def _order(columns: list[str], descending) -> list[Column]:
    ways = [False] * len(columns) if descending is None else [descending] * len(columns) if isinstance(descending, bool) else list(descending)
    return [F.col(f"`{c}`").desc_nulls_last() if d else F.col(f"`{c}`").asc_nulls_last() for c, d in zip(columns, ways, strict=True)]


def _aggregates(df: DataFrame, aggregations: Mapping[str, str | Sequence[str]]) -> list[Column]:
    out = []
    for column, functions in aggregations.items():
        for f in _list(functions):
            if column == "*":
                if f != "count":
                    raise ValueError('"*" can only be counted')
                out.append(F.count("*").alias("count"))
                continue
            if f not in FUNCTIONS:
                raise ValueError(f"unknown aggregate {f!r}: one of {', '.join(FUNCTIONS)}")
            c = F.col(f"`{column}`")
            if isinstance(df.schema[column].dataType, T.BooleanType):
                c = c.cast("int")
            out.append(FUNCTIONS[f](c).alias(f"{column}_{f}"))
    return out


def _sql_aggregates(text: str, df: DataFrame) -> list[Column]:
    return [F.expr(sql).alias(name) for sql, name in sqltext.aliased(text, df)]
