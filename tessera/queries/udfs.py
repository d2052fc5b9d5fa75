"""User functions, stateful executors, sources and sinks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from tessera.operators.stateful import Executor
from tessera.plans import Stream
from tessera.queries import query
from tessera.storage import fresh_path


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN 'high' ELSE 'low' END AS band FROM orders")
def with_columns_function(t):
    return t.orders.with_columns({"band": lambda x: x["o_totalprice"].map(lambda v: "high" if v > 50000 else "low")}, required_columns={"o_totalprice"}).select(["o_orderkey", "band"])


def _net(table: pa.Table) -> pa.Table:
    return pa.table({"l_orderkey": table["l_orderkey"], "net": pc.round(pc.multiply(table["l_extendedprice"], pc.subtract(1.0, table["l_discount"])), 4)})


query(
    """SELECT l_orderkey, round(l_extendedprice*(1-l_discount),4) AS net
     FROM lineitem""",
    "transform_udf",
)(
    lambda t: t.lineitem.transform(_net, ["l_orderkey", "net"], {"l_orderkey", "l_extendedprice", "l_discount"})
        .transform_sql("l_orderkey as l_orderkey, round(net, 4) as net")
)


class CountByKey(Executor):
    """Counts and sums per key of all the batches that a task sees."""

    def __init__(self):
        self.sums: dict = {}

    def execute(self, batches, stream_id, executor_id):
        for b in batches:
            for r in b.group_by("o_custkey").aggregate([("o_orderkey", "count")]).to_pylist():
                self.sums[r["o_custkey"]] = self.sums.get(r["o_custkey"], 0) + r["o_orderkey_count"]

    def done(self, executor_id):
        return pa.table({"o_custkey": pa.array(list(self.sums), pa.int64()), "n": pa.array(list(self.sums.values()), pa.int64())})


query(
    """SELECT o_custkey, count(*) AS n
     FROM orders
     GROUP BY ALL""",
    "stateful_by_key",
)(
    lambda t: t.orders.stateful_transform(CountByKey, "o_custkey long, n long", ["o_custkey", "o_orderkey"], by="o_custkey")
)
query(
    """SELECT o_custkey, sum(n)::BIGINT AS n
     FROM (SELECT o_custkey, count(*) AS n
     FROM orders
     GROUP BY ALL)
     GROUP BY ALL""",
    "udaf_partial_final",
)(
    lambda t: t.orders.stateful_transform(CountByKey, ["o_custkey", "n"], ["o_custkey", "o_orderkey"])
        .groupby("o_custkey")
        .agg_sql("sum(n) as n")
)


class Margins(Executor):
    def __init__(self):
        self.seen = [0, 0]

    def execute(self, batches, stream_id, executor_id):
        self.seen[stream_id] += sum(b.num_rows for b in batches)
        self.key = batches[0]["k"][0].as_py()

    def done(self, executor_id):
        return pa.table({"k": [self.key], "left_rows": [self.seen[0]], "right_rows": [self.seen[1]]})


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(l, 0) AS left_rows, coalesce(r, 0) AS right_rows
 FROM (SELECT s_nationkey AS k, count(*) AS l
 FROM supplier
 GROUP BY ALL) a
 FULL
 JOIN (SELECT c_nationkey AS k, count(*) AS r
 FROM customer
 GROUP BY ALL) b ON a.k = b.k""")
def cogroup_executor(t):
    a = t.supplier.transform_sql("s_nationkey as k, s_suppkey as id")
    b = t.customer.transform_sql("c_nationkey as k, c_custkey as id")
    return a.groupby("k").cogroup(b.groupby("k"), Margins, "k int, left_rows long, right_rows long", ["k", "id"], ["k", "id"])


class Tagged(Executor):
    def execute(self, batches, stream_id, executor_id):
        return [pa.table({"stream": pa.array([stream_id] * b.num_rows, pa.int32()), "id": b["id"]}) for b in batches]


query(
    """SELECT stream, count(*) AS n, sum(id)::BIGINT AS ids
     FROM (SELECT 0 AS stream, s_suppkey AS id
     FROM supplier
     UNION ALL SELECT 1, c_custkey
     FROM customer)
     GROUP BY ALL""",
    "mingle_streams",
)(
    lambda t: t.ctx.mingle([t.supplier.transform_sql("s_suppkey as id"), t.customer.transform_sql("c_custkey as id")], Tagged, "stream int, id long", [["id"], ["id"]])
        .groupby("stream")
        .agg_sql("count(*) as n, sum(id) as ids")
)


@query("""SELECT user_id, round(sum(value * CASE WHEN r % 2 = 1 THEN 1 ELSE -1 END), 6) AS swing, last(event_id ORDER BY r) AS latest
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events) GROUP BY user_id""")
def ordered_stateful_transform(t):
    """Signs alternate along time, so the result tells the order."""

    def swings(f):
        signs = 1 - 2 * (np.arange(len(f)) % 2)
        return pd.DataFrame({"user_id": f["user_id"].iloc[:1], "swing": [round(float((f["value"] * signs).sum()), 6)], "latest": f["event_id"].iloc[-1:].to_numpy()})

    return t.events.select(["user_id", "event_id", "ts", "value"]).ordered("ts").ordered_stateful_transform(swings, "user_id long, swing double, latest long", "user_id")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_round_trip(t):
    path = fresh_path(t.spark, "csv")
    t.customer.select(["c_custkey", "c_name", "c_nationkey", "c_acctbal"]).write_csv(path, output_line_limit=400)
    return t.ctx.read_csv(f"{path}/*", schema="c_custkey long, c_name string, c_nationkey int, c_acctbal double", has_header=True)


@query("SELECT count(*) AS n, sum(s_suppkey)::BIGINT AS ids FROM supplier")
def parquet_round_trip(t):
    path = fresh_path(t.spark, "parquet")
    t.supplier.write_parquet(path, output_line_limit=50)
    return t.ctx.read_parquet(f"{path}/*").agg_sql("count(*) as n, sum(s_suppkey) as ids")


@query("SELECT r_regionkey, r_name FROM region")
def dataset_round_trip(t):
    return t.ctx.read_dataset(t.region.compute())


@query("SELECT r_regionkey, r_name FROM region")
def arrow_round_trip(t):
    return t.ctx.from_arrow(t.region.to_arrow())


@query("SELECT r_regionkey, r_name FROM region")
def pandas_round_trip(t):
    return t.ctx.from_pandas(t.region.collect())


@query("SELECT event_id, event_type, props, value FROM events")
def json_round_trip(t):
    path = fresh_path(t.spark, "json")
    t.events.select(["event_id", "event_type", "props", "value"]).df.write.json(path)
    return t.ctx.read_json(path, "event_id long, event_type string, props string, value double")


@query("SELECT count(*) AS n FROM orders")
def read_files(t):
    path = fresh_path(t.spark, "blobs")
    t.orders.df.select("o_orderkey", "o_custkey").repartition(4).write.csv(path)
    rows = t.ctx.read_files(f"{path}/*.csv")
    return Stream(rows.df.selectExpr("explode(filter(split(decode(object, 'UTF-8'), '\\n'), x -> x <> '')) AS line")).agg_sql("count(*) as n")


class Squares:
    """A user-defined reader: each channel's states are numbers, read as themselves and their squares."""

    def get_own_state(self, num_channels):
        return {c: list(range(c, 20, num_channels)) for c in range(num_channels)}

    def execute(self, channel, state):
        return pa.table({"i": pa.array([state], pa.int64()), "square": pa.array([state * state], pa.int64())})


query("SELECT i, i * i AS square FROM range(20) r(i)", "custom_source")(lambda t: t.ctx.read_custom(Squares(), "i long, square long", 4))
query(
    """SELECT c_mktsegment, count(*) AS n
     FROM customer
     GROUP BY ALL""",
    "sql_text",
)(
    lambda t: t.ctx.sql("SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY ALL", customer=t.customer)
)
