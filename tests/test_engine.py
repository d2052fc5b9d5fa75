"""Semantics that the test tables do not reach: nulls, ties, empty inputs, skewed keys, errors, sources."""

import datetime as dt
import http.server
import importlib
import itertools
import json
import pathlib
import random
import sys
import threading

import pyarrow as pa
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from tessera import streaming
from tessera.functions import col, sqltext
from tessera.operators.windows import HoppingWindow, OnCompletionTrigger, OnEventTrigger, SessionWindow, SlidingWindow, TumblingWindow
from tessera.plans import Context, Stream


@pytest.fixture(scope="module")
def ctx(spark):
    return Context(spark)


def make(spark, rows, schema, time=None):
    s = Stream(spark.createDataFrame(rows, schema))
    return s.ordered(time) if time else s


def got(stream):
    return sorted((tuple(r) for r in stream.df.collect()), key=repr)


def test_sql_text():
    assert sqltext.split("a, f(b, 'x,y'), [1, 2]") == ["a", "f(b, 'x,y')", "[1, 2]"]
    assert list(sqltext.aliased('sum("a b") as x, len(y) AS "z"')) == [("sum(`a b`)", "x"), ("length(y)", "z")]
    assert sqltext.over("sum(a) / count(*) + 1", "PARTITION BY k") == "sum(a) OVER (PARTITION BY k) / count(*) OVER (PARTITION BY k) + 1"
    with pytest.raises(ValueError):
        list(sqltext.aliased("sum(a)"))


def test_expressions(spark):
    s = make(spark, [(7, 2.0, "Ab"), (None, 1.0, None)], "i int, d double, t string")
    out = s.with_columns({"a": s["i"] % 4 + 2 ** s["d"], "b": (s["i"] > 5) & ~(s["d"] == 1), "c": 10 - s["i"] / 2, "e": s["t"].str.starts_with("A"), "f": -s["d"], "g": s["i"].isin(7, 8)}).collect()
    assert out.iloc[0][["a", "b", "c", "e", "f", "g"]].tolist() == [7.0, True, 6.5, True, -2.0, True]
    assert out.iloc[1][["a", "e"]].isna().all()
    with pytest.raises(ValueError):
        bool(col("x") == 1)
    with pytest.raises(KeyError):
        s["absent"]


def test_clip_keeps_nulls_and_join_rules(spark):
    s = make(spark, [(1, 5.0), (2, None), (3, 50.0), (None, 1.0)], "k int, v double")
    assert got(s.clip({"v": (6.0, 10.0)})) == sorted([(1, 6.0), (2, None), (3, 10.0), (None, 6.0)], key=repr)
    other = make(spark, [(1, 9.0), (None, 8.0)], "k int, v double")
    assert got(s.join(other, on="k")) == [(1, 5.0, 9.0)]
    assert len(got(s.join(other, on="k", how="left"))) == 4
    assert got(s.join(other, on="k", how="anti").select(["k"])) == sorted([(2,), (3,), (None,)], key=repr)
    with pytest.raises(ValueError):
        s.join(other, on="k", how="theta")
    with pytest.raises(ValueError):
        s.rename({"k": "v"})
    with pytest.raises(ValueError):
        s.with_columns({"k": s["v"]})
    assert s.filter("k > 100").collect().empty


def test_top_k_puts_nulls_last(spark):
    s = make(spark, [(1,), (None,), (3,)], "k int")
    assert [r.k for r in s.top_k("k", 3, True).df.collect()] == [3, 1, None]
    assert [r.k for r in s.top_k("k", 3).df.collect()] == [1, 3, None]


def test_bool_aggregates(spark):
    s = make(spark, [(True,), (False,), (True,), (None,)], "b boolean")
    assert got(s.agg({"b": ["sum", "count"], "*": "count"})) == [(2, 3, 4)]


def asof(left, right):
    out = []
    for k, t, x in left:
        best = max(((u, y) for j, u, y in right if j == k and u is not None and t is not None and u <= t), default=(None, None))
        out.append((k, t, x, best[1]))
    return sorted(out, key=repr)


def test_asof_bucket_from_the_data(spark, monkeypatch):
    from tessera.operators import asof as operator

    r = random.Random(2)
    left, right = ([(r.choice(["hot"] * 9 + ["a"]), r.randrange(1000), i) for i in range(n)] for n in (300, 200))
    a, b = make(spark, left, "k string, t long, x long", "t"), make(spark, right, "k string, t long, y long", "t")
    plain = got(a.join_asof(b, on="t", by="k"))
    sides = (a.df, b.df, "t", "t", ["k"], ["k"])
    assert operator.fitting_bucket(*sides) is None and got(a.join_asof(b, on="t", by="k", bucket="auto")) == plain
    monkeypatch.setattr(operator, "STRETCH_ROWS", 50)
    assert 50 < operator.fitting_bucket(*sides) < 250 and got(a.join_asof(b, on="t", by="k", bucket="auto")) == plain


@pytest.mark.parametrize("bucket,parts", [(None, 1), (None, 7), (5, 3), (1, 2), (1000, 4)])
def test_asof_with_ties_nulls_and_hot_keys(spark, bucket, parts):
    r = random.Random(parts)
    left = [(r.choice([1, 1, 1, 2, 3]), r.randrange(60), i) for i in range(150)] + [(1, None, 999)]
    right = [(r.choice([1, 1, 1, 2]), r.randrange(60), i) for i in range(120)] + [(1, None, -1)]
    a = Stream(spark.createDataFrame(left, "k int, t long, x int").repartition(parts)).ordered("t")
    b = Stream(spark.createDataFrame(right, "k int, t long, y int").repartition(parts)).ordered("t")
    assert got(a.join_asof(b, on="t", by="k", bucket=bucket)) == asof(left, right)
    assert all(x[3] is None for x in got(a.join_asof(b.filter_sql("y < -5"), on="t", by="k", bucket=bucket)))


def test_range_join(spark):
    r = random.Random(2)
    left, right = ([(r.randrange(3), r.randrange(-40, 40), i) for i in range(80)] for _ in range(2))
    a, b = (make(spark, x, "k int, t long, i int", "t") for x in (left, right))
    want = sorted(((k, t, i, u, j) for k, t, i in left for l, u, j in right if l == k and t - 7 <= u <= t), key=repr)
    assert got(a.join_range(b, 7, on="t", by="k")) == want


EVENTS = [(k, t, v) for k in (1, 2) for t, v in [(0, 1.0), (3, 2.0), (3, 3.0), (9, 4.0), (10, 5.0), (21, 6.0)]] + [(3, None, 1.0)]
AGGS = {"n": "count(*)", "s": "sum(v)"}


def test_windows_on_integer_time(spark):
    s = make(spark, EVENTS, "k int, t int, v double", "t")
    rows = [e for e in EVENTS if e[1] is not None]
    summed = lambda f: sorted(((x, k, len(g), sum(e[2] for e in g)) for (x, k), g in f.items()), key=repr)
    group = lambda pairs: {key: [e for q, e in pairs if q == key] for key in {q for q, _ in pairs}}
    assert got(s.windowed_transform(TumblingWindow("t", "k", 5, aggregation_dict=AGGS), OnCompletionTrigger())) == summed(group([((e[1] // 5 * 5, e[0]), e) for e in rows]))
    hop = [((b, e[0]), e) for e in rows for b in range(-9, 30, 3) if b <= e[1] < b + 8]
    assert got(s.windowed_transform(HoppingWindow("t", "k", 3, 8, aggregation_dict=AGGS), OnCompletionTrigger())) == summed(group(hop))
    slide = sorted(((t, k, len(g := [e for e in rows if e[0] == k and t - 7 < e[1] <= t]), sum(e[2] for e in g)) for k, t, _ in rows), key=repr)
    assert got(s.windowed_transform(SlidingWindow("t", "k", 7, aggregation_dict=AGGS), OnEventTrigger())) == slide
    # A gap of exactly the timeout (6: from 3 to 9) keeps a session.
    assert got(s.windowed_transform(SessionWindow("t", "k", 6, aggregation_dict=AGGS), OnCompletionTrigger())) == sorted([(0, k, 5, 15.0) for k in (1, 2)] + [(21, k, 1, 6.0) for k in (1, 2)], key=repr)
    running = sorted(((t, k, len(g := [e for e in rows if e[0] == k and e[1] // 5 == t // 5 and e[1] <= t]), sum(e[2] for e in g)) for k, t, _ in rows), key=repr)
    assert got(s.windowed_transform(TumblingWindow("t", "k", 5, aggregation_dict=AGGS), OnEventTrigger())) == running
    with pytest.raises(ValueError):
        s.windowed_transform(HoppingWindow("t", "k", 3, 8, aggregation_dict=AGGS), OnEventTrigger())
    with pytest.raises(TypeError):
        s.ordered("v").windowed_transform(TumblingWindow("v", "k", 5, aggregation_dict=AGGS), OnCompletionTrigger())


def test_shift(spark):
    s = make(spark, [(1, t, t * 10) for t in range(4)], "k int, t int, v int", "t")
    assert [r.v for r in s.shift(1, "k", -1).df.orderBy("t").collect()] == [-1, 0, 10, 20]
    assert [r.v for r in s.shift(-2, "k").df.orderBy("t").collect()] == [20, 30, None, None]


def test_pattern_is_greedy(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (1, 20, "c"), (1, 30, "a"), (1, 31, "b"), (1, 33, "c"), (1, 33, "b"), (2, 0, "a"), (2, 0, "b")]
    s = make(spark, rows, "k int, t int, e string", "t")
    found = got(s.pattern_recognize([("x", "e = 'a'"), ("y", "e = 'b'"), ("z", "e = 'c'")], [5, 10], "k"))
    assert found == [(1, 30, 31, 33)]


@pytest.mark.parametrize("block", [8192, 3])
def test_nearest_neighbours_in_blocks(spark, monkeypatch, block):
    import numpy as np

    from tessera.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    r = np.random.default_rng(0)
    x, p = r.normal(size=(60, 6)), r.normal(size=(10, 6))
    s = make(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[0].tolist()), (61, None)], "id int, v array<double>")
    probes = make(spark, [(i, v.tolist()) for i, v in enumerate(p)], "pid int, w array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit(np.vstack([x, x[:1]])) @ unit(p).T
    near = {(i, j) for j in range(10) for i in sorted(range(61), key=lambda i: (-cos[i, j], i))[:4]}
    out = s.vector_nn_join(probes, vec_column_left="v", vec_column_right="w", k=4).df.select("id", "pid").collect()
    assert {tuple(r) for r in out} == near and len(out) == 40
    back = {(i, j) for i in range(61) for j in sorted(range(10), key=lambda j: -cos[i, j])[:2]}
    out = s.vector_nn_join(probes, vec_column_left="v", vec_column_right="w", k=2, probe_side="left").df.select("id", "pid").collect()
    assert {tuple(r) for r in out} == back and len(out) == 122
    out = s.vector_range_join(probes, 0.5, vec_column_left="v", vec_column_right="w").df.select("id", "pid").collect()
    assert {tuple(r) for r in out} == {(int(i), int(j)) for i, j in zip(*np.nonzero(cos >= 0.5))}


def test_empty_inputs(spark, ctx):
    s = make(spark, [], "k int, t int, v double", "t")
    assert s.windowed_transform(TumblingWindow("t", "k", 5, aggregation_dict=AGGS), OnCompletionTrigger()).collect().empty
    assert s.join_asof(s.rename({"v": "w"}), on="t", by="k").collect().empty
    assert s.transform(lambda t: t, "k int, v double", {"k", "v"}).collect().empty
    assert s.gramian(["v"]).df.collect()[0][0] is None
    assert s.compute().length() == 0


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_stateful_results_do_not_depend_on_partitions(spark, parts):
    from tessera.queries.udfs import CountByKey

    rows = [(i % 7, i) for i in range(500)]
    s = Stream(spark.createDataFrame(rows, "o_custkey long, o_orderkey long").repartition(parts))
    assert got(s.stateful_transform(CountByKey, ["o_custkey", "n"], {"o_custkey", "o_orderkey"}, by="o_custkey")) == sorted((k, 500 // 7 + (k < 500 % 7)) for k in range(7))


def test_partitioners_and_placements(spark):
    from tessera.operators.stateful import CustomChannelsStrategy, HashPartitioner, RangePartitioner, SingleChannelStrategy
    from tessera.queries.udfs import CountByKey

    s = Stream(spark.createDataFrame([(i % 5, i) for i in range(100)], "o_custkey long, o_orderkey long").repartition(6))
    want = [(k, 20) for k in range(5)]
    for partitioner, placement in [(HashPartitioner("o_custkey"), None), (HashPartitioner("o_custkey"), CustomChannelsStrategy(3)), (RangePartitioner("o_custkey", 4), None), (None, SingleChannelStrategy())]:
        assert got(s.stateful_transform(CountByKey, "o_custkey long, n long", {"o_custkey", "o_orderkey"}, partitioner, placement)) == want
    spread = got(s.stateful_transform(CountByKey, "o_custkey long, n long", {"o_custkey", "o_orderkey"}, None, CustomChannelsStrategy(4)))
    assert sum(n for _, n in spread) == 100 and len(spread) > 5


def test_broadcast_and_function_partitioners(spark):
    from tessera.operators.stateful import BroadcastPartitioner, CustomChannelsStrategy, DatasetStrategy, FunctionPartitioner, TaggedCustomChannelsStrategy
    from tessera.queries.udfs import CountByKey

    s = Stream(spark.createDataFrame([(i % 5, i) for i in range(100)], "o_custkey long, o_orderkey long").repartition(6)).compute()
    s = Stream(s.df)

    def counted(partitioner, placement):
        return got(s.stateful_transform(CountByKey, "o_custkey long, n long", {"o_custkey", "o_orderkey"}, partitioner, placement))

    assert counted(BroadcastPartitioner(), DatasetStrategy(3)) == [(k, 20) for k in range(5) for _ in range(3)]
    assert counted(FunctionPartitioner(lambda df: df.o_custkey + 7), TaggedCustomChannelsStrategy(2, "gpu")) == [(k, 20) for k in range(5)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        with pytest.raises(ValueError, match="too many"):
            counted(BroadcastPartitioner(), CustomChannelsStrategy(3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_expressions_know_their_columns(spark):
    s = make(spark, [(1, 2.0, "x")], "a int, b double, c string")
    assert (s["a"] + s["b"] * 2 > 1).required_columns() == {"a", "b"}
    assert s["c"].str.to_uppercase().required_columns() == {"c"}


def test_joins_on_conditions(spark):
    a, b = make(spark, [(1, 5), (2, 9), (3, 1)], "k int, v int"), Stream(make(spark, [(1, 4), (2, 9), (2, 3)], "k int, lo int").compute().df)
    assert got(a.join_where(b, "k = k_2 and v > lo")) == [(1, 5, 1, 4), (2, 9, 2, 3)]
    assert got(a.join_where(b, "v > lo and v < 9")) == [(1, 5, 1, 4), (1, 5, 2, 3)]
    assert got(a.join_where(b, "v >= lo and k = k_2", how="anti")) == [(3, 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        with pytest.raises(ValueError, match="equality"):
            a.join_where(b, "v > lo")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_of_texts(spark):
    s = make(spark, [(" a\tb  a\n",), ("",), (" \x0b\f\r ",), (None,), ("é x",)], "t string").spread()
    assert s.df.rdd.getNumPartitions() >= 4
    assert got(s.with_columns({"w": lambda x: x["t"].str.tokens()}).select(["w"])) == sorted([(["a", "b", "a"],), ([],), ([],), (None,), (["é", "x"],)], key=repr)


def test_set_operations_with_repeats(spark):
    a, b = make(spark, [(1,), (1,), (1,), (2,)], "k int"), make(spark, [(1,), (1,), (3,)], "k int")
    assert got(a.intersect_all(b)) == [(1,), (1,)] and got(a.except_all(b)) == [(1,), (2,)]


def test_sliding_frames_of_rows_and_ahead(spark):
    s = make(spark, [("a", t, t) for t in (1, 2, 4, 8)], "k string, t long, v long", "t")
    rows = s.windowed_transform(SlidingWindow("t", "k", 2, 1, rows=True, aggregation_dict={"x": "sum(v)"}), OnEventTrigger())
    assert [r[2] for r in got(rows)] == [3, 7, 14, 12]
    ahead = s.windowed_transform(SlidingWindow("t", "k", 2, 4, aggregation_dict={"x": "sum(v)"}), OnEventTrigger())
    assert [r[2] for r in got(ahead)] == [7, 7, 12, 8]


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    """A row that comes after its window has been given out is dropped."""
    at = lambda h: dt.datetime(2024, 1, 1, h)
    for n, hours in enumerate([(0, 1, 9), (8, 10), (1, 11, 20), (21,)]):
        spark.createDataFrame([(at(h), "k", h) for h in hours], "ts timestamp, k string, v int").coalesce(1).write.parquet(f"{tmp_path}/{n}")
    stream = spark.readStream.schema("ts timestamp, k string, v int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/[0-9]")
    window = TumblingWindow("ts", "k", dt.timedelta(hours=4), aggregation_dict={"n": "count(*)"})
    out = got(Stream(streaming.drained(streaming.windowed(stream, window, OnCompletionTrigger(dt.timedelta(hours=1))))))
    assert out == [(at(0), "k", 2), (at(8), "k", 4)]  # one o'clock of the third file is late, eleven is not


def test_fragments_are_read_in_tasks(spark, tmp_path, monkeypatch):
    """A stand-in for the package that the machine lacks."""
    (tmp_path / "lance.py").write_text(
        "import pyarrow as pa\n"
        "class Fragment:\n"
        "    def __init__(self, n): self.fragment_id = n\n"
        "    def to_batches(self): return [pa.record_batch({'i': pa.array([self.fragment_id], pa.int64()), 'v': [[1.0, 2.0]]})]\n"
        "class Whole:\n"
        "    schema = Fragment(0).to_batches()[0].schema\n"
        "    def get_fragments(self): return [Fragment(n) for n in range(3)]\n"
        "    def get_fragment(self, n): return Fragment(n)\n"
        "    def to_table(self): raise RuntimeError('not through the driver')\n"
        "def dataset(at): return Whole()\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    before = list(sys.path)
    spark.sparkContext.addPyFile(str(tmp_path / "lance.py"))
    try:
        assert got(Context(spark).read_lance("/nowhere/x.lance", "v")) == [(i, [1.0, 2.0]) for i in range(3)]
    finally:
        sys.path[:] = before
        sys.modules.pop("lance", None)
        pathlib.Path(SparkFiles.get("lance.py")).unlink()
        importlib.invalidate_caches()


class Service(http.server.BaseHTTPRequestHandler):
    def answer(self, body):
        self.send_response(200 if body is not None else 404)
        self.end_headers()
        if body is not None:
            self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        i = int(self.path.rsplit("/", 1)[1])
        self.answer(None if i == 3 else {"id": i, "title": f"t{i}", "extra": 1} if i != 4 else {"id": 4})

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.answer({"result": [{"id": asked["n"], "k": k} for k in range(asked["n"])]})

    def log_message(self, *_):
        pass


def test_rest(ctx):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        assert got(ctx.read_rest_get(url, ["1", "2", "3", "4"], "id long, title string", on_error="skip")) == [(1, "t1"), (2, "t2"), (4, None)]
        rows = ctx.read_rest_get(url, ["1", "3"], "id long, title string", on_error="report").collect()
        assert sorted(rows["error"].isna()) == [False, True] and "404" in rows["error"].dropna().iloc[0]
        with pytest.raises(Exception, match="no answer for"):
            ctx.read_rest_get(url, ["1", "3"], "id long, title string").collect()
        assert got(ctx.read_rest_post(url, [{"n": 2}, {"n": 0}, {"n": 1}], "id long, k long")) == [(1, 0), (2, 0), (2, 1)]
    finally:
        server.shutdown()


def test_a_service_that_is_down_is_an_error(ctx):
    with pytest.raises(Exception, match="no answer for"):
        ctx.read_rest_post("http://127.0.0.1:9/", [{"n": 1}], "id long", tries=2).collect()
    with pytest.raises(ValueError):
        ctx.read_rest_get("http://127.0.0.1:9/", ["1"], "id long", on_error="ignore")


def test_a_server_error_is_tried_again(ctx):
    class Shaky(Service):
        seen: dict = {}

        def do_GET(self):
            self.seen[self.path] = self.seen.get(self.path, 0) + 1
            if self.seen[self.path] < 3:
                self.send_response(503)
                self.end_headers()
            else:
                self.answer({"id": int(self.path[1:])})

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Shaky)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert got(ctx.read_rest_get(f"http://127.0.0.1:{server.server_port}/", ["1", "2"], "id long")) == [(1,), (2,)]
    finally:
        server.shutdown()


def test_list_aggregates_keep_nulls(spark):
    s = make(spark, [(1, "a"), (1, None), (2, None), (2, "b"), (2, "b")], "k int, v string")
    rows = s.groupby("k").agg_sql("array_agg(v) as vs, len(list(distinct v)) as kinds, array_agg(v) filter (where v is not null) as some").collect().sort_values("k")
    assert [sorted(v, key=str) for v in rows["vs"]] == [[None, "a"], [None, "b", "b"]] or [sorted(v, key=str) for v in rows["vs"]] == [["a", None], ["b", "b", None]]
    assert rows["kinds"].tolist() == [2, 2] and [list(v) for v in rows["some"]] == [["a"], ["b", "b"]]


def test_len_is_by_type(spark):
    s = make(spark, [([1, 2, 3], "four"), ([], ""), (None, None)], "a array<int>, s string")
    out = s.with_columns_sql("len(a) as na, len(s) as ns, list_contains(list_distinct(a), 2) as two").select(["na", "ns"]).df.collect()
    assert {tuple(r) for r in out} == {(3, 4), (0, 0), (None, None)}
    assert s.filter_sql("len(a) > 1 and len(s) = 4").count()["count"].tolist() == [1]


def test_errors_of_functions_are_shown_and_types_can_be_given(spark):
    s = make(spark, [(i, i / 2) for i in range(200)], "k long, v double")
    with pytest.raises(ZeroDivisionError):
        s.with_columns({"x": lambda f: 1 / 0})
    late = lambda f: f["k"].map(lambda k: 0.5 if k > 150 else k)  # noqa: E731  whole numbers at first
    assert s.with_columns({"x": (late, "double")}, {"k"}).df.where("x = 0.5").count() == 49

    def noted(f) -> "double":
        return f["k"] * 2

    assert dict(s.with_columns({"x": noted}, {"k"}).df.dtypes)["x"] == "double"


def test_vectors_that_cannot_be_compared(spark):
    rows = make(spark, [(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0]), (3, [None, 1.0]), (4, []), (5, [float("nan"), 1.0]), (6, [3.0, 0.1])], "id long, v array<double>")
    probes = make(spark, [(10, None), (11, [1.0, 0.0]), (12, [0.0, 2.0]), (13, [None, None])], "pid long, w array<double>")
    args = {"vec_column_left": "v", "vec_column_right": "w"}
    assert got(rows.vector_nn_join(probes, k=2, **args).select(["id", "pid"])) == [(0, 11), (2, 12), (6, 11), (6, 12)]
    assert got(rows.vector_nn_join(probes, k=1, probe_side="left", **args).select(["id", "pid"])) == [(0, 11), (2, 12), (6, 11)]
    assert got(rows.vector_range_join(probes, 0.9, **args).select(["id", "pid"])) == [(0, 11), (2, 12), (6, 11)]
    none = make(spark, [(1, None)], "pid long, w array<double>")
    assert got(rows.vector_nn_join(none, k=1, **args)) == []
    ragged = make(spark, [(1, [1.0, 2.0, 3.0])], "pid long, w array<double>")
    with pytest.raises(Exception, match="components"):
        rows.vector_nn_join(ragged, k=1, **args).collect()
    with pytest.raises(ValueError, match="components"):
        rows.vector_nn_join(make(spark, [(1, [1.0]), (2, [1.0, 2.0])], "pid long, w array<double>"), k=1, **args)


def test_inverted_lists_find_most_neighbours(spark):
    import numpy as np

    from tessera.operators import clustering

    r = np.random.default_rng(8)
    x = np.concatenate([c + 0.4 * r.normal(size=(40, 8)) for c in 2 * r.normal(size=(12, 8))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [None] * 8)], "id long, v array<double>").repartition(4)
    probes = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, len(x), 10)], "pid long, w array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(i), p) for p in range(0, len(x), 10) for i in np.argsort(-unit @ unit[p], kind="stable")[:5]}
    index = clustering.inverted_lists(rows, "v", 12)
    assert index.rows.count() == len(x) and len(index.centres) == 12
    some, every = ({tuple(r) for r in clustering.search(index, probes, "w", 5, n).select("id", "pid").collect()} for n in (3, 12))
    assert every == want
    assert len(some & want) >= 0.9 * len(want)


def test_csv_rules(ctx, tmp_path):
    (tmp_path / "a.csv").write_text("1|x|\n2|y|\n")
    assert got(ctx.read_csv(str(tmp_path / "a.csv"), ["k", "v", "null"], sep="|").drop(["null"])) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        ctx.read_csv(str(tmp_path / "a.csv"))
    (tmp_path / "t.txt").write_text("one two\nthree\n")
    assert got(ctx.read_text(str(tmp_path / "t.txt"))) == [("one two",), ("three",)]


def test_config_and_gated_sources(ctx):
    ctx.set_config("optimize_joins", True)
    assert ctx.get_config("optimize_joins") == "true"
    with pytest.raises(ImportError):
        ctx.read_lance("/nowhere/x.lance", "v")


def test_plans_push_down_and_prune(ctx):
    plan = ctx.read_parquet("/root/testdata/sf0.001/lineitem.parquet").filter_sql("l_discount > 0.05").select(["l_orderkey"]).explain()
    assert "PushedFilters: [IsNotNull(l_discount), GreaterThan(l_discount,0.05)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in plan


def test_session_and_hopping_streams_equal_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(minutes=m), float(m)) for k in (1, 2) for m in (0, 10, 20, 31, 90, 400)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double")
    df.write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for w in (SessionWindow("ts", "k", dt.timedelta(minutes=10), aggregation_dict={"n": "count(*)"}), HoppingWindow("ts", "k", dt.timedelta(minutes=30), dt.timedelta(hours=1), aggregation_dict={"n": "count(*)"})):
        closed = {r for r in got(Stream(streaming.drained(streaming.windowed(read(), w, OnCompletionTrigger(dt.timedelta(0))))))}
        whole = {r for r in got(Stream(df).ordered("ts").windowed_transform(w, OnCompletionTrigger()))}
        assert closed and closed <= whole
        assert all(r[0] >= base + dt.timedelta(minutes=300) for r in whole - closed)


def test_combinations_of_joined_sorted_streams_keep_time(ctx):
    s = ctx.read_sorted_parquet("/root/testdata/sf0.001/events.parquet", "ts")
    assert s.filter_sql("value > 0").select(["ts", "user_id"]).time == "ts"
    assert s.rename({"ts": "at"}).time == "at"
    with pytest.raises(ValueError):
        s.drop(["ts"])
    assert list(itertools.islice(s.schema, 2)) == ["event_id", "ts"]
    assert isinstance(s.to_arrow(), pa.Table) and s.df.select(F.max("ts")).count() == 1


@pytest.mark.parametrize("block", [8192, 4])
def test_vector_queries_take_every_fiftieth_row_as_probe(spark, tmp_path, monkeypatch, block):
    import numpy as np

    from tessera import queries
    from tessera.operators import vectors

    queries.load()
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    x = np.random.default_rng(4).normal(size=(620, 6))
    spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos, ids, ps = unit @ unit.T, range(len(x)), range(0, len(x), 50)
    assert len(ps) == 13
    want = {
        "knn_of_probes": {(i, p) for p in ps for i in sorted(ids, key=lambda i: -cos[i, p])[:5]},
        "knn_of_rows": {(i, p) for i in ids for p in sorted(ps, key=lambda p: -cos[i, p])[:2]},
        "vector_range": {(i, p) for i in ids for p in ps if cos[i, p] >= 0.3},
        "knn_filtered": {(i, p) for p in ps for i in sorted((i for i in ids if i % 7 < 3), key=lambda i: -cos[i, p])[:3]},
    }
    for name, pairs in want.items():
        out = queries.QUERIES[name](spark, str(tmp_path)).select("vec_id", "probe_id").collect()
        assert {tuple(r) for r in out} == pairs and len(out) == len(pairs), name


def test_matrix_product_and_pagerank_take_all_ids(spark, tmp_path):
    from tessera import queries

    queries.load()
    r = random.Random(6)
    rows = sorted({(r.randrange(1, 90), r.randrange(1, 400), r.randrange(1, 8)) for _ in range(700)} | {(5, 5, 1)})
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = {s: {n for i, _, n in rows if i == s} for s, _, _ in rows}
    want = {(a, b): len(lines[a] & lines[b]) for a in lines for b in lines if lines[a] & lines[b]}
    out = queries.QUERIES["sparse_matmul"](spark, str(tmp_path)).collect()
    assert {(x.i, x.j): x.v for x in out} == want and len(out) == len(want)
    edges = {(s, -1 - p) for s, p, _ in rows}
    nodes = {x for e in edges for x in e}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(5):
        got = dict.fromkeys(nodes, 0.0)
        for s, p in edges:
            got[p] += rank[s] / sum(a == s for a, _ in edges)
        lost = 1 - sum(got.values())
        rank = {n: 0.15 / len(nodes) + 0.85 * (got[n] + lost / len(nodes)) for n in nodes}
    out = {x.node: x["rank"] for x in queries.QUERIES["pagerank"](spark, str(tmp_path)).collect()}
    assert out == pytest.approx(rank)


@pytest.mark.parametrize("tile, step", [(1 << 24, 1 << 20), (40, 7)])
def test_matrix_product_by_tiles(spark, monkeypatch, tile, step):
    from tessera.operators import algebra

    monkeypatch.setattr(algebra, "TILE_PRODUCTS", tile)
    monkeypatch.setattr(algebra, "STEP_PRODUCTS", step)
    r = random.Random(3)
    cells = lambda: [(r.choice([None, *range(30)]), r.choice([None, 0, 1, 2]), r.choice([None, 1.0, -1.0, 2.5])) for _ in range(150)]
    left, right = cells(), [(k, None if j is None else f"c{j}", v) for j, k, v in cells()]
    want: dict = {}
    for i, k, x in left:
        for _, j, y in (row for row in right if k is not None and row[0] == k):
            want.setdefault((i, j), []).append(None if x is None or y is None else x * y)
    want = {c: None if all(v is None for v in vs) else sum(v for v in vs if v is not None) for c, vs in want.items()}
    out = algebra.matmul(spark.createDataFrame(left, "i long, j int, v double"), spark.createDataFrame(right, "i long, j string, v double"))
    rows = out.collect()
    assert {(x.i, x.j): x.v for x in rows} == want and len(rows) == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan  # products are not moved
    whole = spark.createDataFrame([(1, 1, 3), (1, 2, 4)], "i long, j long, v long")
    assert got(Stream(algebra.matmul(whole, whole.selectExpr("j AS i", "i AS j", "v")))) == [(1, 1, 25)]
    apart = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0), (2, 3, 5.0)], "i long, j long, v double")
    assert got(Stream(algebra.matmul(apart, spark.createDataFrame([(1, 9, 2.0), (7, 9, 1.0)], "i long, j long, v double")))) == [(1, 9, 6.0)]


@pytest.mark.parametrize("block", [8192, 16])
def test_nearest_rows_and_probes_among_copies(spark, monkeypatch, block):
    import numpy as np

    from tessera.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "SCORE_BYTES", 1 << 16)
    x = np.random.default_rng(5).normal(size=(4100, 7))
    x[500:3500] = x[700]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in reversed(list(enumerate(x)))], "id long, v array<double>").coalesce(1)
    probes = rows.where("id % 50 = 0").selectExpr("id AS pid", "v AS w")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos, ps = (unit @ unit.T).round(12), range(0, len(x), 50)
    out = vectors.nearest_to_probes(rows, probes, "v", "w", 3).select("id", "pid").collect()
    assert {tuple(r) for r in out} == {(i, p) for p in ps for i in sorted(range(len(x)), key=lambda i: (-cos[i, p], i))[:3]} and len(out) == 3 * len(ps)
    out = vectors.nearest_probes(rows, probes, "v", "w", 2).select("id", "pid").collect()
    assert {tuple(r) for r in out} == {(i, p) for i in range(len(x)) for p in sorted(ps, key=lambda p: (-cos[i, p], p))[:2]} and len(out) == 2 * len(x)
    dim, blocks = vectors._blocks(probes.withColumnRenamed("pid", "__probe"), "w")
    assert vectors._found(rows, "v", dim, blocks, True, 3, None).count() == 3 * len(ps)  # one stretch, however many parts its similarities have


def test_similarities_in_memory_do_not_grow():
    import tracemalloc

    import numpy as np

    from tessera.operators import vectors

    r = np.random.default_rng(6)
    asking, answers = (vectors._unit(r.normal(size=(8192, 16))) for _ in range(2))
    tracemalloc.start()
    try:
        best = vectors._Best(len(asking), 5)
        best.add(np.arange(len(asking)), asking, np.arange(len(answers)), answers)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
    assert len(best.found()[0]) == 5 * len(asking)


def test_a_search_meets_lists_in_products(spark):
    import numpy as np

    from tessera.operators import clustering

    x = np.random.default_rng(7).normal(size=(900, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    probes = rows.where("id % 50 = 0").selectExpr("id AS pid", "v AS w")
    index = clustering.inverted_lists(rows, "v", 6)
    out = clustering.search(index, probes, "w", 4, 2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = ((unit[:, None] - index.centres[None]) ** 2).sum(2).argsort(1)
    assert {r.id: r["__list"] for r in index.rows.collect()} == dict(enumerate(far[:, 0]))
    want = {(i, p) for p in range(0, len(x), 50) for i in sorted((i for i in range(len(x)) if far[i, 0] in far[p, :2]), key=lambda i: -(unit[i] @ unit[p]))[:4]}
    found = out.select("id", "pid").collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (out, clustering._usable(rows, "v"))]
    assert not any("zip_with" in p or "transform(" in p for p in plans) and "__list" not in "".join(x for x in plans[0].splitlines() if "Join" in x)


def test_a_round_of_pagerank_reads_the_edges_once(spark, monkeypatch):
    from tessera.operators import algebra

    settled, settle = [], algebra.settle

    def noted(df, name="dataset"):
        files = df.inputFiles() if settled else []
        settled.append((name, df._jdf.queryExecution().optimizedPlan().toString(), files))
        return settle(df, name)

    monkeypatch.setattr(algebra, "settle", noted)
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 3), (4, 1), (3, 3), (4, 5)], "src long, dst long")
    out = {x.node: x["rank"] for x in algebra.pagerank(edges, rounds=4).collect()}
    pairs = sorted({tuple(r) for r in edges.collect()})
    rank = dict.fromkeys(range(1, 6), 0.2)
    for _ in range(4):
        given = {v: sum(rank[s] / sum(a == s for a, _ in pairs) for s, d in pairs if d == v) for v in rank}
        rank = {v: 0.15 / 5 + 0.85 * (given[v] + (1 - sum(given.values())) / 5) for v in rank}
    assert out == pytest.approx(rank)
    readers = [sum("/edges-" in f for f in {x.rpartition("/")[0] for x in files}) for _, _, files in settled]
    assert sum(readers) == 2 + 4  # out-degrees, nodes, rounds
    assert max(plan.count("Join") for _, plan, _ in settled) == 1  # out-degrees are not joined to edges again
    assert {x.node: x["rank"] for x in algebra.pagerank(edges, rounds=0).collect()} == dict.fromkeys(range(1, 6), 0.2)
