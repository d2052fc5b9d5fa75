"""Scalar functions of the expression namespaces and of SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import algebra
from tessera.plans import Stream
from tessera.queries import query


def _events(make):
    return lambda t: t.events.with_columns(make).select(["event_id", *make])


query(
    """SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, length(c_name) AS n, c_name[1:2] AS two
     FROM customer""",
    "str_case_length",
)(
    lambda t: t.customer.with_columns({"up": lambda x: x["c_name"].str.to_uppercase(), "low": lambda x: x["c_name"].str.to_lowercase(), "n": lambda x: x["c_name"].str.length().cast("long"), "two": lambda x: x["c_name"].str.slice(0, 2)})
        .select(["c_custkey", "up", "low", "n", "two"])
)
query(
    """SELECT p_partkey, contains(p_name, '1') AS has, starts_with(p_type, 'PRO') AS begins, suffix(p_brand, '2') AS ends
     FROM part""",
    "str_contains",
)(
    lambda t: t.part.with_columns({"has": lambda x: x["p_name"].str.contains("1"), "begins": lambda x: x["p_type"].str.starts_with("PRO"), "ends": lambda x: x["p_brand"].str.ends_with("2")})
        .select(["p_partkey", "has", "begins", "ends"])
)
query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", "str_json_extract")(_events({"k": lambda x: x["props"].str.json_extract("k")}))
query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S')::TIMESTAMP AS at, strftime(ts, '%Y-%m-%d')::DATE AS day
     FROM events""",
    "str_strptime",
)(
    lambda t: t.events.with_columns({"a": lambda x: x["ts"].dt.strftime()})
        .with_columns({"at": lambda x: x["a"].str.slice(0, 19).str.strptime("datetime"), "day": lambda x: x["a"].str.slice(0, 10).str.strptime("date")})
        .select(["event_id", "at", "day"])
)
query("SELECT count(DISTINCT c_name) AS names, count(DISTINCT c_name) AS hashes, count(*) AS n FROM customer", "str_hash")(  # equal hashes where and only where names are equal
    lambda t: t.customer.with_columns({"h": lambda x: x["c_name"].str.hash()})
        .agg_sql("count(distinct c_name) as names, count(distinct h) as hashes, count(h) as n")
)
query(
    """SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, dayofweek(ts) AS wd, week(ts) AS w
     FROM events""",
    "dt_parts",
)(
    _events({k: (lambda f: lambda x: getattr(x["ts"].dt, f)().cast("long"))(f) for k, f in (("y", "year"), ("m", "month"), ("d", "day"), ("h", "hour"), ("mi", "minute"), ("s", "second"), ("wd", "weekday"), ("w", "week"))})
)
query(
    """SELECT event_id, millisecond(ts) AS ms, microsecond(ts) AS us
     FROM events""",
    "dt_fractions",
)(_events({"ms": lambda x: x["ts"].dt.millisecond(), "us": lambda x: x["ts"].dt.microsecond()}))
query(
    """SELECT event_id, ts + interval 3 hour AS a, ts - interval 2 day AS b, ts + interval 1 month AS c, ts + interval 1 year AS d, ts + interval 250 millisecond AS e
     FROM events""",
    "dt_offset_by",
)(_events({"a": lambda x: x["ts"].dt.offset_by(3, "h"), "b": lambda x: x["ts"].dt.offset_by(-2, "d"), "c": lambda x: x["ts"].dt.offset_by(1, "M"), "d": lambda x: x["ts"].dt.offset_by(1, "y"), "e": lambda x: x["ts"].dt.offset_by(250, "ms")}))
query("SELECT event_id, ts::VARCHAR AS text FROM events", "dt_strftime")(_events({"text": lambda x: x["ts"].dt.strftime()}))
query(
    """SELECT o_orderkey, abs(o_totalprice) AS a, round(sqrt(o_totalprice),6) AS b, round(ln(o_totalprice+1),6) AS c, floor(o_totalprice)::BIGINT AS d
     FROM orders""",
    "sql_math",
)(
    lambda t: t.orders.transform_sql("o_orderkey as o_orderkey, abs(o_totalprice) as a, round(sqrt(o_totalprice), 6) as b, round(ln(o_totalprice + 1), 6) as c, floor(o_totalprice) as d")
)


@query("""SELECT word, count(*) AS n
 FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r\\x0B\\f]+')) AS word
 FROM documents)
 WHERE word <> ''
 GROUP BY ALL""")
def word_count(t):
    """The words are split where they are exploded: as a column they would be split again for the filter on empty lists that is inferred."""
    d = t.documents.select(["text"]).spread()
    return Stream(d.df.select(F.explode(d["text"].str.tokens().column).alias("word"))).groupby("word").agg_sql("count(*) as n")


@query("""SELECT o_custkey, len(list_distinct(list(o_orderpriority))) AS kinds, list_contains(list(o_orderpriority), '1-URGENT') AS urgent
 FROM orders
 GROUP BY ALL""")
def array_functions(t):
    d = t.orders.groupby("o_custkey").agg_sql("array_agg(o_orderpriority) as all_p")
    return d.transform_sql("o_custkey as o_custkey, cast(size(list_distinct(all_p)) as bigint) as kinds, list_contains(all_p, '1-URGENT') as urgent")


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS i, l_linenumber AS j, 1.0::DOUBLE AS v FROM lineitem)
 SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m a JOIN (SELECT j AS i, i AS j, v FROM m) b ON a.j = b.i GROUP BY ALL""")
def sparse_matmul(t):
    m = t.lineitem.distinct(["l_suppkey", "l_linenumber"]).df.selectExpr("l_suppkey AS i", "cast(l_linenumber AS bigint) AS j", "1.0D AS v")
    return Stream(algebra.matmul(m, m.selectExpr("j AS i", "i AS j", "v")))


def _pagerank_sql(rounds: int) -> str:
    """The same sums, a common table expression a round."""
    steps = [
        """e AS (SELECT DISTINCT l_suppkey AS src, -1 - l_partkey AS dst FROM lineitem),
 d AS (SELECT src, count(*) AS d FROM e GROUP BY src),
 v AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
 k AS (SELECT count(*) AS n FROM v),
 r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, k)"""
    ]
    for i in range(rounds):
        steps.append(f"""
 g{i} AS (SELECT dst, sum(rank / d) AS got FROM e JOIN d USING (src) JOIN r{i} ON r{i}.node = e.src GROUP BY dst),
 r{i + 1} AS (SELECT node, 0.15 / n + 0.85 * (coalesce(got, 0) + (1.0 - (SELECT sum(got) FROM g{i})) / n) AS rank FROM k, v LEFT JOIN g{i} ON dst = node)""")
    return f"WITH {','.join(steps)}\n SELECT node, round(rank, 12) AS rank FROM r{rounds}"


@query(_pagerank_sql(5))
def pagerank(t):
    """Suppliers point to their parts.  Part p is node -1 - p, since suppliers and parts are numbered alike."""
    edges = t.lineitem.df.selectExpr("l_suppkey AS src", "-1 - l_partkey AS dst")
    return Stream(algebra.pagerank(edges, rounds=5).selectExpr("node", "round(rank, 12) AS rank"))
