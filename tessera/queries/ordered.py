"""As-of and range joins, event-time windows, shifts, patterns, nearest neighbours and streams."""

from __future__ import annotations

import datetime as dt

from tessera import streaming
from tessera.operators import indicators
from tessera.operators.windows import HoppingWindow, OnCompletionTrigger, OnEventTrigger, SessionWindow, SlidingWindow, TumblingWindow
from tessera.plans import Stream
from tessera.queries import query

HOUR = dt.timedelta(hours=1)
_AGGS = {"n": "count(*)", "total": "round(sum(value), 4)"}


def _kind(t, kind, value):
    return t.ctx.read_sorted_parquet(f"{t.sf_dir}/events.parquet", "ts").filter_sql(f"event_type = '{kind}'").rename({"value": value}).select(["ts", "user_id", value, "event_id"])


_ASOF = """SELECT c.ts, c.user_id, c.price, c.event_id, e.bid, e.event_id AS event_id_2 FROM (SELECT ts, user_id, value AS price, event_id FROM events WHERE event_type = 'click') c
 ASOF LEFT JOIN (SELECT ts, user_id, value AS bid, event_id FROM events WHERE event_type = 'error') e ON c.user_id = e.user_id AND c.ts >= e.ts"""
query(_ASOF, "asof_join")(lambda t: _kind(t, "click", "price").join_asof(_kind(t, "error", "bid"), on="ts", by="user_id"))
query(_ASOF, "asof_join_bucketed")(lambda t: _kind(t, "click", "price").join_asof(_kind(t, "error", "bid"), on="ts", by="user_id", bucket=dt.timedelta(days=2)))
query(
    f"""SELECT round(sum(bid), 4) AS bids, count(bid) AS matched, count(*) AS n
     FROM ({_ASOF})""",
    "asof_join_sum",
)(
    lambda t: _kind(t, "click", "price")
        .join_asof(_kind(t, "error", "bid"), on="ts", by="user_id")
        .agg_sql("round(sum(bid), 4) as bids, count(bid) as matched, count(*) as n")
)
query("""SELECT c.event_id, e.event_id AS event_id_2 FROM events c JOIN events e ON c.user_id = e.user_id AND e.ts <= c.ts AND e.ts >= c.ts - interval 1 hour

 WHERE c.event_type = 'click' AND e.event_type = 'error'""", "range_join")(lambda t: _kind(t, "click", "price").join_range(_kind(t, "error", "bid"), HOUR, on="ts", by="user_id").select(["event_id", "event_id_2"]))


def _win(window, trigger):
    return lambda t: t.ctx.read_sorted_parquet(f"{t.sf_dir}/events.parquet", "ts").windowed_transform(window, trigger)


query(
    """SELECT time_bucket(interval 1 hour, ts) AS ts, user_id, count(*) AS n, round(sum(value),4) AS total
     FROM events
     GROUP BY ALL""",
    "window_tumbling",
)(_win(TumblingWindow("ts", "user_id", HOUR, aggregation_dict=_AGGS), OnCompletionTrigger()))
query(
    """SELECT b AS ts, user_id, count(*) AS n, round(sum(value),4) AS total
     FROM (SELECT *, time_bucket(interval 30 minute, ts) - k * interval 30 minute AS b
     FROM events, range(2) r(k))
     WHERE ts < b + interval 1 hour
     GROUP BY ALL""",
    "window_hopping",
)(_win(HoppingWindow("ts", "user_id", HOUR / 2, HOUR, aggregation_dict=_AGGS), OnCompletionTrigger()))
query(
    """SELECT ts, user_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total
     FROM events
     WINDOW w AS (PARTITION BY user_id, time_bucket(interval 1 hour, ts)
     ORDER BY ts RANGE UNBOUNDED PRECEDING)""",
    "window_tumbling_event",
)(_win(TumblingWindow("ts", "user_id", HOUR, aggregation_dict=_AGGS), OnEventTrigger()))
query(
    """SELECT ts, user_id, count(*) OVER w AS n, round(avg(value) OVER w, 4) AS mean
     FROM events
     WINDOW w AS (PARTITION BY user_id
     ORDER BY ts RANGE BETWEEN interval '59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)""",
    "window_sliding",
)(_win(SlidingWindow("ts", "user_id", HOUR, aggregation_dict={"n": "count(*)", "mean": "round(avg(value), 4)"}), OnEventTrigger()))
_S = "SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > interval 6 hour THEN 1 ELSE 0 END AS f FROM events)"
query(
    f"""SELECT min(ts) AS ts, user_id, count(*) AS n, round(sum(value),4) AS total
     FROM ({_S})
     GROUP BY user_id, s""",
    "window_session",
)(_win(SessionWindow("ts", "user_id", 6 * HOUR, aggregation_dict=_AGGS), OnCompletionTrigger()))
query(
    f"""SELECT ts, user_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total
     FROM ({_S})
     WINDOW w AS (PARTITION BY user_id, s
     ORDER BY ts RANGE UNBOUNDED PRECEDING)""",
    "window_session_event",
)(_win(SessionWindow("ts", "user_id", 6 * HOUR, aggregation_dict=_AGGS), OnEventTrigger()))
query(
    """SELECT e // 100 * 100 - k * 100 AS event_id, event_type, count(*) AS n
     FROM (SELECT event_id AS e, event_type, k
     FROM events, range(3) r(k))
     WHERE e < e // 100 * 100 - k * 100 + 250
     GROUP BY ALL""",
    "window_hopping_integer",
)(
    lambda t: t.events.ordered("event_id")
        .windowed_transform(HoppingWindow("event_id", "event_type", 100, 250, aggregation_dict={"n": "count(*)"}), OnCompletionTrigger())
)
query(
    """SELECT event_id, ts, user_id, lag(value, 2) OVER w AS value, lag(event_type, 2) OVER w AS event_type
     FROM events
     WINDOW w AS (PARTITION BY user_id
     ORDER BY ts)""",
    "shift_rows",
)(
    lambda t: t.ctx.from_spark(t.events.ordered("ts").select(["ts", "user_id", "value", "event_type"]).ordered("ts").shift(2, by="user_id").df)
        .join(t.events.select(["ts", "user_id", "event_id"]), on=["ts", "user_id"])
)
query("""WITH v AS (SELECT user_id, ts AS a FROM events WHERE event_type = 'view'),
 b AS (SELECT v.user_id, a, min(ts) AS b FROM v JOIN events e ON e.user_id = v.user_id AND e.event_type = 'click' AND e.ts > a GROUP BY ALL),
 c AS (SELECT b.user_id, a, b, min(ts) AS c
 FROM b
 JOIN events e ON e.user_id = b.user_id AND e.event_type = 'purchase' AND e.ts > b
 WHERE b - a <= interval 24 hour
 GROUP BY ALL)
 SELECT user_id, a, b, c FROM c WHERE c - b <= interval 48 hour""", "cep_pattern")(
    lambda t: t.events.ordered("ts")
        .pattern_recognize([("a", "event_type = 'view'"), ("b", "event_type = 'click'"), ("c", "event_type = 'purchase'")], [24 * HOUR, 48 * HOUR], "user_id")
)
query(
    """SELECT user_id, event_id, ts, value, max(ts) OVER (PARTITION BY user_id
     ORDER BY event_id) AS processing_time
     FROM events""",
    "processing_time",
)(
    lambda t: Stream(streaming.processing_time(t.events.select(["user_id", "event_id", "ts", "value"]).df, "user_id", "event_id", "ts"))
)
query(
    """SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS sma_5
     FROM events
     WINDOW w AS (PARTITION BY user_id
     ORDER BY ts ROWS 4 PRECEDING)""",
    "indicator_sma",
)(
    lambda t: Stream(indicators.sma(t.events.df, "user_id", "ts", "value", 5).selectExpr("event_id", "round(sma_5, 6) AS sma_5"))
)
query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events),
 m AS (SELECT event_id, user_id, r, value AS fast, value AS slow FROM e WHERE r = 1
  UNION ALL SELECT e.event_id, e.user_id, e.r, m.fast + (e.value - m.fast) * 2 / 13, m.slow + (e.value - m.slow) * 2 / 27 FROM m JOIN e ON e.user_id = m.user_id AND e.r = m.r + 1)
 SELECT event_id, round(fast - slow, 6) AS macd FROM m""",
    "indicator_macd",
)(lambda t: Stream(indicators.macd(t.events.select(["event_id", "user_id", "ts", "value"]).df, "user_id", "ts", "value").selectExpr("event_id", "round(macd, 6) AS macd")))
query(
    """SELECT event_id, CASE WHEN count(value) OVER w = 20 THEN round(avg(value) OVER w - 2 * stddev_samp(value) OVER w, 5) END AS low
     FROM events
     WINDOW w AS (PARTITION BY user_id
     ORDER BY ts ROWS 19 PRECEDING)""",
    "indicator_bollinger",
)(
    lambda t: Stream(indicators.bollinger(t.events.df, "user_id", "ts", "value").selectExpr("event_id", "round(boll_low, 5) AS low"))
)
query(
    """WITH d AS (SELECT event_id, user_id, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events),
 g AS (SELECT event_id, count(step) OVER w AS n, avg(greatest(step, 0.0)) FILTER (step IS NOT NULL) OVER w AS up, avg(greatest(-step, 0.0)) FILTER (step IS NOT NULL) OVER w AS down
  FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS 13 PRECEDING))
 SELECT event_id, CASE WHEN n = 14 AND up + down > 0 THEN round(100 * up / (up + down), 6) END AS rsi FROM g""",
    "indicator_rsi",
)(lambda t: Stream(indicators.rsi(t.events.select(["event_id", "user_id", "ts", "value"]).df, "user_id", "ts", "value").selectExpr("event_id", "round(rsi_14, 6) AS rsi")))

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[])"


def _nearest_sql(k: int, of: str, ties: str, where: str = "true") -> str:
    """The k nearest of each `of`, probes being every fiftieth row."""
    ranked = f"row_number() OVER (PARTITION BY {of}.vec_id ORDER BY {_COS} DESC, {ties}.vec_id) AS r"
    return f"SELECT vec_id, probe_id FROM (SELECT e.vec_id, p.vec_id AS probe_id, {ranked} FROM embeddings e, embeddings p WHERE p.vec_id % 50 = 0 AND {where}) WHERE r <= {k}"


def _probes(t):
    """Every fiftieth row, so that the probes grow with the table."""
    return t.embeddings.filter_sql("vec_id % 50 = 0").select(["vec_id", "embedding"]).rename({"vec_id": "probe_id", "embedding": "probe_vec"})


def _nearest(t, rows, **options):
    found = rows.select(["vec_id", "embedding"]).vector_nn_join(_probes(t), vec_column_left="embedding", vec_column_right="probe_vec", **options)
    return found.select(["vec_id", "probe_id"])


query(_nearest_sql(5, "p", "e"), "knn_of_probes")(lambda t: _nearest(t, t.embeddings, k=5))
query(_nearest_sql(2, "e", "p"), "knn_of_rows")(lambda t: _nearest(t, t.embeddings, k=2, probe_side="left"))
query(_nearest_sql(3, "p", "e", "e.label < 3"), "knn_filtered")(lambda t: _nearest(t, t.embeddings.filter_sql("label < 3"), k=3))


@query(f"SELECT e.vec_id, p.vec_id AS probe_id FROM embeddings e, embeddings p WHERE p.vec_id % 50 = 0 AND {_COS} >= 0.3")
def vector_range(t):
    rows = t.embeddings.select(["vec_id", "embedding"])
    return rows.vector_range_join(_probes(t), 0.3, vec_column_left="embedding", vec_column_right="probe_vec").select(["vec_id", "probe_id"])


@query(_nearest_sql(5, "p", "e"))
def ivf_search(t):
    """All eight lists are looked at, so that the result is exact; tests measure the recall of fewer."""
    index = t.embeddings.select(["vec_id", "embedding"]).inverted_lists("embedding", 8)
    return Stream.search_lists(index, _probes(t), "probe_vec", 5, 8).select(["vec_id", "probe_id"])


def _stream(t):
    batch = t.events.df
    return t.spark.readStream.schema(batch.schema).parquet(f"{t.sf_dir}/events.parque[t]")


query(
    """SELECT time_bucket(interval 1 day, ts) AS ts, event_type, count(*) AS n, round(sum(value),4) AS total
     FROM events
     WHERE time_bucket(interval 1 day, ts) + interval 1 day <= (SELECT max(ts) - interval 1 hour
     FROM events)
     GROUP BY ALL""",
    "stream_tumbling",
)(
    lambda t: Stream(streaming.drained(streaming.windowed(_stream(t), TumblingWindow("ts", "event_type", dt.timedelta(days=1), aggregation_dict=_AGGS), OnCompletionTrigger(HOUR))))
)


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_stateful(t):
    import pandas as pd

    def step(state, key, frame):
        n, total = state[0] + len(frame), state[1] + float(frame["value"].sum())
        return (n, total), pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    return Stream(streaming.drained(streaming.stateful(_stream(t), ["user_id"], lambda: (0, 0.0), step, "user_id long, n long, total double")))
