"""Projection, filter, join, aggregate, sort and set queries."""

from __future__ import annotations

from tessera.queries import query

query(
    """SELECT l_orderkey, l_linenumber, l_quantity
     FROM lineitem
     WHERE l_quantity >= 45 AND l_discount < 0.02""",
    "filter_expression",
)(
    lambda t: (lambda d: d.filter((d["l_quantity"] >= 45) & (d["l_discount"] < 0.02)).select(["l_orderkey", "l_linenumber", "l_quantity"]))(t.lineitem)
)
query(
    """SELECT l_orderkey, l_linenumber
     FROM lineitem
     WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-01-01' + interval '1' month AND l_discount BETWEEN 0.05 AND 0.07""",
    "filter_sql_dates",
)(
    lambda t: t.lineitem.filter_sql("l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-01-01' + interval '1' month and l_discount between 0.05 and 0.07")
        .select(["l_orderkey", "l_linenumber"])
)
query(
    """SELECT p_partkey, p_type
     FROM part
     WHERE (p_type LIKE 'PRO%' OR p_name LIKE '%1' OR NOT p_size IN (1, 2, 3)) AND p_size = 7""",
    "filter_sql_like_in",
)(
    lambda t: t.part.filter_sql("(p_type like 'PRO%' or p_name like '%1' or not p_size in (1, 2, 3)) and p_size == 7")
        .select(["p_partkey", "p_type"])
)
query(
    """SELECT p_partkey, p_brand
     FROM part
     WHERE regexp_matches(p_brand, '#[12]$') AND substring(p_type, 1, 3) = 'STA'""",
    "filter_sql_regexp",
)(
    lambda t: t.part.filter_sql("""regexp_matches("p_brand", '#[12]$') and substring(p_type, 1, 3) = 'STA'""")
        .select(["p_partkey", "p_brand"])
)
query(
    """SELECT o_orderkey
     FROM orders
     WHERE extract(year
     FROM o_orderdate) = 1997 AND extract(month
     FROM o_orderdate) = 3 AND CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 1000 ELSE o_totalprice > 200000 END""",
    "filter_sql_case_extract",
)(
    lambda t: t.orders.filter_sql("extract(year from o_orderdate) = 1997 and extract(month from o_orderdate) = 3 and case when o_orderstatus = 'F' then o_totalprice > 1000 else o_totalprice > 200000 end")
        .select(["o_orderkey"])
)
query("SELECT n_nationkey, n_regionkey FROM nation", "select_columns")(lambda t: t.nation.select({"n_regionkey", "n_nationkey"}))
query("SELECT r_name FROM region", "drop_columns")(lambda t: t.region.drop(["r_regionkey", "absent"]))
query(
    """SELECT n_nationkey AS id, n_name AS country
     FROM nation""",
    "rename_columns",
)(
    lambda t: t.nation.rename({"n_nationkey": "id", "n_name": "country"})
        .drop(["n_regionkey"])
)
query(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice*(1-l_discount),4) AS net, round(-l_tax,4) AS minus, l_linenumber % 3 AS third, round(power(l_quantity,2),4) AS squared
     FROM lineitem""",
    "with_columns_expression",
)(
    lambda t: t.lineitem.with_columns({"net": lambda x: (x["l_extendedprice"] * (1 - x["l_discount"])), "minus": lambda x: -x["l_tax"], "third": lambda x: x["l_linenumber"] % 3, "squared": lambda x: x["l_quantity"] ** 2})
        .transform_sql("l_orderkey as l_orderkey, l_linenumber as l_linenumber, round(net, 4) as net, round(minus, 4) as minus, third as third, round(squared, 4) as squared")
)
query(
    """SELECT o_orderkey, greatest(o_totalprice, 1000.0) AS floor_price, coalesce(o_orderstatus, 'none') AS status
     FROM orders""",
    "with_columns_sql",
)(
    lambda t: t.orders.with_columns_sql("greatest(o_totalprice, 1000.0) as floor_price, coalesce(o_orderstatus, 'none') as status")
        .select(["o_orderkey", "floor_price", "status"])
)
query(
    """SELECT o_orderkey, CASE WHEN o_totalprice < 5000 THEN 5000 WHEN o_totalprice > 90000 THEN 90000 ELSE o_totalprice END AS o_totalprice
     FROM orders""",
    "clip_columns",
)(
    lambda t: t.orders.clip({"o_totalprice": (5000.0, 90000.0)})
        .select(["o_orderkey", "o_totalprice"])
)

query(
    """SELECT o_orderkey, c_name
     FROM orders
     JOIN customer ON o_custkey = c_custkey""",
    "join_inner",
)(
    lambda t: t.orders.join(t.customer, left_on="o_custkey", right_on="c_custkey")
        .select(["o_orderkey", "c_name"])
)
query(
    """SELECT c_custkey, o_orderkey
     FROM customer
     LEFT
     JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000""",
    "join_left",
)(
    lambda t: t.customer.join(t.orders.filter_sql("o_totalprice > 100000"), left_on="c_custkey", right_on="o_custkey", how="left")
        .select(["c_custkey", "o_orderkey"])
)
query(
    """SELECT c_custkey
     FROM customer
     WHERE EXISTS (SELECT *
     FROM orders
     WHERE o_custkey = c_custkey AND o_totalprice > 100000)""",
    "join_semi",
)(
    lambda t: t.customer.join(t.orders.filter_sql("o_totalprice > 100000"), left_on="c_custkey", right_on="o_custkey", how="semi")
        .select(["c_custkey"])
)
query(
    """SELECT c_custkey
     FROM customer
     WHERE NOT EXISTS (SELECT *
     FROM orders
     WHERE o_custkey = c_custkey AND o_totalprice > 100000)""",
    "join_anti",
)(
    lambda t: t.customer.join(t.orders.filter_sql("o_totalprice > 100000"), left_on="c_custkey", right_on="o_custkey", how="anti")
        .select(["c_custkey"])
)
query(
    """SELECT c_custkey
     FROM customer""",
    "join_anti_empty_build",
)(
    lambda t: t.customer.join(t.orders.filter_sql("o_orderkey < 0"), left_on="c_custkey", right_on="o_custkey", how="anti")
        .select(["c_custkey"])
)
query(
    """SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_2
     FROM nation a
     JOIN nation b ON a.n_regionkey = b.n_regionkey""",
    "join_suffix",
)(
    lambda t: t.nation.join(t.nation.select(["n_regionkey", "n_name"]), on="n_regionkey")
        .select(["n_nationkey", "n_name", "n_name_2"])
)
query(
    """SELECT l_partkey, l_suppkey, count(*) AS n
     FROM lineitem
     JOIN (SELECT DISTINCT l_partkey, l_suppkey
     FROM lineitem
     WHERE l_quantity > 45) USING (l_partkey, l_suppkey)
     GROUP BY ALL""",
    "join_multi_key",
)(
    lambda t: t.lineitem.join(t.lineitem.filter_sql("l_quantity > 45").distinct(["l_partkey", "l_suppkey"]), on=["l_partkey", "l_suppkey"])
        .groupby(["l_partkey", "l_suppkey"])
        .agg_sql("count(*) as n")
)
query(
    """SELECT s_name, n_name, r_name
     FROM supplier
     JOIN nation ON s_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey""",
    "join_broadcast",
)(
    lambda t: t.supplier.join(t.nation, left_on="s_nationkey", right_on="n_nationkey", broadcast=True)
        .join(t.region, left_on="n_regionkey", right_on="r_regionkey", broadcast=True)
        .select(["s_name", "n_name", "r_name"])
)
query(
    """SELECT coalesce(s_nationkey, n_nationkey) AS s_nationkey, s_name, n_name
     FROM supplier
     FULL
     JOIN nation ON s_nationkey = n_nationkey""",
    "join_outer",
)(
    lambda t: t.supplier.join(t.nation, left_on="s_nationkey", right_on="n_nationkey", how="outer")
        .select(["s_nationkey", "s_name", "n_name"])
)

query(
    """SELECT l_returnflag, round(sum(l_quantity),2) AS l_quantity_sum, round(avg(l_quantity),6) AS l_quantity_avg, min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max, count(*) AS count
     FROM lineitem
     GROUP BY ALL""",
    "agg_dict",
)(
    lambda t: t.lineitem.groupby("l_returnflag")
        .agg({"l_quantity": ["sum", "avg"], "l_tax": ["min", "max"], "*": "count"})
        .transform_sql("l_returnflag as l_returnflag, round(l_quantity_sum, 2) as l_quantity_sum, round(l_quantity_avg, 6) as l_quantity_avg, l_tax_min as l_tax_min, l_tax_max as l_tax_max, `count` as `count`")
)
query(
    """SELECT round(sum(o_totalprice),2) AS total, count(*) AS n, round(sum(o_totalprice)/count(*),4) AS mean, round(stddev_samp(o_totalprice),4) AS sd, round(var_samp(o_totalprice)/1e6,4) AS var
     FROM orders""",
    "agg_sql_global",
)(
    lambda t: t.orders.agg_sql("round(sum(o_totalprice), 2) as total, count(*) as n, round(sum(o_totalprice) / count(*), 4) as mean, round(stddev(o_totalprice), 4) as sd, round(variance(o_totalprice) / 1e6, 4) as var")
)
query(
    """SELECT o_orderstatus, sum(CASE WHEN o_totalprice > 50000 THEN 1 ELSE 0 END)::BIGINT AS big, count(CASE WHEN o_totalprice > 50000 THEN 1 END) AS big2
     FROM orders
     GROUP BY ALL""",
    "agg_conditional",
)(
    lambda t: t.orders.groupby("o_orderstatus")
        .agg_sql("sum(case when o_totalprice > 50000 then 1 else 0 end) as big, count(case when o_totalprice > 50000 then 1 end) as big2")
)
query(
    """SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS keys
     FROM orders
     GROUP BY ALL""",
    "agg_array",
)(
    lambda t: t.orders.groupby("o_custkey")
        .agg_sql("array_join(array_sort(array_agg(o_orderkey)), ',') as keys")
)
query("SELECT count(DISTINCT o_custkey) AS o_custkey FROM orders", "count_distinct_global")(lambda t: t.orders.count_distinct("o_custkey"))
query(
    """SELECT o_orderstatus, count(DISTINCT o_custkey) AS o_custkey
     FROM orders
     GROUP BY ALL""",
    "count_distinct_grouped",
)(
    lambda t: t.orders.groupby("o_orderstatus")
        .count_distinct("o_custkey")
)
query("SELECT count(*) AS count FROM lineitem", "count_rows")(lambda t: t.lineitem.count(collect=False))
query(
    """SELECT max(l_quantity) AS l_quantity_max, max(l_tax) AS l_tax_max
     FROM lineitem""",
    "max_columns",
)(
    lambda t: t.lineitem.max(["l_quantity", "l_tax"], collect=False)
)
query("SELECT min(o_totalprice) AS o_totalprice_min FROM orders", "min_columns")(lambda t: t.orders.min("o_totalprice", collect=False))
query("SELECT sum(p_size)::BIGINT AS p_size_sum FROM part", "sum_columns")(lambda t: t.part.sum("p_size", collect=False))
query("SELECT avg(p_size) AS p_size_mean FROM part", "mean_columns")(lambda t: t.part.mean(["p_size"], collect=False))
query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "distinct_keys")(lambda t: t.lineitem.distinct(["l_returnflag", "l_linestatus"]))
query(
    """SELECT p_partkey, p_size, p_retailprice
     FROM part
     ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 25""",
    "top_k_rows",
)(
    lambda t: t.part.top_k(["p_size", "p_retailprice", "p_partkey"], 25, [True, False, False])
        .select(["p_partkey", "p_size", "p_retailprice"])
)
query("SELECT n_name, n_nationkey FROM nation ORDER BY n_name", "sort_rows")(lambda t: t.nation.sort("n_name").select(["n_name", "n_nationkey"]))
query(
    """SELECT s_suppkey AS k
     FROM supplier
     UNION ALL SELECT p_partkey
     FROM part""",
    "union_all",
)(
    lambda t: t.supplier.transform_sql("s_suppkey as k")
        .union(t.part.transform_sql("p_partkey as k"))
)
query(
    """SELECT o_custkey AS k
     FROM orders
     WHERE o_totalprice > 50000
     INTERSECT SELECT c_custkey
     FROM customer
     WHERE c_acctbal > 0""",
    "set_intersect",
)(
    lambda t: t.orders.filter_sql("o_totalprice > 50000")
        .transform_sql("o_custkey as k")
        .intersect(t.customer.filter_sql("c_acctbal > 0").transform_sql("c_custkey as k"))
)
query(
    """SELECT c_custkey AS k
     FROM customer
     EXCEPT SELECT o_custkey
     FROM orders""",
    "set_except",
)(
    lambda t: t.customer.transform_sql("c_custkey as k")
        .except_(t.orders.transform_sql("o_custkey as k"))
)
query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n
     FROM lineitem
     GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "cube_groups",
)(
    lambda t: t.lineitem.cube(["l_returnflag", "l_linestatus"])
        .agg_sql("count(*) as n")
)
query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n
     FROM lineitem
     GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "rollup_groups",
)(
    lambda t: t.lineitem.rollup(["l_returnflag", "l_linestatus"])
        .agg_sql("count(*) as n")
)
query("SELECT count(DISTINCT o_custkey) AS exact, true AS near FROM orders", "approximate_count_distinct")(  # within three times the given error
    lambda t: t.ctx.from_spark(t.orders.approximate_count_distinct("o_custkey", 0.02).df.crossJoin(t.orders.agg_sql("count(distinct o_custkey) as exact").df).selectExpr("exact", "abs(o_custkey - exact) <= 0.06 * exact AS near"))
)
query(
    """SELECT quantile_disc(l_quantity, 0.1)::DOUBLE AS l_quantity
     FROM lineitem
     UNION ALL SELECT quantile_disc(l_quantity, 0.5)::DOUBLE
     FROM lineitem
     UNION ALL SELECT quantile_disc(l_quantity, 0.9)::DOUBLE
     FROM lineitem""",
    "approximate_quantile",
)(
    lambda t: t.lineitem.approximate_quantile(["l_quantity"], [0.1, 0.5, 0.9])
)
query(
    """SELECT quantile_disc(l_quantity, 0.5)::DOUBLE AS l_quantity
     FROM lineitem""",
    "approximate_median",
)(
    lambda t: t.lineitem.approximate_median("l_quantity")
)
query(
    """SELECT round(a/1000,3) AS l_quantity, round(b,2) AS l_tax
     FROM (SELECT sum(l_quantity*l_quantity) AS a, sum(l_quantity*l_tax) AS b
     FROM lineitem
     UNION ALL SELECT sum(l_tax*l_quantity), sum(l_tax*l_tax)
     FROM lineitem)""",
    "gramian_matrix",
)(
    lambda t: t.lineitem.gramian(["l_quantity", "l_tax"])
        .transform_sql("round(l_quantity / 1000, 3) as l_quantity, round(l_tax, 2) as l_tax")
)
query(
    """SELECT round(a,3) AS l_quantity, round(b,3) AS l_tax
     FROM (SELECT sum((l_quantity-25)*(l_quantity-25))/1000 AS a, sum((l_quantity-25)*(l_tax-0.04)) AS b
     FROM lineitem
     UNION ALL SELECT sum((l_tax-0.04)*(l_quantity-25))/1000, sum((l_tax-0.04)*(l_tax-0.04))
     FROM lineitem)""",
    "gramian_demeaned",
)(
    lambda t: t.lineitem.gramian(["l_quantity", "l_tax"], [25.0, 0.04])
        .transform_sql("round(l_quantity / 1000, 3) as l_quantity, round(l_tax, 3) as l_tax")
)
query(
    """SELECT round(a,6) AS l_quantity, round(b,6) AS l_discount
     FROM (SELECT covar_pop(l_quantity,l_quantity) AS a, covar_pop(l_quantity,l_discount) AS b
     FROM lineitem
     UNION ALL SELECT covar_pop(l_discount,l_quantity), covar_pop(l_discount,l_discount)
     FROM lineitem)""",
    "covariance_matrix",
)(
    lambda t: t.lineitem.covariance(["l_quantity", "l_discount"])
        .transform_sql("round(l_quantity, 6) as l_quantity, round(l_discount, 6) as l_discount")
)
query(
    """SELECT l_returnflag, round(sum(l_quantity),2) AS q, count(*) AS n
     FROM lineitem
     GROUP BY ALL""",
    "transform_sql_grouped",
)(
    lambda t: t.lineitem.transform_sql("round(sum(l_quantity), 2) as q, count(*) as n", groupby=["l_returnflag"])
)
query(
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey
     ORDER BY o_orderdate, o_orderkey) AS place
     FROM orders""",
    "rank_rows",
)(
    lambda t: t.orders.with_columns_sql("row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place")
        .transform_sql("o_orderkey as o_orderkey, cast(place as bigint) as place")
)
