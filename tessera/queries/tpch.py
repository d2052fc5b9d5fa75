"""TPC-H queries, adapted to the columns at hand (dates are timestamps; no comments, phones or ship modes)."""

from __future__ import annotations

from tessera.queries import query


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity),2) AS sum_qty, round(sum(l_extendedprice),2) AS sum_base_price,
 round(sum(l_extendedprice*(1-l_discount)),4) AS sum_disc_price, round(sum(l_extendedprice*(1-l_discount)*(1+l_tax)),2) AS sum_charge,
 round(avg(l_quantity),4) AS avg_qty, round(avg(l_extendedprice),4) AS avg_price, round(avg(l_discount),4) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= date '1998-12-01' - interval '90' day GROUP BY ALL""")
def q1(t):
    d = t.lineitem.filter_sql("l_shipdate <= date '1998-12-01' - interval '90' day")
    return d.groupby(["l_returnflag", "l_linestatus"], orderby=["l_returnflag", "l_linestatus"]).agg_sql(
        """round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
        round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc_price,
        round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
        round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price,
        round(avg(l_discount), 4) as avg_disc, count(*) as count_order"""
    )


@query("""WITH e AS (SELECT s.*, n_name
 FROM supplier s
 JOIN nation ON s_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey
 WHERE r_name = 'EUROPE'),
 ps AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY ALL),
 d AS (SELECT * FROM ps JOIN e ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size = 15),
 m AS (SELECT p_partkey AS k, min(cost) AS least FROM d GROUP BY ALL)
 SELECT s_name, n_name, p_partkey, round(s_acctbal, 2) AS s_acctbal FROM d JOIN m ON p_partkey = k AND cost = least""")
def q2(t):
    europe = t.nation.join(t.region.filter_sql("r_name = 'EUROPE'"), left_on="n_regionkey", right_on="r_regionkey").select(["n_nationkey", "n_name"])
    suppliers = t.supplier.join(europe, left_on="s_nationkey", right_on="n_nationkey")
    offers = t.lineitem.groupby(["l_partkey", "l_suppkey"]).agg_sql("min(l_extendedprice / l_quantity) as cost")
    d = offers.join(suppliers, left_on="l_suppkey", right_on="s_suppkey").join(t.part.filter_sql("p_size = 15"), left_on="l_partkey", right_on="p_partkey")
    least = d.groupby("l_partkey").agg({"cost": "min"})
    d = d.join(least, left_on=["l_partkey", "cost"], right_on=["l_partkey", "cost_min"]).rename({"l_partkey": "p_partkey"})
    return d.transform_sql("s_name as s_name, n_name as n_name, p_partkey as p_partkey, round(s_acctbal, 2) as s_acctbal")


@query("""SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice*(1-l_discount)),4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
 JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < date '1998-03-15' AND l_shipdate > date '1998-03-15'
 GROUP BY ALL ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
def q3(t):
    d = t.lineitem.filter_sql("l_shipdate > date '1998-03-15'").join(t.orders.filter_sql("o_orderdate < date '1998-03-15'"), left_on="l_orderkey", right_on="o_orderkey")
    d = d.join(t.customer.filter_sql("c_mktsegment = 'BUILDING'"), left_on="o_custkey", right_on="c_custkey")
    d = d.groupby(["l_orderkey", "o_orderdate"]).agg_sql("round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue")
    return d.top_k(["revenue", "o_orderdate", "l_orderkey"], 10, descending=[True, False, False])


@query("""SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= date '1996-07-01' AND o_orderdate < date '1996-10-01'
 AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount < 0.05) GROUP BY ALL""")
def q4(t):
    d = t.orders.filter_sql("o_orderdate >= date '1996-07-01' and o_orderdate < date '1996-10-01'")
    d = d.join(t.lineitem.filter_sql("l_discount < 0.05"), left_on="o_orderkey", right_on="l_orderkey", how="semi")
    return d.groupby("o_orderpriority", orderby="o_orderpriority").agg_sql("count(*) as order_count")


@query("""SELECT n_name, round(sum(l_extendedprice*(1-l_discount)),4) AS revenue
 FROM customer
 JOIN orders ON c_custkey = o_custkey
 JOIN lineitem ON l_orderkey = o_orderkey
 JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE r_name = 'ASIA' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1997-01-01' GROUP BY ALL""")
def q5(t):
    nations = t.nation.join(t.region.filter_sql("r_name = 'ASIA'"), left_on="n_regionkey", right_on="r_regionkey").select(["n_nationkey", "n_name"])
    suppliers = t.supplier.join(nations, left_on="s_nationkey", right_on="n_nationkey")
    d = t.lineitem.join(t.orders.filter_sql("o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01'"), left_on="l_orderkey", right_on="o_orderkey")
    d = d.join(suppliers, left_on="l_suppkey", right_on="s_suppkey").join(t.customer, left_on=["o_custkey", "s_nationkey"], right_on=["c_custkey", "c_nationkey"])
    return d.groupby("n_name").agg_sql("round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue")


@query("""SELECT round(sum(l_extendedprice*l_discount),4) AS revenue
 FROM lineitem
 WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def q6(t):
    d = t.lineitem.filter_sql("l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-01-01' + interval '1' year and l_discount between 0.05 and 0.07 and l_quantity < 24")
    return d.agg_sql("round(sum(l_extendedprice * l_discount), 4) as revenue")


@query("""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate)::BIGINT AS l_year, round(sum(l_extendedprice*(1-l_discount)),4) AS revenue

 FROM supplier
 JOIN lineitem ON s_suppkey = l_suppkey
 JOIN orders ON o_orderkey = l_orderkey
 JOIN customer ON c_custkey = o_custkey
 JOIN nation n1 ON s_nationkey = n1.n_nationkey
 JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
 AND l_shipdate BETWEEN date '1995-01-01' AND date '1996-12-31' GROUP BY ALL""")
def q7(t):
    two = t.nation.filter_sql("n_name in ('NATION_1', 'NATION_2')").select(["n_nationkey", "n_name"])
    d = t.lineitem.filter_sql("l_shipdate between date '1995-01-01' and date '1996-12-31'").join(t.orders, left_on="l_orderkey", right_on="o_orderkey")
    d = d.join(t.supplier.join(two, left_on="s_nationkey", right_on="n_nationkey").rename({"n_name": "supp_nation"}), left_on="l_suppkey", right_on="s_suppkey")
    d = d.join(t.customer.join(two, left_on="c_nationkey", right_on="n_nationkey").rename({"n_name": "cust_nation"}), left_on="o_custkey", right_on="c_custkey")
    d = d.filter_sql("supp_nation <> cust_nation").with_columns({"l_year": lambda x: x["l_shipdate"].dt.year().cast("long")})
    return d.groupby(["supp_nation", "cust_nation", "l_year"]).agg_sql("round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue")


@query("""SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END)/sum(volume),6) AS mkt_share
 FROM (SELECT year(o_orderdate)::BIGINT AS o_year,
 l_extendedprice*(1-l_discount) AS volume, n2.n_name AS nation FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
 WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') GROUP BY ALL""")
def q8(t):
    american = t.nation.join(t.region.filter_sql("r_name = 'AMERICA'"), left_on="n_regionkey", right_on="r_regionkey").select(["n_nationkey"])
    d = t.lineitem.join(t.part.filter_sql("p_type = 'ECONOMY'"), left_on="l_partkey", right_on="p_partkey").join(t.orders, left_on="l_orderkey", right_on="o_orderkey")
    d = d.join(t.customer.join(american, left_on="c_nationkey", right_on="n_nationkey"), left_on="o_custkey", right_on="c_custkey")
    d = d.join(t.supplier, left_on="l_suppkey", right_on="s_suppkey").join(t.nation, left_on="s_nationkey", right_on="n_nationkey")
    d = d.with_columns({"o_year": lambda x: x["o_orderdate"].dt.year().cast("long"), "volume": lambda x: x["l_extendedprice"] * (1 - x["l_discount"])})
    return d.groupby("o_year").agg_sql("round(sum(case when n_name = 'NATION_3' then volume else 0 end) / sum(volume), 6) as mkt_share")


@query("""SELECT n_name AS nation, year(o_orderdate)::BIGINT AS o_year, round(sum(l_extendedprice*(1-l_discount)),4) AS amount
 FROM lineitem
 JOIN part ON p_partkey = l_partkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_type LIKE '%PROMO%' GROUP BY ALL""")
def q9(t):
    d = t.lineitem.join(t.part.filter(t.part["p_type"].str.contains("PROMO")), left_on="l_partkey", right_on="p_partkey").join(t.orders, left_on="l_orderkey", right_on="o_orderkey")
    d = d.join(t.supplier, left_on="l_suppkey", right_on="s_suppkey").join(t.nation, left_on="s_nationkey", right_on="n_nationkey").rename({"n_name": "nation"})
    d = d.with_columns({"o_year": lambda x: x["o_orderdate"].dt.year().cast("long")})
    return d.groupby(["nation", "o_year"]).agg_sql("round(sum(l_extendedprice * (1 - l_discount)), 4) as amount")


@query("""SELECT c_custkey, c_name, round(sum(l_extendedprice*(1-l_discount)),4) AS revenue, round(c_acctbal,2) AS c_acctbal, n_name
 FROM customer
 JOIN orders ON c_custkey = o_custkey
 JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= date '1996-01-01' AND o_orderdate < date '1996-04-01' AND l_returnflag = 'R'
 GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
def q10(t):
    d = t.lineitem.filter_sql("l_returnflag = 'R'").join(t.orders.filter_sql("o_orderdate >= date '1996-01-01' and o_orderdate < date '1996-04-01'"), left_on="l_orderkey", right_on="o_orderkey")
    d = d.join(t.customer, left_on="o_custkey", right_on="c_custkey").join(t.nation, left_on="c_nationkey", right_on="n_nationkey").rename({"o_custkey": "c_custkey"})
    d = d.groupby(["c_custkey", "c_name", "c_acctbal", "n_name"]).agg_sql("round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue")
    d = d.top_k(["revenue", "c_custkey"], 20, descending=[True, False])
    return d.transform_sql("c_custkey as c_custkey, c_name as c_name, revenue as revenue, round(c_acctbal, 2) as c_acctbal, n_name as n_name")


@query("""WITH v AS (SELECT l_partkey, round(sum(l_extendedprice),2) AS value
 FROM lineitem
 JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey
 WHERE n_name = 'NATION_5'
 GROUP BY ALL)
 SELECT l_partkey, value FROM v WHERE value > (SELECT sum(value) * 0.002 FROM v)""")
def q11(t):
    own = t.supplier.join(t.nation.filter_sql("n_name = 'NATION_5'"), left_on="s_nationkey", right_on="n_nationkey")
    v = t.lineitem.join(own, left_on="l_suppkey", right_on="s_suppkey").groupby("l_partkey").agg_sql("round(sum(l_extendedprice), 2) as value")
    return t.ctx.sql("SELECT l_partkey, value FROM {v} WHERE value > (SELECT sum(value) * 0.002 FROM {v})", v=v)


@query("""SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high_count, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low_count
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' GROUP BY ALL""")
def q12(t):
    d = t.lineitem.filter_sql("l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01'").join(t.orders, left_on="l_orderkey", right_on="o_orderkey")
    d = d.with_columns({"high": lambda x: x["o_orderpriority"].isin("1-URGENT", "2-HIGH")}).with_columns({"low": lambda x: ~x["high"]})
    return d.groupby("l_linestatus").agg({"high": "sum", "low": "sum"}).rename({"high_sum": "high_count", "low_sum": "low_count"})


@query("""SELECT c_count, count(*) AS custdist
 FROM (SELECT c_custkey, count(o_orderkey) AS c_count
 FROM customer
 LEFT
 JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT'
 GROUP BY ALL)
 GROUP BY ALL""")
def q13(t):
    d = t.customer.join(t.orders.filter_sql("o_orderpriority <> '1-URGENT'"), left_on="c_custkey", right_on="o_custkey", how="left")
    return d.groupby("c_custkey").agg_sql("count(o_orderkey) as c_count").groupby("c_count").agg_sql("count(*) as custdist")


@query("""SELECT round(100*sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice*(1-l_discount) ELSE 0 END)/sum(l_extendedprice*(1-l_discount)),6) AS promo_revenue
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= date '1996-09-01' AND l_shipdate < date '1996-10-01'""")
def q14(t):
    d = t.lineitem.filter_sql("l_shipdate >= date '1996-09-01' and l_shipdate < date '1996-10-01'").join(t.part, left_on="l_partkey", right_on="p_partkey")
    return d.agg_sql("round(100 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo_revenue")


@query("""WITH r AS (SELECT l_suppkey, round(sum(l_extendedprice*(1-l_discount)),4) AS total_revenue
 FROM lineitem
 WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-04-01'
 GROUP BY ALL)
 SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM r)""")
def q15(t):
    r = t.lineitem.filter_sql("l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01'").groupby("l_suppkey").agg_sql("round(sum(l_extendedprice * (1 - l_discount)), 4) as total_revenue")
    best = r.agg({"total_revenue": "max"})
    d = r.join(best, left_on="total_revenue", right_on="total_revenue_max")
    return t.supplier.join(d, left_on="s_suppkey", right_on="l_suppkey").select(["s_suppkey", "s_name", "total_revenue"])


@query("""SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt
 FROM lineitem
 JOIN part ON p_partkey = l_partkey
 WHERE p_brand <> 'Brand#1' AND p_size IN (1, 5, 9, 14, 19, 23, 36, 45)
 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""")
def q16(t):
    d = t.lineitem.select(["l_partkey", "l_suppkey"]).join(t.part.filter_sql("p_brand <> 'Brand#1' and p_size in (1, 5, 9, 14, 19, 23, 36, 45)"), left_on="l_partkey", right_on="p_partkey")
    d = d.join(t.supplier.filter_sql("s_acctbal < 0"), left_on="l_suppkey", right_on="s_suppkey", how="anti")
    return d.groupby(["p_brand", "p_type", "p_size"]).count_distinct("l_suppkey").rename({"l_suppkey": "supplier_cnt"})


@query("""SELECT round(sum(l_extendedprice)/7.0,2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#3'
 AND l_quantity < (SELECT 0.5*avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""")
def q17(t):
    d = t.lineitem.join(t.part.filter_sql("p_brand = 'Brand#3'"), left_on="l_partkey", right_on="p_partkey")
    d = d.join(d.groupby("l_partkey").agg_sql("0.5 * avg(l_quantity) as bar"), on="l_partkey")
    return d.filter_sql("l_quantity < bar").agg_sql("round(sum(l_extendedprice) / 7.0, 2) as avg_yearly")


@query("""SELECT c_name, c_custkey, o_orderkey, o_orderdate, round(o_totalprice,2) AS o_totalprice, round(sum(l_quantity),2) AS sum_qty
 FROM customer
 JOIN orders ON c_custkey = o_custkey
 JOIN lineitem ON o_orderkey = l_orderkey

 WHERE o_orderkey IN (SELECT l_orderkey
 FROM lineitem
 GROUP BY l_orderkey
 HAVING sum(l_quantity) > 300)
 GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def q18(t):
    big = t.lineitem.groupby("l_orderkey").agg_sql("sum(l_quantity) as sum_qty").filter_sql("sum_qty > 300")
    d = big.join(t.orders, left_on="l_orderkey", right_on="o_orderkey").join(t.customer, left_on="o_custkey", right_on="c_custkey")
    d = d.top_k(["o_totalprice", "l_orderkey"], 100, descending=[True, False])
    return d.transform_sql("c_name as c_name, o_custkey as c_custkey, l_orderkey as o_orderkey, o_orderdate as o_orderdate, round(o_totalprice, 2) as o_totalprice, round(sum_qty, 2) as sum_qty")


_Q19 = """(p_brand = 'Brand#2' and l_quantity between 1 and 11 and p_size between 1 and 5) or (p_brand = 'Brand#3' and l_quantity between 10 and 20 and p_size between 1 and 10)
 or (p_brand = 'Brand#4' and l_quantity between 20 and 30 and p_size between 1 and 15)"""


@query(f"SELECT round(sum(l_extendedprice*(1-l_discount)),4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {_Q19}")
def q19(t):
    d = t.lineitem.join(t.part, left_on="l_partkey", right_on="p_partkey").filter_sql(_Q19)
    return d.agg_sql("round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue")


@query("""SELECT s_name, s_suppkey
 FROM supplier
 WHERE s_nationkey < 5 AND s_suppkey IN (SELECT l_suppkey
 FROM lineitem
 WHERE l_partkey IN (SELECT p_partkey
 FROM part
 WHERE p_type LIKE 'SMALL%')
 AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' GROUP BY l_suppkey HAVING sum(l_quantity) > 100)""")
def q20(t):
    d = t.lineitem.filter_sql("l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01'").join(t.part.filter_sql("p_type like 'SMALL%'"), left_on="l_partkey", right_on="p_partkey", how="semi")
    d = d.groupby("l_suppkey").agg_sql("sum(l_quantity) as qty").filter_sql("qty > 100")
    return t.supplier.filter_sql("s_nationkey < 5").join(d, left_on="s_suppkey", right_on="l_suppkey", how="semi").select(["s_name", "s_suppkey"])


@query("""SELECT l_orderkey, min(l_suppkey) AS suppkey
 FROM lineitem
 GROUP BY l_orderkey
 HAVING count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) = 1""")
def q21(t):
    d = t.lineitem.groupby("l_orderkey").agg_sql("array_agg(distinct l_suppkey) as every, array_agg(distinct l_suppkey) filter (where l_returnflag = 'R') as late")
    return d.filter_sql("size(every) >= 2 and size(late) = 1").transform_sql("l_orderkey as l_orderkey, array_min(every) as suppkey")


@query("""SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal),2) AS totacctbal
 FROM customer
 WHERE c_nationkey IN (1, 3, 5, 7, 9) AND c_acctbal > (SELECT avg(c_acctbal)
 FROM customer
 WHERE c_acctbal > 0)
 AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= date '1999-01-01') GROUP BY ALL""")
def q22(t):
    rich = t.ctx.sql("SELECT * FROM {c} WHERE c_nationkey IN (1, 3, 5, 7, 9) AND c_acctbal > (SELECT avg(c_acctbal) FROM {c} WHERE c_acctbal > 0)", c=t.customer)
    d = rich.join(t.orders.filter_sql("o_orderdate >= date '1999-01-01'"), left_on="c_custkey", right_on="o_custkey", how="anti")
    return d.groupby("c_nationkey", orderby="c_nationkey").agg_sql("count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal")
