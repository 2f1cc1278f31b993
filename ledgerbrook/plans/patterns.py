"""Retail query patterns on the fixture: channels are the three return flags, stores are suppliers, items are parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.inequality import counted_below
from ..operators.relational import means_in_row_order
from ..sources.scratch import stored
from ..sources.tables import run_sql, sql_query, table
from .tpch import PARTSUPP

_REVENUE = "l_extendedprice * (1 - l_discount)"
_YEAR = "CAST(year(o_orderdate) AS INT)"

SQL: dict[str, str] = {
    "d1_star_join": f"""
SELECT {_YEAR} AS y, p_brand, round(sum({_REVENUE}), 6) AS revenue, round(avg(l_quantity), 6) AS mean_qty
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE (p_type = 'PROMO' AND l_quantity BETWEEN 5 AND 20) OR (p_type = 'LARGE' AND s_acctbal > 0)
GROUP BY {_YEAR}, p_brand ORDER BY y, revenue DESC, p_brand LIMIT 100""",
    "d2_basket_size": """
WITH basket AS (SELECT l_orderkey, count(*) AS cnt FROM lineitem GROUP BY l_orderkey)
SELECT c_custkey, c_name, o_orderkey, cnt FROM basket JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE cnt BETWEEN 8 AND 10 AND o_orderstatus = 'O'""",
    "d3_channels_united": f"""
WITH a AS (SELECT p_brand, sum({_REVENUE}) AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' AND p_size < 10 GROUP BY p_brand),
n AS (SELECT p_brand, sum({_REVENUE}) AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N' AND p_size < 10 GROUP BY p_brand),
r AS (SELECT p_brand, sum({_REVENUE}) AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND p_size < 10 GROUP BY p_brand)
SELECT p_brand, round(sum(v), 6) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r) AS u GROUP BY p_brand""",
    "d4_channel_rollup": f"""
WITH sold AS (SELECT l_suppkey AS s, l_linestatus AS channel, sum({_REVENUE}) AS sales FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey, l_linestatus),
back AS (SELECT l_suppkey AS s, l_linestatus AS channel, sum({_REVENUE}) AS returns FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey, l_linestatus)
SELECT channel, s, round(sum(sales), 6) AS sales, round(sum(returns), 6) AS returns
FROM (SELECT channel, s, sales, 0.0 AS returns FROM sold UNION ALL SELECT channel, s, 0.0, returns FROM back) AS u GROUP BY ROLLUP (channel, s)""",
    "d5_rollup_averages": """
SELECT r_name, n_name, CAST(grouping(n_name) AS INT) AS total, round(avg(l_quantity), 6) AS qty, round(avg(l_extendedprice), 6) AS price
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "d6_rank_in_level": f"""
WITH g AS (
  SELECT r_name, n_name, CAST(grouping(r_name) + grouping(n_name) AS INT) AS lvl, sum({_REVENUE}) AS revenue
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name))
SELECT * FROM (SELECT r_name, n_name, lvl, round(revenue, 4) AS revenue, rank() OVER (PARTITION BY lvl, CASE WHEN lvl = 0 THEN r_name END ORDER BY revenue DESC) AS rk FROM g) AS x WHERE rk <= 3""",
    "d7_growth_between_years": f"""
WITH y AS (SELECT o_custkey, {_YEAR} AS yr, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey, {_YEAR})
SELECT a.o_custkey AS custkey, round(a.total, 6) AS before, round(b.total, 6) AS after FROM y a JOIN y b ON b.o_custkey = a.o_custkey AND b.yr = a.yr + 1
WHERE a.yr = 1997 AND b.total > 1.5 * a.total""",
    "d8_above_group_average": """
WITH t AS (SELECT c_nationkey, o_custkey, sum(o_totalprice) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey, o_custkey)
SELECT o_custkey, round(total, 6) AS total FROM t WHERE total > (SELECT 1.2 * avg(total) FROM t x WHERE x.c_nationkey = t.c_nationkey)""",
    "d9_existence_with_or": """
SELECT c_mktsegment, count(*) AS n FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
  AND (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)
    OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'))
GROUP BY c_mktsegment""",
    "d10_several_suppliers": """
SELECT count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice), 6) AS price FROM lineitem l
WHERE EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_suppkey <> l.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_returnflag = 'R')""",
    "d11_share_of_class": f"""
WITH b AS (SELECT p_type, p_brand, sum({_REVENUE}) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type, p_brand)
SELECT p_type, p_brand, round(revenue, 6) AS revenue, round(revenue * 100 / sum(revenue) OVER (PARTITION BY p_type), 6) AS share FROM b""",
    "d12_deviation_with_neighbours": f"""
WITH m AS (
  SELECT n_name, {_YEAR} AS y, CAST(month(o_orderdate) AS INT) AS m, sum({_REVENUE}) AS revenue
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name, {_YEAR}, CAST(month(o_orderdate) AS INT)),
w AS (SELECT *, avg(revenue) OVER (PARTITION BY n_name, y) AS mean, rank() OVER (PARTITION BY n_name ORDER BY y, m) AS rk FROM m)
SELECT w.n_name, w.y, w.m, round(w.revenue, 6) AS revenue, round(w.mean, 6) AS mean, round(p.revenue, 6) AS before, round(q.revenue, 6) AS after
FROM w JOIN w p ON p.n_name = w.n_name AND p.rk = w.rk - 1 JOIN w q ON q.n_name = w.n_name AND q.rk = w.rk + 1
WHERE w.mean > 0 AND abs(w.revenue - w.mean) / w.mean > 0.3""",
    "d13_full_join_cumulative": """
WITH a AS (SELECT CAST(ts AS DATE) AS d, sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY CAST(ts AS DATE)),
b AS (SELECT CAST(ts AS DATE) AS d, sum(value) AS v FROM events WHERE event_type = 'purchase' AND CAST(day(ts) AS INT) % 2 = 0 GROUP BY CAST(ts AS DATE)),
j AS (SELECT coalesce(a.d, b.d) AS d, a.v AS av, b.v AS bv FROM a FULL JOIN b ON a.d = b.d)
SELECT d, round(sum(av) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 6) AS ca, round(max(bv) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 6) AS mb FROM j""",
    "d14_set_operations": f"""
SELECT 'all_years' AS what, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE {_YEAR} = 1996 INTERSECT SELECT o_custkey FROM orders WHERE {_YEAR} = 1997 INTERSECT SELECT o_custkey FROM orders WHERE {_YEAR} = 1998) AS i
UNION ALL SELECT 'only_first', count(*) FROM (SELECT o_custkey FROM orders WHERE {_YEAR} = 1996 EXCEPT SELECT o_custkey FROM orders WHERE {_YEAR} = 1997) AS e""",
    "d15_best_and_worst": """
WITH p AS (SELECT l_partkey, avg(l_discount) AS mean FROM lineitem GROUP BY l_partkey),
low AS (SELECT * FROM p ORDER BY mean, l_partkey LIMIT 10), high AS (SELECT * FROM p ORDER BY mean DESC, l_partkey LIMIT 10),
up AS (SELECT l_partkey, rank() OVER (ORDER BY mean, l_partkey) AS rk FROM low), down AS (SELECT l_partkey, rank() OVER (ORDER BY mean DESC, l_partkey) AS rk FROM high)
SELECT up.rk AS rk, up.l_partkey AS worst, down.l_partkey AS best FROM up JOIN down ON up.rk = down.rk""",
    "d16_buckets_side_by_side": """
SELECT * FROM (SELECT count(*) AS n1, round(avg(l_extendedprice), 6) AS p1, count(DISTINCT l_partkey) AS d1 FROM lineitem WHERE l_quantity BETWEEN 1 AND 10) AS a
CROSS JOIN (SELECT count(*) AS n2, round(avg(l_extendedprice), 6) AS p2, count(DISTINCT l_partkey) AS d2 FROM lineitem WHERE l_quantity BETWEEN 11 AND 20) AS b
CROSS JOIN (SELECT CASE WHEN count(*) > 1000 THEN round(avg(l_discount), 6) ELSE round(avg(l_tax), 6) END AS pick FROM lineitem WHERE l_quantity > 20) AS c""",
    "d17_pivot_weekdays": """
SELECT o_orderstatus, """ + ", ".join(f"round(sum(CASE WHEN {{dow}} = {i} THEN o_totalprice END), 6) AS d{i}" for i in range(7)) + """, round(sum(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN o_totalprice ELSE 0 END), 6) AS early,
  round(sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' THEN o_totalprice ELSE 0 END), 6) AS late
FROM orders GROUP BY o_orderstatus""",
    "d18_coefficient_of_variation": f"""
WITH q AS (
  SELECT l_suppkey, CAST(month(l_shipdate) AS INT) AS m, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS dev FROM lineitem GROUP BY l_suppkey, CAST(month(l_shipdate) AS INT))
SELECT l_suppkey, m, round(mean, 6) AS mean, round(dev / nullif(mean, 0), 6) AS cov FROM q WHERE dev / nullif(mean, 0) > 0.6""",
    "d19_theta_join": f"""
WITH {PARTSUPP}
SELECT CAST(month(l_shipdate) AS INT) AS m, count(*) AS n, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS promo
FROM lineitem JOIN partsupp ON ps_partkey = l_partkey AND ps_availqty < 4 * l_quantity JOIN orders ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL '5' DAY GROUP BY CAST(month(l_shipdate) AS INT)""",
    "d20_adjusted_quantity": """
WITH gone AS (SELECT l_orderkey AS k, l_partkey AS p, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_partkey)
SELECT o_custkey, round(sum(CASE WHEN q IS NOT NULL THEN (l_quantity - q) * l_extendedprice ELSE l_quantity * l_extendedprice END), 6) AS act
FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN gone ON k = l_orderkey AND p = l_partkey WHERE l_returnflag <> 'R' GROUP BY o_custkey""",
    "d21_within_tolerance": f"""
WITH a AS (SELECT l_suppkey AS s, sum({_REVENUE}) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey), n AS (SELECT l_suppkey AS s, sum({_REVENUE}) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_suppkey),
r AS (SELECT l_suppkey AS s, sum({_REVENUE}) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey)
SELECT a.s AS s, round(a.v, 6) AS av, round(n.v, 6) AS nv, round(r.v, 6) AS rv, round((a.v + n.v + r.v) / 3, 6) AS mean FROM a JOIN n ON n.s = a.s JOIN r ON r.s = a.s
WHERE a.v BETWEEN 0.9 * n.v AND 1.1 * n.v AND a.v BETWEEN 0.9 * r.v AND 1.1 * r.v""",
    "d22_best_customers": """
WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(total, 6) AS total FROM t WHERE total > (SELECT 0.8 * max(total) FROM t)""",
    "d23_correlated_count": """
SELECT DISTINCT p_name FROM part i WHERE p_size BETWEEN 1 AND 10 AND (
  SELECT count(*) FROM part v WHERE v.p_brand = i.p_brand AND ((v.p_type = 'PROMO' AND v.p_size < 3) OR (v.p_type = 'SMALL' AND v.p_size > 48))) > 1""",
    "d24_below_fraction_of_average": f"""
WITH sp AS (SELECT l_suppkey, l_partkey, sum({_REVENUE}) AS revenue FROM lineitem GROUP BY l_suppkey, l_partkey),
sa AS (SELECT l_suppkey AS s, avg(revenue) AS mean FROM sp GROUP BY l_suppkey)
SELECT s_name, l_partkey, round(revenue, 6) AS revenue FROM sp JOIN sa ON s = l_suppkey JOIN supplier ON s_suppkey = l_suppkey WHERE revenue <= 0.05 * mean""",
    "d25_wide_self_join": f"""
WITH w AS (
  SELECT p_brand, s_name, n_name, {_YEAR} AS y, count(*) AS cnt, sum(l_extendedprice) AS price, sum(l_discount) AS disc
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = s_nationkey GROUP BY p_brand, s_name, n_name, {_YEAR})
SELECT a.p_brand, a.s_name, a.n_name, a.cnt AS n1, round(a.price, 6) AS p1, b.cnt AS n2, round(b.price, 6) AS p2 FROM w a JOIN w b ON b.p_brand = a.p_brand AND b.s_name = a.s_name AND b.n_name = a.n_name
WHERE a.y = 1997 AND b.y = 1998 AND b.cnt <= a.cnt AND a.disc > 0.3""",
}
#: Sunday is 0.
_DOW = {"spark": "dayofweek(o_orderdate) - 1", "oracle": "dayofweek(o_orderdate)"}


def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a line's part that hold less than four times its quantity, counted in the order of what they hold."""
    lines = run_sql(spark, sf_dir, "SELECT l_partkey, l_quantity, l_discount, CAST(month(l_shipdate) AS INT) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL '5' DAY")
    held = run_sql(spark, sf_dir, f"WITH {PARTSUPP} SELECT ps_partkey, CAST(ps_availqty AS DOUBLE) AS held FROM partsupp")
    short = counted_below(lines, held, {"l_partkey": "ps_partkey"}, 4 * F.col("l_quantity").cast("double"), F.col("held")).where("n > 0")
    return short.groupBy("m").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("l_discount") > 0.05, F.col("n")).otherwise(0)).alias("promo"))


def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten parts with the least mean discount beside the ten with the most."""
    p = stored(means_in_row_order(table(spark, sf_dir, "lineitem"), "l_partkey", "l_discount", "mean"), "means")
    key = F.col("l_partkey").asc_nulls_last()

    def ten(order, name: str) -> DataFrame:
        return p.orderBy(order, key).limit(10).select(F.rank().over(W.orderBy(order, key)).alias("rk"), F.col("l_partkey").alias(name))  # ten rows

    return ten(F.col("mean").asc_nulls_last(), "worst").join(ten(F.col("mean").desc_nulls_last(), "best"), "rk")


def queries() -> dict:
    return {k: sql_query(v.replace("{dow}", _DOW["spark"])) for k, v in SQL.items()} | {"d15_best_and_worst": best_and_worst, "d19_theta_join": theta_join}


def oracle_sql() -> dict[str, str]:
    return {k: v.replace("{dow}", _DOW["oracle"]) for k, v in SQL.items()}
