"""Order-processing workload: 21 decision-support queries and parameterised variants.

The fixture has no partsupp table; PARTSUPP derives one. Money is rounded to six places at the very end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import run_sql, sql_query

PARTSUPP = """partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(l_quantity) * 10 AS BIGINT) AS ps_availqty, min(l_extendedprice) / 100 AS ps_supplycost
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""

SQL: dict[str, str] = {
    "h1_pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty, round(sum(l_extendedprice), 6) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 6) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS sum_charge,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "h2_minimum_cost_supplier": f"""
WITH {PARTSUPP},
offers AS (
  SELECT p_partkey, s_acctbal, s_name, n_name, ps_supplycost, min(ps_supplycost) OVER (PARTITION BY p_partkey) AS cheapest
  FROM partsupp JOIN part ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE p_size = 15 AND p_type LIKE '%MO' AND r_name = 'EUROPE')
SELECT round(s_acctbal, 6) AS s_acctbal, s_name, n_name, p_partkey, round(ps_supplycost, 6) AS cost
FROM offers WHERE ps_supplycost = cheapest ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "h3_shipping_priority": """
WITH open_orders AS (
  SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00')
SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM open_orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""",
    "h4_order_priority": """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority""",
    "h5_local_supplier_volume": """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY n_name""",
    "h6_forecast_revenue": """
SELECT round(sum(l_extendedprice * l_discount), 6) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
    "h7_volume_between_nations": """
WITH ship AS (
  SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
  WHERE (a.n_name = 'NATION_1' AND b.n_name = 'NATION_2') OR (a.n_name = 'NATION_2' AND b.n_name = 'NATION_1'))
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 6) AS revenue FROM ship GROUP BY supp_nation, cust_nation, l_year""",
    "h8_market_share": """
WITH sold AS (
  SELECT CAST(year(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, s.n_name AS nation
  FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation c ON c.n_nationkey = c_nationkey JOIN region ON r_regionkey = c.n_regionkey JOIN nation s ON s.n_nationkey = s_nationkey
  WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY')
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM sold GROUP BY o_year""",
    "h9_profit_by_nation_year": f"""
WITH {PARTSUPP}
SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 6) AS profit
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN partsupp ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey
JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey
WHERE p_name LIKE '%widget%' GROUP BY n_name, CAST(year(o_orderdate) AS INT)""",
    "h10_returned_items": """
WITH lost AS (
  SELECT o_custkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-04-01 00:00:00' AND l_returnflag = 'R' GROUP BY o_custkey)
SELECT c_custkey, c_name, round(revenue, 6) AS revenue, round(c_acctbal, 6) AS c_acctbal, n_name
FROM lost JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "h11_important_stock": f"""
WITH {PARTSUPP},
stock AS (
  SELECT ps_partkey, sum(ps_supplycost * ps_availqty) AS worth FROM partsupp JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey
  WHERE n_name = 'NATION_4' GROUP BY ps_partkey)
SELECT ps_partkey, round(worth, 6) AS worth FROM stock WHERE worth > (SELECT sum(worth) * 0.001 FROM stock)""",
    "h12_flag_priority": """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
GROUP BY l_returnflag""",
    "h13_customer_distribution": """
SELECT c_count, count(*) AS custdist
FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS counted
GROUP BY c_count""",
    "h14_promotion_effect": """
SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'""",
    "h16_supplier_counts": f"""
WITH {PARTSUPP}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MED%' AND p_size % 6 = 1
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_name LIKE '%7%' AND s_suppkey IS NOT NULL)
GROUP BY p_brand, p_type, p_size""",
    "h17_small_quantity": """
WITH usual AS (SELECT l_partkey AS k, 0.2 * avg(l_quantity) AS low FROM lineitem GROUP BY l_partkey)
SELECT round(sum(l_extendedprice) / 7.0, 6) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey JOIN usual ON k = l_partkey
WHERE p_brand = 'Brand#3' AND l_quantity < low""",
    "h18_large_orders": """
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, round(o_totalprice, 6) AS o_totalprice, round(sum(l_quantity), 6) AS qty
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "h19_discounted_revenue": """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#7' AND l_quantity < 15 AND p_size <= 20) OR (p_brand = 'Brand#18' AND l_quantity >= 35 AND p_size > 30)""",
    "h20_promotion_candidates": f"""
WITH {PARTSUPP},
half AS (
  SELECT l_partkey, l_suppkey, 0.5 * sum(l_quantity) AS q FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_partkey, l_suppkey)
SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE n_name = 'NATION_5' AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp JOIN half ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey
  WHERE ps_availqty > q AND ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%'))""",
    "h21_waiting_suppliers": """
WITH late AS (SELECT l_orderkey, l_suppkey, l_shipdate > o_orderdate + INTERVAL '60' DAY AS slow FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT s_name, count(*) AS numwait FROM late l JOIN supplier ON s_suppkey = l.l_suppkey
WHERE slow AND EXISTS (SELECT 1 FROM late x WHERE x.l_orderkey = l.l_orderkey AND x.l_suppkey <> l.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM late x WHERE x.l_orderkey = l.l_orderkey AND x.l_suppkey <> l.l_suppkey AND x.slow)
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "h22_sales_opportunity": """
WITH c AS (SELECT c_custkey, substring(c_name, 10, 9) AS code, c_acctbal FROM customer),
rich AS (SELECT avg(c_acctbal) AS least FROM c WHERE c_acctbal > 0)
SELECT substring(code, 9, 1) AS code, count(*) AS numcust, round(sum(c_acctbal), 6) AS totacctbal FROM c JOIN rich ON c_acctbal > least
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY substring(code, 9, 1)""",
}

#: Variants: the query's constants as named parameters, and the values they are run with.
VARIANTS: dict[str, tuple[str, dict[str, str], dict]] = {
    "hp1": ("h1_pricing_summary", {"TIMESTAMP '2001-06-01 00:00:00'": "CAST(:until AS TIMESTAMP_NTZ)"}, {"until": "2000-01-01 00:00:00"}),
    "hp2": ("h2_minimum_cost_supplier", {"p_size = 15": "p_size = :size", "'EUROPE'": ":region"}, {"size": 20, "region": "ASIA"}),
    "hp3": ("h3_shipping_priority", {"'BUILDING'": ":segment"}, {"segment": "MACHINERY"}),
    "hp5": ("h5_local_supplier_volume", {"'ASIA'": ":region"}, {"region": "EUROPE"}),
    "hp6": ("h6_forecast_revenue", {"0.045 AND 0.075": ":low AND :high", "l_quantity < 24": "l_quantity < :most"}, {"low": 0.025, "high": 0.055, "most": 30}),
    "hp7": ("h7_volume_between_nations", {"'NATION_1'": ":one", "'NATION_2'": ":two"}, {"one": "NATION_7", "two": "NATION_8"}),
    "hp8": ("h8_market_share", {"'ECONOMY'": ":type"}, {"type": "SMALL"}),
    "hp9": ("h9_profit_by_nation_year", {"'%widget%'": ":name"}, {"name": "small%"}),
    "hp11": ("h11_important_stock", {"'NATION_4'": ":nation", "0.001": ":fraction"}, {"nation": "NATION_9", "fraction": 0.002}),
    "hp12": ("h12_flag_priority", {"('A', 'R')": "(:one, :two)"}, {"one": "N", "two": "R"}),
    "hp13": ("h13_customer_distribution", {"'%URGENT%'": ":words"}, {"words": "%LOW%"}),
    "hp14": ("h14_promotion_effect", {"'PROMO%'": ":type"}, {"type": "STANDARD%"}),
    "hp16": ("h16_supplier_counts", {"'Brand#4'": ":brand"}, {"brand": "Brand#9"}),
    "hp17": ("h17_small_quantity", {"'Brand#3'": ":brand"}, {"brand": "Brand#11"}),
    "hp18": ("h18_large_orders", {"> 300": "> :least"}, {"least": 250}),
    "hp20": ("h20_promotion_candidates", {"'NATION_5'": ":nation"}, {"nation": "NATION_6"}),
}


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def variant(name: str):
    base, marks, values = VARIANTS[name]
    text = SQL[base]
    for old, new in marks.items():
        if old not in text:
            raise ValueError(f"{name}: {old} isn't in {base}")
        text = text.replace(old, new)
    return text, values


def _variant_query(name: str):
    text, values = variant(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, text, **values)

    return run


def _variant_oracle(name: str) -> str:
    text, values = variant(name)
    for key, value in values.items():
        text = text.replace(f":{key}", _literal(value))
    return text.replace("TIMESTAMP_NTZ", "TIMESTAMP")


def queries() -> dict:
    return {k: sql_query(v) for k, v in SQL.items()} | {f"{k}_{VARIANTS[k][0].split('_', 1)[1]}": _variant_query(k) for k in VARIANTS}


def oracle_sql() -> dict[str, str]:
    return SQL | {f"{k}_{VARIANTS[k][0].split('_', 1)[1]}": _variant_oracle(k) for k in VARIANTS}
