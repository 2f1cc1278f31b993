"""Relational operators, one small DataFrame query each: projections, joins, aggregates, windows, sorts, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table
from .inequality import counted_below

#: Rows of a table with a fixed or checked size that a join may broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it was counted and is small; else Spark picks the join."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def means_in_row_order(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key and the mean of value, added up in the order of a stored table's files and rows, as SQL in one thread does.

    A sum of doubles depends on its order, so where means are ranked, those of equal rows would part by chance. A group is
    sorted in one task, which spills and keeps none of its rows.
    """
    placed = rows.select(key, value, F.struct("_metadata.file_path", "_metadata.row_index").alias("__at"))
    running = F.avg(value).over(W.partitionBy(key).orderBy("__at").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("__mean", running).groupBy(key).agg(F.max_by("__mean", "__at").alias(name))


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


c, r6 = F.col, lambda x: F.round(x, 6)
ALL: dict[str, tuple] = {}


def op(name: str, sql: str):
    def add(f):
        ALL[name] = (f, sql)
        return f

    return add


def simple(name: str, f, sql: str) -> None:
    ALL[name] = (f, sql)


# projections and filters
simple("p1_projection", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", r6(c("l_extendedprice") * (1 - c("l_discount"))).alias("net")), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem")
simple("p2_conjunction", lambda t: t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).where((c("l_shipdate") > c("o_orderdate")) & (c("l_quantity") < 3)).select("l_orderkey", "l_partkey"), "SELECT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND l_quantity < 3")
simple("p3_between", lambda t: t.lineitem.where(c("l_quantity").between(10 - 1, 10 + 1)).groupBy("l_quantity").count().withColumnRenamed("count", "n"), "SELECT l_quantity, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 - 1 AND 10 + 1 GROUP BY l_quantity")
simple("p4_in_list", lambda t: t.part.where(c("p_type").isin("PROMO", "SMALL")).select("p_partkey", "p_type"), "SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL')")
simple("p5_disjunction", lambda t: t.lineitem.join(t.part, c("p_partkey") == c("l_partkey")).where(((c("p_brand") == "Brand#1") & (c("l_quantity") < 5)) | ((c("p_brand") == "Brand#2") & (c("l_quantity") > 45))).groupBy("p_brand").agg(F.count("*").alias("n")), "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#1' AND l_quantity < 5) OR (p_brand = 'Brand#2' AND l_quantity > 45) GROUP BY p_brand")
simple("p6_like", lambda t: t.part.where(c("p_name").like("%widget%") & ~c("p_type").like("S%")).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%' AND p_type NOT LIKE 'S%'")
simple("p7_nulls", lambda t: t.documents.join(t.labels, "doc_id", "left").groupBy(c("toxic").isNull().alias("unlabelled"), c("quality").isNotNull().alias("rated")).agg(F.count("*").alias("n")), "SELECT toxic IS NULL AS unlabelled, quality IS NOT NULL AS rated, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
simple("p8_case", lambda t: t.orders.select("o_orderkey", F.when(c("o_totalprice") > 200000, "high").when(c("o_totalprice") > 100000, "mid").otherwise("low").alias("band")), "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
simple("p9_point_lookup", lambda t: t.orders.where(c("o_orderkey") == 77).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
simple("p10_star", lambda t: t.customer.where(c("c_acctbal") > 9000).select("*").orderBy("c_custkey"), "SELECT * FROM customer WHERE c_acctbal > 9000 ORDER BY c_custkey")
simple("p11_constant_keys", lambda t: t.events.groupBy(F.lit(1).alias("one"), (c("user_id") % 10).alias("u")).agg(F.count("*").alias("n")), "SELECT 1 AS one, user_id % 10 AS u, count(*) AS n FROM events GROUP BY user_id % 10")


@op("p12_reused_expression", "WITH m AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey) SELECT o_custkey, round(v, 6) AS v FROM m WHERE v > (SELECT 2 * avg(v) FROM m)")
def reused(t):
    m = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return m.crossJoin(F.broadcast(m.agg(F.avg("v").alias("mean")))).where(c("v") > 2 * c("mean")).select("o_custkey", r6("v").alias("v"))  # one row


simple("p13_column_aliases", lambda t: t.nation.groupBy("n_regionkey").count().toDF("region", "nations"), "SELECT region, nations FROM (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) AS x(region, nations)")

# joins
simple("j1_inner", lambda t: t.orders.join(t.customer, c("c_custkey") == c("o_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n")), "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
simple("j2_star", lambda t: t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).join(t.customer, c("c_custkey") == c("o_custkey")).join(t.part, c("p_partkey") == c("l_partkey")).join(t.supplier, c("s_suppkey") == c("l_suppkey")).join(small(t.nation), c("n_nationkey") == c("s_nationkey")).join(small(t.region), c("r_regionkey") == c("n_regionkey")).groupBy("r_name", "p_type").agg(F.count("*").alias("n")), "SELECT r_name, p_type, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, p_type")
simple("j3_multi_key", lambda t: t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).join(t.customer, c("c_custkey") == c("o_custkey")).join(t.supplier, (c("s_suppkey") == c("l_suppkey")) & (c("s_nationkey") == c("c_nationkey"))).groupBy("s_nationkey").agg(F.count("*").alias("n")), "SELECT s_nationkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey GROUP BY s_nationkey")
simple("j4_same_dimension_twice", lambda t: t.customer.alias("a").join(t.nation.alias("n"), c("n.n_nationkey") == c("c_nationkey")).join(t.nation.alias("m"), c("m.n_regionkey") == c("n.n_regionkey")).groupBy(c("n.n_name").alias("home"), c("m.n_name").alias("near")).agg(F.count("*").alias("n")), "SELECT n.n_name AS home, m.n_name AS near, count(*) AS n FROM customer JOIN nation n ON n.n_nationkey = c_nationkey JOIN nation m ON m.n_regionkey = n.n_regionkey GROUP BY n.n_name, m.n_name")
simple("j5_left_with_condition", lambda t: t.customer.join(t.orders, (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > 400000), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")), "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey")
simple("j6_left_as_anti", lambda t: t.part.join(t.lineitem.where("l_quantity > 49"), c("l_partkey") == c("p_partkey"), "left_anti").select("p_partkey"), "SELECT p_partkey FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) x ON l_partkey = p_partkey WHERE l_partkey IS NULL")
simple("j7_full", lambda t: t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("p")).join(t.orders.where("o_totalprice > 400000").groupBy(c("o_custkey").alias("k")).agg(F.count("*").alias("b")), c("o_custkey") == c("k"), "full").select(F.coalesce("o_custkey", "k").alias("k"), "p", "b"), "SELECT coalesce(a.k, x.k) AS k, p, b FROM (SELECT o_custkey AS k, count(*) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS b FROM orders WHERE o_totalprice > 400000 GROUP BY 1) x ON a.k = x.k")
@op("j8_theta", "SELECT l.l_returnflag AS flag, count(*) AS n FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey AND l.l_quantity < m.l_quantity AND l.l_suppkey <> m.l_suppkey GROUP BY l.l_returnflag")
def theta(t):
    """Larger lines of the same order by another supplier: those of the order less those of the supplier in it."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag").where("l_suppkey IS NOT NULL")
    quantity = -c("l_quantity")
    larger = counted_below(lines, lines, {"l_orderkey": "l_orderkey"}, quantity, quantity, name="all")
    both = counted_below(larger, lines, {"l_orderkey": "l_orderkey", "l_suppkey": "l_suppkey"}, quantity, quantity, name="own")
    return both.where(c("all") > c("own")).groupBy(c("l_returnflag").alias("flag")).agg(F.sum(c("all") - c("own")).alias("n"))


simple("j9_semi", lambda t: t.orders.join(t.lineitem.where("l_quantity > 49"), c("l_orderkey") == c("o_orderkey"), "left_semi").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
simple("j10_anti_and_not_in", lambda t: t.spark.sql("SELECT s_suppkey FROM {s} WHERE s_suppkey NOT IN (SELECT l_suppkey FROM {l} WHERE l_quantity > 49 AND l_discount > 0.09)", s=t.supplier, l=t.lineitem), "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)")
simple("j11_exists_inequality", lambda t: t.lineitem.alias("l").join(t.lineitem.alias("m"), (c("l.l_orderkey") == c("m.l_orderkey")) & (c("m.l_suppkey") != c("l.l_suppkey")), "left_semi").groupBy("l_linestatus").agg(F.count("*").alias("n")), "SELECT l_linestatus, count(*) AS n FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_suppkey <> l.l_suppkey) GROUP BY l_linestatus")


@op("j12_exists_or_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000) OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def exists_or(t):
    hits = t.orders.where("(o_orderstatus = 'P' AND o_totalprice > 300000) OR o_totalprice > 450000")
    return t.customer.join(hits, c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey")


simple("j13_correlated_scalar", lambda t: t.lineitem.withColumn("mean", F.avg("l_quantity").over(W.partitionBy("l_partkey"))).where(c("l_quantity") < 0.3 * c("mean")).groupBy("l_partkey").agg(F.count("*").alias("n")), "SELECT l_partkey, count(*) AS n FROM lineitem l WHERE l_quantity < (SELECT 0.3 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey) GROUP BY l_partkey")


@op("j14_correlated_two_keys", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = o.o_orderstatus)")
def correlated_two(t):
    mean = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("mean"))
    return t.orders.join(mean, ["o_custkey", "o_orderstatus"]).where(c("o_totalprice") > 1.5 * c("mean")).select("o_orderkey", "o_custkey")


simple("j15_scalar_in_where", lambda t: t.customer.crossJoin(F.broadcast(t.customer.agg(F.avg("c_acctbal").alias("mean")))).where(c("c_acctbal") > c("mean")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
simple("j16_one_row_cross", lambda t: t.orders.agg(F.count("*").alias("orders")).crossJoin(t.lineitem.agg(F.count("*").alias("lines"))).crossJoin(t.customer.agg(F.count("*").alias("customers"))), "SELECT * FROM (SELECT count(*) AS orders FROM orders) CROSS JOIN (SELECT count(*) AS lines FROM lineitem) CROSS JOIN (SELECT count(*) AS customers FROM customer)")


@op("j17_self_join_years", "WITH y AS (SELECT o_custkey, year(o_orderdate) AS yr, sum(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT a.o_custkey, round(a.v, 6) AS v1, round(b.v, 6) AS v2 FROM y a JOIN y b USING (o_custkey) WHERE a.yr = 1996 AND b.yr = 1997")
def self_join(t):
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.sum("o_totalprice").alias("v"))
    one, two = (y.where(c("yr") == n).select("o_custkey", r6("v").alias(a)) for n, a in ((1996, "v1"), (1997, "v2")))
    return one.join(two, "o_custkey")


@op("j18_null_safe", "SELECT count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS s FROM orders) a JOIN (SELECT * FROM (VALUES ('F', 1), (NULL, 2)) AS v(s, x)) b ON a.s IS NOT DISTINCT FROM b.s")
def null_safe(t):
    few = t.spark.createDataFrame([("F", 1), (None, 2)], "k string, x int")
    status = F.when(c("o_orderstatus") != "P", c("o_orderstatus"))
    return t.orders.select(status.alias("s")).join(F.broadcast(few), c("s").eqNullSafe(c("k"))).agg(F.count("*").alias("n"))


# aggregates
simple("a1_global", lambda t: t.lineitem.agg(F.count("*").alias("n"), r6(F.sum("l_tax")).alias("s"), r6(F.avg("l_tax")).alias("m"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi")), "SELECT count(*) AS n, round(sum(l_tax), 6) AS s, round(avg(l_tax), 6) AS m, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
simple("a2_grouped", lambda t: t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r6(F.avg("o_totalprice")).alias("m")), "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS m FROM orders GROUP BY o_orderpriority")
simple("a3_count_distinct", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("d"), F.count("*").alias("n")), "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, count(*) AS n FROM lineitem GROUP BY l_returnflag")
simple("a4_conditional", lambda t: t.lineitem.agg(F.count_if(c("l_discount") > 0.05).alias("a"), r6(F.sum(F.when(c("l_returnflag") == "R", c("l_quantity")).otherwise(0))).alias("b")), "SELECT count(*) FILTER (l_discount > 0.05) AS a, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 6) AS b FROM lineitem")
simple("a5_pivot", lambda t: t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0), "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
simple("a6_having", lambda t: t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where(c("q") > 250).select("l_orderkey", r6("q").alias("q")), "SELECT l_orderkey, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250")
simple("a7_stddev", lambda t: t.lineitem.groupBy("l_returnflag").agg(r6(F.stddev_samp("l_quantity")).alias("dev"), r6(F.stddev_samp("l_quantity") / F.avg("l_quantity")).alias("cov")), "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS dev, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cov FROM lineitem GROUP BY l_returnflag")
simple("a8_rollup", lambda t: t.part.rollup("p_brand", "p_type").agg(F.count("*").alias("n")), "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")
simple("a9_grouping", lambda t: t.part.rollup("p_type").agg(F.grouping("p_type").cast("int").alias("g"), F.count("*").alias("n")), "SELECT p_type, CAST(grouping(p_type) AS INT) AS g, count(*) AS n FROM part GROUP BY ROLLUP (p_type)")
simple("a10_twice", lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n")), "SELECT k, count(*) AS n FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey) GROUP BY k")
simple("a11_ratio", lambda t: t.lineitem.groupBy("l_linestatus").agg(r6(F.sum(c("l_extendedprice") * c("l_discount")) / F.sum("l_extendedprice")).alias("rate")), "SELECT l_linestatus, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS rate FROM lineitem GROUP BY l_linestatus")
simple("a12_many_sums", lambda t: t.lineitem.agg(*(r6(F.sum(c("l_quantity") + i)).alias(f"s{i}") for i in range(90))), "SELECT " + ", ".join(f"round(sum(l_quantity + {i}), 6) AS s{i}" for i in range(90)) + " FROM lineitem")
simple("a13_top_k_groups", lambda t: t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "l_partkey", "l_suppkey").limit(10), "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_partkey, l_suppkey LIMIT 10")
simple("a14_alias_key", lambda t: t.pages.withColumn("l", F.length("url") % 5).groupBy("l").agg(F.count("*").alias("n")), "SELECT CAST(length(url) % 5 AS INT) AS l, count(*) AS n FROM pages GROUP BY 1")

# windows
simple("w1_rank", lambda t: t.part.withColumn("rk", F.rank().over(W.partitionBy("p_brand").orderBy(c("p_retailprice").desc()))).where("rk <= 3").select("p_brand", "p_partkey", "rk"), "SELECT p_brand, p_partkey, CAST(rk AS INT) AS rk FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rk FROM part) WHERE rk <= 3")


@op("w2_paired_ranks", "WITH m AS (SELECT l_suppkey, avg(l_discount) AS d FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, CAST(rank() OVER (ORDER BY d, l_suppkey) AS INT) AS up, CAST(rank() OVER (ORDER BY d DESC, l_suppkey DESC) AS INT) AS down FROM m")
def paired_ranks(t):
    """An unpartitioned window, after aggregation: one row per supplier reaches its one task."""
    m = means_in_row_order(t.lineitem, "l_suppkey", "l_discount", "d")
    return m.withColumn("up", F.rank().over(W.orderBy(c("d").asc_nulls_last(), c("l_suppkey").asc_nulls_last()))).withColumn("down", F.rank().over(W.orderBy(c("d").desc(), c("l_suppkey").desc()))).select("l_suppkey", "up", "down")  # one row per supplier


@op("w3_rank_in_rollup_level", "WITH g AS (SELECT p_brand, p_type, CAST(grouping(p_brand) + grouping(p_type) AS INT) AS lvl, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)) SELECT p_brand, p_type, lvl, n, CAST(rank() OVER (PARTITION BY lvl, CASE WHEN lvl = 0 THEN p_brand END ORDER BY n DESC) AS INT) AS rk FROM g")
def rank_in_level(t):
    g = t.part.rollup("p_brand", "p_type").agg((F.grouping("p_brand") + F.grouping("p_type")).cast("int").alias("lvl"), F.count("*").alias("n"))
    return g.withColumn("rk", F.rank().over(W.partitionBy("lvl", F.when(c("lvl") == 0, c("p_brand"))).orderBy(c("n").desc())))


simple("w4_window_over_aggregate", lambda t: t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("v")).select("o_orderpriority", "o_orderstatus", F.round("v", 4).alias("v"), F.round(F.avg("v").over(W.partitionBy("o_orderpriority")), 4).alias("mean")), "SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 4) AS v, round(avg(sum(o_totalprice)) OVER (PARTITION BY o_orderpriority), 4) AS mean FROM orders GROUP BY o_orderpriority, o_orderstatus")
simple("w5_share", lambda t: t.part.groupBy("p_type", "p_brand").agg(F.sum("p_size").alias("s")).withColumn("share", r6(c("s") * 100 / F.sum("s").over(W.partitionBy("p_type")))), "SELECT p_type, p_brand, CAST(sum(p_size) AS BIGINT) AS s, round(sum(p_size) * 100 / sum(sum(p_size)) OVER (PARTITION BY p_type), 6) AS share FROM part GROUP BY p_type, p_brand")


@op("w6_running", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 6) AS run, round(max(o_totalprice) OVER w, 6) AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return t.orders.select("o_custkey", "o_orderkey", r6(F.sum("o_totalprice").over(w)).alias("run"), r6(F.max("o_totalprice").over(w)).alias("top"))


@op("w7_top_groups_semi", "WITH b AS (SELECT n_regionkey, c_nationkey, rank() OVER (PARTITION BY n_regionkey ORDER BY sum(c_acctbal) DESC) AS rk FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey, c_nationkey) SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM b WHERE rk <= 2)")
def top_groups(t):
    by = t.customer.join(small(t.nation), c("n_nationkey") == c("c_nationkey")).groupBy("n_regionkey", "c_nationkey").agg(F.sum("c_acctbal").alias("v"))
    best = by.withColumn("rk", F.rank().over(W.partitionBy("n_regionkey").orderBy(c("v").desc()))).where("rk <= 2")
    return t.customer.join(best, "c_nationkey", "left_semi").select("c_custkey")


@op("w8_runs", "SELECT user_id, event_type, min(ts) AS t0, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, event_type, run HAVING count(*) >= 3")
def runs(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(c("event_type").eqNullSafe(F.lag("event_type").over(w)), 0).otherwise(1)
    e = t.events.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "event_type", "run").agg(F.min("ts").alias("t0"), F.count("*").alias("n")).where("n >= 3").drop("run")


# sorts and limits
simple("o1_multi_key_sort", lambda t: t.supplier.orderBy(c("s_nationkey").asc_nulls_last(), c("s_acctbal").desc_nulls_last(), "s_suppkey").select("s_nationkey", "s_suppkey"), "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY s_nationkey NULLS LAST, s_acctbal DESC NULLS LAST, s_suppkey")
simple("o2_top_k", lambda t: t.orders.orderBy(c("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
simple("o3_offset", lambda t: t.orders.orderBy("o_orderkey").offset(100).limit(10).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100")
simple("o4_by_expression", lambda t: t.part.orderBy((c("p_retailprice") * c("p_size")).desc(), "p_partkey").limit(10).select("p_partkey"), "SELECT p_partkey FROM part ORDER BY p_retailprice * p_size DESC, p_partkey LIMIT 10")
simple("o5_any_rows", lambda t: t.events.limit(10).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 10)")
simple("o6_first_rows", lambda t: t.customer.orderBy("c_custkey").limit(10), "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")

# sets
simple("u1_union_all", lambda t: t.orders.select(c("o_custkey").alias("k")).unionByName(t.customer.select(c("c_custkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n")), "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY k")
simple("u2_union", lambda t: t.orders.select(c("o_custkey").alias("k")).union(t.customer.select("c_nationkey")).distinct(), "SELECT o_custkey AS k FROM orders UNION SELECT c_nationkey FROM customer")
simple("u3_intersect", lambda t: t.lineitem.select(c("l_suppkey").alias("k")).intersect(t.customer.select("c_custkey")), "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT c_custkey FROM customer")
simple("u4_except", lambda t: t.customer.select(c("c_custkey").alias("k")).subtract(t.orders.where("o_totalprice > 300000").select("o_custkey")), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
simple("u5_distinct", lambda t: t.lineitem.select("l_returnflag", "l_linestatus").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
