"""Scalar functions as the workloads use them, and a canonical text for any value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import Tables

c = F.col


def canonical(col: Column, kind: T.DataType) -> Column:
    """A value's canonical text: integers plain, floats with six decimals, decimals by their scale, ISO dates and times, `NULL` for null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        out = F.format_string("%.6f", col.cast("double"))
    elif isinstance(kind, T.DateType):
        out = F.date_format(col, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    elif isinstance(kind, T.BooleanType):
        out = F.when(col, "true").otherwise("false")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        out = F.to_json(col)
    else:
        out = col.cast("string")
    return F.when(col.isNull(), "NULL").otherwise(out)


def deviation(value: Column, mean: Column) -> Column:
    """|value - mean| / mean, null where the mean is 0."""
    return F.when(mean != 0, F.abs(value - mean) / mean)


ALL = {
    "f1_substring": (lambda t: t.customer.select("c_custkey", F.substring("c_name", 1, 4).alias("a"), F.substring("c_name", 10, 3).alias("b")), "SELECT c_custkey, substring(c_name, 1, 4) AS a, substring(c_name, 10, 3) AS b FROM customer"),
    "f2_concat": (lambda t: t.supplier.select("s_suppkey", F.concat(F.lit("store "), "s_name").alias("x")), "SELECT s_suppkey, 'store ' || s_name AS x FROM supplier"),
    "f3_upper": (lambda t: t.part.select("p_partkey", F.upper("p_name").alias("x")), "SELECT p_partkey, upper(p_name) AS x FROM part"),
    "f4_length": (lambda t: t.documents.select("doc_id", F.length("text").cast("long").alias("n")), "SELECT doc_id, length(text) AS n FROM documents"),
    "f5_regexp_replace": (lambda t: t.events.select("event_id", F.regexp_replace("props", r"(\w+)\W+(\d+)", "$2 of $1").alias("turned")), r"SELECT event_id, regexp_replace(props, '(\w+)\W+(\d+)', '\2 of \1', 'g') AS turned FROM events"),
    "f6_extract": (lambda t: t.events.select("event_id", F.year("ts").alias("y"), F.minute("ts").alias("m")), "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(minute(ts) AS INT) AS m FROM events"),
    "f7_date_trunc": (lambda t: t.events.select("event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("m")), "SELECT event_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS m FROM events"),
    "f8_from_epoch": (lambda t: t.events.select("event_id", F.timestamp_seconds(c("event_id") * 60).cast("timestamp_ntz").alias("at")), "SELECT event_id, CAST(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(event_id * 60) AS TIMESTAMP) AS at FROM events"),
    "f9_date_arithmetic": (lambda t: t.orders.select("o_orderkey", (c("o_orderdate") + F.expr("INTERVAL '3' MONTH")).alias("a"), (c("o_orderdate") - F.expr("INTERVAL '10' DAY")).alias("b")), "SELECT o_orderkey, o_orderdate + INTERVAL '3' MONTH AS a, o_orderdate - INTERVAL '10' DAY AS b FROM orders"),
    "f10_date_difference": (lambda t: t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).groupBy(F.floor(F.datediff(c("l_shipdate").cast("date"), c("o_orderdate").cast("date")) / 30).cast("long").alias("lag")).agg(F.count("*").alias("n")), "SELECT CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 30) AS BIGINT) AS lag, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"),
    "f11_cast": (lambda t: t.orders.select("o_orderkey", c("o_orderdate").cast("date").alias("d"), c("o_totalprice").cast("decimal(15,2)").cast("string").alias("p")), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS p FROM orders"),
    "f12_coalesce": (lambda t: t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("t")), "SELECT doc_id, coalesce(toxic, -1) AS t FROM documents LEFT JOIN labels USING (doc_id)"),
    "f13_abs_round": (lambda t: t.customer.select("c_custkey", F.round(F.abs("c_acctbal"), 1).alias("x")), "SELECT c_custkey, round(abs(c_acctbal), 1) AS x FROM customer"),
    "f14_guarded_deviation": (lambda t: t.part.groupBy("p_brand").agg(F.avg("p_size").alias("m"), F.max("p_size").alias("x")).select("p_brand", F.round(deviation(c("x"), c("m")), 6).alias("dev"), F.round(F.try_divide(c("x"), c("m") - c("m")), 6).alias("none")), "SELECT p_brand, round(abs(max(p_size) - avg(p_size)) / nullif(avg(p_size), 0), 6) AS dev, CAST(NULL AS DOUBLE) AS none FROM part GROUP BY p_brand"),
    "f15_decimal_ratio": (lambda t: t.orders.groupBy("o_orderpriority").agg((F.count_if(c("o_orderstatus") == "F").cast("decimal(15,4)") / F.count("*").cast("decimal(15,4)")).cast("double").alias("x")).select("o_orderpriority", F.round("x", 6).alias("x")), "SELECT o_orderpriority, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS x FROM orders GROUP BY o_orderpriority"),
    "f16_canonical_text": (lambda t: (lambda d: d.select(*(canonical(c(f.name), f.dataType).alias(f.name) for f in d.schema)))(t.orders.withColumn("flag", c("o_totalprice") > 100000).withColumn("gap", F.when(c("o_orderstatus") != "P", c("o_custkey")))),
        "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, printf('%.6f', o_totalprice) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority, CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END AS flag, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) ELSE 'NULL' END AS gap FROM orders"),
    "f17_parameters": (lambda t: t.spark.sql("SELECT p_partkey FROM {p} WHERE p_brand = :brand AND p_size < :most", args={"brand": "Brand#3", "most": 10}, p=t.part), "SELECT p_partkey FROM part WHERE p_brand = 'Brand#3' AND p_size < 10"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
