"""Versioned batch folders, snapshots and expected results: reading and writing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changelog import ORDERS_LOG, orders_log
from ..operators.relational import Tables
from .scratch import scratch
from .tables import NAMES

c = F.col
VERSION_SCHEMA = "version string, scenario string, scale_factor double, num_steps int, tables map<string,struct<keys:array<string>,time_column:string,batches:array<struct<id:bigint,parts:int>>>>"


def write_batches(log: DataFrame, path: str, rows_per_file: int = 48_000) -> None:
    """One folder per batch, files of at most rows_per_file rows (kept between 32,000 and 64,000)."""
    log.repartitionByRange("batch_id", "_op_index").write.option("maxRecordsPerFile", min(max(rows_per_file, 32_000), 64_000)).partitionBy("batch_id").parquet(path)


def read_batches(spark: SparkSession, path: str, schema: T.StructType, first: int | None = None, last: int | None = None) -> DataFrame:
    """Batches of an id range; the range prunes folders."""
    df = spark.read.schema(schema).parquet(path)
    if first is not None:
        df = df.where(c("batch_id") >= first)
    return df if last is None else df.where(c("batch_id") <= last)


def read_batch_files(spark: SparkSession, paths: str, schema: T.StructType) -> DataFrame:
    """Files named batch-NNNNNN[-part-PPP].parquet, with batch_id and part_id from their names."""
    name = c("_metadata.file_name")
    ids = {n: F.regexp_extract(name, p, 1) for n, p in (("batch_id", r"batch-(\d+)"), ("part_id", r"-part-(\d+)"))}
    df = spark.read.schema(schema).option("pathGlobFilter", "batch-*.parquet").option("recursiveFileLookup", "true").parquet(paths)
    return df.select("*", ids["batch_id"].cast("long").alias("batch_id"), F.coalesce(F.nullif(ids["part_id"], F.lit("")).cast("int"), F.lit(0)).alias("part_id"))


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """Version metadata: a row per table and batch, batch ids once."""
    v = spark.read.schema(VERSION_SCHEMA).option("multiLine", True).json(path)
    t = v.select("version", F.explode("tables").alias("table_name", "t"))
    return t.select("version", "table_name", c("t.keys").alias("keys"), c("t.time_column").alias("time_column"), F.explode("t.batches").alias("b")).select("version", "table_name", "keys", "time_column", c("b.id").alias("batch_id"), c("b.parts").alias("parts")).dropDuplicates(["table_name", "batch_id"])


def write_nothing(df: DataFrame) -> None:
    """Runs the whole plan, keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_version(df: DataFrame, path: str, version: str) -> DataFrame:
    """A keyed table as a new version folder; older ones stay readable."""
    df.write.parquet(f"{path}/version={version}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/version={version}")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A pipe-delimited expected result with a header."""
    return spark.read.csv(path, sep="|", header=True, inferSchema=True)


def expected_result(spark: SparkSession, kind: str, value) -> DataFrame:
    """An expected result from a CSV path, inline CSV text, inline (columns, rows) or a row count."""
    if kind == "csv":
        return spark.read.csv(value, header=True, inferSchema=True)
    if kind == "inline_csv":
        head, *lines = value.strip().split("\n")
        names = ", ".join(f"`{n.strip()}` string" for n in head.split(","))
        return spark.createDataFrame([(x,) for x in lines], "line string").select(F.from_csv("line", names).alias("r")).select("r.*")
    if kind == "rows":
        columns, rows = value
        return spark.createDataFrame([tuple(r) for r in rows], columns)
    if kind == "count":
        return spark.createDataFrame([(int(value),)], "n_rows long")
    raise ValueError(f"unknown kind of expected result: {kind}")


def write_snapshot(df: DataFrame, path: str, checkpoint: str, query: str) -> DataFrame:
    """A query's result at a checkpoint; an empty one keeps its schema."""
    df.write.parquet(f"{path}/{checkpoint}/{query}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{checkpoint}/{query}")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints and queries found under a snapshot folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("checkpoint"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("query")).distinct()


def write_row_counts(tables: dict[str, DataFrame], path: str, checkpoint: str) -> None:
    """The rows of each table at a checkpoint, as JSON lines beside its snapshots."""
    row_counts(tables).coalesce(1).write.json(f"{path}/{checkpoint}/row_counts")  # one row per table


def read_row_counts(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    return spark.read.schema("table_name string, n_rows long").json(f"{path}/{checkpoint}/row_counts")


_SCENARIO = "checkpoint_indexes:array<bigint>,query_indexes:array<string>,checkpoint_interval_steps:bigint"


def write_manifest(spark: SparkSession, path: str, scenario: str, interval: int) -> None:
    """checkpoints.json in a snapshot folder: for the scenario the checkpoints and queries found there, and the steps between two checkpoints."""
    found = manifest(spark, path).select(F.regexp_extract("checkpoint", r"(\d+)$", 1).cast("long").alias("n"), "query")
    lists = found.agg(F.array_sort(F.collect_set("n")).alias("checkpoint_indexes"), F.array_sort(F.collect_set("query")).alias("query_indexes"), F.lit(interval).cast("long").alias("checkpoint_interval_steps"))
    lists.select(F.create_map(F.lit(scenario), F.struct("*")).alias("scenarios")).coalesce(1).write.mode("overwrite").json(f"{path}/checkpoints.json")  # one row


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """scenario, checkpoint, query and interval of each snapshot that the manifest lists. A field that is missing is empty, an interval 0."""
    rows = spark.read.schema(f"scenarios map<string,struct<{_SCENARIO}>>").json(f"{path}/checkpoints.json").select(F.explode("scenarios").alias("scenario", "x"))
    return rows.select("scenario", F.explode("x.checkpoint_indexes").alias("checkpoint"), "x.query_indexes", F.coalesce("x.checkpoint_interval_steps", F.lit(0)).cast("long").alias("interval")).select("scenario", "checkpoint", F.explode("query_indexes").alias("query"), "interval")


def write_layout(df: DataFrame, name: str, by: list[str], bucket: tuple[int, str] | None = None) -> DataFrame:
    """A table partitioned by folders and, if asked, bucketed by a column."""
    w = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    if bucket:
        w = w.bucketBy(*bucket).sortBy(bucket[1])
    w.format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


#: Column types by name. Fixed values.
TYPES = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "utf8": "string", "binary": "binary", "date32": "date", "date64": "date", "timestamp": "timestamp_ntz", "timestamp_tz": "timestamp"}


def table_schema(columns: list[tuple[str, str]]) -> T.StructType:
    """A schema from (name, type); decimal(p,s) is capped at 38 digits."""
    out = []
    for name, kind in columns:
        if kind.startswith("decimal"):
            p, s = (int(x) for x in kind[8:-1].split(","))
            kind = f"decimal({min(p, 38)},{s})"
        out.append(f"`{name}` {TYPES.get(kind, kind)}")
    return T.StructType.fromDDL(", ".join(out))


def read_store(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """A parquet table in any store that Spark reads, with one block of options."""
    return spark.read.options(**(options or {})).parquet(path)


def _logged(t: Tables, first: int | None = None, last: int | None = None) -> DataFrame:
    log = orders_log(t)
    path = scratch(t.spark, "batches")
    write_batches(log, path)
    return read_batches(t.spark, path, log.schema, first, last)


def _snapshot(t: Tables) -> DataFrame:
    path = scratch(t.spark, "snapshots")
    made = {("cp0", "none"): t.orders.where("o_orderkey < 0"), ("cp1", "priorities"): t.orders.groupBy("o_orderpriority").count(), ("cp1", "orders"): t.orders}
    back = {k: write_snapshot(df, path, *k) for k, df in made.items()}
    n = row_counts({"/".join(k): df for k, df in back.items()})
    return manifest(t.spark, path).join(n, F.concat_ws("/", "checkpoint", "query") == c("table_name")).drop("table_name")


def _layout(t: Tables) -> DataFrame:
    """Rows by status, and whether each lies in the file of its bucket, in order; the table is dropped once that is known."""
    name = f"orders_by_status_{uuid.uuid4().hex[:8]}"
    made = write_layout(t.orders, name, ["o_orderstatus"], (4, "o_orderkey"))
    file = c("_metadata.file_name")
    bucket = F.regexp_extract(file, r"_(\d+)(?:\.c\d+)?\.", 1).cast("int")
    rows = made.select("o_orderkey", "o_orderstatus", file.alias("file"), F.pmod(F.hash("o_orderkey"), F.lit(4)).alias("own"), bucket.alias("bucket"), c("_metadata.row_index").alias("at"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_orderstatus", "file").orderBy("at"))  # one bucket's file
    checked = rows.withColumn("sorted", before.isNull() | (before <= c("o_orderkey"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("bucket").alias("buckets"), F.bool_and(c("own") == c("bucket")).alias("placed"), F.bool_and("sorted").alias("sorted"))
    path = scratch(t.spark, "layout")
    checked.write.parquet(path)
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.read.schema(checked.schema).parquet(path)


def _null_sink(t: Tables) -> DataFrame:
    write_nothing(t.lineitem)
    return t.lineitem.agg(F.count("*").alias("n"))


def _version(t: Tables) -> DataFrame:
    """Metadata of the orders log, written as JSON and read with its schema; one batch is listed twice."""
    log = orders_log(t)
    ids = log.select("batch_id").distinct().unionByName(log.where("batch_id = 2").select("batch_id").limit(1))
    b = ids.agg(F.sort_array(F.collect_list(F.struct(c("batch_id").alias("id"), F.lit(1).alias("parts")))).alias("batches"))  # one row per batch
    doc = b.select(F.to_json(F.struct(F.lit("1").alias("version"), F.create_map(F.lit("orders"), F.struct(F.array(F.lit("o_orderkey")).alias("keys"), F.lit("o_created_at").alias("time_column"), "batches")).alias("tables"))).alias("value"))
    path = scratch(t.spark, "version")
    doc.coalesce(1).write.text(path)
    return read_version(t.spark, path).select("table_name", "time_column", "batch_id", "parts")


def _golden(t: Tables) -> DataFrame:
    """Customers as a golden file and back."""
    path = scratch(t.spark, "golden")
    t.customer.write.csv(path, sep="|", header=True)
    return read_golden(t.spark, path).withColumn("c_custkey", c("c_custkey").cast("long"))


def _expected(t: Tables) -> DataFrame:
    """Customers by segment as a CSV result, as inline CSV and as a count."""
    path = scratch(t.spark, "expected")
    found = t.customer.groupBy(c("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    found.write.csv(path, header=True)
    lines = [f"{r.segment},{r.n}" for r in found.collect()]  # one row per segment
    a = expected_result(t.spark, "csv", path).select(F.lit("csv").alias("kind"), "segment", c("n").cast("string").alias("n"))
    b = expected_result(t.spark, "inline_csv", "\n".join(["segment,n", *lines])).select(F.lit("inline").alias("kind"), "segment", "n")
    n = expected_result(t.spark, "count", len(lines)).select(F.lit("count").alias("kind"), F.lit(None).cast("string").alias("segment"), c("n_rows").cast("string").alias("n"))
    return a.unionByName(b).unionByName(n)


def _typed(t: Tables) -> DataFrame:
    """Suppliers in the types of a table definition."""
    schema = table_schema([("s_suppkey", "uint32"), ("s_name", "utf8"), ("s_acctbal", "decimal(40,2)")])
    return t.supplier.select(*(c(f.name).cast(f.dataType) for f in schema)).withColumn("s_acctbal", c("s_acctbal").cast("string"))


_LOG = f"WITH {ORDERS_LOG} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, batch_id, _op, _op_index FROM orders_log"
def _counted(t: Tables) -> DataFrame:
    """Every table's rows, written at a checkpoint and read back."""
    path = scratch(t.spark, "counts")
    write_row_counts({n: getattr(t, n) for n in NAMES}, path, "cp0")
    return read_row_counts(t.spark, path, "cp0")


def _listed(t: Tables) -> DataFrame:
    """Orders by status at two checkpoints of two steps each, and the manifest that lists them, with the rows of each snapshot."""
    path = scratch(t.spark, "snapshots")
    back = {}
    for i in (0, 1):
        for query, by in (("statuses", "o_orderstatus"), ("priorities", "o_orderpriority")):
            back[i, query] = write_snapshot(t.orders.where(c("o_orderkey") % 4 <= 2 * i + 1).groupBy(by).count(), path, f"cp{i}", query)
    write_manifest(t.spark, path, "orders", 2)
    n = row_counts({f"{i}/{q}": df for (i, q), df in back.items()})
    return read_manifest(t.spark, path).join(n, F.concat_ws("/", "checkpoint", "query") == c("table_name")).drop("table_name")


ALL = {
    "s1_s4_batches": (lambda t: _logged(t), _LOG),
    "s2_version_metadata": (_version, f"WITH {ORDERS_LOG} SELECT DISTINCT 'orders' AS table_name, 'o_created_at' AS time_column, batch_id, 1 AS parts FROM orders_log"),
    "s7_golden_file": (_golden, "SELECT * FROM customer"),
    "s8_expected_results": (_expected, "WITH x AS (SELECT c_mktsegment AS segment, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY 1) SELECT k AS kind, segment, n FROM x, (VALUES ('csv'), ('inline')) AS v(k) UNION ALL SELECT 'count', NULL, CAST(count(*) AS VARCHAR) FROM x"),
    "s13_table_definition": (_typed, "SELECT s_suppkey, s_name, CAST(CAST(s_acctbal AS DECIMAL(38,2)) AS VARCHAR) AS s_acctbal FROM supplier"),
    "s3_batch_range": (lambda t: _logged(t, 2, 4), f"{_LOG} WHERE batch_id BETWEEN 2 AND 4"),
    "s5_null_sink": (_null_sink, "SELECT count(*) AS n FROM lineitem"),
    "s6_keyed_versions": (lambda t: write_version(t.customer, scratch(t.spark, "customer"), "1"), "SELECT * FROM customer"),
    "s9_s11_snapshots": (_snapshot, "SELECT 'cp0' AS checkpoint, 'none' AS query, CAST(0 AS BIGINT) AS n_rows UNION ALL SELECT 'cp1', 'priorities', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'cp1', 'orders', count(*) FROM orders"),
    "s10_written_counts": (_counted, " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES)),
    "s11_manifest": (_listed, " UNION ALL ".join(f"SELECT 'orders' AS scenario, CAST({i} AS BIGINT) AS checkpoint, '{q}' AS query, CAST(2 AS BIGINT) AS interval, count(DISTINCT {by}) AS n_rows FROM orders WHERE o_orderkey % 4 <= {2 * i + 1}" for i in (0, 1) for q, by in (("statuses", "o_orderstatus"), ("priorities", "o_orderpriority")))),
    "s10_row_counts": (lambda t: row_counts({"orders": t.orders, "part": t.part}), "SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders UNION ALL SELECT 'part', count(*) FROM part"),
    "s12_layout": (_layout, "SELECT o_orderstatus, count(*) AS n, least(count(DISTINCT o_orderkey), 4) AS buckets, true AS placed, true AS sorted FROM orders GROUP BY o_orderstatus"),
    "s14_store_table": (lambda t: read_store(t.spark, f"{t.sf_dir}/lineitem.parquet", {"mergeSchema": "false"}), "SELECT * FROM lineitem"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
