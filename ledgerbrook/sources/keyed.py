"""A keyed table that takes inserts, updates and deletes."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changelog import orders_log
from ..operators.relational import Tables
from ..operators.replay import _replayed, apply_changes
from .scratch import dropped, scratch

c = F.col


def missing(e: AnalysisException) -> bool:
    """Whether there is nothing at the path; any other fault of a read is one."""
    return e.getCondition() == "PATH_NOT_FOUND"


class KeyedSink:
    """Rows by key, dealt into buckets by the key's hash; the table comes into being with the first write.

    A write adds a delta, its changes as they come, to the buckets that its keys fall in and leaves the others alone; a
    bucket that has `compact_every` deltas is folded into a new base. A manifest per version lists what each bucket consists of
    (so many rows as buckets and deltas at most), and a version counts once its number is noted: a write that is cut short leaves the
    table as it was, and older versions stay readable until `vacuum`. Reading folds bases and deltas in one aggregation.
    """

    PIECE = "bucket int, folder string, number long, base boolean"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 16, compact_every: int = 8):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.compact_every = spark, path, schema, keys, buckets, compact_every

    def versions(self) -> list[int]:
        try:
            return sorted(r[0] for r in self.spark.read.schema("version int").parquet(f"{self.path}/noted").distinct().collect())  # one row per write
        except AnalysisException as e:
            if missing(e):
                return []
            raise

    def version(self) -> int:
        """The newest version noted, -1 before the first."""
        return max(self.versions(), default=-1)

    def manifest(self, version: int) -> list:
        """What the buckets of a version consist of: a base, or none, and the deltas since."""
        return [] if version < 0 else self.spark.read.schema(self.PIECE).parquet(f"{self.path}/manifest/v{version}").collect()

    def _log(self, pieces: list) -> DataFrame:
        """Bases as creates and deltas as they are, each row with its place: the number of its write and its index in that."""
        out = []
        for base in (True, False):
            for number in sorted({p.number for p in pieces if p.base == base}):
                own = [p for p in pieces if p.base == base and p.number == number]
                files = self.spark.read.schema(self._stored(base)).parquet(*(f"{self.path}/{p.folder}/__bucket={p.bucket}" for p in own))
                op, index = (F.lit("c"), F.lit(-1).cast("long")) if base else (c("_op"), c("_op_index"))
                out.append(files.select(*self.schema.names, op.alias("_op"), F.struct(F.lit(number).cast("long").alias("n"), index.alias("i")).alias("_op_index")))
        return reduce(DataFrame.unionByName, out)

    def _stored(self, base: bool) -> T.StructType:
        return self.schema if base else T.StructType([*self.schema.fields, T.StructField("_op", T.StringType()), T.StructField("_op_index", T.LongType())])

    def read(self, version: int | None = None) -> DataFrame | None:
        n = self.version() if version is None else version
        if n < 0:
            return None
        pieces = self.manifest(n)
        return apply_changes(None, self._log(pieces), self.keys).select(*self.schema.names) if pieces else self.spark.createDataFrame([], self.schema)

    def _put(self, rows: DataFrame, folder: str) -> list[int]:
        """Write rows by bucket and give the buckets; a large one is several files. At most so many rows as buckets reach the driver."""
        dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        dealt.hint("rebalance", "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        read = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__bucket", T.IntegerType())])).parquet(f"{self.path}/{folder}")
        return [r[0] for r in read.select("__bucket").distinct().collect()]

    def write(self, changes: DataFrame) -> None:
        """Apply rows with _op (c, u or d) and _op_index, in that order."""
        before = self.version()
        n = before + 1
        pieces = [tuple(p) for p in self.manifest(before)]
        touched = self._put(changes.select(*self.schema.names, "_op", "_op_index"), f"v{n}")
        pieces += [(b, f"v{n}", n, False) for b in touched]
        deltas = Counter(b for b, _, _, base in pieces if not base)
        full = {b for b in touched if deltas[b] >= self.compact_every}
        if full:
            own = [Row(bucket=b, folder=f, number=k, base=base) for b, f, k, base in pieces if b in full]
            left = self._put(apply_changes(None, self._log(own), self.keys).select(*self.schema.names), f"b{n}")
            pieces = [p for p in pieces if p[0] not in full] + [(b, f"b{n}", n, True) for b in left]
        self.spark.createDataFrame(pieces, self.PIECE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{n}")
        self.spark.createDataFrame([(n,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/noted")  # one row

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the data that none of the newest `keep` versions needs, and give the folders that went; older versions can't be read any more."""
        versions = self.versions()
        kept = {p.folder for v in versions[-keep:] for p in self.manifest(v)}
        gone = sorted({p.folder for v in versions[:-keep] for p in self.manifest(v)} - kept)
        for folder in gone:
            dropped(self.spark, f"{self.path}/{folder}")
        return gone

    def insert(self, rows: DataFrame) -> None:
        self._all(rows, "c")

    def update(self, rows: DataFrame) -> None:
        """Merge by key where a row matches: whole rows; keys that aren't there are left out."""
        self._all(rows, "u")

    def delete(self, rows: DataFrame) -> None:
        """Only the keys of rows count."""
        self._all(rows.select(*(c(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema)), "d")

    def _all(self, rows: DataFrame, op: str) -> None:
        self.write(rows.withColumn("_op", F.lit(op)).withColumn("_op_index", F.lit(0).cast("long")))


def _sunk(t: Tables) -> DataFrame:
    """Customers inserted, a third of them updated, a fifth deleted, and some of those inserted anew."""
    sink = KeyedSink(t.spark, scratch(t.spark, "customer"), t.customer.schema, ["c_custkey"])
    sink.insert(t.customer)
    sink.update(t.customer.where("c_custkey % 3 = 0").withColumn("c_acctbal", c("c_acctbal") + 1))
    sink.update(t.customer.withColumn("c_custkey", -1 - c("c_custkey")))
    sink.delete(t.customer.where("c_custkey % 5 = 0"))
    sink.insert(t.customer.where("c_custkey % 10 = 0").withColumn("c_name", F.lit("again")))
    return sink.read()


def _logged(t: Tables) -> DataFrame:
    """The orders log written in two parts."""
    log = orders_log(t)
    sink = KeyedSink(t.spark, scratch(t.spark, "orders"), log.drop("batch_id", "_op", "_op_index").schema, ["o_orderkey"])
    for part in (log.where("batch_id <= 3"), log.where("batch_id > 3")):
        sink.write(part)
    return sink.read()


def _merged(t: Tables) -> DataFrame:
    """Orders by key; then, order by order of a few customers, matched-only merges, of which some find no row, and every third write compacts."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    sink = KeyedSink(t.spark, scratch(t.spark, "merged"), o.schema, ["o_orderkey"], compact_every=3)
    sink.insert(o.where("o_orderkey % 2 = 0"))
    for i in range(1, 6):
        sink.update(o.where(c("o_custkey") % 50 == i).withColumn("o_totalprice", c("o_totalprice") + i).withColumn("o_orderstatus", F.lit(None).cast("string")))
    return sink.read()


ALL = {
    "s6_keyed_sink": (_sunk, "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'again' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 10 <> 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 10 = 0"),
    "s6_keyed_log": (_logged, _replayed("ignore")),
    "e10_bucket_merge": (_merged, "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 50 BETWEEN 1 AND 5 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN o_custkey % 50 BETWEEN 1 AND 5 THEN o_custkey % 50 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
