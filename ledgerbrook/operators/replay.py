"""Change-log replay: a log of creates, updates and deletes applied to keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch, stored
from .changelog import ORDERS_LOG, orders_log
from .relational import Tables
from .scans import numbered

c = F.col


def schema_diff(df: DataFrame, expected: T.StructType) -> DataFrame:
    """A row for each column that is missing, extra, renamed (another name at its place), retyped or of other nullability: both sides, and n_rows.

    n_rows counts the rows a problem concerns: all rows for a missing column, rows with a value for an extra or renamed
    one, values that don't convert to the expected type, and nulls where none may be. One pass over the rows.
    """
    have, want = {f.name: f for f in df.schema}, {f.name: f for f in expected}
    renamed = {w.name: h for h, w in zip(df.schema, expected, strict=False) if h.name not in want and w.name not in have}
    extra = have.keys() - want.keys() - {h.name for h in renamed.values()}
    found = []
    for name, w in want.items():
        h = have.get(name)
        if name in renamed:
            found.append((name, "renamed", name, renamed[name].name, F.count(c(renamed[name].name))))
        elif h is None:
            found.append((name, "missing", w.dataType.simpleString(), None, F.count("*")))
        elif h.dataType != w.dataType:
            found.append((name, "type", w.dataType.simpleString(), h.dataType.simpleString(), F.count_if(c(name).isNotNull() & c(name).try_cast(w.dataType).isNull())))
        elif h.nullable and not w.nullable:
            found.append((name, "nullability", "not null", "null", F.count_if(c(name).isNull())))
    found += [(name, "extra", None, have[name].dataType.simpleString(), F.count(c(name))) for name in sorted(extra)]
    text = lambda x: F.lit(x).cast("string")
    rows = F.array(*(F.struct(text(n).alias("column_name"), text(p).alias("problem"), text(e).alias("expected"), text(f).alias("found"), c(f"n{i}").alias("n_rows")) for i, (n, p, e, f, _) in enumerate(found)))
    if not found:
        return df.sparkSession.createDataFrame([], "column_name string, problem string, expected string, found string, n_rows long")
    return df.agg(*(n.cast("long").alias(f"n{i}") for i, (*_, n) in enumerate(found))).select(F.inline(rows))


def with_created_at(df: DataFrame, prefix: str) -> DataFrame:
    """A `<prefix>_created_at` column in UTC."""
    return df.withColumn(f"{prefix}_created_at", F.current_timestamp())


def stamped(df: DataFrame, at: Column) -> DataFrame:
    """__created_at, one value for a batch."""
    return df.withColumn("__created_at", at.cast("timestamp_ntz"))


def stripped(df: DataFrame) -> DataFrame:
    return df.drop("_op", "_op_index")


def op_code(op: Column) -> Column:
    """Unknown and null codes are creates."""
    return F.when(op.isin("u", "d"), op).otherwise("c")


def op_of(log: DataFrame) -> Column:
    """The operation of a log's rows; a log without _op is all creates."""
    return op_code(c("_op")) if "_op" in log.columns else F.lit("c")


def segments(log: DataFrame) -> DataFrame:
    """Runs of equal operations within a batch, in order: batch_id, segment, _op, first and last index, rows.

    Runs are found within the ranges of a sort, which are stored once; each range goes on from the last operation and the
    runs of those before it, so a batch of any size is many tasks' work.
    """
    rows = log.select("batch_id", "_op_index", op_of(log).alias("_op")).orderBy("batch_id", "_op_index").withColumn("__p", F.spark_partition_id())
    ranges = stored(rows, "ranges")
    w, across = W.partitionBy("batch_id", "__p").orderBy("_op_index"), W.partitionBy("batch_id").orderBy("__p")
    cut = ranges.withColumn("new", F.coalesce((c("_op") != F.lag("_op").over(w)).cast("int"), F.lit(0)))  # the first of a range is seen to below
    ends = cut.groupBy("batch_id", "__p").agg(F.min_by("_op", "_op_index").alias("__begins"), F.max_by("_op", "_op_index").alias("__ends"), F.sum("new").alias("__new"))  # one row per range
    opens = F.coalesce((c("__begins") != F.lag("__ends").over(across)).cast("int"), F.lit(1))
    ends = ends.withColumn("__opens", opens).withColumn("__before", F.sum(c("__opens") + c("__new")).over(across) - c("__new"))
    ends = ends.select(c("batch_id").alias("__i"), c("__p").alias("__q"), "__before")
    runs = cut.withColumn("segment", F.sum("new").over(w)).join(ends, c("batch_id").eqNullSafe(c("__i")) & (c("__p") == c("__q"))).withColumn("segment", c("segment") + c("__before"))
    return runs.groupBy("batch_id", "segment", "_op").agg(F.min("_op_index").alias("first"), F.max("_op_index").alias("last"), F.count("*").alias("n"))


def insert_only(log: DataFrame) -> DataFrame:
    """Batches that hold creates only; those need no fold. An unknown or null code is replayed as a create but is none here; a log without _op is all creates."""
    creates = c("_op").eqNullSafe("c") if "_op" in log.columns else F.lit(True)
    return log.groupBy("batch_id").agg(F.bool_and(creates).alias("insert_only"))


def apply_changes(base: DataFrame | None, log: DataFrame, keys: list[str], missing_update: str = "ignore") -> DataFrame:
    """The keyed state after replaying log over base in the order of _op_index.

    One aggregation with partial sums, whatever a key's share of the log: a key is alive if its last create (with
    missing_update='upsert': create or update) comes after its last delete, and then its last row of either kind wins as
    a whole, nulls included. An update of an absent key is ignored or creates it, by policy. Null keys are keys.
    """
    columns = [f for f in log.columns if f not in ("_op", "_op_index", "batch_id")]
    rows = log.select(*columns, op_of(log).alias("_op"), "_op_index")
    if base is not None:
        rows = rows.unionByName(base.select(*columns, F.lit("c").alias("_op"), F.lit(-1).cast("long").alias("_op_index")))
    makes = c("_op") != "d" if missing_update == "upsert" else c("_op") == "c"
    state = rows.groupBy(*keys).agg(
        F.max(F.when(makes, c("_op_index"))).alias("__made"), F.max(F.when(c("_op") == "d", c("_op_index"))).alias("__gone"),
        F.max_by(F.struct(*columns), F.when(c("_op") != "d", c("_op_index"))).alias("__row"))
    return state.where(c("__made").isNotNull() & (c("__gone").isNull() | (c("__made") > c("__gone")))).select("__row.*")


def _match(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & c(f"{a}.{k}").eqNullSafe(c(f"{b}.{k}"))
    return out


def keyed_update(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with every non-key column taken from changes (unique by key) where the keys match; keys match null-safe."""
    new = changes.withColumn("__hit", F.lit(True))
    rest = [k for k in base.columns if k not in keys]
    joined = base.alias("b").join(new.alias("n"), _match(keys, "b", "n"), "left")
    return joined.select(*(c(f"b.{k}") if k in keys else F.when(c("n.__hit"), c(f"n.{k}")).otherwise(c(f"b.{k}")).alias(k) for k in base.columns)) if rest else base


def keyed_delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.alias("b").join(gone.select(*keys).alias("n"), _match(keys, "b", "n"), "left_anti")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    return keyed_delete(base, changes, keys).unionByName(changes.select(*base.columns))


def first_write_wins(base: DataFrame, inserts: DataFrame, keys: list[str]) -> DataFrame:
    """base and the first insert (by _op_index) of each key it lacks."""
    columns = base.columns
    first = inserts.groupBy(*keys).agg(F.min_by(F.struct(*columns), "_op_index").alias("r")).select("r.*")
    return base.unionByName(keyed_delete(first, base, keys))


def document_id(keys: list[str]) -> Column:
    return F.concat_ws(":", *(c(k).cast("string") for k in keys))


def sparse_document(columns: list[str]) -> Column:
    """JSON without null fields."""
    return F.to_json(F.struct(*columns))


def net_rows(log: DataFrame, by: list[str]) -> DataFrame:
    """Creates minus deletes, never below 0."""
    change = F.when(c("_op") == "d", -1).when(c("_op") == "u", 0).otherwise(1)
    return log.groupBy(*by).agg(F.greatest(F.sum(change), F.lit(0)).alias("net"))


def freshness(df: DataFrame, now: Column) -> DataFrame:
    """The last stamp and the seconds since."""
    return df.agg(F.max("__created_at").alias("last")).select("last", (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(c("last").cast("timestamp"))).alias("lag_s"))


def rebatched(df: DataFrame, order: str, interval: Column, rows: int = 32_768) -> DataFrame:
    """df plus batch_no: whole batches of `rows` rows in order, a smaller last one, none across an interval.

    Rows are numbered within the stored ranges of a sort and shifted by the counts before, so an interval of any size is
    many tasks' work.
    """
    ranges = stored(df.withColumn("__i", interval).orderBy("__i", order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("__i", "__p").agg(F.count("*").alias("__n"))  # one row per range and interval in it
    before = before.select(c("__i").alias("__j"), c("__p").alias("__q"), (F.sum("__n").over(W.partitionBy("__i").orderBy("__p")) - c("__n")).alias("__b"))
    place = F.row_number().over(W.partitionBy("__i", "__p").orderBy(order)) - 1 + c("__b")
    out = ranges.join(F.broadcast(before), c("__i").eqNullSafe(c("__j")) & (c("__p") == c("__q")))
    return out.withColumn("batch_no", F.floor(place / rows)).drop("__i", "__j", "__p", "__q", "__b")


def rows_for_bytes(df: DataFrame, most_bytes: int = 75 << 20, width: Column | None = None) -> int:
    """Rows per file so that files stay near most_bytes, from the mean width of the rows (as JSON, where none is given)."""
    mean = df.agg(F.avg(F.octet_length(F.to_json(F.struct(*df.columns))) if width is None else width)).first()[0]
    return max(1, int(most_bytes / max(mean or 1, 1)))


def split_by_bytes(df: DataFrame, order: list[str], width: Column, most_bytes: int = 75 << 20) -> DataFrame:
    """df plus width and split, a number in order: every split has at most most_bytes, but for single larger rows.

    Bytes are cut every most_bytes; a row that lies across a cut is a split alone. Bytes are summed up within ranges of
    the order and shifted by the bytes before.
    """
    ranged = stored(df.withColumn("width", width.cast("long")).orderBy(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__p").agg(F.sum("width").alias("__s"))
    before = sums.select(c("__p").alias("__q"), (F.sum("__s").over(W.orderBy("__p")) - c("__s")).alias("__b"))  # one row per range
    end = F.sum("width").over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + c("__b")
    ends = ranged.join(F.broadcast(before), c("__p") == c("__q")).withColumn("__e", end)
    cut = F.expr(f"(__e - width) div {int(most_bytes)}")
    across = (F.expr(f"greatest(__e - 1, __e - width) div {int(most_bytes)}") != cut).cast("long")
    return ends.withColumn("split", cut * 2 + across).drop("__p", "__q", "__b", "__e")


#: Splits in one folder: as many folders as Spark lists without a job (spark.sql.sources.parallelPartitionDiscovery.threshold). In a job, each folder is a task, whose result goes to the driver.
SPLITS_AT_ONCE = 32
#: Rows that a task writes, in as many splits as they are; a larger split is a task's alone.
ROWS_A_TASK = 500_000


def write_splits(df: DataFrame, split: str, path: str, order: list[str]) -> int:
    """One file per value of the column `split`, in its order, each with its rows in the order given; the column is left out. The number of files.

    Splits are numbered without gaps, and a file's folder is its split's number, so paths list in order; SPLITS_AT_ONCE of them are in
    one folder more. A task writes neighbouring splits one after the other, so tasks follow rows and not files. What bounds a split
    bounds its file.
    """
    spark = df.sparkSession
    counted = stored(df.groupBy(split).agg(F.count("*").alias("__n")), "counted")
    n, total = counted.agg(F.count("*"), F.sum("__n")).first()
    if not n:
        spark.createDataFrame([], df.drop(split).schema).write.parquet(f"{path}/__splits=000000000")
        return 0
    numbers = numbered(counted.select(split), [split]).withColumnRenamed(split, "__own")
    rows = df.join(F.broadcast(numbers) if n <= 100_000 else numbers, c(split).eqNullSafe(c("__own"))).drop("__own", split)
    tasks = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROWS_A_TASK))
    text = lambda x, width: F.coalesce(F.lpad(x.cast("string"), width, "0"), F.lit(""))
    rows = rows.withColumn("__splits", text(F.floor(c("position") / SPLITS_AT_ONCE), 9)).withColumn("__split", text(c("position"), 10))
    put = rows.repartitionById(tasks, F.expr(f"cast(position * {tasks} div {n} as int)")).drop("position").sortWithinPartitions("__splits", "__split", *order)
    put.write.partitionBy("__splits", "__split").parquet(path)
    return n


def split_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of write_splits and file_no, the place of their file in the listing (from 0)."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return rows.withColumn("file_no", F.regexp_extract(c("_metadata.file_path"), r"/__split=(\d+)/", 1).cast("long"))


def state_as_of(base: DataFrame | None, log: DataFrame, keys: list[str], batch: int, **options) -> DataFrame:
    return apply_changes(base, log.where(c("batch_id") <= batch), keys, **options)


def checkpoint_plan(batches: DataFrame, every: int, bootstrap: bool = False) -> DataFrame:
    """batch_id and the checkpoint it belongs to; with bootstrap, the first batch is checkpoint 0 alone."""
    steps = batches.select("batch_id").distinct().withColumn("n", F.dense_rank().over(W.orderBy("batch_id")))  # one row per batch
    n = F.when(c("n") == 1, 0).otherwise(F.floor((c("n") - 2) / every) + 1) if bootstrap else F.floor((c("n") - 1) / every)
    return steps.select("batch_id", n.cast("long").alias("checkpoint"))


def _base(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _changes(t: Tables) -> DataFrame:
    """One update per key: of every third order, and of keys that don't exist."""
    return _base(t).where("o_orderkey % 3 = 0").select((c("o_orderkey") + F.when(c("o_orderkey") % 9 == 0, 1_000_000).otherwise(0)).alias("o_orderkey"), F.when(c("o_orderkey") % 2 == 0, c("o_custkey")).alias("o_custkey"), F.lit("X").alias("o_orderstatus"), (c("o_totalprice") * 2).alias("o_totalprice"))


_CHANGES = "ch AS (SELECT o_orderkey + CASE WHEN o_orderkey % 9 = 0 THEN 1000000 ELSE 0 END AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0)"
_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def _replayed(policy: str, where: str = "true") -> str:
    """Sequential meaning in SQL: rows after the last delete, from the first that makes the key, and of those the last."""
    makes = "_op IN ('c', 'u')" if policy == "upsert" else "_op = 'c'"
    return f"""WITH {ORDERS_LOG}, l AS (SELECT * FROM orders_log WHERE {where}),
g AS (SELECT o_orderkey AS k, max(_op_index) AS gone FROM l WHERE _op = 'd' GROUP BY o_orderkey),
a AS (SELECT l.* FROM l LEFT JOIN g ON k = o_orderkey WHERE gone IS NULL OR _op_index > gone),
b AS (SELECT o_orderkey AS k, min(_op_index) AS born FROM a WHERE {makes} GROUP BY o_orderkey)
SELECT {_COLS} FROM (SELECT a.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY _op_index DESC) AS r FROM a JOIN b ON k = o_orderkey WHERE _op_index >= born AND _op <> 'd') WHERE r = 1"""


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


def _width() -> Column:
    """Bytes of a lineitem as a line of text, of those columns whose text SQL gives alike."""
    return F.octet_length(F.concat_ws("|", *_LINE)) + 1


_ORDERS = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType(), False), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderpriority", T.StringType())])


def _drifted(t: Tables) -> DataFrame:
    """Orders after a change of their source: a column renamed, one gone, prices as text, some of them no numbers, and customers left out."""
    key = c("o_orderkey")
    return t.orders.select(
        "o_orderkey", F.when(key % 7 != 0, c("o_custkey")).alias("o_custkey"), c("o_orderstatus").alias("status"),
        F.when(key % 5 == 0, "n/a").otherwise(c("o_totalprice").cast("string")).alias("o_totalprice"))


_DRIFTED = """SELECT 'o_custkey' AS column_name, 'nullability' AS problem, 'not null' AS expected, 'null' AS found, count(*) FILTER (o_orderkey % 7 = 0 OR o_custkey IS NULL) AS n_rows FROM orders
UNION ALL SELECT 'o_orderstatus', 'renamed', 'o_orderstatus', 'status', count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'type', 'double', 'string', count(*) FILTER (o_orderkey % 5 = 0) FROM orders
UNION ALL SELECT 'o_orderpriority', 'missing', 'string', NULL, count(*) FROM orders"""


_PREFIXES = {"lineitem": "l", "orders": "o", "customer": "c", "part": "p", "supplier": "s", "nation": "n", "region": "r"}


def _rehydrated(t: Tables) -> DataFrame:
    """Every standard table with its time column: by table and minute, its rows, whether one instant stamps them all, and the column's place."""
    rows = []
    for name, prefix in _PREFIXES.items():
        df, at = with_created_at(getattr(t, name), prefix), f"{prefix}_created_at"
        rows.append(df.groupBy().agg(F.count(at).alias("n"), (F.min(at) == F.max(at)).alias("one"), F.bool_and(F.abs(F.unix_seconds(F.current_timestamp()) - F.unix_seconds(c(at))) < 86_400).alias("now")).select(F.lit(name).alias("table_name"), F.lit(f"{at}:{df.schema[at].dataType.simpleString()}:{df.columns.index(at)}").alias("added"), "n", "one", "now"))
    return reduce(DataFrame.unionByName, rows)


_REHYDRATED = " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{p}_created_at:timestamp:' || (SELECT count(*) FROM (DESCRIBE {name})) AS added, count(*) AS n, true AS one, true AS now FROM {name}" for name, p in _PREFIXES.items())


def _plain_log(t: Tables) -> DataFrame:
    """Orders as a log without _op: its segments, the keys alive after each batch's replay, and whether it is insert-only."""
    log = stored(t.orders.select("o_orderkey", "o_custkey", (c("o_orderkey") % 5).alias("batch_id"), c("o_orderkey").alias("_op_index")), "plain")
    alive = apply_changes(None, log, ["o_orderkey"]).groupBy((c("o_orderkey") % 5).alias("batch_id")).agg(F.count("*").alias("alive"))
    return segments(log).select("batch_id", "segment", "_op", "n").join(alive, "batch_id").join(insert_only(log), "batch_id")


def _odd_codes(t: Tables) -> DataFrame:
    """The orders log with an unknown code here and none there."""
    odd = c("o_orderkey") % 10_007
    return insert_only(orders_log(t).withColumn("_op", F.when(odd == 1, "x").when(odd.isin(0, 2), None).otherwise(c("_op"))))


def _batch_files(t: Tables) -> DataFrame:
    """The log in whole batches, written as a file each."""
    log, path = orders_log(t), scratch(t.spark, "files")
    batches = rebatched(log, "_op_index", F.floor(c("batch_id") / 3), 1000).withColumn("batch", F.struct(F.floor(c("batch_id") / 3), "batch_no")).drop("batch_no")
    write_splits(batches, "batch", path, ["_op_index"])
    return split_files(t.spark, path, log.schema).groupBy("file_no").agg(F.count("*").alias("n"), F.min("_op_index").alias("first"), F.max("_op_index").alias("last"))


def _split_files(t: Tables) -> DataFrame:
    """Lines in files of at most 64 KiB by the width of their text, in order."""
    path = scratch(t.spark, "files")
    rows = split_by_bytes(t.lineitem, _LINE, _width(), 1 << 16)
    write_splits(rows, "split", path, _LINE)
    files = split_files(t.spark, path, rows.drop("split").schema)
    return files.groupBy("file_no").agg(F.count("*").alias("n"), F.sum("width").alias("bytes"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


_SPLIT_FILES = """WITH x AS (SELECT l_orderkey, w, CAST(sum(w) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM (SELECT *, strlen(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)) + 1 AS w FROM lineitem)),
y AS (SELECT (e - w) // 65536 * 2 + CASE WHEN (e - 1) // 65536 <> (e - w) // 65536 THEN 1 ELSE 0 END AS split, count(*) AS n, CAST(sum(w) AS BIGINT) AS bytes, min(l_orderkey) AS first, max(l_orderkey) AS last FROM x GROUP BY 1)
SELECT row_number() OVER (ORDER BY split) - 1 AS file_no, n, bytes, first, last FROM y"""


def _stamp():
    return F.lit("2024-02-01 00:00:00")


ALL = {
    "e1_schema_diff": (lambda t: schema_diff(_drifted(t), _ORDERS), _DRIFTED),
    "e2_time_column": (lambda t: with_created_at(t.lineitem, "l").agg(F.count("l_created_at").alias("n"), (F.min("l_created_at") == F.max("l_created_at")).alias("one"), F.bool_and(F.abs(F.unix_timestamp("l_created_at") - F.unix_timestamp(F.current_timestamp())) < 86_400).alias("now")), "SELECT count(*) AS n, true AS one, true AS now FROM lineitem"),
    "e3_e4_stamp_and_strip_whole": (lambda t: stripped(stamped(orders_log(t), _stamp())), f"WITH {ORDERS_LOG} SELECT {_COLS}, batch_id, TIMESTAMP '2024-02-01 00:00:00' AS __created_at FROM orders_log"),
    "e5_segments": (lambda t: segments(orders_log(t)), f"WITH {ORDERS_LOG}, x AS (SELECT *, CASE WHEN _op IS NOT DISTINCT FROM lag(_op) OVER (PARTITION BY batch_id ORDER BY _op_index) THEN 0 ELSE 1 END AS new FROM orders_log), y AS (SELECT *, CAST(sum(new) OVER (PARTITION BY batch_id ORDER BY _op_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM x) SELECT batch_id, segment, _op, min(_op_index) AS first, max(_op_index) AS last, count(*) AS n FROM y GROUP BY batch_id, segment, _op"),
    "e6_insert_only": (lambda t: insert_only(orders_log(t)), f"WITH {ORDERS_LOG} SELECT batch_id, bool_and(_op = 'c') AS insert_only FROM orders_log GROUP BY batch_id"),
    "e7_apply_changes": (lambda t: apply_changes(None, orders_log(t), ["o_orderkey"]), _replayed("ignore")),
    "e7_apply_changes_upsert": (lambda t: apply_changes(None, orders_log(t), ["o_orderkey"], "upsert"), _replayed("upsert")),
    "e8_keyed_update": (lambda t: keyed_update(_base(t), _changes(t), ["o_orderkey"]), f"WITH {_CHANGES} SELECT o.o_orderkey, CASE WHEN ch.o_orderkey IS NOT NULL THEN ch.o_custkey ELSE o.o_custkey END AS o_custkey, coalesce(ch.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(ch.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o LEFT JOIN ch USING (o_orderkey)"),
    "e9_keyed_delete": (lambda t: keyed_delete(_base(t), _changes(t), ["o_orderkey"]), f"WITH {_CHANGES} SELECT {_COLS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ch)"),
    "e10_matched_merge": (lambda t: keyed_update(_base(t), _changes(t).where("o_totalprice > 100000"), ["o_orderkey"]).where("o_orderstatus = 'X'"), f"WITH {_CHANGES} SELECT {_COLS} FROM ch WHERE o_totalprice > 100000 AND o_orderkey IN (SELECT o_orderkey FROM orders)"),
    "e11_upsert": (lambda t: upsert(_base(t), _changes(t), ["o_orderkey"]), f"WITH {_CHANGES} SELECT {_COLS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ch) UNION ALL SELECT {_COLS} FROM ch"),
    "e12_first_write_wins": (lambda t: first_write_wins(_base(t).where("o_orderkey % 2 = 0"), orders_log(t).where("_op <> 'd'"), ["o_orderkey"]), f"WITH {ORDERS_LOG} SELECT {_COLS} FROM orders"),
    "e13_document_id": (lambda t: t.lineitem.select("l_orderkey", "l_linenumber", document_id(["l_orderkey", "l_linenumber"]).alias("id")), "SELECT l_orderkey, l_linenumber, concat_ws(':', l_orderkey, l_linenumber) AS id FROM lineitem"),
    "e14_sparse_documents_whole": (lambda t: orders_log(t).select("_op_index", sparse_document(["o_orderkey", "o_custkey", "o_orderstatus"]).alias("doc")), f"""WITH {ORDERS_LOG} SELECT _op_index, '{{"o_orderkey":' || o_orderkey || CASE WHEN o_custkey IS NULL THEN '' ELSE ',"o_custkey":' || o_custkey END || CASE WHEN o_orderstatus IS NULL THEN '' ELSE ',"o_orderstatus":"' || o_orderstatus || '"' END || '}}' AS doc FROM orders_log"""),
    "e15_net_rows": (lambda t: net_rows(orders_log(t), ["batch_id"]), f"WITH {ORDERS_LOG} SELECT batch_id, CAST(greatest(sum(CASE _op WHEN 'd' THEN -1 WHEN 'u' THEN 0 ELSE 1 END), 0) AS BIGINT) AS net FROM orders_log GROUP BY batch_id"),
    "e16_freshness": (lambda t: freshness(t.events.select(c("ts").alias("__created_at")), _stamp()), "SELECT max(ts) AS last, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) AS lag_s FROM events"),
    "e17_rebatched": (lambda t: rebatched(orders_log(t), "_op_index", F.floor(c("batch_id") / 3), 1000).groupBy(F.floor(c("batch_id") / 3).alias("interval"), "batch_no").agg(F.count("*").alias("n"), F.min("_op_index").alias("first"), F.max("_op_index").alias("last")), f"WITH {ORDERS_LOG}, x AS (SELECT batch_id // 3 AS i, _op_index, (row_number() OVER (PARTITION BY batch_id // 3 ORDER BY _op_index) - 1) // 1000 AS b FROM orders_log) SELECT CAST(i AS BIGINT) AS interval, CAST(b AS BIGINT) AS batch_no, count(*) AS n, min(_op_index) AS first, max(_op_index) AS last FROM x GROUP BY i, b"),
    "e18_byte_bound": (lambda t: t.lineitem.agg(F.count("*").alias("n")).select(F.lit(rows_for_bytes(t.lineitem, 75 << 20, _width())).cast("long").alias("rows_per_file"), "n"), "SELECT CAST(floor(78643200 / avg(strlen(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)) + 1)) AS BIGINT) AS rows_per_file, count(*) AS n FROM lineitem"),
    "e18_byte_splits": (lambda t: split_by_bytes(t.lineitem, _LINE, _width(), 1 << 16).groupBy("split").agg(F.count("*").alias("n"), F.sum("width").alias("bytes")), "WITH x AS (SELECT w, CAST(sum(w) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM (SELECT *, strlen(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)) + 1 AS w FROM lineitem)) SELECT (e - w) // 65536 * 2 + CASE WHEN (e - 1) // 65536 <> (e - w) // 65536 THEN 1 ELSE 0 END AS split, count(*) AS n, CAST(sum(w) AS BIGINT) AS bytes FROM x GROUP BY 1"),
    "e2_time_columns": (_rehydrated, _REHYDRATED),
    "e5_e6_without_operations": (_plain_log, "SELECT o_orderkey % 5 AS batch_id, CAST(1 AS BIGINT) AS segment, 'c' AS _op, count(*) AS n, count(*) AS alive, true AS insert_only FROM orders GROUP BY 1"),
    "e6_unknown_codes": (_odd_codes, f"WITH {ORDERS_LOG} SELECT batch_id, bool_and(_op = 'c' AND o_orderkey % 10007 > 2) AS insert_only FROM orders_log GROUP BY batch_id"),
    "e17_batch_files": (_batch_files, f"WITH {ORDERS_LOG}, x AS (SELECT batch_id // 3 AS i, _op_index, (row_number() OVER (PARTITION BY batch_id // 3 ORDER BY _op_index) - 1) // 1000 AS b FROM orders_log), y AS (SELECT i, b, count(*) AS n, min(_op_index) AS first, max(_op_index) AS last FROM x GROUP BY i, b) SELECT row_number() OVER (ORDER BY i, b) - 1 AS file_no, n, first, last FROM y"),
    "e18_split_files": (_split_files, _SPLIT_FILES),
    "e19_state_as_of": (lambda t: state_as_of(None, orders_log(t), ["o_orderkey"], 4), _replayed("ignore", "batch_id <= 4")),
    "e20_checkpoint_plan": (lambda t: checkpoint_plan(orders_log(t), 3).withColumn("kind", F.lit("log")).unionByName(checkpoint_plan(orders_log(t), 3, bootstrap=True).withColumn("kind", F.lit("bootstrap"))), f"WITH {ORDERS_LOG}, s AS (SELECT batch_id, dense_rank() OVER (ORDER BY batch_id) AS n FROM (SELECT DISTINCT batch_id FROM orders_log)) SELECT batch_id, CAST((n - 1) // 3 AS BIGINT) AS checkpoint, 'log' AS kind FROM s UNION ALL SELECT batch_id, CAST(CASE WHEN n = 1 THEN 0 ELSE (n - 2) // 3 + 1 END AS BIGINT), 'bootstrap' FROM s"),
}


ALL["e3_e4_stamp_and_strip"] = ALL["e3_e4_stamp_and_strip_whole"]
ALL["e14_sparse_documents"] = (
    lambda t: t.orders.join(t.lineitem.where("l_returnflag = 'R'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("returned")), "o_orderkey", "left").select("o_orderkey", sparse_document(["o_orderstatus", "returned", "o_custkey"]).alias("doc")),
    """WITH r AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) SELECT o_orderkey, '{"o_orderstatus":"' || o_orderstatus || '"' || CASE WHEN n IS NULL THEN '' ELSE ',"returned":' || n END || ',"o_custkey":' || o_custkey || '}' AS doc FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
