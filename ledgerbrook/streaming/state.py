"""The latest row of each key as state of a streaming operator, in RocksDB, readable as a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changelog import orders_log
from ..operators.relational import Tables
from ..operators.replay import _replayed, op_code
from ..sources.batches import read_batches
from ..sources.scratch import scratch
from .replay import append_batch, read_log_stream

c = F.col
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: on each executor's disk, with snapshots in the query's checkpoint."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


#: What the state of a key holds, in this order: the last index that makes it, the last that deletes it (negated), its last row and that row's index.
_STATE = ("__made", "__gone", "__row", "__at")


def _row_type(log: DataFrame) -> T.StructType:
    return T.StructType([f for f in log.schema if f.name not in ("_op", "_op_index", "batch_id")])


def latest_rows(log: DataFrame, keys: list[str], missing_update: str = "ignore") -> DataFrame:
    """A streamed log (columns, _op, _op_index) as a stream of the rows it changes, by one streaming aggregation, the one of apply_changes.

    A key's state is the last indexes of a create (with missing_update='upsert': create or update) and of a delete, and its last row of
    either kind, whatever its share of the log. Each is a maximum by _op_index, so a batch that comes again, as a copy of its files, leaves
    the state alone, and operations that come late count in their place. For every key in a micro-batch one row comes out: its columns and
    _op `u` while it is alive, else the key alone and _op `d`.
    """
    row = _row_type(log)
    makes = c("_op") != "d" if missing_update == "upsert" else c("_op") == "c"
    rows = log.select(*row.names, op_code(c("_op")).alias("_op"), "_op_index")
    state = rows.groupBy(*keys).agg(
        F.max(F.when(makes, c("_op_index"))).alias("__made"), F.min(F.when(c("_op") == "d", -c("_op_index"))).alias("__gone"),  # not a second max: the store's reader tells fields by their aggregate's name
        F.max_by(F.struct(*row.names), F.when(c("_op") != "d", c("_op_index"))).alias("__row"))
    return state.select(*(c(n) if n in keys else F.when(_alive(), c("__row")[n]).alias(n) for n in row.names), F.when(_alive(), "u").otherwise("d").alias("_op"))


def _alive() -> Column:
    return c("__made").isNotNull() & (c("__gone").isNull() | (c("__made") > -c("__gone")))


def keep_latest(log: DataFrame, keys: list[str], checkpoint: str, missing_update: str = "ignore") -> None:
    """Run a streamed log into the state under checkpoint until what is available is done; a later call goes on from there."""
    with rocksdb_state(log.sparkSession):
        latest_rows(log, keys, missing_update).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: the rows that are alive after the last micro-batch."""
    with rocksdb_state(spark):
        return spark.read.format("statestore").load(checkpoint).select("value.*").toDF(*_STATE).where(_alive()).select("__row.*")


def _stateful(t: Tables) -> DataFrame:
    """The orders log: five batches, a pause, one of them once more, and the rest."""
    log, path, at = orders_log(t), scratch(t.spark, "log"), scratch(t.spark, "state")
    whole = scratch(t.spark, "batches")
    log.write.partitionBy("batch_id").parquet(whole)  # so that a batch costs its own rows
    log = read_batches(t.spark, whole, log.schema)
    for batches in ((0, 1, 2, 3, 4), (4, 5, 6, 7, 8)):
        for b in batches:
            append_batch(log, f"{path}/{batches[0]}", b)
        keep_latest(read_log_stream(t.spark, path, log.schema), ["o_orderkey"], at)
    return read_latest(t.spark, at)


ALL = {"t3_latest_row_state": (_stateful, _replayed("ignore"))}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
