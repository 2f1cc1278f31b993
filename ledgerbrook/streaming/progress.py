"""Progress of streaming queries, as they report it, in a table; and the rate of ingestion from it."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.changelog import ORDERS_LOG, orders_log
from ..operators.relational import Tables
from ..sources.scratch import scratch
from .replay import VersionedTable, append_batch, read_log_stream, replay_stream

c = F.col


class ProgressTable(StreamingQueryListener):
    """Appends a row to a table for every micro-batch that a query reports: query and run, batch, when it began, its rows and how long it took.

    The table outlives queries and sessions: a query that goes on from its checkpoint keeps its id and goes on with its batches.
    """

    SCHEMA = "query_id string, run_id string, batch_id long, at timestamp, n_rows long, ms long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended = spark, path, {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = self.spark.createDataFrame([(str(p.id), str(p.runId), p.batchId, p.timestamp, p.numInputRows, p.durationMs.get("triggerExecution"))], self.SCHEMA.replace("timestamp", "string"))
        row.withColumn("at", c("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(self.path)  # one row

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query, seconds: float = 60) -> None:
        """Until all that the query reported is in the table; reports arrive after the fact."""
        query.awaitTermination()
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError(f"query {query.id} hasn't reported its end")

    def read(self) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromDDL(self.SCHEMA)).parquet(self.path)


def ingest_rates(progress: DataFrame) -> DataFrame:
    """Per query and micro-batch: its rows, the rows so far, the rows per second that it took, and whether a new run began with it. A batch reported twice, or without rows, counts once or not at all."""
    one = progress.where("n_rows > 0").groupBy("query_id", "batch_id").agg(F.max_by(F.struct("run_id", "at", "n_rows", "ms"), "at").alias("x")).select("query_id", "batch_id", "x.*")
    w = W.partitionBy("query_id").orderBy("batch_id")  # one row per micro-batch
    return one.select("query_id", "batch_id", "at", "n_rows", F.sum("n_rows").over(w).alias("total"), (1000 * c("n_rows") / F.nullif("ms", F.lit(0))).alias("rate"), (~c("run_id").eqNullSafe(F.lag("run_id").over(w))).alias("resumed"))


def _watched(t: Tables) -> DataFrame:
    """The orders log through a stream, batch by batch, with a pause after five, watched from outside: what the second listener adds goes into the same table."""
    log, path, offsets, reports = orders_log(t), scratch(t.spark, "log"), scratch(t.spark, "offsets"), scratch(t.spark, "progress")
    state = T.StructType([f for f in log.schema if f.name not in ("batch_id", "_op", "_op_index")])
    target = VersionedTable(t.spark, scratch(t.spark, "state"), state)
    for batches in (range(5), range(5, 9)):
        table = ProgressTable(t.spark, reports)
        t.spark.streams.addListener(table)
        try:
            for b in batches:
                append_batch(log, path, b)
                table.wait(replay_stream(read_log_stream(t.spark, path, log.schema), target, ["o_orderkey"], offsets))
        finally:
            t.spark.streams.removeListener(table)
    return ingest_rates(table.read()).select("batch_id", "n_rows", "total", (c("rate") >= 0).alias("fine"))


ALL = {
    "t5_live_progress": (_watched, f"WITH {ORDERS_LOG}, r AS (SELECT batch_id, count(*) AS n_rows FROM orders_log GROUP BY 1) SELECT batch_id, n_rows, CAST(sum(n_rows) OVER (ORDER BY batch_id) AS BIGINT) AS total, true AS fine FROM r"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
