"""Streaming replay of a change log and windowed run metrics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changelog import orders_log
from ..operators.relational import Tables
from ..operators.replay import _replayed, apply_changes
from ..operators.runstats import RUNS, percentiles, query_runs
from ..sources.keyed import missing
from ..sources.scratch import scratch

c = F.col


class VersionedTable:
    """A keyed table as version folders named by micro-batch, and a table of the versions applied.

    A version is a delta, the changes of its micro-batch, or a base, the whole table; reading folds the deltas since the
    last base. So a micro-batch costs what it holds, and only every `compact_every`-th rewrites the table.
    A version counts once its number is noted, which happens after it is written; so a micro-batch that is repeated
    after a failure is either skipped or written again from the version before it.
    """

    NOTED = "version long, last long, base boolean"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str] | None = None, missing_update: str = "ignore", compact_every: int = 8):
        self.spark, self.path, self.schema, self.keys, self.missing_update, self.compact_every = spark, path, schema, keys, missing_update, compact_every
        self.version, self.last, self.base, self.deltas = None, -1, None, []
        try:
            noted = sorted(set(map(tuple, spark.read.schema(self.NOTED).parquet(f"{path}/applied").collect())))  # one row per micro-batch
        except AnalysisException as e:
            if not missing(e):  # else nothing is applied yet
                raise
            noted = []
        for version, last, base in noted:
            self._note(version, last, base)

    def _note(self, version: int, last: int, base: bool) -> None:
        self.version, self.last = version, last
        self.base, self.deltas = (version, []) if base else (self.base, [*self.deltas, version])

    def _deltas(self, *versions: int) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_op", T.StringType()), T.StructField("_op_index", T.LongType())])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/d{v}" for v in versions))

    def _base(self) -> DataFrame | None:
        return None if self.base is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.base}")

    def read(self) -> DataFrame:
        base = self._base()
        if self.deltas:
            return apply_changes(base, self._deltas(*self.deltas), self.keys, self.missing_update)
        return self.spark.createDataFrame([], self.schema) if base is None else base

    def advance(self, changes: DataFrame, version: int) -> None:
        """Apply a micro-batch: its rows with _op and _op_index, which are read once. One that begins below what was applied is refused, before it counts."""
        changes.select(*self.schema.names, "_op", "_op_index").write.mode("overwrite").parquet(f"{self.path}/d{version}")
        lo, hi = self._deltas(version).agg(F.min("_op_index"), F.max("_op_index")).first()
        if lo is None:
            return
        if lo <= self.last:
            raise ValueError(f"micro-batch {version} begins at {lo}, but {self.last} is applied")
        compact = len(self.deltas) + 1 >= self.compact_every
        if compact:
            apply_changes(self._base(), self._deltas(*self.deltas, version), self.keys, self.missing_update).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.spark.createDataFrame([(version, hi, compact)], self.NOTED).coalesce(1).write.mode("append").parquet(f"{self.path}/applied")  # one row
        self._note(version, hi, compact)


def replay_stream(log: DataFrame, target: VersionedTable, keys: list[str], checkpoint: str, missing_update: str = "ignore"):
    """Apply a streamed log to target, micro-batch by micro-batch, until what is available is done.

    A micro-batch already applied is skipped; one that begins below what was applied is refused, since files must come
    in the order of their batches.
    """

    def fold(batch: DataFrame, number: int) -> None:
        if target.version is None or number > target.version:
            target.advance(batch, number)

    target.keys, target.missing_update = keys, missing_update
    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """Files of a log as they come; a micro-batch holds all there are, or at most so many."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(path)


def append_batch(log: DataFrame, path: str, batch: int, rows_per_file: int = 1_000_000) -> None:
    """A batch of the log in files by ranges of its order, for a stream to pick up together."""
    log.where(c("batch_id") == batch).repartitionByRange("_op_index").write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{batch:06d}")


def metric_windows(runs: DataFrame, width: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts, successes, failures and durations by window and query; works on streams and tables."""
    return runs.withColumn("at", c("started_at").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "query_name").agg(
        F.count("*").alias("n"), F.count_if("success").alias("passed"), F.count_if(~c("success")).alias("failed"), F.sum("duration_ms").alias("total_ms"),
        *(F.count_if(c("duration_ms") <= b).alias(f"le_{b}") for b in (10, 50, 100))).select(c("w.start").cast("timestamp_ntz").alias("start"), "query_name", "n", "passed", "failed", "total_ms", "le_10", "le_50", "le_100")


def classified(runs: DataFrame, most_ms: float) -> DataFrame:
    """A success slower than most_ms is a failure by timeout."""
    slow = c("success") & (c("duration_ms") > most_ms)
    return runs.withColumn("reason", F.when(slow, "timeout").otherwise(c("reason"))).withColumn("success", c("success") & ~slow)


def timing_medians(runs: DataFrame, width: str = "5 seconds") -> DataFrame:
    """The median by window, by ranks, so a window of any size is no single task's."""
    starts = runs.withColumn("start", F.window(c("started_at").cast("timestamp"), width)["start"].cast("timestamp_ntz"))
    return percentiles(starts, ["start"], "duration_ms", [50]).withColumnRenamed("p50", "median_ms")


def progress_rates(samples: DataFrame, at: str, rows: str) -> DataFrame:
    """samples (one row each, of a cumulative count) plus the rows per second since the sample before."""
    w = Window.orderBy(at)
    seconds = F.unix_timestamp(c(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(w).cast("timestamp"))
    return samples.withColumn("rate", (c(rows) - F.lag(rows).over(w)) / F.nullif(seconds, F.lit(0)))


def _progress(t: Tables) -> DataFrame:
    """Events by the end of each hour, and the rate within it."""
    hours = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.count("*").alias("n"))
    samples = hours.select("h", F.sum("n").over(Window.orderBy("h")).alias("total"))  # one row per hour
    return progress_rates(samples, "h", "total").withColumn("rate", _by(c("rate")))


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is available into parquet and read that; appended rows only."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _replayed_in(t: Tables, runs: list[range], missing_update: str = "ignore") -> DataFrame:
    """The orders log through a stream: the batches of each run arrive one by one, and a run begins on the offsets and the table that the one before left."""
    log, path, offsets = orders_log(t), scratch(t.spark, "log"), scratch(t.spark, "offsets")
    state = T.StructType([f for f in log.schema if f.name not in ("batch_id", "_op", "_op_index")])
    target = VersionedTable(t.spark, scratch(t.spark, "state"), state)
    for batches in runs:
        target = VersionedTable(t.spark, target.path, state, ["o_orderkey"], missing_update, 4)  # what is applied is read from the folder
        for b in batches:
            append_batch(log, path, b)
            replay_stream(read_log_stream(t.spark, path, log.schema), target, ["o_orderkey"], offsets, missing_update).awaitTermination()
    return target.read()


def _stream_state(t: Tables, missing_update: str = "ignore") -> DataFrame:
    last = orders_log(t).agg(F.max("batch_id")).first()[0]
    return _replayed_in(t, [range(0 if last is None else last + 1)], missing_update)


def _paused(t: Tables) -> DataFrame:
    """Five batches, a pause, then the rest, on the same offsets."""
    return _replayed_in(t, [range(5), range(5, 9)])


def _metric_stream(t: Tables) -> DataFrame:
    """metric_windows over a stream: the runs arrive in three parts by time; a last run, a day later, closes every window before it.

    A row that comes later than the watermark allows is dropped: one is sent after the second part, a day before the first.
    """
    runs, path, out = query_runs(t), scratch(t.spark, "runs"), scratch(t.spark, "windows")
    lo, hi = runs.agg(F.min("started_at"), F.max("started_at")).first()
    if lo is None:
        return metric_windows(runs)
    span = (hi - lo) / 3
    late = runs.where(c("started_at") <= F.lit(lo)).limit(1).withColumn("started_at", F.lit(lo - timedelta(days=1)).cast("timestamp_ntz"))
    after = late.withColumn("started_at", F.lit(hi + timedelta(days=1)).cast("timestamp_ntz"))
    parts = [runs.where((c("started_at") >= F.lit(lo + span * i).cast("timestamp_ntz")) & (c("started_at") < F.lit(lo + span * (i + 1) if i < 2 else hi + span).cast("timestamp_ntz"))) for i in range(3)]
    for i, part in enumerate([*parts[:2], late, parts[2], after]):
        part.write.parquet(f"{path}/{i}")
        stream = t.spark.readStream.schema(runs.schema).option("recursiveFileLookup", "true").parquet(path)
        done = drained(metric_windows(stream), out)
    return done.where(c("start") <= F.lit(hi).cast("timestamp_ntz"))


def _run_stream(t: Tables) -> DataFrame:
    path = scratch(t.spark, "runs")
    query_runs(t).write.parquet(path)
    return t.spark.readStream.schema(query_runs(t).schema).parquet(path)


def _by(col: Column) -> Column:
    return F.round(col, 6)


_WINDOW = "time_bucket(INTERVAL '5 seconds', started_at)"
ALL = {
    "t1_micro_batch_replay": (lambda t: _stream_state(t), _replayed("ignore")),
    "t2_pause_and_resume": (_paused, _replayed("ignore")),
    "t3_latest_row_per_key": (lambda t: _stream_state(t, "upsert").select("o_orderkey", "o_orderstatus"), f"WITH r AS ({_replayed('upsert')}) SELECT o_orderkey, o_orderstatus FROM r"),
    "t4_metric_windows": (lambda t: _metric_stream(t).withColumn("total_ms", _by(c("total_ms"))), f"WITH {RUNS} SELECT {_WINDOW} AS start, query_name, count(*) AS n, count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed, round(sum(duration_ms), 6) AS total_ms, count(*) FILTER (duration_ms <= 10) AS le_10, count(*) FILTER (duration_ms <= 50) AS le_50, count(*) FILTER (duration_ms <= 100) AS le_100 FROM runs GROUP BY 1, 2"),
    "t5_progress_rate": (_progress, "WITH h AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, count(*) AS n FROM events GROUP BY 1), s AS (SELECT h, CAST(sum(n) OVER (ORDER BY h) AS BIGINT) AS total FROM h) SELECT h, total, round((total - lag(total) OVER (ORDER BY h)) / CAST(epoch(h) - epoch(lag(h) OVER (ORDER BY h)) AS DOUBLE), 6) AS rate FROM s"),
    "t6_timeouts": (lambda t: drained(classified(_run_stream(t), 60.0), scratch(t.spark, "timeouts")).groupBy("success", F.when(c("reason") == "timeout", "timeout").when(c("reason").isNotNull(), "other").alias("reason")).agg(F.count("*").alias("n")), f"WITH {RUNS} SELECT success AND duration_ms <= 60 AS success, CASE WHEN success AND duration_ms > 60 THEN 'timeout' WHEN reason IS NOT NULL THEN 'other' END AS reason, count(*) AS n FROM runs GROUP BY 1, 2"),
    "t7_timing_medians": (lambda t: timing_medians(query_runs(t)).withColumn("median_ms", _by(c("median_ms"))), f"WITH {RUNS} SELECT {_WINDOW} AS start, round(median(duration_ms), 6) AS median_ms FROM runs GROUP BY 1"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
