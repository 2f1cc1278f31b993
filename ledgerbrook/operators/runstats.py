"""Run analytics over a log of query executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored
from .relational import Tables
from .scans import carries, earlier, in_ranges, scan, with_carries

c = F.col


def query_runs(t: Tables) -> DataFrame:
    """The events as a run log: type as query name, value as duration, `error` as failure, user as worker."""
    e = t.events
    return e.select(c("event_id").alias("run_id"), (c("user_id") % 4).alias("worker_id"), c("event_type").alias("query_name"), c("ts").alias("started_at"), c("value").alias("duration_ms"), (c("event_type") != "error").alias("success"), F.when(c("event_type") == "error", F.concat(F.lit("failed "), c("event_id").cast("string"))).alias("reason"))


RUNS = "runs AS (SELECT event_id AS run_id, user_id % 4 AS worker_id, event_type AS query_name, ts AS started_at, value AS duration_ms, event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS reason FROM events)"


def ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Different values with the first and last rank of each (__first, __last, from 0) and the group's number of values (__n).

    Equal values are counted first. The rest is ranked within ranges of a sort, which are stored once, and shifted by the
    counts of the ranges before; so a group of any size is ranked by many tasks.
    """
    counts = df.where(c(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__k"))
    ranges = stored(counts.orderBy(*by, value).withColumn("__p", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("__p", *by).agg(F.sum("__k").alias("__s"))  # one row per range and group in it
    over = W.partitionBy(*by)
    shifts = sums.select(*(c(x).alias(f"__by_{x}") for x in by), c("__p").alias("__q"), (F.sum("__s").over(over.orderBy("__p")) - c("__s")).alias("__b"), F.sum("__s").over(over).alias("__n"))
    here = c("__p") == c("__q")
    for x in by:
        here = here & c(x).eqNullSafe(c(f"__by_{x}"))
    within = F.sum("__k").over(W.partitionBy("__p", *by).orderBy(value))
    out = ranges.join(shifts, here).withColumn("__last", within + c("__b") - 1).withColumn("__first", c("__last") - c("__k") + 1)
    return out.select(*by, value, "__k", "__last", "__first", "__n")


def percentiles(df: DataFrame, by: list[str], value: str, ps: list[float], nearest: bool = False) -> DataFrame:
    """Percentiles per group, one column `p<percent>` each.

    Rank p / 100 * (n - 1), to four places, since floating point misses whole ranks by less; between two ranks the mean of both
    values, or with nearest the value at the rounded rank.
    """
    r = ranked(df, by, value)
    out = []
    for p in ps:
        at = F.round(F.lit(p / 100) * (c("__n") - 1), 4)
        lo, hi = (F.floor(at + 0.5), F.floor(at + 0.5)) if nearest else (F.floor(at), F.ceil(at))
        has = lambda x: F.max(F.when((c("__first") <= x) & (x <= c("__last")), c(value)))
        out.append(((has(lo) + has(hi)) / 2).alias(f"p{p:g}"))
    return r.groupBy(*by).agg(*out)


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, least, most and number of values; groups without a value have no row."""
    middle = percentiles(df, by, value, [50]).select(*(c(x).alias(f"__by_{x}") for x in by), c("p50").alias("median"))
    rest = df.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("iterations"))
    same = F.lit(True)
    for x in by:
        same = same & c(x).eqNullSafe(c(f"__by_{x}"))
    return rest.join(middle, same).select(*by, "median", "least", "most", "iterations")


def without_outliers(df: DataFrame, by: list[str], value: str, width: float = 1.5) -> DataFrame:
    """Rows within `width` interquartile ranges of the quartiles; all rows of a group of which none would be left."""
    q = percentiles(df, by, value, [25, 75])
    spread = (c("p75") - c("p25")) * width
    marked = df.join(q, by).withColumn("__in", c(value).between(c("p25") - spread, c("p75") + spread))
    any_in = marked.groupBy(*by).agg(F.bool_or("__in").alias("__any"))
    return marked.join(any_in, by).where("__in or not __any").select(*df.columns)


def status_rollup(df: DataFrame, by: list[str]) -> DataFrame:
    """failed if any run failed, and the first failure's reason."""
    return df.groupBy(*by).agg(F.when(F.bool_and("success"), "passed").otherwise("failed").alias("status"), F.min_by("reason", F.when(~c("success"), F.struct("started_at", "run_id"))).alias("first_reason"))


def throughput(parallel: int, queries: int, seconds: Column, scale: float, sets: int) -> Column:
    return parallel * queries * 3600 / seconds * scale * sets


def counter_rates(df: DataFrame, by: list[str], at: str, counter: str) -> DataFrame:
    """Rate per second between samples of a cumulative counter; a counter that falls gives 0. A group of any size is many tasks' work."""
    rows = scan(df, by, [at, counter], {"__at": ("lag", c(at)), "__counter": ("lag", c(counter))})
    seconds = F.unix_timestamp(c(at).cast("timestamp")) - F.unix_timestamp(c("__at").cast("timestamp"))
    return rows.withColumn("rate", F.greatest(c(counter) - c("__counter"), F.lit(0)) / F.nullif(seconds, F.lit(0))).drop("__at", "__counter")


def wait_share(df: DataFrame, by: list[str]) -> DataFrame:
    """100 * wait / (wait + apply + linger), as a ratio of sums."""
    return df.groupBy(*by).agg((100 * F.sum("wait") / F.nullif(F.sum(c("wait") + c("apply") + c("linger")), F.lit(0))).alias("wait_share"))


def outcome(failed: Column, converged: Column, stopped: Column) -> Column:
    """The one outcome of a run: stopped before failed before unconverged before passed."""
    return F.when(stopped, "stopped").when(failed, "failed").when(~converged, "not converged").otherwise("passed")


_ATTRIBUTES = "array<struct<key:string,type:tinyint,str:string,int:bigint,double:double,bool:boolean,bytes:binary,ser:binary>>"
_POINT = f"time_unix_nano:bigint,start_time_unix_nano:bigint,flags:bigint,attributes:{_ATTRIBUTES}"
_NUMBER = f"array<struct<{_POINT},int_value:bigint,double_value:double>>"
_HISTOGRAM = f"array<struct<{_POINT},count:bigint,sum:double,bucket_counts:array<bigint>,explicit_bounds:array<double>,min:double,max:double>>"
_METRIC = f"struct<name:string,description:string,unit:string,metric_type:tinyint,aggregation_temporality:int,is_monotonic:boolean,numbers:{_NUMBER},histograms:{_HISTOGRAM}>"
_OWNER = f"attributes:{_ATTRIBUTES},dropped_attributes_count:bigint"
#: Telemetry as it arrives: resources, their scopes, their metrics, and the points of each. Field names are fixed values, of the wire format.
TELEMETRY = f"struct<resource:struct<schema_url:string,{_OWNER}>,scopes:array<struct<scope:struct<name:string,version:string,{_OWNER}>,schema_url:string,metrics:array<{_METRIC}>>>>"


def flattened(df: DataFrame, column: str) -> DataFrame:
    """Nested telemetry (JSON of TELEMETRY) as one row per point, gauges, sums and histograms alike, parsed once.

    data_number or data_histogram is set, as the point's kind is; resource, scope and the point's own attributes stay
    lists. A metric without points gives no row. Times are in UTC.
    """
    scopes = df.select(F.inline(F.array(F.from_json(column, TELEMETRY)))).select("resource", F.explode("scopes").alias("s"))  # inline: fields are taken from one parse
    metrics = scopes.select("resource", "s.scope", "s.schema_url", F.explode("s.metrics").alias("m"))
    kinds = {"data_number": ("numbers", ("int_value", "double_value")), "data_histogram": ("histograms", ("count", "sum", "bucket_counts", "explicit_bounds", "min", "max"))}
    common = ("time_unix_nano", "start_time_unix_nano", "flags", "attributes")
    types = {k: next(f.dataType.elementType for f in metrics.schema["m"].dataType if f.name == name) for k, (name, _) in kinds.items()}

    def points(kind: str) -> Column:
        """The points of a kind, each with its data and with null for the other kind's."""
        def point(p: Column) -> Column:
            own = [F.struct(*(p[x].alias(x) for x in fields)) if k == kind else F.lit(None).cast(T.StructType([types[k][x] for x in fields])) for k, (_, fields) in kinds.items()]
            return F.struct(*(p[x].alias(x) for x in common), *(x.alias(k) for x, k in zip(own, kinds, strict=True)))

        return F.coalesce(F.transform(c("m")[kinds[kind][0]], point), F.array())

    nano = lambda x: F.timestamp_micros(F.floor(c(x) / 1000))
    about = [c(f"m.{x}").alias(x) for x in ("metric_type", "name", "description", "unit", "aggregation_temporality", "is_monotonic")]
    rows = metrics.select("resource", "scope", "schema_url", *about, F.explode(F.concat(*map(points, kinds))).alias("q"))
    return rows.select("resource", "scope", "schema_url", *(x for x in rows.columns[3:-1]), nano("q.time_unix_nano").alias("time"), nano("q.start_time_unix_nano").alias("start_time"), "q.flags", "q.attributes", "q.data_number", "q.data_histogram")


def attribute(attributes: Column, key: str, kind: str = "str") -> Column:
    """The value of a key in an attribute list, null where it is absent; of repeated keys the first counts."""
    return F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))[kind]


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Counts by bucket: bucket i holds values up to bounds[i], the last one all above."""
    bucket = F.when(c(value) <= bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        bucket = bucket.when(c(value) <= b, i)
    return df.groupBy(*by, bucket.otherwise(len(bounds)).alias("bucket")).agg(F.count("*").alias("n"))


def parameter_sets(df: DataFrame, name: str, order: str) -> DataFrame:
    """df plus set_no (the i-th variant of each query is in set i) and even (whether all queries have as many). A query of any number of variants is many tasks' work."""
    rows = scan(df, [name], [order], {"set_no": ("sum", F.lit(1).cast("long"))}).withColumn("set_no", c("set_no").cast("int"))
    even = df.groupBy(name).agg(F.count("*").alias("k")).agg((F.min("k") == F.max("k")).alias("even"))
    return rows.crossJoin(F.broadcast(even))  # one row


def queue_waits(df: DataFrame, by: list[str]) -> DataFrame:
    """df (started_at, duration_ms, run_id) plus wait_ms and depth: each worker serves its runs one after the other.

    A run waits while the time the runs before it took exceeds the time that has passed: with X the sum of durations before
    minus the arrival, the wait is X less the smallest X so far. Depth counts the runs of the second in which it arrives, so far.
    A worker's log is cut in ranges: a range goes on from the sum of those before it and from the smallest X in them.
    """
    order = ["started_at", "run_id"]
    timed = df.withColumn("__at", F.unix_micros(c("started_at").cast("timestamp")) / 1000).withColumn("__second", F.date_trunc("second", "started_at"))
    ranges = in_ranges(timed, by, order)
    w = W.partitionBy("__p", *by).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)

    def with_x(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__x", F.coalesce(F.sum("duration_ms").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) - c("__at"))

    shift = F.coalesce(c("__shift"), F.lit(0.0))
    begins = carries(ranges, by, {"__sum": F.sum("duration_ms"), "__least": F.min("__x")}, {"__shift": F.sum("__sum").over(earlier()), "__low": F.min(shift + c("__least")).over(earlier())}, with_x)
    arrived = carries(ranges, [*by, "__second"], {"__n": F.count("*")}, {"__before": F.sum("__n").over(earlier())})
    rows = with_carries(with_carries(with_x(ranges), by, begins), [*by, "__second"], arrived)
    wait = c("__x") + shift - F.least(F.min("__x").over(upto) + shift, c("__low"))
    depth = F.row_number().over(W.partitionBy("__p", *by, "__second").orderBy(*order)) + F.coalesce("__before", F.lit(0))
    return rows.withColumn("wait_ms", wait).withColumn("depth", depth.cast("int")).select(*df.columns, "wait_ms", "depth")


def leaderboard(df: DataFrame) -> DataFrame:
    return df.withColumn("place", F.rank().over(W.orderBy("duration", "p99")))  # one row per run


def r6(x) -> Column:
    return F.round(x, 6)


def _sql_percentile(by: str, p: float, nearest: bool = False) -> str:
    at = f"round({p / 100}::DOUBLE * (n - 1), 4)"
    lo, hi = (f"floor({at} + 0.5)", f"floor({at} + 0.5)") if nearest else (f"floor({at})", f"ceil({at})")
    return f"round((max(CASE WHEN r = {lo} THEN duration_ms END) + max(CASE WHEN r = {hi} THEN duration_ms END)) / 2, 6)"


_RANKED = f"WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY duration_ms) - 1 AS r, count(*) OVER (PARTITION BY query_name) AS n FROM runs)"
_Q = f"{_RANKED}, q AS (SELECT query_name, {_sql_percentile('', 25)} AS a, {_sql_percentile('', 75)} AS z FROM k GROUP BY query_name)"


def _telemetry() -> Column:
    """An event as a message with two scopes, a gauge of two points, an empty metric and a histogram."""
    n = c("event_id")
    kept = F.array(F.struct(F.lit("worker").alias("key"), F.lit(1).alias("type"), F.concat(F.lit("w"), (n % 5).cast("string")).alias("str"), F.lit(None).cast("bigint").alias("int")), F.struct(F.lit("tries").alias("key"), F.lit(2).alias("type"), F.lit(None).cast("string").alias("str"), (n % 4).alias("int")))
    point = lambda k: F.struct((n * 1_000_000_000 + k).alias("time_unix_nano"), kept.alias("attributes"), (n + k).alias("int_value"))
    spread = F.struct((n * 1_000_000_000).alias("time_unix_nano"), (n % 10 + 1).alias("count"), c("value").alias("sum"), F.array(F.lit(1).cast("bigint"), n % 10).alias("bucket_counts"), F.array(F.lit(10.0)).alias("explicit_bounds"))
    gauge = F.struct(F.lit("gauge").alias("name"), F.lit(1).alias("metric_type"), F.array(point(0), point(1)).alias("numbers"))
    hist = F.struct(F.lit("spread").alias("name"), F.lit(3).alias("metric_type"), F.array(spread).alias("histograms"))
    empty = F.struct(F.lit("none").alias("name"), F.lit(2).alias("metric_type"))
    as_json = lambda *m: F.concat(F.lit("["), F.concat_ws(",", *(F.to_json(x) for x in m)), F.lit("]"))
    scope = lambda name, *m: F.concat(F.lit('{"scope":{"name":"'), name, F.lit('"},"metrics":'), as_json(*m), F.lit("}"))
    return F.concat(F.lit('{"resource":{"schema_url":"r'), (n % 3).cast("string"), F.lit('"},"scopes":['), scope(c("event_type"), gauge, empty), F.lit(","), scope(F.lit("other"), hist), F.lit("]}"))


def _points(t: Tables) -> DataFrame:
    rows = flattened(t.events.select(_telemetry().alias("j")), "j")
    by = [c("resource.schema_url").alias("resource"), c("scope.name").alias("scope"), "name", "metric_type", attribute(c("attributes"), "worker").alias("worker")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("data_number.int_value").alias("ints"), F.sum(attribute(c("attributes"), "tries", "int")).alias("tries"), F.sum("data_histogram.count").alias("counted"), r6(F.sum("data_histogram.sum")).alias("total"), F.sum(F.get("data_histogram.bucket_counts", F.lit(1))).alias("above"), F.max(F.unix_seconds("time")).alias("last"))


_POINTS = """SELECT 'r' || (event_id % 3) AS resource, event_type AS scope, 'gauge' AS name, 1 AS metric_type, 'w' || (event_id % 5) AS worker, 2 * count(*) AS n, CAST(sum(2 * event_id + 1) AS BIGINT) AS ints, CAST(sum(2 * (event_id % 4)) AS BIGINT) AS tries, CAST(NULL AS BIGINT) AS counted, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS BIGINT) AS above, max(event_id) AS last FROM events GROUP BY 1, 2, 5
UNION ALL SELECT 'r' || (event_id % 3), 'other', 'spread', 3, NULL, count(*), NULL, NULL, CAST(sum(event_id % 10 + 1) AS BIGINT), round(sum(value), 6), CAST(sum(event_id % 10) AS BIGINT), max(event_id) FROM events GROUP BY 1"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(c(n)) for n in names})


_WORKERS = f"WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY duration_ms) - 1 AS r, count(*) OVER (PARTITION BY worker_id) AS n FROM runs)"


def _board(t: Tables) -> DataFrame:
    runs = query_runs(t)
    tail = percentiles(runs, ["worker_id"], "duration_ms", [99]).withColumnRenamed("p99", "tail")
    return _rounded(leaderboard(runs.groupBy("worker_id").agg(F.sum("duration_ms").alias("duration")).join(tail, "worker_id").withColumnRenamed("tail", "p99")).select("worker_id", "place", "p99"), "p99")


def _queues(t: Tables) -> DataFrame:
    """Runs twenty thousand times closer together, so that workers do queue."""
    runs = query_runs(t).withColumn("started_at", F.timestamp_micros(F.floor(F.unix_micros(c("started_at").cast("timestamp")) / 20_000)).cast("timestamp_ntz"))
    waits = queue_waits(runs, ["worker_id"]).withColumn("wait_ms", F.round("wait_ms", 3))
    return _rounded(percentiles(waits, ["worker_id"], "wait_ms", [50, 95]).join(waits.groupBy("worker_id").agg(F.max("depth").cast("long").alias("depth")), "worker_id"), "p50", "p95")


_QUEUES = f"""WITH {RUNS}, a AS (SELECT *, CAST(floor(epoch_us(started_at) / 20000) AS BIGINT) AS us FROM runs),
x AS (SELECT *, coalesce(sum(duration_ms) OVER (PARTITION BY worker_id ORDER BY us, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - us / 1000 AS x, row_number() OVER (PARTITION BY worker_id, us // 1000000 ORDER BY us, run_id) AS depth FROM a),
w AS (SELECT worker_id, depth, round(x - min(x) OVER (PARTITION BY worker_id ORDER BY us, run_id ROWS UNBOUNDED PRECEDING), 3) AS wait FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY wait) - 1 AS r, count(*) OVER (PARTITION BY worker_id) AS n FROM w)
SELECT worker_id, {_sql_percentile('', 50).replace('duration_ms', 'wait')} AS p50, {_sql_percentile('', 95).replace('duration_ms', 'wait')} AS p95, max(depth) AS depth FROM k GROUP BY worker_id"""


def _waits(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", c("l_quantity").alias("wait"), (c("l_discount") * 100).alias("apply"), (c("l_tax") * 100).alias("linger"))


ALL = {
    "m1_midpoint_percentile": (lambda t: _rounded(percentiles(query_runs(t), ["query_name"], "duration_ms", [25, 50, 99]), "p25", "p50", "p99"), f"{_RANKED} SELECT query_name, " + ", ".join(f"{_sql_percentile('', p)} AS p{p}" for p in (25, 50, 99)) + " FROM k GROUP BY query_name"),
    "m2_summary": (lambda t: _rounded(summary(query_runs(t), ["query_name"], "duration_ms"), "median", "least", "most"), f"WITH {RUNS} SELECT query_name, round(median(duration_ms), 6) AS median, round(min(duration_ms), 6) AS least, round(max(duration_ms), 6) AS most, count(*) AS iterations FROM runs GROUP BY query_name"),
    "m3_without_outliers": (lambda t: without_outliers(query_runs(t), ["query_name"], "duration_ms").groupBy("query_name").agg(F.count("*").alias("n"), r6(F.max("duration_ms")).alias("most")), f"{_Q} SELECT query_name, count(*) AS n, round(max(duration_ms), 6) AS most FROM runs JOIN q USING (query_name) WHERE duration_ms BETWEEN a - 1.5 * (z - a) AND z + 1.5 * (z - a) GROUP BY query_name"),
    "m4_tail_percentiles": (lambda t: _rounded(percentiles(query_runs(t).withColumn("all", F.lit("all")), ["all"], "duration_ms", [90, 95, 99]), "p90", "p95", "p99"), f"WITH {RUNS}, k AS (SELECT *, row_number() OVER (ORDER BY duration_ms) - 1 AS r, count(*) OVER () AS n FROM runs) SELECT 'all' AS \"all\", " + ", ".join(f"{_sql_percentile('', p)} AS p{p}" for p in (90, 95, 99)) + " FROM k"),
    "m5_status_rollup": (lambda t: status_rollup(query_runs(t), ["query_name"]), f"WITH {RUNS} SELECT query_name, CASE WHEN bool_and(success) THEN 'passed' ELSE 'failed' END AS status, arg_min(reason, {{'a': started_at, 'b': run_id}}) FILTER (NOT success) AS first_reason FROM runs GROUP BY query_name"),
    "m6_throughput": (lambda t: query_runs(t).agg(r6(throughput(2, 5, F.sum("duration_ms") / 1000, 0.01, 3)).alias("x")), f"WITH {RUNS} SELECT round(2 * 5 * 3600 / (sum(duration_ms) / 1000) * 0.01 * 3, 6) AS x FROM runs"),
    "m7_queries_per_second": (lambda t: query_runs(t).agg(r6(F.count("*") / F.sum("duration_ms") * 1000).alias("qps"), r6(F.count("*") / F.sum("duration_ms") * 1000 / 8).alias("per_core")), f"WITH {RUNS} SELECT round(count(*) / sum(duration_ms) * 1000, 6) AS qps, round(count(*) / sum(duration_ms) * 1000 / 8, 6) AS per_core FROM runs"),
    "m8_nearest_rank": (lambda t: _rounded(percentiles(query_runs(t), ["query_name"], "duration_ms", [50, 99], nearest=True), "p50", "p99"), f"{_RANKED} SELECT query_name, {_sql_percentile('', 50, True)} AS p50, {_sql_percentile('', 99, True)} AS p99 FROM k GROUP BY query_name"),
    "m9_counter_rates": (lambda t: _rounded(counter_rates(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id").groupBy("user_id").agg(F.sum("rate").alias("rate"), F.count("rate").alias("n")), "rate"), "WITH x AS (SELECT user_id, greatest(event_id - lag(event_id) OVER w, 0) / nullif(CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER w)) AS BIGINT), 0) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, round(sum(rate), 6) AS rate, count(rate) AS n FROM x GROUP BY user_id"),
    "m10_wait_share": (lambda t: _rounded(wait_share(_waits(t), ["l_returnflag"]), "wait_share"), "SELECT l_returnflag, round(100 * sum(l_quantity) / nullif(sum(l_quantity + l_discount * 100 + l_tax * 100), 0), 6) AS wait_share FROM lineitem GROUP BY l_returnflag"),
    "m11_load_rate": (lambda t: t.events.agg((F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))).alias("s"), F.count("*").alias("n")).select("s", r6(c("n") / F.nullif("s", F.lit(0))).alias("rate")), "SELECT CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS s, round(count(*) / nullif(CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT), 0), 6) AS rate FROM events"),
    "m12_outcome": (lambda t: query_runs(t).groupBy("worker_id", "query_name").agg(F.count_if(~c("success")).alias("f"), F.count("*").alias("n")).select("worker_id", "query_name", outcome(c("f") > 0, c("n") > 490, c("worker_id") == 3).alias("outcome")), f"WITH {RUNS} SELECT worker_id, query_name, CASE WHEN worker_id = 3 THEN 'stopped' WHEN bool_or(NOT success) THEN 'failed' WHEN count(*) <= 490 THEN 'not converged' ELSE 'passed' END AS outcome FROM runs GROUP BY worker_id, query_name"),
    "m13_flattened": (_points, _POINTS),
    "m14_histogram": (lambda t: histogram(query_runs(t), ["query_name"], "duration_ms", [10.0, 50.0, 100.0]), f"WITH {RUNS} SELECT query_name, CASE WHEN duration_ms <= 10 THEN 0 WHEN duration_ms <= 50 THEN 1 WHEN duration_ms <= 100 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM runs GROUP BY 1, 2"),
    "m15_parameter_sets_whole": (lambda t: parameter_sets(t.part, "p_brand", "p_partkey").select("p_partkey", "set_no", "even"), "WITH p AS (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS set_no, count(*) OVER (PARTITION BY p_brand) AS k FROM part) SELECT p_partkey, set_no, (SELECT min(k) = max(k) FROM p) AS even FROM p"),
    "m16_leaderboard": (_board, f"{_WORKERS} SELECT worker_id, CAST(rank() OVER (ORDER BY duration, p99) AS INT) AS place, round(p99, 6) AS p99 FROM (SELECT worker_id, sum(duration_ms) AS duration, {_sql_percentile('', 99)} AS p99 FROM k GROUP BY worker_id)"),
    "m17_queue_waits": (_queues, _QUEUES),
    "m18_total_duration": (lambda t: query_runs(t).agg(F.round(F.sum("duration_ms"), 4).alias("total")), f"WITH {RUNS} SELECT round(sum(duration_ms), 4) AS total FROM runs"),
}


ALL["m15_parameter_sets"] = (
    lambda t: parameter_sets(query_runs(t).where("success"), "query_name", "run_id").groupBy("set_no").agg(F.count("*").alias("n"), F.bool_and("even").alias("even")),
    f"WITH {RUNS}, p AS (SELECT CAST(row_number() OVER (PARTITION BY query_name ORDER BY run_id) AS INT) AS set_no, count(*) OVER (PARTITION BY query_name) AS k FROM runs WHERE success) SELECT set_no, count(*) AS n, (SELECT min(k) = max(k) FROM p) AS even FROM p GROUP BY set_no")


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
