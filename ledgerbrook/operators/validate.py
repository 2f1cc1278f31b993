"""Result validation: tolerant comparison, schema equivalence, counts, convergence."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import canonical
from ..plans.tpch import SQL
from ..sources.batches import row_counts, scratch, write_snapshot
from ..sources.tables import NAMES
from .changelog import ORDERS_LOG, orders_log
from .relational import Tables
from .replay import _replayed, apply_changes, checkpoint_plan, net_rows, state_as_of, stored
from .runstats import RUNS, query_runs
from .scans import numbered

c = F.col
#: Kinds of failure.
NO_EXPECTED, NO_ANSWER, SCHEMA, ROWS, DATA, LENGTH = "no expected answer", "no answer", "schema mismatch", "row count mismatch", "data mismatch", "column length mismatch"
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
# What an expected type (first) also accepts (second), beside itself.
_ACCEPTS = {
    ("float", "double"),
    ("double", "decimal"), ("bigint", "decimal"),
    ("decimal", "bigint"), ("decimal", "int"), ("decimal", "double"),
    ("int", "bigint"),
    ("bigint", "int"), ("bigint", "tinyint"), ("bigint", "double"), ("bigint", "string"),
    ("timestamp", "timestamp_ntz"), ("timestamp_ntz", "timestamp"),
}


def kind_of(kind: T.DataType) -> str:
    """The type's name; decimals of every precision and texts of every width are alike."""
    return "decimal" if isinstance(kind, T.DecimalType) else "string" if isinstance(kind, T.StringType) else kind.simpleString()


def acceptable(expected: T.DataType, found: T.DataType) -> bool:
    e, f = kind_of(expected), kind_of(found)
    return e == f or (e, f) in _ACCEPTS


def schema_problems(expected: T.StructType, found: T.StructType) -> list[str]:
    """Positional, lenient and asymmetric: names may differ, found types must be acceptable for what is expected."""
    if len(expected) != len(found):
        return [f"{LENGTH}: {len(expected)} and {len(found)}"]
    return [f"{SCHEMA}: column {i}, {e.dataType.simpleString()} and {f.dataType.simpleString()}" for i, (e, f) in enumerate(zip(expected, found, strict=True)) if not acceptable(e.dataType, f.dataType)]


def close(expected: Column, found: Column, kind: T.DataType, tolerance: float) -> Column:
    """Equal text, or numbers within tolerance of the expected (at least 1e-12); nulls equal nulls."""
    same = canonical(expected, kind).eqNullSafe(canonical(found, kind))
    if kind_of(kind) in (*_NUMBERS, "decimal"):
        near = F.abs(found.try_cast("double") - expected.cast("double")) <= F.greatest(F.abs(expected.cast("double")) * tolerance, F.lit(1e-12))
        return same | F.coalesce(near, F.lit(False))
    return same


def compare_results(expected: DataFrame, found: DataFrame, order: list[str], tolerance: float = 0.05) -> DataFrame:
    """Every difference: position, column_name, expected, found, problem. Rows are matched by position in the given order."""
    problems = schema_problems(expected.schema, found.schema)
    spark = expected.sparkSession
    if problems:
        return spark.createDataFrame([(None, None, None, None, p) for p in problems], "position long, column_name string, expected string, found string, problem string")
    names = expected.columns
    found = found.toDF(*names)
    a, b = numbered(expected, order).alias("a"), numbered(found, order).alias("b")
    both = a.join(b, c("a.position") == c("b.position"), "full")
    missing = c("a.position").isNull() | c("b.position").isNull()
    cells = []
    for f in expected.schema:
        x, y = c(f"a.{f.name}"), c(f"b.{f.name}")
        bad = ~close(x, y, f.dataType, tolerance)
        cells.append(F.when(~missing & bad, F.struct(F.lit(f.name).alias("column_name"), canonical(x, f.dataType).alias("expected"), canonical(y, f.dataType).alias("found"), F.lit(DATA).alias("problem"))))
    absent = F.when(missing, F.struct(F.lit(None).cast("string").alias("column_name"), F.when(c("a.position").isNotNull(), "row").alias("expected"), F.when(c("b.position").isNotNull(), "row").alias("found"), F.lit(ROWS).alias("problem")))
    return both.select(F.coalesce("a.position", "b.position").alias("position"), F.explode(F.filter(F.array(absent, *cells), lambda x: x.isNotNull())).alias("x")).select("position", "x.*")


def same_rows(expected: DataFrame, found: DataFrame) -> tuple[int, bool]:
    """The rows of found, and whether expected holds the same ones, each as often, by one aggregation and without an order.

    Equal rows have no differences in any order; where they aren't equal, compare_results says what differs and by how much.
    """
    if expected.dtypes != found.dtypes:
        return found.count(), False
    side = lambda df, e: df.withColumn("__e", F.lit(e)).withColumn("__f", F.lit(1 - e))
    rows = side(expected, 1).unionByName(side(found, 0)).groupBy(*found.columns).agg(F.sum("__e").alias("__e"), F.sum("__f").alias("__f"))
    n, odd = rows.agg(F.coalesce(F.sum("__f"), F.lit(0)), F.count_if(c("__e") != c("__f"))).first()
    return n, odd == 0


def check_rows(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select("n", F.lit(expected).cast("long").alias("expected"), (c("n") == expected).alias("ok"))


def reconcile(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Row counts by table, side by side; tables on one side only fail."""
    return actual.select("table_name", c("n_rows").alias("found")).join(expected.select("table_name", c("n_rows").alias("expected")), "table_name", "full").withColumn("ok", c("found").eqNullSafe(c("expected")))


def compare_namespaces(spark, query: Callable[[], DataFrame], one: str, other: str, order: list[str], tolerance: float = 0.0) -> DataFrame:
    """The same query under two databases."""
    before = spark.catalog.currentDatabase()
    try:
        spark.catalog.setCurrentDatabase(one)
        a = query()
        spark.catalog.setCurrentDatabase(other)
        b = query()
    finally:
        spark.catalog.setCurrentDatabase(before)
    return compare_results(a, b, order, tolerance)


def stable_counts(runs: DataFrame) -> DataFrame:
    """Queries and whether every run returned as many rows."""
    return runs.groupBy("query_name").agg((F.min("n_rows") == F.max("n_rows")).alias("stable"), F.count("*").alias("n"))


def outcomes(attempts: DataFrame) -> DataFrame:
    """Passes, failures and the last reason per query."""
    return attempts.groupBy("query_name").agg(F.count_if("success").alias("passes"), F.count_if(~c("success")).alias("failures"), F.max_by("reason", F.when(~c("success"), F.struct("started_at", "run_id"))).alias("last_reason"))


def convergence(attempts: DataFrame, paused_at: Column) -> DataFrame:
    """The first iteration in which every query passes, and the seconds from the pause to its first probe."""
    whole = attempts.groupBy("iteration").agg(F.bool_and("success").alias("ok"), F.min("started_at").alias("sent"))
    first = whole.where("ok").agg(F.min(F.struct("iteration", "sent")).alias("x"))
    return first.select(c("x.iteration").alias("iteration"), (F.unix_timestamp(c("x.sent").cast("timestamp")) - F.unix_timestamp(paused_at.cast("timestamp"))).alias("seconds"))


def without_skipped(runs: DataFrame, skipped: DataFrame) -> DataFrame:
    return runs.join(skipped, "query_name", "left_anti")


def _broken(t: Tables) -> DataFrame:
    """Customers with a wrong balance (beyond 5 %) for every 100th, and a harmless one for every 101st."""
    x = c("c_acctbal")
    return t.customer.withColumn("c_acctbal", F.when(c("c_custkey") % 100 == 0, x * 1.5 + 10).when(c("c_custkey") % 101 == 0, x * 1.01).otherwise(x))


def _schemas(t: Tables) -> DataFrame:
    """Orders against variants of themselves: unacceptable columns, and how many cells differ where all are acceptable."""
    own = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    swap = lambda name, x: own.select(*(x.alias(name) if n == name else n for n in own.columns))
    found = {
        "same": own, "number_as_text": swap("o_custkey", c("o_custkey").cast("string")), "narrow_number": swap("o_custkey", c("o_custkey").cast("int")),
        "decimal_for_double": swap("o_totalprice", c("o_totalprice").cast("decimal(18,2)")), "tenth_is_off": swap("o_custkey", F.when(c("o_orderkey") % 10 == 0, c("o_custkey") * 2).otherwise(c("o_custkey")).cast("string")),
        "text_for_double": swap("o_totalprice", c("o_totalprice").cast("string")), "number_for_text": swap("o_orderstatus", F.length("o_orderstatus")), "flag_for_number": swap("o_custkey", c("o_custkey") > 0), "short": own.drop("o_custkey"),
    }
    out = None
    for name, df in found.items():
        problems = len(schema_problems(own.schema, df.schema))
        cells = F.lit(None).cast("long") if problems else F.count("*")
        row = compare_results(own, df, ["o_orderkey"], 1e-6).agg(cells.alias("differing")).select(F.lit(name).alias("variant"), F.lit(problems).alias("problems"), "differing")
        out = row if out is None else out.unionByName(row)
    return out


_SCHEMAS_SQL = """SELECT v.variant, v.problems, CASE WHEN v.problems = 0 THEN CASE WHEN v.variant = 'tenth_is_off' THEN n ELSE 0 END END AS differing
FROM (VALUES ('same', 0), ('number_as_text', 0), ('narrow_number', 0), ('decimal_for_double', 0), ('tenth_is_off', 0), ('text_for_double', 1), ('number_for_text', 1), ('flag_for_number', 1), ('short', 1)) AS v(variant, problems),
(SELECT count(*) AS n FROM orders WHERE o_orderkey % 10 = 0 AND abs(o_custkey) > greatest(abs(o_custkey) * 1e-6, 1e-12))"""


def _rendered(t: Tables) -> DataFrame:
    """Whole orders as canonical text: integers, text, floats and nulls, decimals, times, dates, flags."""
    df = t.orders.select("o_orderkey", "o_orderstatus", F.when(c("o_orderstatus") != "P", c("o_totalprice")).alias("price"), c("o_totalprice").cast("decimal(18,2)").alias("exact"), "o_orderdate", c("o_orderdate").cast("date").alias("day"), (c("o_custkey") % 2 == 0).alias("even"))
    return df.select(*(canonical(c(f.name), f.dataType).alias(f.name) for f in df.schema))


def _namespaces(t: Tables) -> DataFrame:
    one, other = (f"ledger_{kind}_{uuid.uuid4().hex[:8]}" for kind in ("trusted", "tested"))  # a warehouse may hold those of an earlier session
    for name, df in ((one, t.supplier), (other, t.supplier.withColumn("s_nationkey", F.when(c("s_suppkey") == 7, -1).otherwise(c("s_nationkey"))))):
        t.spark.sql(f"CREATE DATABASE {name}")
        df.write.saveAsTable(f"{name}.supplier_copy")
    out = stored(compare_namespaces(t.spark, lambda: t.spark.table("supplier_copy"), one, other, ["s_suppkey"]).select("position", "column_name", "found"), "compared")
    for name in (one, other):
        t.spark.sql(f"DROP DATABASE {name} CASCADE")
    return out


def _checkpoint(t: Tables) -> DataFrame:
    """State after batch 4 against the net row count of the log so far, with keys that live on."""
    log = orders_log(t)
    state = state_as_of(None, log, ["o_orderkey"], 4)
    found = state.agg(F.count("*").alias("n_rows")).select(F.lit("orders").alias("table_name"), "n_rows")
    net = net_rows(log.where("batch_id <= 4").withColumn("table_name", F.lit("orders")), ["table_name"]).withColumnRenamed("net", "n_rows")
    return reconcile(found, net)


#: Catalogue queries that run on the state at each checkpoint.
AT_CHECKPOINTS = ("h4_order_priority", "h13_customer_distribution", "h18_large_orders", "h22_sales_opportunity")
_REST = ["o_orderkey", "o_orderdate", "o_orderpriority"]


def state_results(t: Tables, state: DataFrame) -> dict[str, DataFrame]:
    """The state of orders, and the catalogue queries with it for orders; what no log changes comes from the table."""
    whole = state.join(t.orders.select(*_REST), "o_orderkey")
    out = {"orders": state}
    for query in AT_CHECKPOINTS:
        for name in NAMES:
            if re.search(rf"\b{name}\b", SQL[query]):
                (whole if name == "orders" else getattr(t, name)).createOrReplaceTempView(name)
        out[query] = t.spark.sql(SQL[query])
    return out


def checkpoint_bounds(log: DataFrame, every: int) -> dict[int, int]:
    """The last batch of each checkpoint."""
    return {r[0]: r[1] for r in checkpoint_plan(log, every).groupBy("checkpoint").agg(F.max("batch_id")).orderBy("checkpoint").collect()}  # one row per checkpoint


def write_checkpoints(t: Tables, log: DataFrame, path: str, every: int) -> None:
    """Snapshots of the results and their row counts at each checkpoint. The state goes on from the checkpoint before."""
    state, done = None, -1
    for checkpoint, bound in checkpoint_bounds(log, every).items():
        state = stored(apply_changes(state, log.where((c("batch_id") > done) & (c("batch_id") <= bound)), ["o_orderkey"]), "state")
        done = bound
        results = {k: write_snapshot(df, path, f"cp{checkpoint}", k) for k, df in state_results(t, state).items()}
        write_snapshot(row_counts(results), path, f"cp{checkpoint}", "row_counts")


def verify_checkpoints(t: Tables, log: DataFrame, path: str, every: int) -> DataFrame:
    """checkpoint, name, expected and found rows, differing cells and ok: the log replayed to each checkpoint at once, against the snapshots."""
    out = None
    for checkpoint, bound in checkpoint_bounds(log, every).items():
        found = {k: df if k == "orders" else stored(df, "found") for k, df in state_results(t, stored(state_as_of(None, log, ["o_orderkey"], bound), "state")).items()}  # the state is stored
        read = lambda k, at=checkpoint: t.spark.read.parquet(f"{path}/cp{at}/{k}")
        wrong = None
        for k, df in found.items():
            order = ["o_orderkey"] if k == "orders" else df.columns
            if same_rows(read(k), df)[1]:
                n = t.spark.createDataFrame([(k, 0)], "table_name string, differences long")
            else:
                n = compare_results(read(k), df, order, 1e-9).agg(F.count("*").alias("differences")).select(F.lit(k).alias("table_name"), "differences")
                n = stored(n, "compared")  # one plan for all of them would fill the driver
            wrong = n if wrong is None else wrong.unionByName(n)
        report = reconcile(row_counts(found), read("row_counts")).join(wrong, "table_name", "left")
        report = report.select(F.lit(checkpoint).cast("long").alias("checkpoint"), c("table_name").alias("name"), "expected", "found", "differences", (c("ok") & c("differences").eqNullSafe(0)).alias("ok"))
        out = report if out is None else out.unionByName(report)
    return out


def _verified(t: Tables) -> DataFrame:
    log, path = stored(orders_log(t), "log"), scratch(t.spark, "snapshots")
    write_checkpoints(t, log, path, 3)
    return verify_checkpoints(t, log, path, 3)


def _verified_sql() -> str:
    """Row counts of the queries over the state by SQL's own replay; nothing differs."""
    states, rows = [], []
    for k in range(3):
        states.append(f"s{k} AS (SELECT * FROM ({_replayed('ignore', f'batch_id <= {3 * k + 2}')}) JOIN (SELECT {', '.join(_REST)} FROM orders) USING (o_orderkey))")
        for name in ("orders", *AT_CHECKPOINTS):
            text = re.sub(r"\borders\b", f"s{k}", SQL.get(name, "SELECT * FROM orders"))
            rows.append(f"SELECT CAST({k} AS BIGINT) AS checkpoint, '{name}' AS name, count(*) AS expected, count(*) AS found, CAST(0 AS BIGINT) AS differences, true AS ok FROM ({text})")
    return f"WITH {', '.join(states)} {' UNION ALL '.join(rows)}"


ALL = {
    "v1_compare_results": (lambda t: compare_results(t.customer, _broken(t), ["c_custkey"]).groupBy("column_name", "problem").agg(F.count("*").alias("n"), F.min("position").alias("first")), "SELECT 'c_acctbal' AS column_name, 'data mismatch' AS problem, count(*) AS n, min(p) AS first FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) WHERE c_custkey % 100 = 0 AND abs(c_acctbal * 0.5 + 10) > abs(c_acctbal) * 0.05"),
    "v2_schema_equivalence": (_schemas, _SCHEMAS_SQL),
    "v6_namespaces": (_namespaces, "SELECT p AS position, 's_nationkey' AS column_name, '-1' AS found FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) WHERE s_suppkey = 7"),
    "v3_canonical_rendering": (lambda t: _rendered(t), "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN printf('%.6f', o_totalprice) ELSE 'NULL' END AS price, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS exact, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS even FROM orders"),
    "v4_row_count": (lambda t: check_rows(t.orders.join(t.customer, c("o_custkey") == c("c_custkey")), t.orders.count()), "SELECT count(*) AS n, (SELECT count(*) FROM orders) AS expected, count(*) = (SELECT count(*) FROM orders) AS ok FROM orders JOIN customer ON o_custkey = c_custkey"),
    "v5_v11_checkpoint_counts": (_checkpoint, f"WITH {ORDERS_LOG} SELECT 'orders' AS table_name, (SELECT count(*) FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 5 + 3 <= 4)) AS found, CAST(sum(CASE _op WHEN 'd' THEN -1 WHEN 'u' THEN 0 ELSE 1 END) AS BIGINT) AS expected, true AS ok FROM orders_log WHERE batch_id <= 4"),
    "v11_checkpoint_verification": (_verified, _verified_sql()),
    "v7_snapshot_rows": (lambda t: compare_results(t.supplier.orderBy("s_suppkey").limit(10), t.supplier.orderBy(c("s_suppkey").desc()).limit(10), ["s_suppkey"], 0.0).where("column_name = 's_suppkey'").select("position", "expected", "found"), "WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS p, s_suppkey AS k FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 10)), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS p, s_suppkey AS k FROM (SELECT * FROM supplier ORDER BY s_suppkey DESC LIMIT 10)) SELECT p AS position, CAST(a.k AS VARCHAR) AS expected, CAST(b.k AS VARCHAR) AS found FROM a JOIN b USING (p) WHERE a.k <> b.k"),
    "v8_stable_counts": (lambda t: stable_counts(t.events.select(c("event_type").alias("query_name"), (c("event_id") % F.when(c("event_type") == "click", 2).otherwise(1)).alias("n_rows"))), "SELECT event_type AS query_name, min(event_id % CASE WHEN event_type = 'click' THEN 2 ELSE 1 END) = max(event_id % CASE WHEN event_type = 'click' THEN 2 ELSE 1 END) AS stable, count(*) AS n FROM events GROUP BY event_type"),
    "v9_outcomes": (lambda t: outcomes(query_runs(t)), f"WITH {RUNS} SELECT query_name, count(*) FILTER (success) AS passes, count(*) FILTER (NOT success) AS failures, arg_max(reason, {{'a': started_at, 'b': run_id}}) FILTER (NOT success) AS last_reason FROM runs GROUP BY query_name"),
    "v10_convergence": (lambda t: convergence(query_runs(t).withColumn("iteration", F.floor(c("run_id") / 2)), F.lit("2024-01-01 00:00:00")), f"WITH {RUNS}, w AS (SELECT run_id // 2 AS iteration, bool_and(success) AS ok, min(started_at) AS sent FROM runs GROUP BY 1) SELECT iteration, CAST(floor(epoch(sent)) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) AS seconds FROM w WHERE ok ORDER BY iteration LIMIT 1"),
    "v12_skip_list": (lambda t: without_skipped(query_runs(t), t.events.where("event_type = 'view'").select(c("event_type").alias("query_name")).distinct()).groupBy("query_name").agg(F.count("*").alias("n")), f"WITH {RUNS} SELECT query_name, count(*) AS n FROM runs WHERE query_name <> 'view' GROUP BY query_name"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
