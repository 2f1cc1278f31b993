"""A whole database replayed to checkpoints: every order-processing query there against its snapshots, failures by query."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import Tables
from ..operators.replay import apply_changes, checkpoint_plan
from ..operators.validate import NO_EXPECTED, ROWS, compare_results, same_rows
from ..sources.batches import manifest, read_manifest, read_row_counts, write_manifest, write_row_counts, write_snapshot
from ..sources.scratch import scratch, stored
from .tpch import PARTSUPP, SQL

c = F.col
#: Keyed tables, and the number in each that updates change; dimensions are created at once and stay.
KEYS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"]}
CHANGED = {"orders": "o_totalprice", "lineitem": "l_quantity", "customer": "c_acctbal", "part": "p_retailprice", "supplier": "s_acctbal"}
#: Queries that run at once: each is a few small jobs, which leave a cluster idle one by one.
AT_ONCE = 8


def database_log(t: Tables, name: str) -> DataFrame:
    """A table's log by arithmetic on its first key: creates in batches 0 to 2, one update in seven two batches later, one delete in eleven three batches later."""
    rows, key = getattr(t, name), c(KEYS[name][0])
    tagged = lambda df, batch, op, rank: df.withColumn("batch_id", batch.cast("long")).withColumn("_op", F.lit(op)).withColumn("_op_index", c("batch_id") * 3 + rank)
    if name not in CHANGED:
        return tagged(rows, F.lit(0), "c", 0)
    updates = rows.where(key % 7 == 0).withColumn(CHANGED[name], c(CHANGED[name]) + 1)
    deletes = rows.where(key % 11 == 5).select(*(c(f.name) if f.name in KEYS[name] else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))
    return tagged(rows, key % 3, "c", 0).unionByName(tagged(updates, key % 3 + 2, "u", 1)).unionByName(tagged(deletes, key % 3 + 3, "d", 2))


def state_sql(name: str, columns: list[str], bound: int) -> str:
    """The table after batch `bound`, as SQL has it."""
    k = KEYS[name][0]
    if name not in CHANGED:
        return f"SELECT * FROM {name}"
    shown = [f"CASE WHEN {k} % 7 = 0 AND {k} % 3 + 2 <= {bound} THEN {x} + 1 ELSE {x} END AS {x}" if x == CHANGED[name] else x for x in columns]
    return f"SELECT {', '.join(shown)} FROM {name} WHERE {k} % 3 <= {bound} AND NOT ({k} % 11 = 5 AND {k} % 3 + 3 <= {bound})"


def bounds(logs: dict[str, DataFrame], every: int) -> dict[int, int]:
    """The last batch of each checkpoint, over the batches of all logs."""
    batches = None
    for log in logs.values():
        batches = log.select("batch_id") if batches is None else batches.unionByName(log.select("batch_id"))
    plan = checkpoint_plan(batches.distinct(), every).groupBy("checkpoint").agg(F.max("batch_id").alias("last"))
    return {r.checkpoint: r.last for r in plan.orderBy("checkpoint").collect()}  # one row per checkpoint


def results(spark, states: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every order-processing query over the states; views are resolved here and now. What five of them derive first, all lines by part and supplier, is stored for all."""
    for name, df in states.items():
        df.createOrReplaceTempView(name)
    if any(PARTSUPP in text for text in SQL.values()):
        stored(spark.sql(f"WITH {PARTSUPP} SELECT * FROM partsupp"), "partsupp").createOrReplaceTempView("partsupp")
    return {query: spark.sql(text.replace(f"WITH {PARTSUPP},", "WITH").replace(f"WITH {PARTSUPP}", "")) for query, text in SQL.items()}


def write_checkpoints(t: Tables, logs: dict[str, DataFrame], path: str, every: int, scenario: str = "database") -> None:
    """Snapshots of all results at each checkpoint, the tables' row counts and a manifest. States go on from the snapshots of the checkpoint before."""
    states, done = dict.fromkeys(logs), -1
    for checkpoint, bound in bounds(logs, every).items():
        snapshot = lambda name, df, at=checkpoint: (name, write_snapshot(df, path, f"cp{at}", name))
        states = dict(_each(t.spark, {n: apply_changes(states[n], log.where((c("batch_id") > done) & (c("batch_id") <= bound)), KEYS[n]) for n, log in logs.items()}, snapshot))
        done = bound
        _each(t.spark, results(t.spark, states), snapshot)
        write_row_counts(states, path, f"cp{checkpoint}")
    write_manifest(t.spark, path, scenario, every)


def verify_checkpoints(t: Tables, logs: dict[str, DataFrame], path: str, every: int, tolerance: float = 1e-6) -> DataFrame:
    """checkpoint, name, found rows, differences, problem (null if there is none) and ok, for each table and query at each checkpoint.

    The logs are replayed to each checkpoint at once. A query without a snapshot, with other columns, other rows or cells beyond the tolerance
    fails by itself; so does a table whose row count isn't the one noted. One row per query and checkpoint is all that reaches the driver.
    """
    report = []
    for checkpoint, bound in bounds(logs, every).items():
        states = _stored(t.spark, {n: apply_changes(None, log.where(c("batch_id") <= bound), KEYS[n]) for n, log in logs.items()}, "state")
        noted = {r.table_name: r.n_rows for r in read_row_counts(t.spark, path, f"cp{checkpoint}").collect()}
        there = {r["query"] for r in manifest(t.spark, path).where(c("checkpoint") == f"cp{checkpoint}").collect()}

        def checked(query: str, df: DataFrame, at=checkpoint) -> tuple:
            found = df if query in KEYS else stored(df, "found")  # states are stored
            if query not in there:
                return at, query, found.count(), None, NO_EXPECTED
            expected = t.spark.read.schema(found.schema).parquet(f"{path}/cp{at}/{query}") if found.columns == (own := t.spark.read.parquet(f"{path}/cp{at}/{query}")).columns else own
            n, same = same_rows(expected, found)
            if same:
                return at, query, n, 0, ROWS if query in KEYS and noted.get(query) != n else None
            wrong = compare_results(expected, found, KEYS.get(query, found.columns), tolerance).agg(F.count("*").alias("n"), F.min("problem").alias("problem")).first()
            problem = wrong.problem or (ROWS if query in KEYS and noted.get(query) != n else None)
            return at, query, n, wrong.n, problem

        report += _each(t.spark, states | results(t.spark, states), checked)
    return t.spark.createDataFrame(report, "checkpoint long, name string, found long, differences long, problem string").withColumn("ok", c("problem").isNull())


def _each(spark, named: dict[str, DataFrame], f) -> list:
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda x: f(*x)), named.items()))


def _stored(spark, named: dict[str, DataFrame], label: str) -> dict[str, DataFrame]:
    return dict(_each(spark, named, lambda name, df: (name, stored(df, label))))


def _verified(t: Tables) -> DataFrame:
    logs, path = _stored(t.spark, {n: database_log(t, n) for n in KEYS}, "log"), scratch(t.spark, "snapshots")
    write_checkpoints(t, logs, path, 2)
    interval = read_manifest(t.spark, path).select("interval").distinct()
    return verify_checkpoints(t, logs, path, interval.first()[0]).select("checkpoint", "name", "found", "differences", "ok")


_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "nation": [], "region": [],
}


def _verified_sql() -> str:
    """The rows of every query over the states as SQL has them; nothing differs."""
    states, rows = [], []
    for k in range(3):
        states += [f"s{k}_{n} AS MATERIALIZED ({state_sql(n, _COLUMNS[n], 2 * k + 1)})" for n in KEYS]
        for name in (*KEYS, *SQL):
            text = re.sub(rf"\b({'|'.join(KEYS)})\b", rf"s{k}_\1", SQL.get(name, f"SELECT * FROM {name}"))
            rows.append(f"SELECT CAST({k} AS BIGINT) AS checkpoint, '{name}' AS name, count(*) AS found, CAST(0 AS BIGINT) AS differences, true AS ok FROM ({text})")
    return f"WITH {', '.join(states)} {' UNION ALL '.join(rows)}"


ALL = {"v11_whole_database": (_verified, _verified_sql())}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
