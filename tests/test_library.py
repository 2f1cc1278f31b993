import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from ledgerbrook.operators import changelog, relational, replay, runstats, validate
from ledgerbrook.functions import scalar
from ledgerbrook.plans import tpch
from ledgerbrook.sources import batches
from ledgerbrook.streaming import replay as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows_of(names, rows):
    cut = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(str([cut(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("module", [relational, scalar, replay, runstats])
def test_queries_equal_their_sql(spark, oracle, module):
    sql = module.oracle_sql()
    for name, run in module.queries().items():
        df = run(spark, SF)
        want = oracle.execute(sql[name])
        assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in want.description], want.fetchall()), name


def test_every_query_has_a_callable_and_no_stray_sql():
    q, o = entry.queries(), entry.oracle_sql()
    assert all(map(callable, q.values())) and set(o) <= set(q) and len(q) > 200


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def sequential(log, policy):
    state = {}
    for op, k, v in log:
        if op == "d":
            state.pop(k, None)
        elif op == "u":
            if k in state or policy == "upsert":
                state[k] = v
        else:
            state[k] = v
    return state


@pytest.mark.parametrize("policy", ["ignore", "upsert"])
def test_replay_equals_a_sequential_model(spark, policy):
    rng = random.Random(11)
    log = [(rng.choice(["c", "u", "u", "d", "odd"]), rng.choice([None, *range(40)]), rng.choice([None, rng.random()])) for _ in range(3000)]
    base = [(k, 1.0) for k in range(10)]
    df = spark.createDataFrame([(op, k, v, i) for i, (op, k, v) in enumerate(log)], "_op string, k long, v double, _op_index long").repartition(7)
    got = replay.apply_changes(spark.createDataFrame(base, "k long, v double"), df, ["k"], policy).collect()
    assert {r.k: r.v for r in got} == sequential([("c", k, v) for k, v in base] + log, policy) and len(got) == len({r.k for r in got})


def test_synthesized_log_is_consistent(spark):
    base = spark.read.parquet(f"{SF}/customer.parquet")
    log = changelog.synthesize(base, ["c_custkey"], steps=6, update_ratio=0.5, delete_ratio=0.3)
    rows = sorted(log.collect(), key=lambda r: r._op_index)
    assert len({r._op_index for r in rows}) == len(rows)
    keys = [(r.batch_id, changelog.RANK[r._op], r.c_custkey) for r in rows]
    assert keys == sorted(keys)
    alive, gone = set(), set()
    for r in rows:
        if r._op == "c":
            assert r.c_custkey not in alive | gone
            alive.add(r.c_custkey)
        else:
            assert r.c_custkey in alive
            if r._op == "d":
                alive.remove(r.c_custkey)
                gone.add(r.c_custkey)
                assert r.c_name is None and r.c_acctbal is None
    n = {k: sum(r._op == k for r in rows) for k in "cud"}
    assert n["c"] == base.count() and 0 < n["d"] < n["u"] < n["c"]
    assert {r.c_custkey for r in changelog.live_keys(log, ["c_custkey"], 5).collect()} == alive == {r.c_custkey for r in replay.apply_changes(None, log, ["c_custkey"]).collect()}


@pytest.mark.parametrize(("values", "p", "want"), [([1, 2, 3, 10], 99, 6.5), ([1, 2, 3, 10], 50, 2.5), ([5], 99, 5), ([3, 1, 2], 50, 2), ([4, 4, 4, 4], 25, 4), ([10, 1], 0, 1)])
def test_midpoint_percentile(spark, values, p, want):
    df = spark.createDataFrame([("q", float(v)) for v in values] + [("q", None)], "q string, v double")
    assert runstats.percentiles(df, ["q"], "v", [p]).first()[1] == want


def test_outliers_leave_and_a_group_is_never_emptied(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [10, 11, 12, 11, 10, 500]] + [("b", 1.0)], "q string, v double")
    assert sorted((r.q, r.v) for r in runstats.without_outliers(df, ["q"], "v").collect()) == [("a", 10), ("a", 10), ("a", 11), ("a", 11), ("a", 12), ("b", 1)]


def test_comparison_finds_planted_errors(spark):
    rows = [(i, f"n{i}", float(i), None if i % 5 else i) for i in range(200)]
    schema = "k long, name string, x double, y long"
    a = spark.createDataFrame(rows, schema).repartition(4)
    assert validate.compare_results(a, spark.createDataFrame(rows[::-1], schema), ["k"]).count() == 0
    bad = [list(r) for r in rows]
    bad[7][1], bad[50][2], bad[51][2], bad[6][3] = "other", 60.0, 51.0 * 1.04, 1
    found = validate.compare_results(a, spark.createDataFrame(bad, schema), ["k"]).collect()
    assert sorted((r.position, r.column_name) for r in found) == [(6, "y"), (7, "name"), (50, "x")]
    short = validate.compare_results(a, spark.createDataFrame(rows[:-3], schema), ["k"]).collect()
    assert [r.problem for r in short] == [validate.ROWS] * 3
    assert validate.compare_results(a, a.drop("y"), ["k"]).first().problem.startswith(validate.LENGTH)
    assert validate.compare_results(a, a.withColumn("x", F.lit(True)), ["k"]).first().problem.startswith(validate.SCHEMA)


def test_positions_are_gapless_however_ranges_are_cut(spark):
    """Runs of a sort may be coalesced in other ways; positions must not depend on that."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        df = spark.range(300_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), "id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("pad"))
        got = validate.numbered(df, ["k", "id"]).agg(F.count("*"), F.countDistinct("position"), F.min("position"), F.max("position")).first()
        assert tuple(got) == (300_000, 300_000, 0, 299_999)
        assert validate.compare_results(df, df.repartition(7), ["k", "id"]).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(("expected", "found", "fine"), [("bigint", "string", True), ("string", "bigint", False), ("string", "timestamp", False), ("float", "double", True), ("double", "float", False), ("decimal(38,4)", "decimal(38,0)", True), ("timestamp", "timestamp_ntz", True), ("date", "timestamp", False), ("int", "smallint", False)])
def test_schema_equivalence_is_asymmetric(expected, found, fine):
    made = [T.StructType.fromDDL(f"x {kind}") for kind in (expected, found)]
    assert (validate.schema_problems(*made) == []) is fine


def test_schema_diff_counts_rows(spark):
    want = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.IntegerType()), T.StructField("gone", T.StringType())])
    df = spark.createDataFrame([(1, "3", None), (None, "x", 2.5), (2, None, 1.5)], "a long, b string, other double")
    got = {(r.column_name, r.problem, r.n_rows) for r in replay.schema_diff(df, want).collect()}
    assert got == {("a", "nullability", 1), ("b", "type", 1), ("gone", "renamed", 2)}
    assert replay.schema_diff(df, df.schema).collect() == [] and replay.schema_diff(df.limit(0), want).count() == 3
    assert {r.problem for r in replay.schema_diff(df.drop("other"), want).collect()} == {"nullability", "type", "missing"}


def test_expected_results_and_metadata(spark, tmp_path):
    (tmp_path / "g.csv").write_text("a|b\n1|x\n2|y\n")
    (tmp_path / "v.json").write_text('{"version": "3", "tables": {"t": {"keys": ["k"], "time_column": "ts", "batches": [{"id": 0, "parts": 1}, {"id": 1, "parts": 2}, {"id": 1, "parts": 2}]}}}')
    assert [tuple(r) for r in batches.read_golden(spark, str(tmp_path / "g.csv")).collect()] == [(1, "x"), (2, "y")]
    assert [tuple(r) for r in batches.expected_result(spark, "inline_csv", "a,b\n1,x\n").collect()] == [("1", "x")]
    assert [tuple(r) for r in batches.expected_result(spark, "rows", (["a"], [[1], [2]])).collect()] == [(1,), (2,)]
    assert batches.expected_result(spark, "count", 5).first()[0] == 5
    assert sorted((r.table_name, r.batch_id, r.parts) for r in batches.read_version(spark, str(tmp_path / "v.json")).collect()) == [("t", 0, 1), ("t", 1, 2)]
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("*.parquet"))
    (tmp_path / "b").mkdir()
    part.rename(tmp_path / "b" / "batch-000007-part-002.parquet")
    got = batches.read_batch_files(spark, str(tmp_path / "b"), T.StructType([T.StructField("id", T.LongType())])).collect()
    assert {(r.batch_id, r.part_id) for r in got} == {(7, 2)} and len(got) == 3
    assert batches.table_schema([("a", "uint64"), ("b", "decimal(40,2)"), ("c", "timestamp")]).simpleString() == "struct<a:decimal(20,0),b:decimal(38,2),c:timestamp_ntz>"


def test_stream_refuses_batches_out_of_order(spark):
    t = relational.Tables(spark, SF)
    log, path = changelog.orders_log(t), batches.scratch(spark, "log")
    state = T.StructType([f for f in log.schema if f.name not in ("batch_id", "_op", "_op_index")])
    target, offsets = stream.VersionedTable(spark, batches.scratch(spark, "state"), state), batches.scratch(spark, "offsets")
    for b in (3, 1):
        log.where(f"batch_id = {b}").coalesce(1).write.parquet(f"{path}/{b}")
        q = stream.replay_stream(stream.read_log_stream(spark, path, log.schema), target, ["o_orderkey"], offsets)
        if b == 3:
            q.awaitTermination()
            again = stream.VersionedTable(spark, target.path, state)
            assert again.version == target.version == 0 and again.last == target.last
        else:
            with pytest.raises(Exception, match="is applied"):
                q.awaitTermination()


def test_filters_and_columns_reach_the_scan(spark):
    plan = tpch.queries()["h6_forecast_revenue"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan and "l_orderkey" not in plan.split("ReadSchema")[1]


def test_mutation_counts_are_capped_by_the_live_keys():
    assert changelog.capped(900, 300, 600) == (450, 150) and changelog.capped(5, 5, 10) == (5, 5) and changelog.capped(3, 3, 0) == (0, 0)
    assert {changelog.jittered(100, s, 1, 7) for s in range(500)} == set(range(75, 126)) and changelog.jittered(0, 3, 1, 7) == 0


@pytest.mark.parametrize("span", [50, 1_000_000, changelog.DRAWS])
def test_least_draws_are_exact(spark, span):
    """Ranks among many equal draws, among few, and among draws of 62 bits."""
    rng = random.Random(span)
    rows = [(rng.randrange(span), i, rng.choice("ab")) for i in range(9000)]
    df = spark.createDataFrame(rows, "draw long, k long, name string")
    want = sorted(rows)
    for ranks in ([1, 9000], [0, 4567], [17, 17]):
        assert changelog.least(df, ["k", "name"], ranks, span) == [want[r - 1] if r else None for r in ranks]


def test_each_step_changes_exactly_as_many_live_keys_as_asked(spark):
    base = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("j"), F.lit("x").alias("name"))
    log = changelog.synthesize(base, ["k", "j"], steps=5, update_ratio=0.4, delete_ratio=0.9, seed=3)
    rows = log.collect()
    assert sorted(r._op_index for r in rows) == list(range(len(rows)))
    alive = set()
    for s in range(5):
        ops = {o: [(r.k, r.j) for r in rows if r.batch_id == s and r._op == o] for o in "cud"}
        alive |= set(ops["c"])
        u, d = changelog.capped(*(changelog.jittered(round(len(ops["c"]) * x), s, w, 3) for w, x in ((1, 0.4), (2, 0.9))), len(alive))
        assert (len(ops["u"]), len(ops["d"])) == (u, d) == (len(set(ops["u"])), len(set(ops["d"])))
        assert set(ops["u"]) <= alive and set(ops["d"]) <= alive and not set(ops["u"]) & set(ops["d"])
        alive -= set(ops["d"])
    assert changelog.synthesize(base, ["k", "j"], dimension=True).where("_op <> 'c'").count() == 0
    assert changelog.synthesize(base.limit(0), ["k", "j"], steps=3).count() == 0


def test_bootstrap_churns_by_the_live_keys_and_payload_ranges_hold(spark):
    base = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("small"), F.lit(1).cast("long").alias("big"), F.lit("x").alias("name"), F.lit(0.5).alias("part"))
    log = changelog.synthesize(base, ["k"], update_ratio=0.3, delete_ratio=0.1, bootstrap=True, mutation_steps=4, churn=0.2).cache()
    n = {(r.batch_id, r._op): r["count"] for r in log.groupBy("batch_id", "_op").count().collect()}
    assert n[0, "c"] == 20_000 and {b for b, _ in n} == {0, 1, 2, 3, 4}
    live = 20_000
    for b in range(1, 5):
        each = round(live * 0.2 / 4)
        assert (n[b, "u"], n[b, "d"]) == (round(each * 0.75), each - round(each * 0.75))
        live -= n[b, "d"]
    u = log.where("_op = 'u'").agg(F.min("small"), F.max("small"), F.min("big"), F.max("big"), F.min(F.length("name")), F.max(F.length("name")), F.max("part")).first()
    assert u[0] >= 1 and 500_000 < u[1] <= 999_999 and u[2] >= 1 and 500_000_000 < u[3] <= 999_999_999 and u[4] == u[5] == 10 and u[6] < 1000


def test_keyed_sink_takes_inserts_updates_and_deletes(spark):
    from ledgerbrook.sources.keyed import KeyedSink

    rows = lambda x: spark.createDataFrame(x, "k long, v string")
    sink = KeyedSink(spark, batches.scratch(spark, "sink"), rows([]).schema, ["k"])
    assert sink.version() == -1 and sink.read() is None
    sink.insert(rows([(1, "a"), (2, "b"), (3, None)]))
    sink.update(rows([(2, "c"), (9, "none")]))
    sink.delete(rows([(1, "ignored"), (7, None)]))
    assert sorted(map(tuple, sink.read().collect())) == [(2, "c"), (3, None)] and sink.version() == 2
    rows([(5, "cut short")]).write.parquet(f"{sink.path}/v3")  # a version that was never noted
    sink.insert(rows([(4, "d")]))
    assert sorted(map(tuple, KeyedSink(spark, sink.path, sink.schema, ["k"]).read().collect())) == [(2, "c"), (3, None), (4, "d")]


def bytes_under(path):
    top = path.removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


def test_a_small_write_to_a_sink_is_small(spark):
    from ledgerbrook.sources.keyed import KeyedSink

    rows = spark.range(60_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    sink = KeyedSink(spark, batches.scratch(spark, "sink"), rows.schema, ["k"], buckets=8, compact_every=3)
    sink.insert(rows)
    whole = bytes_under(f"{sink.path}/v0")
    for i in range(1, 4):
        sink.update(rows.where(f"k in (5, 77)").withColumn("v", F.lit(f"new {i}")))
    own = {p.bucket for p in sink.manifest(3) if p.number == 3}
    assert 1 <= len(own) <= 2 and bytes_under(f"{sink.path}/v3") < whole / 50
    assert 0 < bytes_under(f"{sink.path}/b2") < whole / 3  # only the buckets written to were folded, at their third delta
    assert {r.v for r in sink.read().where("k in (5, 77)").collect()} == {"new 3"} and sink.read().count() == 60_000
    assert {r.v for r in sink.read(1).where("k in (5, 77)").collect()} == {"new 1"}
    assert sink.vacuum() == ["v1"] and sink.read().count() == 60_000  # v0 still holds the other buckets
    sink.delete(rows)
    assert sink.read().count() == 0


def test_an_unreadable_note_is_no_new_table(spark):
    from ledgerbrook.sources.keyed import KeyedSink

    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    sink = KeyedSink(spark, batches.scratch(spark, "sink"), rows.schema, ["k"])
    sink.insert(rows)
    noted = f"{sink.path}/noted".removeprefix("file://")
    for f in os.listdir(noted):
        if f.endswith(".parquet"):
            with open(os.path.join(noted, f), "r+b") as x:
                x.truncate(3)
            os.remove(os.path.join(noted, f".{f}.crc"))
    with pytest.raises(Exception):
        sink.version()


@pytest.mark.parametrize("policy", ["ignore", "upsert"])
def test_state_of_latest_rows_equals_a_replay(spark, policy):
    from ledgerbrook.streaming.state import keep_latest, read_latest

    rng = random.Random(3)
    log = [(i % 3, rng.choice("cuudx"), rng.choice([None, *range(12)]), rng.choice([None, i]), i) for i in range(300)]
    log.sort(key=lambda r: r[0])
    schema = "batch_id int, _op string, k long, v long, _op_index long"
    df = spark.createDataFrame([(b, op, k, v, i) for i, (b, op, k, v, _) in enumerate(log)], schema)
    path, at = batches.scratch(spark, "log"), batches.scratch(spark, "state")
    for n, b in enumerate((0, 1, 1, 0, 2)):  # two come again
        df.where(F.col("batch_id") == b).repartition(2).write.parquet(f"{path}/{n}")
        keep_latest(stream.read_log_stream(spark, path, df.schema), ["k"], at, policy)
    want = replay.apply_changes(None, df, ["k"], policy).collect()
    assert sorted(map(str, read_latest(spark, at).collect())) == sorted(map(str, want))


@pytest.mark.parametrize("workers", [1, 2])
def test_queue_waits_equal_a_served_queue(spark, workers):
    """Also where one worker's log lies in eight ranges."""
    from datetime import datetime, timedelta

    rng, rows = random.Random(6), []
    for i in range(400):
        rows.append((i, i % workers, datetime(2024, 1, 1) + timedelta(milliseconds=rng.randrange(9000)), float(rng.randrange(80))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.createDataFrame(rows, "run_id long, worker_id long, started_at timestamp_ntz, duration_ms double")
        got = {r.run_id: (r.wait_ms, r.depth) for r in runstats.queue_waits(df, ["worker_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    free, arrived = {}, {}
    for i, w, at, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        start = max(at, free.get(w, at))
        second = (w, at.replace(microsecond=0))
        arrived[second] = arrived.get(second, 0) + 1
        assert abs(got[i][0] - (start - at).total_seconds() * 1000) < 0.01 and got[i][1] == arrived[second]
        free[w] = start + timedelta(milliseconds=ms)
    assert max(w for w, _ in got.values()) > 100


@pytest.mark.parametrize("p", [7, 29, 57, 58])
def test_percentiles_at_whole_ranks(spark, p):
    """Where p / 100 * 100 misses the whole number by floating point, the value at that rank counts alone."""
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    assert runstats.percentiles(df, [], "v", [p]).first()[0] == p


def test_ranks_hold_when_a_group_spans_many_ranges(spark):
    values = [random.Random(i).randrange(5000) for i in range(20_000)]
    df = spark.createDataFrame([("big", float(v)) for v in values] + [(None, 3.0), (None, None)], "g string, v double").repartition(5)
    got = {r.g: (r.p50, r.p99) for r in runstats.percentiles(df, ["g"], "v", [50, 99]).collect()}
    v = sorted(values)
    assert got == {"big": ((v[9999] + v[10000]) / 2, (v[19799] + v[19800]) / 2), None: (3.0, 3.0)}


def test_late_rows_miss_their_window(spark):
    t = relational.Tables(spark, SF)
    assert stream._metric_stream(t).agg(F.sum("n")).first()[0] == t.events.count()  # one late row was sent and dropped


def test_segments_go_on_across_ranges(spark):
    rng = random.Random(8)
    rows = [(b, i, rng.choice(["c", "c", "c", "u", "d", None])) for b in (1, 2) for i in range(3000)] + [(3, i, "u") for i in range(2000)]
    got = replay.segments(spark.createDataFrame(rows, "batch_id long, _op_index long, _op string").repartition(9)).collect()
    want, last = {}, None
    for b, i, op in rows:
        op = op or "c"
        if last != (b, op):
            n = 1 + max((s for x, s in want if x == b), default=0)
            want[b, n], last = [op, i, i, 0], (b, op)
        want[b, n][2:] = [i, want[b, n][3] + 1]
    assert {(r.batch_id, r.segment): [r._op, r.first, r.last, r.n] for r in got} == want
