import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerbrook.operators import replay
from ledgerbrook.operators.inequality import counted_below
from ledgerbrook.sources import batches


@pytest.mark.parametrize("or_equal", [False, True])
def test_counts_equal_the_pairs(spark, or_equal):
    rng = random.Random(2)
    value = lambda: rng.choice([None, *range(15)])
    probe = [(i, rng.choice([None, "a", "b", "gone"]), value()) for i in range(300)]
    build = [(rng.choice([None, "a", "b", "b", "other"]), value()) for _ in range(300)]
    got = counted_below(spark.createDataFrame(probe, "i long, k string, x int"), spark.createDataFrame(build, "own string, y int"), {"k": "own"}, F.col("x"), F.col("y"), or_equal)
    want = {i: sum(k == b and x is not None and y is not None and (y < x or or_equal and y == x) for b, y in build if k is not None) for i, k, x in probe}
    assert {r.i: r.n for r in got.collect()} == want
    assert got.columns == ["i", "k", "x", "n"]


def test_a_hot_key_costs_its_rows_not_its_pairs(spark):
    """A third of 90,000 rows under one key: 4.5e8 pairs if they were made."""
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1000).alias("k"), F.xxhash64("id").alias("x"))
    out = counted_below(rows, rows, {"k": "k"}, F.col("x"), F.col("x"))
    n = out.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    assert n.where("n <> rows * (rows - 1) / 2").count() == 0 and n.where("k = -1").first().n == 30_000 * 29_999 // 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_a_file_per_split_in_order(spark, monkeypatch):
    monkeypatch.setattr(replay, "SPLITS_AT_ONCE", 4)
    rng = random.Random(5)
    rows = [(i, "x" * (500 if i == 40 else rng.randrange(1, 60))) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, text string").repartition(5)
    split = replay.split_by_bytes(df, ["i"], F.length("text"), 200)
    path = batches.scratch(spark, "files")
    n = replay.write_splits(split, "split", path, ["i"])
    names = sorted(os.path.join(d, f) for d, _, fs in os.walk(path.removeprefix("file://")) for f in fs if f.endswith(".parquet"))
    files = [[tuple(r) for r in spark.read.parquet(f"file://{x}").select("i", "text").collect()] for x in names]
    assert len(files) == n > 8 and sum(files, []) == rows
    assert all(sum(len(t) for _, t in f) <= 200 or len(f) == 1 for f in files)
    assert [r.n for r in replay.split_files(spark, path, df.schema).groupBy("file_no").agg(F.count("*").alias("n")).orderBy("file_no").collect()] == [len(f) for f in files]
    empty = batches.scratch(spark, "files")
    assert replay.write_splits(split.limit(0), "split", empty, ["i"]) == 0 and replay.split_files(spark, empty, df.schema).count() == 0


def test_logs_without_operations_and_odd_codes(spark):
    rows = [(0, 0, "c"), (0, 1, "c"), (1, 2, "x"), (2, 3, None), (3, 4, "u"), (4, 5, "c")]
    log = spark.createDataFrame([(b, i, op, i) for b, i, op in rows], "batch_id int, _op_index long, _op string, k long")
    assert {r.batch_id: r.insert_only for r in replay.insert_only(log).collect()} == {0: True, 1: False, 2: False, 3: False, 4: True}
    plain = log.drop("_op")
    assert all(r.insert_only for r in replay.insert_only(plain).collect())
    assert [(r._op, r.n) for r in replay.segments(plain).where("batch_id = 0").collect()] == [("c", 2)]
    assert replay.apply_changes(None, plain, ["k"]).count() == 6 and replay.apply_changes(None, log, ["k"]).count() == 5


def test_manifest_fields_that_are_missing(spark):
    path = batches.scratch(spark, "snapshots")
    spark.createDataFrame([('{"scenarios": {"a": {"checkpoint_indexes": [0, 2], "query_indexes": ["q"]}, "b": {}}}',)], "value string").write.text(f"{path}/checkpoints.json")
    assert sorted(map(tuple, batches.read_manifest(spark, path).collect())) == [("a", 0, "q", 0), ("a", 2, "q", 0)]
