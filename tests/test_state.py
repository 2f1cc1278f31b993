import time

from ledgerbrook.operators import replay
from ledgerbrook.sources import batches
from ledgerbrook.streaming import replay as stream
from ledgerbrook.streaming.state import keep_latest, read_latest

SCHEMA = "batch_id int, _op string, k long, v long, _op_index long"


def test_operations_that_come_late_count_in_their_place(spark):
    early = [(0, "c", 1, 10, 0), (0, "c", 2, 20, 1), (0, "c", 3, 30, 2), (2, "u", 1, 12, 6), (2, "d", 2, None, 7)]
    late = [(1, "d", 1, None, 3), (1, "c", 1, 11, 4), (1, "u", 3, 31, 5), (1, "u", 4, 40, 8)]
    path, at = batches.scratch(spark, "log"), batches.scratch(spark, "state")
    for i, rows in enumerate((early, late, early)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/{i}")
        keep_latest(stream.read_log_stream(spark, path, spark.createDataFrame([], SCHEMA).schema), ["k"], at)
    want = replay.apply_changes(None, spark.createDataFrame(early + late, SCHEMA), ["k"]).collect()
    assert sorted(map(tuple, read_latest(spark, at).collect())) == sorted(map(tuple, want)) == [(1, 12), (3, 31)]


def test_a_micro_batch_of_many_keys_takes_seconds(spark):
    """200,000 keys, created and then changed or deleted: before, each cost a dozen calls between the JVM and Python."""
    from pyspark.sql import functions as F

    made = spark.range(200_000).select(F.lit(0).alias("batch_id"), F.lit("c").alias("_op"), F.col("id").alias("k"), F.col("id").alias("v"), F.col("id").alias("_op_index"))
    changed = made.withColumn("_op", F.when(F.col("k") % 2 == 0, "u").otherwise("d")).withColumn("v", F.col("v") + 1).withColumn("_op_index", F.col("k") + 1_000_000)
    path, at = batches.scratch(spark, "log"), batches.scratch(spark, "state")
    made.unionByName(changed).write.parquet(f"{path}/0")
    began = time.monotonic()
    keep_latest(stream.read_log_stream(spark, path, made.schema), ["k"], at)
    assert time.monotonic() - began < 25
    assert read_latest(spark, at).agg(F.count("*"), F.sum(F.col("v") - F.col("k")), F.max("k")).first() == (100_000, 100_000, 199_998)
