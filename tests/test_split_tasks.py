import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerbrook.operators import replay
from ledgerbrook.sources import batches


def _written(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path.removeprefix("file://")) for f in fs if f.endswith(".parquet"))


@pytest.mark.parametrize("kind", ["bytes", "rows"])
def test_a_task_writes_many_small_splits(spark, kind):
    """Before, each file was a task of its own, whose result went to the driver."""
    df = spark.range(3_000).withColumn("text", F.lit("x" * 10))
    if kind == "bytes":
        rows, split = replay.split_by_bytes(df, ["id"], F.length("text"), 100), "split"
    else:
        rows, split = replay.rebatched(df, "id", F.floor(F.col("id") / 1_001), 10).withColumn("batch", F.struct(F.floor(F.col("id") / 1_001), "batch_no")).drop("batch_no"), "batch"
    path = batches.scratch(spark, "files")
    n = replay.write_splits(rows, split, path, ["id"])
    files = _written(path)
    assert len(files) == n >= 300 and len({re.search(r"part-(\d+)", f)[1] for f in files}) <= 4
    back = replay.split_files(spark, path, df.schema).groupBy("file_no").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).orderBy("file_no").collect()
    assert [r.file_no for r in back] == list(range(n)) and all(r.hi - r.lo + 1 == r.n <= 10 for r in back) and all(a.hi < b.lo for a, b in zip(back, back[1:]))
