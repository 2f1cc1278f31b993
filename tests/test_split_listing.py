from pyspark.sql import functions as F

from ledgerbrook.operators import replay
from ledgerbrook.sources import batches


def test_files_are_listed_by_few_tasks(spark):
    """Before, each file's folder was a task of the listing, whose result went to the driver."""
    df = spark.range(2_400)
    path = batches.scratch(spark, "files")
    n = replay.write_splits(df.withColumn("split", F.floor(F.col("id") / 2)), "split", path, ["id"])
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    try:
        files = replay.split_files(spark, path, df.schema)
        tracker = sc.statusTracker()
        tasks = sum(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert n == 1_200 and 0 < tasks <= n // 30
    got = files.groupBy("file_no").agg(F.min("id").alias("lo"), F.count("*").alias("n")).orderBy("file_no").collect()
    assert [(r.file_no, r.lo, r.n) for r in got] == [(i, 2 * i, 2) for i in range(n)]
