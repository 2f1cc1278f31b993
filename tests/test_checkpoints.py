from pyspark.sql import functions as F

from ledgerbrook.operators.changelog import orders_log
from ledgerbrook.operators.relational import Tables
from ledgerbrook.operators.validate import verify_checkpoints, write_checkpoints
from ledgerbrook.sources.batches import scratch

SF = "/root/testdata/sf0.001"


def test_wrong_values_under_right_counts_are_found(spark):
    t, path = Tables(spark, SF), scratch(spark, "snapshots")
    log = orders_log(t)
    write_checkpoints(t, log, path, 3)
    price = F.when((F.col("batch_id") == 4) & (F.col("_op") == "c"), F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice"))
    got = {(r.checkpoint, r.name): r for r in verify_checkpoints(t, log.withColumn("o_totalprice", price), path, 3).collect()}
    assert len(got) == 15 and all(r.expected == r.found for r in got.values())
    assert got[0, "orders"].ok and not got[1, "orders"].ok and got[1, "orders"].differences > 0 and got[1, "h13_customer_distribution"].ok
