from pyspark.sql import functions as F

from ledgerbrook.operators import validate
from ledgerbrook.operators.relational import Tables
from ledgerbrook.plans import verification
from ledgerbrook.sources import batches
from ledgerbrook.sources.scratch import dropped, stored


def test_planted_faults_are_found_by_query(spark, monkeypatch):
    monkeypatch.setattr(verification, "SQL", {q: verification.SQL[q] for q in ("h1_pricing_summary", "h4_order_priority", "h13_customer_distribution")})
    t = Tables(spark, "/root/testdata/sf0.001")
    logs = {n: stored(verification.database_log(t, n), "log") for n in ("orders", "lineitem", "customer")}
    path = batches.scratch(spark, "snapshots")
    verification.write_checkpoints(t, logs, path, 2)
    assert {(r.checkpoint, r.interval) for r in batches.read_manifest(spark, path).collect()} == {(0, 2), (1, 2), (2, 2)}

    def rewrite(name, change):
        df = stored(spark.read.parquet(f"{path}/{name}"), "was")
        change(df).write.mode("overwrite").parquet(f"{path}/{name}")

    least = spark.read.parquet(f"{path}/cp1/h1_pricing_summary").agg(F.min("sum_qty")).first()[0]
    rewrite("cp1/h1_pricing_summary", lambda df: df.withColumn("sum_qty", F.when(F.col("sum_qty") == least, 7.0).otherwise(F.col("sum_qty"))))
    rewrite("cp2/h4_order_priority", lambda df: df.limit(2))
    rewrite("cp0/customer", lambda df: df.drop("c_name"))
    dropped(spark, f"{path}/cp0/h13_customer_distribution")
    spark.createDataFrame([("orders", 1), ("lineitem", 2), ("customer", 3)], "table_name string, n_rows long").write.mode("overwrite").json(f"{path}/cp2/row_counts")

    report = verification.verify_checkpoints(t, logs, path, 2).collect()
    assert len(report) == 18
    bad = {(r.checkpoint, r.name): r.problem for r in report if not r.ok}
    assert bad.pop((0, "customer")).startswith(validate.LENGTH)
    assert bad == {(1, "h1_pricing_summary"): validate.DATA, (2, "h4_order_priority"): validate.ROWS, (0, "h13_customer_distribution"): validate.NO_EXPECTED, (2, "orders"): validate.ROWS, (2, "lineitem"): validate.ROWS, (2, "customer"): validate.ROWS}
    assert next(r.differences for r in report if (r.checkpoint, r.name) == (1, "h1_pricing_summary")) == 1
