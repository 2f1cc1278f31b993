from pyspark.sql import functions as F

from ledgerbrook.operators.replay import split_by_bytes


def test_byte_splits_hold_with_skewed_widths(spark):
    widths = [1] * 500 + [90] * 40 + [250, 0, 250] + [3] * 300
    rows = spark.createDataFrame(list(enumerate(widths)), "k int, n int").repartition(7)
    got = split_by_bytes(rows, ["k"], F.col("n"), 100).orderBy("k").collect()
    assert [r.width for r in got] == widths and all(a.split <= b.split for a, b in zip(got, got[1:]))
    by = {}
    for r in got:
        by.setdefault(r.split, []).append(r.width)
    assert all(sum(x) <= 100 or [w for w in x if w] == [250] for x in by.values())
