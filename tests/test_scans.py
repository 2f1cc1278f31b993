import itertools
import random

from pyspark.sql import functions as F

from ledgerbrook.operators.scans import scan


def test_running_values_across_ranges(spark):
    random.seed(4)
    rows = [(g, i, random.choice([None, *range(20)])) for g, n in (("hot", 3000), ("a", 3), (None, 40), ("z", 1), ("b", 900)) for i in range(n)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, v long")
    want = {}
    for g, its in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])), key=lambda r: r[0]):
        total = low = high = mixed = None
        before, first = None, True
        for _, i, v in its:
            if v is not None:
                total, low, high = (total or 0) + v, v if low is None else min(low, v), v if high is None else max(high, v)
                mixed = (mixed or 0) ^ v
            want[g, i] = (total, low, high, mixed, None if first else before)
            before, first = v, False
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        v = F.col("v")
        out = scan(df, ["g"], ["i"], {"s": ("sum", v), "lo": ("min", v), "hi": ("max", v), "x": ("xor", v), "p": ("lag", v)})
        got = {(r.g, r.i): (r.s, r.lo, r.hi, r.x, r.p) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want
    assert scan(df.limit(0), ["g"], ["i"], {"s": ("sum", v)}).collect() == []
