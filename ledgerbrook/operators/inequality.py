"""Joins on equal keys and an inequality whose pairs are only counted: by running counts in the order of the values, without the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import scan

c = F.col


def counted_below(probe: DataFrame, build: DataFrame, keys: dict[str, str], value: Column, other: Column, or_equal: bool = False, name: str = "n") -> DataFrame:
    """probe plus name, the rows of build with equal keys (probe's column to build's) and a smaller `other` than the row's `value`; no smaller or equal with or_equal.

    Nulls match nothing. Both sides are sorted together, values of build first counted, and a row's number is the count that has run up
    before it; so a key of any size costs its rows, not its pairs. Counts above are counts below of the negated values.
    """
    keyed = {f"__k{i}": (a, b) for i, (a, b) in enumerate(keys.items())}
    first, second = (1, 0) if or_equal else (0, 1)  # which of equal values is met first: the one with the smaller mark
    asked = probe.select("*", *(c(a).alias(k) for k, (a, _) in keyed.items()), value.alias("__x"), F.lit(first).alias("__mark"), F.lit(True).alias("__asks"))
    held = build.select(*(c(b).alias(k) for k, (_, b) in keyed.items()), other.alias("__x"))
    held = held.where(" AND ".join(f"{k} IS NOT NULL" for k in [*keyed, "__x"])).groupBy(*keyed, "__x").agg(F.count("*").alias("__held")).withColumns({"__mark": F.lit(second), "__asks": F.lit(False)})
    run = scan(asked.unionByName(held, allowMissingColumns=True), [*keyed], ["__x", "__mark"], {"__below": ("sum", c("__held"))})
    known = F.lit(True)
    for k in (*keyed, "__x"):
        known = known & c(k).isNotNull()
    return run.where("__asks").withColumn(name, F.when(known, F.coalesce("__below", F.lit(0))).otherwise(0).cast("long")).select(*probe.columns, name)
