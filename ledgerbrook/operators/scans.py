"""Running values along groups of any size: scanned within the stored ranges of a sort, and carried from range to range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

c = F.col


def _together(kind: str, a: Column, b: Column) -> Column:
    """What two parts give, of which either may be null."""
    if kind in ("min", "max"):
        return F.least(a, b) if kind == "min" else F.greatest(a, b)
    return F.coalesce(a + b if kind == "sum" else a.bitwiseXOR(b), a, b)


_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max, "xor": F.bit_xor}


def in_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df sorted by group and order (nulls first) and stored, plus __p, the range that a row lies in. Two runs of a sort may be cut in different places, so all that follows reads this one."""
    return stored(df.orderBy(*by, *order).withColumn("__p", F.spark_partition_id()), "ranges")


def cut_groups(ranges: DataFrame, by: list[str]) -> DataFrame:
    """The groups (one struct, __g) that more than one range holds: at most one for each range, since a range only shares its first and its last."""
    ends = stored(ranges.groupBy("__p").agg(F.min(F.struct(*by)).alias("lo"), F.max(F.struct(*by)).alias("hi")), "range-ends")  # one row per range
    a, b = ends.select(c("lo").alias("__g"), c("__p").alias("__b")), ends.select(c("hi").alias("__h"), c("__p").alias("__a"))
    return a.join(F.broadcast(b), c("__g").eqNullSafe(c("__h")) & (c("__a") < c("__b"))).select("__g").distinct()


def carries(ranges: DataFrame, by: list[str], totals: dict[str, Column], carried: dict[str, Column], within: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(__g, __q, carried columns) of groups in several ranges: what each of their ranges begins with.

    totals are aggregates of a group's rows in one range, after `within` has added columns to them; carried are window
    expressions over those of the ranges before, in the window `earlier()`. At most twice as many rows as ranges.
    """
    cut = F.broadcast(cut_groups(ranges, by))
    own = within(ranges.withColumn("__own", F.struct(*by)).join(cut, c("__own").eqNullSafe(c("__g"))))
    sums = own.groupBy("__g", c("__p").alias("__q")).agg(*(x.alias(n) for n, x in totals.items()))
    for name, x in carried.items():  # a later one may use an earlier one
        sums = sums.withColumn(name, x)
    return sums.select("__g", "__q", *carried)


def earlier():
    """The window of a group's ranges before the one at hand."""
    return W.partitionBy("__g").orderBy("__q").rowsBetween(W.unboundedPreceding, -1)


def with_carries(rows: DataFrame, by: list[str], carried: DataFrame) -> DataFrame:
    """rows (with __p) and what their range begins with; null where a group begins."""
    return rows.join(F.broadcast(carried), F.struct(*by).eqNullSafe(c("__g")) & (c("__p") == c("__q")), "left").drop("__g", "__q")


def scan(df: DataFrame, by: list[str], order: list[str], running: dict[str, tuple[str, Column]]) -> DataFrame:
    """df plus running columns along each group, named to (kind, value).

    sum, min, max and xor take in the row itself and skip nulls; lag is the value of the row before. Rows that are equal in
    `order` follow each other in any order, so name a unique one where that matters. A group may hold most rows: each
    range of the sort is scanned for itself, and only totals of ranges that share a group go on. Empty table: empty result.
    """
    ranges = in_ranges(df.withColumns({f"__v_{n}": v for n, (_, v) in running.items()}), by, order)
    latest = F.struct(F.lit(0).alias("z"), *order)
    totals, carried = {}, {}
    for n, (kind, _) in running.items():
        totals[f"__t_{n}"] = F.max_by(F.struct(f"__v_{n}"), latest) if kind == "lag" else _AGGREGATE[kind](f"__v_{n}")
        carried[f"__c_{n}"] = F.last(f"__t_{n}").over(earlier()) if kind == "lag" else _AGGREGATE[kind](f"__t_{n}").over(earlier())
    rows = with_carries(ranges, by, carries(ranges, by, totals, carried))
    w = W.partitionBy("__p", *by).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    out = {}
    for n, (kind, _) in running.items():
        if kind == "lag":
            out[n] = F.when(F.row_number().over(w) == 1, c(f"__c_{n}")[f"__v_{n}"]).otherwise(F.lag(f"__v_{n}").over(w))
        else:
            out[n] = _together(kind, _AGGREGATE[kind](f"__v_{n}").over(upto), c(f"__c_{n}"))
    return rows.withColumns(out).drop("__p", *(f"__{x}_{n}" for n in running for x in "vc"))


def numbered(df: DataFrame, order: list) -> DataFrame:
    """df plus position, gapless from 0 in the order: rows are numbered within ranges of a sort and shifted by the counts before.

    The ranges are stored once: counts and rows of two runs of a sort need not agree, since each may be cut anew.
    """
    ranged = stored(df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()), "ranges")
    counts = ranged.groupBy("__p").count()
    before = counts.withColumn("__b", F.sum("count").over(W.orderBy("__p")) - c("count")).select(c("__p").alias("__q"), "__b")  # one row per partition
    place = c("__m") - F.shiftleft(c("__p").cast("long"), 33)
    return ranged.join(F.broadcast(before), c("__p") == c("__q")).withColumn("position", c("__b") + place).drop("__p", "__q", "__m", "__b")
