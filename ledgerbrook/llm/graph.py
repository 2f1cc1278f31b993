"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored


def components(edges: DataFrame, **lookup: int) -> DataFrame:
    """(node, root) for each node of edges (u, v); root is the same exactly for connected nodes.

    Each round, every node moves to the smallest of itself and its neighbours and the graph contracts, so it at least
    halves; rounds grow with the logarithm of the nodes. Every round is stored; nothing but row counts reaches the driver. A
    root may hold most nodes: where it is joined, it is broadcast or salted (lookup: `most` and `salts` of `looked_up`).
    """
    edges = stored(edges.select("u", "v").where(~F.col("u").eqNullSafe(F.col("v"))).distinct(), "edges")
    moves = []
    while True:
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moves.append(stored(ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "moves"))
        if not edges.take(1):
            break
        a, b = (moves[-1].select(F.col("node").alias(x), F.col("root").alias(f"{x}_to")) for x in ("u", "v"))
        edges = stored(edges.join(a, "u").join(b, "v").where("u_to <> v_to").select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct(), "edges")
    out = moves.pop()
    while moves:
        later = out.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        out = looked_up(moves.pop(), later, "root", "__n", **lookup).select("node", F.coalesce("__r", "root").alias("root"))
        if moves:
            out = stored(out, "moves")
    return out
