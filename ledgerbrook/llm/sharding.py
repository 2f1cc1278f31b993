"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, fields, stored, table

#: A group over 1/HEAVY of all bytes, tokens or rows is placed on the driver (at most 3 * HEAVY of them), all others in tasks.
HEAVY = 4096
#: Parts of a shard's share in which a heavy group is counted, so that it can be split where it must.
FINE = 16
#: Weights of bytes, tokens and rows in the dot product. Bytes come first, since their law is the one that holds.
WEIGHTS = np.array([1.0, 0.5, 0.5])
#: Shards may exceed their equal share by this much before groups of less than a shard are split.
SLACK = 0.01
#: Light groups that one task places.
TASK_GROUPS = 200_000
#: Rows of a shard are numbered in so many runs side by side.
RUNS = 1024
PLACED = "a long, b long, shard int"


class Shards:
    """Residual capacities of shards (rows) in bytes, tokens and rows (columns), all scaled by an equal share.

    Of tokens and rows nothing is left once a share is used up: what a group of many tiny rows exceeds it by doesn't keep bytes away.
    """

    def __init__(self, residual: np.ndarray):
        self.residual, self.left = residual.copy(), np.maximum(residual, 0)
        self.left[:, 0] = residual[:, 0]

    def place(self, size: np.ndarray) -> int:
        """The shard where the dot product of a scaled size with the residual capacity is highest; ties go to the lowest."""
        s = int(np.argmax(np.round((self.left * WEIGHTS) @ size, 12)))
        self.residual[s] -= size
        self.left[s, 0], self.left[s, 1:] = self.residual[s, 0], np.maximum(self.residual[s, 1:], 0)
        return s


def relevelled(residual: np.ndarray) -> np.ndarray:
    """residual (rows: shards) with room for what is still to come, in tokens and rows as in bytes, where groups exceed a shard's share.

    Such a shard will take tokens and rows by the bytes that it has room for; the others share the rest in proportion to what they have left.
    """
    out, room = residual.copy(), np.maximum(residual[:, 0], 0)
    for m in range(1, residual.shape[1]):
        over, left = residual[:, m] < 0, residual[:, m].sum()
        if over.any() and left > 0 and room.sum() > 0:
            out[over, m] = left * room[over] / room.sum()
            out[~over, m] *= (left - out[over, m].sum()) / residual[~over, m].sum()
    return out


def pack_vectors(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, Shards]:
    """The shard of each vector (rows of scaled sizes), largest first, each where the dot product is highest; and what is left."""
    packer, out = Shards(np.ones((shards, sizes.shape[1]))), np.zeros(len(sizes), dtype=np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -sizes.sum(axis=1), -sizes.max(axis=1, initial=0))):
        out[i] = packer.place(sizes[i])
    return out, packer


def pack_heavy(groups: list[np.ndarray], shards: int, slack: float = SLACK) -> tuple[list[np.ndarray], Shards]:
    """The shard of each fine part of each heavy group (rows of scaled sizes), and what is left.

    A group is split only where it has more bytes than a shard, into as few pieces as that takes. If shards would then exceed their
    share of bytes by more than `slack`, pieces of half the size are tried, and so on.
    """
    best, total = None, [g.sum(axis=0) for g in groups]
    limit = 1.0
    while limit >= 1 / FINE:
        cuts = [np.arange(len(g)) * max(1, min(len(g), int(np.ceil(t[0] / limit - 1e-9)))) // len(g) for g, t in zip(groups, total, strict=True)]
        pieces = [np.stack([np.bincount(cut, weights=g[:, c]) for c in range(3)], axis=1) for g, cut in zip(groups, cuts, strict=True)]
        place, packer = pack_vectors(np.concatenate(pieces), shards)
        over = -packer.residual[:, 0].min()
        if best is None or over < best[0] - 1e-12:
            ends = np.cumsum([len(x) for x in pieces])
            best = over, [place[e - len(x) : e][cut] for e, x, cut in zip(ends, pieces, cuts, strict=True)], packer
        if over <= slack:
            break
        limit /= 2
    return best[1], best[2]


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size (UTF-8 bytes + 1), tokens (words), crc and a 128-bit name of the text for each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text, F.col(text_col).isNull()).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def part(parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(7)), parts).cast("int")


def place_light(groups: DataFrame, residual: np.ndarray, totals: list[float], tasks: int) -> DataFrame:
    """PLACED of groups (a, b, size, tokens, n): each task streams its groups, largest first, onto its share of what is left."""
    schema, whole = arrow_type(PLACED), np.array([max(t, 1) for t in totals], dtype=float) / len(residual)
    share = [F.col(x) / F.lit(float(w)) for x, w in zip(("size", "tokens", "n"), whole, strict=True)]

    def each(batches):
        packer = Shards(residual / tasks)
        for batch in batches:
            sizes = np.stack([batch.column(i).to_numpy() for i in (2, 3, 4)], axis=1) / whole
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packer.place(x) for x in sizes], type=pa.int32())], schema=schema)

    dealt = groups.select("a", "b", "size", "tokens", "n").repartition(tasks, "a", "b")
    return dealt.sortWithinPartitions(F.greatest(*share).desc(), "a", "b").mapInArrow(each, T.StructType(fields(PLACED)))


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """rows (of narrow) plus shard.

    Equal texts are a group, and a group lies in one shard unless that is impossible: see pack_heavy. Groups of more than
    1/HEAVY of all bytes, tokens or rows come to the driver first (a bounded number, whatever the input); all others
    are placed one by one in tasks, each against its share of the capacity that is left, and join their rows by the
    text's name.
    """
    spark = rows.sparkSession
    totals = [float(x or 0) for x in rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()]
    if not totals[2]:
        return rows.withColumn("shard", F.lit(0))
    groups = stored(rows.groupBy("a", "b").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "groups")
    of_all = [F.col(x) / F.lit(max(t, 1.0)) for x, t in zip(("size", "tokens", "n"), totals, strict=True)]
    is_heavy = F.greatest(*of_all) > 1 / HEAVY
    parts = F.least(F.ceil(F.greatest(*of_all) * shards * FINE), F.col("n")).cast("long")
    heavy = stored(groups.where(is_heavy).select("a", "b", F.greatest(parts, F.lit(1)).alias("parts")), "heavy")  # at most 3 * HEAVY rows
    mine = rows.join(F.broadcast(heavy), ["a", "b"]).withColumn("k", part(F.col("parts")))
    fine = mine.groupBy("a", "b", "k").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("a", "b", "k").collect()  # at most 3 * (HEAVY + shards * FINE) rows
    names, sizes = {}, []
    for r in fine:
        names.setdefault((r.a, r.b), []).append(r.k)
        sizes.append([r.size, r.tokens, r.n])
    scaled = np.array(sizes, dtype=float).reshape(-1, 3) * shards / np.maximum(totals, 1)
    if names:
        place, packer = pack_heavy(np.split(scaled, np.cumsum([len(k) for k in names.values()])[:-1]), shards)
    else:
        place, packer = [], Shards(np.ones((shards, 3)))
    found = [(*name, int(k), int(s)) for (name, ks), at in zip(names.items(), place, strict=True) for k, s in zip(ks, at, strict=True)]
    own = spark.createDataFrame(found, "a long, b long, k int, shard int")
    light = groups.where(~is_heavy)
    tasks = max(1, -(-light.count() // TASK_GROUPS))
    others = stored(place_light(light, relevelled(packer.residual), totals, tasks), "light")
    first = mine.join(F.broadcast(own), ["a", "b", "k"]).select(*rows.columns, "shard")
    return first.unionByName(rows.join(others, ["a", "b"]).select(*rows.columns, "shard"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows plus slot, gapless from 0 within each shard: runs by a hash of the row are numbered side by side and shifted by the counts before them."""
    rows = rows.withColumn("run", F.pmod(F.xxhash64("id", "a"), F.lit(RUNS)).cast("int"))
    before = F.sum("count").over(W.partitionBy("s").orderBy("r")) - F.col("count")
    shift = rows.groupBy(F.col("shard").alias("s"), F.col("run").alias("r")).count().select("s", "r", before.alias("before"))  # at most shards * RUNS rows
    in_run = F.row_number().over(W.partitionBy("shard", "run").orderBy("id", "a", "b"))
    out = rows.withColumn("place", in_run).join(F.broadcast(shift), (F.col("shard") == F.col("s")) & (F.col("run") == F.col("r")))
    return out.withColumn("slot", (F.col("before") + F.col("place") - 1).cast("long")).drop("run", "s", "r", "before", "place")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    Null text counts as empty with one byte, in a group of its own; null and repeated ids are rows as any other; texts may be of any
    length; empty table: empty result. Extra columns are ignored. The texts are read once; what follows works on rows of a few numbers.
    Equal texts share a shard, but for groups of more bytes than one and those that must be cut to make shards near equal in bytes.
    """
    rows = stored(narrow(docs, id_col, text_col), "sizes")
    rows = numbered(stored(assign(rows, shards), "shards"))
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
