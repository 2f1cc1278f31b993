"""Near-duplicate embeddings: a pivot-permutation index with inverted pivot lists, shared-pivot counts and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, arrow_type, fields, kept_names, looked_up, stored, table, with_columns
from .graph import components

#: Reference points of a dimension. No two are closer than APART in cosine, so near copies never become pivots side by side.
PIVOTS, APART = 512, 0.7
#: Pivots are chosen among so many vectors, those with the least hashes; all vectors are indexed.
SAMPLE = 4096
#: A vector is described by its NEAREST pivots in order, stands in the inverted lists of the first LISTS of them, and meets those that share SHARED of its NEAREST.
NEAREST, LISTS, SHARED = 12, 5, 3
#: Vectors of an inverted list that one task compares with one another; longer lists are dealt in blocks, and each pair of blocks is a task's group.
BLOCK = 2048
#: Rows of a block compared at once.
CHUNK = 128
SIGNED = "node binary, dim int, vec binary"
DESCRIBED = "near binary"
FOUND = "u binary, v binary, n long"


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivots(sample: np.ndarray, dim: int, most: int = PIVOTS, apart: float = APART, seed: int = 7) -> np.ndarray:
    """Up to `most` unit vectors, pairwise under `apart` in cosine: greedily from the sample, then from seeded random directions.

    In few dimensions fewer fit; then lists are longer and share more.
    """
    rng, out = np.random.default_rng([seed, dim]), np.empty((most, dim))
    n = 0
    for x in np.concatenate([sample, units(rng.standard_normal((4 * most, dim)))]):
        if n == most:
            break
        if not n or (out[:n] @ x).max() < apart:
            out[n] = x
            n += 1
    return out[:n]


def signed(rows: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """rows without the vector, plus node (128 bits that name label and vector; null if the vector links with nothing), dim and vec (its bytes)."""
    kept, schema = [n for n in kept_names(rows, SIGNED) if n != vec_col], arrow_type(SIGNED)
    kind = np.float32 if isinstance(rows.schema[vec_col].dataType.elementType, T.FloatType) else np.float64

    def each(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(vec_col))
            labels = batch.column(batch.schema.get_field_index(label_col)).to_pylist()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # a null becomes NaN, a negative zero zero
            ends = lists.offsets.to_numpy()
            lens = np.diff(ends)
            fine = lists.is_valid().to_numpy(zero_copy_only=False) & (lens > 0) & np.array([x is not None for x in labels], dtype=bool)
            out = [(None, None, None)] * len(labels)
            for dim in np.unique(lens[fine]).tolist():
                at = np.flatnonzero(fine & (lens == dim))
                x = flat[ends[at, None] + np.arange(dim)]
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                for i, row in zip(at[good].tolist(), x[good], strict=True):
                    own = row.tobytes()
                    out[i] = (xxhash.xxh3_128_digest(f"{labels[i]}|{dim}|".encode() + own), dim, own)
            yield with_columns(batch, kept, schema, [list(c) for c in zip(*out, strict=True)] if out else [[], [], []])

    return arrow_map(rows, SIGNED, each, keep=kept)


def described(classes: DataFrame, kind: type, chosen: dict[int, np.ndarray]) -> DataFrame:
    """classes plus near: the numbers (uint16) of the nearest pivots, nearest first; ties by number."""
    kept, schema = kept_names(classes, DESCRIBED), arrow_type(DESCRIBED)

    def each(batches):
        by_dim = dict(chosen)
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
            vecs = batch.column(batch.schema.get_field_index("vec")).to_pylist()
            near: list = [None] * len(vecs)
            for dim in np.unique(dims).tolist():
                if dim not in by_dim:
                    by_dim[dim] = pivots(np.empty((0, dim)), dim)
                at = np.flatnonzero(dims == dim)
                for some in np.split(at, range(1024, len(at), 1024)):
                    x = units(np.frombuffer(b"".join(vecs[i] for i in some), dtype=kind).reshape(len(some), dim))
                    order = np.argsort(-(x @ by_dim[dim].T), axis=1, kind="stable")[:, :NEAREST].astype(np.uint16)
                    for i, row in zip(some.tolist(), order, strict=True):
                        near[i] = row.tobytes()
            yield with_columns(batch, kept, schema, [near])

    return arrow_map(classes, DESCRIBED, each)


def bitset(near: np.ndarray) -> np.ndarray:
    """Pivot numbers of each row as bits of uint64 words."""
    out = np.zeros((len(near), -(-PIVOTS // 64)), dtype=np.uint64)
    for column in near.T.astype(np.int64):
        out[np.arange(len(near)), column // 64] |= np.uint64(1) << (column % 64).astype(np.uint64)
    return out


def compared(pivot: int, sides: np.ndarray, near: np.ndarray, x: np.ndarray, copies: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of the members of an inverted list: how many vectors each links with, and links that connect what all links connect.

    Pairs of different sides are compared (of one side, if there is but one) whose first common list this is and that
    share enough pivots; x holds unit vectors, copies how many rows each stands for.
    """
    g, both = len(x), len(np.unique(sides)) > 1
    lists, words = bitset(near[:, :LISTS]), bitset(near)
    before = np.array([min(max(pivot - 64 * i, 0), 64) for i in range(lists.shape[1])])
    earlier = lists & np.array([(1 << int(b)) - 1 for b in before], dtype=np.uint64)
    counts, root, links = np.zeros(g, dtype=np.int64), np.arange(g), []
    left, right = (np.flatnonzero(sides == sides.min()), np.flatnonzero(sides == sides.max())) if both else (np.arange(g), np.arange(g))
    need = min(SHARED, near.shape[1])
    for a in np.split(left, range(CHUNK, len(left), CHUNK)):
        meet = np.bitwise_count(words[a, None] & words[right]).sum(axis=2, dtype=np.int64) >= need
        meet &= ~(earlier[a, None] & earlier[right]).any(axis=2)
        if not both:
            meet &= right > a[:, None]
        if meet.mean() > 0.05:
            i, j = np.nonzero(meet & (x[a] @ x[right].T >= least))
        else:
            i, j = np.nonzero(meet)
            near_enough = np.concatenate([np.einsum("ij,ij->i", x[a[p]], x[right[q]]) for p, q in zip(np.split(i, range(65536, len(i), 65536)), np.split(j, range(65536, len(j), 65536)), strict=True)]) >= least
            i, j = i[near_enough], j[near_enough]
        i, j = a[i], right[j]
        counts += np.bincount(i, weights=copies[j], minlength=g).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=g).astype(np.int64)
        for u, its in zip(*_grouped(i, j), strict=True):
            others, first = np.unique(root[its], return_index=True)
            new = others != root[u]
            links += [(u, int(its[k])) for k in first[new]]
            root[np.isin(root, others[new])] = root[u]
    return counts, links


def _grouped(i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """j in groups of equal i (i is sorted)."""
    keys, at = np.unique(i, return_index=True)
    return keys.tolist(), np.split(j, at[1:]) if len(keys) else []


def links(members: DataFrame, kind: type, least: float, block: int = BLOCK) -> DataFrame:
    """(u, v, n) of members (node, label, dim, vec, copies, near): with v null, u links with n vectors more; else a link that connects two nodes."""
    lists = F.slice(F.transform(F.sequence(F.lit(0), F.lit(NEAREST - 1)), lambda i: F.conv(F.hex(F.concat(F.substring("near", 2 * i + 2, F.lit(1)), F.substring("near", 2 * i + 1, F.lit(1)))), 16, 10).cast("int")), 1, LISTS)
    listed = members.select("*", F.explode(F.filter(lists, lambda p: p.isNotNull())).alias("pivot")).withColumn("list", F.struct("label", "dim", "pivot"))
    sizes = stored(listed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").select(F.xxhash64("list").alias("of"), "blocks").groupBy("of").agg(F.max("blocks").alias("blocks")), "lists")
    deal = looked_up(listed.withColumn("h", F.xxhash64("list")).drop("list"), sizes, "h", "of", "inner").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = deal.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.struct("label", "dim", "pivot", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
    rows = dealt.select(F.xxhash64(task).alias("t"), task.alias("task"), "own", "node", "copies", "near", "vec")
    schema = arrow_type(FOUND)

    def each(batches):
        key, held = None, []

        def done():
            if len(held) > 1:
                own, nodes, copies, near, vecs = zip(*held, strict=True)
                near = np.frombuffer(b"".join(near), dtype=np.uint16).reshape(len(nodes), -1)
                x = units(np.frombuffer(b"".join(vecs), dtype=kind).reshape(len(nodes), key[1]))
                counts, pairs = compared(key[2], np.array(own), near, x, np.array(copies, dtype=np.float64), least)
                some = np.flatnonzero(counts).tolist()
                out = [(nodes[i], None, int(counts[i])) for i in some] + [(nodes[a], nodes[b], 0) for a, b in pairs]
                if out:
                    return [pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)]
            return []

        for batch in batches:
            tasks = zip(*(batch.column(1).field(i).to_pylist() for i in range(5)), strict=True)
            for its, *row in zip(tasks, *(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                if its != key:
                    yield from done()
                    key, held = its, []
                held.append(row)
        yield from done()

    return rows.repartition("t").sortWithinPartitions("t", "task").mapInArrow(each, T.StructType(fields(FOUND)))


def embedding_links(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", block: int = BLOCK) -> DataFrame:
    """(rid, n_links, component_id) per row of vectors: its id, the other rows at cosine >= least, and the smallest id it reaches.

    Only rows of equal label (none null) and of equal dimension are compared; without label_col, all of equal dimension. A
    vector that is null, empty or zero or holds a null or a non-finite component links with nothing, and is a component of its
    own. Equal vectors of one label are one class from the start, counted as many times as there are rows, so copies cost
    nothing; of a null id, component_id is the smallest id that is not null. Links found are exact: cosines are computed in double
    precision, none below `least` counts. A pair is missed if it shares too few near pivots (recall is measured in the tests). Links between a list's members are
    counted where the list is, and only those that connect it leave the task. Empty table: empty result. Extra columns are ignored.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    element = vectors.schema[vec_col].dataType.elementType
    kind, cast = (np.float32, "array<float>") if isinstance(element, T.FloatType) else (np.float64, "array<double>")
    rows = vectors.select(F.col(id_col).alias("rid"), label.alias("label"), F.col(vec_col).cast(cast).alias("vec"))
    marked = stored(signed(rows, "vec", "label"), "vectors")
    one = marked.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("rid").alias("first"), F.count("*").alias("copies"), F.min(F.struct("label", "dim", "vec")).alias("x"))
    classes = stored(one.select("node", "first", "copies", "x.*"), "classes")
    sample: dict[int, list[bytes]] = {}
    for r in classes.select("dim", "vec", F.xxhash64("node").alias("h"), "node").orderBy("h", "node").limit(SAMPLE).collect():  # SAMPLE rows at most
        sample.setdefault(r.dim, []).append(bytes(r.vec))
    chosen = {d: pivots(units(np.frombuffer(b"".join(v), dtype=kind).reshape(len(v), d)), d) for d, v in sample.items()}
    found = stored(links(described(classes.drop("first"), kind, chosen), kind, least, block), "links")
    near = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    joined = components(found.where("v is not null").select("u", "v"))
    own = stored(classes.select("node", "first", "copies").join(near, F.col("node") == F.col("u"), "left").drop("u").join(joined, "node", "left"), "own")
    lowest = stored(own.where("root is not null").groupBy("root").agg(F.min("first").alias("lowest")).withColumnRenamed("root", "of"), "lowest")
    linked = looked_up(own.where("copies > 1 or n > 0"), lowest, "root", "of").select(F.col("node").alias("of_node"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "first").alias("component"))
    out = looked_up(marked.select("rid", "node"), stored(linked, "linked"), "node", "of_node")
    return out.select("rid", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("of_node").isNull(), F.col("rid")).otherwise(F.col("component")).alias("component_id"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_links(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("rid").alias("vec_id"), "n_links", "component_id", F.col("rid").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
  AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS c FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM v JOIN m ON m.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
