"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch, temporary
from .common import WordHashes, arrow_map, arrow_type, fields, kept_names, looked_up, mixed, rolling, shielded, stored, table, table_bytes, utf8, with_columns
from .graph import components

SHINGLE = 5
#: 24 bands of 4 rows miss a pair at similarity 0.85 with probability 2e-8 and one at 0.8 with 4e-6.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Signatures are compared in batches of so many hashes.
BATCH = 32
#: A pair is pruned when its similarity reaches the threshold with less than this posterior probability.
MISS = 1e-7
#: Members of a bucket that meet its first one in one place.
SALTED = 256
#: Ids of texts to fetch are broadcast up to so many bytes.
BROADCAST_BYTES = 16 << 20
#: Texts, and bytes of text, that one task compares with one another; larger buckets are dealt in blocks, and each pair of blocks is a task's group.
BLOCK, BLOCK_BYTES = 500, 8 << 20
#: Texts held as Python values at a time.
AT_ONCE = 1000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
SIGNED = "n_shingles long, node binary, signature binary"
LINKS = "u binary, v binary"


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 5-word runs (A-Z lower-cased); of fewer words, one of the whole."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    k = min(SHINGLE, len(words))
    h = rolling(hashes(words), k, 0x9E3779B97F4A7C15)
    return np.unique(h if k == SHINGLE else mixed(h + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i : i + 1024, None] * _A + _B).min(axis=0), out=out)
    return out


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """For each number of hashes compared so far, the fewest matches that keep a pair.

    With a uniform prior, similarity after m matches of n is Beta(m + 1, n - m + 1), which exceeds t with the probability
    that at most m of n + 1 trials of chance t succeed.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def signed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs plus n_shingles, node (128 bits that name the set of shingles, null without words) and signature."""
    kept, schema = kept_names(docs, SIGNED), arrow_type(SIGNED)

    def each(batches):
        hashes = WordHashes()
        for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            rows = []
            for text in utf8(batch, text_col):
                s = shingles(text, hashes)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, signature(s).tobytes() if len(s) else None))
            yield with_columns(batch, kept, schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []])

    return arrow_map(docs, SIGNED, each)


def possible(sizes: np.ndarray, sigs: np.ndarray, size: int, sig: np.ndarray, percent: int, least: list[tuple[int, int]]) -> np.ndarray:
    """Which of some sets may be as similar to one as asked: by their sizes, then by signature batches, until a posterior rules them out."""
    to = np.flatnonzero(100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size))
    matches, done = np.zeros(len(to), dtype=np.int64), 0
    for n, m in least:
        matches += (sigs[to, done:n] == sig[done:n]).sum(axis=1)
        keep = matches >= m
        to, matches, done = to[keep], matches[keep], n
    return to


def linked(nodes: list[bytes], sides: np.ndarray, roots: list[bytes], band: int, sigs: np.ndarray, texts: list[bytes], percent: int, least: list[tuple[int, int]], hashes: WordHashes) -> list[tuple[bytes, bytes]]:
    """Links that, with those behind roots, connect what all pairs of similarity >= percent connect, among some texts of a bucket.

    Pairs of different sides are compared (of one side, if there is but one) whose first common band is the bucket's.
    Sizes, then signature batches prune them; the rest are counted exactly, all of a text's at once, unless they are
    connected already.
    """
    g, sets = len(nodes), [shingles(t, hashes) for t in texts]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    key = band_keys(sigs)
    both = len(set(sides.tolist())) > 1
    flat, owner = np.concatenate(sets), np.repeat(np.arange(g), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    root, out = np.unique(np.array(roots, dtype=object), return_inverse=True)[1], []
    for a in range(g):
        to = np.arange(a + 1, g)
        if both:
            to = to[sides[to] != sides[a]]
        to = to[root[to] != root[a]]
        if len(to):
            to = to[(key[to] == key[a]).argmax(axis=1) == band]
            to = to[possible(sizes[to], sigs[to], int(sizes[a]), sigs[a], percent, least)]
        if not len(to):
            continue
        begin, end = np.searchsorted(flat, sets[a]), np.searchsorted(flat, sets[a], side="right")
        n = end - begin
        shared = np.bincount(owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)], minlength=g)[to]
        for b in to[100 * shared >= percent * (sizes[a] + sizes[to] - shared)].tolist():
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
                out.append((nodes[a], nodes[b]))
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A column per band, equal where its rows are (by 64 bits)."""
    bands = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(sigs), BANDS), dtype=np.uint64)
    for i in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i]
    return key


def texts_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """node and the text that stands for it, of nodes. Texts are shuffled only if the ids are too many to broadcast."""
    of = texts.select(F.col("rid").alias("__i"), F.col("rh").alias("__h"), "text")
    picked = stored(classes.join(nodes, "node").select("node", "rid", "rh"), "picked")
    few = table_bytes(picked, "rid") <= BROADCAST_BYTES
    own = of.join(F.broadcast(picked) if few else picked, F.col("rid").eqNullSafe(F.col("__i")) & (F.col("rh") == F.col("__h")))
    return own.select("node", "text").dropDuplicates(["node"])


def facing(pairs: DataFrame, payload: DataFrame, name: str) -> DataFrame:
    """Rows for `streamed` of pairs (u, v): u's payload (node, and the column of that name) once for every SALTED of its partners, then theirs."""
    many = stored(pairs.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > SALTED).select(F.col("u").alias("of"), F.ceil(F.col("n") / SALTED).cast("int").alias("parts")), "hot")
    dealt = looked_up(pairs, many, "u", "of").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0)).cast("int").alias("salt"))
    own = payload.select(F.col("node").alias("__n"), name)
    heads = dealt.select("u", "salt").distinct().join(own, F.col("u") == F.col("__n")).select("u", "salt", F.lit(0).alias("role"), F.col("u").alias("node"), name)
    members = dealt.join(own, F.col("v") == F.col("__n")).select("u", "salt", F.lit(1).alias("role"), F.col("v").alias("node"), name)
    return heads.unionByName(members).repartition("u", "salt").sortWithinPartitions("u", "salt", "role")


def streamed(rows: DataFrame, name: str, start, judge) -> DataFrame:
    """Pairs (u, v) that judge(start(u's values), values of partners) finds, of rows from `facing`; a task holds one u and a batch."""
    schema = arrow_type(LINKS)

    def each(batches):
        judged, u, head = judge(), None, None
        for batch in batches:
            us, roles, nodes = (batch.column(i).to_pylist() for i in (0, 2, 3))
            values = utf8(batch, name)
            salts = batch.column(1).to_pylist()
            at = 0
            while at < len(us):
                if roles[at] == 0:
                    u, head = us[at], start(values[at])
                    at += 1
                    continue
                end = at
                while end < len(us) and roles[end] == 1 and us[end] == us[at] and salts[end] == salts[at]:
                    end += 1
                found = [nodes[at + i] for i in judged(head, values[at:end])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([u] * len(found), type=pa.binary()), pa.array(found, type=pa.binary())], schema=schema)
                at = end

    return rows.mapInArrow(each, T.StructType(fields(LINKS)))


def verified(pairs: DataFrame, classes: DataFrame, own: DataFrame, percent: int, least: list[tuple[int, int]]) -> DataFrame:
    """Those of pairs (u, v) with similarity >= percent: pruned by size and signature batches, then counted on the full sets of own (node, text)."""

    def sketch(value: bytes):
        return int.from_bytes(value[:8]), np.frombuffer(value, dtype=np.uint32, offset=8)

    def by_signature():
        def judged(head, values):
            sizes = np.array([sketch(v)[0] for v in values])
            return possible(sizes, np.stack([sketch(v)[1] for v in values]), *head, percent, least).tolist()

        return judged

    def exact():
        hashes = WordHashes()

        def judged(head, values):
            mine = shingles(head, hashes)
            for i, text in enumerate(values):
                other = shingles(text, hashes)
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * shared >= percent * (len(mine) + len(other) - shared):
                    yield i

        return judged

    left = stored(streamed(facing(pairs, classes, "sketch"), "sketch", sketch, by_signature), "possible")
    return stored(streamed(facing(left, own, "text"), "text", lambda text: text, exact), "links")


def links(classes: DataFrame, texts: DataFrame, percent: int, miss: float = MISS, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of classes at similarity >= percent / 100.

    classes: node, signature, sketch (size and signature), bytes (of text), rid, rh (the row that stands for it); texts:
    rid, rh, text. Texts with an equal band are a bucket. First each meets the bucket's smallest, so that a group of near
    copies comes together in one step without its pairs. Only buckets whose other members verified links haven't joined go
    on: there, all pairs of different components are compared, in blocks of bounded rows and bytes.
    """
    least, schema = least_matches(percent / 100, miss), arrow_type(LINKS)
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("signature", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)))
    rows = classes.select("node", F.posexplode(bands).alias("i", "band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("other")).where("first <> other").select("band", "first")
    buckets = stored(rows.join(shared, "band"), "buckets")
    star = stored(buckets.where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct(), "band-pairs")
    own = stored(texts_of(buckets.select("node").distinct(), classes, texts), "candidates")
    near = verified(star, classes, own, percent, least)

    found = stored(components(near), "near").select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    # a bucket's first has met all the others
    parts = stored(buckets.where("node <> first").join(found, F.col("node") == F.col("__n"), "left").select("i", "band", "node", F.coalesce("__r", "node").alias("root")), "parts")
    apart = parts.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    rest = stored(parts.join(apart, "band"), "apart")
    sized = rest.join(classes.select("node", "bytes"), "node")
    sizes = stored(sized.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / block_bytes)).cast("int").alias("blocks")).select(F.col("band").alias("of"), "blocks"), "blocks")
    deal = looked_up(rest, sizes, "band", "of", "inner").withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = deal.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.struct("band", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y")).alias("task"), "i", "own", "node", "root")
    members = classes.select("node", "signature").join(own, "node")
    dealt = dealt.join(members, "node").select(F.xxhash64("task").alias("t"), "task", "i", "own", "node", "root", "signature", "text")

    def each(batches):
        hashes, task, held = WordHashes(), None, []

        def done():
            if len(held) > 1:
                band, sides, nodes, roots, sigs, own = zip(*held, strict=True)
                new = linked(list(nodes), np.array(sides), list(roots), band[0], np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(len(nodes), HASHES), list(own), percent, least, hashes)
                if new:
                    return [pa.RecordBatch.from_arrays([pa.array(c, type=pa.binary()) for c in zip(*new, strict=True)], schema=schema)]
            return []

        for batch in batches:
            tasks = zip(*(batch.column(1).field(i).to_pylist() for i in range(3)), strict=True)
            for key, *row in zip(tasks, *(batch.column(i).to_pylist() for i in range(2, 7)), utf8(batch, "text"), strict=True):
                if key != task:
                    yield from done()
                    task, held = key, []
                held.append(row)
        yield from done()

    more = stored(dealt.repartition("t").sortWithinPartitions("t", "task").mapInArrow(each, T.StructType(fields(LINKS))), "more-links")
    return near.unionByName(more)


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(rid, rh, n_shingles, component_id, root) per row of docs: its id, a hash of its text, and its component's name.

    Texts with equal shingle sets are one class from the start; classes link at similarity >= percent / 100. Rows
    without words are linked with nothing. component_id is the smallest id in the component (null ids count last).
    Repeated rows share a class; equal ids with different texts are different documents. Texts may be of any length; memory
    grows with the longest. Empty table: empty result.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("rid"), text.alias("text"), F.xxhash64(text).alias("rh"))
    marked = stored(signed(rows.withColumn("bytes", F.octet_length("text")), "text").drop("text"), "signatures")
    one = marked.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("rid", "rh", "n_shingles", "signature", "bytes")).alias("x"))
    size = F.unhex(F.lpad(F.hex("x.n_shingles"), 16, "0"))
    classes = stored(one.select("node", "x.rid", "x.rh", "x.signature", "x.bytes", F.concat(size, "x.signature").alias("sketch")), "classes")
    found = components(links(classes, rows, percent, miss, block))
    own = F.coalesce("node", F.concat(F.lit(b"-"), F.coalesce(F.col("rid").cast("string"), F.lit("")).cast("binary"), F.col("rh").cast("string").cast("binary")))
    named = stored(marked.drop("signature", "bytes").withColumn("node", own).join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    firsts = stored(named.groupBy("root").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("root").alias("of"), "first", "n"), "firsts")
    joined = looked_up(named, firsts, "root", "of")  # only components of several rows
    return joined.select("rid", "rh", "n_shingles", F.when(F.col("n").isNull(), F.col("rid")).otherwise(F.col("first")).alias("component_id"), "root")


def near_dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with all their columns, with one document of each component of near-duplicates: the one with the smallest id.

    Of repeated rows, or different texts with that id in one component, one stays. Rows without words are kept. Texts may be of any length:
    memory grows with the longest. Empty table: empty result.
    """
    rows, names, restored = shielded(docs)
    i, t = names[id_col], names[text_col]
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "stay")
    with temporary(spark):  # of what is stored on the way, only the ids that stay are needed on
        marks = near_duplicates(rows, percent, i, t, **options)
        keep = marks.where(F.col("rid").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("rid").alias("rid"), F.min("rh").alias("rh"))
        wordless = marks.where("n_shingles = 0").select("rid", "rh").distinct()
        stay = keep.select("rid", "rh").unionByName(wordless).distinct()
        stay.write.parquet(path)
    stay = spark.read.schema(stay.schema).parquet(path)
    keyed = rows.withColumn("__h", F.xxhash64(F.col(t).cast("string")))
    out = keyed.join(stay, F.col(i).eqNullSafe(F.col("rid")) & (F.col("__h") == F.col("rh")))
    return restored(out.dropDuplicates([i, "__h"]))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("rid").alias("doc_id"), "n_shingles", "component_id", F.col("rid").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n k ON k.doc_id = y WHERE 100 * c >= 85 * (m.n + k.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""
