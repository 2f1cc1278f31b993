"""Substring dedup by compaction of a de Bruijn graph of token k-mers.

The graph's edges are the windows of `width` words, its nodes the runs of width - 1 words that they share. Windows that
follow each other and have the same anchor, the least-hashed short run (ANCHOR words) in them, travel as one row, which
names the nodes it leaves and enters; as it has fewer windows than a node has words, the two nodes hold all its words.
Equal windows have equal anchors, so windows of other anchors never need to meet. What occurs once only stays behind. The
repeated edges are joined where one ends and the next begins in a node that no other enters or leaves, and such links
contract to nonbranching paths by further joins (`compacted`). A text that runs through a whole path then stands for its
windows by one long span, verified on the words at its source coordinates; texts that hold part of a path are verified
edge by edge. Only edges whose anchor recurs in other surroundings (branches, ends of passages) are looked at window by
window. Copies within a batch are compared there and then.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, arrow_map, arrow_type, fields, kept_names, looked_up, mixed, rolling, shielded, stored, table, utf8, with_columns
from .graph import components

#: Words of a window.
WIDTH = 35
#: Words of the anchors that cut a text into edges.
ANCHOR = 8
FACTOR, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Longest run of windows that is cut at once; longer texts are cut in runs side by side.
STRETCH = 1 << 20
#: Edges: anchor, node left, node entered, the text's two keys, first window, windows; twice: the edge is known to recur.
EDGES = "m long, l long, r long, k long, k2 int, a int, n int, twice boolean, local boolean"
#: What is compared: name (windows, edges) or path; kind, and for paths the digest and whose it is.
WINDOWS = "g long, h long, kind byte, role byte, v long, w long, k long, k2 int, a int, b int, known boolean"
WINDOW, EDGE, PATH = 0, 1, 2
#: Whose digest a row of a path holds: a part of the first or second source of its edges, or a text that runs through it.
FIRST, SECOND, THROUGH = 1, 2, 3
CUT = "n_words long, n_removed long, kept_text string, kept_sha256 string"


def anchors(k: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` k-mer hashes, the place of its least hash (the first of equals)."""
    if len(k) < span:
        return np.empty(0, dtype=np.int64)
    low = np.uint64(2 * STRETCH - 1)
    least, size = (k & ~low) | np.arange(len(k), dtype=np.uint64), 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: size - span], least[span - size :])
    return (least & low).astype(np.int64)


def edges_of(h: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The edges of a text with word hashes h: anchor, node left, node entered, first window, number of windows."""
    out = []
    for s in range(0, max(len(h) - width + 1, 0), STRETCH):
        own = h[s : s + STRETCH + width - 1]
        k = rolling(own, anchor, FACTOR)
        p = anchors(k, width - anchor + 1)
        a = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1])
        end = np.append(a[1:], len(p))
        nodes = rolling(own, width - 1, OTHER)
        out.append((k[p[a]], nodes[a], nodes[end], a + s, end - a))
    if not out:
        none = np.empty(0, dtype=np.uint64)
        return none, none, none, none.astype(np.int64), none.astype(np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def at_source(words: list[bytes], a: int, b: int, width: int) -> bytes:
    """128 bits of the words of windows a to b."""
    return xxhash.xxh3_128_digest(b" ".join(words[a : b + width]))


def verified_copies(texts: list[bytes | None], which: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray, same: np.ndarray, width: int) -> np.ndarray:
    """same, where the words of an edge are those of the edge before it in order (which: its text; a, b: its windows)."""
    at = np.flatnonzero(same)
    sides = np.unique(np.concatenate([order[at], order[at + 1]]))
    name, words, last = {}, [], -1
    for e in sides[np.argsort(which[sides], kind="stable")].tolist():
        if which[e] != last:
            last = which[e]
            words = texts[last].split()
        name[e] = at_source(words, int(a[e]), int(b[e]), width)
    out = same.copy()
    out[at] = [name[x] == name[y] for x, y in zip(order[at].tolist(), order[at + 1].tolist(), strict=True)]
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs plus k and k2, 96 bits that name a row's id and text."""
    text = F.col(text_col).cast("string")
    return docs.withColumn("k", F.xxhash64(F.col(id_col), text)).withColumn("k2", F.hash(F.lit("second"), text, F.col(id_col)))


def edges(rows: DataFrame, width: int, anchor: int) -> DataFrame:
    """EDGES of rows (k, k2, text). Of edges that are equal within an Arrow batch one travels, as `twice`; the others are repeated for certain and leave as `local` paths."""
    schema = arrow_type(EDGES)

    def each(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = utf8(batch, "text")
            found = [edges_of(hashes(t.split()), width, anchor) if t else None for t in texts]
            which = np.repeat(np.arange(len(found)), [len(f[0]) if f else 0 for f in found])
            if not len(which):
                continue
            m, l, r, a, n = (np.concatenate([f[i] for f in found if f]) for i in range(5))
            b, c = a + n - 1, mixed(mixed(l) + r) ^ n.astype(np.uint64)
            m, l, r = m.view(np.int64), l.view(np.int64), r.view(np.int64)
            order = np.argsort(c, kind="stable")
            same = np.logical_and.reduce([np.diff(x[order]) == 0 for x in (c, l, r, n)])
            same = verified_copies(texts, which, a, b, order, same, width)
            local, twice = np.zeros(len(m), dtype=bool), np.zeros(len(m), dtype=bool)
            local[order[1:]] = same
            twice[order[:-1]] = same
            go = np.flatnonzero(~local)
            stay = np.flatnonzero(local)
            if len(stay):  # local edges that follow each other are one path
                new = np.concatenate([[True], (which[stay][1:] != which[stay][:-1]) | (a[stay][1:] != b[stay][:-1] + 1)])
                first, last = stay[new], stay[np.append(np.flatnonzero(new)[1:] - 1, len(stay) - 1)]
            else:
                first = last = stay
            k, k2 = batch.column(batch.schema.get_field_index("k")).to_numpy(), batch.column(batch.schema.get_field_index("k2")).to_numpy()
            start = np.concatenate([go, first])
            y, z = len(go), len(first)
            none = np.zeros(z, dtype=np.int64)
            cols = [np.concatenate([m[go], k[which[first]]]), np.concatenate([l[go], none]), np.concatenate([r[go], none]), k[which[start]], k2[which[start]],
                    a[start].astype(np.int32), np.concatenate([n[go], b[last] - a[first] + 1]).astype(np.int32), np.concatenate([twice[go], np.ones(z, dtype=bool)]), np.arange(y + z) >= y]
            for s in range(0, y + z, 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000], type=f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.mapInArrow(each, T.StructType(fields(EDGES)))


def compacted(found: DataFrame) -> DataFrame:
    """(edge, p, size): the nonbranching path of each linked edge, and how many edges that path has.

    found: distinct repeated edges (e, l, r). An edge is joined with the next where it alone enters the node that the next
    alone leaves; the links contract by joins, in rounds that grow with the logarithm of the longest path.
    """
    enters = found.groupBy(F.col("r").alias("node")).agg(F.min("e").alias("u"), F.count("*").alias("n_in")).where("n_in = 1")
    leaves = found.groupBy(F.col("l").alias("node")).agg(F.min("e").alias("v"), F.count("*").alias("n_out")).where("n_out = 1")
    paths = components(enters.join(leaves, "node").select("u", "v"), salts=4)  # a path is no longer than a text
    return stored(paths.select(F.col("node").alias("edge"), F.col("root").alias("p"), F.count("*").over(W.partitionBy("root")).cast("int").alias("size")), "paths")


def spans_of(words: list[bytes], a: np.ndarray, b: np.ndarray, p: np.ndarray, size: np.ndarray, nth: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, list]:
    """What to compare of a text's edges (in order): their names, which go alone, and rows (path, role, digest, first and last window) of its paths.

    Edges of one path that follow each other are a run. A run of all edges of the path goes as one span under the XOR of
    their names; the edges of other runs go alone, and so do the first two sources of every edge, whose names make the path's digest.
    """
    names = np.frombuffer(b"".join(at_source(words, x, y, width) for x, y in zip(a.tolist(), b.tolist(), strict=True)), dtype=np.int64).reshape(-1, 2)
    if not len(a):
        return names, np.empty(0, dtype=bool), []
    start = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (a[1:] != b[:-1] + 1) | (size[1:] == 1)]))
    count = np.diff(np.append(start, len(a)))
    whole = (count == size[start]) & (count > 1)
    last = start + count - 1
    rows = []
    for role, of in ((FIRST, nth == FIRST), (SECOND, nth == SECOND), (THROUGH, np.repeat(whole, count))):
        digest = np.bitwise_xor.reduceat(np.where(of[:, None], names, 0), start, axis=0)
        at = np.flatnonzero(np.logical_or.reduceat(of, start) & (size[start] > 1))
        rows += zip(p[start[at]].tolist(), [role] * len(at), digest[at, 0].tolist(), digest[at, 1].tolist(), a[start[at]].tolist(), b[last[at]].tolist(), strict=True)
    return names, ~np.repeat(whole, count) | (nth <= SECOND), rows


def windows(rows: DataFrame, width: int) -> DataFrame:
    """WINDOWS of rows (k, k2, text, asks): the spans and edges asked for by the words at their coordinates, and each window of the other edges."""
    schema = arrow_type(WINDOWS)

    def each(batches):
        hashes = WordHashes()
        for batch in batches:
            asks = batch.column(batch.schema.get_field_index("asks"))
            k, k2 = batch.column(batch.schema.get_field_index("k")).to_pylist(), batch.column(batch.schema.get_field_index("k2")).to_pylist()
            for text, i, j, own in zip(utf8(batch, "text"), k, k2, asks, strict=True):
                own = own.values
                a, b, known, whole, p, size, nth = (own.field(n).to_numpy(zero_copy_only=False) for n in ("a", "b", "known", "whole", "p", "size", "nth"))
                words = text.split()
                at = np.flatnonzero(whole)
                at = at[np.argsort(a[at], kind="stable")]
                names, alone, runs = spans_of(words, a[at], b[at], p[at], size[at], nth[at], width)
                edge, names = at[alone], names[alone]
                run = np.array(runs, dtype=np.int64).reshape(-1, 6)
                n = np.where(whole, 0, b - a + 1)
                w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                h = hashes(words) if len(w) else np.empty(0, dtype=np.uint64)
                one, two = (rolling(h, width, f)[w].view(np.int64) for f in (OTHER, FACTOR))
                parts = (len(w), len(edge), len(run))
                none = np.zeros(parts[0] + parts[1], dtype=np.int64)
                cols = [np.concatenate([one, names[:, 0], run[:, 0]]), np.concatenate([two, names[:, 1], np.zeros(len(run), dtype=np.int64)]), np.repeat([WINDOW, EDGE, PATH], parts),
                        np.concatenate([none, run[:, 1]]), np.concatenate([none, run[:, 2]]), np.concatenate([none, run[:, 3]]), np.full(sum(parts), i), np.full(sum(parts), j),
                        np.concatenate([w, a[edge], run[:, 4]]), np.concatenate([w, b[edge], run[:, 5]]), np.concatenate([np.repeat(known, n), known[edge], np.zeros(len(run))]).astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(f.type.to_pandas_dtype()), type=f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.mapInArrow(each, T.StructType(fields(WINDOWS)))


def repeated_paths(rows: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(k, k2, paths): for each text with repeated windows, the first and last windows of the stretches they fill.

    rows: k, k2, text. Copies of an edge collapse within each batch before they meet the others of their anchor; what
    meets is streamed by a window function, which spills. The edges are stored once they are judged. Edges that others
    name alike are put on the paths of the graph and verified on their words, by whole paths where a text runs through one;
    so are the windows of edges whose anchor has other surroundings too.
    """
    if anchor < 2:
        raise ValueError("an anchor of one word leaves words of an edge outside of its nodes")
    found = edges(rows.select("k", "k2", "text"), width, anchor)
    by_m, by_c = W.partitionBy("m", "local"), W.partitionBy("m", "local", "l", "r", "n")
    differs = lambda x: F.min(x).over(by_m) != F.max(x).over(by_m)
    judged = (
        found.withColumn("others", F.count("*").over(by_c) > 1).withColumn("copied", F.max("twice").over(by_c))
        .withColumn("contents", differs("l") | differs("r") | differs("n")).withColumn("nth", F.least(F.row_number().over(by_c.orderBy("k", "a")), F.lit(3)).cast("byte"))
    )
    whole = F.col("others") & ~F.col("local")
    source = whole & (F.col("nth") == 1)
    judged = judged.select("k", "k2", "a", (F.col("a") + F.col("n") - 1).alias("b"), "local", (F.col("local") | F.col("others") | F.col("copied")).alias("known"), whole.alias("whole"), "twice", "nth",
                           (~F.col("local") & F.col("contents") & (F.col("nth") == 1)).alias("ask"), F.when(whole, F.xxhash64("m", "l", "r", "n")).alias("e"), F.when(source, F.col("l")).alias("l"), F.when(source, F.col("r")).alias("r"))
    judged = stored(judged.where("known or ask"), "edges")
    paths = compacted(judged.where("whole and nth = 1").select("e", "l", "r"))
    entry = lambda known, whole, p, size, nth: F.struct("a", "b", known.alias("known"), F.lit(whole).alias("whole"), p.alias("p"), size.alias("size"), nth.alias("nth"))
    # an edge comes once from a batch at most, so that none holds many rows
    on_paths = looked_up(judged.where("whole").select("k", "k2", "a", "b", "twice", "nth", "e"), paths, "e", "edge", salts=4)
    asked = on_paths.select("k", "k2", entry(F.col("twice"), True, F.coalesce("p", "e"), F.coalesce("size", F.lit(1)), F.col("nth")).alias("x")).unionByName(
        judged.where("ask").select("k", "k2", entry(F.lit(False), False, F.lit(0).cast("long"), F.lit(1), F.lit(0).cast("byte")).alias("x")))
    asks = asked.groupBy("k", "k2").agg(F.collect_list("x").alias("asks"))  # of one text
    # a text that occurs twice has no unknown edge, so its windows may be counted twice; its edges, too, are repeated
    seen = windows(rows.join(asks, ["k", "k2"]).select("k", "k2", "text", "asks"), width)
    by_name = W.partitionBy("g", "h", "kind")
    part = F.struct("role", "k", "k2", "a", "v", "w")
    again = F.coalesce(F.lag(part).over(by_name.orderBy("role", "k", "k2", "a", "v", "w")) == part, F.lit(False))  # of an equal row
    seen = seen.withColumn("again", again).withColumn("n", F.count("*").over(by_name))
    right = F.col("role") == THROUGH
    for role in (FIRST, SECOND):
        for x in ("v", "w"):
            right = right & (F.bit_xor(F.when(~F.col("again") & (F.col("role") == role), F.col(x))).over(by_name) == F.col(x))
    seen = seen.withColumn("right", right)
    more = seen.where(f"kind = {WINDOW} and n > 1 or kind = {EDGE} and (n > 1 or known) or kind = {PATH} and right").select("k", "k2", "a", "b")
    spans = judged.where("known and not whole").select("k", "k2", "a", "b").unionByName(more)
    return spans.groupBy("k", "k2").agg(F.collect_list(F.struct("a", "b")).alias("paths"))


def without(text: bytes | None, a: np.ndarray, b: np.ndarray, width: int) -> tuple[int, int, bytes]:
    """Words, words removed, and the words left with one space between them."""
    words = text.split() if text else []
    if not len(a):
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b + width, -1)
    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
    return len(words), len(words) - len(stay), b" ".join([words[i] for i in stay])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """docs plus n_words, n_removed, kept_text and kept_sha256: each word in a window that also starts elsewhere is gone.

    Windows are judged on the input. Null or empty texts have no words; texts shorter than a window lose nothing;
    repeated rows repeat each other's windows and lose them all; null ids are documents as any other; an empty table
    gives no rows. Input columns with the names of results are replaced. Texts may be of any length: memory grows with the longest.
    """
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    paths = repeated_paths(rows, width, anchor).select(F.col("k").alias("__k"), F.col("k2").alias("__k2"), F.col("paths").alias("__paths"))
    k = keyed(docs.drop("k", "k2"), id_col, text_col).withColumnRenamed("k", "__mine").withColumnRenamed("k2", "__mine2")
    if {"k", "k2"} & set(docs.columns):  # the document's own k and k2 stay
        text = F.col(text_col)
        k = docs.withColumn("__mine", F.xxhash64(F.col(id_col), text)).withColumn("__mine2", F.hash(F.lit("second"), text, F.col(id_col)))
    joined = k.join(paths, (F.col("__mine") == F.col("__k")) & (F.col("__mine2") == F.col("__k2")), "left").drop("__mine", "__mine2", "__k", "__k2")
    kept, schema = [c for c in kept_names(joined, CUT) if c != "__paths"], arrow_type(CUT)

    def each(batches):
        for batch in batches:
            out = []
            for text, paths in zip(utf8(batch, text_col), batch.column(batch.schema.get_field_index("__paths")), strict=True):
                own = paths.values if paths.is_valid else None
                a, b = (own.field(n).to_numpy().astype(np.int64) if own is not None else np.empty(0, dtype=np.int64) for n in ("a", "b"))
                n, gone, left = without(text, a, b, width)
                out.append((n, gone, left.decode(), hashlib.sha256(left).hexdigest()))
            yield with_columns(batch, kept, schema, [list(c) for c in zip(*out, strict=True)] if out else [[]] * 4)

    return arrow_map(joined, CUT, each, keep=kept)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with all their columns, with repeated windows cut from the text; a text that loses nothing stays as it is, null too.

    Odd rows count as in `cut_repeats`. Columns keep their names, whatever they are. Empty table: empty result.
    """
    rows, names, restored = shielded(docs)
    t = names[text_col]
    out = cut_repeats(rows, names[id_col], t, **options)
    return restored(out.withColumn(t, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(t))))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT rid, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT rid, i + o AS p FROM r, (SELECT unnest(range(0, 35)) AS o)),
x AS (SELECT rid, list(p) AS ps FROM c GROUP BY rid),
k AS (
  SELECT d.rid, doc_id, len(ws) AS n, coalesce(len(ps), 0) AS gone, coalesce(t.kept, CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE '' END) AS kept
  FROM d LEFT JOIN x USING (rid) LEFT JOIN (
    SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept
    FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d WHERE rid IN (SELECT rid FROM x)) u
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rid = u.rid AND c.p = u.p) GROUP BY rid) t USING (rid))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""
