"""Benchmark decontamination: suffix arrays over the documents, searched for every benchmark suffix."""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, arrow_type, covered, kept_names, released, shielded, stored, table, table_bytes, utf8, with_columns

#: Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters; every other byte separates.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The benchmark goes to the executors in blocks of about so many bytes; each block passes over the documents.
BLOCK_BYTES = 16 << 20
#: Passes in one stage; what they found is stored before the next ones, so that a task's workers don't grow with the benchmark.
PASSES = 4
#: Words of a shard of documents, over which one suffix array is built. A longer document is a shard by itself.
SHARD_WORDS = 2_000_000
FOUND = "n_words long, hit binary, matches array<struct<item_id:string,item_start:int,doc_start:long,length:long>>, n_hit long"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


class Block:
    """A block of benchmark items: their words as numbers from 1 in one row, with a 0 after each item, and all windows.

    A window is `width` consecutive words of an item, or all words of a shorter one.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.width, self.names, ids, starts, spans = width, [], [], [], []
        for name, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if own:
                span = min(width, len(own))
                starts += range(len(ids), len(ids) + len(own) - span + 1)
                spans += [span] * (len(own) - span + 1)
                self.names += [(name, len(ids))] * (len(own) + 1)
                ids += own + [0]
        self.ids, self.starts, self.spans = np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(spans, dtype=np.int64)
        self.least = min(spans, default=width)
        self.bits = max(1, len(self.vocabulary).bit_length())
        if ids:  # equal windows are searched once; all their places are kept
            own = self.keys(self.ids, self.starts, self.spans, 0)
            order = np.lexsort([*own[::-1], self.spans])
            same = np.all([np.diff(k[order]) == 0 for k in [*own, self.spans]], axis=0)
            self.which = np.empty(len(order), dtype=np.int64)
            self.which[order] = np.concatenate([[0], np.cumsum(~same)])
            self.first = order[np.concatenate([[True], ~same])]
            self.places = np.split(self.starts[np.argsort(self.which, kind="stable")], np.cumsum(np.bincount(self.which))[:-1])
            self.low = self.keys(self.ids, self.starts[self.first], self.spans[self.first], 0)
            self.high = self.keys(self.ids, self.starts[self.first], self.spans[self.first], (1 << self.bits) - 1)

    def keys(self, ids: np.ndarray, starts: np.ndarray, spans: np.ndarray | None, beyond: int) -> list[np.ndarray]:
        """The first `width` words from each start, packed in columns of int64; words past the span count as `beyond`."""
        padded = np.concatenate([ids, np.zeros(self.width, dtype=np.int64)])
        per, out = 62 // self.bits, []
        for begin in range(0, self.width, per):
            key = np.zeros(len(starts), dtype=np.int64)
            for j in range(begin, min(begin + per, self.width)):
                word = padded[starts + j]
                key = (key << self.bits) | (word if spans is None else np.where(j < spans, word, beyond))
            out.append(key)
        return out

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a shard and the windows that start there: binary search of every window in the shard's suffix array.

        The array holds the suffixes that begin with at least `least` benchmark words (no others can match), in the
        order of their first `width` words, the depth of a window.
        """
        none = np.empty(0, dtype=np.int64)
        if not len(self.ids) or not len(ids):
            return none, none
        stops = np.append(np.flatnonzero(ids == 0), len(ids))
        starts = np.flatnonzero(ids)
        starts = starts[stops[np.searchsorted(stops, starts)] - starts >= self.least]
        if not len(starts):
            return none, none
        columns = self.keys(ids, starts, None, 0)
        order = np.lexsort(columns[::-1])
        columns, suffixes = [c[order] for c in columns], starts[order]
        lo, hi = bound(columns, self.low, False), bound(columns, self.high, True)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        return suffixes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)], which


def bound(columns: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all wanted keys at once: the first row not below (after: above) each, rows in lexicographic order."""
    lo, hi = np.zeros(len(wanted[0]), dtype=np.int64), np.full(len(wanted[0]), len(columns[0]), dtype=np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        at = np.minimum(mid, len(columns[0]) - 1)
        less, equal = np.zeros(len(lo), dtype=bool), np.ones(len(lo), dtype=bool)
        for c, w in zip(columns, wanted, strict=True):
            less |= equal & (c[at] < w)
            equal &= c[at] == w
        right = (less | equal if after else less) & (lo < hi)
        lo, hi = np.where(right, mid + 1, lo), np.where(right, hi, np.minimum(mid, hi))
    return lo


def longest(block: Block, at: np.ndarray, which: np.ndarray) -> list[tuple[str, int, int, int]]:
    """For each item found in a document, its longest verbatim match (the first of equals): item, place in it, place in the document, words.

    at: places in the document in order, which: the window found there. Matches grow word by word along item and document.
    """
    best: dict[tuple[str, int], tuple[int, int, int]] = {}
    alive: dict[int, tuple[int, int]] = {}
    before = -2
    by_place = defaultdict(list)
    for p, w in zip(at.tolist(), which.tolist(), strict=True):
        by_place[p].append(w)
    for p, found in by_place.items():
        old, alive, before = (alive if p == before + 1 else {}), {}, p
        for w in found:
            span = int(block.spans[block.first[w]])
            for t in block.places[w].tolist():
                begun = old.get(t - 1, (p,))[0]
                alive[t] = (begun,)
                item = block.names[t]
                length = p - begun + span
                if length > best.get(item, (0,))[0]:
                    best[item] = (length, begun, t - (p - begun) - item[1])
    return [(item[0], item_start, doc_start, length) for item, (length, doc_start, item_start) in sorted(best.items(), key=lambda x: (x[0][1], x[0][0]))]


def search_texts(block: Block, texts: list[bytes | None], shard_words: int) -> list[tuple[int, bytes, list]]:
    """For each text: its number of words, a bit for each word that a found window covers, and the longest matches."""
    out: list[tuple[int, bytes, list]] = []
    held: list[np.ndarray] = []

    def flush():
        if not held:
            return
        at, which = block.search(np.concatenate([x for ids in held for x in (ids, np.zeros(1, dtype=np.int64))]))
        order = np.lexsort([which, at])
        at, which = at[order], which[order]
        begin = 0
        for ids in held:
            lo, hi = np.searchsorted(at, [begin, begin + len(ids)])
            if lo == hi:
                out.append((len(ids), b"", []))
            else:
                own = at[lo:hi] - begin
                hit = np.zeros(len(ids), dtype=bool)
                spans = block.spans[block.first[which[lo:hi]]]
                for s in np.unique(spans):
                    hit |= covered(own[spans == s], int(s), len(ids))
                out.append((len(ids), np.packbits(hit, bitorder="little").tobytes(), longest(block, own, which[lo:hi])))
            begin += len(ids) + 1
        held.clear()

    size, get = 0, block.vocabulary.get
    for text in texts:
        words = words_of(text)
        held.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
        size += len(words)
        if size >= shard_words:
            flush()
            size = 0
    flush()
    return out


def joined(a: bytes, b: bytes) -> bytes:
    """Union of two rows of bits."""
    if not a or not b:
        return a or b
    return np.bitwise_or(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tobytes()


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs plus n_words, n_hit, matches (the longest one of each item found), n_items, items_sha256 and contaminated.

    Documents are never shuffled: each task builds suffix arrays over shards of its rows and searches them for every
    benchmark window. The benchmark's size is taken first; it is broadcast in blocks of about block_bytes, however many
    that takes, and one pass over the rows in the same stage serves each block. Null or empty texts have no words and
    no hits; items without words find nothing; a null item id reads ''; items with equal ids count as one; repeated
    rows each get their result; a text longer than a shard is a shard by itself; empty tables are allowed. Input columns with the names of results are replaced.
    """
    spark = docs.sparkSession
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    blocks = max(1, -(-table_bytes(items, "text") // block_bytes))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # about block_bytes
        block = spark.sparkContext.broadcast(Block(sorted((r.id, r.text.encode() if r.text is not None else None) for r in own), width))
        docs = _pass(docs, block, text_col, b == 0, shard_words)
        if b % PASSES == PASSES - 1 and b + 1 < blocks:
            docs = stored(docs, "searched")
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return docs.withColumn("n_items", F.size(ids).cast("long")).withColumn("items_sha256", F.sha2(F.array_join(ids, ",").cast("binary"), 256)).withColumn("contaminated", F.col("n_hit") > 0).drop("hit")


def _pass(docs: DataFrame, block, text_col: str, first: bool, shard_words: int) -> DataFrame:
    kept, schema = kept_names(docs, FOUND), arrow_type(FOUND)

    def each(batches):
        released()
        for batch in batches:
            found = search_texts(block.value, utf8(batch, text_col), shard_words)
            if not first:
                hits, old = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("hit", "matches"))
                found = [(n, joined(hit, h), [tuple(m.values()) for m in o] + matches) for (n, hit, matches), h, o in zip(found, hits, old, strict=True)]
            names = [f.name for f in schema.field("matches").type.value_type]
            yield with_columns(batch, kept, schema, [
                [n for n, _, _ in found], [h for _, h, _ in found], [[dict(zip(names, m, strict=True)) for m in x] for _, _, x in found],
                [int.from_bytes(h, "little").bit_count() for _, h, _ in found]])

    return arrow_map(docs, FOUND, each)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs, with all their columns, without the documents in which a benchmark window occurs.

    Null and empty texts stay. Texts may be of any length: memory grows with the longest. An empty benchmark keeps all; an empty table gives no rows.
    """
    rows, names, restored = shielded(docs)
    return restored(find_benchmark(rows, benchmark, text_col=names[text_col], **options).where(~F.col("contaminated")))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
hit AS (SELECT rid, i, k, item FROM dw JOIN bw USING (k, g)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM hit)) GROUP BY rid),
its AS (SELECT rid, list(DISTINCT item ORDER BY item) AS xs FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(xs), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(xs, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
