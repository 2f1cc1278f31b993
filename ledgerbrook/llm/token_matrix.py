"""Token-id matrices: best-fit-decreasing packing with a segment tree over free space."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, fields, stored, table, utf8
from .tokens import END, default_tokenizer, encoder

#: A task packs its documents in blocks of about so many tokens, which bounds its memory.
BLOCK_TOKENS = 4_000_000
SEQUENCE = "sequence_id long, pieces array<int>, starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"


class CapacityTree:
    """Counts of bins by free space in a segment tree; finds the least free space that holds a size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, by: int) -> None:
        node = free + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, size: int) -> int | None:
        node = size + self.leaves
        if self.count[node]:
            return size
        while node > 1:  # up to the first ancestor with bins to the right, then down to the leftmost
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into sizes (each at most capacity); largest first, ties in the given order."""
    tree, by_free, bins = CapacityTree(capacity), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        free = tree.least(sizes[i])
        if free is None:
            free, b = capacity, len(bins)
            bins.append([])
        else:
            b = by_free[free].pop()
            tree.add(free, -1)
        bins[b].append(i)
        if free > sizes[i]:
            by_free.setdefault(free - sizes[i], []).append(b)
            tree.add(free - sizes[i], 1)
    return bins


def token_matrix(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row per packed sequence, with `<id_col>s` (of its segments) and:

    pieces, starts: which piece of its document each segment is, and where in the document it starts; cu_seqlens:
    cumulative lengths from 0; n_tokens; ids: `capacity` little-endian uint32, padded with 0; positions: int32 that
    restart at 0 with each segment (padding: 0). A document is its token ids and a closing 0 (null or empty text: the 0
    alone); a longer one than capacity is cut into pieces, none lost. Null and repeated ids are kept as they are; an
    empty table gives no rows. Extra columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = arrow_type(SEQUENCE)
    names = f"{id_col}s"
    out = T.StructType([T.StructField(names, T.ArrayType(rows.schema["id"].dataType), True)] + fields(SEQUENCE))

    def each(batches):
        from pyspark import TaskContext

        base, encode, made = TaskContext.get().partitionId() << 36, encoder(path), 0
        held, tokens, kind = [], 0, None

        def packed():
            nonlocal made
            bins = best_fit_decreasing([len(ids) // 4 for *_, ids in held], capacity)
            for begin in range(0, len(bins), 256):
                own = bins[begin : begin + 256]
                lengths = [[len(held[i][3]) // 4 for i in b] for b in own]
                ends = [[0, *np.cumsum(x).tolist()] for x in lengths]
                ids = [b"".join(held[i][3] for i in b).ljust(4 * capacity, b"\0") for b in own]
                positions = []
                for e in ends:
                    p = np.zeros(capacity, dtype="<i4")
                    for a, z in pairwise(e):
                        p[a:z] = np.arange(z - a)
                    positions.append(p.tobytes())
                cols = [list(range(base + made, base + made + len(own))), [[held[i][1] for i in b] for b in own], [[held[i][2] for i in b] for b in own], ends, [e[-1] for e in ends], ids, positions]
                made += len(own)
                yield pa.RecordBatch.from_arrays([pa.array([[held[i][0] for i in b] for b in own], type=pa.list_(kind))] + [pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], names=[names, *schema.names])
            held.clear()

        for batch in batches:
            kind = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), encode(utf8(batch, "text")), strict=True):
                ids += END
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    held.append((doc, k, start, ids[4 * start : 4 * (start + capacity)]))
                tokens += len(ids) // 4
                if tokens >= block_tokens:
                    yield from packed()
                    tokens = 0
        if held:
            yield from packed()

    return rows.mapInArrow(each, out)


def op6_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices are written to the shared folder; the query reads them back."""
    rows = stored(token_matrix(table(spark, sf_dir, "documents")), "token-matrix", **{"parquet.block.size": str(16 << 20)})  # rows are wide: small row groups keep writers small
    return rows.select("sequence_id", "doc_ids", "pieces", "starts", "cu_seqlens", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
