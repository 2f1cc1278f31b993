"""Best-fit packing with bounded space: a fixed number of open bins in a bitset keyed by free space."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, fields, stored, table, utf8
from .tokens import END, default_tokenizer, encoder

#: Bins open at once in a stream of documents.
OPEN_BINS = 1024
#: The moves of bins that a stream leaves open are broadcast up to so many rows; beyond, they join by a shuffle.
BROADCAST_MOVES = 200_000
#: Bins left open that one task packs again.
REPACK = 100_000
PIECES = "piece int, start long, length long, ids binary, bin long, offset long, left_open boolean"


class BoundedBestFit:
    """Online best fit with at most `most` open bins; the fullest closes first.

    Bit f of `bits` says that some open bin has f places free; the lowest set bit from `size` on is the best fit.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.bits, self.n_open, self.made = capacity, most, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _put(self, free: int, b: int) -> None:
        self.by_free.setdefault(free, []).append(b)
        self.bits |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if size < self.capacity and self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, b = self.capacity, self.made
            self.made += 1
        if free > size:
            self._put(free - size, b)
        return b, self.capacity - free

    def left(self) -> list[tuple[int, int]]:
        """Bins still open, and what they hold."""
        return [(b, self.capacity - free) for free, bins in self.by_free.items() for b in bins]


def pack(docs: DataFrame, capacity: int = 2048, text_col: str = "text", tokenizer: str | None = None, open_bins: int = OPEN_BINS, repack: int = REPACK, broadcast_moves: int = BROADCAST_MOVES) -> DataFrame:
    """A row per piece: the columns of docs but the text, then piece, start, length, ids, sequence_id, offset.

    A document is its token ids and a closing 0 (null or empty text: the 0 alone). Only longer ones than `capacity` are
    cut. ids holds little-endian uint32. Each task packs its rows as one stream; bins still open at its end travel as
    whole bins to a second best fit, so short streams waste little. Pieces are stored once, so numbers stay the same
    whatever is computed again. Repeated and null rows are packed as any other; an empty table gives no rows. Columns
    of docs with the names of results are replaced.
    """
    path = tokenizer or default_tokenizer()
    names = {f.name for f in fields(PIECES)} | {"sequence_id", text_col}
    payload = [c for c in docs.columns if c not in names]
    rows = docs.select(*payload, F.col(text_col).cast("string").alias("__text"))
    schema = arrow_type(PIECES)
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields[:-1]] + fields(PIECES))

    def stream(batches):
        from pyspark import TaskContext

        base, encode, fit = TaskContext.get().partitionId() << 36, encoder(path), BoundedBestFit(capacity, open_bins)
        empty = None

        def made(batch, which, cols):
            own = [batch.column(i).take(pa.array(which, type=pa.int32())) for i in range(len(payload))]
            return pa.RecordBatch.from_arrays(own + [pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], names=payload + schema.names)

        for batch in batches:
            empty = batch.slice(0, 0)
            which, cols, size = [], [[] for _ in schema], 0
            for i, ids in enumerate(encode(utf8(batch, "__text"))):
                ids += END
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    b, offset = fit.place(len(own) // 4)
                    which.append(i)
                    for c, x in zip(cols, (k, start, len(own) // 4, own, base + b, offset, None), strict=True):
                        c.append(x)
                    size += len(own)
                if size >= 16 << 20:
                    yield made(batch, which, cols)
                    which, cols, size = [], [[] for _ in schema], 0
            if which:
                yield made(batch, which, cols)
        if empty is not None and (left := fit.left()):  # what is open, as rows without a document
            n = len(left)
            nulls = [pa.nulls(n, empty.column(i).type) for i in range(len(payload))]
            cols = [[None] * n, [None] * n, [used for _, used in left], [None] * n, [base + b for b, _ in left], [None] * n, [True] * n]
            yield pa.RecordBatch.from_arrays(nulls + [pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], names=payload + schema.names)

    placed = stored(rows.mapInArrow(stream, out), "packed")
    open_ = placed.where("left_open").select("bin", F.col("length").alias("used"))
    n = open_.count()
    moves = _repacked(open_.repartition(max(1, -(-n // repack))), capacity, open_bins)
    moves = moves.withColumnRenamed("bin", "__bin")
    if n <= broadcast_moves:
        moves = F.broadcast(moves)
    pieces = placed.where(F.col("left_open").isNull()).join(moves, F.col("bin") == F.col("__bin"), "left")
    return pieces.select(*payload, "piece", "start", "length", "ids", F.coalesce("target", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0).cast("long"))).alias("offset"))


def _repacked(bins: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """Where each bin that was left open goes: bin, target (a bin's number, as sequence), shift."""
    schema = arrow_type("bin long, target long, shift long")

    def stream(batches):
        fit, first = BoundedBestFit(capacity, open_bins), {}
        for batch in batches:
            rows = []
            for b, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target, offset = fit.place(used)
                rows.append((b, first.setdefault(target, b), offset))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return bins.sortWithinPartitions(F.col("used").desc(), "bin").mapInArrow(stream, T.StructType(fields("bin long, target long, shift long")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
