"""Helpers that the training-data operators share: scratch tables, Arrow maps, words and window codes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch

#: ASCII white space as bytes.split() takes it: \x20 and \x09-\x0D.
SPACE = b" \t\n\x0b\x0c\r"
#: What tasks leave in their worker process for the next ones: the encoders of packing.
KEPT: dict = {}


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder once and read it from there: later steps neither recompute it nor need the executors that made it."""
    path = scratch(df.sparkSession, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, small: DataFrame, key: str, name: str, how: str = "left", most: int = 200_000, salts: int = 32) -> DataFrame:
    """rows joined with small (stored, one row per `name`, a few narrow columns) where rows.key = small.name; a key may hold most rows.

    small is broadcast up to `most` rows; beyond, each of its rows meets the rows of its key in `salts` places.
    """
    if small.count() <= most:
        return rows.join(F.broadcast(small), F.col(key) == F.col(name), how)
    salt = F.pmod(F.xxhash64(*(c for c, t in rows.dtypes if not t.startswith("map"))), F.lit(salts))
    small = small.withColumn("__salted", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("__salt", salt).join(small, (F.col(key) == F.col(name)) & (F.col("__salt") == F.col("__salted")), how).drop("__salt", "__salted")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def arrow_map(df: DataFrame, ddl: str, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: Iterable[str] | None = None) -> DataFrame:
    """mapInArrow with the schema of the kept columns of df and then those of ddl; a new column replaces a kept one of the same name."""
    new = fields(ddl)
    names = {f.name for f in new}
    kept = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in set(keep))]
    return df.mapInArrow(each, T.StructType([T.StructField(f.name, f.dataType, True) for f in kept + new]))


def arrow_type(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType(fields(ddl)))


def with_columns(batch: pa.RecordBatch, kept: list[str], schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """The kept columns of batch, then columns (lists or arrays) typed as in schema."""
    made = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in kept] + made, names=kept + schema.names)


def kept_names(df: DataFrame, ddl: str) -> list[str]:
    new = {f.name for f in fields(ddl)}
    return [n for n in df.columns if n not in new]


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The texts of a column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def dense_ids(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Each word's number by first appearance, and how many there are."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    return ids, len(seen)


def window_codes(ids: np.ndarray, size: int, k: int) -> np.ndarray:
    """A code for each run of k ids (ids < size) that is equal exactly where the runs are. Empty for fewer than k ids."""
    if len(ids) < k:
        return np.empty(0, dtype=np.int64)
    code, span, size = ids, max(size, 1), max(size, 1)
    for j in range(1, k):
        if span * size >= 2**62:
            _, code = np.unique(code, return_inverse=True)
            span = int(code.max()) + 1
        code = code[:-1] * size + ids[j:]
        span *= size
    return code


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of that width beginning at one of starts."""
    edge = np.zeros(n + width + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0


def released() -> None:
    """Give back what earlier tasks left in this worker process, which Spark uses again for any operator: encoders, and freed memory that Arrow and malloc hold."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # malloc's


class WordHashes:
    """64-bit hashes of words, remembered for at most `most` distinct words at a time. A task begins with them, so memory of earlier tasks is given back."""

    def __init__(self, most: int = 150_000):
        import xxhash

        released()
        self.most, self.seen, self.hash = most, {}, xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        try:
            return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            for w in set(words):
                if w not in seen:
                    seen[w] = self.hash(w)
            return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(h: np.ndarray, k: int, factor: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of each run of k values, mixed so that all bits depend on all values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    f = np.uint64(factor | 1)
    out = h[:n].copy()
    for j in range(1, k):
        out *= f
        out += h[j : j + n]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_key(*cols) -> F.Column:
    """128 bits that name a value: two independent 64-bit hashes side by side."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *cols).alias("b"))


def table_bytes(df: DataFrame, *cols: str) -> int:
    """Bytes of text in the columns plus 16 for each row, counted by Spark."""
    size = F.lit(16)
    for c in cols:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return int(df.agg(F.sum(size.cast("long"))).first()[0] or 0)


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """df with columns named so that no operator's results clash with them, the new names, and what gives df's own columns back."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names, lambda out: out.select(*(F.col(n).alias(c) for c, n in names.items()))
