"""WARC archives: write monolithic gzip files, normalise them to one member a record with an offset index, read them back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, fields, scratch, stored, table, utf8

CHUNK = 1 << 20
MANIFEST = "path string, records long, bytes long"
INDEX = "path string, offset long, length long, record_id string, record_type string, target string"
RECORD = "record_id string, record_type string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path within it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(record_id: str, kind: str, target: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record. A revisit has no block; its headers give length and digest of the full payload."""
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "2000-01-01T00:00:00Z", "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers_to}>"}
        block = b""
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    # a line break inside a value would end the header
    lines = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, read once in chunks; one member or many."""
    inflate, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            begun = True
            if out := inflate.decompress(data, CHUNK):
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
    if begun and not inflate.eof:
        if out := inflate.flush():
            yield out
        raise ValueError("the gzip stream ends early")


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC stream: headers and the raw bytes of the whole record. Holds one record at a time."""
    buffer, more = bytearray(), True

    def fill() -> bool:
        nonlocal more
        piece = next(chunks, None)
        more = piece is not None
        if more:
            buffer.extend(piece)
        return more

    while True:
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill():
                if buffer.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        head = headers(bytes(buffer[:end]))
        whole = end + 4 + int(head["content-length"]) + 4
        while len(buffer) < whole:
            if not fill():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(buffer[:whole])
        del buffer[:whole]


def bare(uri: str | None) -> str | None:
    return uri.strip("<>") if uri else None


def parsed(head: dict[str, str], raw: bytes) -> tuple:
    """A row of RECORD; a response's digest and length are taken from its payload and held against its headers."""
    digest, length, payload = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]), None
    if head["warc-type"] == "response":
        block = raw[raw.index(b"\r\n\r\n") + 4 : -4]
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if (base32_sha1(payload), len(payload)) != (digest, length):
            raise ValueError(f"{head['warc-record-id']}: the payload doesn't match its headers")
    return bare(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"], bare(head.get("warc-refers-to")), digest, length, payload


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= most or size >= most_bytes:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """pages plus __digest and __response (the id of the response a row revisits, or null).

    Rows with equal payloads of at least least_bytes: the smallest id is the response. Rows that repeat that id are
    responses too; a null id revisits a non-null one. Smallest ids are taken by partial aggregation, and only payloads
    that occur twice are joined back, on narrow rows that Spark may split where a payload is hot.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.withColumn("__digest", F.sha1(payload.cast("binary"))).withColumn("__size", F.octet_length(payload))
    firsts = rows.where(F.col("__size") >= least_bytes).groupBy(F.col("__digest").alias("__d")).agg(F.min(id_col).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    out = rows.join(firsts, F.col("__digest") == F.col("__d"), "left")
    return out.withColumn("__response", F.when((F.col("__size") >= least_bytes) & ~F.col(id_col).eqNullSafe(F.col("__first")), F.col("__first"))).drop("__d", "__first", "__size")


def write_archives(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write a record for each row into monolithic gzip archives under `to`; the manifest (path, records, bytes).

    Each task writes its own files, named at random, and only files in the stored manifest count: a task that runs
    again leaves an unlisted file. Null payloads are empty, null urls are `urn:none`. Null and repeated ids are records as any
    other; extra columns are ignored, whatever their names. Payloads may be of any length: a task holds one at a time. An
    empty table gives an empty manifest.
    """
    rows = with_revisits(pages, id_col, payload_col, least_bytes).select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("urn:none")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"), F.col("__response").cast("string").alias("response"))

    schema = arrow_type(MANIFEST)

    def write(parts):
        where, base = folder(to)
        where.create_dir(base, recursive=True)
        out = name = pack = None
        n = size = 0

        def close():
            nonlocal out, size
            out.write(end := pack.flush())
            out.close()
            size += len(end)
            out = None
            return (f"{to}/{name}", n, size)

        def rows_done():
            nonlocal out, name, pack, n, size
            for part in parts:
                ids, urls, payloads, responses = part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part, "payload"), part.column(3).to_pylist()
                for i, url, payload, response in zip(ids, urls, payloads, responses, strict=True):
                    if out is None:
                        name, pack, n, size = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                        out = where.open_output_stream(f"{base}/{name}", compression=None)
                    kind = "response" if response is None else "revisit"
                    data = pack.compress(record(f"urn:page:{i}", kind, url, payload, base32_sha1(payload), f"urn:page:{response}"))
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= archive_bytes:
                        yield close()
            if out is not None:
                yield close()

        yield from batches(rows_done(), schema)

    return stored(rows.mapInArrow(write, T.StructType(fields(MANIFEST))), "warc-manifest")


def normalise(manifest: DataFrame, to: str) -> DataFrame:
    """Rewrite each archive with one gzip member a record, beside a sidecar offset index (`<archive>.idx`); the index.

    A file's stream is inflated once, front to back; a task holds one record, of any length. The index is stored before it
    is used. An empty manifest gives an empty index; other columns of the manifest are ignored.
    """
    files, schema = max(1, manifest.count()), arrow_type(INDEX)

    def rewrite(parts):
        where, base = folder(to)
        where.create_dir(base, recursive=True)

        def rows():
            for part in parts:
                for path in part.column(part.schema.get_field_index("path")).to_pylist():
                    source, inner = folder(path)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    at = 0
                    with source.open_input_stream(inner, compression=None) as stream, where.open_output_stream(f"{base}/{name}", compression=None) as out, where.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                        for head, raw in records(inflated(stream)):
                            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = pack.compress(raw) + pack.flush()
                            out.write(member)
                            row = (f"{to}/{name}", at, len(member), bare(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"])
                            index.write("\t".join(map(str, row[1:])).encode() + b"\n")
                            at += len(member)
                            yield row

        yield from batches(rows(), schema, most=10_000)

    return stored(manifest.select("path").repartition(min(files, 100_000), "path").mapInArrow(rewrite, T.StructType(fields(INDEX))), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Read indexed records by offset, each from its own member; rows of RECORD (payload is null for revisits).

    A record is read whole, whatever its length; an index row that occurs twice is read twice; an empty index gives no rows.
    """

    schema = arrow_type(RECORD)

    def read(parts):
        def rows():
            path = stream = None
            for part in parts:
                cols = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("path", "offset", "length")]
                for p, offset, length in zip(*cols, strict=True):
                    if p != path:
                        if stream is not None:
                            stream.close()
                        source, inner = folder(p)
                        path, stream = p, source.open_input_file(inner)
                    stream.seek(offset)
                    raw = zlib.decompress(stream.read(length), 31)
                    yield parsed(headers(raw[: raw.index(b"\r\n\r\n")]), raw)
            if stream is not None:
                stream.close()

        yield from batches(rows(), schema)

    return index.select("path", "offset", "length").mapInArrow(read, T.StructType(fields(RECORD)))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), f"{to}/whole")
    rows = read_records(normalise(manifest, f"{to}/members"))
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', x[i:i])]), '') AS bits FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[n:n] FOR_N), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM b
"""
#: The five bits from place 5 i + 1 on, as a number from 1.
_N = "(1 + " + " + ".join(f"{2 ** (4 - j)} * CAST(bits[5 * i + {j + 1}:5 * i + {j + 1}] AS INT)" for j in range(5)) + ")"
ORACLE_SQL = ORACLE_SQL.replace("[n:n] FOR_N", f"[{_N}:{_N}]")
