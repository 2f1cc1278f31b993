import gzip
import hashlib
import io
import zlib

import pytest
from pyarrow import fs as pafs

from ledgerbrook.llm.common import scratch
from ledgerbrook.llm.warc import base32_sha1, headers, inflated, normalise, read_records, record, records, write_archives


def test_stream_parsing_over_odd_chunks():
    raws = [record(f"urn:page:{i}", "response", "http://a/\r\nX: y", b"\r\n\r\nWARC/1.1" * i, base32_sha1(b"\r\n\r\nWARC/1.1" * i), None) for i in range(50)]
    for packed in (gzip.compress(b"".join(raws)), b"".join(map(gzip.compress, raws))):
        assert [raw for _, raw in records(inflated(io.BytesIO(packed)))] == raws
        with pytest.raises(ValueError):
            list(records(inflated(io.BytesIO(packed[:-20]))))
    assert list(records(inflated(io.BytesIO(b"")))) == []
    assert "x" not in headers(raws[0][: raws[0].index(b"\r\n\r\n")])


def test_round_trip(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, None, None), (5, "u5", ""), (7, "u7", "é\0\r\n\r\n" * 50_000), (9, "u9", "same"), (9, "u9", "same"), (None, "n", "same"), (11, "u", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as __n", "2 as payload", "3 as id").repartition(3)
    to = scratch(spark, "warc-test")
    index = normalise(write_archives(pages, to + "/a"), to + "/b")
    got = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in read_records(index).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min(j for j, _, g in rows if j is not None and (g or "") == (h or ""))
        kind = "response" if i == first else "revisit"
        want.append((f"urn:page:{i}", kind, None if i == first else f"urn:page:{first}", len(data), base32_sha1(data), bytes(data) if i == first else None))
    assert [g[:5] for g in got] == sorted(w[:5] for w in want)
    assert all(bytes(g[5]) == w[5] for g, w in zip(got, sorted(want, key=lambda w: w[0]), strict=True) if w[5] is not None)
    assert hashlib.sha1(b"").hexdigest().upper() != base32_sha1(b"")
    for path in {r.path for r in index.collect()}:  # every indexed member stands alone, and the sidecar says the same
        fs, inner = pafs.FileSystem.from_uri(path)
        data, lines = fs.open_input_stream(inner, compression=None).read(), fs.open_input_stream(inner + ".idx", compression=None).read().decode().splitlines()
        entries = sorted((r.offset, r.length) for r in index.collect() if r.path == path)
        assert [tuple(map(int, x.split("\t")[:2])) for x in lines] == entries
        assert sum(n for _, n in entries) == len(data) and all(zlib.decompress(data[o : o + n], 31).startswith(b"WARC/1.1") for o, n in entries)
    assert read_records(normalise(write_archives(pages.limit(0), to + "/c"), to + "/d")).collect() == []
