import zlib

import numpy as np

from ledgerbrook.llm.sharding import pack_heavy, pack_vectors, place_light, shard_documents


def plain_placement(sizes, shards, order=None):
    """Vector bin packing straight from its rule, with lists."""
    residual, out = [[1.0] * 3 for _ in range(shards)], [None] * len(sizes)
    for i in order or sorted(range(len(sizes)), key=lambda i: (-max(sizes[i]), -sum(sizes[i]), i)):
        scores = [round(sum((r if w == 1 else max(r, 0)) * x * w for r, x, w in zip(row, sizes[i], (1, 0.5, 0.5), strict=True)), 12) for row in residual]
        out[i] = s = scores.index(max(scores))
        residual[s] = [r - x for r, x in zip(residual[s], sizes[i], strict=True)]
    return out


def test_placement_against_brute_force(spark):
    rng = np.random.default_rng(3)
    for n, shards in ((0, 4), (1, 4), (200, 5), (3000, 8)):
        sizes = rng.integers(1, 100, (n, 3)).astype(float)
        sizes *= shards / np.maximum(sizes.sum(axis=0), 1)
        place, packer = pack_vectors(sizes, shards)
        assert place.tolist() == plain_placement(sizes.tolist(), shards)
        assert np.allclose(packer.residual, 1 - np.array([sizes[place == s].sum(axis=0) for s in range(shards)]))
    assert (abs(packer.residual) < 0.02).all()
    # the same rule in tasks, in the same order
    raw = [(i, -i, int(x), int(y), int(z)) for i, (x, y, z) in enumerate(rng.integers(1, 1000, (500, 3)))]
    totals = np.array([r[2:] for r in raw], dtype=float).sum(axis=0)
    scaled = [[v * 4 / t for v, t in zip(r[2:], totals, strict=True)] for r in raw]
    order = sorted(range(500), key=lambda i: (-max(scaled[i]), raw[i][0]))
    want = dict(enumerate(plain_placement(scaled, 4, order)))
    got = place_light(spark.createDataFrame(raw, "a long, b long, size long, tokens long, n long").repartition(3), np.ones((4, 3)), totals.tolist(), 1)
    assert {r.a: r.shard for r in got.collect()} == want


def test_groups_are_split_only_where_they_must():
    even = lambda share: np.full((16, 3), share / 16)
    place, packer = pack_heavy([even(0.9), even(0.7), even(0.4)], 8)  # all fit
    assert all(len(set(p.tolist())) == 1 for p in place) and (packer.residual > 0).all()
    place, packer = pack_heavy([np.full((40, 3), 2.5 / 40)], 8)  # larger than a shard: three pieces
    assert len(set(place[0].tolist())) == 3 and (packer.residual >= 0).all()
    tiny = np.tile([0.001, 0.001, 0.15], (16, 1))  # many rows of few bytes: more than two shards' rows, but not their bytes
    place, packer = pack_heavy([tiny, *([even(0.4)] * 15)], 8)
    assert len(set(place[0].tolist())) == 1 and packer.residual[:, 0].min() > 0
    place, packer = pack_heavy([even(0.6)] * 12, 8)  # whole ones would not be near equal
    assert packer.residual.min() > -0.01 and sum(len(set(p.tolist())) == 1 for p in place) < 12


def test_shards_hold_all_rows_and_split_only_hot_groups(spark):
    rows = [(i, f"text {i} " * (1 + i % 17)) for i in range(3000)] + [(10_000 + i, "hot") for i in range(2000)] + [(20_000 + i, "pair of copies") for i in range(2)] + [(None, None), (None, None), (5, ""), (6, "long " * 3000), (7, "a b"), (7, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as shard", "3 as a", "4 as parts", "5 as n")
    got = shard_documents(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id in (20_000, 20_001)}) == 1
    assert len({r.shard for r in got if r.doc_id and 10_000 <= r.doc_id < 12_000}) == 1  # two of five rows, but few bytes
    assert max(sizes) < 1.01 * min(sizes)
    assert shard_documents(docs.limit(0)).collect() == []
    longer = docs.unionByName(spark.createDataFrame([(9001, "long " * 500_000)], "doc_id long, text string"), allowMissingColumns=True)
    got = {r.doc_id: r for r in shard_documents(longer).collect() if r.doc_id in (9001, 20_000)}
    assert got[9001].size == 2_500_001 and got[9001].text_crc32 == zlib.crc32(b"long " * 500_000) and got[9001].shard != got[20_000].shard
