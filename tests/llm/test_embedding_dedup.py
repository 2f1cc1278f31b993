import numpy as np
import pytest

from ledgerbrook.llm.embedding_dedup import embedding_links, pivots, units

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    """(n_links, smallest id reached) of each row, in order, by comparing all pairs in double precision."""
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ok):
        for j in ok[a + 1 :]:
            x, y = (np.array(rows[k][1], dtype=np.float32).astype(np.float64) for k in (i, j))
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[top(j)] = top(i)
    ids = {}
    for i, (v, *_) in enumerate(rows):
        ids.setdefault(top(i), []).append(v)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[i][0], n[i], low[top(i)]) for i in range(len(rows))), key=str)


def found(spark, rows, kind=KIND, **options):
    df = spark.createDataFrame(rows, kind).selectExpr("*", "1 as node", "'x' as dim", "2 as vec", "3 as n_links", "4 as component_id")
    return sorted((tuple(r) for r in embedding_links(df.repartition(3), **options).collect()), key=str)


def near(rng, base, n, noise):
    return base + rng.standard_normal((n, len(base))) * noise


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    groups = [near(rng, rng.standard_normal(24), n, 0.08) for n in (90, 7, 2, 2, 2)] + [rng.standard_normal((120, 24))]
    vecs = np.concatenate(groups).astype(np.float32).tolist()
    rows = [(i, v, i % 2 if i > 60 else 0) for i, v in enumerate(vecs)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(5)] + [rows[3], (2000, rows[3][1], 7), (2001, rows[3][1], None), (2002, rows[3][1], None)]
    want = brute(rows)
    assert max(n for _, n, _ in want) > 60
    for block in (2048, 16):  # the large group in one block, and in several
        got = found(spark, rows, block=block)
        links = sum(n for _, n, _ in want)
        assert abs(links - sum(n for _, n, _ in got)) <= 0.01 * links
        assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in want]


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [1.0, nan], 1), (5, [inf, 1.0], 1), (6, [1.0, 1.0], 1), (7, [2.0, 2.0], 1), (8, [1.0, 1.0, 0.0], 1),
            (9, [-1.0, -1.0], 1), (10, [3e38, 3e38], 1), (11, [1e-38, 1e-38], 1), (12, [0.0, 5.0], 1), (13, [-0.0, 5.0], 1), (None, [1.0, 1.0], 1), (None, [7.0], 2), (14, [1.0, 1.0], 1), (14, [1.0, 1.0], 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:6]) == brute(rows[:6])
    assert found(spark, rows[:0]) == []
    wide = [(i, (np.arange(5000) + i).astype(float).tolist(), 1) for i in range(3)]
    assert found(spark, wide, "vec_id long, embedding array<double>, label int") == brute(wide)


@pytest.mark.parametrize("dim", [2, 3, 8, 32])
def test_recall(spark, dim):
    """Links at all angles about the threshold, in few and in many dimensions: at least 0.99 of them are found, none below."""
    rng = np.random.default_rng(dim)
    base = units(rng.standard_normal((60, dim)))
    vecs = np.concatenate([base, *(units(base + rng.standard_normal((60, dim)) * s / np.sqrt(dim)) for s in (0.1, 0.15, 0.2, 0.25))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vecs.astype(np.float32))]
    got, want = (sum(n for _, n, _ in x) for x in (found(spark, rows), brute(rows)))
    assert 0.99 * want <= got <= want and want > 100


def test_pivots_stand_apart():
    rng = np.random.default_rng(1)
    p = pivots(units(near(rng, np.ones(16), 500, 0.01)), 16, most=64)
    cos = p @ p.T - 2 * np.eye(len(p))
    assert len(p) == 64 and cos.max() < 0.7
