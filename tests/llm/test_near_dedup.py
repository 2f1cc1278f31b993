import random

import numpy as np
from pyspark.sql import functions as F

from ledgerbrook.llm.common import WordHashes
from ledgerbrook.llm.graph import components
from ledgerbrook.llm.near_dedup import HASHES, least_matches, near_dedup, near_duplicates, shingles, signature


def brute_sets(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts, percent):
    sets = [brute_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both) and sets[j]:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))], sets


def corpus(seed):
    rng, texts = random.Random(seed), []
    words = [f"W{i}" for i in range(300)]
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 6, 60, 140]))
        for _ in range(rng.choice([1, 2, 14])):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append((" " if rng.random() < 0.9 else "\n").join(own).lower() if rng.random() < 0.3 else " ".join(own))
    return texts + [None, "", " \n", "one", "ONE", "one two", None]


def test_components_and_shingle_counts(spark, monkeypatch):
    for seed, block, percent in ((1, 1000, 85), (2, 4, 85), (3, 6, 80)):
        monkeypatch.setattr("ledgerbrook.llm.near_dedup.SALTED", 2 if seed == 2 else 256)  # a bucket's first meets its partners in several places
        texts = corpus(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as node", "2 as root").repartition(3)
        got = {r.rid: (r.n_shingles, r.component_id) for r in near_duplicates(docs, percent, block=block).collect()}
        want, sets = brute_components(texts, percent)
        assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}
    assert near_duplicates(docs.limit(0)).collect() == []


def test_one_document_of_a_group_stays(spark):
    texts = corpus(4)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (None, "null id alone here now", "x"), (None, "another null id text here", "x"), (3, "same id other text than before", "x"), (500, "repeated row of five words", "x"), (500, "repeated row of five words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = near_dedup(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    want, sets = brute_components(texts, 80)
    assert {i for i, t in got if i is not None and i < len(texts) and t == texts[i]} == {i for i in range(len(texts)) if want[i] == i or not sets[i]}
    assert sorted(t for i, t in got if i is None) == ["another null id text here", "null id alone here now"]
    assert got.count((500, "repeated row of five words")) == 1 and (3, "same id other text than before") in got


def test_very_long_texts(spark):
    """400,000 words, a near copy of them, and one that shares a third."""
    words = [f"w{i * 7919 % 100_003}x{i % 11}" for i in range(400_000)]
    near, third = words[:200_000] + ["other"] * 10 + words[200_010:], words[:200_000] + [f"own{i}" for i in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(third)), (4, "short")], "doc_id long, text string")
    got = {r.rid: (r.n_shingles > 300_000, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (True, 3), 4: (False, 4)}


def test_signatures_estimate_similarity_and_bounds_hold():
    hashes = WordHashes()
    words = [f"w{i}" for i in range(1000)]
    a, b = shingles(" ".join(words).encode(), hashes), shingles(" ".join(words[:900] + ["x"] * 100).encode(), hashes)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a) == signature(b)).mean() - true) < 0.12
    bounds = least_matches(0.85, 1e-7)
    assert [n for n, _ in bounds] == [32, 64, 96] == list(range(32, HASHES + 1, 32)) and all(0 < m < 0.8 * n for n, m in bounds)


def test_graph_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)] + [(200, 200)]
    root = {}
    for n in {x for e in edges for x in e}:
        root[n] = n
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(root[u], root[v])
            changed |= root[u] != m or root[v] != m
            root[u] = root[v] = m
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    firsts = {}
    for n, r in got.items():
        firsts.setdefault(r, set()).add(n)
    want = {}
    for n, r in root.items():
        want.setdefault(r, set()).add(n)
    assert sorted(map(sorted, firsts.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert components(spark.createDataFrame([], "u long, v long")).select(F.col("node")).collect() == []


def test_components_beyond_a_broadcast(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long"), most=0, salts=3).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
