import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerbrook.llm import substring_dedup
from ledgerbrook.llm.common import WordHashes
from ledgerbrook.llm.substring_dedup import compacted, cut_repeats, dedup_substrings, edges_of, spans_of


def brute(rows, width):
    seen = Counter(tuple(w[i : i + width]) for _, t in rows for w in [(t or "").split()] for i in range(len(w) - width + 1))
    out = []
    for d, t in rows:
        w = (t or "").split()
        hit = {i + o for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for o in range(width)}
        left = " ".join(x for i, x in enumerate(w) if i not in hit)
        out.append((d, len(w), len(hit), left, hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É"]
    shared = [rng.choices(words, k=rng.choice([5, 7, 12, 40])) for _ in range(8)]
    rows = []
    for i in range(70):
        text = []
        for _ in range(rng.randrange(5)):
            text += rng.choices(words, k=rng.randrange(12))
            part = rng.choice(shared)
            s = rng.randrange(len(part))
            text += part[s : s + rng.randrange(1, 40)]
        rows.append((i, (" " if i % 2 else "\n").join(text)))
    return rows + [(None, None), (None, rows[0][1]), (3, ""), (500, "a b " * 20), (501, "twice the same row " * 3), (501, "twice the same row " * 3), (7, "x " * 60), (8, "x " * 60 + "y"), (9, "short one")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as n_words", "3 as paths").repartition(5)
    got = cut_repeats(docs, width=6, anchor=2).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in got), key=str) == brute(rows, 6)
    assert {r.k for r in got} == {1}


def test_stage_keeps_columns_and_untouched_texts(spark):
    docs = spark.createDataFrame([(1, "a  b\nc", 9), (2, "p q r s t u v", 9), (3, "0 q r s t u v", 9), (None, None, 9)], "doc_id long, text string, n_removed int")
    out = dedup_substrings(docs, width=6, anchor=2)
    assert out.columns == docs.columns and sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "a  b\nc", 9), (2, "p", 9), (3, "0", 9), (None, None, 9)]))
    assert cut_repeats(docs.limit(0)).collect() == []


def test_long_texts_are_cut_side_by_side(monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH", 64)
    h = WordHashes()([f"w{i * i % 97}".encode() for i in range(1000)])
    m, left, right, a, n = edges_of(h, 35, 8)
    assert a[0] == 0 and a[-1] + n[-1] == 966 and (a[1:] == a[:-1] + n[:-1]).all() and len(m) == len(left) == len(a)
    assert (left[1:] == right[:-1]).all() and n.max() <= 28
    assert [len(x) for x in edges_of(h[:34], 35, 8)] == [0] * 5 and len(edges_of(h[:35], 35, 8)[0]) == 1
    assert np.isin([64, 128], a).all()


def test_paths_end_where_the_graph_branches(spark):
    graph = [(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 13, 14), (5, 13, 15), (6, 20, 21), (7, 22, 21), (8, 21, 23), (9, 30, 31), (10, 31, 30), (11, 40, 40)]
    got = {r.edge: (r.p, r.size) for r in compacted(spark.createDataFrame(graph, "e long, l long, r long")).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 9: (9, 2), 10: (9, 2)}
    assert compacted(spark.createDataFrame([], "e long, l long, r long")).collect() == []


def test_a_text_that_runs_through_a_path_is_one_span():
    words = [f"w{i}".encode() for i in range(40)]
    a, b = np.array([0, 5, 9, 20, 24]), np.array([4, 8, 12, 23, 25])
    p, size, nth = np.array([7, 7, 7, 7, 7]), np.full(5, 3), np.array([3, 1, 3, 2, 3])
    names, alone, rows = spans_of(words, a, b, p, size, nth, 6)
    assert alone.tolist() == [False, True, False, True, True]
    xor = names[0] ^ names[1] ^ names[2]
    assert sorted(rows) == sorted([(7, 3, *xor.tolist(), 0, 12), (7, 1, *names[1].tolist(), 0, 12), (7, 2, *names[3].tolist(), 20, 25)])


def test_long_passages_in_whole_and_in_part(spark):
    rng = random.Random(5)
    word = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage, other = word(300), word(200)
    texts = [word(9) + passage + word(9) for _ in range(7)] + [passage[50:] + word(5), word(3) + passage[:220], passage + other, other + passage + other, word(80), passage + passage]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(3, " ".join(texts[3])), (3, " ".join(texts[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 15):
        got = cut_repeats(docs.repartition(parts)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in got), key=str) == brute(rows, 35)
