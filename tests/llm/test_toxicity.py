import math
import random
import zlib
from collections import Counter

import numpy as np

from ledgerbrook.llm.toxicity import BEYOND, DISCOUNT, RATIO, calibrated, rated, spelled, toxicity, train


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(3)
    words, slurs = [f"w{i}" for i in range(500)], ["slurA", "slurB", "bad"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        text = rng.choices(words, k=rng.randrange(20, 120)) + (rng.choices(slurs, k=2) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(None, "slurA slurB"), (9001, None), (9002, ""), (9003, "slurA bad " * 30_000), (9004, "SLURA, slurB!"), (5, rows[5][1])]
    labels += [(9002, None), (None, 1), (5, 0), (9003, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as toxic_ll", "2 as score", "3 as __y")
    labs = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity(docs, labs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, int(r.doc_id % 6 == 0)) for r in got if r.held_out and r.doc_id < 1500]
    assert np.mean([p == y for p, y in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[9004].predicted == by_id[9003].predicted == by_id[None].predicted == 1 and by_id[9001].score == by_id[9002].score < 0.5
    assert len({r.score for r in got if r.doc_id == 5}) == 1

    # held-out labels teach nothing
    turned = spark.createDataFrame([(i, 1 - y if y in (0, 1) and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    assert {(r.doc_id, r.score) for r in toxicity(docs, turned).collect()} == {(r.doc_id, r.score) for r in got}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labs = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity(docs.limit(0), labs).collect() == []
    assert len({r.score for r in toxicity(docs, labs.limit(0)).collect()}) == 1


def test_calibration_follows_the_data():
    x = np.random.default_rng(1).normal(size=4000)
    y = (np.random.default_rng(2).random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    assert np.allclose(calibrated(x, y), [2, -1], atol=0.2)


def test_all_labels_and_all_texts_count(spark):
    """Rare expressions get class counts from all labelled rows, and unlabelled text enters the shared lowest order."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(i, f"a{i % 50} b{i % 70} " + ("vile" if i % 2 else "mild") * (i % 3 == 0)) for i in range(40_000)]
    rare = [i for i in range(1, 40_000, 2) if fold(i) in (1, 2, 3)][:15]
    rows = [(i, "scarce " + t if i in rare else t) for i, t in rows] + [(90_000, "scarce")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40_000)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    more = spark.createDataFrame([(100_000 + i, f"new{i} scarce") for i in range(300)], "doc_id long, text string")
    llr = lambda d: d.where("doc_id = 90000").selectExpr("toxic_ll - ordinary_ll").first()[0]
    first, second = llr(toxicity(docs, labels)), llr(toxicity(docs.unionByName(more), labels))
    assert first > 1 and second > 0 and abs(first - second) > 0.1


def plain_model(rows):
    """Interpolated Kneser-Ney over the telling beginnings of words, with dictionaries of strings.

    From u to the next telling v or to none: max(c(v) - D, 0) / n(u) + (1 - sum over v and none of max(c(v) - D, 0) / n(u)) N(v) / (N(u) + 1), where N
    counts the different words that begin so. Gives the chances of what may follow each u, by class, and the telling beginnings.
    """
    docs = {c: [set(t.split()) for t, y in rows if t is not None and y is c] for c in (True, False)}
    starts = lambda ws: {(w + " ")[:k] for w in ws for k in range(1, len(w) + 2)}
    count = {c: Counter(x for ws in docs[c] for x in starts(ws)) for c in docs}
    t, o = (max(sum(x is not None and y is c for x, y in rows), 1) for c in (True, False))
    own = set()
    for x in set(count[True]) | set(count[False]):
        a, b = count[True][x], count[False][x]
        share = t / (t + o)
        rate = ((a + 0.5) / t) / ((b + 0.5) / o)
        beyond = 2 * sum(k * math.log(k / ((a + b) * s)) for k, s in ((a, share), (b, 1 - share)) if k)
        if max(a, b) > DISCOUNT and beyond > BEYOND and (rate > RATIO or rate < 1 / RATIO):
            own.add(x)
    kinds = {w for t, _ in rows for w in (t or "").split()}
    types = Counter(x for w in kinds for x in starts([w]))
    types[""] = len(kinds)
    below = {u: [] for u in {"", *own}}
    for v in own:
        below[max((v[:k] for k in range(len(v)) if v[:k] in below), key=len)].append(v)
    chances = {}
    for u, its in below.items():
        for c in (True, False):
            n = max(sum(map(len, docs[c])), 1) if not u else max(count[c][u], sum(count[c][v] for v in its), 1)
            ex = {v: max(count[c][v] - DISCOUNT, 0) / n for v in its}
            ended = max(n - sum(count[c][v] for v in its) - DISCOUNT, 0) / n
            left = 1 - sum(ex.values()) - ended
            chances[u, c] = {v: ex[v] + left * types[v] / (types[u] + 1) for v in its}
            chances[u, c][None] = ended + left * (types[u] + 1 - sum(types[v] for v in its)) / (types[u] + 1)
    return chances, own


def plain_log_likelihoods(rows, words):
    chances, own = plain_model(rows)
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in chances.values())
    out = {}
    for w in words:
        way = [(w + " ")[:k] for k in range(1, len(w) + 2) if (w + " ")[:k] in own]
        out[w] = [sum(math.log(chances[u, c][v]) for u, v in zip(["", *way], [*way, None], strict=True)) for c in (True, False)]
    return out, len(own)


def test_chances_sum_to_one(spark):
    """From the start of words and from each telling beginning, over all that may follow and none, in either class."""
    rng = random.Random(9)
    rows = [(" ".join(rng.choices(["bad", "bads", "badly", "bide"], k=3)) if y else " ".join(rng.choices(["bide", "bin", "cat", "bad" if i % 40 == 0 else "cap"], k=3)), y) for i in range(900) for y in [i % 10 == 0]]
    trained = train(spark.createDataFrame(rows, "text string, toxic boolean"))
    chances, own = plain_model(rows)
    model = trained.block(0)
    assert len(model.keys) == len(own) > 3
    at = {x: int(np.searchsorted(model.keys, spelled([x.rstrip(" ").encode()])[3][len(x) - 1])) for x in own}
    for i, c in enumerate((True, False)):
        for u in {u for u, _ in chances}:
            p = {v: np.exp(model.step[i, at[v]]) for v in chances[u, c] if v} | {None: np.exp(model.end[i, at[u]] if u else model.none[i])}
            assert abs(sum(p.values()) - 1) < 1e-9
            assert all(abs(p[v] - chances[u, c][v]) < 1e-9 for v in p)


def test_models_against_a_plain_computation(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(["ba", "do", "ki", "lu", "s"], k=rng.randint(1, 4)))
    rows = []
    for i in range(600):
        y = [True, False, False, None][i % 4]
        ws = [word() for _ in range(12)] + ([f"vil{word()}" for _ in range(3)] if y and rng.random() < 0.7 else [])
        rows.append((" ".join(ws), y))
    rows += [(None, True), ("", False), (None, None)]
    words = sorted({w for t, _ in rows for w in (t or "").split()})[:150] + ["vil", "vilzz", "zzz", "unseen" * 50]
    want, owned = plain_log_likelihoods(rows, words)
    assert owned > 5
    table = spark.createDataFrame(rows, "text string, toxic boolean").repartition(3)
    asked = spark.createDataFrame([(w,) for w in words] + [(" ".join(words),)], "text string")
    for block in (10**6, 3):  # one block, and many
        models = train(table, block)
        assert (models.blocks > 1) == (block == 3)
        got = {r.text: (r.toxic_ll, r.ordinary_ll, r.n_words) for r in rated(asked, models).collect()}
        assert all(np.allclose(got[w][:2], want[w]) for w in words)
        assert np.allclose(got[" ".join(words)][:2], np.mean([want[w] for w in words], axis=0)) and got[" ".join(words)][2] == len(words)
