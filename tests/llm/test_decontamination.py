import random

import numpy as np

from ledgerbrook.llm.decontamination import Block, decontaminate, find_benchmark, search_texts, words_of


def brute(texts, items, width):
    out = []
    for text in texts:
        words, hit, found = words_of(text), set(), {}
        for name, t in items:
            own = words_of(t)
            span = min(width, len(own))
            best = 0
            for i in range(len(own)):
                for j in range(len(words)):
                    n = 0
                    while i + n < len(own) and j + n < len(words) and own[i + n] == words[j + n]:
                        n += 1
                    if n >= span > 0:
                        hit |= set(range(j, j + n))
                        best = max(best, n)
            if best:
                found[name] = max(best, found.get(name, 0))
        out.append((len(words), hit, found))
    return out


def test_search_against_brute_force():
    rng = random.Random(5)
    for round_ in range(60):
        letters = ["a", "b", "É", "x1", "zz"][: 2 + round_ % 4]
        text = lambda n: " ".join(rng.choice(letters) for _ in range(n)).encode()  # noqa: B023, E731
        items = [(str(i), text(rng.choice([0, 1, 2, 3, 5, 9, 14]))) for i in range(6)] + [("n", None)]
        texts = [text(rng.choice([0, 1, 4, 30])) for _ in range(12)] + [None, items[5][1]]
        width = rng.choice([3, 4, 10])
        got = search_texts(Block(items, width), texts, shard_words=rng.choice([1, 20, 1000]))
        for (n, bits, matches), (wn, hit, found) in zip(got, brute(texts, items, width), strict=True):
            own = set(np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).tolist())
            assert (n, own, {m[0]: m[3] for m in matches}) == (wn, hit, found)


def test_blocks_agree_and_rows_survive(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([4, 12, 40])))) for i in range(30)] + [(None, "only null id " * 4), (31, None), (32, ""), (5, "five again " * 6)]
    docs = [(i, " ".join(rng.choices(words, k=50)) + (" " + items[i % 30][1].upper() if i % 3 == 0 else ""), 1, 2) for i in range(60)] + [(None, None, 1, 2), (7, "", 1, 2), (7, "", 1, 2), (88, "ONLY null id, " * 4, 1, 2), (9, "q " * 200_000, 1, 2)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, n_words int, hit int")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as id")
    one = sorted(map(str, find_benchmark(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    many = sorted(map(str, find_benchmark(docs, bench, block_bytes=300).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    assert one == many and len(one) == 65
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert all(i % 3 for i in got if i is not None and i < 7) and 88 not in got and got.count(7) == 3 and None in got
    assert find_benchmark(docs.limit(0), bench).collect() == []
    assert not find_benchmark(docs, bench.limit(0)).where("contaminated").collect()
