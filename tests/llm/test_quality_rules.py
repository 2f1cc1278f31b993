import random

from ledgerbrook.llm.quality_rules import measure, quality_rules


def brute(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", text) if w]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + o for i, r in enumerate(runs) if runs.count(r) > 1 for o in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_measure_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é ", "c#\n", "\t", "$ ", " ", "\n"]) for _ in range(rng.randrange(80)))
        assert measure(text.encode()) == brute(text)
    assert measure(None) == measure(b"") == (0, 0, 0, 0, 0)


def test_hosts_ties_nulls_and_clashing_columns(spark):
    good, bad = " ".join(f"w{i}" for i in range(20)), "x"
    rows = [(i, good, "fine", 5) for i in range(30)] + [(100 + i, bad, "spam", 5) for i in range(30)] + [(200, good, "spam", None), (201, None, None, 1), (201, None, None, 1), (None, good, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    for limit in (1 << 20, 0):
        out = quality_rules(docs, broadcast_bytes=limit)
        got = out.collect()
        assert len(got) == len(rows) and out.columns.count("n_words") == 1
        kept = {r.doc_id for r in got if r.kept}
        assert set(range(30)) <= kept and not kept & {*range(100, 130), 200, 201}
    assert quality_rules(docs.limit(0)).collect() == []


def test_hosts_that_stand_out_go_and_alike_ones_stay(spark):
    rng = random.Random(2)
    text = lambda ok: " ".join(f"w{rng.randrange(10**6)}" + ("" if ok else "#") for _ in range(20))
    rows = [(100 * h + i, text(i >= (40 if h == 7 else 5)), f"host{h}") for h in range(30) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules(docs).collect()
    assert {r.source for r in got if not r.kept} == {"host7"} and not any(r.base_failed for r in got)
    assert {r.host_rule for r in got if r.source == "host7"} == {"symbols"} and all(0.3 < r.host_rate < 0.4 for r in got if r.host_rate)
    assert all(r.kept for r in quality_rules(docs.where("source <> 'host7'")).collect())


def test_a_very_long_text(spark):
    rows = [(1, "word " * 300_000, "a"), (2, " ".join(f"w{i}" for i in range(200_000)), "a")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), drop_text=True).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].kept) == (300_000, 300_000, False) and (got[2].n_words, got[2].kept) == (200_000, True)
    assert "text" not in got[1].asDict()
