import hashlib
import re

import numpy as np

from ledgerbrook.llm.fill_in_middle import cuts, fill_in_middle, restored

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXTS = ["", "a", "ab cd", "é", "日本語 text", "a\nb\r\n", "<P>x", "no <M> more", "x<S", "<<P", ">", "zZ@[`{aZ", "😀😀ab😀", "\x00\x7fq\x80", "éa" * 9, "word " * 3000, "x" * 70_001, "ü" * 9999, "áb", " " * 17, "12345678abcdefgh"]


def plain_cut(i, text, seed=1):
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    return len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_against_a_pattern(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(9 * len(TEXTS))]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("*", "'x' as form", "1 as output")
    for at_once in (16 << 20, 50):  # many texts side by side, and few
        got = fill_in_middle(docs, at_once=at_once).collect()
        assert len(got) == len(rows) + 3
        assert {r.form for r in got} == {"plain", "psm", "spm"}
        for r in got:
            assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(r.doc_id, r.text), r.doc_id
            assert restored(r.output.encode(), r.form).decode() == r.text


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "some text"), (None, "some text"), (2, "")], "doc_id long, text string")
    got = sorted(((r.n_units, r.form, r.output) for r in fill_in_middle(docs).collect()), key=str)
    none = (0, "plain", None)
    own = plain_cut("", "some text")
    assert got == sorted([none, (0, "plain", ""), (own[0], own[1], own[4]), (own[0], own[1], own[4])], key=str)
    assert fill_in_middle(docs.limit(0)).collect() == []
    assert restored(None, "plain") is None


def test_every_cut_of_texts_side_by_side():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("aZ .é日😀1"), rng.integers(0, 40))) for _ in range(300)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    draws = rng.integers(0, 2**32, (300, 2), dtype=np.uint32)
    n, a, b = cuts(np.frombuffer(data, dtype=np.uint8), offsets, draws)
    for i, t in enumerate(texts):
        units = UNIT.findall(t)
        x, y = sorted(int(d) % (len(units) + 1) for d in draws[i])
        assert (n[i], a[i], b[i]) == (len(units), len("".join(units[:x]).encode()), len("".join(units[:y]).encode()))
