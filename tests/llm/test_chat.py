from ledgerbrook.llm.chat import chat_format


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    seqs = {c: tuple(s[1:] for s in sorted(v)) for c, v in convs.items()}
    keep = {c for c, s in seqs.items() if not any(o[: len(s)] == s and (len(o) > len(s) or d < c) for d, o in seqs.items() if d != c)}
    return {c: "".join(f"<|{r[1] if r[0] else 'unknown'}|>\n{x[1]}<|end|>\n" for r, x in seqs[c]) for c in keep}


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"),
            (4, 0, "user", "a"), (4, 1, "assistant", "x"), (5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 2, "user", "c"), (6, 0, None, None), (6, 1, "user", ""),
            (7, 0, None, None), (8, 0, "", ""), (None, 0, "user", "z"), (9, 3, "user", "t"), (9, 3, "user", "t"), (9, None, "user", "n"), (10, 0, "user", "y" * 100_000)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as place", "2 as conv", "3 as n_turns")
    got = {r.conv_id: r.rendered for r in chat_format(docs).collect()}
    assert got == brute(rows)
    assert set(got) == {3, 4, 6, 8, 9, 10}
    assert chat_format(docs.limit(0)).collect() == []


def test_plan_is_native(spark):
    plan = chat_format(spark.createDataFrame([(1, 0, "u", "a")], "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
