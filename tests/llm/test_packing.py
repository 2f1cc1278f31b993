import random

import numpy as np
from tokenizers import Tokenizer

from ledgerbrook.llm.packing import BoundedBestFit, pack
from ledgerbrook.llm.token_matrix import best_fit_decreasing, token_matrix
from ledgerbrook.llm.tokens import Encoder, default_tokenizer

ODD = ["", " ", "á é", "x ́y", "ΑΣ ΣΑΣ. ΣΑ Σ", "<|endoftext|> a<|startoftext|>b", "it's we'll 'S", "\x1c\x1d a\x85b c", "日本語 テキスト", "a\x0bb\x0cc\td\r\ne", "1234 5,6", "İstanbul ǅ", "\x00\x01 \x7f", "🙂👍🏽 🙂", "ﬁ ½ Ⅳ", "a" * 5000]


def test_ids_equal_the_tokenizers(spark):
    path, rng = default_tokenizer(), random.Random(2)
    texts = ODD + ["".join(rng.choice("ab é́\n\t 'sΣσ1.,-<|> ​") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    plain, ours = Tokenizer.from_file(path), Encoder(path, most=50)
    wide = "abcdefghijklmnopqrstuvwxyzéèêàâçñóíúüöäßøåæðþœšžłőǆAEIOÉÜ"
    texts += [" ".join("".join(rng.choices(wide if i % 2 else wide[:26], k=rng.randrange(1, 16))) for _ in range(100)) for i in range(400)]
    for text, e, ids in zip(texts, plain.encode_batch(texts, add_special_tokens=False), ours([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, repr(text)
    assert ours.words is not None and list(ours([])) == [] and list(ours([None, b""])) == [b"", b""]


def test_bounded_best_fit_against_plain_search():
    rng = random.Random(4)
    for most in (1, 3, 1000):
        fit, bins, open_ = BoundedBestFit(50, most), {}, []
        for _ in range(400):
            size = rng.randint(1, 50)
            b, offset = fit.place(size)
            fitting = [x for x in open_ if 50 - bins[x] >= size]
            if fitting:
                assert b in fitting and bins[b] == max(bins[x] for x in fitting)
            elif size < 50 and len(open_) >= most:
                full = max(bins[x] for x in open_)
                open_.remove(next(x for x in open_[::-1] if bins[x] == full) if len([x for x in open_ if bins[x] == full]) == 1 else [x for x in open_ if bins[x] == full and x not in dict(fit.left())][0])
            assert offset == bins.get(b, 0)
            bins[b] = offset + size
            if b in open_ and bins[b] == 50:
                open_.remove(b)
            elif b not in open_ and bins[b] < 50:
                open_.append(b)
            assert sorted(fit.left()) == sorted((x, bins[x]) for x in open_)


def docs_of(spark):
    rows = [(i, "word " * (i * 7 % 400) + "tail") for i in range(200)] + [(None, None), (None, ""), (5, "again"), (5, "again"), (900, "long text " * 5000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as bin", "'k' as kept")


def test_pack_round_trip(spark):
    rows, docs = docs_of(spark)
    plain = Tokenizer.from_file(default_tokenizer())
    for moves in (10**6, 0):
        got = pack(docs.repartition(4), capacity=256, broadcast_moves=moves).collect()
        want = sorted(str((d, plain.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in rows)
        whole = {}
        for r in got:
            assert r.kept == "k" and r.length == len(r.ids) // 4 <= 256 and r.start == 256 * r.piece
        for d in {r.doc_id for r in got}:
            pieces = sorted((r for r in got if r.doc_id == d), key=lambda r: (r.start, bytes(r.ids)))
            if len({r.start for r in pieces}) == len(pieces):
                whole[d] = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert {str(x) for x in whole.items()} <= set(want) and len(whole) >= 199
        for s in {r.sequence_id for r in got}:
            own, at = sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset), 0
            for r in own:
                assert r.offset == at
                at += r.length
            assert at <= 256
        tokens = sum(r.length for r in got)
        assert len({r.sequence_id for r in got}) <= 1.05 * tokens / 256 + 2
    assert pack(docs.limit(0)).collect() == []


def test_best_fit_decreasing():
    rng = random.Random(8)
    for n in (0, 1, 500):
        sizes = [rng.randint(1, 64) for _ in range(n)]
        bins = best_fit_decreasing(sizes, 64)
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= 64 for b in bins)
        assert len(bins) <= 11 / 9 * sum(sizes) / 64 + 1
        free, want = [], 0  # against a linear search for the fullest bin that fits
        for s in sorted(sizes, reverse=True):
            fit = [f for f in free if f >= s]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - s)
            else:
                want += 1
                free.append(64 - s)
        assert len(bins) == want


def test_token_matrix_round_trip(spark):
    rows, docs = docs_of(spark)
    plain = Tokenizer.from_file(default_tokenizer())
    got = token_matrix(docs.repartition(3), capacity=256, block_tokens=5000).collect()
    segments = []
    for r in got:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for d, k, s, a, z in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert positions[a:z].tolist() == list(range(z - a)) and s == 256 * k
            segments.append(str((d, k, ids[a:z].tolist())))
    want = []
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want += [str((d, k, ids[s : s + 256])) for k, s in enumerate(range(0, len(ids), 256))]
    assert sorted(segments) == sorted(want)
    assert token_matrix(docs.limit(0)).collect() == []
