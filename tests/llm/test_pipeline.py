import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerbrook.llm.common import scratch
from ledgerbrook.llm.tokens import default_tokenizer


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(3000)]
    make = lambda n: rng.choices(words, k=n)
    item, passage, near = make(25), make(60), make(200)
    docs = {1: make(80), 2: make(90) + item + make(40), 3: near, 4: near[:100] + ["changed"] + near[101:], 5: make(50) + passage + make(30), 6: make(20) + passage + make(70), 7: ["few", "words"], 8: ["spam"] * 100, 9: make(5000)}
    rows = [(d, " ".join(t), "en", "src0", sum(map(len, t))) for d, t in docs.items()] + [(10, None, "en", "src1", 0), (11, "", None, None, None), (1, " ".join(docs[1]), "en", "src0", 7)]
    rows += [(100 + i, "bad", "en", "spamhost", 3) for i in range(40)] + [(200, " ".join(make(50)), "en", "spamhost", 1)] + [(300 + i, " ".join(make(60)), "en", "src0", 1) for i in range(40)]
    to = scratch(spark, "pipeline-test")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to, docs, passage


def test_stages_take_effect(spark, case):
    to, docs, passage = case
    rows = spark.read.parquet(f"{to}/documents.parquet")
    columns, seen = rows.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch(spark, "stage")
        stage(spark, rows, to).write.parquet(path)
        rows = spark.read.parquet(path)
        assert rows.columns == columns or i == 4
        seen.append({r.doc_id: r for r in rows.collect()})
    quality, dedup, cut, clean, packed = seen
    fine = {1, 2, 3, 4, 5, 6, 9} | set(range(300, 340))
    assert set(quality) == fine
    assert set(dedup) == fine - {4}
    assert cut[5].text.split() == docs[5][:50] + docs[5][110:] and cut[6].text.split() == docs[6][:20] + docs[6][80:]
    assert cut[5].n_chars == len(cut[5].text) and cut[9].text == " ".join(docs[9])
    assert set(clean) == fine - {4, 2} == set(packed)
    plain = Tokenizer.from_file(default_tokenizer())
    for d, r in clean.items():
        pieces = rows.where(f"doc_id = {d}").orderBy("piece").collect() if d in (1, 5, 9) else []
        if pieces:
            assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist() == plain.encode(r.text, add_special_tokens=False).ids + [0]
    assert sorted(map(str, corpus_pipeline.run(spark, to).select("doc_id", "piece", "start", "length").collect())) == sorted(map(str, rows.select("doc_id", "piece", "start", "length").collect()))


def test_odd_tables(spark, case):
    """Null ids, columns named like results of the operators, an empty table and an empty benchmark."""
    to, docs, _ = case
    rows = spark.read.parquet(f"{to}/documents.parquet")
    clashing = ["n_words", "kept", "host_rate", "node", "root", "k", "paths", "n_hit", "bin", "ids", "signature", "text_key"]
    odd = rows.unionByName(rows.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" and more"), F.repeat(F.lit(" x1 y2 z3"), 3)))).select("*", *(F.lit(i).alias(c) for i, c in enumerate(clashing)))
    there = scratch(spark, "pipeline-odd")
    odd.write.parquet(f"{there}/documents.parquet")
    spark.read.parquet(f"{to}/benchmark.parquet").limit(0).write.parquet(f"{there}/benchmark.parquet")
    seen = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, there)
        assert seen.columns == odd.columns
    got = {r.doc_id for r in corpus_pipeline.run(spark, there).collect()}
    assert {1, 2, 3, 5, 6} <= got and len(got & {None, 9}) == 1  # nothing is contaminated; of two near copies one stays
    none = scratch(spark, "pipeline-empty")
    rows.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{to}/benchmark.parquet").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, none).collect() == []


def test_what_stages_store_is_dropped(spark, case):
    import os

    from ledgerbrook.sources.scratch import run_dir, scratch as path_in, temporary

    with temporary(spark):
        inside = path_in(spark, "x")
        spark.range(3).write.parquet(inside)
        assert os.path.isdir(inside.removeprefix("file://"))
    assert not os.path.exists(os.path.dirname(inside.removeprefix("file://"))) and path_in(spark, "y").startswith(run_dir(spark))
