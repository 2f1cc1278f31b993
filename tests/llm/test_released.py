from ledgerbrook.llm import tokens
from ledgerbrook.llm.near_dedup import signed


def test_a_worker_gives_back_its_encoder(spark):
    """Before, what packing had remembered stayed in the worker process, beside all that later operators needed."""
    import pyarrow as pa

    def remember(batches):
        yield from batches
        tokens.encoder(tokens.default_tokenizer())

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(getattr(tokens, "KEPT", None) or getattr(tokens, "_made", {}))] * batch.num_rows, type=pa.int64())], names=["n"])

    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(64)], "doc_id long, text string").repartition(8).cache()
    count = lambda df: df.mapInArrow(kept, "n long").agg({"n": "max"}).first()[0]
    docs.mapInArrow(remember, docs.schema).count()
    assert count(docs) == 1
    signed(docs.repartition(64), "text").write.format("noop").mode("overwrite").save()
    assert count(docs) == 0
    docs.unpersist()
