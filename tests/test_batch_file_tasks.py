import re

from ledgerbrook.operators import replay
from ledgerbrook.operators.relational import Tables


def test_batch_files_come_from_few_tasks(spark, monkeypatch):
    """Before, each batch of 1,000 rows was a task, whose result went to the driver."""
    seen = []
    was = replay.split_files
    monkeypatch.setattr(replay, "split_files", lambda session, path, schema: seen.append(path) or was(session, path, schema))
    rows = replay._batch_files(Tables(spark, "/root/testdata/sf0.01")).count()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(seen[0]).select("path").collect()
    assert len(files) == rows > 20 and len({re.search(r"part-(\d+)", r.path)[1] for r in files}) <= 4
