import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerbrook.operators import relational
from ledgerbrook.plans import patterns


@pytest.fixture
def folder(tmp_path):
    """Keys 1 and 2 have the same discounts in the same order, those of 2 in two files; sums of such parts are less by one bit. Key 3 has only nulls."""
    files = [[(1, 0.1), (1, 0.2), (1, 0.3), (2, 0.1), (3, None)], [(2, 0.2), (2, 0.3), (4, 0.3)]]
    (tmp_path / "lineitem.parquet").mkdir()
    for i, rows in enumerate(files):
        keys = pa.array([k for k, _ in rows], pa.int64())
        pq.write_table(pa.table({"l_partkey": keys, "l_suppkey": keys, "l_discount": pa.array([x for _, x in rows], pa.float64())}), tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    return str(tmp_path)


def test_best_and_worst_ties(spark, folder):
    """Before, part 2 came before part 1, and part 3 before both, unlike in SQL."""
    out = patterns.queries()["d15_best_and_worst"](spark, folder)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 4), (2, 2, 1), (3, 4, 2), (4, 3, 3)]


def test_paired_ranks_ties(spark, folder):
    """Before, supplier 2 came before supplier 1, and supplier 3 before both, unlike in SQL."""
    out = relational.queries()["w2_paired_ranks"](spark, folder)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3), (2, 2, 2), (3, 4, 4), (4, 3, 1)]
