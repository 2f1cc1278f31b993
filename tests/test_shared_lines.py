from ledgerbrook.operators.relational import Tables
from ledgerbrook.operators.validate import same_rows
from ledgerbrook.plans import verification
from ledgerbrook.plans.tpch import PARTSUPP, SQL
from ledgerbrook.sources.scratch import scratch, stored


def test_lines_by_part_and_supplier_are_derived_once_for_all_queries(spark):
    """Before, each of five queries derived them anew, at every checkpoint twice."""
    t = Tables(spark, "/root/testdata/sf0.001")
    found = verification.results(spark, {n: getattr(t, n) for n in verification.KEYS})
    assert set(SQL) <= set(found)
    shared = [q for q in SQL if PARTSUPP in SQL[q]]
    assert len(shared) == 5
    rows = 0
    for q in shared:
        assert "min(l_extendedprice" not in found[q]._jdf.queryExecution().optimizedPlan().toString()
        n, same = same_rows(spark.sql(SQL[q]), found[q])
        assert same
        rows += n
    assert rows


def test_states_are_written_once(spark, monkeypatch):
    """Before, a state was stored and then read and written again as a snapshot."""
    labels = []
    monkeypatch.setattr(verification, "stored", lambda df, label: labels.append(label) or stored(df, label))
    monkeypatch.setattr(verification, "SQL", {})
    t = Tables(spark, "/root/testdata/sf0.001")
    logs = {n: stored(verification.database_log(t, n), "log") for n in ("orders", "customer")}
    path = scratch(spark, "snapshots")
    verification.write_checkpoints(t, logs, path, 2)
    assert labels == []
    assert all(r.ok and r.found for r in verification.verify_checkpoints(t, logs, path, 2).collect())
