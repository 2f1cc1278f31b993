from ledgerbrook.operators.changelog import orders_log
from ledgerbrook.operators.relational import Tables
from ledgerbrook.plans.catalogue import queries

SF = "/root/testdata/sf0.001"


def test_every_operation_comes_out_stamped_and_stripped(spark):
    out, log = queries()["e3_e4_stamp_and_strip"](spark, SF), orders_log(Tables(spark, SF))
    assert out.columns == [*(x for x in log.columns if x not in ("_op", "_op_index")), "__created_at"]
    assert out.count() == log.count()
