from ledgerbrook.operators.changelog import orders_log
from ledgerbrook.operators.relational import Tables
from ledgerbrook.plans.catalogue import queries

SF = "/root/testdata/sf0.001"


def test_rows_of_the_whole_table_come_out(spark):
    t = Tables(spark, SF)
    log = orders_log(t).count()
    wanted = {"g1_sequence_whole": t.customer.count(), "e3_e4_stamp_and_strip_whole": log, "e14_sparse_documents_whole": log, "m15_parameter_sets_whole": t.part.count()}
    assert {k: queries()[k](spark, SF).count() for k in wanted} == wanted
