import pytest

import __spark_entry__
from latticeq import registry
from tests.oracles import same_rows

SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query", "family", "superfamily", "fold"] and out.count() >= 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["S1_window_scan", "X3_pair_split", "A12_regression_metrics", "W6_aligned_segments", "E1_sensitivity_first_fp", "E6_paired_bootstrap", "N13_standardised", "G4_carried_groups", "S10_structures"])
def test_queries_equal_their_oracles(spark, name):
    same_rows(spark, name, SF)


def test_clusters(spark):
    from latticeq.operators.clustering import sequence_clusters

    base = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVVHSLAKWKRQTLGQHDFSAGEGLYTHMKALRPDEDRLSPLHSVYVDQWDWERVMGDGERQFSTLKSTVEAIWAGIKATEAAVSEEFGLAPFLPDQIHFVHSQELLSRYPDLDAKGRERAIAKDLGAVFLVGIGGKLSDGHRHDVRAPDYDDWS"
    rows = [(1, base), (2, base[:-10]), (3, base[5:]), (4, base[:40]), (5, base[::-1]), (6, None), (7, "MK")]
    found = {r.member: r.representative for r in sequence_clusters(spark.createDataFrame(rows, "id long, sequence string")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 7: 7}
