import pytest
from pyspark.sql import functions as F

from latticeq.operators import loader

LABELS = "row long, id1 string, id2 string, r1 long, r2 long, gw_raw double, fgw_raw double, tm_term double, pair_type string"


def _protein(name, n, features=None):
    return name, [[float(k), 0.0, 0.0] for k in range(n)], [[1.0]] * (n if features is None else features)


def _tables(spark):
    rows = []
    for row, one, other, pairs in ((1, "A", "B", [(2, 0), (0, 1), (1, 1)]), (2, "A", "gone", [(0, 0)]), (3, "A", "odd", [(0, 0)]), (4, "A", "B", [(0, 0), (0, 2)]), (5, "A", "B", [(0, 0)]), (6, "A", "B", [(None, 0)]), (7, "long", "A", [(0, 0)]), (8, "B", "A", [(1, 2)]), (9, None, "A", [(0, 0)])):
        rows += [(row, one, other, a, b, 0.0, 0.1, 0.5, "aligned" if row != 5 else "new") for a, b in pairs]
    rows.append((10, "A", "B", 0, 0, 0.0, 0.0, 0.0, "random"))
    rows.append((10, "B", "A", 0, 0, 0.0, 0.0, 0.0, "random"))  # two pairs of proteins in one group
    proteins = spark.createDataFrame([_protein("A", 3), _protein("B", 2), _protein("odd", 4, 3), _protein("long", 12), (None, [], [])], "id string, points array<array<double>>, features array<array<double>>")
    return spark.createDataFrame(rows, LABELS), proteins.withColumn("note", F.lit("extra"))


def test_items_and_rejects(spark):
    labels, proteins = _tables(spark)
    found = loader.build_items(labels, proteins, patch=2, longest=10)
    assert {(r.row, r.reason) for r in found.rejects.collect()} == {
        (2, "no protein gone"), (3, "points and features differ in number"), (4, "residue outside the protein"), (5, "unknown pair type"),
        (6, "residue outside the protein"), (7, "sequence too long"), (9, "no protein null"), (10, "several proteins in one group"),
    }
    items = {r.row: r for r in found.built.collect()}
    assert items.keys() == {1, 8} and items[1].r1 == [0, 1, 2] and items[1].r2 == [1, 1, 0] and items[1].structure == [1.0] * 3
    assert items[1].patch1 == [[0, 1], [1, 0], [2, 1]] and items[8].patch2 == [[2, 1]] and items[8].code == [0]


def test_strict_mode_raises_the_reason(spark):
    labels, proteins = _tables(spark)
    with pytest.raises(Exception, match="group 2: no protein gone"):
        loader.build_items(labels.where("row in (1, 2)"), proteins, strict=True).built.collect()
    assert loader.build_items(labels.where("row in (1, 8)"), proteins, strict=True).built.count() == 2


def test_batches_are_padded_to_their_own_longest(spark):
    labels, proteins = _tables(spark)
    built = loader.build_items(labels, proteins, patch=2).built
    batches = {r.row: r for r in loader.collated(built, 2).collect()}
    assert batches.keys() == {1, 7, 8} and [batches[k].batch for k in (1, 7, 8)] == [0, 0, 1] and [batches[k].width for k in (1, 7, 8)] == [3, 3, 1]
    assert batches[7].mask == [True, False, False] and batches[7].code == [0, -1, -1] and batches[7].r2 == [0, 0, 0] and batches[8].mask == [True]
    assert loader.collated(built.limit(0), 2).count() == 0
