"""A table that is being loaded in large batches is not rewritten for each few of them."""

from pyspark.sql import types as T

from lotwatch.session import fresh_folder
from lotwatch.sources.tables import DELTAS, MergedTable


def test_a_load_makes_no_base_and_small_batches_do(spark):
    table = MergedTable(spark, fresh_folder(spark, "table"), "k", T.StructType().add("k", "long").add("v", "long"))
    for v in range(6):
        table.merge(spark.range(60 * v - 10 if v else 0, 60 * v + 60).selectExpr("id AS k", f"{v}L AS v"), v)
    _, base, deltas = table._state()
    assert not base and len(deltas) == 6
    expected = [(k, min(5, (k + 10) // 60)) for k in range(360)]
    assert sorted(map(tuple, table.read().collect())) == expected
    table.merge(spark.range(1).selectExpr("id AS k", "9L AS v"), 9)
    _, base, deltas = table._state()
    assert [e["n_rows"] for e in base] == [360] and not deltas
    assert sorted(map(tuple, table.read().collect())) == [(0, 9), *expected[1:]]


def test_a_load_of_very_many_batches_is_merged(spark):
    table = MergedTable(spark, fresh_folder(spark, "table"), "k", T.StructType().add("k", "long"))
    for v in range(DELTAS + 2):
        table.merge(spark.range(3 * v, 3 * v + 3).selectExpr("id AS k"), v)
    assert len(table._state()[2]) <= 2 and table.count() == 3 * (DELTAS + 2)
