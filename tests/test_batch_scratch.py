"""A batch leaves nothing but the tables, and a table without base rows is read without joins."""

import os

from pyspark.sql import types as T

from lotwatch.session import fresh_folder, shared_folder
from lotwatch.sources.tables import MergedTable
from lotwatch.streaming.sync import TenderStore


def test_scratch_goes_with_the_batch(spark):
    root = fresh_folder(spark, "store")
    before = set(os.listdir(shared_folder(spark)))
    raw = spark.createDataFrame([("a.json", '{"id": "1", "items": [{"id": "i"}]}'), ("b.json", "{")], "source_file string, body string")
    store = TenderStore(spark, root)
    for number in (0, 1):
        store.apply(raw, number, embed=False)
    assert set(os.listdir(shared_folder(spark))) - before <= {os.path.basename(root)}
    assert store.tenders().count() == 1 and store.items().count() == 1 and store.rejected().count() == 2


def test_deltas_alone_are_read_without_joins(spark):
    table = MergedTable(spark, fresh_folder(spark, "table"), "k", T.StructType().add("k", "long").add("v", "long"))
    for v in (1, 2):
        table.merge(spark.range(3).selectExpr("id AS k", f"{v}L AS v"), v)
    assert "Join" not in table.read()._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, table.read().collect())) == [(0, 2), (1, 2), (2, 2)]
    assert [tuple(r) for r in table.read_keys(spark.range(1).selectExpr("id AS k")).collect()] == [(0, 2)]
