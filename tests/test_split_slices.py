"""Long texts are cut slice by slice."""

import pyarrow as pa

from lotwatch.operators import chunks


def test_slices_are_bounded(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * n for n in (5, 5, 5, 30, 1, 9, 0, 10, 1)])], names=["id", "text"])
    parts = list(chunks._slices(batch, 1, 10))
    assert [p.num_rows for p in parts] == [2, 1, 1, 3, 1, 1] and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()


def test_pieces_of_many_long_texts(spark):
    texts = ["line é\n" * n for n in (1, 700, 2000)] + ["\n" * 9000, "😀" * 9000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = chunks.split_texts(df, limit=4096)
    assert rows.dtypes == [("id", "bigint"), ("position", "int"), ("piece", "string")]
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in sorted(rows.collect()):
        found.setdefault(r["id"], []).append(r["piece"])
    assert found == {i: chunks._cut(t, 4096) if t else [t] for i, t in enumerate(texts)}
