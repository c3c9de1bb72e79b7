"""Rows of megabytes go to and from Python workers in small batches."""

import pyarrow as pa

from lotwatch.llm import alignment, rows
from lotwatch.llm.queries import BYTE_BPE, PIECE_BPE


def test_batches_are_bounded_and_the_setting_is_put_back(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    wide = spark.range(0, 40, 1, 1).selectExpr("cast(repeat('x', 1000000) as binary) AS v").mapInArrow(sizes, "n long")
    with rows.small_batches(spark):
        assert max(r["n"] for r in wide.collect()) <= 10
    assert spark.conf.get(rows.BATCH_BYTES, None) is None
    spark.conf.set(rows.BATCH_BYTES, "1000000")
    with rows.small_batches(spark):
        assert spark.conf.get(rows.BATCH_BYTES) == "1000000"
    spark.conf.unset(rows.BATCH_BYTES)


def test_alignment_moves_its_slices_in_small_batches(spark, monkeypatch):
    seen, write = {}, alignment.stored

    def watched(df, purpose, *args, **options):
        seen[purpose] = spark.conf.get(rows.BATCH_BYTES, None)
        return write(df, purpose, *args, **options)

    monkeypatch.setattr(alignment, "stored", watched)
    docs = spark.createDataFrame([(1, "one and two"), (2, None)], "doc_id long, text string")
    assert alignment.align(docs, BYTE_BPE, PIECE_BPE).count() == 2
    assert seen["slices"] == seen["aligned"] == str(2 * rows.SLICE_BYTES)
