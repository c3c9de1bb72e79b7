"""One typed parse for the usual document, and no exception for an amount that is no number."""

from pyspark.sql import functions as F

from lotwatch.functions.values import to_double
from lotwatch.sources import raw


def test_wrapped_documents_alone_are_parsed_as_wrapped(spark):
    bodies = ['{"id": "1", "data": {"id": "x"}}', '{"data": {"id": "2", "title": "t"}}', ' \n{"id": "3"}\t', '{"id": "4", "items": 5}', '{"data": 1}', "[]", None, '{"id": "5"']
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "source_file string, body string")
    parsed = raw.parse_documents(df)
    found = {r["source_file"]: (r["tender_id"], r["doc"] and r["doc"]["title"], r["reject_reason"]) for r in parsed.collect()}
    assert found["0"] == ("1", None, None) and found["1"] == ("2", "t", None) and found["2"] == ("3", None, None)
    assert [found[i][2] for i in "34567"] == ["malformed", "not an object", "not an object", "unreadable", "unreadable"]
    text = raw.good_documents(parsed).select("doc.title")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and text.count("from_json(") == 2


def test_only_numbers_are_cast(spark):
    df = spark.createDataFrame([("n/a",), ("",), (" 1.5 ",), ("1e999",), ("1.5d",), (None,)], "x string")
    rows = df.select(to_double(F.col("x")).alias("n"))
    assert [r["n"] for r in rows.collect()] == [None, None, 1.5, None, None, None]
