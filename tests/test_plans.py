"""Physical plans: what the operators promise about shuffles and scans."""

from pyspark.sql import functions as F

from lotwatch.operators import embedding, filters, versions
from lotwatch.plans import reports
from lotwatch.plans.star import order_tenders, table, tender_view

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "1000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_versions_are_cut_before_the_shuffle(spark):
    """A key with very many versions sends one row per task."""
    rows = table(spark, FOLDER, "lineitem")
    text = plan(versions.latest_version(rows, ["l_orderkey"], "l_shipdate", ["l_partkey"]))
    assert text.index("Partial", text.index("Exchange")) > text.index("Exchange")
    assert "row_number(), 1, Partial" in text and "row_number(), 1, Final" in text


def test_band_and_columns_reach_the_scan(spark):
    rows = table(spark, FOLDER, "orders").filter(filters.in_band("o_totalprice", 90000, 99999)).select("o_orderkey")
    text = plan(rows)
    assert "GreaterThanOrEqual(o_totalprice,90000.0)" in text and "LessThanOrEqual(o_totalprice,99999.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_year_is_a_range_on_the_scan(spark):
    rows = table(spark, FOLDER, "orders").withColumnRenamed("o_orderdate", "date_created")
    text = plan(reports.category_year_count(rows, F.col("o_orderpriority") == "5-LOW", 1997))
    assert "o_orderdate" in text and "EqualTo(o_orderpriority,5-LOW)" in text


def test_view_joins_only_what_the_columns_need(spark):
    assert "Join" not in plan(tender_view(spark, FOLDER, "tender_number", "awarded_amount"))
    text = plan(tender_view(spark, FOLDER, "supplier_name"))
    assert "supplier.parquet" in text and "orders.parquet" not in text and "l_tax" not in text


def test_ranking_sorts_only_its_top(spark):
    assert "TakeOrderedAndProject" in plan(reports.supplier_ranking(order_tenders(spark, FOLDER)))


def test_the_default_encoder_needs_no_python(spark):
    rows = embedding.hashed(table(spark, FOLDER, "documents"))
    text = plan(rows)
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert rows.columns == [*table(spark, FOLDER, "documents").columns, "embedding"]


def test_vectors_in_the_jvm_are_those_of_the_encoder(spark):
    texts = ["", None, "word", "Word WORD other", "a_b c-d 1e5", "дрон Дрон ÉTÉ", "x " * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for prefix in ("", "query: "):
        rows = embedding.hashed(df, prefix=prefix).withColumn("other", embedding.embed(F.col("text"), prefix=prefix)).collect()
        assert len(rows) == len(texts) and all(r.embedding == r.other for r in rows)
