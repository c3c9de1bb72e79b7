"""One report row per group at every size, with the ids as a long table."""

from pyspark.sql import functions as F

from lotwatch.operators import evidence
from lotwatch.plans import reports


def test_a_group_of_more_than_half_a_million_rows_is_one_row(spark):
    n = 500_003
    big = spark.range(n).select(
        F.concat(F.lit("UA-"), F.col("id")).alias("tender_number"), F.lit("B").alias("buyer_name"), F.lit("S").alias("supplier_name"), F.lit(95000.0).alias("awarded_amount")
    )
    small = big.limit(3).withColumn("supplier_name", F.lit("T"))
    t = big.unionByName(small)
    ranked, ids = reports.splitting_groups(t)
    assert ranked.columns == ["buyer_name", "supplier_name", "n_contracts", "total_amount", "min_amount", "max_amount"]
    assert ids.columns == ["buyer_name", "supplier_name", "tender_number"] and ids.count() == n + 3
    for report, size in ((reports.contract_splitting(t), "n_contracts"), (reports.supplier_concentration(t, "B"), "n_wins")):
        rows = report.select("supplier_name", size, "total_amount", "evidence_page", F.size(F.split("tender_numbers", ", "))).collect()
        assert sorted(map(tuple, rows)) == [("S", n, n * 95000.0, 0, n), ("T", 3, 285000.0, 0, 3)]


def test_groups_without_ids_stay(spark):
    rows = spark.createDataFrame([("a", None), ("b", "2"), ("b", "1"), ("b", "1")], "k string, tender_number string")
    ranked = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = evidence.joined_evidence(ranked, evidence.evidence_rows(ranked, rows, ["k"]), ["k"])
    assert sorted(map(tuple, found.collect())) == [("a", 1, 0, ""), ("b", 3, 0, "1, 2")]
