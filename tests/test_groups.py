"""Statistics are attached evenly, whatever holds a third of the rows."""

import statistics

import pytest
from pyspark.sql import functions as F

from lotwatch.operators import groups

N = 90_000


@pytest.fixture()
def shuffled(spark):
    """Joins by shuffle into 16 parts that nothing puts together or splits again."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _tenders(spark):
    """A third without category, a third in one, the rest in 5,000; every seventh amount is null."""
    kind = F.col("id") % 3
    category = F.when(kind == 1, "hot").when(kind == 2, F.concat(F.lit("c"), (F.col("id") % 5_000).cast("string")))
    return spark.range(N).select("id", category.alias("cpv_main"), F.when(F.col("id") % 7 != 0, (F.col("id") % 1_000).cast("double")).alias("awarded_amount"))


@pytest.mark.parametrize(("operator", "result"), [(groups.price_deviation, "price_deviation_pct"), (groups.leave_one_out, "category_avg")])
def test_no_task_gets_the_rows_of_a_hot_or_null_category(shuffled, operator, result):
    rows = operator(_tenders(shuffled)).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count(result))
    sizes = [r["n"] for r in rows.collect()]
    assert sum(sizes) == N and len(sizes) == 16
    assert max(sizes) < 2 * statistics.median(sizes)


def test_hot_and_null_categories_have_the_figures_of_a_plain_join(shuffled):
    t = _tenders(shuffled)
    found = {r["id"]: r for r in groups.leave_one_out(groups.price_deviation(t)).collect()}
    by = {}
    for r in t.collect():
        by.setdefault(r["cpv_main"], []).append(r)
    for category, rows in by.items():
        amounts = [r["awarded_amount"] for r in rows if r["awarded_amount"] is not None]
        middle, total = (statistics.median(amounts), sum(amounts)) if amounts else (None, 0)
        for r in rows:
            own, got = r["awarded_amount"], found.pop(r["id"])
            known = category is not None and own is not None
            gap = (own - middle) / middle * 100 if known and len(amounts) >= 2 and middle else None
            assert got["price_deviation_pct"] == (None if gap is None else pytest.approx(gap))
            others = len(amounts) - (own is not None)
            mean = (total - (own or 0)) / others if category is not None and others else None
            assert got["category_avg"] == (None if mean is None else pytest.approx(mean))
    assert not found


def test_no_rows_and_no_statistics(spark):
    t = _tenders(spark)
    assert groups.leave_one_out(t.limit(0)).count() == 0 and groups.price_deviation(t.limit(0)).count() == 0
    none = groups.price_deviation(t.withColumn("awarded_amount", F.lit(None).cast("double")))
    assert none.filter("price_deviation_pct is null").count() == N
