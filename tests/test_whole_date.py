"""A run's limit falls between dates, and no task orders all of them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotwatch.sources import raw

rnd = random.Random(3)
DAY = datetime(2024, 3, 30, 22)
DATES = [DAY + timedelta(days=rnd.choice((0, 0, 1, 40)), seconds=rnd.choice((0, 1, 7200)), microseconds=rnd.choice((0, 1, 999_999))) for _ in range(150)]
DATES += [datetime(1969, 12, 31, 23, 59, 59, 999_999), datetime(1960, 1, 1), datetime(1, 1, 2), None, None]


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 17, 90, 151, 153, 154, 1000])
def test_oldest_up_to_a_whole_date(spark, limit):
    df = spark.createDataFrame([(i, d and d.isoformat()) for i, d in enumerate(DATES)], "i long, d string").withColumn("date_modified", F.col("d").cast("timestamp"))
    dated = sorted(d for d in DATES if d)
    last = dated[min(limit, len(dated)) - 1]
    assert {r["i"] for r in raw.up_to_whole_date(df, limit).collect()} == {i for i, d in enumerate(DATES) if d is None or d <= last}


def test_undated_rows_alone(spark):
    df = spark.createDataFrame([(None,), (None,)], "date_modified timestamp")
    assert raw.up_to_whole_date(df, 1).count() == 2 and raw.up_to_whole_date(df.limit(0), 1).count() == 0


def test_no_task_takes_all_dates(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.range(1000).select(F.timestamp_seconds("id").alias("date_modified"))
    plans = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1])
    monkeypatch.setattr(DataFrame, "first", lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self)[0])[1])
    assert raw.up_to_whole_date(df, 500).count() == 500
    assert plans and not any("TakeOrdered" in p or "Sort" in p or "SinglePartition" in p for p in plans)
