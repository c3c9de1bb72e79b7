"""A landing of lines is compressed, in files of bounded length, and reads back whole."""

import os

from lotwatch.session import fresh_folder
from lotwatch.sources import raw


def test_landing_of_lines(spark, monkeypatch):
    monkeypatch.setattr(raw, "LINES_PER_FILE", 50)
    folder = fresh_folder(spark, "landing")
    df = spark.range(300).selectExpr("concat('{\"id\": \"', id, '\", \"title\": \"', repeat('word ', 50), '\"}') AS body").coalesce(1)
    raw.land_lines(df, folder)
    files = [f for f in os.listdir(folder) if f.startswith("part")]
    assert len(files) == 6 and all(f.endswith(".gz") for f in files)
    assert sum(os.path.getsize(f"{folder}/{f}") for f in files) < 300 * 250 / 5
    assert raw.read_raw_lines(spark, folder).select("body").exceptAll(df).isEmpty() and raw.read_raw_lines(spark, folder).count() == 300
