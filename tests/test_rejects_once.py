"""Damaged documents cost no more than they must."""

import json
import re

from pyspark.sql import functions as F

from lotwatch.session import fresh_folder
from lotwatch.sources import raw
from lotwatch.streaming import sync

GOOD = '{"id": "1", "dateModified": "2024-01-01T00:00:00+00:00"}'
BODIES = [
    GOOD, f" {GOOD}\n", f'{{"data": {GOOD}}}', GOOD[:20], GOOD[:-1], f"{GOOD} x", f"[{GOOD}]", '{"id": "x", "value": "much"}', '{"title": "no id"}', "", None, "{", "}",
    '{"data": {"id": "2"}', '{"id": 1.0, "items": {}}', "null", "{}x{}",
]


def _frame(spark, bodies=BODIES):
    return spark.createDataFrame([(f"{i}.json", b) for i, b in enumerate(bodies)], "source_file string, body string")


def test_texts_out_of_braces_get_no_typed_parse(spark):
    plans = [raw.parse_documents(_frame(spark)).select("doc", "reject_reason"), raw.with_frame(_frame(spark))]
    for plan, n in zip((p._jdf.queryExecution().optimizedPlan().toString() for p in plans), (2, 1), strict=True):
        assert len(re.findall(r"THEN from_json\(", plan)) == plan.count("from_json(") >= n


def test_judged_as_by_a_parse_without_types(spark):
    found = {r["source_file"]: (r["tender_id"], r["reject_reason"]) for r in raw.parse_documents(_frame(spark)).collect()}
    for i, body in enumerate(BODIES):
        try:
            whole = json.loads(body)
        except (TypeError, ValueError):
            continue
        if isinstance(whole, dict):
            inner = whole["data"] if "id" not in whole and "data" in whole else whole
            assert (found[f"{i}.json"][1] is None) == ("id" in inner and inner.get("value") != "much")
    assert found["3.json"] == found["4.json"] == (None, "unreadable") and found["2.json"] == ("1", None)


def test_what_is_in_the_quarantine_is_not_parsed_again(spark, monkeypatch):
    store = sync.TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(_frame(spark, [GOOD]), 0, embed=False)
    given, parse = [], sync.parse_documents
    names = lambda rows: {r["source_file"] for r in rows.select("source_file").collect()}
    monkeypatch.setattr(sync, "parse_documents", lambda rows: (given.append(names(rows)), parse(rows))[1])
    feed = _frame(spark)
    for number in (1, 2):
        sync.run_update(store, feed, number, None, False, False)
    bad, n = names(store.rejected()), store.rejected().count()
    assert len(bad) == n > 5 and bad <= given[0] and not bad & given[1]
    # Another text of the same name is judged anew.
    changed = feed.filter("source_file = '8.json'").withColumn("body", F.lit('{"title": "none"}'))
    sync.run_update(store, changed, 3, None, False, False)
    assert store.rejected().count() == n + 1
