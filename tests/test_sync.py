"""Incremental runs, streaming, replay and the bucketed table."""

import json

import pytest
from pyspark.sql import functions as F

from lotwatch.operators.flatten import flatten_items, flatten_tenders
from lotwatch.operators.groups import price_deviation
from lotwatch.schema import TENDERS
from lotwatch.session import fresh_folder
from lotwatch.sources import raw
from lotwatch.sources.tables import DELTAS, MergedTable
from lotwatch.streaming.sync import TenderStore, run_update, sync_stream


def document(key, modified, cpv, amount, n_items=1, title="дрон"):
    line = lambda n: {"id": f"{key}-{n}", "description": "опис", "quantity": "2", "classification": {"id": cpv},
                      "unit": {"value": {"amount": amount / 2, "currency": "UAH"}}}
    return json.dumps({
        "id": key, "tenderID": f"UA-2024-01-01-00000{key[-1]}-a", "title": title, "dateModified": modified,
        "contracts": [{"status": "active", "value": {"amount": amount, "currency": "UAH"}}], "items": [line(n) for n in range(n_items)],
    })


FIRST = [
    ("t1.json", document("t1", "2024-01-01T00:00:00+00:00", "33", 100.0)),
    ("t2.json", document("t2", "2024-01-01T00:00:00+00:00", "33", 200.0)),
    ("t3.json", json.dumps({"data": json.loads(document("t3", "2024-01-02T00:00:00+00:00", "18", 50.0, 2))})),
    ("bad.json", "{oops"),
]
# t2 moves to another category, t1 comes late with an older version, t4 is new, t5 is not relevant.
SECOND = [
    ("t2.json", document("t2", "2024-02-01T00:00:00+00:00", "18", 70.0)),
    ("t1.json", document("t1", "2023-01-01T00:00:00+00:00", "33", 999.0)),
    ("t4.json", document("t4", "2024-02-02T00:00:00+00:00", "33", 300.0)),
]
OFF_TOPIC = [("t5.json", document("t5", "2024-02-03T00:00:00+00:00", "99", 1.0, title="папір"))]
EXPECTED = {"t1": ("33", 100.0, -50.0), "t2": ("18", 70.0, pytest.approx(100 / 6)), "t3": ("18", 50.0, pytest.approx(-100 / 6)), "t4": ("33", 300.0, 50.0)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "source_file string, body string")


def state(store):
    return {r.tender_id: (r.cpv_main, r.awarded_amount, r.price_deviation_pct) for r in store.tenders().collect()}


def test_runs_replay_and_log(spark):
    store = TenderStore(spark, fresh_folder(spark, "store"))
    assert run_update(store, frame(spark, FIRST), 0)["status"] == "no_baseline"
    assert store.apply(frame(spark, FIRST), 1) == {"status": "ok", "since": None, "n_tenders": 3}
    assert state(store)["t3"][2] is None and state(store)["t1"][2] == pytest.approx(-100 / 3)
    vectors = {r.id: r.document for r in store.vectors.read().collect()}

    result = run_update(store, frame(spark, SECOND + OFF_TOPIC), 2)
    assert result == {"status": "ok", "since": "2024-01-02T00:00:00.000000+00:00", "n_tenders": 2}
    assert state(store) == EXPECTED and store.quality_report().isEmpty()
    assert {(r.tender_id, r.item_id) for r in store.items().collect()} == {("t1", "t1-0"), ("t2", "t2-0"), ("t3", "t3-0"), ("t3", "t3-1"), ("t4", "t4-0")}

    again = {r.id: r.document for r in store.vectors.read().collect()}
    assert again.keys() == EXPECTED.keys() and store.vectors.count() == 4
    assert again["t1"] == vectors["t1"] and again["t2"] != vectors["t2"]

    assert store.apply(frame(spark, SECOND), 2)["status"] == "already_applied"
    assert run_update(store, frame(spark, SECOND + OFF_TOPIC), 3)["status"] == "up_to_date"
    assert [r.status for r in store.run_log().orderBy("batch_seq").collect()] == ["no_baseline", "ok", "ok", "up_to_date"]
    assert [r.reject_reason for r in store.rejected().collect()] == ["unreadable"]


def test_stream_in_small_batches_equals_one_build(spark, tmp_path):
    store, checkpoint = TenderStore(spark, fresh_folder(spark, "store")), fresh_folder(spark, "checkpoint")
    for wave, rows in (("a", FIRST), ("b", SECOND)):
        for name, body in rows:
            (tmp_path / f"{wave}-{name}").write_text(body, encoding="utf-8")
        sync_stream(store, str(tmp_path), checkpoint, files_per_batch=2)
    whole = TenderStore(spark, fresh_folder(spark, "store"))
    whole.apply(frame(spark, FIRST + SECOND), 0, embed=False)
    assert state(store) == state(whole) == EXPECTED
    direct = price_deviation(whole.tender_table.read()).select("tender_id", "price_deviation_pct")
    assert {r[0]: r[1] for r in direct.collect()} == {k: v[2] for k, v in EXPECTED.items()}
    assert raw.read_raw(spark, str(tmp_path)).count() == 7


def test_merged_table_keeps_one_row_per_key(spark):
    df = spark.range(100).select(F.col("id"), F.lit(1).alias("v"))
    table = MergedTable(spark, fresh_folder(spark, "table"), "id", df.schema)
    assert table.read().count() == table.count() == 0
    table.replace(df)
    table.replace_keys(spark.createDataFrame([(7,)], "id long"), spark.createDataFrame([(7, 2)], df.schema))
    assert table.count() == 100 and table.read().filter("v = 2").count() == 1
    assert table.read_keys(spark.createDataFrame([(7,), (8,), (777,)], "id long")).count() == 2
    table.replace_keys(df.select("id"), df.limit(0))
    assert table.read().count() == 0
    table.replace(table.read().unionByName(df))
    assert table.read().count() == 100 and table.has_batch(-1) and not table.has_batch(-1, "other")


def test_a_batch_writes_its_own_rows_and_deltas_are_merged(spark):
    df = spark.range(1000).select(F.col("id"), F.lit(0).alias("v"))
    table = MergedTable(spark, fresh_folder(spark, "table"), "id", df.schema)
    table.replace(df)
    for n in range(1, 20):
        table.merge(spark.createDataFrame([(n % 5, n)], df.schema), n)
    log = table._log().collect()
    assert sorted(e.n_rows for e in log if e.kind == "delta") == [1] * 19
    assert max(e.n_rows for e in log if e.kind == "merged") <= 17
    assert {r.id: r.v for r in table.read().filter("id < 5").collect()} == {n % 5: n for n in range(15, 20)}
    assert len(table._state()[2]) <= DELTAS + 1
    table.compact()
    assert table.count() == 1000 and not table._state()[2]
    assert table.vacuum() > 0 and table.vacuum() == 0 and table.count() == 1000


def test_unfinished_write_stays_invisible(spark, monkeypatch):
    df = spark.range(20).select(F.col("id"), F.lit(1).alias("v"))
    table = MergedTable(spark, fresh_folder(spark, "table"), "id", df.schema)
    table.replace(df)
    # A run that dies before its log entry.
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.merge(df.withColumn("v", F.lit(9)))
    monkeypatch.setattr(type(spark), "createDataFrame", make)
    assert table.read().filter("v = 9").count() == 0
    table.replace(df.withColumn("v", F.lit(3)))
    assert table.read().groupBy("v").count().collect() == [(3, 20)]


STEPS = [("tender_table", "merge"), ("item_table", "merge"), ("statistics", "replace_keys"), ("vectors", "replace_keys")]


@pytest.mark.parametrize("step", STEPS, ids=[s[0] for s in STEPS])
def test_replay_repairs_a_run_that_died_after_any_step(spark, step):
    store = TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(frame(spark, FIRST), 0, embed=False, refresh=False)
    part = getattr(store, step[0])
    whole = getattr(part, step[1])

    def dies(*args, **named):
        whole(*args, **named)
        raise RuntimeError("lost")

    setattr(part, step[1], dies)
    with pytest.raises(RuntimeError):
        store.apply(frame(spark, SECOND), 1)
    setattr(part, step[1], whole)
    assert store.apply(frame(spark, SECOND), 1)["status"] == "ok"
    assert state(store) == EXPECTED and store.quality_report().isEmpty()
    assert store.items().count() == 5 and store.vectors.count() == 3


def test_two_runs_take_all_of_a_date_and_what_has_none(spark):
    store = TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(frame(spark, [("t0", document("t0", "2024-01-01T00:00:00+00:00", "33", 1.0))]), 0, embed=False)
    same = [(f"t{n}", document(f"t{n}", "2024-01-02T00:00:00+00:00", "33", 1.0)) for n in range(1, 5)]
    odd = [("t5", document("t5", "some day", "33", 1.0)), ("bad", "{")]
    later = [("t6", document("t6", "2024-01-03T00:00:00+00:00", "33", 1.0))]
    feed = frame(spark, same + odd + later)
    assert run_update(store, feed, 1, limit=2)["n_tenders"] == 5
    assert run_update(store, feed, 2, limit=2)["n_tenders"] == 1
    assert run_update(store, feed, 3, limit=2)["status"] == "up_to_date"
    # One that comes late with the cursor's own date is not missed.
    assert run_update(store, feed.unionByName(frame(spark, [("t7", document("t7", "2024-01-03T00:00:00+00:00", "33", 1.0))])), 4)["n_tenders"] == 1
    assert store.tenders().count() == 8 and store.rejected().count() == 1


def test_a_run_without_baseline_leaves_its_number_free(spark):
    store = TenderStore(spark, fresh_folder(spark, "store"))
    assert run_update(store, frame(spark, FIRST), 7)["status"] == "no_baseline"
    assert store.apply(frame(spark, FIRST), 7, embed=False)["status"] == "ok"


def test_statistics_wait_for_a_refresh_without_being_wrong(spark):
    store = TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(frame(spark, FIRST), 0, embed=False, refresh=False)
    store.apply(frame(spark, SECOND), 1, embed=False, refresh=False)
    assert store.statistics.count() == 0 and state(store) == EXPECTED
    assert store.refresh() == 2 and store.refresh() == 0 and state(store) == EXPECTED
    assert store.vacuum() >= 0 and state(store) == EXPECTED


def test_change_feed_is_strictly_after_the_cursor(spark):
    df = spark.createDataFrame([(n, f"2024-01-0{n}") for n in range(1, 6)], "tender_id long, d string").withColumn("date_modified", F.to_timestamp("d"))
    ids = lambda **o: [r.tender_id for r in raw.change_feed(df, **o).collect()]
    assert ids(since="2024-01-02 00:00:00", limit=2) == [3, 4]
    assert ids(since="2024-01-02 00:00:00", limit=0) == [3, 4, 5]
    assert ids(since="2024-01-04 00:00:00", descending=True, limit=2) == [5, 4]


def test_touched_and_missing_documents(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "tender_id string")
    touched = spark.createDataFrame([("a",), ("a",), ("z",)], "tender_id string")
    assert [r[0] for r in raw.touched_documents(docs, touched).collect()] == ["a"]
    assert [r[0] for r in raw.missing_documents(docs, touched).collect()] == ["z"]
    assert [r[0] for r in raw.new_documents(touched, docs).collect()] == ["z"]


def test_documents_are_judged_one_by_one(spark):
    bodies = {
        "plain": '{"id":"a"}', "wrapped": '{"data":{"id":"b","value":[],"awards":{},"items":null,"bids":""}}', "list": "[1]", "broken": "{", "no id": '{"x":1}',
        "bad value": '{"id":"c","value":"much"}', "bad items": '{"id":"d","items":{"a":1}}', "own id": '{"id":"e","data":{"id":"f"}}', "twice": '{"id":"x","id":"g"}',
        "number award": '{"id":"h","awards":[5]}', "text supplier": '{"id":"i","awards":[{"suppliers":["x"]}]}', "good award": '{"id":"j","awards":[{"suppliers":[{"name":"x"}]}],"items":[]}',
        "ends": '{"id":"k"}\n\r\t ',
    }
    parsed = raw.parse_documents(frame(spark, list(bodies.items())))
    got = {r.source_file: (r.tender_id, r.reject_reason) for r in parsed.collect()}
    assert got == {
        "plain": ("a", None), "wrapped": ("b", None), "list": (None, "not an object"), "broken": (None, "unreadable"), "no id": (None, "no id"),
        "bad value": ("c", "malformed"), "bad items": ("d", "malformed"), "own id": ("e", None), "twice": ("g", None),
        "number award": ("h", "malformed"), "text supplier": ("i", "malformed"), "good award": ("j", None), "ends": ("k", None),
    }
    assert {r.outcome: r.n_documents for r in raw.run_counters(parsed).collect()}["ok"] == 6


def test_landing_keeps_or_replaces(spark):
    kind = "tender_id string, body string"
    landed = spark.createDataFrame([("a", "old"), ("b", "old")], kind)
    incoming = spark.createDataFrame([("b", "new"), ("c", "new"), ("c", "new")], kind)
    rows = lambda **o: {tuple(r) for r in raw.land(landed, incoming, **o).collect()}
    assert rows() == {("a", "old"), ("b", "old"), ("c", "new")}
    assert rows(overwrite=True) == {("a", "old"), ("b", "new"), ("c", "new")}


def test_nothing_in_nothing_out(spark):
    parsed = raw.good_documents(raw.parse_documents(frame(spark, [])))
    rows = price_deviation(flatten_tenders(parsed))
    assert rows.isEmpty() and set(rows.columns) == set(TENDERS.fieldNames())
    assert flatten_items(parsed).isEmpty()
    store = TenderStore(spark, fresh_folder(spark, "store"))
    assert store.apply(frame(spark, [("x", "{")]), 0) == {"status": "up_to_date", "since": None, "n_tenders": 0}
    assert store.tenders().isEmpty() and store.cursor() is None


def test_runs_read_only_the_days_at_or_after_the_cursor(spark, tmp_path):
    """Files of earlier days may even be broken."""
    day = lambda n: f"2024-01-{n:02}T00:00:00+00:00"
    rows = [(f"t{n}", document(f"t{n}", day(n), "33", float(n))) for n in range(1, 7)] + [("odd", document("t8", "some day", "33", 8.0)), ("bad", "{")]
    landing = str(tmp_path / "landing")
    raw.land_by_day(frame(spark, rows), landing)
    store = TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(frame(spark, rows[:3]), 0, embed=False)
    for n in (1, 2):
        for file in (tmp_path / "landing" / f"day=2024-01-{n:02}").glob("*.parquet"):
            file.write_bytes(b"no parquet")
    feed = raw.read_landing(spark, landing)
    plan = raw.changed_since(feed, store.cursor())._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "day" in plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert run_update(store, feed, 1, limit=2, relevant_only=False, embed=False)["n_tenders"] == 3
    assert store.cursor() == "2024-01-05T00:00:00.000000+00:00"
    assert run_update(store, feed, 2, limit=2, relevant_only=False, embed=False)["n_tenders"] == 1
    assert run_update(store, feed, 3, limit=2, relevant_only=False, embed=False)["status"] == "up_to_date"
    assert {r.tender_id for r in store.tenders_plain().collect()} == {*(f"t{n}" for n in range(1, 7)), "t8"} and store.rejected().count() == 1
    # A late document of the cursor's day is found among those of its day.
    raw.land_by_day(frame(spark, [("t9", document("t9", day(6), "33", 1.0))]), landing)
    assert run_update(store, raw.read_landing(spark, landing), 4, relevant_only=False, embed=False)["n_tenders"] == 1


def test_ids_and_dates_before_the_full_parse(spark):
    bodies = ['{"id":"a","dateModified":"2024-01-05T23:30:00-01:00"}', '{"data":{"id":"b","dateModified":"2024-01-05"}}', '{"id":"c"}', "{", "[1]", '{"dateModified":"x"}', ""]
    rows = raw.with_frame(frame(spark, [(str(i), b) for i, b in enumerate(bodies)])).orderBy("source_file").collect()
    assert [r.document_id for r in rows] == ["a", "b", "c", None, None, None, None]
    assert [str(r.day) for r in rows] == ["2024-01-06", "2024-01-05", *["None"] * 5]


def test_a_refresh_reads_no_tenders(spark, monkeypatch):
    store = TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(frame(spark, FIRST), 0, embed=False, refresh=False)
    store.apply(frame(spark, SECOND), 1, embed=False, refresh=False)
    monkeypatch.setattr(store.tender_table, "_resolved", lambda *a: (_ for _ in ()).throw(RuntimeError("tenders were read")))
    assert store.refresh() == 2
    got = {r.cpv_main: (r.category_median, r.category_n) for r in store.statistics.read().collect()}
    assert got == {"33": (200.0, 2), "18": (60.0, 2)}


def test_changes_of_a_batch_that_never_ended_are_corrected(spark, monkeypatch):
    """A batch of one source dies after its changes are noted; one of another source takes the same tender."""
    store = TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(frame(spark, FIRST), 0, embed=False)
    merge = store.tender_table.merge
    store.tender_table.merge = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.apply(frame(spark, SECOND[:1]), 0, embed=False, source="other")
    store.tender_table.merge = merge
    store.apply(frame(spark, [("t2.json", document("t2", "2024-01-15T00:00:00+00:00", "33", 150.0))]), 1, embed=False)
    assert state(store)["t1"][2] == pytest.approx(-20) and state(store)["t3"][2] is None
    store.apply(frame(spark, SECOND[:1]), 0, embed=False, source="other")
    direct = {r.tender_id: r.price_deviation_pct for r in price_deviation(store.tenders_plain()).collect()}
    assert {k: v[2] for k, v in state(store).items()} == direct and direct["t3"] == pytest.approx(-100 / 6)
