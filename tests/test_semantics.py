"""Corner cases on small hand-written tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotwatch import fixed_values as fixed
from lotwatch.functions import text as tx
from lotwatch.functions import values as vl
from lotwatch.operators import answers, chunks, evidence, filters, flatten, groups, routing, versions
from lotwatch.plans import reports
from lotwatch.schema import ITEMS, TENDERS

URL = "https://example.org/t/"


def tenders(spark, *rows):
    """Tender rows from partial dictionaries."""
    return spark.createDataFrame([tuple(r.get(f) for f in TENDERS.fieldNames()) for r in rows], TENDERS)


def items(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f) for f in ITEMS.fieldNames()) for r in rows], ITEMS)


def one(spark, column, **values):
    """Value of an expression over one row of strings."""
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column).first()[0]


def award(number, buyer="B", supplier="S", amount=95000.0, **more):
    return {"tender_id": f"id{number}", "tender_number": f"UA-2024-01-01-{number:06d}-a", "buyer_name": buyer,
            "supplier_name": supplier, "awarded_amount": amount, **more}


# --- reports -----------------------------------------------------------------


def test_splitting_group_with_evidence(spark):
    t = tenders(
        spark, award(1, amount=99000.0), award(2, amount=96012.0), award(3, amount=96012.0),
        award(4, supplier="T", amount=90000.0), award(5, supplier="T", amount=99999.0), award(6, supplier="T", amount=99999.5),
        award(7, supplier="U", amount=89999.99), award(8, supplier=None), award(9, supplier=None), award(10, supplier=None),
        award(11, supplier="«Оборонний Постачальник»"), award(12, supplier="«Оборонний Постачальник»"),
        award(13, supplier="«Оборонний Постачальник»"),
    )
    rows = reports.contract_splitting(t).collect()
    assert [(r.supplier_name, r.n_contracts, r.total_amount, r.evidence_page) for r in rows] == [("S", 3, 291024.0, 0)]
    assert rows[0].tender_numbers == ", ".join(f"UA-2024-01-01-{n:06d}-a" for n in (1, 2, 3))


def test_evidence_of_a_large_group_goes_over_pages_and_stays_whole(spark):
    t = tenders(spark, *(award(n) for n in range(200)))
    ranked = t.groupBy("buyer_name", "supplier_name").agg(F.count(F.lit(1)).alias("n"))
    pages = evidence.with_evidence_pages(ranked, t, ["buyer_name", "supplier_name"], "n", ids_per_page=20).collect()
    ids = [i for p in pages for i in p.tender_numbers.split(", ")]
    assert len(pages) == 10 and len(ids) == len(set(ids)) == 200


def test_masked_supplier_never_leads_the_ranking(spark):
    rows = [award(n, supplier="Оборонний постачальник") for n in range(38)]
    rows += [award(100 + n, supplier="Real") for n in range(24)] + [award(200 + n, supplier=None) for n in range(30)]
    top = reports.supplier_ranking(tenders(spark, *rows)).collect()
    assert [(r.supplier_name, r.n_wins, r.share_of_total) for r in top] == [("Real", 24, 1.0)]


def test_missing_name_is_neither_masked_nor_a_party(spark):
    t = tenders(spark, award(1, supplier=None), award(2, supplier="ПРИХОВАНО"), award(3))
    got = {r.tender_id: (r.m, r.p) for r in t.select("tender_id", filters.is_masked().alias("m"), filters.not_masked().alias("p")).collect()}
    assert got == {"id1": (False, False), "id2": (True, False), "id3": (False, True)}


def test_totals_do_not_fan_out(spark):
    t = tenders(spark, award(1, amount=10.0, cpv_main="30"), award(2, amount=5.0, cpv_main="33"))
    i = items(spark, *({"tender_id": "id1", "item_id": str(n), "cpv": "30"} for n in range(10)), {"tender_id": "id2", "cpv": "30"})
    r = reports.total_with_item_condition(t, i, filters.cpv_prefix("30"), F.col("cpv") == "30").first()
    assert (r.total_amount, r.n_tenders) == (15.0, 2)


def test_concentration_needs_no_exact_case(spark):
    t = tenders(spark, award(1, buyer="Департамент БЕЗПЕКИ"), award(2, buyer="департамент безпеки"), award(3, buyer="Інший"))
    assert reports.supplier_concentration(t, "Безпеки").first().n_wins == 2


def test_hedge_finds_titles_that_labels_lack(spark):
    t = tenders(spark, award(1, cpv_main="34", cpv_description="Апарати", title="Дрони"), award(2, cpv_main="99", title="ДРОН"), award(3, cpv_main="31"))
    assert t.filter(filters.category_hedge("31", "дрон")).count() == 3
    assert t.filter(filters.category_hedge(None, "дрон")).count() == 2


def test_overpricing_keeps_ties_counts_orphans_and_shows_numbers(spark):
    t = tenders(spark, award(1), award(2))
    i = items(
        spark, {"tender_id": "id1", "description": "Mavic 3T", "unit_amount": 30.0}, {"tender_id": "id2", "description": "MAVIC 3t pro", "unit_amount": 30.0},
        {"tender_id": "gone", "description": "mavic 3T", "unit_amount": 30.0}, {"tender_id": "id1", "description": "Mavic 3T", "unit_amount": 10.0},
        {"tender_id": "id1", "description": "Mavic 3T", "unit_amount": None}, {"tender_id": "id1", "description": "other", "unit_amount": 99.0},
    )
    rows = sorted(reports.item_overpricing(i, t, "mavic 3t").collect(), key=lambda r: r.tender_number)
    assert [r.tender_number for r in rows] == ["UA-2024-01-01-000001-a", "UA-2024-01-01-000002-a"]
    assert {(r.sample_size, r.avg_unit_amount, r.median_unit_amount, r.ratio_to_median) for r in rows} == {(4, 25.0, 30.0, 1.0)}


def test_outliers_are_above_the_mean_only(spark):
    i = items(spark, *({"tender_id": f"id{n}", "item_id": str(n), "description": "папір", "unit_amount": x} for n, x in enumerate([1.0, 10.0, 10.0, 10.0, 20.0])))
    rows = reports.price_outliers(i, "Папір").collect()
    assert [(r.unit_amount, r.sample_size) for r in rows] == [(20.0, 5)]
    assert not reports.small_sample(reports.price_outliers(i, "Папір")).first().is_small_sample
    assert reports.small_sample(i.select(F.lit("2").alias("sample_size"))).first().is_small_sample


def test_bound_values_are_inert(spark):
    t = tenders(spark, award(1))
    bad = "'; DROP TABLE tenders; --"
    assert reports.supplier_concentration(t, bad).count() == 0
    assert reports.ad_hoc(spark, "SELECT * FROM {tenders} WHERE buyer_name = :b", t, t, {"b": bad}).count() == 0
    assert reports.tender_lookup(t, bad).count() == 0 and t.count() == 1


def test_wildcards_in_values_stay_wildcards(spark):
    assert one(spark, tx.contains_ci(F.col("x"), "a_c"), x="xABCx") is True
    assert one(spark, tx.contains_ci(F.col("x"), "a%d"), x="abcd") is True
    assert one(spark, tx.contains_ci(F.col("x"), "a\\_c"), x="abc") is False


def test_analysis_leaves_the_tender_out(spark):
    t = tenders(spark, award(1, amount=130.0, cpv_main="33"), award(2, amount=100.0, cpv_main="33"), award(3, amount=None, cpv_main="33"),
                award(4, amount=7.0, cpv_main=None), award(5, amount=9.0, cpv_main=None), award(6, amount=1.0, cpv_main="18"))
    got = {r.tender_id: (r.category_avg, r.ratio, r.is_anomaly) for r in reports.tender_analysis_all(t).collect()}
    assert got == {"id1": (100.0, 1.3, True), "id2": (130.0, 100 / 130, False), "id3": (115.0, None, False),
                   "id4": (None, None, False), "id5": (None, None, False), "id6": (None, None, False)}
    single = reports.tender_analysis(t, "UA-2024-01-01-000001-a").first()
    assert (single.category_avg, single.is_anomaly, single.awarded_text) == (100.0, True, "130.00")
    assert reports.tender_analysis(t, "UA-2024-01-01-000004-a").first().category_avg is None


def test_record_and_average(spark):
    t = tenders(spark, award(1, amount=1.0, cpv_main="30"), award(2, buyer="C", amount=3.0, cpv_main="30"), award(3, amount=None, cpv_main="30"))
    r = reports.category_average_and_record(t, filters.cpv_prefix("30")).first()
    assert (r.average_amount, r.buyer_name, r.max_single_payment) == (2.0, "C", 3.0)


def test_staleness_and_cursor(spark):
    at = dt.datetime(2024, 1, 1, 0, 0)
    t = tenders(spark, award(1, date_modified=at))
    now = F.lit("2024-01-03 07:12:00").cast("timestamp")
    r = reports.staleness(t, now).first()
    assert r.hours_since_sync == pytest.approx(55.2) and r.is_stale
    assert reports.resume_cursor(t).first().cursor == "2024-01-01T00:00:00.000000+00:00"
    empty = reports.staleness(t.filter("1 = 0"), now).first()
    assert empty.hours_since_sync is None and not empty.is_stale


def test_status_preview_and_party_check(spark):
    t = tenders(spark, *(award(n) for n in range(31)))
    assert reports.report_status(reports.investigate("monopoly", t, t)) == "missing_parameter"
    assert reports.report_status(reports.investigate("splitting", t, t, "nobody")) == "empty"
    assert reports.report_status(reports.investigate("splitting", t, t)) == "ok"
    rows, more = reports.preview(t)
    assert rows.count() == 30 and more and not reports.preview(t.limit(30))[1]
    assert reports.names_no_party(t.select("title")) and not reports.names_no_party(t)
    with pytest.raises(ValueError):
        reports.investigate("other", t, t)


# --- versions and groups -------------------------------------------------------


def test_unreadable_date_wins_and_null_key_is_one_key(spark):
    rows = [("a", "2024-01-02", "f1"), ("a", None, "f2"), ("b", "2024-01-01", "f1"), ("b", "2024-01-03", "f0"), (None, "2024-01-01", "x"), (None, "2024-01-02", "y"), ("c", "2024-01-01", "f1"), ("c", "2024-01-01", "f2")]
    df = spark.createDataFrame(rows, "tender_id string, d string, source_file string").withColumn("date_modified", F.to_timestamp("d"))
    assert {(r.tender_id, r.source_file) for r in versions.latest_version(df).collect()} == {("a", "f2"), ("b", "f0"), (None, "y"), ("c", "f2")}


def test_items_go_by_arrival_and_removed_items_can_be_dropped(spark):
    kind = "tender_id string, item_id string, batch_seq long, source_file string, position long"
    old = spark.createDataFrame([("t", "1", 1, "f", 0), ("t", "2", 1, "f", 1), ("u", "1", 1, "f", 0)], kind)
    new = spark.createDataFrame([("t", "1", 2, "a", 0)], kind)
    key = lambda df: {(r.tender_id, r.item_id, r.batch_seq) for r in df.collect()}
    assert key(versions.upsert_items(old, new)) == {("t", "1", 2), ("t", "2", 1), ("u", "1", 1)}
    assert key(versions.upsert_items(old, new, replace_children=True)) == {("t", "1", 2), ("u", "1", 1)}


def test_deviation_guards(spark):
    t = tenders(spark, award(1, amount=100.0, cpv_main="33"), award(2, amount=200.0, cpv_main="33"), award(3, amount=None, cpv_main="33"),
                award(4, amount=5.0, cpv_main="18"), award(5, amount=0.0, cpv_main="0"), award(6, amount=0.0, cpv_main="0"),
                award(7, amount=1.0, cpv_main=None), award(8, amount=2.0, cpv_main=None))
    got = {r.tender_id: r.price_deviation_pct for r in groups.price_deviation(t).collect()}
    assert got.pop("id1") == pytest.approx(-100 / 3) and got.pop("id2") == pytest.approx(100 / 3)
    assert got == {f"id{n}": None for n in range(3, 9)}


@pytest.mark.parametrize("values_per_cell", [1_000_000, 2])
def test_exact_median_against_brute_force(spark, values_per_cell):
    import random

    rng = random.Random(5)
    rows = [("hot", rng.choice([1, -1]) * rng.lognormvariate(3, 4)) for _ in range(3001)]
    rows += [("same", 7.25)] * 500 + [("pair", 1.0), ("pair", 2.0), ("zero", 0.0), ("empty", None), (None, 3.0), ("nan", float("nan"))]
    rows += [("narrow", 95000 + n * 1e-6) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.median, r.n_values) for r in groups.exact_median(df, ["k"], "v", values_per_cell).collect()}
    clean = df.filter("k IS NOT NULL AND NOT isnan(v)").groupBy("k").agg(F.median("v").alias("m"), F.count("v").alias("n")).filter("n > 0")
    expected = {r.k: (r.m, r.n) for r in clean.collect()}
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k] == (pytest.approx(expected[k][0], rel=1e-12), expected[k][1])


def test_attach_keeps_all_rows_and_gives_null_keys_nothing(spark):
    rows = spark.createDataFrame([(n % 7 or None, float(n)) for n in range(100)], "k long, v double")
    stats = rows.filter("k IS NOT NULL").groupBy("k").agg(F.sum("v").alias("s"))
    found = groups.attach(rows, stats, ["k"]).collect()
    sums = {k: float(sum(n for n in range(100) if n % 7 == k)) for k in range(1, 7)}
    assert sorted((r.v, r.s) for r in found) == sorted((float(n), sums.get(n % 7)) for n in range(100))


# --- flattening ------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, value",
    [("12.5", 12.5), (" 7 ", 7.0), ("1e3", 1000.0), (".5", 0.5), ("", None), ("abc", None), ("1.5d", None), ("1_000", None), ("NaN", None), ("Infinity", None), ("1e999", None), ("-1e999", None), (None, None)],
)
def test_lenient_numbers(spark, text, value):
    assert one(spark, vl.to_double(F.col("x")), x=text) == value


def test_instants_with_offsets_and_mixed_fractions(spark):
    shown = lambda x: one(spark, vl.iso_instant(vl.to_instant(F.col("x"))), x=x)
    assert shown("2024-01-02T03:04:05+02:00") == "2024-01-02T01:04:05.000000+00:00"
    assert shown("2024-01-02T03:04:05.123456+02:00") == "2024-01-02T01:04:05.123456+00:00"
    assert shown("soon") is None


def test_award_precedence(spark):
    cases = {  # contract amount and currency, award amount and currency -> amount, currency
        ("10", "USD", "20", "EUR"): ("10", "USD"), ("10", "", "20", "EUR"): ("10", "UAH"), (None, "USD", "20", "EUR"): ("20", "EUR"),
        (None, "USD", "20", ""): ("20", "USD"), (None, None, None, None): (None, "UAH"), (None, "USD", None, None): (None, "USD"),
    }
    names = ["ca", "cc", "aa", "ac"]
    df = spark.createDataFrame(list(cases), ", ".join(f"{n} string" for n in names))
    amount, currency = flatten.awarded(*(F.col(n) for n in names), F.lit("UAH"))
    got = {tuple(r[:4]): (r[4], r[5]) for r in df.select("*", amount.alias("a"), currency.alias("c")).collect()}
    assert got == cases


# --- routing -----------------------------------------------------------------------


@pytest.mark.parametrize(
    "question, path",
    [
        ("Скільки всього тендерів в базі?", "sql"), ("скільки загалом закупівель", "sql"), ("скільки коштує генератор", "vector"),
        ("Який постачальник найкращий", "vector"), ("які тендери найчастіше", "vector"), ("назви замовника, який витратив максимальну суму", "sql"),
        ("найчастіше вимоги", "vector"), ("А це за всі дрони?", "followup"), ("Чому середня ціна генераторів вища?", "sql"),
        ("Чи є ознаки дроблення тендерів?", "investigation:splitting"), ("монополія і схеми", "investigation:splitting"),
        ("улюблені постачальники", "investigation:monopoly"), ("хто переплатив за Mavic", "investigation:overpricing"),
        ("порівняй ціна центру", "followup"),
    ],
)
def test_routes(spark, question, path):
    assert one(spark, routing.route(F.col("q")), q=question) == path


def test_whole_word_option(spark):
    assert one(spark, routing.is_followup(F.col("q"), whole_word=True), q="порівняй ціна центру") is False
    assert one(spark, routing.is_followup(F.col("q"), whole_word=True), q="А це що?") is True


# --- text ----------------------------------------------------------------------------


def test_links_and_escapes(spark):
    text = "див. [назва](https://x.org/a) та www.y.com/z_1 кінець"
    assert one(spark, tx.strip_links(F.col("x")), x=text) == "див. назва та  кінець"
    assert one(spark, tx.escape_markdown(F.col("x")), x="a_b*c`d[e]") == r"a\_b\*c\`d\[e]"
    assert one(spark, tx.links_to_plain(F.col("x")), x=r"[L](u) a\_b\[") == "L (u) a_b["


def test_only_known_ids_become_links(spark):
    known = "UA-2024-01-01-000001-а"  # Cyrillic suffix
    unknown = "UA-2024-01-01-000002-a"
    ids = F.array(F.lit(known), F.lit("UA-2024-01-01-000003-a"))
    got = one(spark, tx.link_known_ids(F.col("x"), ids, URL), x=f"{known}, {unknown}_z {known} і {unknown}!")
    assert got == f"[{known}]({URL}{known}), {unknown}\\_z [{known}]({URL}{known}) і {unknown}!"


def test_evidence_is_appended_only_when_none_is_cited(spark):
    ids = F.array(F.lit("UA-2"), F.lit("UA-1"))
    assert one(spark, tx.with_evidence(F.col("x"), ids, URL), x="see UA-1") == "see UA-1"
    assert one(spark, tx.with_evidence(F.col("x"), ids, URL), x="none") == f"none\n\n📎 Тендери: [UA-1]({URL}UA-1), [UA-2]({URL}UA-2)"
    assert one(spark, tx.with_evidence(F.col("x"), F.array().cast("array<string>"), URL), x="none") == "none"


@pytest.mark.parametrize(
    "answer, context, expected",
    [
        ("ціна 3 047 500 грн", "", []), ("політ 15 км", "нічого", ["15 км"]), ("політ 15 км", "до 15 км", []), ("вага 1000 г", "", []),
        ("вага 900 г. разом", "", ["900 г."]), ("ціна 900 г.рн", "", []), ("12 Метрів і 2 кг", "", ["12 Метрів", "2 кг"]), ("швидкість 60 км/год", "", ["60 км/год"]),
    ],
)
def test_ungrounded_measurements(spark, answer, context, expected):
    assert one(spark, tx.ungrounded_measurements(F.col("a"), F.col("c")), a=answer, c=context) == expected


def test_money_forms(spark):
    assert one(spark, vl.money(F.col("x").cast("double")), x="1234567.5") == "1 234 567.50"
    assert one(spark, vl.money_compact(F.col("x").cast("double")), x="46700000") == "46.7 млн"
    assert one(spark, vl.money_compact(F.col("x").cast("double")), x="304749.99") == "304 750"


@pytest.mark.parametrize("raw, clean", [(' "Mavic 3T." ', "Mavic 3T"), ("none", None), ("'NONE'", None), (" ", None), ("'.'", None)])
def test_clean_parameter(spark, raw, clean):
    assert one(spark, vl.clean_parameter(F.col("x")), x=raw) == clean


def test_chunk_text_states_what_is_missing(spark):
    t = tenders(spark, award(1, title="Дрон", budget_amount=1e7, budget_currency=None))
    lines = t.select(tx.chunk_text(t.schema)).first()[0].split("\n")
    assert len(lines) == 10 and lines[0] == "Тендер: Дрон" and lines[2] == "Замовник: B (не вказано), тип замовника: не вказано"
    assert lines[5] == "Орієнтовний бюджет: 10000000.00 "


def test_metadata_drops_missing_values(spark):
    df = spark.createDataFrame([("a", None, float("nan"), True)], "s string, n long, x double, b boolean")
    assert df.select(tx.metadata_json(df.schema)).first()[0] == '{"s":"a","b":true}'


def test_split_at_line_ends(spark):
    text = "a" * 7 + "\n\n\n" + "b" * 12 + "\nc"
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "i int, text string")
    got = {}
    for r in sorted(chunks.split_texts(df, limit=10).collect(), key=lambda r: (r.i, r.position)):
        got.setdefault(r.i, []).append(r.piece)
    assert got == {1: ["a" * 7 + "\n\n", "b" * 10, "bb\nc"], 2: ["short"], 3: [""]}


def test_answer_audit(spark):
    kind = "answer_id int, text string, context string, known_ids array<string>, sample_size long"
    df = spark.createDataFrame([(1, "вага 5 кг [x](https://a.b)", "", ["UA-2024-01-01-000001-a"], 2), (2, "ok", None, None, None)], kind)
    got = {r.answer_id: r for r in answers.audit_answers(df, URL).collect()}
    assert got[1].ungrounded == ["5 кг"] and got[1].is_small_sample
    assert got[1].audited.startswith("ℹ️ Small sample, N=2\n\n⚠️ Not found in the evidence: 5 кг\n\nвага 5 кг x\n\n📎")
    assert got[2].audited == "ok" and not got[2].is_small_sample


def test_restrictive_specification(spark):
    signal = tx.restrictive_specification(F.col("x"), [r"mavic \d"])
    assert one(spark, signal, x="Дрон Mavic 3") is True
    assert one(spark, signal, x="Дрон Mavic 3 або еквівалент") is False


def test_evidence_ids_of_both_shapes(spark):
    df = spark.createDataFrame([("a, b,,", "c "), ("b", None)], "tender_numbers string, tender_number string")
    assert sorted(r[0] for r in evidence.evidence_ids(df).collect()) == ["a", "b", "c"]


def test_relevance_survives_missing_values(spark):
    t = tenders(spark, {"tender_id": "1", "title": None}, {"tender_id": "2", "title": "ДРОНИ"}, {"tender_id": "3", "title": "x"}, {"tender_id": "4"})
    i = items(spark, {"tender_id": "1", "cpv": "33100"}, {"tender_id": "3", "cpv": None, "description": None}, {"tender_id": "4", "description": "Генератор"})
    assert {r.tender_id for r in filters.relevant_documents(t, i).collect()} == {"1", "2", "4"}


def test_category_dictionary_and_key_lists(spark):
    t = tenders(spark, award(1, cpv_main="33100"), award(2, cpv_main="99"), award(3, cpv_main=None))
    assert [r.category for r in filters.with_category(t).orderBy("tender_id").collect()] == [fixed.CPV_CATEGORIES["33"], None, None]
    assert filters.with_key_in(t, "tender_id", []).count() == 0 and filters.with_key_in(t, "tender_id", ["id2"]).count() == 1
