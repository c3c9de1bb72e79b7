"""Every operator bound to the star-schema tables, as named queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch import fixed_values as fixed
from lotwatch.functions import text as tx
from lotwatch.functions import values as vl
from lotwatch.operators import answers as an
from lotwatch.operators import chunks, embedding, evidence, filters, flatten, groups, inverted, neighbours, routing, versions
from lotwatch.plans import reports as rp
from lotwatch.plans.star import (
    LINE_KEY, VERSION_ORDER, answers, damaged_documents, event_documents, label_probes, latest_lines, line_items, order_tenders,
    raw_documents, record_number, table, tender_view,
)
from lotwatch.schema import TENDERS, VECTORS
from lotwatch.session import fresh_folder, stored
from lotwatch.sources import raw, tables
from lotwatch.streaming import sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MASK = ["#000000007"]
DIM = 64
BASE_URL = "https://example.org/tender/"
ALL_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
AWARD_VIEW = ["buyer_name", "supplier_name", "awarded_amount", "tender_number"]
MODEL_PATTERNS = ["the [a-z]+tion[ .,]", "le [a-z]+ment[ .,]", "der [a-z]+en[ .,]"]
QUESTION_WORDS = {
    "leading": ["is ", "le ", "der "],
    "qualitative": ["über", "que", "hand"],
    "quantitative": ["the", "und", "los", "la "],
    "followup": ["why?", "ente.", "same"],
    "triggers": {"splitting": ["schw", "ring"], "monopoly": ["thand", "elle"], "overpricing": ["ción", "ment"]},
}


def query(function):
    """Register a query; all of them read and show instants in UTC."""

    @wraps(function)
    def run(spark: SparkSession, d: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, d)

    QUERIES[function.__name__] = run
    return run


# --- reports -----------------------------------------------------------------


@query
def splitting_scan(spark, d):
    return rp.contract_splitting(tender_view(spark, d, *AWARD_VIEW), masks=MASK)


@query
def splitting_one_buyer(spark, d):
    return rp.contract_splitting(tender_view(spark, d, *AWARD_VIEW), buyer="nation_7", masks=MASK)


@query
def supplier_concentration(spark, d):
    return rp.supplier_concentration(tender_view(spark, d, *AWARD_VIEW), "nation_7", masks=MASK)


@query
def supplier_ranking_masked(spark, d):
    t = tender_view(spark, d, "supplier_name", "awarded_amount")
    t = t.withColumn("supplier_name", F.nullif("supplier_name", F.lit("Supplier#000000003")))
    return rp.supplier_ranking(t, masks=MASK)


@query
def category_hedge_ranking(spark, d):
    t = tender_view(spark, d, "supplier_name", "awarded_amount", "cpv_main", "cpv_description", "title")
    return rp.category_supplier_ranking(t, "PROMO", "red", masks=MASK)


@query
def repeat_supplier(spark, d):
    t = tender_view(spark, d, "buyer_name", "supplier_name")
    return rp.repeat_suppliers(t, "buyer_name", masks=MASK)


@query
def item_statistics(spark, d):
    r = rp.item_statistics(line_items(spark, d), "red")
    return r.withColumns({c: F.round(c, 6) for c in ("avg_unit_amount", "median_unit_amount")})


@query
def item_overpricing(spark, d):
    r = rp.item_overpricing(line_items(spark, d), order_tenders(spark, d), "red plate")
    return r.withColumns({c: F.round(c, 6) for c in ("unit_amount", "avg_unit_amount", "median_unit_amount", "ratio_to_median")})


@query
def item_price_outliers(spark, d):
    return rp.price_outliers(line_items(spark, d), "red").withColumns({c: F.round(c, 6) for c in ("unit_amount", "avg_unit_amount")})


@query
def small_sample_caveat(spark, d):
    per_item = line_items(spark, d).groupBy("description", "cpv").agg(F.count(F.lit(1)).alias("sample_size"))
    return rp.small_sample(per_item, floor=30)


@query
def category_total_no_fanout(spark, d):
    return rp.category_totals(order_tenders(spark, d))


@query
def fanout_semijoin(spark, d):
    return rp.total_with_item_condition(
        order_tenders(spark, d), line_items(spark, d), filters.cpv_prefix("1-"), tx.contains_ci(F.col("description"), "RED p")
    )


@query
def category_avg_and_top(spark, d):
    return rp.category_average_and_record(order_tenders(spark, d), filters.cpv_prefix("1-"))


@query
def category_year_count(spark, d):
    t = tender_view(spark, d, "cpv_main", "cpv_description", "title", "date_created")
    return rp.category_year_count(t, filters.category_hedge("PROMO", "red"), 1997)


@query
def market_stats(spark, d):
    return rp.market_statistics(order_tenders(spark, d), line_items(spark, d))


@query
def tender_analysis(spark, d):
    return rp.tender_analysis(order_tenders(spark, d), "o-7").withColumns(
        {"category_avg": F.round("category_avg", 4), "ratio": F.round("ratio", 6)}
    )


@query
def tender_analysis_all(spark, d):
    r = rp.tender_analysis_all(order_tenders(spark, d), masks=["clerk o"])
    return r.select("tender_number", "category_avg", "ratio", "is_anomaly", "supplier_masked")


@query
def price_deviation(spark, d):
    t = stored(tender_view(spark, d, "tender_number", "cpv_main", "awarded_amount"))
    return groups.price_deviation(t).withColumn("price_deviation_pct", F.round("price_deviation_pct", 6))


@query
def price_deviation_dirty(spark, d):
    """Amounts as text, some of them zero, negative, tiny, or too large for any number."""
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("1e999")).when(F.col("o_orderpriority") == "2-HIGH", F.lit("-1e999"))
        .when(F.col("o_custkey") % 7 == 0, F.lit("0")).when(F.col("o_custkey") % 7 == 1, F.lit("-12.5")).when(F.col("o_custkey") % 7 == 2, F.lit("1e-300"))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    )
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("tender_id"), F.col("o_orderstatus").alias("cpv_main"), vl.to_double(text).alias("awarded_amount"))
    return groups.price_deviation(stored(o)).withColumn("price_deviation_pct", F.round("price_deviation_pct", 6))


@query
def report_states(spark, d):
    """What a report can say of itself: no rows, some, or a parameter that is missing; and whether it names a party."""
    t, i = order_tenders(spark, d), line_items(spark, d)
    reports = {"nobody": rp.investigate("splitting", t, i, "no such buyer"),
               "monopoly": rp.investigate("monopoly", t, i), "prices": rp.investigate("overpricing", t, i, "red plate")}
    rows = [(name, rp.report_status(r), None if r is None else rp.names_no_party(r)) for name, r in reports.items()]
    return spark.createDataFrame(rows, "report string, status string, names_no_party boolean")


@query
def resume_cursor(spark, d):
    return rp.resume_cursor(table(spark, d, "events"), "ts")


@query
def staleness_check(spark, d):
    now = F.lit("2024-02-01 08:30:00").cast("timestamp")
    return rp.staleness(table(spark, d, "events"), now, modified="ts").withColumn("hours_since_sync", F.round("hours_since_sync", 6))


@query
def result_preview(spark, d):
    ordered = order_tenders(spark, d).select("tender_number", "budget_amount").orderBy(F.desc("budget_amount"), "tender_number")
    rows, truncated = rp.preview(ordered)
    return rows.withColumn("is_truncated", F.lit(truncated))


@query
def known_evidence_ids(spark, d):
    return evidence.evidence_ids(splitting_one_buyer(spark, d), keep=["supplier_name"])


@query
def ad_hoc_union(spark, d):
    text = """
        SELECT 'tender' AS kind, cpv_main AS label, count(*) AS n_rows FROM {tenders} WHERE awarded_amount >= :low GROUP BY cpv_main
        UNION
        SELECT 'item' AS kind, cpv AS label, count(*) AS n_rows FROM {items} WHERE line_total >= :low GROUP BY cpv"""
    return rp.ad_hoc(spark, text, order_tenders(spark, d), line_items(spark, d), {"low": 50000.0})


# --- filters -------------------------------------------------------------------


@query
def masked_flag(spark, d):
    s = table(spark, d, "supplier").withColumn("supplier_name", F.nullif("s_name", F.lit("Supplier#000000003")))
    return s.select("s_suppkey", filters.is_masked(masks=MASK).alias("is_masked"), filters.not_masked(masks=MASK).alias("is_party"))


@query
def category_names(spark, d):
    code = F.concat((F.col("p_size") % 8 + 29).cast("string"), F.lit("000000-"), F.col("p_brand"))
    coded = filters.with_category(table(spark, d, "part").withColumn("cpv_main", code))
    return coded.groupBy("category").agg(F.count(F.lit(1)).alias("n_parts"))


@query
def key_list_lookup(spark, d):
    wanted = ["o-1", "o-5", "o-9", "o-12345"]
    return filters.with_key_in(order_tenders(spark, d), "tender_number", wanted).select("tender_number", "budget_amount")


@query
def relevance_filter(spark, d):
    kept = filters.relevant_documents(order_tenders(spark, d), line_items(spark, d), ["PROMO"], ["urgent", "red plate"])
    return kept.select("tender_id", "title")


@query
def relevance_filter_raw(spark, d):
    documents = raw.good_documents(raw.parse_documents(raw_documents(spark, d)))
    return raw.relevant_raw(documents, ["N"], ["line 3", "part 11"]).select("tender_id")


# --- versions and merges ---------------------------------------------------------


@query
def latest_version_dedup(spark, d):
    return latest_lines(spark, d)


@query
def item_arrival_dedup(spark, d):
    rows = table(spark, d, "lineitem").withColumn("arrival", F.col("l_partkey") * 100_000 + F.col("l_suppkey"))
    return versions.last_arrival(rows, LINE_KEY, ["arrival", "l_shipdate", "l_quantity"])


@query
def duplicate_key_check(spark, d):
    return versions.duplicate_keys(table(spark, d, "lineitem"), LINE_KEY)


def _halves(spark, d):
    lines = table(spark, d, "lineitem")
    border = F.lit("1998-06-01").cast("timestamp")
    return lines.filter(F.col("l_shipdate") < border), lines.filter(F.col("l_shipdate") >= border)


@query
def upsert_merge(spark, d):
    older, newer = _halves(spark, d)
    return versions.upsert(newer, older, LINE_KEY, "l_shipdate", VERSION_ORDER)


@query
def incremental_equals_full(spark, d):
    """Three runs against a stored table, the newest rows first."""
    older, newer = _halves(spark, d)
    late = newer.filter(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp"))
    middle = newer.filter(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp"))
    pick = lambda rows: versions.latest_version(rows, LINE_KEY, "l_shipdate", VERSION_ORDER)
    store = tables.MergedTable(spark, fresh_folder(spark, "lines"), LINE_KEY, newer.schema, pick)
    for number, batch in enumerate((late, older, middle)):
        store.merge(batch, number)
    return store.read()


@query
def deviation_after_merge(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("cpv_main"))
    older, newer = _halves(spark, d)
    merged = versions.upsert(older, newer, LINE_KEY, "l_shipdate", VERSION_ORDER)
    rows = merged.join(part, "l_partkey").select(*LINE_KEY, "cpv_main", F.col("l_extendedprice").alias("awarded_amount"))
    return groups.price_deviation(stored(rows)).withColumn("price_deviation_pct", F.round("price_deviation_pct", 6))


@query
def replace_children_merge(spark, d):
    older, newer = _halves(spark, d)
    return versions.upsert_items(older, newer, LINE_KEY, ["l_shipdate", *VERSION_ORDER], "l_orderkey", replace_children=True)


@query
def union_by_name(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return versions.union_by_name(customers, suppliers)


# --- feed, landing, streaming ------------------------------------------------------


@query
def change_feed_ascending(spark, d):
    return raw.change_feed(table(spark, d, "events"), datetime(2024, 1, 15), limit=2000, modified="ts", key="event_id")


@query
def change_feed_newest(spark, d):
    return raw.change_feed(table(spark, d, "events"), descending=True, limit=500, modified="ts", key="event_id")


@query
def landing_skip_existing(spark, d):
    incoming = table(spark, d, "documents").select("doc_id", "lang", "text")
    return raw.new_documents(incoming, table(spark, d, "labels"), "doc_id")


@query
def landing_overwrite(spark, d):
    """Documents with a quality label have landed; all documents come in again, revised."""
    documents = table(spark, d, "documents").select("doc_id", "lang", "source")
    landed = raw.touched_documents(documents, table(spark, d, "labels"), "doc_id")
    first = documents.filter("lang <> 'en'").withColumns({"source": F.lit("revised once"), "modified": F.lit(1)})
    both = first.unionByName(first.withColumns({"source": F.lit("revised"), "modified": F.lit(2)}))
    return raw.land(landed.withColumn("modified", F.lit(0)), both, overwrite=True, key="doc_id", modified="modified").drop("modified")


@query
def raw_landing_roundtrip(spark, d):
    """Documents written to a landing folder, read back, parsed and counted by outcome."""
    landing = fresh_folder(spark, "landing")
    raw.land_lines(damaged_documents(spark, d), landing)
    return raw.run_counters(raw.parse_documents(raw.read_raw_lines(spark, landing)))


@query
def empty_in_empty_out(spark, d):
    """No document is of this kind: tenders, items and statistics have their columns and no row."""
    documents = event_documents(spark, d).join(table(spark, d, "events").filter("event_type = 'no such type'").select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("source_file")), "source_file")
    good = raw.good_documents(raw.parse_documents(documents.select("source_file", "body")))
    made = {"tenders": flatten.flatten_tenders(good), "items": flatten.flatten_items(good), "deviation": groups.price_deviation(flatten.flatten_tenders(good))}
    return tables.row_counts(made).withColumn("n_columns", F.element_at(F.create_map(*(x for n, t in made.items() for x in (F.lit(n), F.lit(len(t.columns))))), F.col("table_name")))


@query
def store_incremental_deviation(spark, d):
    """The tender store built in two runs; categories change between them."""
    documents = stored(raw_documents(spark, d).select("source_file", "body", "l_linestatus").repartition("source_file"))
    store = sync.TenderStore(spark, fresh_folder(spark, "store"))
    for number, status in enumerate(("O", "F")):
        store.apply(documents.filter(F.col("l_linestatus") == status).drop("l_linestatus"), number)
    rows = store.tenders().select("tender_id", "cpv_main", "awarded_amount", "price_deviation_pct")
    return rows.withColumn("price_deviation_pct", F.round("price_deviation_pct", 6))


def landed(spark, documents):
    folder = fresh_folder(spark, "landing")
    raw.land_by_day(documents, folder)
    return raw.read_landing(spark, folder)


@query
def run_update_ties(spark, d):
    """Runs of bounded size over documents of which very many share a date, until nothing is left."""
    documents = stored(event_documents(spark, d))
    store = sync.TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(documents.filter("ts < '2024-01-06'").select("source_file", "body"), 0, embed=False)
    limit, number, landing = documents.count() // 4 + 1, 0, landed(spark, documents)
    while number < 10 and sync.run_update(store, landing, number := number + 1, limit, False, False)["status"] != "up_to_date":
        pass
    return store.tenders_plain().select("tender_id", "date_modified", "cpv_main")


@query
def run_update_undated(spark, d):
    """Documents whose date cannot be read are taken too, and once."""
    documents = stored(event_documents(spark, d, undated=F.col("event_type") == "error"))
    store = sync.TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(documents.filter("ts < '2024-01-06'").select("source_file", "body"), 0, embed=False)
    landing = landed(spark, documents)
    for number in (1, 2):
        result = sync.run_update(store, landing, number, None, False, False)
    return store.tenders_plain().select("tender_id", "date_modified", F.lit(result["status"]).alias("last_status"))


@query
def run_update_rejects(spark, d):
    """Damaged documents of incremental runs end in the quarantine, once."""
    documents = stored(event_documents(spark, d, damaged=F.col("event_type") == "click"))
    store = sync.TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(documents.filter("ts < '2024-01-06'").select("source_file", "body"), 0, embed=False)
    landing = landed(spark, documents)
    for number in (1, 2):
        sync.run_update(store, landing, number, None, False, False)
    kept = store.tenders_plain().select(F.lit("ok").alias("outcome"), F.col("tender_id").alias("document"))
    bad = store.rejected().select(F.col("reject_reason").alias("outcome"), F.regexp_replace("source_file", "[.]json$", "").alias("document"))
    return kept.unionByName(bad)


@query
def run_status(spark, d):
    """The run log of a store that began without a baseline, was filled, and was up to date."""
    documents = stored(event_documents(spark, d, damaged=F.col("event_type") == "click").select("source_file", "body"))
    store = sync.TenderStore(spark, fresh_folder(spark, "store"))
    sync.run_update(store, documents, 1, None, False, False)
    store.apply(documents.unionByName(documents), 1, embed=False)
    sync.run_update(store, documents, 2, None, False, False)
    return store.run_log().select("batch_seq", "batch_id", "status", "n_tenders", "n_rejected", "n_items", "n_duplicates")


@query
def quality_report(spark, d):
    """Keys that a store holds twice, after two versions of each document: none; beside the number of its rows."""
    documents = stored(event_documents(spark, d).select("source_file", "body"))
    store = sync.TenderStore(spark, fresh_folder(spark, "store"))
    for number in (0, 1):
        store.apply(documents, number, embed=False)
    twice = store.quality_report().agg(F.count(F.lit(1)).alias("n_duplicate_keys"))
    return twice.withColumns({"n_tenders": F.lit(store.tender_table.count()), "n_items": F.lit(store.item_table.count())})


@query
def embed_all(spark, d):
    store = sync.TenderStore(spark, fresh_folder(spark, "store"))
    store.apply(event_documents(spark, d).select("source_file", "body"), 0, embed=False)
    store.embed_all()
    return store.vectors.read().select("id", (F.size("embedding") > 0).alias("has_vector"))


@query
def two_streams_one_table(spark, d):
    """Two streams with checkpoints of their own, both beginning at batch 0, fill one table."""
    work = fresh_folder(spark, "stream")
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    store = tables.MergedTable(spark, f"{work}/table", "event_id", rows.schema)
    for name, half in (("errors", rows.filter("event_type = 'error'")), ("others", rows.filter("event_type <> 'error'"))):
        half.write.json(f"{work}/{name}")
        sync.stream_versions(spark.readStream.schema(rows.schema).json(f"{work}/{name}"), store, f"{work}/checkpoint-{name}")
    return store.read()


@query
def line_stream_store(spark, d):
    """Files of one document per line stream into the store in several batches."""
    landing = fresh_folder(spark, "landing")
    raw.land_lines(raw_documents(spark, d), landing)
    store = sync.TenderStore(spark, fresh_folder(spark, "store"))
    sync.sync_stream(store, landing, fresh_folder(spark, "checkpoint"), lines=True, embed=False)
    rows = store.tenders().select("tender_id", "cpv_main", "awarded_amount", "price_deviation_pct")
    return rows.withColumn("price_deviation_pct", F.round("price_deviation_pct", 6))


@query
def touched_rows(spark, d):
    touched = table(spark, d, "labels").filter("quality = 1")
    return raw.touched_documents(table(spark, d, "documents"), touched, "doc_id")


@query
def missing_rows(spark, d):
    documents = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return raw.missing_documents(documents, table(spark, d, "lineitem"), "l_orderkey")


@query
def stream_ingest_events(spark, d):
    """Events arrive as JSON files in two waves; later versions of a key win."""
    landing, work = fresh_folder(spark, "landing"), fresh_folder(spark, "stream")
    columns = ["event_id", "ts", "event_type", "value"]
    first = table(spark, d, "events").select(*columns)
    kind = first.schema
    store = tables.MergedTable(spark, f"{work}/table", "event_id", kind, lambda rows: versions.latest_version(rows, ["event_id"], "ts", [], by_hash=True))
    late = first.filter("event_type = 'error'")
    newer = late.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "value": F.col("value") + 1})
    older = late.withColumns({"ts": F.col("ts") - F.expr("INTERVAL 1 DAY"), "value": F.lit(-1.0)})
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    for wave in (first.repartition(8), newer.unionByName(older).repartition(4)):
        wave.write.mode("append").options(**form).json(landing)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 8).options(**form).json(landing)
        sync.stream_versions(stream, store, f"{work}/checkpoint")
    return store.read()


# --- nested documents ----------------------------------------------------------------


@query
def json_flatten_tenders(spark, d):
    good = raw.good_documents(raw.parse_documents(raw_documents(spark, d)))
    return flatten.flatten_tenders(good)


@query
def json_flatten_items(spark, d):
    good = raw.good_documents(raw.parse_documents(raw_documents(spark, d)))
    return flatten.flatten_items(good, keep_position=True)


@query
def quarantine(spark, d):
    return raw.run_counters(raw.parse_documents(damaged_documents(spark, d)))


@query
def json_props(spark, d):
    e = table(spark, d, "events").withColumn("doc", F.try_parse_json("props"))
    return e.select(
        "event_id", vl.to_double(flatten.path("doc", "k")).alias("k"), flatten.path("doc", "k", "deeper").alias("deeper"),
        flatten.path("doc", "missing", default="none").alias("missing"),
    )


@query
def pick_last_active(spark, d):
    lines = latest_lines(spark, d)
    entry = lambda status, name: F.struct(status.alias("status"), name.alias("name"))
    entries = F.array(
        entry(F.col("l_returnflag"), F.lit("first")), entry(F.col("l_linestatus"), F.lit("second")), entry(F.lit("N"), F.lit("third"))
    )
    active = F.transform(entries, lambda e: F.struct(F.when(e["status"].isin("A", "O"), "active").otherwise("x").alias("status"), e["name"].alias("name")))
    picked = flatten.last_active(F.filter(active, lambda e: F.col("l_tax") > 0))
    return lines.select(*LINE_KEY, picked["name"].alias("picked"))


@query
def coerce_types(spark, d):
    messy = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("")).when(F.col("o_orderpriority") == "2-HIGH", F.lit("1_000"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("NaN")).when(F.col("o_orderpriority") == "5-LOW", F.lit("1e999")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    )
    when = F.when(F.col("o_orderstatus") == "P", F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+03:00'"))
    text = table(spark, d, "orders").select(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("tender_id"), messy.alias("awarded_amount"),
        when.alias("date_created"), F.col("o_custkey").cast("string").alias("n_bids"),
    )
    return flatten.coerce(text, TENDERS).select("tender_id", "awarded_amount", "date_created", "n_bids", "title")


# --- text ------------------------------------------------------------------------------


def _questions(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    w, text = QUESTION_WORDS, F.col("text")
    return c.select("conv_id", "turn", routing.route(
        text, routing.is_followup(text, w["followup"]), routing.investigation_kind(text, w["triggers"]),
        routing.question_path(text, w["leading"], w["qualitative"], w["quantitative"]),
    ).alias("route"))


@query
def route_questions(spark, d):
    return _questions(spark, d)


@query
def route_summary(spark, d):
    return routing.routing_report(_questions(spark, d))


@query
def route_questions_default(spark, d):
    """The default lists: each message asks, by its key, with an entry of one of them, or of two that compete, or of none."""
    c = table(spark, d, "conversations")
    entry = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("turn") % len(words) + 1).cast("int"))
    after = lambda *words: F.concat_ws(" ", "text", *words)
    quantity, triggers = entry(fixed.QUANTITATIVE_WORDS), fixed.INVESTIGATION_TRIGGERS
    asked = [
        after(entry(fixed.FOLLOWUP_MARKERS), quantity),
        *(after(entry(words), quantity) for words in triggers.values()),
        after(quantity),
        after(entry(fixed.QUALITATIVE_WORDS), quantity),
        F.concat(F.initcap(entry(fixed.QUALITATIVE_LEADING_WORDS)), after(quantity)),
        F.col("text"),
    ]
    question = F.element_at(F.array(*asked), (F.pmod(F.col("conv_id"), F.lit(len(asked))) + 1).cast("int"))
    return c.select("conv_id", "turn", "role", routing.route(question).alias("route"))


@query
def chunk_text(spark, d):
    c = table(spark, d, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    rows = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = ["Buyer: {c_name} ({n_name})", "Segment: {segment}", "Balance: {c_acctbal} {currency}"]
    return rows.select("c_custkey", tx.chunk_text(rows.schema, lines, {"currency": ""}).alias("chunk"))


@query
def metadata_json(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_orderdate").alias("created"), "o_orderpriority",
    )
    return o.select("o_orderkey", tx.metadata_json(o.schema).alias("metadata"))


@query
def split_documents(spark, d):
    return chunks.split_texts(table(spark, d, "documents").select("doc_id", "text"))


@query
def strip_links(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_links(F.col("html")).alias("plain"))


@query
def escape_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.escape_markdown(F.col("text")).alias("escaped"))


@query
def markdown_to_plain(spark, d):
    linked = F.concat(F.lit("["), F.col("lang"), F.lit("]("), F.col("source"), F.lit(") "), tx.escape_markdown(F.col("text")))
    return table(spark, d, "documents").select("doc_id", tx.links_to_plain(linked).alias("plain"))


@query
def link_known_ids(spark, d):
    a = answers(spark, d)
    return a.select("answer_id", tx.link_known_ids(F.col("text"), F.col("known_ids"), BASE_URL).alias("linked"))


@query
def evidence_backstop(spark, d):
    a = answers(spark, d)
    return a.select("answer_id", tx.with_evidence(F.col("text"), F.col("known_ids"), BASE_URL).alias("backed"))


@query
def ungrounded_numbers(spark, d):
    found = tx.ungrounded_measurements(F.col("text"), F.col("context"), r"(?iu)\d[\d\s.,]*\s*(?:кг|км)")
    return answers(spark, d).select("answer_id", F.array_join(found, "; ").alias("ungrounded"))


@query
def answer_audit(spark, d):
    audited = an.audit_answers(answers(spark, d), BASE_URL)
    return audited.withColumn("ungrounded", F.array_join("ungrounded", "; "))


@query
def money_and_date_format(spark, d):
    o = table(spark, d, "orders")
    now = F.lit("2002-01-01").cast("timestamp")
    return o.select(
        "o_orderkey", vl.money(F.col("o_totalprice")).alias("money"), vl.iso_day(F.col("o_orderdate")).alias("day"),
        vl.iso_instant(F.col("o_orderdate")).alias("instant"), vl.hours_between(F.col("o_orderdate"), now).alias("hours"),
    )


@query
def money_compact(spark, d):
    return table(spark, d, "orders").select("o_orderkey", vl.money_compact(F.col("o_totalprice") * 4).alias("compact"))


@query
def clean_parameters(spark, d):
    text = F.when(F.col("p_brand") == "Brand#1", F.lit(" none. ")).when(F.col("p_brand") == "Brand#2", F.lit("''")).otherwise(
        F.concat(F.lit("  \""), F.col("p_name"), F.lit(".\" "))
    )
    return table(spark, d, "part").select("p_partkey", vl.clean_parameter(text).alias("parameter"))


@query
def restrictive_specs(spark, d):
    signal = tx.restrictive_specification(F.col("text"), MODEL_PATTERNS, ["oder", "ouor"])
    return table(spark, d, "documents").select("doc_id", signal.alias("is_restrictive"))


# --- vectors -----------------------------------------------------------------------------


def _label_hits(spark, d, k):
    corpus = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return corpus, neighbours.nearest_neighbours(corpus, label_probes(spark, d), k)


@query
def vector_knn(spark, d):
    _, hits = _label_hits(spark, d, 5)
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def _fiftieths(spark, d):
    """All vectors, and those with an id divisible by 50 as queries that do not find themselves."""
    corpus = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return corpus, corpus.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


@query
def vector_knn_approx(spark, d):
    """Rows of the inverted file at its defaults; they may miss neighbours, so SQL cannot tell them and a test measures recall."""
    hits = inverted.approximate_neighbours(*_fiftieths(spark, d), 5, own_id=F.col("query_id"))
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query
def vector_knn_all_lists(spark, d):
    """The same search, by codes and then exactly, over all lists of the inverted file."""
    corpus, queries = _fiftieths(spark, d)
    index = inverted.build_index(corpus, 5)
    asked = stored(neighbours.query_rows(corpus, queries, "id", "embedding", "query_id", F.col("query_id")), "asked")
    hits = inverted.search(index, asked, 5, max(1, len(index.cells)), max(1, index.n_lists))
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query
def vector_gate(spark, d):
    _, hits = _label_hits(spark, d, 5)
    return neighbours.gate(hits, 0.65).withColumn("closest", F.round("closest", 6))


@query
def context_assembly(spark, d):
    _, hits = _label_hits(spark, d, 5)
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    return neighbours.context_per_query(neighbours.hit_rows(hits, documents), 0.75)


@query
def threshold_calibration(spark, d):
    corpus, hits = _label_hits(spark, d, 20)
    labelled = neighbours.hit_rows(hits, corpus.select("id", "label"))
    r = neighbours.threshold_calibration(labelled, F.col("label") == F.col("query_id"), [0.55, 0.6, 0.65, 0.7, 0.75])
    return r.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query
def distance_profile(spark, d):
    corpus, hits = _label_hits(spark, d, 20)
    r = neighbours.distance_profile(neighbours.hit_rows(hits, corpus.select("id", "label")), F.col("label") == F.col("query_id"))
    return r.withColumns({c: F.round(c, 6) for c in r.columns if c not in ("is_match", "n_hits")})


@query
def embed_documents(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    vectors = embedding.hashed(documents, dim=DIM)
    places = vectors.select("doc_id", F.posexplode("embedding").alias("place", "weight"))
    return places.filter("weight <> 0").withColumn("weight", F.col("weight").cast("double"))


@query
def role_prefixes(spark, d):
    """Passages and queries are embedded with the prefix of their role."""
    sides = [("passage", "documents", "doc_id", fixed.PASSAGE_PREFIX), ("query", "benchmark", "item_id", fixed.QUERY_PREFIX)]
    vectors = versions.union_by_name(
        *(embedding.hashed(table(spark, d, name).select(F.lit(role).alias("role"), F.col(key).alias("id"), "text"), dim=DIM, prefix=prefix) for role, name, key, prefix in sides)
    )
    places = vectors.select("role", "id", F.posexplode("embedding").alias("place", "weight"))
    return places.filter("weight <> 0").withColumn("weight", F.col("weight").cast("double"))


@query
def reembed_touched(spark, d):
    """Embed all documents, revise the toxic ones, embed only those again."""
    documents = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("tender_id"), "text", "lang")
    documents = documents.repartition("tender_id")
    labels = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("tender_id"))
    options = {"lines": ["{lang}: {text}"], "dim": DIM}
    store = tables.MergedTable(spark, fresh_folder(spark, "vectors"), "id", VECTORS)
    store.replace(embedding.vector_rows(documents, **options))
    revised = documents.withColumn("text", F.concat("text", F.lit(" revised")))
    rows = embedding.touched_vector_rows(revised, labels, **options)
    store.replace_keys(labels.select(F.col("tender_id").alias("id")), rows)
    places = F.size(F.filter("embedding", lambda x: x != 0)).alias("n_places")
    return store.read().select("id", F.md5("document").alias("document_md5"), places)


@query
def semantic_search(spark, d):
    documents = table(spark, d, "documents").repartition("doc_id")
    corpus = embedding.hashed(documents, dim=DIM).select(
        F.col("doc_id").alias("id"),
        "embedding",
        F.col("text").alias("document"),
        F.to_json(F.struct(F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("tender_number"), F.col("lang").alias("title"))).alias("metadata"),
    )
    queries = embedding.hashed(table(spark, d, "benchmark"), dim=DIM).select(F.col("item_id").alias("query_id"), "embedding")
    return neighbours.semantic_search(corpus, queries, BASE_URL, threshold=0.35).withColumn("closest", F.round("closest", 6))


# --- tables --------------------------------------------------------------------------------


@query
def table_schema(spark, d):
    described = {name: table(spark, d, name) for name in ALL_TABLES}
    columns = tables.describe_tables(spark, described).join(tables.row_counts(described), "table_name")
    return columns.withColumn("column_type", F.replace("column_type", F.lit("timestamp_ntz"), F.lit("timestamp")))


@query
def row_counts(spark, d):
    return tables.row_counts({name: table(spark, d, name) for name in ALL_TABLES})
