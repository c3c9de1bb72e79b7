"""The star-schema tables seen as procurement tables.

A line item stands for a tender with an award, an order for a tender of its own
grain, a part for what was bought.  Only the joins that the asked-for columns
need are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.operators.versions import latest_version

LINE_KEY = ["l_orderkey", "l_linenumber"]
VERSION_ORDER = ["l_partkey", "l_suppkey"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items, newest version of each (order, line)."""
    return latest_version(table(spark, folder, "lineitem"), LINE_KEY, "l_shipdate", VERSION_ORDER)


# Column of the tender view -> (expression, tables it needs besides the line items).
_VIEW: dict[str, tuple[Callable[[], Column], set[str]]] = {
    "tender_id": (lambda: F.col("l_orderkey").cast("string"), set()),
    "tender_number": (
        lambda: F.concat(F.lit("o-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")),
        set(),
    ),
    "awarded_amount": (lambda: F.col("l_extendedprice"), set()),
    "unit_amount": (lambda: F.col("l_extendedprice") / F.col("l_quantity"), set()),
    "date_modified": (lambda: F.col("l_shipdate"), set()),
    "supplier_name": (lambda: F.col("s_name"), {"supplier"}),
    "title": (lambda: F.col("p_name"), {"part"}),
    "cpv_main": (lambda: F.col("p_type"), {"part"}),
    "cpv_description": (lambda: F.col("p_brand"), {"part"}),
    "date_created": (lambda: F.col("o_orderdate"), {"orders"}),
    "buyer_name": (lambda: F.col("n_name"), {"orders", "customer", "nation"}),
}
_JOINS = [
    ("supplier", "l_suppkey", "s_suppkey"),
    ("part", "l_partkey", "p_partkey"),
    ("orders", "l_orderkey", "o_orderkey"),
    ("customer", "o_custkey", "c_custkey"),
    ("nation", "c_nationkey", "n_nationkey"),
]


def tender_view(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Tender-shaped rows, one per newest line item, with the named columns."""
    needed = set().union(*(_VIEW[c][1] for c in columns))
    rows = latest_lines(spark, folder)
    for name, left, right in _JOINS:
        if name in needed:
            rows = rows.join(table(spark, folder, name), F.col(left) == F.col(right))
    return rows.select(*(_VIEW[c][0]().alias(c) for c in columns))


def order_tenders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders at tender grain; category is the order priority."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("tender_id"),
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("tender_number"),
        F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("title"),
        F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("buyer_name"),
        F.lit(None).cast("string").alias("buyer_region"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Clerk "), F.col("o_orderstatus"))).alias("supplier_name"),
        F.col("o_orderpriority").alias("cpv_main"),
        F.col("o_orderpriority").alias("cpv_description"),
        F.col("o_totalprice").alias("budget_amount"),
        F.lit("UAH").alias("budget_currency"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("awarded_amount"),
        F.lit("UAH").alias("awarded_currency"),
        F.col("o_orderdate").alias("date_created"),
        F.col("o_orderdate").alias("date_modified"),
    )


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as items of their order, described by the part."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.col("l_orderkey").cast("string").alias("tender_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id"),
        F.col("p_name").alias("description"),
        F.col("p_type").alias("cpv"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_amount"),
        F.col("l_extendedprice").alias("line_total"),
    )


def record_number(date: str, key: str) -> Column:
    """An id of the record pattern, made from a date and a key."""
    number = F.lpad((F.col(key) % 1_000_000).cast("string"), 6, "0")
    return F.concat(F.lit("UA-"), F.date_format(date, "yyyy-MM-dd"), F.lit("-"), number, F.lit("-a"))


def raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One nested JSON document per newest line item, with the irregularities of real ones.

    Returned lines are wrapped in ``data``; contracts without tax have no amount;
    the second award's status varies; currencies may be empty; lines without
    discount have no item list.
    """
    iso = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    award = lambda status, amount, currency, supplier: F.struct(
        status.alias("status"),
        F.struct(amount.alias("amount"), currency.alias("currency")).alias("value"),
        F.array(F.struct(F.concat(F.lit("Supplier "), supplier.cast("string")).alias("name"),
                         F.struct(supplier.cast("string").alias("id")).alias("identifier"))).alias("suppliers"),
    )
    price = F.col("l_extendedprice")
    awards = F.array(
        award(F.lit("active"), price.cast("decimal(18,2)").cast("string"), F.lit("EUR"), F.col("l_suppkey")),
        award(
            F.when(F.col("l_linestatus") == "O", F.lit("active")).otherwise(F.lit("pending")),
            F.lit("n/a"), F.lit(""), F.col("l_suppkey") + 1,
        ),
    )
    contract = F.struct(
        F.lit("pending").alias("status"),
        F.struct(
            F.when(F.col("l_tax") > 0, price).alias("amount"),
            F.when(F.col("l_returnflag") == "A", F.lit("USD")).otherwise(F.lit("")).alias("currency"),
        ).alias("value"),
    )
    item = lambda suffix, unit: F.struct(
        F.concat(F.col("l_linenumber").cast("string"), F.lit(suffix)).alias("id"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("description"),
        F.col("l_quantity").cast("bigint").cast("string").alias("quantity"),
        F.struct(F.col("l_returnflag").alias("id"), F.col("l_linestatus").alias("description")).alias("classification"),
        F.struct(F.lit("piece").alias("name"), F.struct(unit.alias("amount"), F.lit("UAH").alias("currency")).alias("value")).alias("unit"),
        F.struct(iso.alias("endDate")).alias("deliveryDate"),
    )
    items = F.when(
        F.col("l_discount") > 0, F.array(item("a", F.col("l_extendedprice")), item("b", F.lit(None).cast("double")))
    )
    document = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.concat(F.lit("o-"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("tenderID"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("title"),
        F.col("l_linestatus").alias("status"),
        iso.alias("dateModified"),
        F.when(F.col("l_returnflag") == "N", F.lit("soon")).otherwise(iso).alias("dateCreated"),
        F.struct(price.alias("amount"), F.lit("UAH").alias("currency"), (F.col("l_tax") > 0).alias("valueAddedTaxIncluded")).alias("value"),
        F.struct(
            F.concat(F.lit("Buyer "), F.col("l_returnflag")).alias("name"),
            F.struct(F.lit("Kyiv").alias("region")).alias("address"),
        ).alias("procuringEntity"),
        awards.alias("awards"),
        F.array(contract).alias("contracts"),
        items.alias("items"),
    )
    bare = F.to_json(document)
    body = F.when(F.col("l_returnflag") == "R", F.concat(F.lit('{"data":'), bare, F.lit("}"))).otherwise(bare)
    name = F.concat(F.concat_ws("-", "l_orderkey", "l_linenumber"), F.lit(".json"))
    return latest_lines(spark, folder).select(name.alias("source_file"), body.alias("body"), "l_discount", "l_tax", "l_linestatus")


def damaged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents, some of them damaged in one of four ways."""
    rows = raw_documents(spark, folder)
    broken = (
        F.when(F.col("l_discount") == 0, F.substring("body", 1, 20))
        .when(F.col("l_tax") == 0, F.concat(F.lit("["), F.col("body"), F.lit("]")))
        .when(F.col("l_discount") == 0.1, F.lit('{"title":"no id"}'))
        .when(F.col("l_tax") == 0.08, F.lit('{"id":"x","value":"much"}'))
        .otherwise(F.col("body"))
    )
    return rows.select("source_file", broken.alias("body"))


def event_documents(spark: SparkSession, folder: str, undated=None, damaged=None) -> DataFrame:
    """A small document per event, dated to the day so that very many share a date; some without a date or broken off."""
    e = table(spark, folder, "events")
    no, name = F.lit(False), F.col("event_id").cast("string")
    day = F.when(undated if undated is not None else no, F.lit("unknown")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'00:00:00'+00:00'"))
    item = F.struct(F.lit("1").alias("id"), F.struct(F.col("event_type").alias("id")).alias("classification"))
    body = F.to_json(F.struct(name.alias("id"), F.concat(F.lit("e-"), name).alias("tenderID"), F.col("event_type").alias("title"), day.alias("dateModified"), F.array(item).alias("items")))
    broken = F.when(damaged if damaged is not None else no, F.substring(body, 1, 12)).otherwise(body)
    return e.select(F.concat(name, F.lit(".json")).alias("source_file"), broken.alias("body"), "ts")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Written answers made from orders; the evidence of some is known, of others not."""
    # As many parts as there are cores: the texts are short, and what is done with them is not.
    o = table(spark, folder, "orders").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    own = record_number("o_orderdate", "o_orderkey")
    text = F.concat(
        F.lit("Order_"), F.col("o_orderkey").cast("string"), F.lit(" *won* "),
        F.when(F.col("o_orderstatus") != "P", own).otherwise(F.lit("no id")),
        F.lit(", вага "), F.col("o_custkey").cast("string"), F.lit(" кг, [site](https://example.org/x) and www.example.com/y "),
        F.lit("15 км."),
    )
    context = F.concat(
        F.lit("маса "), F.col("o_custkey").cast("string"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" тонн")).otherwise(F.lit(" кг")),
    )
    known = F.when(F.col("o_orderstatus") != "O", F.array(own, F.concat(F.lit("A"), F.col("o_custkey").cast("string")))).otherwise(
        F.array().cast("array<string>")
    )
    return o.select(
        F.col("o_orderkey").alias("answer_id"), text.alias("text"), context.alias("context"), known.alias("known_ids"),
        (F.col("o_custkey") % 5).alias("sample_size"),
    )


def label_probes(spark: SparkSession, folder: str) -> DataFrame:
    """One probe per label: the mean of its vectors."""
    parts = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    means = parts.groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # As many entries per label as the vectors have dimensions.
    ordered = F.array_sort(F.collect_list(F.struct("place", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["x"]).alias("embedding")).select(
        F.col("label").cast("bigint").alias("query_id"), "embedding"
    )
