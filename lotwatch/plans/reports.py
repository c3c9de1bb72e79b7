"""The user-level reports, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch import fixed_values as fixed
from lotwatch.functions.text import contains_ci
from lotwatch.functions.values import exact_mean, exact_sum, hours_between, iso_day, iso_instant, money, ratio
from lotwatch.operators.evidence import evidence_rows, joined_evidence
from lotwatch.operators.filters import category_hedge, in_band, is_masked, not_masked, optional_contains, present
from lotwatch.operators.groups import exact_median, leave_one_out
from lotwatch.session import stored

MASKS = tuple(fixed.MASKED_SUPPLIERS)


def total(column: str) -> Column:
    """Sum of money in cents; the order of addition does not show."""
    return exact_sum(column)


def mean(column: str) -> Column:
    return F.try_divide(total(column), F.count(column))


def _top(df: DataFrame, order: Sequence[str], ties: Sequence[str], rows: int = fixed.REPORT_ROWS) -> DataFrame:
    """First rows by descending figures; names break ties so that the cut is repeatable."""
    keys = [F.col(c).desc_nulls_last() for c in order] + [F.col(c).asc_nulls_last() for c in ties]
    return df.orderBy(*keys).limit(rows)


PAIR = ["buyer_name", "supplier_name"]

# --- supplier and buyer reports ----------------------------------------------


def splitting_groups(
    tenders: DataFrame,
    buyer: str | None = None,
    low: float = fixed.SPLITTING_LOW,
    high: float = fixed.SPLITTING_HIGH,
    min_contracts: int = fixed.SPLITTING_MIN_CONTRACTS,
    masks: Sequence[str] = MASKS,
) -> tuple[DataFrame, DataFrame]:
    """Buyer and supplier pairs with several awards just below a threshold, one row per pair, and the ids behind them as a long table."""
    rows = tenders.filter(
        in_band("awarded_amount", low, high) & present("buyer_name", "supplier_name") & not_masked(masks=masks)
    )
    rows = optional_contains(rows, "buyer_name", buyer)
    groups = rows.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_contracts"),
        total("awarded_amount").alias("total_amount"),
        F.min("awarded_amount").alias("min_amount"),
        F.max("awarded_amount").alias("max_amount"),
    )
    ranked = _top(groups.filter(F.col("n_contracts") >= min_contracts), ["n_contracts", "total_amount"], PAIR)
    return ranked, evidence_rows(ranked, rows, PAIR)


def contract_splitting(tenders: DataFrame, buyer: str | None = None, **how) -> DataFrame:
    """``splitting_groups`` with the ids of each pair as one text."""
    return joined_evidence(*splitting_groups(tenders, buyer, **how), PAIR)


def concentration_groups(tenders: DataFrame, buyer: str, masks: Sequence[str] = MASKS) -> tuple[DataFrame, DataFrame]:
    """Who wins most at one buyer, with the share of the listed total, and the ids behind them as a long table."""
    rows = tenders.filter(contains_ci(F.col("buyer_name"), buyer) & not_masked(masks=masks))
    ranked = _leading_suppliers(rows)
    return ranked, evidence_rows(ranked, rows, ["supplier_name"])


def supplier_concentration(tenders: DataFrame, buyer: str, masks: Sequence[str] = MASKS) -> DataFrame:
    """``concentration_groups`` with the ids of each supplier as one text."""
    return joined_evidence(*concentration_groups(tenders, buyer, masks), ["supplier_name"])


def supplier_wins(rows: DataFrame) -> DataFrame:
    return rows.groupBy("supplier_name").agg(
        F.count(F.lit(1)).alias("n_wins"), total("awarded_amount").alias("total_amount")
    )


def _leading_suppliers(rows: DataFrame) -> DataFrame:
    """Top suppliers with their share of all suppliers' money; the rows are aggregated once."""
    wins = supplier_wins(rows)
    everything = wins.agg(total("total_amount")).scalar()
    ranked = _top(wins, ["n_wins", "total_amount"], ["supplier_name"])
    return ranked.withColumn("share_of_total", F.round(F.try_divide(F.col("total_amount"), everything), 6))


def supplier_ranking(tenders: DataFrame, masks: Sequence[str] = MASKS) -> DataFrame:
    """Market-wide wins per supplier; missing and masked suppliers are no parties."""
    return _leading_suppliers(tenders.filter(not_masked(masks=masks)))


def category_supplier_ranking(
    tenders: DataFrame, prefix: str | None, keyword: str, masks: Sequence[str] = MASKS
) -> DataFrame:
    """Supplier ranking within a category, the category taken by code, label or title."""
    return supplier_ranking(tenders.filter(category_hedge(prefix, keyword)), masks)


def repeat_suppliers(
    rows: DataFrame,
    result_id: str,
    supplier: str = "supplier_name",
    min_rows: int = 2,
    masks: Sequence[str] = MASKS,
) -> DataFrame:
    """Suppliers that occur several times within one result set."""
    return (
        rows.filter(not_masked(supplier, masks))
        .groupBy(result_id, supplier)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") >= min_rows)
    )


# --- price reports -----------------------------------------------------------


def item_statistics(items: DataFrame, item: str) -> DataFrame:
    """One row: mean, median, maximum and number of priced items that match a text."""
    matching = contains_ci(F.col("description"), item) & F.col("unit_amount").isNotNull()
    rows = stored(items.filter(matching).select("unit_amount"))
    figures = rows.agg(
        exact_mean("unit_amount").alias("avg_unit_amount"),
        F.max("unit_amount").alias("max_unit_amount"),
        F.count(F.lit(1)).alias("sample_size"),
    )
    middle = exact_median(rows, [], "unit_amount").select("median").scalar()
    return figures.withColumn("median_unit_amount", middle)


def item_overpricing(items: DataFrame, tenders: DataFrame, item: str) -> DataFrame:
    """The dearest instances of an item against the statistics of the same item.

    Every instance at the maximum is listed.  Items without a tender count in the
    statistics but are not listed.
    """
    wanted = contains_ci(F.col("description"), item) & F.col("unit_amount").isNotNull()
    matching = stored(items.filter(wanted).select("tender_id", "description", "unit_amount"))
    figures = matching.agg(
        F.struct(
            exact_mean("unit_amount").alias("avg"), F.max("unit_amount").alias("max"), F.count(F.lit(1)).alias("n")
        )
    ).scalar()
    median = exact_median(matching, [], "unit_amount").select("median").scalar()
    dearest = matching.filter(F.col("unit_amount") == figures["max"])
    return (
        dearest.join(tenders.select("tender_id", "tender_number"), "tender_id")
        .select(
            "tender_number",
            "description",
            "unit_amount",
            figures["avg"].alias("avg_unit_amount"),
            median.alias("median_unit_amount"),
            figures["n"].alias("sample_size"),
        )
        .withColumn("ratio_to_median", F.try_divide(F.col("unit_amount"), F.col("median_unit_amount")))
    )


def price_outliers(items: DataFrame, item: str, ratio_limit: float = fixed.PRICE_ANOMALY_RATIO) -> DataFrame:
    """Items priced above ``ratio_limit`` times the mean of the same narrow set."""
    matching = items.filter(contains_ci(F.col("description"), item))
    figures = matching.agg(
        F.struct(exact_mean("unit_amount").alias("avg"), F.count(F.lit(1)).alias("n"))
    ).scalar()
    above = matching.select(
        "tender_id",
        "item_id",
        "description",
        "unit_amount",
        figures["avg"].alias("avg_unit_amount"),
        figures["n"].alias("sample_size"),
    ).filter(F.col("unit_amount") > F.col("avg_unit_amount") * ratio_limit)
    return _top(above, ["unit_amount"], ["tender_id", "item_id"])


def small_sample(result: DataFrame, sample_size: str = "sample_size", floor: int = fixed.MIN_FAIR_SAMPLE_SIZE) -> DataFrame:
    """One row: the smallest comparison group of a result and whether it is too small."""
    smallest = F.min(F.col(sample_size).try_cast("double"))
    return result.agg(smallest.alias("min_sample_size")).withColumn(
        "is_small_sample", F.coalesce(F.col("min_sample_size") < floor, F.lit(False))
    )


# --- category reports --------------------------------------------------------


def category_totals(tenders: DataFrame, category: str = "cpv_main", amount: str = "awarded_amount") -> DataFrame:
    """Sum, mean and count per category at tender grain."""
    return tenders.groupBy(category).agg(
        total(amount).alias("total_amount"), mean(amount).alias("avg_amount"), F.count(F.lit(1)).alias("n_tenders")
    )


def total_with_item_condition(
    tenders: DataFrame,
    items: DataFrame,
    tender_condition: Column,
    item_condition: Column,
    amount: str = "awarded_amount",
    key: str = "tender_id",
) -> DataFrame:
    """Totals of the tenders that meet their own condition or own a matching item.

    Items only filter: matching ids are made distinct before they meet the
    tenders, so each tender counts once.
    """
    hits = items.filter(item_condition).select(key).distinct().withColumn("__hit", F.lit(True))
    chosen = tenders.join(hits, key, "left").filter(tender_condition | F.col("__hit").isNotNull())
    return chosen.agg(
        total(amount).alias("total_amount"), mean(amount).alias("avg_amount"), F.count(F.lit(1)).alias("n_tenders")
    )


def category_average_and_record(
    tenders: DataFrame, condition: Column, buyer: str = "buyer_name", amount: str = "awarded_amount", key: str = "tender_id"
) -> DataFrame:
    """One row: mean amount of a category beside its single largest payment."""
    rows = tenders.filter(condition)
    average = rows.agg(mean(amount)).scalar()
    return (
        rows.filter(F.col(amount).isNotNull())
        .orderBy(F.col(amount).desc(), F.col(key))
        .limit(1)
        .select(average.alias("average_amount"), F.col(buyer), F.col(amount).alias("max_single_payment"))
    )


def category_year_count(tenders: DataFrame, condition: Column, year: int, created: str = "date_created") -> DataFrame:
    """How many tenders of a category were created in a year?"""
    first, after = F.lit(f"{year}-01-01").cast("timestamp"), F.lit(f"{year + 1}-01-01").cast("timestamp")
    in_year = (F.col(created) >= first) & (F.col(created) < after)
    return tenders.filter(in_year & condition).agg(F.count(F.lit(1)).alias("n_tenders"))


# --- market and single-tender reports ------------------------------------------


def market_statistics(tenders: DataFrame, items: DataFrame) -> DataFrame:
    """One row: tenders, items, tenders with a known award, first and last day."""
    n_items = items.agg(F.count(F.lit(1))).scalar()
    return tenders.agg(
        F.count(F.lit(1)).alias("n_tenders"),
        F.count("awarded_amount").alias("n_awarded"),
        iso_day(F.min("date_created")).alias("first_day"),
        iso_day(F.max("date_created")).alias("last_day"),
    ).withColumn("n_items", n_items)


ANALYSIS_COLUMNS = [
    "tender_number", "title", "status", "buyer_name", "buyer_region", "supplier_name",
    "cpv_main", "cpv_description", "budget_amount", "budget_currency", "awarded_amount", "awarded_currency",
]


def tender_lookup(tenders: DataFrame, tender_number: str) -> DataFrame:
    return tenders.filter(F.col("tender_number") == F.lit(tender_number)).select(*ANALYSIS_COLUMNS)


def tender_analysis(
    tenders: DataFrame, tender_number: str, ratio_limit: float = fixed.PRICE_ANOMALY_RATIO, masks: Sequence[str] = MASKS
) -> DataFrame:
    """One tender against the mean of the other tenders of its category."""
    one = tender_lookup(tenders, tender_number)
    category = one.select("cpv_main").limit(1).scalar()
    others = tenders.filter((F.col("cpv_main") == category) & (F.col("tender_number") != F.lit(tender_number)))
    average = others.agg(mean("awarded_amount")).scalar()
    return (
        one.withColumn("category_avg", average)
        .withColumn("ratio", ratio(F.col("awarded_amount"), F.col("category_avg")))
        .withColumn("is_anomaly", F.coalesce(F.col("ratio") >= ratio_limit, F.lit(False)))
        .withColumn("supplier_masked", is_masked(masks=masks))
        .withColumn("awarded_text", money(F.col("awarded_amount")))
    )


def tender_analysis_all(
    tenders: DataFrame, ratio_limit: float = fixed.PRICE_ANOMALY_RATIO, masks: Sequence[str] = MASKS
) -> DataFrame:
    """The single-tender analysis for every tender at once."""
    return leave_one_out(tenders, ratio_limit=ratio_limit).withColumn("supplier_masked", is_masked(masks=masks))


# --- freshness -----------------------------------------------------------------


def resume_cursor(tenders: DataFrame, modified: str = "date_modified") -> DataFrame:
    """One row: the newest modification as ISO text, null when there is nothing."""
    return tenders.agg(iso_instant(F.max(modified)).alias("cursor"))


def staleness(
    tenders: DataFrame, now: Column, threshold_hours: float = fixed.STALE_AFTER_HOURS, modified: str = "date_modified"
) -> DataFrame:
    """One row: hours since the newest modification and whether that is too long."""
    newest = tenders.agg(F.max(modified).alias("newest"))
    hours = hours_between(F.col("newest"), now)
    return newest.select(
        hours.alias("hours_since_sync"), F.coalesce(hours > threshold_hours, F.lit(False)).alias("is_stale")
    )


# --- result handling -------------------------------------------------------------


def preview(result: DataFrame, rows: int = fixed.PREVIEW_ROWS) -> tuple[DataFrame, bool]:
    """The first rows of a result and whether there are more; the result is computed once."""
    first = result.take(rows + 1)
    return result.sparkSession.createDataFrame(first[:rows], result.schema), len(first) > rows


def names_no_party(result: DataFrame) -> bool:
    """A result with neither a supplier nor a buyer column cannot name one."""
    return not {"supplier_name", "buyer_name"} & set(result.columns)


def report_status(result: DataFrame | None) -> str:
    """``missing_parameter``, ``empty`` or ``ok``."""
    if result is None:
        return "missing_parameter"
    return "empty" if result.isEmpty() else "ok"


def investigate(kind: str, tenders: DataFrame, items: DataFrame, parameter: str | None = None) -> DataFrame | None:
    """The report of an investigation kind; null when it needs a parameter that is missing."""
    if kind == "splitting":
        return contract_splitting(tenders, parameter)
    if kind not in ("monopoly", "overpricing"):
        raise ValueError(f"unknown investigation kind: {kind!r}")
    if not parameter:
        return None
    if kind == "monopoly":
        return supplier_concentration(tenders, parameter)
    return item_overpricing(items, tenders, parameter)


def ad_hoc(spark: SparkSession, text: str, tenders: DataFrame, items: DataFrame, args: dict | None = None) -> DataFrame:
    """A query of the user's own over ``{tenders}`` and ``{items}``, values bound as ``:name``."""
    return spark.sql(text, args=args or {}, tenders=tenders, items=items)
