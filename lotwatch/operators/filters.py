"""Row filters of the procurement queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch import fixed_values as fixed
from lotwatch.functions.text import contains_any, contains_ci


def present(*columns: str) -> Column:
    """All of the columns have a value."""
    condition = F.col(columns[0]).isNotNull()
    for name in columns[1:]:
        condition = condition & F.col(name).isNotNull()
    return condition


def in_band(column: str, low: float, high: float) -> Column:
    """Inclusive at both ends."""
    return F.col(column).between(low, high)


def not_masked(column: str = "supplier_name", masks: Sequence[str] = tuple(fixed.MASKED_SUPPLIERS)) -> Column:
    """The party is named and its name is none of the masks.  Null names do not pass."""
    condition = F.col(column).isNotNull()
    for mask in masks:
        condition = condition & ~contains_ci(F.col(column), mask)
    return condition


def is_masked(column: str = "supplier_name", masks: Sequence[str] = tuple(fixed.MASKED_SUPPLIERS)) -> Column:
    """Null-safe flag for display: a missing name is not a masked one."""
    return F.coalesce(contains_any(F.col(column), masks), F.lit(False))


def optional_contains(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Filter by case-blind containment when a value is given, else leave the rows alone."""
    return df.filter(contains_ci(F.col(column), value)) if value else df


def cpv_prefix(prefix: str, column: str = "cpv_main") -> Column:
    return F.col(column).startswith(prefix)


def category_hedge(
    prefix: str | None,
    keyword: str,
    code: str = "cpv_main",
    label: str = "cpv_description",
    title: str = "title",
) -> Column:
    """Category by code prefix, or by official label, or by the buyer's own title."""
    condition = contains_ci(F.col(label), keyword) | contains_ci(F.col(title), keyword)
    return condition | cpv_prefix(prefix, code) if prefix else condition


def with_category(
    df: DataFrame, code: str = "cpv_main", categories: Mapping[str, str] = fixed.CPV_CATEGORIES, result: str = "category"
) -> DataFrame:
    """Name of the category by the first two digits of the code."""
    names = F.create_map(*(F.lit(x) for pair in categories.items() for x in pair))
    return df.withColumn(result, F.try_element_at(names, F.substring(code, 1, 2)))


def with_key_in(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Rows whose key is in a short list; an empty list gives no rows."""
    return df.filter(F.col(key).isin(list(values))) if values else df.filter(F.lit(False))


def relevant_documents(
    tenders: DataFrame,
    items: DataFrame,
    prefixes: Sequence[str] = tuple(fixed.RELEVANT_CPV_PREFIXES),
    keywords: Sequence[str] = tuple(fixed.RELEVANT_KEYWORDS),
    tender_id: str = "tender_id",
    title: str = "title",
    code: str = "cpv",
    description: str = "description",
) -> DataFrame:
    """Tenders with an item of a wanted code, or a wanted word in title or items.

    Item hits are reduced to distinct ids before they meet the tenders.  Missing
    codes, titles and descriptions simply do not match.
    """
    by_code = F.coalesce(F.col(code).rlike("^(?:" + "|".join(prefixes) + ")"), F.lit(False))
    by_word = F.coalesce(contains_any(F.col(description), keywords), F.lit(False))
    hits = items.filter(by_code | by_word).select(tender_id).distinct().withColumn("__hit", F.lit(True))
    by_title = F.coalesce(contains_any(F.col(title), keywords), F.lit(False))
    return tenders.join(hits, tender_id, "left").filter(F.col("__hit").isNotNull() | by_title).drop("__hit")
