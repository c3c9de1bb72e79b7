"""Latest version per key, last arrival per key, duplicate checks.

``row_number() = 1`` lets Spark put a group limit in front of the shuffle, so
each task sends at most one row per key: a key that holds a third of all rows
costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns that have one; decides between rows that are otherwise equal in rank."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not _unhashable(f.dataType.simpleString())]
    return F.xxhash64(*plain) if plain else F.lit(0)


def _unhashable(kind: str) -> bool:
    return "map<" in kind or "variant" in kind


def _first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], by_hash: bool) -> DataFrame:
    # The hash reads every column, so it is left out where the order is total without it.
    order = [*order, row_hash(df)] if by_hash else list(order) or [F.lit(0)]
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) == 1).drop(_RANK)


def latest_version(
    df: DataFrame,
    keys: Sequence[str] = ("tender_id",),
    modified: str = "date_modified",
    tie_breakers: Sequence[str] = ("source_file",),
    by_hash: bool = False,
) -> DataFrame:
    """One row per key: the most recently modified one.

    A row whose date is missing wins over dated rows.  Ties go to the highest
    tie breakers, in the order given, and with ``by_hash`` then by a hash of the
    row.  Null keys count as one key.
    """
    order = [F.col(modified).desc_nulls_first(), *(F.col(c).desc_nulls_last() for c in tie_breakers)]
    return _first_per_key(df, keys, order, by_hash)


def last_arrival(
    df: DataFrame,
    keys: Sequence[str] = ("tender_id", "item_id"),
    arrival: Sequence[str] = ("batch_seq", "source_file", "position"),
    by_hash: bool = False,
) -> DataFrame:
    """One row per key: the one that arrived last, whatever its dates; ``by_hash`` decides between equals."""
    return _first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in arrival], by_hash)


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group, numbered from one."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("tender_id",)) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column one side lacks is null there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_by_name(*frames).distinct()


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str] = ("tender_id",),
    modified: str = "date_modified",
    tie_breakers: Sequence[str] = ("batch_seq", "source_file"),
) -> DataFrame:
    """Merge new rows onto existing ones; an older version that comes late loses."""
    return latest_version(union_by_name(existing, incoming), keys, modified, tie_breakers)


def upsert_items(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str] = ("tender_id", "item_id"),
    arrival: Sequence[str] = ("batch_seq", "source_file", "position"),
    parent: str = "tender_id",
    replace_children: bool = False,
) -> DataFrame:
    """Merge items by arrival.

    Items that a newer tender version no longer lists stay, unless
    ``replace_children`` drops all earlier items of the tenders that came in.
    """
    if replace_children:
        touched = incoming.select(parent).distinct()
        existing = existing.join(touched, parent, "left_anti")
    return last_arrival(union_by_name(existing, incoming), keys, arrival)
