"""Evidence ids of a result: long form, joined and paged text, id sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence_ids(result: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct ids in a result that has ``tender_number`` or comma-joined ``tender_numbers``."""
    parts = []
    if "tender_numbers" in result.columns:
        parts.append(result.select(*keep, F.explode(F.split("tender_numbers", ",")).alias("tender_number")))
    if "tender_number" in result.columns:
        parts.append(result.select(*keep, F.col("tender_number").cast("string")))
    if not parts:
        return result.select(*keep, F.lit("").alias("tender_number")).limit(0)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("tender_number", F.trim("tender_number"))
    return rows.filter(F.col("tender_number") != "").distinct()


def evidence_rows(ranked: DataFrame, rows: DataFrame, keys: Sequence[str], number: str = "tender_number") -> DataFrame:
    """Long table of the keys of each ranked group and every different id behind it.

    ``ranked`` has a bounded number of rows (a top-k report) and is therefore
    broadcast.  No task or row holds a group.
    """
    return rows.filter(F.col(number).isNotNull()).select(*keys, number).join(F.broadcast(ranked.select(*keys)), list(keys)).distinct()


def joined_evidence(ranked: DataFrame, evidence: DataFrame, keys: Sequence[str], number: str = "tender_number") -> DataFrame:
    """Formatter: ``ranked`` with the sorted, comma-joined ids of each group, one row per group at every size.

    A group's text is one value, so a caller with groups of many millions of
    ids takes the long table itself.  ``evidence_page`` is always 0.
    """
    texts = evidence.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(number)), ", ").alias("tender_numbers"))
    return F.broadcast(ranked).join(texts, list(keys), "left").select(
        *ranked.columns, F.lit(0).cast("long").alias("evidence_page"), F.coalesce("tender_numbers", F.lit("")).alias("tender_numbers")
    )


def with_evidence_pages(
    ranked: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    size: str,
    number: str = "tender_number",
    *,
    ids_per_page: int,
) -> DataFrame:
    """Formatter in pages of a size that the caller gives: the figures of a group are repeated on each of its rows.

    ``ranked`` has a bounded number of rows (a top-k report) and is therefore
    broadcast.  A group of at most ``ids_per_page`` rows comes out as one row.
    A larger one continues on further rows, numbered by ``evidence_page``, so
    that every id appears once and no task or row has to hold them all.
    """
    spread = F.pmod(F.xxhash64(F.col(number)), F.ceil(F.col(size) / ids_per_page))
    return (
        rows.select(*keys, number)
        .join(F.broadcast(ranked), list(keys))
        .groupBy(*ranked.columns, spread.alias("evidence_page"))
        .agg(F.array_join(F.array_sort(F.collect_set(number)), ", ").alias("tender_numbers"))
    )
