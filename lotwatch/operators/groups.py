"""Group statistics that stay exact and bounded when one group is huge.

Spark's own ``median`` keeps every distinct value of a group in one task.  Here
the middle values are found by counting: values fall into ordered cells, the
cell counts (a small table) tell which cell holds the middle, and only that cell
is looked at again.  All counting combines map-side, so no task ever holds a
group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch import fixed_values as fixed
from lotwatch.functions.values import exact_sum, ratio
from lotwatch.session import cut_lineage, stored

CELLS_PER_E_FOLD = 256.0
CELLS_PER_REFINEMENT = 4096.0
VALUES_PER_CELL = 1_000_000
HOT = 1000


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], size: str | None = None, needed: Column | None = None) -> DataFrame:
    """Give every row the statistics of its group.  Rows with a null key, or not ``needed``, get none.

    ``stats`` has one row per group, and ``size`` names its number of rows (if
    there is none, adaptive execution is left to split the large groups).  A
    group with more than one in ``HOT`` of all rows is hot; there cannot be more
    than ``HOT`` of them, so their statistics are broadcast.  Rows that are done
    or get nothing are dealt evenly in the join, the others by their key.
    """
    names = [c for c in stats.columns if c not in keys]
    if size is not None:
        # Looked at three times: for the sum of sizes, the hot groups, and the join.
        stats = stored(stats, "statistics")
    is_hot = F.lit(False) if size is None else F.col(size) * HOT > stats.agg(F.sum(size)).scalar()
    hot = stats.filter(is_hot).select(*keys, F.struct(*names).alias("__hot"))
    open_rows = F.col("__hot").isNull() & (F.lit(True) if needed is None else F.coalesce(needed, F.lit(False)))
    for key in keys:
        open_rows = open_rows & F.col(key).isNotNull()
    # A second key of the join: a function of the key where it has to meet its group, else a number that no group has.
    deal = F.when(open_rows, F.xxhash64(*keys)).otherwise(F.monotonically_increasing_id())
    rows = df.join(F.broadcast(hot), list(keys), "left").withColumn("__deal", deal)
    met = rows.join(stats.withColumn("__deal", F.xxhash64(*keys)), [*keys, "__deal"], "left")
    own = [c for c in df.columns if c not in keys]
    return met.select(*keys, *own, *(F.coalesce(F.col("__hot")[n], F.col(n)).alias(n) for n in names))


def _cell(value: Column) -> Column:
    """Order-preserving cell number: equal steps of the logarithm, mirrored below zero.

    The logarithm is monotone in floating point, so cells never overlap.
    Infinities have the outermost cells for themselves.
    """
    finite = F.abs(value) < F.lit(float("inf"))
    steps = F.when(finite, F.floor(F.ln(F.abs(value)) * CELLS_PER_E_FOLD) + 250_000).otherwise(F.lit(1_000_000))
    return F.when(value > 0, steps).when(value < 0, -steps).otherwise(F.lit(0).cast("bigint"))


def _narrow(inside: DataFrame, names: Sequence[str], step: Column, shares: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Cut the open cells of every group into steps and keep those with the wanted ranks.

    ``inside`` holds the values still in play with their ``cell``, the number of
    values of the group ``below`` that cell and the group's ``total``.  Returns
    the picked cells (at most two per group and share) and the values inside them.
    """
    stepped = inside.withColumn("step", step)
    counted = stepped.groupBy(*names, "cell", "below", "total", "step").agg(
        F.sum("weight").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    earlier = Window.partitionBy(*names, "cell").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    whole_group = Window.partitionBy(*names)
    placed = counted.withColumns(
        {
            "below": F.col("below") + F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "total": F.coalesce(F.col("total"), F.sum("n").over(whole_group)),
        }
    )
    wanted = F.lit(False)
    for share in shares:
        for rank in (_low_rank(share), _high_rank(share)):
            wanted = wanted | ((F.col("below") <= rank) & (F.col("below") + F.col("n") > rank))
    numbered = placed.filter(wanted).withColumn(
        "next_cell", F.row_number().over(Window.partitionBy(*names).orderBy("below")).cast("bigint")
    )
    picked = cut_lineage(numbered)
    kept = (
        stepped.drop("below", "total", "low", "high")
        .join(picked, [*names, "cell", "step"])
        .select(*names, "value", "weight", F.col("next_cell").alias("cell"), "below", "total", "low", "high")
    )
    return picked, kept


def _rank(share: float) -> Column:
    """Place of a share among the sorted values of a group, from zero, between two of them as a rule."""
    return (F.col("total") - 1) * F.lit(float(share))


def _low_rank(share: float) -> Column:
    return F.floor(_rank(share))


def _high_rank(share: float) -> Column:
    return F.ceil(_rank(share))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, values_per_cell: int = VALUES_PER_CELL, times: Column | None = None) -> DataFrame:
    """Exact interpolated median and count of the non-null values per group: the keys, ``median`` and ``n_values``."""
    return exact_quantiles(df, keys, value, {"median": 0.5}, values_per_cell, times)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], values_per_cell: int = VALUES_PER_CELL, times: Column | None = None
) -> DataFrame:
    """Exact interpolated quantiles and count of the non-null values per group.

    Columns: the keys, those of ``shares``, and ``n_values``.  All ranks are
    selected at once.  Groups with a null key are left out.  With no keys the
    whole frame is one group.  ``times`` says how often a row's value counts,
    once if not given.
    """
    names = [f"__k{i}" for i in range(len(keys) or 1)]
    sources = [F.col(k) for k in keys] or [F.lit(0)]
    rows = df.select(*(s.alias(n) for s, n in zip(sources, names)), F.col(value).cast("double").alias("value"), (F.lit(1) if times is None else times).cast("bigint").alias("weight"))
    # The values are cut again at every look.
    rows = stored(rows.filter(F.col("value").isNotNull() & ~F.isnan("value")), "values")
    present = F.lit(True)
    for name in names:
        present = present & F.col(name).isNotNull()
    inside = rows.filter(present).withColumns(
        {"cell": F.lit(0).cast("bigint"), "below": F.lit(0).cast("bigint"), "total": F.lit(None).cast("bigint")}
    )

    # First look: logarithmic cells.  Later looks: equal steps between the ends
    # of a picked cell, while one still holds more than a task should sort.
    parts = list(shares.values())
    picked, inside = _narrow(inside, names, _cell(F.col("value")), parts)
    share = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    step = F.when(F.col("high") > F.col("low"), F.floor(share * CELLS_PER_REFINEMENT)).otherwise(F.lit(0).cast("bigint"))
    while not picked.filter((F.col("high") > F.col("low")) & (F.col("n") > values_per_cell)).isEmpty():
        picked, inside = _narrow(inside, names, step, parts)

    # Last look: the distinct values of the picked cells with their counts.
    counted = inside.groupBy(*names, "cell", "below", "total", "value").agg(F.sum("weight").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*names, "cell").orderBy("value"))
    placed = counted.withColumn("upto", upto)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("value")))

    def quantile(share: float) -> Column:
        # Without the difference of two infinities.
        low, part = at(_low_rank(share)), F.max(_rank(share) - _low_rank(share))
        return F.when(part > 0, low * (1 - part) + at(_high_rank(share)) * part).otherwise(low)

    found = placed.groupBy(*names).agg(*(quantile(share).alias(name) for name, share in shares.items()), F.max("total").alias("n_values"))
    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), *shares, "n_values")


def category_statistics(df: DataFrame, category: str = "cpv_main", amount: str = "awarded_amount") -> DataFrame:
    """Median and number of known amounts per category, self included, nulls left out."""
    return exact_median(df, [category], amount).withColumnsRenamed(
        {"median": "category_median", "n_values": "category_n"}
    )


def amount_changes(before: DataFrame, after: DataFrame, category: str = "cpv_main", amount: str = "awarded_amount") -> DataFrame:
    """``category``, ``amount``, ``n``: how much more often a category has an amount after than before; what did not change is left out."""
    signed = lambda df, n: df.select(category, F.col(amount).cast("double").alias(amount), F.lit(n).cast("bigint").alias("n"))
    both = signed(before, -1).unionByName(signed(after, 1)).filter(F.col(category).isNotNull() & F.col(amount).isNotNull() & ~F.isnan(amount))
    return both.groupBy(category, amount).agg(F.sum("n").alias("n")).filter("n <> 0")


def statistics_of_changes(changes: DataFrame, category: str = "cpv_main", amount: str = "awarded_amount") -> DataFrame:
    """:func:`category_statistics` from all changes so far."""
    now = changes.groupBy(category, amount).agg(F.sum("n").alias("n")).filter("n > 0")
    return exact_median(now, [category], amount, times=F.col("n")).withColumnsRenamed({"median": "category_median", "n_values": "category_n"})


def with_deviation(
    df: DataFrame,
    statistics: DataFrame,
    category: str = "cpv_main",
    amount: str = "awarded_amount",
    result: str = "price_deviation_pct",
    min_n: int = 2,
) -> DataFrame:
    """Percentage deviation of each amount from its category's median."""
    joined = attach(df, statistics, [category], "category_n", F.col(amount).isNotNull())
    gap = F.try_divide(F.col(amount) - F.col("category_median"), F.col("category_median")) * 100
    return joined.withColumn(result, F.when(F.col("category_n") >= min_n, gap)).drop("category_median", "category_n")


def price_deviation(df: DataFrame, category: str = "cpv_main", amount: str = "awarded_amount") -> DataFrame:
    """All rows with the deviation from the median of their category, where comparable rows exist."""
    return with_deviation(df.drop("price_deviation_pct"), category_statistics(df, category, amount), category, amount)


def leave_one_out(
    df: DataFrame,
    category: str = "cpv_main",
    amount: str = "awarded_amount",
    ratio_limit: float = fixed.PRICE_ANOMALY_RATIO,
) -> DataFrame:
    """Mean amount of the other rows of the category, the ratio to it and the anomaly flag."""
    totals = (
        df.filter(F.col(category).isNotNull())
        .groupBy(category)
        .agg(exact_sum(amount).alias("__sum"), F.count(amount).alias("__n"), F.count(F.lit(1)).alias("__rows"))
    )
    own = F.coalesce(F.col(amount), F.lit(0.0))
    own_n = F.col(amount).isNotNull().cast("int")
    mean = F.try_divide(F.col("__sum") - own, F.col("__n") - own_n)
    return (
        attach(df, totals, [category], "__rows")
        .withColumn("category_avg", mean)
        .withColumn("ratio", ratio(F.col(amount), F.col("category_avg")))
        .withColumn("is_anomaly", F.coalesce(F.col("ratio") >= ratio_limit, F.lit(False)))
        .drop("__sum", "__n", "__rows")
    )
