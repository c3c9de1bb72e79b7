"""Lenient casts, dates, money and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwatch import fixed_values as fixed

# Spark's cast to double also takes forms such as "1.5d"; only plain decimal
# notation, with an optional exponent, counts as a number here.
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def once(value: Column) -> Column:
    """The value, not deterministic in name only: filters on it, inferred ones too, do not compute it again."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def to_double(text: Column) -> Column:
    """Number in a string, or null for missing, empty and unreadable text, and for numbers too large for a double."""
    # Only what is a number is cast: the cast of other text makes an exception a row.
    number = F.when(text.rlike(PLAIN_NUMBER), text).try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def exact_sum(amount: str | Column) -> Column:
    """Sum of money rounded to cents, the same in whatever order it is added up.

    Amounts are added as decimals of eight places.  Where one is too large for
    that (from 1e22 on), or the sum is, the sum of doubles is given.
    """
    number = F.col(amount) if isinstance(amount, str) else amount
    decimals = F.try_sum(number.try_cast("decimal(30,8)")).cast("double")
    fits = F.count(number.try_cast("decimal(30,8)")) == F.count(number)
    return F.round(F.when(fits, F.coalesce(decimals, F.sum(number))).otherwise(F.sum(number)), 2)


def exact_mean(amount: str | Column) -> Column:
    """Mean of known amounts, not rounded, the same in whatever order they are added up; see :func:`exact_sum`."""
    number = F.col(amount) if isinstance(amount, str) else amount
    decimals = number.try_cast("decimal(30,8)")
    fits = F.count(decimals) == F.count(number)
    exact = F.try_divide(F.try_sum(decimals).cast("double"), F.count(number))
    return F.when(fits, F.coalesce(exact, F.avg(number))).otherwise(F.avg(number))


def drop_nan(number: Column) -> Column:
    """A missing number is null, never NaN."""
    return F.when(~F.isnan(number), number)


def to_instant(text: Column) -> Column:
    """Timestamp in a string (offsets respected), or null when invalid."""
    return F.try_to_timestamp(text)


def to_count(text: Column) -> Column:
    """Nullable whole number in a string."""
    return to_double(text).try_cast("bigint")


def iso_instant(instant: Column) -> Column:
    """ISO-8601 text in UTC with microseconds."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def iso_day(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd")


def hours_between(earlier: Column, later: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(3_600_000_000.0)


def money(amount: Column, decimals: int = 2) -> Column:
    """``1234.5`` as ``1 234.50``."""
    return F.translate(F.format_number(amount, decimals), ",", " ")


def money_compact(amount: Column, suffix: str = fixed.MILLION_SUFFIX) -> Column:
    """Amounts from one million on as ``46.7 млн``, smaller ones whole and grouped."""
    in_millions = F.concat(F.format_number(amount / 1e6, 1), F.lit(suffix))
    return F.when(amount >= 1e6, F.translate(in_millions, ",", "")).otherwise(money(amount, 0))


def ratio(value: Column, base: Column) -> Column:
    """``value / base``, null where the base is missing or not positive."""
    return F.when(base > 0, value / base)


def fixed_number(number: Column, decimals: int = 2) -> Column:
    """Plain decimal text without an exponent, unlike a cast to string."""
    return F.translate(F.format_number(number, decimals), ",", "")


def clean_parameter(text: Column) -> Column:
    """Trim spaces, quotes and dots; empty text and the word NONE mean 'not given'."""
    bare = F.btrim(F.btrim(text), F.lit("\"'."))
    return F.when((bare != "") & (F.upper(bare) != "NONE"), bare)
