"""Scalar helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source tags of gap-fill rows.
FILL_TAGS = ("ext_a_fill", "ext_b_fill", "synthetic_fill")


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x within [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def sign(x: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum(x)


def month_key(ms: Column) -> Column:
    """UTC month as ``yyyy-MM`` (the session's time zone is UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def date_start_ms(day: Column) -> Column:
    return F.unix_millis(day.cast("timestamp"))


def date_end_ms(day: Column) -> Column:
    """The first millisecond after an inclusive end date."""
    return F.unix_millis(F.date_add(day, 1).cast("timestamp"))


def is_fill(source: Column) -> Column:
    """Whether a source tag marks a gap-fill row; null is not."""
    return F.coalesce(F.lower(F.trim(source)).isin(*FILL_TAGS), F.lit(False))


def add_months(month: Column, n: Column | int) -> Column:
    """``yyyy-MM`` plus n months."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), n), "yyyy-MM")


def parse_utc(text: Column) -> Column:
    """ISO time; without an offset it is UTC; null where it can't be read."""
    return F.try_to_timestamp(text)


def finite_positive(x: Column) -> Column:
    """x > 0 and finite; NaN sorts above infinity, so the upper bound rejects it too. Null is false."""
    return F.coalesce((x > 0) & (x < F.lit(float("inf"))), F.lit(False))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def twelve_digits(x: Column) -> Column:
    """12 significant digits without trailing zeros."""
    text = F.format_string("%.12g", x)
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    return F.when(x == 0, "0").otherwise(plain)


def nonzero(x: Column) -> Column:
    """Null in place of zero."""
    return F.when(x != 0, x)
