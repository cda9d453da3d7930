"""Null-safe arithmetic and date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where the denominator is not positive or anything is missing."""
    return F.when(den > 0, num / den)


def zero(x: Column) -> Column:
    """A missing value counted as nothing."""
    return F.coalesce(x, F.lit(0.0))


def clip(x: Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    """x within lo..hi; null stays null."""
    out = x
    if lo is not None:
        out = F.when(out < lo, lo).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, hi).otherwise(out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def mean_of(*xs: Column) -> Column:
    """The mean of the values that are not null."""
    total, n = F.lit(0.0), F.lit(0)
    for x in xs:
        total, n = total + F.coalesce(x, F.lit(0.0)), n + F.when(x.isNotNull(), 1).otherwise(0)
    return F.when(n > 0, total / n)


def month_index(date: Column) -> Column:
    """Months since year 0, for joins on calendar months."""
    return F.year(date) * 12 + F.month(date)


def pad_cik(x: Column) -> Column:
    """A company number as ten digits."""
    return F.lpad(x.cast("string"), 10, "0")


def eastern_date(ts: Column) -> Column:
    """The trading date in New York of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))


def from_nanos(ns: Column) -> Column:
    """A timestamp (microseconds) of an epoch in nanoseconds."""
    return F.timestamp_micros(F.floor(ns / 1000).cast("long"))
