"""The New York Stock Exchange calendar by rule: sessions, early closes, trading-day arithmetic.

The table has one row per session (some 250 a year), so it is bounded by the years asked for and joins by broadcast.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NY = ZoneInfo("America/New_York")
#: Days on which the exchange was closed for other reasons than its holidays (fixed values).
CLOSED = [dt.date(2001, 9, d) for d in (11, 12, 13, 14)] + [dt.date(2004, 6, 11), dt.date(2007, 1, 2), dt.date(2012, 10, 29), dt.date(2012, 10, 30), dt.date(2018, 12, 5), dt.date(2025, 1, 9)]


def _easter(year: int) -> dt.date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday (Monday 0) of a month; -1 for the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return last - dt.timedelta(days=(last.weekday() - weekday) % 7)


def holidays(year: int) -> set[dt.date]:
    """Full-day closings; a Saturday holiday is kept on Friday (but New Year's never moves back), a Sunday one on Monday."""
    fixed = [dt.date(year, 7, 4), dt.date(year, 12, 25)] + ([dt.date(year, 6, 19)] if year >= 2022 else [])
    out = {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _easter(year) - dt.timedelta(days=2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)}
    for d in fixed:
        out.add(d + dt.timedelta(days={5: -1, 6: 1}.get(d.weekday(), 0)))
    new_year = dt.date(year, 1, 1)
    if new_year.weekday() != 5:
        out.add(new_year + dt.timedelta(days=1 if new_year.weekday() == 6 else 0))
    return out | {d for d in CLOSED if d.year == year}


def early_closes(year: int) -> set[dt.date]:
    """13:00 closes: before Independence Day, after Thanksgiving, on Christmas Eve."""
    third = dt.date(year, 7, 3)
    days = {_nth(year, 11, 3, 4) + dt.timedelta(days=1), dt.date(year, 12, 24)}
    if third.weekday() < 4:
        days.add(third)
    return {d for d in days if d.weekday() < 5 and d not in holidays(year)}


def sessions(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """``date, market_open, market_close`` (UTC) of each session from start to end."""
    rows = []
    day = start
    closed: dict[int, tuple[set, set]] = {}
    while day <= end:
        off, early = closed.setdefault(day.year, (holidays(day.year), early_closes(day.year)))
        if day.weekday() < 5 and day not in off:
            at = lambda h, m: dt.datetime(day.year, day.month, day.day, h, m, tzinfo=_NY).astimezone(dt.UTC)  # noqa: E731, B023
            rows.append((day, at(9, 30), at(13 if day in early else 16, 0)))
        day += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "date date, market_open timestamp, market_close timestamp")


def filter_session(bars: DataFrame, table: DataFrame, session: str = "regular", ts: str = "timestamp", date: str = "date") -> DataFrame:
    """Bars of the regular session (open <= ts < close), of extended hours (the rest; all of a day without session), or all."""
    if session == "all":
        return bars
    joined = bars.join(F.broadcast(table), date, "left")
    regular = F.coalesce((F.col(ts) >= F.col("market_open")) & (F.col(ts) < F.col("market_close")), F.lit(False))
    return joined.where(regular if session == "regular" else ~regular).select(*bars.columns)


def business_day_after(date: Column, days: int) -> Column:
    """The n-th weekday after a date (holidays not looked at)."""
    weekday = F.weekday(date)
    from_ = F.when(weekday == 5, F.date_sub(date, 1)).when(weekday == 6, F.date_sub(date, 2)).otherwise(date)
    w = F.least(weekday, F.lit(4))
    return F.date_add(from_, days + 2 * F.floor((w + days) / 5).cast("int"))


def shifted_sessions(table: DataFrame, lag: int) -> DataFrame:
    """``date, shifted``: the session ``lag`` sessions later (earlier if negative); null beyond the table."""
    from pyspark.sql import Window as W

    return table.select("date").withColumn("shifted", F.lead("date", lag).over(W.orderBy("date")) if lag >= 0 else F.lag("date", -lag).over(W.orderBy("date")))


def publication_dates(table: DataFrame, settlements: DataFrame, date: str = "settlement_date", days: int = 7) -> DataFrame:
    """Settlement dates with ``published_date``, the n-th session after the last one up to them.

    The calendar is spread to one row a day, bounded by its years and joined on the day itself; repeated rows stay. Days before the
    table, and those whose session lies beyond it, have no date.
    """
    from pyspark.sql import Window as W

    w = W.orderBy("date")
    sessions_ = table.select("date").distinct().select(F.col("date").alias("_d"), F.lead("date").over(w).alias("_next"), F.lead("date", days).over(w).alias("published_date"))
    each = sessions_.select(F.explode(F.sequence("_d", F.date_sub(F.coalesce("_next", F.date_add("_d", 1)), 1))).alias("_day"), "published_date")
    return settlements.join(F.broadcast(each), F.col("_day") == F.col(date), "left").select(*settlements.columns, "published_date")
