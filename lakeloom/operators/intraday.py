"""Intraday bars on a session clock: resampling, a filled grid, features, daily summaries.

Everything is partitioned by (security, date), so a market of any size is one job without day loops.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_freq(freq: str | int) -> int:
    """Minutes of a frequency such as 5, "5min", "1h": 1 to 390."""
    if isinstance(freq, int):
        n = freq
    else:
        m = re.fullmatch(r"\s*(\d+)\s*(m|min|minute|minutes|h|hour|hours)?\s*", freq)
        if not m:
            raise ValueError(f"not a frequency: {freq!r}")
        n = int(m[1]) * (60 if (m[2] or "m").startswith("h") else 1)
    if not 1 <= n <= 390:
        raise ValueError("a bar has 1 to 390 minutes")
    return n


def clock(sessions: DataFrame, minutes: int) -> DataFrame:
    """``date, bar, bar_start, bar_end, minutes_from_open``: bars anchored at the open, labelled by their end; the last may be short."""
    length = (F.unix_timestamp("market_close") - F.unix_timestamp("market_open")) / 60
    bars = F.explode(F.sequence(F.lit(0), (F.ceil(length / minutes) - 1).cast("int"))).alias("bar")
    out = sessions.select("date", "market_open", "market_close", bars)
    start = F.timestamp_seconds(F.unix_timestamp("market_open") + F.col("bar") * minutes * 60)
    end = F.least(F.timestamp_seconds(F.unix_timestamp("market_open") + (F.col("bar") + 1) * minutes * 60), F.col("market_close"))
    return out.select("date", "bar", start.alias("bar_start"), end.alias("bar_end"), ((F.unix_timestamp(end) - F.unix_timestamp("market_open")) / 60).cast("int").alias("minutes_from_open"))


def resample(minutes_bars: DataFrame, sessions: DataFrame, minutes: int, key: str = "security_id", ts: str = "timestamp") -> DataFrame:
    """Minute bars of the regular session to bars of ``minutes``: OHLCV, VWAP of typical prices, transactions, last trade time."""
    joined = minutes_bars.join(F.broadcast(sessions), "date").where((F.col(ts) >= F.col("market_open")) & (F.col(ts) < F.col("market_close")))
    bar = F.floor((F.unix_timestamp(ts) - F.unix_timestamp("market_open")) / (60 * minutes)).cast("int")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    aggs = [
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"), F.sum(typical * F.col("volume")).alias("_pv"), F.max(ts).alias("last_trade"),
    ]
    if "transactions" in minutes_bars.columns:
        aggs.append(F.sum("transactions").alias("transactions"))
    out = joined.groupBy("date", key, bar.alias("bar")).agg(*aggs)
    out = out.withColumn("vwap", F.when(F.col("volume") > 0, F.col("_pv") / F.col("volume"))).drop("_pv")
    return out.join(F.broadcast(clock(sessions, minutes).select("date", "bar", "bar_end", "minutes_from_open")), ["date", "bar"])


def grid(bars: DataFrame, sessions: DataFrame, minutes: int, key: str = "security_id") -> DataFrame:
    """Every bar of every day a security has one: prices carried within the day, volume 0, ``stale`` where nothing traded."""
    present = bars.select("date", key).distinct()
    full = present.join(F.broadcast(clock(sessions, minutes).select("date", "bar", "bar_end", "minutes_from_open")), "date")
    out = full.join(bars.drop("bar_end", "minutes_from_open"), ["date", key, "bar"], "left")
    w = W.partitionBy(key, "date").orderBy("bar").rowsBetween(W.unboundedPreceding, 0)
    last = F.last("close", ignorenulls=True).over(w)
    out = out.withColumn("stale", F.col("close").isNull()).withColumn("_c", last)
    filled = {c: F.coalesce(F.col(c), F.col("_c")) for c in ("open", "high", "low", "close")}
    filled["volume"] = F.coalesce(F.col("volume"), F.lit(0).cast(dict(bars.dtypes)["volume"]))
    if "transactions" in bars.columns:
        filled["transactions"] = F.coalesce("transactions", F.lit(0).cast(dict(bars.dtypes)["transactions"]))
    if "last_trade" in bars.columns:
        filled["last_trade"] = F.last("last_trade", ignorenulls=True).over(w)
    return out.withColumns(filled).drop("_c")


def features(bars: DataFrame, key: str = "security_id", or_minutes: int = 30, lookback: int = 20, min_obs: int | None = None) -> DataFrame:
    """ret_bar, ret_open, ret_prev, gap, vwap_dev, rvol, range_pos, or_high, or_low, or_break, vol_ratio on a grid.

    ``prev_close`` (the previous official close on today's basis) is read if the bars have it. Each value uses bars up to its own.
    """
    day = W.partitionBy(key, "date").orderBy("bar")
    upto = day.rowsBetween(W.unboundedPreceding, 0)
    out = bars if "prev_close" in bars.columns else bars.withColumn("prev_close", F.lit(None).cast("double"))
    out = out.withColumn("_first", F.first("open", ignorenulls=True).over(upto)).withColumn("_prior", F.lag("close").over(day))
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) - 1)
    out = out.withColumns({
        "ret_bar": F.when(F.col("_prior").isNull() & F.col("close").isNotNull(), F.when(F.col("open") > 0, F.col("close") / F.col("open") - 1)).otherwise(div("close", "_prior")),
        "ret_open": div("close", "_first"),
        "ret_prev": div("close", "prev_close"),
        "gap": div("_first", "prev_close"),
        "_pv": F.sum(F.coalesce("vwap", "close") * F.col("volume")).over(upto),
        "_v": F.sum("volume").over(upto),
        "_hi": F.max("high").over(upto),
        "_lo": F.min("low").over(upto),
    })
    r2 = F.pow(F.ln(1 + F.coalesce(F.when(F.col("ret_bar") > -1, F.col("ret_bar")), F.lit(0.0))), 2)
    inside = F.col("minutes_from_open") <= or_minutes
    known = F.col("minutes_from_open") >= or_minutes
    whole = W.partitionBy(key, "date")
    out = out.withColumns({
        "vwap_dev": F.when(F.col("_v") > 0, F.when(F.col("_pv") > 0, F.col("close") / (F.col("_pv") / F.col("_v")) - 1)),
        "rvol": F.when(F.col("close").isNotNull(), F.sqrt(F.sum(r2).over(upto))),
        "range_pos": F.when(F.col("_hi") > F.col("_lo"), (F.col("close") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))),
        "or_high": F.when(known, F.max(F.when(inside, F.col("high"))).over(whole)),
        "or_low": F.when(known, F.min(F.when(inside, F.col("low"))).over(whole)),
    })
    out = out.withColumn("or_break", F.when(F.col("close") > F.col("or_high"), 1).when(F.col("close") < F.col("or_low"), -1).when(F.col("or_high").isNotNull() & F.col("close").isNotNull(), 0))
    least = min_obs or min(lookback, max(5, lookback // 4))
    past = W.partitionBy(key, "bar").orderBy("date").rowsBetween(-lookback, -1)
    mean = F.when(F.count("_v").over(past) >= least, F.avg("_v").over(past))
    out = out.withColumn("_mean", mean).withColumn("vol_ratio", F.when(F.col("_mean") > 0, F.col("_v") / F.col("_mean")))
    return out.drop("_first", "_prior", "_pv", "_v", "_hi", "_lo", "_mean")


def daily_prices(daily: DataFrame, key: str = "security_id", factor: str = "factor") -> DataFrame:
    """Official prices with ``prev_close``: the previous adjusted close on today's basis (divided by today's factor)."""
    w = W.partitionBy(key).orderBy("date")
    adjusted = F.col("close") * F.col(factor) if factor in daily.columns else F.col("close")
    today = F.col(factor) if factor in daily.columns else F.lit(1.0)
    return daily.withColumn("prev_close", F.when(today > 0, F.lag(adjusted).over(w) / today))


def summarize(minute_bars: DataFrame, sessions: DataFrame, key: str = "security_id", ts: str = "timestamp") -> DataFrame:
    """One row per security and day: prices after 30 minutes, at noon and half an hour before the close, volumes, VWAP, 5-minute volatility."""
    joined = minute_bars.join(F.broadcast(sessions), "date").where((F.col(ts) >= F.col("market_open")) & (F.col(ts) < F.col("market_close")))
    since = (F.unix_timestamp(ts) - F.unix_timestamp("market_open")) / 60
    left = (F.unix_timestamp("market_close") - F.unix_timestamp(ts)) / 60
    rows = joined.withColumn("_m", since).withColumn("_left", left)
    last_before = lambda cond: F.max_by(F.when(cond, F.col("close")), F.when(cond, F.col(ts)))
    vol = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("volume"))), F.lit(0.0))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    day = rows.groupBy("date", key).agg(
        F.min_by("open", ts).alias("first_open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("last_close"),
        F.sum("volume").alias("volume"), F.count("*").alias("n_minutes"),
        F.when(F.sum("volume") > 0, F.sum(typical * F.col("volume")) / F.sum("volume")).alias("vwap"),
        last_before(F.col("_m") < 30).alias("price_30"), last_before(F.col("_m") < 150).alias("price_noon"), last_before(F.col("_left") > 30).alias("price_last30"),
        vol(F.col("_m") < 30).alias("volume_first30"), vol(F.col("_left") <= 30).alias("volume_last30"),
        F.min(ts).alias("first_trade"), F.max(ts).alias("last_trade"),
    )
    five = resample(minute_bars, sessions, 5, key, ts)
    w = W.partitionBy(key, "date").orderBy("bar")
    steps = five.withColumn("_r", F.ln(F.col("close") / F.lag("close").over(w)))
    rv = steps.groupBy("date", key).agg(F.sqrt(F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0))).alias("rv_5min"), F.count("_r").alias("n_returns"))
    out = day.join(rv, ["date", key], "left")
    return out.withColumn("ret_open_close", F.when(F.col("first_open") > 0, F.col("last_close") / F.col("first_open") - 1)).withColumn("range", F.when(F.col("low") > 0, F.col("high") / F.col("low") - 1))


def auctions(day_bars: DataFrame, summaries: DataFrame, key: str = "security_id") -> DataFrame:
    """The share of the day's volume outside continuous minutes (official less minute volume, not negative)."""
    joined = summaries.select("date", key, F.col("volume").alias("minute_volume")).join(day_bars.select("date", key, F.col("volume").alias("day_volume")), ["date", key])
    return joined.withColumn("auction_share", F.when(F.col("day_volume") > 0, F.greatest(F.lit(0.0), 1 - F.col("minute_volume") / F.col("day_volume"))))
