"""Study-level operators: example strategies, signal dates, walk-forward weights, books of whole shares, choice of a variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import mean_of
from ..functions.windows import zscore
from .asof import asof_join
from .costs import commission


def momentum_targets(bars: DataFrame, entry: int = 30, exit_: int = 385) -> DataFrame:
    """At ``entry`` minutes each security is held in the direction of its return since the previous close, until ``exit_``."""
    at = bars.where(F.col("minutes_from_open") == entry).select("date", "bar_end", "security_id", F.signum("ret_prev").alias("s")).where("s <> 0")
    n = F.count(F.lit(1)).over(W.partitionBy("date"))
    enter = at.select("date", "bar_end", "security_id", (F.col("s") / n).alias("weight"))
    leave = bars.where(F.col("minutes_from_open") == exit_).join(enter.select("date", "security_id"), ["date", "security_id"]).select("date", "bar_end", "security_id", F.lit(0.0).alias("weight"))
    return enter.unionByName(leave)


def overnight_targets(bars: DataFrame) -> DataFrame:
    """Long from the closing auction to the next opening auction."""
    ends = bars.groupBy("date", "security_id").agg(F.min("bar_end").alias("a"), F.max("bar_end").alias("b"))
    n = F.count(F.lit(1)).over(W.partitionBy("date"))
    out = ends.select("date", F.col("a").alias("bar_end"), "security_id", F.lit(0.0).alias("weight"), F.lit("open").alias("auction"))
    return out.unionByName(ends.select("date", F.col("b").alias("bar_end"), "security_id", (1.0 / n).alias("weight"), F.lit("close").alias("auction")))


def breakout_targets(bars: DataFrame) -> DataFrame:
    """The first break of the opening range of a day is followed to the close."""
    first = bars.where("or_break <> 0").withColumn("_n", F.row_number().over(W.partitionBy("date", "security_id").orderBy("bar"))).where("_n = 1")
    names = bars.groupBy("date").agg(F.countDistinct("security_id").alias("_k"))
    return first.join(F.broadcast(names), "date").select("date", "bar_end", "security_id", (F.col("or_break") / F.col("_k")).alias("weight"))


def reversal_targets(bars: DataFrame, every: int = 30, q: float = 0.2) -> DataFrame:
    """At regular times the losers since the open are bought and the winners sold, by ordinal rank."""
    at = bars.where((F.col("minutes_from_open") % every == 0) & F.col("ret_open").isNotNull() & ~F.col("stale"))
    w = W.partitionBy("date", "bar_end")
    p = (F.row_number().over(w.orderBy("ret_open", "security_id")) - 0.5) / F.count(F.lit(1)).over(w)
    leg = at.withColumn("_p", p).withColumn("_leg", F.when(F.col("_p") <= q, 1).when(F.col("_p") > 1 - q, -1)).where("_leg is not null")
    return leg.select("date", "bar_end", "security_id", (F.col("_leg") / F.count(F.lit(1)).over(W.partitionBy("date", "bar_end", "_leg"))).alias("weight"))


def signal_dates(days: DataFrame, when: str = "month_end", mid_day: int = 15) -> DataFrame:
    """The last trading day of each month, or the last one up to its middle."""
    d = days.select("date").distinct()
    if when == "mid_month":
        d = d.where(F.dayofmonth("date") <= mid_day)
    return d.groupBy(F.trunc("date", "month").alias("_m")).agg(F.max("date").alias("date")).select("date")


def walk_forward_weights(ics: DataFrame, months: int = 36, least: int = 24, shrink: float = 0.5) -> DataFrame:
    """Signal weights per date from coefficients known strictly before it: ``ics(date, next_date, signal, ic)``.

    max(0, mean / deviation) of the last ``months`` coefficients whose ``next_date`` is before the date, normalised, pulled to equal
    weights by ``shrink``; equal weights below ``least`` coefficients or where no signal has a positive ratio.
    """
    dates = ics.select("date").distinct()
    past = dates.join(ics.select(F.col("date").alias("_d"), "next_date", "signal", "ic"), F.col("next_date") < F.col("date"))
    rank = F.dense_rank().over(W.partitionBy("date").orderBy(F.desc("_d")))
    s = past.withColumn("_r", rank).where(F.col("_r") <= months).groupBy("date", "signal").agg(F.count("ic").alias("n"), F.avg("ic").alias("_m"), F.stddev_samp("ic").alias("_s"))
    score = F.when((F.col("n") >= least) & (F.col("_s") > 0), F.greatest(F.col("_m") / F.col("_s"), F.lit(0.0)))
    every = dates.crossJoin(F.broadcast(ics.select("signal").distinct()))  # months x a few signals
    j = every.join(s.select("date", "signal", score.alias("_v")), ["date", "signal"], "left")
    w = W.partitionBy("date")
    equal = 1.0 / F.count(F.lit(1)).over(w)
    total = F.sum(F.coalesce("_v", F.lit(0.0))).over(w)
    known = F.min(F.col("_v").isNotNull().cast("int")).over(w) == 1
    own = F.when(known & (total > 0), F.coalesce("_v", F.lit(0.0)) / total).otherwise(equal)
    return j.select("date", "signal", ((1 - shrink) * own + shrink * equal).alias("weight"))


def equal_groups(panel: DataFrame, groups: dict[str, list[str]], date: str = "date") -> DataFrame:
    """The mean of group scores, each the mean of its signals' z-scores (directions already applied)."""
    out = panel
    for g, names in groups.items():
        for n in names:
            out = out.withColumn(f"_z_{n}", zscore(F.col(n), [date]))
        out = out.withColumn(g, mean_of(*[F.col(f"_z_{n}") for n in names])).drop(*[f"_z_{n}" for n in names])
    return out.withColumn("score", mean_of(*[F.col(g) for g in groups]))


def weighted_signals(panel: DataFrame, signals: list[str], weights: DataFrame, key: str = "security_id") -> DataFrame:
    """``date, security_id, score``: signals in long form by their dated weights, over those available."""
    long = panel.select("date", key, *signals).unpivot(["date", key], signals, "signal", "z").where("z is not null")
    j = long.join(F.broadcast(weights), ["date", "signal"])
    return j.groupBy("date", key).agg(F.when(F.sum("weight") > 0, F.sum(F.col("z") * F.col("weight")) / F.sum("weight")).alias("score"))


def benchmark(panel: DataFrame, n: int) -> DataFrame:
    """The n largest companies of each date by capitalisation, weighted by it."""
    r = panel.withColumn("_n", F.row_number().over(W.partitionBy("date").orderBy(F.desc("issuer_market_cap"), "security_id"))).where(F.col("_n") <= n)
    return r.select("date", "security_id", (F.col("issuer_market_cap") / F.sum("issuer_market_cap").over(W.partitionBy("date"))).alias("weight"))


def round_to_shares(weights: DataFrame, prices: DataFrame, nav: DataFrame | float) -> DataFrame:
    """Whole-share books: shares = round(weight x NAV / price) with the last price within ten days; weights after rounding."""
    p = prices.select("security_id", F.col("date").alias("_d"), F.col("close_raw").alias("price"))
    j = asof_join(weights, p, "date", "_d", ["security_id"], tolerance=10)
    j = j.withColumn("nav", F.lit(float(nav))) if not isinstance(nav, DataFrame) else j.join(F.broadcast(nav.select("date", "nav")), "date", "left")
    j = j.withColumn("shares", F.round(F.col("weight") * F.col("nav") / F.col("price")).cast("long"))
    return j.withColumn("rounded", F.col("shares") * F.col("price") / F.col("nav"))


def book_commissions(book: DataFrame) -> DataFrame:
    """Commission per date of the changes between consecutive whole-share books."""
    dates = book.select("date").distinct().withColumn("_prev", F.lag("date").over(W.orderBy("date")))
    now = book.join(F.broadcast(dates), "date").select("date", "security_id", "shares", "price", "_prev")
    before = book.select(F.col("date").alias("_prev"), "security_id", F.col("shares").alias("_s"))
    kept = now.join(before, ["_prev", "security_id"], "left").select("date", (F.col("shares") - F.coalesce("_s", F.lit(0))).alias("d"), "price")
    nxt = F.broadcast(dates.select(F.col("date").alias("_next"), F.col("_prev").alias("date")).where("date is not null"))
    gone = book.join(nxt, "date").join(book.select(F.col("date").alias("_next"), "security_id"), ["_next", "security_id"], "left_anti").select(F.col("_next").alias("date"), (-F.col("shares")).alias("d"), "price")
    return kept.unionByName(gone).groupBy("date").agg(F.sum(commission(F.col("d"), F.col("price"))).alias("commission"), F.sum(F.abs(F.col("d") * F.col("price"))).alias("traded"))


def choose(results: list[dict], metric: str = "sharpe", worst_drawdown: float | None = None) -> dict:
    """The variant with the best development figure among those within the drawdown; ties go to the first name."""
    ok = [r for r in results if worst_drawdown is None or r["max_drawdown"] >= worst_drawdown] or results
    return sorted(ok, key=lambda r: (-r[metric], r["name"]))[0]
