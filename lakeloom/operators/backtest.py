"""Daily returns, portfolio weights, the backtest engine, forward returns and information coefficients.

The profit of all holdings in all periods is one job: each day is mapped to its rebalance period (an equi-join), growth since the trade is
a running product, and only one row per period enters the sequential recursion of NAV and drift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..functions.windows import average_rank, frame, rolling
from .asof import asof_join

ADV_WINDOW, VOL_WINDOW, SPREAD_WINDOW = 21, 63, 63
BREAK = 3.0
DELIST_LOSS = -0.30


def daily_returns(bars: DataFrame, calendar: DataFrame, key: str = "security_id") -> DataFrame:
    """``ret, close_raw, adv, vol, half_spread, break, delisted`` per security and day.

    ``bars(key, date, close, high, low, volume, split_factor, div_factor)`` are adjusted for splits. A return above +300% is a
    break and counts 0. A security whose bars stop before the calendar does gets one more row on the next trading day: -30% when its
    last raw close was under 1 or it lost half its price over 63 rows, else 0.
    """
    w = W.partitionBy(key).orderBy("date")
    b = bars.withColumn("_tr", F.col("close") * F.col("div_factor")).withColumn("_prev", F.lag("_tr").over(w))
    raw_ret = F.when(F.col("_prev") > 0, F.col("_tr") / F.col("_prev") - 1)
    b = b.withColumn("_raw", raw_ret).withColumn("break", F.coalesce(F.col("_raw") > BREAK, F.lit(False)))
    b = b.withColumn("ret", F.when(F.col("break"), 0.0).otherwise(F.col("_raw")))
    b = b.withColumn("close_raw", F.col("close") / F.col("split_factor")).withColumn("_dv", F.col("close") * F.col("volume"))
    c = F.when(F.col("close") > 0, F.ln("close"))
    eta = F.when((F.col("high") > 0) & (F.col("low") > 0), (F.ln("high") + F.ln("low")) / 2)
    b = b.withColumn("_c", c).withColumn("_eta", eta)
    b = b.withColumn("_ar", 4 * (F.lag("_c").over(w) - F.lag("_eta").over(w)) * (F.lag("_c").over(w) - F.col("_eta")))
    mean_ar = rolling(F.avg, F.col("_ar"), frame([key], ["date"], SPREAD_WINDOW), 20)
    b = b.withColumns({
        "adv": rolling(F.avg, F.col("_dv"), frame([key], ["date"], ADV_WINDOW), 1),
        "vol": rolling(F.stddev_samp, clip(F.col("ret"), -0.5, 0.5), frame([key], ["date"], VOL_WINDOW), 20),
        "half_spread": F.when(mean_ar.isNotNull(), F.sqrt(F.greatest(mean_ar, F.lit(0.0))) / 2),
        "_first": F.first("close").over(w),
        "_back": F.lag("close", 63).over(w),
        "_last": F.lead("date").over(w).isNull(),
    })
    columns = [key, "date", "ret", "close_raw", "adv", "vol", "half_spread", "break"]
    days = calendar.select("date").distinct()
    following = days.select(F.col("date").alias("_day"), F.lead("date").over(W.orderBy("date")).alias("_next"))
    tail = b.where("_last").join(F.broadcast(following), F.col("date") == F.col("_day")).where("_next is not null")
    fall = F.col("close") / F.coalesce("_back", "_first")
    loss = F.when((F.col("close_raw") < 1) | (fall <= 0.5), DELIST_LOSS).otherwise(0.0)
    extra = tail.select(key, F.col("_next").alias("date"), loss.alias("ret"), "close_raw", "adv", "vol", "half_spread", F.lit(False).alias("break"), F.lit(True).alias("delisted"))
    return b.select(*columns, F.lit(False).alias("delisted")).unionByName(extra)


def _leg_normalised(w: Column, keys: list[str]) -> Column:
    """Weights scaled to +1 (or -1) per date and leg."""
    side = W.partitionBy(*keys)
    return w / F.abs(F.sum(w).over(side))


def quantile_weights(scores: DataFrame, score: str = "score", q: float = 0.2, date: str = "date", key: str = "security_id", weight_by: str | None = None, sector: str | None = None, short: bool = True) -> DataFrame:
    """Long the top and short the bottom quantile by p = (ordinal rank - 0.5) / n, within sectors if named; +1 and -1 per leg."""
    group = [date] + ([sector] if sector else [])
    rows = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(score, key))
    rows = rows.withColumn("_p", (rank - 0.5) / F.count(F.lit(1)).over(W.partitionBy(*group)))
    leg = F.when(F.col("_p") > 1 - q, 1).when(F.col("_p") <= q, -1)
    rows = rows.withColumn("_leg", leg).where("_leg is not null" if short else "_leg = 1")
    base = F.col(weight_by) if weight_by else F.lit(1.0)
    rows = rows.withColumn("_w", base * F.col("_leg"))
    return rows.withColumn("weight", _leg_normalised(F.col("_w"), [date, "_leg"])).select(date, key, "weight")


def rank_weights(scores: DataFrame, score: str = "score", date: str = "date", key: str = "security_id", sector: str | None = None) -> DataFrame:
    """Weights proportional to the centred average rank, +1 and -1 per leg; names at the middle have none."""
    group = [date] + ([sector] if sector else [])
    rows = scores.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_r", average_rank(F.col(score), group))
    rows = rows.withColumn("_w", F.col("_r") - F.avg("_r").over(W.partitionBy(*group))).where("_w <> 0").withColumn("_leg", F.signum("_w"))
    return rows.withColumn("weight", _leg_normalised(F.col("_w"), [date, "_leg"])).select(date, key, "weight")


def top_n_weights(scores: DataFrame, n: int, score: str = "score", date: str = "date", key: str = "security_id") -> DataFrame:
    """Equal weights of the n highest scores of each date."""
    rows = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    rank = F.row_number().over(W.partitionBy(date).orderBy(F.col(score).desc(), key))
    rows = rows.withColumn("_n", rank).where(F.col("_n") <= n)
    return rows.select(date, key, (1.0 / F.count(F.lit(1)).over(W.partitionBy(date))).alias("weight"))


def cap_weights(weights: DataFrame, cap: float, date: str = "date", key: str = "security_id", rounds: int = 20) -> DataFrame:
    """No weight beyond the cap: what exceeds it goes to the rest of its leg in proportion, in at most ``rounds`` rounds.

    A leg (the names of one date and sign) is a bounded group; a leg too small for the cap becomes equal weights.
    """
    import numpy as np
    import pandas as pd

    def run(leg: pd.DataFrame) -> pd.DataFrame:
        w = leg["weight"].to_numpy(float)
        total = np.abs(w).sum()
        sign = np.sign(w.sum()) or 1.0
        a = np.abs(w)
        if cap * a.size <= total:
            a = np.full(a.size, total / a.size)
        else:
            for _ in range(rounds):
                over = a > cap + 1e-12
                if not over.any():
                    break
                spare = (a[over] - cap).sum()
                a[over] = cap
                free = a < cap - 1e-12
                a[free] += spare * a[free] / a[free].sum()
        return leg.assign(weight=sign * a)

    rows = weights.select(date, key, F.col("weight").cast("double").alias("weight"), F.signum("weight").alias("_leg"))
    return rows.groupBy(date, "_leg").applyInPandas(run, rows.schema).select(date, key, "weight")


def execution_dates(signals: DataFrame, calendar: DataFrame, lag: int = 1, date: str = "date") -> DataFrame:
    """``signal_date, date``: the trading day ``lag`` sessions after the last one at or before the signal."""
    days = calendar.select("date").distinct().withColumn("_n", F.row_number().over(W.orderBy("date")))
    at = asof_join(signals.select(F.col(date).alias("signal_date")).distinct(), days.withColumnRenamed("date", "_d"), "signal_date", "_d")
    return at.withColumn("_n", F.col("_n") + lag).join(F.broadcast(days), "_n").select("signal_date", "date")


def forward_returns(returns: DataFrame, dates: DataFrame, horizon: int, calendar: DataFrame, key: str = "security_id") -> DataFrame:
    """``date, security_id, fwd``: growth from each date over the next ``horizon`` trading days, reading the index as of both ends."""
    w = W.partitionBy(key).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    index = returns.select(key, "date", F.exp(F.sum(F.ln(F.greatest(1 + F.coalesce("ret", F.lit(0.0)), F.lit(1e-12)))).over(w)).alias("g"))
    days = calendar.select("date").distinct().withColumn("_end", F.lead("date", horizon).over(W.orderBy("date")))
    names = returns.select(key).distinct()
    grid = dates.select("date").distinct().join(F.broadcast(days), "date").where("_end is not null").join(names)
    start = asof_join(grid, index.withColumnRenamed("date", "_d").withColumnRenamed("g", "g0"), "date", "_d", [key], keep_key=False)
    end = asof_join(start, index.withColumnRenamed("date", "_d").withColumnRenamed("g", "g1"), "_end", "_d", [key])
    last = returns.groupBy(key).agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    alive = end.join(last, key).where((F.col("date") >= F.col("_from")) & (F.col("date") <= F.col("_to")))
    return alive.select("date", key, (F.col("g1") / F.col("g0") - 1).alias("fwd"))


def information_coefficients(panel: DataFrame, score: str, fwd: str = "fwd", date: str = "date", least: int = 50) -> DataFrame:
    """Spearman correlation of score and forward return per date with at least ``least`` names."""
    rows = panel.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    rows = rows.withColumn("_a", average_rank(F.col(score), [date])).withColumn("_b", average_rank(F.col(fwd), [date]))
    by_date = rows.groupBy(date).agg(F.count("*").alias("n"), F.covar_samp("_a", "_b").alias("_c"), F.stddev_samp("_a").alias("_sa"), F.stddev_samp("_b").alias("_sb"))
    ic = F.when((F.col("_sa") > 0) & (F.col("_sb") > 0), F.col("_c") / (F.col("_sa") * F.col("_sb")))
    return by_date.where(F.col("n") >= least).select(date, "n", ic.alias("ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean, deviation and t of the coefficients."""
    s = ics.agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.count("ic").alias("periods"))
    return s.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt("periods")))


def quantile_returns(panel: DataFrame, score: str, n: int = 5, fwd: str = "fwd", date: str = "date", key: str = "security_id") -> DataFrame:
    """Mean forward return per date and quantile floor((rank - 1) n / count) + 1."""
    rows = panel.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    rank = F.row_number().over(W.partitionBy(date).orderBy(score, key))
    rows = rows.withColumn("_r", rank).withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(date)))
    rows = rows.withColumn("quantile", F.expr(f"(_r - 1) * {n} div _c + 1"))
    return rows.groupBy(date, "quantile").agg(F.avg(fwd).alias("ret"), F.count("*").alias("names"))


def tradable(targets: DataFrame, returns: DataFrame, key: str = "security_id", tolerance: int = 10) -> DataFrame:
    """Targets whose security has a row within ``tolerance`` days, with its adv, vol and price."""
    market = returns.where("not delisted").select(key, "date", "adv", "vol", "close_raw", "half_spread")
    found = asof_join(targets, market.withColumnRenamed("date", "_d"), "date", "_d", [key], tolerance=tolerance)
    return found.where("close_raw is not null")


def rescale_legs(targets: DataFrame, before: DataFrame, date: str = "date") -> DataFrame:
    """The legs of each date scaled back to the gross they had before untradable names were dropped."""
    gross = before.groupBy(date, F.signum("weight").alias("_leg")).agg(F.sum("weight").alias("_want"))
    rows = targets.withColumn("_leg", F.signum("weight"))
    have = F.sum("weight").over(W.partitionBy(date, "_leg"))
    out = rows.withColumn("_have", have).join(gross, [date, "_leg"])
    return out.withColumn("weight", F.col("weight") * F.col("_want") / F.col("_have")).drop("_leg", "_want", "_have")


def run(targets: DataFrame, returns: DataFrame, cost_bps: Column | float = 0.0, borrow: Column | None = None, key: str = "security_id") -> tuple[DataFrame, DataFrame]:
    """The backtest: (daily: date, gross, borrow, cost, net, nav; trades: date, security_id, target, held, trade, cost).

    ``targets(date, key, weight)`` hold from the close of their date to the next rebalance. With G the growth since the trade,
    a day's P&L is target x (G - G of the day before) over the portfolio's value that day; costs are charged at the rebalance.
    """
    dates = [r[0] for r in targets.select("date").distinct().orderBy("date").collect()]  # one row per rebalance
    spark = targets.sparkSession
    if not dates:
        raise ValueError("no rebalance dates")
    periods = spark.createDataFrame([(i, d, dates[i + 1] if i + 1 < len(dates) else None) for i, d in enumerate(dates)], "period int, start date, stop date")
    days = returns.select("date").distinct()
    of_day = days.join(F.broadcast(periods), (F.col("date") > F.col("start")) & (F.col("stop").isNull() | (F.col("date") <= F.col("stop")))).select("date", "period", "start")
    held = targets.join(F.broadcast(periods.select("period", F.col("start").alias("date"))), "date").select("period", key, F.col("weight").alias("target"))
    rows = returns.select(key, "date", F.coalesce("ret", F.lit(0.0)).alias("ret")).join(F.broadcast(of_day), "date").join(held, ["period", key])
    # a position without a row on a day keeps its value; growth is the running product of its own rows
    w = W.partitionBy("period", key).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("g", F.exp(F.sum(F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-12)))).over(w)))
    rows = rows.withColumn("g0", F.coalesce(F.lag("g").over(W.partitionBy("period", key).orderBy("date")), F.lit(1.0)))
    rate = borrow if borrow is not None else F.lit(0.0)
    rows = rows.withColumn("pnl", F.col("target") * (F.col("g") - F.col("g0"))).withColumn("fee", F.when(F.col("target") < 0, -F.col("target") * F.col("g0") * rate / 252).otherwise(0.0))
    by_day = rows.groupBy("period", "date").agg(F.sum("pnl").alias("pnl"), F.sum("fee").alias("fee"))
    by_day = of_day.select("period", "date").join(by_day, ["period", "date"], "left").fillna(0.0, ["pnl", "fee"])
    value = F.lit(1.0) + F.sum(F.col("pnl") - F.col("fee")).over(W.partitionBy("period").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    by_day = by_day.withColumn("x", value).withColumn("x0", F.coalesce(F.lag("x").over(W.partitionBy("period").orderBy("date")), F.lit(1.0)))
    by_day = by_day.withColumn("gross", F.col("pnl") / F.col("x0")).withColumn("borrow", F.col("fee") / F.col("x0"))

    # drifted holdings at each rebalance against the new targets
    final = rows.groupBy("period", key).agg(F.max_by("g", "date").alias("g"), F.first("target").alias("target"))
    end_x = by_day.groupBy("period").agg(F.max_by("x", "date").alias("x_end"))
    drifted = final.join(end_x, "period").select((F.col("period") + 1).alias("period"), key, (F.col("target") * F.col("g") / F.col("x_end")).alias("held"))
    drifted = drifted.where(F.col("period") < len(dates))
    trades = held.join(drifted, ["period", key], "full").fillna(0.0, ["target", "held"]).withColumn("trade", F.col("target") - F.col("held"))
    rate_bps = cost_bps if isinstance(cost_bps, Column) else F.lit(float(cost_bps))
    trades = trades.withColumn("cost", F.abs("trade") * rate_bps / 1e4).join(F.broadcast(periods.select("period", F.col("start").alias("date"))), "period")
    at_start = trades.groupBy("period").agg(F.sum("cost").alias("cost"))
    first = F.row_number().over(W.partitionBy("period").orderBy("date")) == 1
    daily = by_day.join(at_start, "period", "left").withColumn("cost", F.when(first, F.coalesce("cost", F.lit(0.0))).otherwise(0.0))
    daily = daily.withColumn("net", (1 + F.col("gross") - F.col("borrow")) * (1 - F.col("cost")) - 1)
    # one row per trading day: the running product over all of them is small
    nav = F.exp(F.sum(F.ln(F.greatest(1 + F.col("net"), F.lit(1e-12)))).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    return daily.select("date", "gross", "borrow", "cost", "net").withColumn("nav", nav), trades.select("date", key, "target", "held", "trade", "cost")


def data_warnings(returns: DataFrame, held: DataFrame, key: str = "security_id", jump: float = 0.5) -> DataFrame:
    """Held securities on days with a break, a delisting or a return beyond ``jump``."""
    odd = returns.where(F.col("break") | F.col("delisted") | (F.abs("ret") > jump)).select(key, "date", "ret", "break", "delisted")
    return odd.join(held.select(key).distinct(), key, "left_semi")
