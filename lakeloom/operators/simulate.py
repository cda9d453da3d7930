"""The intraday simulator: targets become orders, orders fill bar by bar under participation caps, auctions, carry and costs.

A strategy that is flat overnight is simulated day by day in parallel (one bounded group per date); one that holds overnight runs
over its days in order inside one group per portfolio.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..functions.windows import frame, rolling
from .asof import asof_join

ADV_WINDOW, VOL_WINDOW = 21, 63


def market_inputs(daily: DataFrame, key: str = "security_id") -> DataFrame:
    """``adv, vol, prev_close`` known before each day: rolling figures shifted by one row."""
    w = W.partitionBy(key).orderBy("date")
    d = daily.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1).withColumn("_dv", F.col("close") * F.col("volume"))
    d = d.withColumn("_adv", F.avg("_dv").over(frame([key], ["date"], ADV_WINDOW))).withColumn("_vol", rolling(F.stddev_samp, clip(F.col("_r"), -0.5, 0.5), frame([key], ["date"], VOL_WINDOW), 20))
    return d.select(*daily.columns, F.lag("_adv").over(w).alias("adv"), F.lag("_vol").over(w).alias("vol"), F.lag("close").over(w).alias("prev_close"))


def run_strategy(bars: DataFrame, strategy: Callable[[pd.DataFrame], pd.DataFrame], date: str = "date", key: str = "security_id") -> DataFrame:
    """A user function (a day's bars -> targets: bar_end, security_id, weight, auction) applied to every day."""
    kind = dict(bars.dtypes)[key]

    def one(day: pd.DataFrame) -> pd.DataFrame:
        out = strategy(day.sort_values(["bar_end", key]))
        if "auction" not in out:
            out = out.assign(auction=None)
        return out.assign(date=day[date].iloc[0])[["date", "bar_end", key, "weight", "auction"]]

    return bars.groupBy(date).applyInPandas(one, f"date date, bar_end timestamp, {key} {kind}, weight double, auction string")


FILL_COLUMNS = ["date", "security_id", "bar_end", "order_end", "kind", "trade", "price", "wait"]


def simulate_day(bars: pd.DataFrame, targets: pd.DataFrame, aux: pd.DataFrame, start: dict, lag: int = 1, price: str = "vwap", participation: float | None = None, aum: float | None = None, flat_by: str | None = None) -> tuple[list[tuple], dict, float]:
    """Fills of one day, positions after it (dollar values over the NAV at the open) and its gross return.

    A set of targets (one ``bar_end``) replaces the book that was wanted before. An order is active from the bar ``lag`` after its
    signal; it fills at the bar's vwap (or open or close; the close where missing), never on a stale bar, and with ``aum`` and
    ``participation`` at most that share of the bar's volume; the rest waits. ``auction`` "open" and "close" orders fill at the
    official prices; targets on the last bar or later go to the closing auction. ``flat_by="close"`` ends the day without positions.
    """
    ends = sorted(bars["bar_end"].unique())
    by = {k: g.set_index("bar_end") for k, g in bars.groupby("security_id")}
    info = aux.set_index("security_id").to_dict("index")
    book = dict(start)  # security -> value at the last mark
    marks = {k: info.get(k, {}).get("prev_close") for k in book}
    pnl, fills, wanted = 0.0, [], {}

    def mark(k, p: float) -> None:
        nonlocal pnl
        old = marks.get(k)
        if k in book and old and p and p == p:
            pnl += book[k] * (p / old - 1)
            book[k] *= p / old
        if p and p == p:
            marks[k] = p

    def fill(k, trade: float, p: float, end, order_end, kind: str, wait: int, day) -> None:
        mark(k, p)
        book[k] = book.get(k, 0.0) + trade
        if abs(book[k]) < 1e-12:
            book.pop(k)
        fills.append((day, k, end, order_end, kind, float(trade), float(p), wait))

    day = bars["date"].iloc[0] if len(bars) else None
    groups = [(e, g) for e, g in targets.groupby("bar_end", sort=True)] if len(targets) else []
    opening = [(e, g[g["auction"] == "open"]) for e, g in groups]
    for e, g in opening:
        for k, w in zip(g["security_id"], g["weight"], strict=True):
            p = info.get(k, {}).get("open")
            if p and p == p:
                mark(k, p)
                fill(k, w - book.get(k, 0.0), p, ends[0], e, "open", 0, day)
    closing: dict = {}
    position = {e: i for i, e in enumerate(ends)}
    for e, g in groups:
        at_close = g[(g["auction"] == "close") | ((g["auction"].isna()) & (g["bar_end"] >= ends[-1]))]
        for k, w in zip(at_close["security_id"], at_close["weight"], strict=True):
            closing[k] = (w, e)
    active: dict = {}
    for i, end in enumerate(ends):
        for e, g in groups:
            cont = g[g["auction"].isna() & (g["bar_end"] < ends[-1])]
            if len(cont) and e in position and position[e] + lag == i:
                new = dict(zip(cont["security_id"], cont["weight"], strict=True))
                active = {k: (w, e, i) for k, w in new.items()}
                for k in book:
                    active.setdefault(k, (0.0, e, i))
        for k in sorted(set(active) | set(book), key=str):
            row = by.get(k)
            if row is None or end not in row.index:
                continue
            r = row.loc[end]
            if k in active and not bool(r["stale"]):
                w, e, since = active[k]
                p = r[price] if price in r and r[price] == r[price] and r[price] else r["close"]
                mark(k, p)
                trade = w - book.get(k, 0.0)
                room = abs(trade) if participation is None or aum is None else participation * r["volume"] * p / aum
                part = np.sign(trade) * min(abs(trade), room)
                if abs(part) > 1e-12:
                    fill(k, part, p, end, e, "bar", i - since, day)
                if abs(trade - part) <= 1e-12:
                    active.pop(k)
            mark(k, r["close"])
    for k in sorted(set(book) | set(closing), key=str):
        p = info.get(k, {}).get("close") or marks.get(k)
        mark(k, p)
        want = closing.get(k, (0.0, ends[-1]) if flat_by == "close" else None)
        if want is not None and p:
            trade = want[0] - book.get(k, 0.0)
            if abs(trade) > 1e-12:
                fill(k, trade, p, ends[-1], want[1], "close", 0, day)
    wanted.clear()
    return fills, {k: v for k, v in book.items()}, pnl


def simulate(bars: DataFrame, targets: DataFrame, aux: DataFrame, overnight: bool = False, **rules) -> tuple[DataFrame, DataFrame]:
    """(fills, daily: date, gross, positions) over all days. Without ``overnight`` each day starts and ends flat, in parallel."""
    key = dict(bars.dtypes)["security_id"]
    schema = f"what string, date date, security_id {key}, bar_end timestamp, order_end timestamp, kind string, trade double, price double, wait int, gross double, positions int"
    columns = ["what", *FILL_COLUMNS, "gross", "positions"]

    def days(b: pd.DataFrame, t: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        rows, book = [], {}
        for d in sorted(b["date"].unique()):
            fills, book, pnl = simulate_day(b[b["date"] == d], t[t["date"] == d], a[a["date"] == d], book if overnight else {}, flat_by=rules.get("flat_by", None if overnight else "close"), **{k: v for k, v in rules.items() if k != "flat_by"})
            rows += [("fill", *f, None, None) for f in fills]
            rows.append(("day", d, None, None, None, None, None, None, None, pnl, len(book)))
            if overnight:
                book = {k: v / (1 + pnl) for k, v in book.items()}
        return pd.DataFrame(rows, columns=columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = days(pdf[pdf["_k"] == "b"], pdf[pdf["_k"] == "t"], pdf[pdf["_k"] == "a"])
        out["wait"], out["positions"] = out["wait"].astype("Int32"), out["positions"].astype("Int32")
        return out

    both = (
        bars.withColumn("_k", F.lit("b")).unionByName(targets.withColumn("_k", F.lit("t")), allowMissingColumns=True).unionByName(aux.withColumn("_k", F.lit("a")), allowMissingColumns=True)
    )
    both = both.withColumn("_g", F.lit("all") if overnight else F.col("date").cast("string"))
    out = both.groupBy("_g").applyInPandas(lambda pdf: run(pdf), schema)
    return out.where("what = 'fill'").select(*FILL_COLUMNS), out.where("what = 'day'").select("date", "gross", "positions")


def intraday_costs(fills: DataFrame, half_spread_bps: Column | float, vol: Column | None = None, adv: Column | None = None, aum: float | None = None, impact: float = 1.0, per_share: float = 0.0035, minimum: float = 0.35, time_of_day: dict[str, float] | None = None) -> DataFrame:
    """Fills with ``spread_cost, impact_cost, commission`` (shares of NAV). Impact and the commission's minimum count once per order."""
    order = W.partitionBy("date", "security_id", "order_end")
    traded = F.abs("trade")
    bps = half_spread_bps if isinstance(half_spread_bps, Column) else F.lit(float(half_spread_bps))
    multiple = F.lit(1.0)
    for kind, m in (time_of_day or {}).items():
        multiple = F.when(F.col("kind") == kind, m).otherwise(multiple)
    out = fills.withColumn("spread_cost", F.when(F.col("kind") == "bar", traded * bps / 1e4 * multiple).otherwise(0.0))
    if aum is None:
        return out.withColumn("impact_cost", F.lit(0.0)).withColumn("commission", F.lit(0.0))
    total = F.sum(traded).over(order)
    if vol is not None and adv is not None:
        out = out.withColumn("impact_cost", traded * impact * F.coalesce(vol, F.lit(0.03)) * F.sqrt(total * aum / adv))
    else:
        out = out.withColumn("impact_cost", F.lit(0.0))
    dollars = total * aum
    fee = F.greatest(F.sum(traded * aum / F.col("price")).over(order) * per_share, F.lit(minimum))
    return out.withColumn("commission", traded * F.when(dollars > 0, fee / dollars).otherwise(0.0))


def borrow_costs(daily_short: DataFrame, short_interest: DataFrame, rate: float = 0.0025, hard: float = 0.03, threshold: float = 0.2, key: str = "security_id") -> DataFrame:
    """Overnight shorts with their daily borrow by the short interest known within 35 days."""
    s = short_interest.select(key, F.col("date").alias("_d"), "si_pct_float")
    j = asof_join(daily_short, s, "date", "_d", [key], tolerance=35)
    return j.withColumn("borrow", F.abs("weight") * F.when(F.col("si_pct_float") > threshold, hard).otherwise(rate) / 252)


def by_time_of_day(fills: DataFrame) -> DataFrame:
    return fills.groupBy(F.date_format("bar_end", "HH:mm").alias("time"), "kind").agg(F.count("*").alias("fills"), F.sum(F.abs("trade")).alias("turnover"))


def round_trips(fills: DataFrame) -> DataFrame:
    """Per day and security: what was bought and sold, at which average prices, and the gain on what was closed."""
    side = lambda s: F.sum(F.when(F.signum("trade") == s, F.abs("trade") / F.col("price")))
    value = lambda s: F.sum(F.when(F.signum("trade") == s, F.abs("trade")))
    g = fills.groupBy("date", "security_id").agg(side(1).alias("bought"), side(-1).alias("sold"), value(1).alias("_bv"), value(-1).alias("_sv"))
    return g.select("date", "security_id", "bought", "sold", (F.col("_bv") / F.col("bought")).alias("buy_price"), (F.col("_sv") / F.col("sold")).alias("sell_price"), (F.least("bought", "sold") * (F.col("_sv") / F.col("sold") - F.col("_bv") / F.col("bought"))).alias("gain"))


def fill_stats(fills: DataFrame) -> DataFrame:
    return fills.groupBy("kind").agg(F.count("*").alias("fills"), F.sum(F.abs("trade")).alias("turnover"), F.avg("wait").alias("mean_wait"), F.max("wait").alias("max_wait"))


def check_lookahead(run: Callable[[DataFrame], DataFrame], rows: DataFrame, cut: Column, columns: list[str]) -> DataFrame:
    """Results up to the cut that change when the input after it is removed; must be empty. ``cut`` is a condition on both."""
    return run(rows).where(cut).select(*columns).exceptAll(run(rows.where(cut)).where(cut).select(*columns))
