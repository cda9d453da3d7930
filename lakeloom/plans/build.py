"""End-to-end builds: identity, fundamental series, market capitalisation, signal panels, portfolios, intraday studies."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import backtest, fundamentals, identity, marketcap, microstructure, risk, signals, simulate, xsection
from ..operators.asof import asof_join
from ..sources.store import Tables


# -- identity ------------------------------------------------------------------------------------------------------------


def build_identity(bars: DataFrame, records: DataFrame, splits: DataFrame, overrides: DataFrame | None = None, blocked: DataFrame | None = None, lookup: Callable[[DataFrame], DataFrame | None] | None = None, rounds: int = 3) -> dict[str, DataFrame]:
    """Master, securities and segments from bars and reference records.

    ``lookup`` is asked, for segments without any record, for more records (ticker, as_of, ids) until it has none or the rounds are over.
    """
    prices = bars.select("ticker", "date", "close")
    ratios = identity.split_ratios(splits)
    eps = identity.episodes(prices)
    segs = identity.segment_all(eps, records, prices, ratios)
    for _ in range(rounds if lookup else 0):
        unknown = segs.where("figi is null and share_class_figi is null and cik is null").select("ticker", "first", "last")
        more = lookup(unknown)
        if more is None or more.isEmpty():
            break
        records = records.unionByName(more, allowMissingColumns=True)
        segs = identity.segment_all(eps, records, prices, ratios)
    assigned = identity.assign_ids(segs, identity.link_candidates(segs, prices, overrides), blocked)
    end = F.lit(prices.agg(F.max("date")).first()[0])
    return {"segments": assigned, "master": identity.master_table(assigned, end), "securities": identity.securities_table(assigned).withColumn("active", F.col("last_trade") >= end)}


def identity_checks(built: dict[str, DataFrame], bars: DataFrame) -> DataFrame:
    """``check, bad``: overlapping windows, security days without an id, ids with two symbols on one day."""
    mapped = identity.map_to_security(bars.select("ticker", "date").distinct(), built["master"])
    two = mapped.where("security_id is not null").groupBy("security_id", "date").agg(F.countDistinct("ticker").alias("n")).where("n > 1")
    parts = {"overlapping windows": identity.overlaps(built["master"]), "days without id": mapped.where("security_id is null"), "two symbols a day": two}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), "bad")
        out = row if out is None else out.unionByName(row)
    return out


# -- fundamentals ---------------------------------------------------------------------------------------------------------


def build_all_series(facts: DataFrame, items: list[fundamentals.Item], policy: str = "first") -> DataFrame:
    """The series of all items in one table; each item reads only its tags."""
    out = None
    for item in items:
        s = fundamentals.build_series(facts, item, policy)
        out = s if out is None else out.unionByName(s)
    return out


def materialised_series(tables: Tables, facts: DataFrame, items: list[fundamentals.Item], version: int) -> DataFrame:
    """The stored series if they were built from this version of the facts, else built and stored anew."""
    stored = tables.read("series")
    if stored is not None and stored.agg(F.max("facts_version")).first()[0] == version:
        return stored.drop("facts_version")
    tables.replace("series", build_all_series(facts, items).withColumn("facts_version", F.lit(version).cast("long")), "item")
    return tables.read("series").drop("facts_version")


# -- market capitalisation ------------------------------------------------------------------------------------------------


def build_market_caps(bars: DataFrame, counts: DataFrame, splits: DataFrame, cik_map: DataFrame, links: DataFrame | None = None, basis: DataFrame | None = None, floats: DataFrame | None = None) -> DataFrame:
    """The daily panel: counts in today's units (with those of predecessors), capitalisation, screen, primary class, float."""
    events = marketcap.split_events(splits)
    now = marketcap.adjusted_counts(counts, events)
    if links is not None:
        chain = marketcap.lineage(links)
        old = marketcap.inherited_counts(counts, chain, events)
        late = marketcap.factor_after(old, events, "end", "split_after").withColumn("shares_now", F.col("shares") * F.col("split_after"))
        now = now.unionByName(late, allowMissingColumns=True)
    with_cik = marketcap.cik_on(bars, cik_map)
    panel = marketcap.year_panel(marketcap.screen(marketcap.daily(with_cik, now, basis)))
    return marketcap.add_float(panel, marketcap.float_table(floats, panel)) if floats is not None else panel


def market_cap_checks(panel: DataFrame, vendor: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """The share of companies within a tolerance of a vendor's capitalisation, and the worst of them."""
    last = panel.where("primary").groupBy("cik").agg(F.max_by("issuer_market_cap", "date").alias("own"))
    j = last.join(vendor.select("cik", "vendor_cap"), "cik").withColumn("off", F.abs(F.col("own") / F.col("vendor_cap") - 1))
    return j.agg(F.count("*").alias("companies"), F.avg((F.col("off") <= tolerance).cast("double")).alias("within"), F.max("off").alias("worst"))


# -- signal panels ---------------------------------------------------------------------------------------------------------


def signal_panel(dates: DataFrame, names: list[str], caps: DataFrame, bars: DataFrame | None = None, series: DataFrame | None = None, short_interest: DataFrame | None = None, market: DataFrame | None = None, top: int | None = None, transform: str | None = None, winsor: float = 0.0, neutral: bool = False) -> DataFrame:
    """The named signals (or groups) of the universe at dates: each source is read only if a signal needs it."""
    table = signals.catalogue()
    wanted = signals.resolve(names)
    sources = {table[n].source for n in wanted}
    panel = caps.join(F.broadcast(dates.select("date").distinct()), "date", "left_semi").where("primary")
    if top is not None:
        panel = marketcap.ranks(panel).where(F.col("rank") <= top)
    if {"fundamental", "growth"} & sources and series is not None:
        items = sorted({i for n in wanted for i in table[n].items})
        if items:
            points = panel.select("date", "cik").where("cik is not null").distinct()
            value = series.withColumn("value", F.coalesce("ttm", "value")).withColumn("available_from", F.coalesce("ttm_available_from", "available_from"))
            panel = panel.join(fundamentals.panel(points, value, items), ["date", "cik"], "left")
            growth = sorted({i for n in wanted if table[n].source == "growth" for i in table[n].items})
            if growth:
                panel = signals.add_lags(panel, growth)
    panel = signals.fundamental_signals(panel, [n for n in wanted if table[n].expr is not None])
    if "price" in sources and bars is not None and any(table[n].expr is None and table[n].source == "price" for n in wanted):
        panel = signals.price_signals(panel, bars, market)
    if "short" in sources and short_interest is not None:
        panel = signals.short_signals(panel, short_interest)
    have = [n for n in wanted if n in panel.columns]
    out = xsection.transform(panel, have, transform, winsor, sector="sector" if neutral else None, size="issuer_market_cap" if neutral else None) if transform or winsor or neutral else panel
    return out.select("date", "security_id", *[c for c in ("cik", "sector", "issuer_market_cap", "rank", "bucket") if c in out.columns], *have)


# -- portfolios -------------------------------------------------------------------------------------------------------------


def drifted(weights: DataFrame, returns: DataFrame, upto: Column, key: str = "security_id") -> DataFrame:
    """Weights after the returns of the days since their date up to another, over the portfolio's value then."""
    j = returns.select(key, F.col("date").alias("_d"), F.coalesce("ret", F.lit(0.0)).alias("ret")).join(weights, key).where((F.col("_d") > F.col("date")) & (F.col("_d") <= upto))
    grown = j.groupBy(key, "weight").agg(F.product(1 + F.col("ret")).alias("g"))
    all_ = weights.select(key, "weight").join(grown.select(key, "g"), key, "left").withColumn("v", F.col("weight") * F.coalesce("g", F.lit(1.0)))
    total = all_.agg(F.sum(F.col("v") - F.col("weight")).alias("gain"))
    return all_.crossJoin(F.broadcast(total)).select(key, (F.col("v") / (1 + F.col("gain"))).alias("held"))


def optimised_portfolio(panel: DataFrame, styles: list[str], cov: DataFrame, returns: DataFrame, limits: risk.Limits | None = None, key: str = "security_id", **solver) -> DataFrame:
    """Optimal weights date after date: each rebalance starts from the drifted holdings of the one before.

    A loop over rebalance dates (dozens to hundreds); each step is a job of its own and its weights (one cross-section) are written out.
    """
    from ..operators.graph import _written

    dates = [r[0] for r in panel.select("date").distinct().orderBy("date").collect()]
    out, before = None, None
    for d in dates:
        rows = panel.where(F.col("date") == F.lit(d))
        if before is not None:
            rows = rows.join(drifted(before, returns, F.lit(d), key), key, "left").fillna(0.0, ["held"])
        before = _written(risk.rebalance(rows, styles, cov, limits, key=key, **solver))
        out = before if out is None else out.unionByName(before)
    return out


def test_portfolios(exposures: DataFrame, n: int = 20, names: int = 50, key: str = "security_id") -> DataFrame:
    """Equal-weight portfolios of names picked by a seeded hash per date, for checks of the forecast risk."""
    grid = exposures.select("date", key).withColumn("portfolio", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rank = F.row_number().over(W.partitionBy("date", "portfolio").orderBy(F.xxhash64(key, "portfolio"), key))
    picked = grid.withColumn("_n", rank).where(F.col("_n") <= names)
    return picked.select("date", "portfolio", key, (1.0 / F.count(F.lit(1)).over(W.partitionBy("date", "portfolio"))).alias("weight"))


def factor_cov_table(factor_returns: DataFrame) -> DataFrame:
    """The long covariance (f1, f2, cov) of the newest date from all factor returns (days x some twenty factors)."""
    spark = factor_returns.sparkSession
    wide = factor_returns.groupBy("date").pivot("factor").agg(F.first("ret")).orderBy("date").toPandas().set_index("date").fillna(0.0)
    cov = risk.factor_cov(wide.to_numpy(float))
    names = list(wide.columns)
    return spark.createDataFrame([(a, b, float(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "f1 string, f2 string, cov double")


def borrow_rates(held: DataFrame, short_interest: DataFrame, model, key: str = "security_id") -> DataFrame:
    """Yearly borrow rates of held names by the short interest known within ten days."""
    j = asof_join(held, short_interest.select(key, F.col("date").alias("_d"), "si_pct_float"), "date", "_d", [key], tolerance=10)
    return j.withColumn("borrow_rate", model.borrow_rate(F.col("si_pct_float")))


def cost_warnings(trades: DataFrame, market: DataFrame, aum: float, key: str = "security_id", share: float = 0.1) -> DataFrame:
    """Trades above a share of the daily dollar volume, or without one."""
    j = asof_join(trades, market.select(key, F.col("date").alias("_d"), "adv"), "date", "_d", [key], tolerance=10)
    part = F.abs("trade") * aum / F.col("adv")
    return j.withColumn("participation", part).where(F.col("adv").isNull() | (part > share))


# -- intraday studies -------------------------------------------------------------------------------------------------------


def intraday_backtest(bars: DataFrame, aux: DataFrame, strategy: Callable[[pd.DataFrame], pd.DataFrame] | None = None, targets: DataFrame | None = None, half_spread_bps: float = 1.0, aum: float | None = None, **rules) -> dict[str, DataFrame]:
    """Targets (given, or of a strategy per day), fills, costs and the net daily series."""
    wanted = targets if targets is not None else simulate.run_strategy(bars, strategy)
    fills, daily = simulate.simulate(bars, wanted, aux, **rules)
    costed = simulate.intraday_costs(fills, half_spread_bps, aum=aum)
    cost = costed.groupBy("date").agg(F.sum(F.col("spread_cost") + F.col("impact_cost") + F.col("commission")).alias("cost"))
    net = daily.join(cost, "date", "left").fillna(0.0, ["cost"]).withColumn("net", (1 + F.col("gross")) * (1 - F.col("cost")) - 1)
    return {"targets": wanted, "fills": costed, "daily": net}


def measure_days(days: list[tuple[dt.date, int, int]], read: Callable[[dt.date], tuple[DataFrame, DataFrame]], tables: Tables) -> None:
    """Tick measures of days (date, open, close in nanoseconds), stored per day; days that are stored are skipped."""
    stored = {r["partition"] for r in tables.manifest().where("dataset = 'cost_daily'").collect()}
    for day, open_ns, close_ns in days:
        if str(day) in stored:
            continue
        trades, quotes = read(day)
        out = microstructure.measure_block(trades, quotes, open_ns, close_ns)
        for name in ("minute", "daily", "venue"):
            tables.replace(f"cost_{name}", out[name].withColumn("date", F.lit(day)), "date")


def forward_panel(scores: DataFrame, returns: DataFrame, calendar: DataFrame, horizon: int = 21) -> DataFrame:
    """Scores with the forward return of each date and name."""
    return scores.join(backtest.forward_returns(returns, scores.select("date"), horizon, calendar), ["date", "security_id"])


def bias_by_portfolio(portfolios: DataFrame, exposures_long: DataFrame, cov: DataFrame, spec: DataFrame, returns: DataFrame, key: str = "security_id") -> DataFrame:
    """The bias statistic of each test portfolio: realised daily returns over the forecast of its date."""
    out = None
    for p in [r[0] for r in portfolios.select("portfolio").distinct().collect()]:  # a few dozen
        w = portfolios.where(F.col("portfolio") == p).drop("portfolio")
        vol = risk.predict(w, exposures_long, cov, spec).select("date", (F.col("total_vol") / np.sqrt(252)).alias("vol"))
        held = asof_join(returns.select(key, "date", "ret"), w.withColumnRenamed("date", "_m"), "date", "_m", [key], strict=True, tolerance=31).where("weight is not null")
        daily = held.groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
        with_vol = asof_join(daily, vol.withColumnRenamed("date", "_v"), "date", "_v", strict=True).where("vol is not null")
        row = risk.bias_stat(with_vol).select(F.lit(p).alias("portfolio"), "bias")
        out = row if out is None else out.unionByName(row)
    return out
