import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import adjust, analytics, backtest, calendar, costs, signals, xsection
from lakeloom.operators.asof import asof_join, validity_join

D = dt.date


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_asof_variants_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5), (None, 5), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 1, None, 1), ("a", 5, "x", 1), ("a", 5, "y", 2), ("a", 8, "z", 1), (None, 1, "n", 1)], "k string, rt int, v string, o int")
    get = lambda **kw: {(r.k, r.t): r.v for r in asof_join(left, right, "t", "rt", ["k"], tie=["o"], **kw).collect()}
    assert get() == {("a", 1): None, ("a", 5): "y", ("a", 9): "z", ("b", 5): None, (None, 5): None, ("a", None): None}
    assert get(strict=True)[("a", 5)] is None and get(strict=True)[("a", 9)] == "z"
    assert get(strategy="forward")[("a", 5)] == "x" and get(strategy="forward")[("a", 9)] is None
    assert get(strategy="forward", strict=True)[("a", 5)] == "z"
    assert get(strategy="nearest")[("a", 9)] == "z" and get(tolerance=0)[("a", 9)] is None
    with pytest.raises(ValueError):
        asof_join(left, right, "t", "rt", ["k"], strategy="sideways")


def test_validity_window(spark):
    w = spark.createDataFrame([("T", "A", D(2020, 1, 1), D(2020, 6, 30)), ("T", "B", D(2020, 8, 1), None)], "ticker string, id string, valid_from date, valid_to date")
    d = spark.createDataFrame([("T", D(2019, 12, 31)), ("T", D(2020, 6, 30)), ("T", D(2020, 7, 5)), ("T", D(2021, 1, 1))], "ticker string, date date")
    assert [r.id for r in validity_join(d, w, "date", ["ticker"]).orderBy("date").collect()] == [None, "A", None, "B"]
    assert [r.id for r in validity_join(d, w, "date", ["ticker"], grace=7).orderBy("date").collect()] == [None, "A", "A", "B"]


def test_split_and_dividend_adjustment(spark):
    days = [D(2020, 8, 27), D(2020, 8, 28), D(2020, 8, 31), D(2020, 9, 1)]
    bars = spark.createDataFrame([("AAPL", d, c, 1000.0) for d, c in zip(days, (500.0, 500.0, 125.0, 130.0), strict=True)] + [("MSFT", d, 200.0, 1000.0) for d in days], "ticker string, date date, close double, volume double")
    sp = adjust.split_factor_table(spark.createDataFrame([("AAPL", D(2020, 8, 31), 1.0, 4.0), ("AAPL", D(2019, 1, 1), 1.0, 0.0)], "ticker string, execution_date date, split_from double, split_to double"))
    dv = adjust.dividend_factor_table(spark.createDataFrame([("AAPL", D(2020, 9, 1), 0.99)], "ticker string, ex_dividend_date date, historical_adjustment_factor double"))
    out = {(r.ticker, r.date): (r.close, r.volume) for r in adjust.adjust_bars(bars, sp).collect()}
    assert [out["AAPL", d] for d in days] == [(125.0, 4000.0), (125.0, 4000.0), (125.0, 1000.0), (130.0, 1000.0)]
    assert all(out["MSFT", d] == (200.0, 1000.0) for d in days)
    both = {(r.ticker, r.date): r.close for r in adjust.adjust_bars(bars, sp, dv).collect()}
    assert [round(both["AAPL", d], 6) for d in days] == [123.75, 123.75, 123.75, 130.0]


def test_exchange_calendar(spark):
    table = {r.date: r for r in calendar.sessions(spark, D(2024, 1, 1), D(2024, 12, 31)).collect()}
    assert len(table) == 252
    for closed in (D(2024, 1, 1), D(2024, 1, 15), D(2024, 2, 19), D(2024, 3, 29), D(2024, 5, 27), D(2024, 6, 19), D(2024, 7, 4), D(2024, 9, 2), D(2024, 11, 28), D(2024, 12, 25)):
        assert closed not in table
    assert (table[D(2024, 11, 29)].market_close - table[D(2024, 11, 29)].market_open).seconds == 3.5 * 3600
    assert D(2021, 12, 31) in {r.date for r in calendar.sessions(spark, D(2021, 12, 30), D(2022, 1, 4)).collect()}
    ts = lambda h, m: dt.datetime(2024, 11, 29, h, m)
    bars = spark.createDataFrame([("SPY", D(2024, 11, 29), ts(h, m)) for h, m in ((14, 29), (14, 30), (17, 59), (18, 30))], "ticker string, date date, timestamp timestamp")
    reg = calendar.filter_session(bars, calendar.sessions(spark, D(2024, 11, 25), D(2024, 11, 29)))
    assert [(r.timestamp.hour, r.timestamp.minute) for r in reg.orderBy("timestamp").collect()] == [(14, 30), (17, 59)]
    assert calendar.filter_session(bars, calendar.sessions(spark, D(2024, 11, 25), D(2024, 11, 29)), "extended").count() == 2


def _engine_bars(spark):
    days, d = [], D(2023, 10, 2)
    while d <= D(2024, 6, 28):
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(days=1)
    data = []
    for i, d in enumerate(days):
        prices = {"A": 10 * 1.01**i, "B": 100.0, "F": 50.0}
        if d < D(2024, 3, 4):
            prices["C"] = 5 * (1 - 0.0185) ** i
        data += [(k, d, p, p * 1.001, p * 0.999, 1e6, 1.0, 1.0) for k, p in prices.items()]
    return days, spark.createDataFrame(data, "security_id string, date date, close double, high double, low double, volume double, split_factor double, div_factor double")


def test_daily_returns_and_delisting(spark):
    days, bars = _engine_bars(spark)
    out = backtest.daily_returns(bars, bars.select("date")).cache()
    a = out.where("security_id = 'A' and ret is not null").collect()
    assert all(abs(r.ret - 0.01) < 1e-12 for r in a) and len(a) == len(days) - 1
    gone = out.where("delisted").collect()
    assert [(r.security_id, r.date, r.ret) for r in gone] == [("C", D(2024, 3, 4), -0.30)]


def test_engine_profit_and_costs(spark):
    days, bars = _engine_bars(spark)
    returns = backtest.daily_returns(bars, bars.select("date"))
    targets = spark.createDataFrame([(days[10], "A", 0.5), (days[10], "B", -0.5), (days[60], "A", 0.5), (days[60], "B", -0.5)], "date date, security_id string, weight double")
    daily, trades = backtest.run(targets, returns, cost_bps=10.0)
    got = daily.orderBy("date").collect()
    assert got[0].date == days[11] and abs(got[0].gross - 0.005) < 1e-12
    assert abs(got[0].cost - 1.0 * 10 / 1e4) < 1e-12 and abs(got[0].net - ((1.005) * (1 - 0.001) - 1)) < 1e-12
    assert abs(got[1].gross - 0.5 * (1.01**2 - 1.01) / 1.005) < 1e-12
    nav = 1.0
    for r in got:
        nav *= 1 + r.net
    assert abs(got[-1].nav - nav) < 1e-9
    second = {r.security_id: r for r in trades.where(F.col("date") == F.lit(days[60])).collect()}
    x = 1 + 0.5 * (1.01**50 - 1)
    assert abs(second["A"].held - 0.5 * 1.01**50 / x) < 1e-9 and abs(second["A"].trade - (0.5 - second["A"].held)) < 1e-12


def test_caps_filters_and_ic(spark):
    w = spark.createDataFrame([(D(2024, 1, 1), f"S{i}", x) for i, x in enumerate((0.6, 0.2, 0.1, 0.1))], "date date, security_id string, weight double")
    capped = {r.security_id: r.weight for r in backtest.cap_weights(w, 0.4).collect()}
    assert abs(sum(capped.values()) - 1) < 1e-9 and max(capped.values()) <= 0.4 + 1e-9 and capped["S1"] > capped["S2"]
    assert all(abs(x - 0.25) < 1e-9 for x in (r.weight for r in backtest.cap_weights(w, 0.2).collect()))
    panel = spark.createDataFrame([(D(2024, 1, 31), f"S{i:02d}", float(i), float(i * i)) for i in range(60)], "date date, security_id string, score double, fwd double")
    ics = backtest.information_coefficients(panel, "score")
    assert [round(r.ic, 9) for r in ics.collect()] == [1.0]
    assert backtest.information_coefficients(panel.limit(40), "score").count() == 0


def test_cost_model(spark):
    fit = costs.SpreadFit({2020: 2.0, 2021: 3.0}, -0.4, 0.6, [(1e6, -0.1), (1e7, 0.15)])
    df = spark.createDataFrame([(2020, 1e8, 0.02), (2025, 1e8, 0.02), (2020, 5e6, 0.04), (2020, None, 0.02), (2020, 1e12, 0.001)], "y int, adv double, vol double")
    got = [r[0] for r in df.select(fit.bps(F.col("y"), F.col("adv"), F.col("vol"))).collect()]
    want = 2 * math.exp(-0.4 * math.log(0.05) + 0.6 * math.log(2) - 0.1 * (math.log(5) - math.log(100)) + 0.15 * (0 - math.log(10)))
    assert abs(got[0] - 2) < 1e-9 and abs(got[1] - 3) < 1e-9 and abs(got[2] - want) < 1e-9 and got[3] is None and got[4] < 0.5
    m = costs.CostModel(fit, aum=1e8)
    c = spark.range(1).select(m.impact_cost(F.lit(0.01), F.lit(1e8), F.lit(0.02)), m.borrow_rate(F.lit(0.3)), m.borrow_rate(F.lit(None).cast("double"))).first()
    assert abs(c[0] - 0.01 * 0.02 * 0.1) < 1e-12 and c[1] == 0.03 and c[2] == 0.0025
    cost = lambda model, adv=1e8, **kw: spark.range(1).select(model.spread_cost(F.lit(-0.5), F.lit(2020), F.lit(adv).cast("double"), F.lit(0.02), **kw)).first()[0]
    assert abs(cost(m) - 0.5 * 3e-4) < 1e-12 and abs(cost(m, None) - 0.5 * 201e-4) < 1e-12 and abs(cost(costs.CostModel(auction=True)) - 0.5e-4) < 1e-12
    assert abs(cost(costs.CostModel(spread="volume")) - 0.5 * 4e-4) < 1e-12 and abs(cost(costs.CostModel(spread=7.0)) - 0.5 * 8e-4) < 1e-12 and abs(cost(costs.CostModel()) - 0.5 * 4.2003e-4) < 1e-12
    assert abs(cost(costs.CostModel(spread="estimate"), estimate=F.lit(0.0012)) - 0.5 * 13e-4) < 1e-12
    big = spark.range(1).select(m.impact_cost(F.lit(1.0), F.lit(1e4), F.lit(0.05))).first()[0]
    assert abs(big - 0.05 * 100) < 1e-9  # a known impact has no cap


def test_asof_forward_and_nearest_on_one_large_key(spark):
    import time

    from lakeloom.operators.asof import asof_join

    left = spark.range(50000).selectExpr("1 as k", "id * 3 as t")
    right = spark.range(50000).selectExpr("1 as k", "id * 3 + 2 as t", "id as v")
    began = time.time()
    for strategy, shift in (("forward", 0), ("nearest", -1)):
        rows = asof_join(left, right, "t", by=["k"], strategy=strategy).selectExpr("t div 3 as i", "v").collect()
        assert all(r.v == max(r.i + shift, 0) for r in rows) and len(rows) == 50000
    assert time.time() - began < 40


def test_sharpe_probabilities():
    assert abs(analytics.probabilistic_sharpe(0.0, 100) - 0.5) < 1e-12
    assert analytics.probabilistic_sharpe(0.1, 1000) > 0.99
    assert analytics.deflated_sharpe(0.1, 1000, 0.002, 50) < analytics.probabilistic_sharpe(0.1, 1000)


def test_signals_follow_the_null_rules(spark):
    panel = spark.createDataFrame(
        [("a", D(2024, 1, 31), "USD", 100.0, 10.0, 50.0, -5.0, None), ("b", D(2024, 1, 31), "EUR", 100.0, 10.0, 0.0, 5.0, 2.0), ("c", D(2024, 1, 31), None, 100.0, 10.0, -1.0, 5.0, None)],
        "security_id string, date date, currency string, issuer_market_cap double, net_income double, equity double, dividends_paid double, buybacks double",
    )
    out = {r.security_id: r for r in signals.fundamental_signals(panel, ["earnings_yield", "roe", "shareholder_yield", "payout_ratio", "size"]).collect()}
    assert out["a"].earnings_yield == 0.1 and out["b"].earnings_yield is None and out["c"].earnings_yield == 0.1
    assert out["a"].roe == 0.2 and out["b"].roe is None and out["c"].roe is None
    assert out["a"].shareholder_yield == -0.05 and out["c"].shareholder_yield == 0.05
    assert set(signals.resolve(["value", "roe"])) >= {"earnings_yield", "roe"} and len(signals.catalogue()) == 48
    with pytest.raises(ValueError):
        signals.resolve(["nothing"])


def test_lags_and_short_signals(spark):
    p = spark.createDataFrame([("a", D(2023, 1, 31), 10.0), ("a", D(2024, 1, 31), 12.0), ("b", D(2024, 1, 31), 1.0)], "security_id string, date date, revenue double")
    for monthly in (True, False):
        lag = {(r.security_id, r.date.year): r.revenue_lag for r in signals.add_lags(p, ["revenue"], monthly).collect()}
        assert lag == {("a", 2023): None, ("a", 2024): 10.0, ("b", 2024): None}
    si = spark.createDataFrame([("a", D(2024, 1, 10), D(2024, 1, 20), 100.0, 2.0), ("a", D(2024, 1, 25), D(2024, 2, 5), 150.0, 3.0)], "security_id string, settlement_date date, published_date date, short_interest double, days_to_cover double")
    pts = spark.createDataFrame([("a", D(2024, 1, 19)), ("a", D(2024, 2, 6)), ("a", D(2024, 6, 1))], "security_id string, date date")
    got = {r.date: (r.days_to_cover, r.si_change) for r in signals.short_signals(pts, si).collect()}
    assert got[D(2024, 1, 19)] == (None, None) and got[D(2024, 2, 6)] == (3.0, 0.5) and got[D(2024, 6, 1)] == (None, None)


def test_composite_reweights_what_is_there(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), f"s{i}", float(i), None if i == 0 else float(-i)) for i in range(5)], "date date, security_id string, a double, b double")
    out = {r.security_id: r.score for r in xsection.composite(df, {"a": 1.0, "b": -1.0}, winsor=0.0).collect()}
    za = (0 - 2) / (2.5**0.5)
    assert abs(out["s0"] - za) < 1e-9
    few = {r.security_id: r.score for r in xsection.composite(df, {"a": 1.0, "b": -1.0}, winsor=0.0, min_signals=2).collect()}
    assert few["s0"] is None and few["s1"] is not None


def test_truncation_changes_no_earlier_signal(spark, sf_dir):
    from lakeloom.plans import views

    b = views.bars(spark, sf_dir).withColumn("div_factor", F.lit(1.0)).cache()
    cut = D(1997, 6, 30)
    pts = views.month_ends(views.calendar(b)).where(F.col("date") <= F.lit(cut)).crossJoin(b.select("security_id").distinct())
    names = ["date", "security_id", "momentum_12_1", "reversal_1m", "volatility_3m"]
    full = signals.price_signals(pts, b).select(*names)
    short = signals.price_signals(pts, b.where(F.col("date") <= F.lit(cut))).select(*names)
    assert full.exceptAll(short).count() == 0
