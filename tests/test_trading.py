import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lakeloom.operators import calibrate, intraday, microstructure as ms, orders, project, risk, simulate

D, T = dt.date, dt.datetime
NS = 1_000_000_000


def epoch(y, m, d, h, mi, s=0):
    return int(T(y, m, d, h, mi, s, tzinfo=dt.UTC).timestamp()) * NS


def test_clock_shortens_the_last_bar(spark):
    ses = spark.createDataFrame([(D(2024, 11, 29), T(2024, 11, 29, 14, 30), T(2024, 11, 29, 18, 0))], "date date, market_open timestamp, market_close timestamp")
    c = intraday.clock(ses, 60).orderBy("bar").collect()
    assert [r.minutes_from_open for r in c] == [60, 120, 180, 210] and c[-1].bar_end == T(2024, 11, 29, 18, 0)
    assert intraday.parse_freq("5min") == 5 and intraday.parse_freq("1h") == 60


def _minutes(spark):
    ses = spark.createDataFrame([(D(2024, 11, d), T(2024, 11, d, 14, 30), T(2024, 11, d, 18 if d == 29 else 21, 0)) for d in (26, 27, 29)], "date date, market_open timestamp, market_close timestamp")
    data = []
    for d, n in ((26, 390), (27, 390), (29, 210)):
        for i in range(n):
            ts = T(2024, 11, d, 14, 30) + dt.timedelta(minutes=i)
            data.append(("A", D(2024, 11, d), ts, 100 + 0.01 * i, 100 + 0.01 * i + 0.005, 100 + 0.01 * i - 0.005, 100 + 0.01 * i, 100.0 + i, 1))
            if i % 7 == 0:
                data.append(("B", D(2024, 11, d), ts, 50.0, 50.0, 50.0, 50.0, 10.0, 1))
    data.append(("A", D(2024, 11, 26), T(2024, 11, 26, 13, 0), 1.0, 1.0, 1.0, 1.0, 1.0, 1))
    return ses, spark.createDataFrame(data, "security_id string, date date, timestamp timestamp, open double, high double, low double, close double, volume double, transactions long")


def test_resample_grid_and_features(spark):
    ses, m = _minutes(spark)
    bars = intraday.resample(m, ses, 5)
    first = bars.where("security_id = 'A' and date = date'2024-11-26' and bar = 0").first()
    assert (first.open, first.close, first.volume) == (100.0, 100.04, 510.0)
    want = sum((100 + 0.01 * i) * (100 + i) for i in range(5)) / 510
    assert abs(first.vwap - want) < 1e-9
    g = intraday.grid(bars, ses, 5).cache()
    assert g.where("security_id = 'B' and date = date'2024-11-26'").count() == 78
    stale = g.where("security_id = 'B' and date = date'2024-11-26' and bar = 3").first()
    assert stale.stale and stale.volume == 0 and stale.close == 50.0
    f = intraday.features(g, or_minutes=30, lookback=2, min_obs=1).cache()
    a = f.where("security_id = 'A' and date = date'2024-11-27'").orderBy("bar").collect()
    assert a[4].or_high is None and abs(a[5].or_high - (100.29 + 0.005)) < 1e-9 and a[6].or_break == 1
    assert abs(a[0].vol_ratio - 1.0) < 1e-9 and abs(a[10].ret_open - (a[10].close / 100.0 - 1)) < 1e-12
    cut = g.where("date <= date'2024-11-27'")
    cols = ["security_id", "date", "bar", "ret_bar", "rvol", "or_high", "vol_ratio"]
    early = intraday.features(cut, or_minutes=30, lookback=2, min_obs=1).select(*cols)
    assert f.where("date <= date'2024-11-27'").select(*cols).exceptAll(early).count() == 0
    s = intraday.summarize(m, ses).where("security_id = 'A' and date = date'2024-11-29'").first()
    assert s.n_minutes == 210 and abs(s.last_close - 102.09) < 1e-9 and abs(s.price_30 - 100.29) < 1e-9


def _ticks(spark):
    o, c = epoch(2024, 1, 10, 14, 30), epoch(2024, 1, 10, 21, 0)
    q = [(o - 60 * NS, 9.0, 11.0), (o - NS, 10.0, 10.02), (o + 120 * NS, 10.01, 10.03), (o + 150 * NS, 10.05, 10.0), (c - 3600 * NS, 10.10, 10.12)]
    quotes = spark.createDataFrame([("AAA", t, b, a) for t, b, a in q], "ticker string, sip_timestamp long, bid_price double, ask_price double")
    trades = [(o + NS, None, None, 10.0, 500.0, [17]), (o + 10 * NS, None, None, 10.02, 100.0, []), (o + 20 * NS, None, None, 10.01, 100.0, [37]), (o + 30 * NS, None, None, 10.0, 300.0, [2]), (o + 181 * NS, o + 60 * NS, o + 181 * NS, 10.0, 100.0, []), (c - NS, None, None, 10.15, 1000.0, [19])]
    t = spark.createDataFrame([("AAA", s, p, x, pr, sz, co, 0, i, 1) for i, (s, p, x, pr, sz, co) in enumerate(trades)], "ticker string, sip_timestamp long, participant_timestamp long, trf_timestamp long, price double, size double, conditions array<smallint>, correction int, sequence_number long, exchange int")
    return o, c, quotes, t


def test_tick_measures_on_paper(spark):
    o, c, quotes, trades = _ticks(spark)
    out = ms.measure_block(trades, quotes, o, c)
    day = out["daily"].first()
    eff = [(0.01 / 10.01, 10.02 * 100), (0.0, 10.01 * 100), (0.01 / 10.01, 10.0 * 100)]
    assert day.n_trades == 3 and abs(day.effective - sum(e * d for e, d in eff) / sum(d for _, d in eff)) < 1e-12
    spans = [(120, 0.01 / 10.01), ((c - o) / NS - 3600 - 120, 0.01 / 10.02), (3600, 0.01 / 10.11)]
    assert abs(day.quoted_half_spread - sum(s * h for s, h in spans) / sum(s for s, _ in spans)) < 1e-12
    assert (day.opening_price, day.opening_size, day.closing_price, day.closing_size) == (10.0, 500.0, 10.15, 1000.0)
    assert [r.sign for r in out["trades"].orderBy("t").collect()] == [1, -1, -1]
    assert abs(out["minute"].agg(F.sum("seconds")).first()[0] - (c - o) / NS) < 1e-6
    snap = ms.snapshots(quotes.select("ticker", F.col("sip_timestamp").alias("ts"), F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask")), [("open", o), ("minute3", o + 140 * NS)]).first()
    assert abs(snap.open - 0.01 / 10.01) < 1e-12 and abs(snap.minute3 - 0.01 / 10.02) < 1e-12


def test_skewed_match_is_the_plain_one(spark):
    rng = np.random.default_rng(1)
    q = spark.createDataFrame([("A" if x < 0.8 else "B", int(t), float(b), float(b) + 1) for x, t, b in zip(rng.random(300), rng.integers(0, 5000, 300), rng.integers(1, 50, 300), strict=True)], "ticker string, ts long, bid double, ask double").dropDuplicates(["ticker", "ts"])
    t = spark.createDataFrame([("A" if x < 0.8 else "B", int(v), i) for i, (x, v) in enumerate(zip(rng.random(200), rng.integers(0, 6000, 200), strict=True))], "ticker string, t long, i int")
    plain = ms.asof_join(t, q, "t", "ts", ["ticker"], strict=True, tie=["bid"]).select("i", "bid", "ask")
    skewed = ms.asof_skewed(t, q, "t", "ts", "ticker", 700, payload=["bid", "ask"]).select("i", "bid", "ask")
    assert plain.exceptAll(skewed).count() == 0 and skewed.exceptAll(plain).count() == 0


def test_spread_fit_recovers_its_parameters(spark):
    rng = np.random.default_rng(7)
    n = 20000
    adv, vol, year = np.exp(rng.normal(16, 2, n)), np.exp(rng.normal(-3.9, 0.4, n)), rng.integers(2020, 2022, n)
    h = lambda k: np.maximum(np.log(adv / k), 0) - max(math.log(1e8 / k), 0)
    mean = np.where(year == 2020, 2.0, 3.0) * np.exp(-0.4 * np.log(adv / 1e8) + 0.6 * np.log(vol / 0.02) - 0.1 * h(1e6) + 0.15 * h(1e7))
    y = mean * rng.gamma(8, 1 / 8, n)
    df = spark.createDataFrame(pd.DataFrame({"security_id": np.arange(n) % 500, "date": [D(int(v), 6, 1) for v in year], "class": "stock", "adv": adv, "vol": vol, "eff_bps": y, "outside_share": 0.0, "n_matched": 50}))
    fit = calibrate.fit_spread(df, [1e6, 1e7])
    assert abs(fit.slope + 0.4) < 0.05 and abs(fit.vol_slope - 0.6) < 0.05 and abs(fit.levels[2020] / 2 - 1) < 0.06 and abs(fit.levels[2021] / 3 - 1) < 0.06
    assert abs(fit.hinges[0][1] + 0.1) < 0.08 and abs(fit.hinges[1][1] - 0.15) < 0.08
    big = calibrate.compare(df, fit).where("n > 500").collect()
    assert big and all(0.85 < r.ratio < 1.15 for r in big)


def test_simulated_fills(spark):
    data, days = [], (D(2024, 3, 1), D(2024, 3, 4))
    for d in days:
        for i in range(6):
            close = 100.0 + i
            data.append((d, T(d.year, d.month, d.day, 14, 35) + dt.timedelta(minutes=5 * i), "A", close - 0.2, close, None if i == 2 else close - 0.1, 0.0 if i == 2 else 1000.0, i == 2))
    bars = spark.createDataFrame(data, "date date, bar_end timestamp, security_id string, open double, close double, vwap double, volume double, stale boolean")
    aux = spark.createDataFrame([(d, "A", 99.5, 105.5, 99.0) for d in days], "date date, security_id string, open double, close double, prev_close double")
    tg = spark.createDataFrame([(days[0], T(2024, 3, 1, 14, 40), "A", 1.0, None)], "date date, bar_end timestamp, security_id string, weight double, auction string")
    fills, daily = simulate.simulate(bars, tg, aux)
    got = fills.orderBy("bar_end").collect()
    # signal on bar 1, active from bar 2, which is stale: filled on bar 3 at its vwap; flat at the close
    assert [(r.kind, r.bar_end.minute, round(r.price, 2), r.wait) for r in got] == [("bar", 50, 102.9, 1), ("close", 0, 105.5, 0)]
    gross = {r.date: r.gross for r in daily.collect()}
    assert abs(gross[days[0]] - (105.5 / 102.9 - 1)) < 1e-12 and gross[days[1]] == 0.0
    capped, _ = simulate.simulate(bars, tg, aux, participation=0.1, aum=50000.0)
    parts = capped.where("kind = 'bar'").orderBy("bar_end").collect()
    assert len(parts) == 3 and abs(parts[0].trade - 0.1 * 1000 * 102.9 / 50000) < 1e-12
    assert simulate.fill_stats(fills).count() == 2 and simulate.round_trips(fills).first().gain > 0
    c = simulate.intraday_costs(fills, 2.0, aum=1e5).where("kind = 'bar'").first()
    assert abs(c.spread_cost - 2e-4) < 1e-12 and abs(c.commission - max(1e5 / 102.9 * 0.0035, 0.35) / 1e5) < 1e-12


def test_overnight_positions_are_carried(spark):
    days = (D(2024, 3, 1), D(2024, 3, 4))
    bars = spark.createDataFrame([(d, T(d.year, d.month, d.day, 15, 0), "A", 100.0, 100.0, 100.0, 10.0, False) for d in days], "date date, bar_end timestamp, security_id string, open double, close double, vwap double, volume double, stale boolean")
    aux = spark.createDataFrame([(days[0], "A", 100.0, 100.0, 100.0), (days[1], "A", 110.0, 121.0, 100.0)], "date date, security_id string, open double, close double, prev_close double")
    tg = spark.createDataFrame([(days[0], T(2024, 3, 1, 15, 0), "A", 1.0, "close"), (days[1], T(2024, 3, 4, 15, 0), "A", 0.0, "open")], "date date, bar_end timestamp, security_id string, weight double, auction string")
    fills, daily = simulate.simulate(bars, tg, aux, overnight=True)
    assert [(r.kind, round(r.trade, 6)) for r in fills.orderBy("date").collect()] == [("close", 1.0), ("open", -1.1)]
    assert [round(r.gross, 9) for r in daily.orderBy("date").collect()] == [0.0, 0.1]


def test_market_inputs_look_back(spark):
    d = spark.createDataFrame([("A", D(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i, 10.0) for i in range(5)], "security_id string, date date, close double, volume double")
    got = simulate.market_inputs(d).orderBy("date").collect()
    assert got[0].adv is None and got[1].adv == 1000.0 and got[2].prev_close == 101.0


def test_order_sheet(spark):
    t = spark.createDataFrame([("A", 0.5), ("B", 0.001), ("C", 0.1), ("E", -0.2), ("F", 0.1)], "security_id string, weight double")
    h = spark.createDataFrame([("D", 4, 7), ("A", 1, 50)], "security_id string, con_id int, shares long")
    k = spark.createDataFrame([(x, x, i, "ok" if x != "C" else "missing") for i, x in enumerate("ABCDEF", 1)], "security_id string, ticker string, con_id int, status string")
    m = spark.createDataFrame([("A", 100.0, 1e9), ("B", 50.0, 1e9), ("C", 10.0, 1e9), ("D", 1.0, 1e9), ("E", 10.0, 1e9), ("F", 10.0, 5e4)], "security_id string, price double, adv double")
    sheet = orders.make_orders(t, h, k, m, 1e5, min_trade=200, participation=0.1, shortable=spark.createDataFrame([("Z",)], "security_id string")).cache()
    got = {r.security_id: (r.shares, r.order_status) for r in sheet.collect()}
    assert got == {"A": (450, "send"), "B": (2, "small"), "C": (1000, "contract"), "D": (-7, "send"), "E": (-2000, "not_shortable"), "F": (1000, "participation")}
    fills = spark.createDataFrame([("x1", 1, 400.0, 101.0)], "exec_id string, con_id int, shares double, price double")
    rec = {r.security_id: r for r in orders.reconcile(sheet, fills, spark.createDataFrame([(1, 450), (4, 7)], "con_id int, shares long")).collect()}
    assert abs(rec["A"].slippage_bps - 100) < 1e-6 and rec["A"].difference == 0 and rec["A"].unfilled == 50
    j = orders.record_fills(fills, fills.union(fills))
    assert j.count() == 1
    assert orders.positions_hash(h).first()[0] == orders.positions_hash(h.orderBy("con_id")).first()[0]


def _model(spark, n=120, days=60):
    rng = np.random.default_rng(3)
    sector = rng.integers(0, 4, n).astype(str)
    cap = np.exp(rng.normal(22, 1, n))
    style = rng.normal(0, 1, (n, 2))
    exp = pd.DataFrame({"security_id": [f"S{i:03d}" for i in range(n)], "date": D(2020, 1, 31), "issuer_market_cap": cap, "sector": sector, "x1": style[:, 0], "x2": style[:, 1]})
    f = rng.normal(0, 0.01, (days, 3))
    rows = []
    for t in range(days):
        r = f[t, 0] + style @ f[t, 1:] + rng.normal(0, 0.002, n)
        rows += [(f"S{i:03d}", D(2020, 2, 1) + dt.timedelta(days=t), float(r[i])) for i in range(n)]
    exp = pd.concat([exp, exp.assign(date=D(2020, 2, 29))])
    return f, spark.createDataFrame(exp), spark.createDataFrame(rows, "security_id string, date date, ret double")


def test_cross_sections_recover_factor_returns(spark):
    f, exp, ret = _model(spark)
    factors, resid = risk.regressions(ret, exp, ["x1", "x2"])
    wide = {r.date: r for r in factors.groupBy("date").pivot("factor").agg(F.first("ret")).collect()}
    got = np.array([[wide[d]["x1"], wide[d]["x2"]] for d in sorted(wide)])
    assert got.shape == (60, 2) and np.abs(got - f[:, 1:]).max() < 0.002
    assert resid.count() == 60 * 120
    spec = risk.specific_var(resid, exp.where("date = date'2020-01-31'").select("security_id", F.lit(D(2020, 4, 1)).alias("date"), "issuer_market_cap"))
    assert spec.where("specific_var is null").count() == 0
    cov = risk.factor_cov(np.random.default_rng(1).normal(0, 0.01, (300, 4)))
    assert np.allclose(cov, cov.T) and np.all(np.linalg.eigvalsh(cov) > 0)


def test_exposures_are_centred(spark):
    _, exp, _ = _model(spark)
    out = risk.build_exposures(exp, {"style": ["x1", "x2"]})
    mean = out.agg((F.sum(F.col("style") * F.col("issuer_market_cap")) / F.sum("issuer_market_cap")).alias("m"), F.max(F.abs("style")).alias("x")).first()
    assert abs(mean.m) < 1e-9 and mean.x < 6


def test_optimiser_against_the_closed_form():
    rng = np.random.default_rng(5)
    n, k = 40, 3
    x, cov, spec = rng.normal(0, 1, (n, k)), np.diag([1e-4, 2e-4, 1e-4]), np.full(n, 4e-4)
    alpha = rng.normal(0, 1e-4, n)
    w, _ = risk.optimise(alpha, x, cov, spec, np.zeros(n), risk=5.0, limits=risk.Limits(max_weight=10, net=None, gross=1e9), steps=4000)
    exact = np.linalg.solve(5.0 * (x @ cov @ x.T + np.diag(spec)), alpha)
    assert np.abs(w - exact).max() < 1e-5
    tied, note = risk.optimise(alpha, x, cov, spec, np.zeros(n), limits=risk.Limits(max_weight=0.05, net=0.0, gross=1.0, vol=0.002))
    assert abs(tied.sum()) < 1e-3 and np.abs(tied).max() <= 0.05 + 1e-9 and np.abs(tied).sum() <= 1 + 1e-6 and note == ""
    dear, _ = risk.optimise(alpha, x, cov, spec, np.zeros(n), linear=1.0, limits=risk.Limits())
    assert np.abs(dear).max() < 1e-9


def test_attribution_adds_up(spark):
    f, exp, ret = _model(spark)
    factors, resid = risk.regressions(ret, exp, ["x1", "x2"])
    w = exp.select("date", "security_id", F.lit(1 / 120).alias("weight"))
    parts = risk.attribute(w, risk.long_exposures(exp, ["x1", "x2"]), factors, resid).groupBy("date").agg(F.sum("value").alias("v"))
    clipped = risk.robust_clip(ret).groupBy("date").agg(F.avg("ret").alias("r"))
    worst = parts.join(clipped, "date").agg(F.max(F.abs(F.col("v") - F.col("r")))).first()[0]
    assert worst < 1e-9


def test_study_operators(spark):
    ics = spark.createDataFrame([(D(2020, 1, 31) + dt.timedelta(days=30 * i), D(2020, 1, 31) + dt.timedelta(days=30 * i + 30), s, v + 0.01 * (i % 3)) for i in range(30) for s, v in (("a", 0.05), ("b", -0.05))], "date date, next_date date, signal string, ic double")
    w = {(r.date, r.signal): r.weight for r in project.walk_forward_weights(ics).collect()}
    last = max(d for d, _ in w)
    assert w[last, "a"] == 0.75 and w[last, "b"] == 0.25 and w[min(d for d, _ in w), "a"] == 0.5
    p = spark.createDataFrame([(D(2024, 1, 31), f"S{i}", float(i + 1)) for i in range(4)], "date date, security_id string, issuer_market_cap double")
    assert {r.security_id: r.weight for r in project.benchmark(p, 2).collect()} == {"S3": 4 / 7, "S2": 3 / 7}
    pr = spark.createDataFrame([("S3", D(2024, 1, 30), 10.0), ("S2", D(2024, 1, 1), 10.0)], "security_id string, date date, close_raw double")
    book = {r.security_id: r.shares for r in project.round_to_shares(project.benchmark(p, 2), pr, 1000.0).collect()}
    assert book == {"S3": 57, "S2": None}
    assert project.choose([{"name": "x", "sharpe": 1.0, "max_drawdown": -0.5}, {"name": "y", "sharpe": 0.9, "max_drawdown": -0.1}], worst_drawdown=-0.2)["name"] == "y"
