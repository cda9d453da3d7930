import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lakeloom.__main__ import main
from lakeloom.operators import backtest, fundamentals, risk
from lakeloom.plans import build, views
from lakeloom.sources.store import Tables

D = dt.date


def test_identity_build_and_checks(spark):
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    bars = spark.createDataFrame([("OLD", d, 10.0) for d in days[:30]] + [("NEW", d, 10.0) for d in days[30:]], "ticker string, date date, close double")
    records = spark.createDataFrame([("OLD", days[5], "F1", None, "C1"), ("NEW", days[40], "F1", None, "C1")], "ticker string, as_of date, figi string, share_class_figi string, cik string")
    splits = spark.createDataFrame([], "ticker string, execution_date date, split_from double, split_to double")
    got = build.build_identity(bars, records, splits)
    assert {(r.ticker, r.security_id, r.valid_to) for r in got["master"].collect()} == {("OLD", "F1", days[29]), ("NEW", "F1", None)}
    assert all(r.bad == 0 for r in build.identity_checks(got, bars).collect())


def test_series_are_stored_by_version(spark, tmp_path):
    facts = spark.createDataFrame([("0000000001", "Assets", "USD", None, D(2023, 3, 31), 5.0, "a", D(2023, 5, 1))], "cik string, tag string, unit string, start date, end date, val double, accn string, filed date")
    items = [fundamentals.Item("assets", "instant", ("Assets",))]
    t = Tables(spark, f"file://{tmp_path}/s")
    assert build.materialised_series(t, facts, items, 1).count() == 1
    assert build.materialised_series(t, facts.limit(0), items, 1).count() == 1
    assert t.summary().first().rows == 1


def test_panel_reads_what_the_signals_need(spark, sf_dir):
    from lakeloom.plans.queries_company import _caps, _counts
    from lakeloom.operators import marketcap as mc

    b = views.bars(spark, sf_dir).withColumn("split_factor", F.lit(1.0)).withColumn("div_factor", F.lit(1.0)).cache()
    caps = mc.year_panel(_caps(spark, sf_dir)).select("date", "security_id", "cik", "issuer_market_cap", "primary")
    assert _counts(spark, sf_dir).count() > 0
    series = caps.select("cik").distinct().selectExpr("cik", "explode(array('net_income', 'equity')) as item", "date'1995-12-31' as end", "100.0D as value", "cast(null as double) as ttm", "date'1996-03-01' as available_from", "cast(null as date) as ttm_available_from")
    dates = views.month_ends(views.calendar(b)).where("date between date'1996-04-01' and date'1996-09-30'")
    p = build.signal_panel(dates, ["earnings_yield", "roe", "reversal_1m"], caps, b, series, top=3)
    rows = p.where("issuer_market_cap is not null").collect()
    assert rows and all(r.roe == 1.0 and abs(r.earnings_yield - 100 / r.issuer_market_cap) < 1e-12 for r in rows if r.cik is not None)


def _risk_inputs(spark):
    rng = np.random.default_rng(2)
    n = 30
    exp = pd.DataFrame([{"security_id": f"S{i:02d}", "date": d, "issuer_market_cap": float(np.exp(rng.normal(20, 1))), "sector": str(i % 3), "x": float(rng.normal())} for d in (D(2024, 1, 31), D(2024, 2, 29)) for i in range(n)])
    ret = pd.DataFrame([{"security_id": f"S{i:02d}", "date": D(2024, 2, 1) + dt.timedelta(days=k), "ret": float(rng.normal(0, 0.01))} for k in range(70) for i in range(n)])
    return spark.createDataFrame(exp), spark.createDataFrame(ret)


def test_portfolio_loop_starts_from_drifted_weights(spark):
    exp, ret = _risk_inputs(spark)
    factors, resid = risk.regressions(ret, exp, ["x"], least=10)
    cov = build.factor_cov_table(factors)
    assert cov.count() == 25
    spec = risk.specific_var(resid, exp.select("security_id", F.lit(D(2024, 4, 10)).alias("date"), "issuer_market_cap").dropDuplicates(["security_id"])).select("security_id", "specific_var")
    panel = exp.join(spec, "security_id").withColumn("alpha", F.when(F.col("x") > 0, 1e-4).otherwise(-1e-4))
    out = build.optimised_portfolio(panel, ["x"], cov, ret, risk.Limits(max_weight=0.1, net=0.0, gross=1.0)).cache()
    by = {r.date: (r.g, r.n) for r in out.groupBy("date").agg(F.sum(F.abs("weight")).alias("g"), F.sum("weight").alias("n")).collect()}
    assert len(by) == 2 and all(0 < g <= 1 + 1e-6 and abs(n) < 1e-3 for g, n in by.values())
    w = spark.createDataFrame([(D(2024, 1, 31), "S00", 0.5)], "date date, security_id string, weight double")
    g = np.prod([1 + r.ret for r in ret.where("security_id = 'S00' and date <= date'2024-02-29'").collect()])
    assert abs(build.drifted(w, ret, F.lit(D(2024, 2, 29))).first().held - 0.5 * g / (1 + 0.5 * (g - 1))) < 1e-9
    ports = build.test_portfolios(exp, 2, 10)
    assert ports.groupBy("date", "portfolio").count().where("count <> 10").count() == 0
    bias = build.bias_by_portfolio(ports, risk.long_exposures(exp, ["x"]), cov, panel.select("date", "security_id", "specific_var"), ret).collect()
    assert len(bias) == 2 and all(0.3 < r.bias < 3 for r in bias)


def test_strategy_backtest_per_day(spark):
    T = dt.datetime
    rows = [(d, T(2024, 3, d.day, 15, 0) + dt.timedelta(minutes=5 * i), "A", 100.0 + i, 100.0 + i, 100.0 + i, 1e6, False) for d in (D(2024, 3, 1), D(2024, 3, 4)) for i in range(4)]
    bars = spark.createDataFrame(rows, "date date, bar_end timestamp, security_id string, open double, close double, vwap double, volume double, stale boolean")
    aux = spark.createDataFrame([(d, "A", 100.0, 103.0) for d in (D(2024, 3, 1), D(2024, 3, 4))], "date date, security_id string, open double, close double")

    def first_bar(day):
        return pd.DataFrame({"bar_end": [day["bar_end"].min()], "security_id": ["A"], "weight": [1.0]})

    out = build.intraday_backtest(bars, aux, first_bar)
    daily = out["daily"].orderBy("date").collect()
    assert len(daily) == 2 and all(abs(r.gross - (103 / 101 - 1)) < 1e-12 and abs(r.cost - 1e-4) < 1e-12 for r in daily)


def test_forward_returns(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    ret = spark.createDataFrame([("A", d, 0.1) for d in days], "security_id string, date date, ret double")
    got = backtest.forward_returns(ret, ret.select("date").where("date = date'2024-01-02'"), 2, ret).collect()
    assert len(got) == 1 and abs(got[0].fwd - 0.21) < 1e-9


def test_command_line(capsys):
    assert main(["queries"]) == 0
    assert "daily_bars" in capsys.readouterr().out
