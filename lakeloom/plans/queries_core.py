"""Queries over the general operators: reshaping, fills, calendars, costs, statistics, sectors, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as win
from ..functions.columns import mean_of
from ..operators import analytics, calendar, costs, marketcap, signals, xsection
from ..operators import microstructure as ms
from . import views
from .queries_market import _DAILY, _FACTORS, _RET, _adjusted, _returns, r
from .registry import register


@register("order_status_pivot", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS p FROM orders GROUP BY 1""")
def order_status_pivot(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return o.select("year", *[r(c, 2).alias(c.lower()) for c in ("F", "O", "P")])


@register("prices_unpivoted", f"WITH {views.BARS} SELECT security_id, date, name, round(price, 4) AS price FROM (UNPIVOT (SELECT security_id, date, open, high, low, close FROM bars) ON open, high, low, close INTO NAME name VALUE price)")
def prices_unpivoted(spark, sf_dir):
    return views.bars(spark, sf_dir).unpivot(["security_id", "date"], ["open", "high", "low", "close"], "name", "price").withColumn("price", r("price"))


@register("row_extremes", f"WITH {views.BARS}, x AS (SELECT security_id, date, open, CASE WHEN security_id % 11 <> 3 THEN close END AS close FROM bars) SELECT security_id, date, round(greatest(open, close), 4) AS top, round(least(open, close), 4) AS bottom, round(CASE WHEN close IS NULL THEN open ELSE (open + close) / 2 END, 4) AS middle FROM x")
def row_extremes(spark, sf_dir):
    x = views.bars(spark, sf_dir).select("security_id", "date", "open", F.when(F.col("security_id") % 11 != 3, F.col("close")).alias("close"))
    return x.select("security_id", "date", r(F.greatest("open", "close")).alias("top"), r(F.least("open", "close")).alias("bottom"), r(mean_of(F.col("open"), F.col("close"))).alias("middle"))


@register("distinct_over", """SELECT o_orderkey, len(list(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey)) AS priorities FROM orders""")
def distinct_over(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.size(F.collect_set("o_orderpriority").over(W.partitionBy("o_custkey"))).cast("long").alias("priorities"))


@register("filled_prices", f"""WITH {views.BARS}, x AS (SELECT security_id, date, CASE WHEN volume > 40 THEN close END AS x FROM bars)
SELECT security_id, date, round(last_value(x IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS before, round(first_value(x IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS after FROM x""")
def filled_prices(spark, sf_dir):
    x = views.bars(spark, sf_dir).select("security_id", "date", F.when(F.col("volume") > 40, F.col("close")).alias("x"))
    return x.select("security_id", "date", r(win.fill_forward(F.col("x"), ["security_id"], ["date"])).alias("before"), r(win.fill_backward(F.col("x"), ["security_id"], ["date"])).alias("after"))


@register("publication_dates", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE isodow(o_orderdate) < 6), n AS (SELECT date, lead(date, 7) OVER (ORDER BY date) AS published_date FROM d), s AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS settlement_date FROM lineitem), x AS (SELECT max(date) AS last FROM d)
SELECT l_orderkey, l_linenumber, settlement_date, CASE WHEN settlement_date <= last THEN published_date END AS published_date FROM s CROSS JOIN x ASOF LEFT JOIN n ON s.settlement_date >= n.date""")
def publication_dates(spark, sf_dir):
    days = views.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).where("weekday(date) < 5").distinct()
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("settlement_date"))
    return calendar.publication_dates(days, rows)


@register("business_days", """SELECT o_orderkey, list_filter(generate_series(d, d + INTERVAL 20 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6 AND x > d)[8]::DATE AS due FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def business_days(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", calendar.business_day_after(F.to_date("o_orderdate"), 8).alias("due"))


_LEVELS = "CASE year " + " ".join(f"WHEN {y} THEN {v}" for y, v in costs.SPREAD_FIT.levels.items()) + " END"


@register("trading_costs", _RET + f""", x AS (SELECT security_id, date, 0.02 AS trade, CAST(year(date) + 9 AS INTEGER) AS year, adv * 1e3 AS adv, vol FROM returns WHERE NOT delisted),
s AS (SELECT *, exp({costs.SPREAD_FIT.slope} * ln(adv / 1e8) + {costs.SPREAD_FIT.vol_slope} * ln(greatest(coalesce(vol, 0.03), 1e-4) / 0.02) + """ + " + ".join(f"{c} * (greatest(ln(adv / {k}), 0) - greatest(ln(1e8 / {k}), 0))" for k, c in costs.SPREAD_FIT.hinges) + f""") * {_LEVELS} AS bps FROM x)
SELECT security_id, date, round(trade * (least(greatest(coalesce(CASE WHEN adv > 0 THEN bps END, 200), 0.5), 200) + 1) * 1e2, 3) AS spread, round(trade * CASE WHEN adv > 0 THEN coalesce(vol, 0.03) * sqrt(trade * 1e8 / adv) ELSE 0.02 END * 1e4, 3) AS impact FROM s""")
def trading_costs(spark, sf_dir):
    """Costs of trades of two per cent, in basis points and hundredths of the portfolio; bars date from before the fitted years."""
    model = costs.CostModel(aum=1e8)
    x = _returns(spark, sf_dir).where("not delisted").withColumn("adv", F.col("adv") * 1e3)
    t, adv, vol = F.lit(0.02), F.col("adv"), F.col("vol")
    return x.select("security_id", "date", r(model.spread_cost(t, F.year("date") + 9, adv, vol) * 1e6, 3).alias("spread"), r(model.impact_cost(t, adv, vol) * 1e4, 3).alias("impact"))


@register("commissions", "SELECT l_orderkey, l_linenumber, round(least(greatest(l_quantity * 0.0035, 0.35), l_extendedprice * 0.01), 4) AS dollars FROM lineitem")
def commissions(spark, sf_dir):
    l = views.table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", r(costs.commission(F.col("l_quantity"), F.col("l_extendedprice") / F.col("l_quantity"))).alias("dollars"))


_TWO = _RET + """, two AS (SELECT date, sum(ret * close_raw) / sum(close_raw) AS net, avg(ret) AS ret FROM returns WHERE NOT delisted AND ret IS NOT NULL GROUP BY date)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price-weighted series and the plain mean as its market."""
    x = _returns(spark, sf_dir).where("not delisted and ret is not null")
    return x.groupBy("date").agg((F.sum(F.col("ret") * F.col("close_raw")) / F.sum("close_raw")).alias("net"), F.avg("ret").alias("ret"))


@register("market_beta", _TWO + " SELECT round(covar_samp(net, ret) / var_samp(ret), 4) AS beta, round((avg(net) - covar_samp(net, ret) / var_samp(ret) * avg(ret)) * 252, 4) AS alpha FROM two")
def market_beta(spark, sf_dir):
    x = _two(spark, sf_dir)
    return analytics.market_beta(x.select("date", "net"), x.select("date", "ret")).select(r("beta").alias("beta"), r("alpha").alias("alpha"))


@register("relative_drawdown", _TWO + ", rel AS (SELECT date, exp(sum(ln((1 + net) / (1 + ret))) OVER (ORDER BY date)) AS nav FROM two), dd AS (SELECT nav / greatest(max(nav) OVER (ORDER BY date), 1) - 1 AS dd FROM rel) SELECT round(min(dd), 4) AS relative_drawdown FROM dd")
def relative_drawdown(spark, sf_dir):
    x = _two(spark, sf_dir)
    return analytics.relative_drawdown(x.select("date", "net"), x.select("date", "ret")).select(r("relative_drawdown").alias("relative_drawdown"))


@register("stats_by_period", _RET + _DAILY + ", p AS (SELECT *, CAST(year(date) // 2 * 2 AS INTEGER) AS period FROM daily), n AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY period ORDER BY date)) AS nav FROM p), d AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY period ORDER BY date), 1) - 1 AS dd FROM n) SELECT period, count(*) AS days, round(stddev_samp(net) * sqrt(252), 4) AS annual_vol, round(avg(net) / stddev_samp(net) * sqrt(252), 4) AS sharpe, round(avg(net) / stddev_samp(net) * sqrt(count(*)), 4) AS t, round(min(dd), 4) AS max_drawdown FROM d GROUP BY period")
def stats_by_period(spark, sf_dir):
    daily = _returns(spark, sf_dir).where("not delisted and ret is not null").groupBy("date").agg(F.avg("ret").alias("net"))
    return analytics.stats_by_period(daily, 2).select("period", "days", *[r(c).alias(c) for c in ("annual_vol", "sharpe", "t", "max_drawdown")])


_CODE = "(p_partkey * 7 + p_size * 131) % 10000"


@register("industry_sectors", "SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL " + " ".join(f"WHEN {' OR '.join(f'{_CODE} BETWEEN {a} AND {b}' for a, b in spans)} THEN '{name}'" for name, spans in xsection.FF12.items()) + " ELSE 'Other' END AS sector FROM part")
def industry_sectors(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", xsection.sic_sector(F.expr(f"case when p_size <> 7 then {_CODE} end")).alias("sector"))


@register("trade_classes", f"""WITH t AS (SELECT event_id, value AS price, CASE WHEN event_id % 13 = 0 THEN NULL ELSE [event_id % 60, user_id % 45] END AS c, CASE WHEN event_id % 50 = 0 THEN 1 WHEN event_id % 3 = 0 THEN 0 END AS correction FROM events)
SELECT event_id, CASE WHEN coalesce(correction, 0) <> 0 OR coalesce(price <= 0, true) THEN 'excluded' WHEN list_has_any(c, {ms.OPENING}) THEN 'opening' WHEN list_has_any(c, {ms.CLOSING}) THEN 'closing' WHEN list_has_any(c, {ms.EXCLUDED}) THEN 'excluded' ELSE 'continuous' END AS class, coalesce(list_has_any(c, {ms.ODD_LOT}), false) AS odd_lot FROM t""")
def trade_classes(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(
        "event_id", F.col("value").alias("price"), F.lit(100.0).alias("size"), F.expr("case when event_id % 13 <> 0 then array(smallint(event_id % 60), smallint(user_id % 45)) end").alias("conditions"),
        F.expr("case when event_id % 50 = 0 then 1 when event_id % 3 = 0 then 0 end").alias("correction"),
    )
    return ms.classify_trades(e).select("event_id", "class", "odd_lot")


@register("usable_quotes", "SELECT event_id, coalesce(value > 0 AND ask >= value AND ask - value <= 0.25 * (ask + value), false) AS usable FROM (SELECT event_id, value, value * (0.9 + 0.1 * (event_id % 10)) AS ask FROM events)")
def usable_quotes(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") * (0.9 + 0.1 * (F.col("event_id") % 10))).alias("ask"))
    return e.select("event_id", ms.usable_quote(F.col("value"), F.col("ask")).alias("usable"))


@register("cost_buckets", f"""WITH {views.MINUTES}, m AS (SELECT security_id, date, (hour(timestamp) * 60 + minute(timestamp)) // 30 AS bucket, CASE WHEN transactions > 0 AND minute(timestamp) % 7 <> 0 THEN high - low END AS e, close AS q, transactions AS n, close * volume AS dv, 60.0 - minute(timestamp) % 20 AS s FROM minutes)
SELECT security_id, date, bucket, round(sum(e * dv) / sum(CASE WHEN e IS NOT NULL THEN dv END), 4) AS effective, round(sum(q * s) / sum(s), 4) AS quoted_half_spread, CAST(sum(n) AS BIGINT) AS n_trades, round(sum(dv), 2) AS dollar_volume FROM m GROUP BY 1, 2, 3""")
def cost_buckets(spark, sf_dir):
    at = F.minute("timestamp")
    m = views.minutes(spark, sf_dir).select(
        "security_id", "date", (F.hour("timestamp") * 60 + at).alias("minute"), F.when(at % 7 != 0, F.col("high") - F.col("low")).alias("effective"), F.col("close").alias("quoted_half_spread"),
        F.col("transactions").alias("n_trades"), (F.col("close") * F.col("volume")).alias("dollar_volume"), (60.0 - at % 20).alias("seconds"),
    )
    b = ms.buckets(m, 30, ["security_id", "date"])
    return b.select("security_id", "date", "bucket", r("effective").alias("effective"), r("quoted_half_spread").alias("quoted_half_spread"), "n_trades", r("dollar_volume", 2).alias("dollar_volume"))


@register("yearly_lags", f"""WITH {views.BARS}, m AS (SELECT security_id, max(date) AS date, arg_max(close, date) AS close, year(max(date)) * 12 + month(max(date)) AS m FROM bars GROUP BY security_id, date_trunc('month', date))
SELECT a.security_id, a.date, round(a.close, 4) AS close, round(b.close, 4) AS close_lag FROM m a LEFT JOIN m b ON a.security_id = b.security_id AND a.m = b.m + 12""")
def yearly_lags(spark, sf_dir):
    m = views.bars(spark, sf_dir).groupBy("security_id", F.trunc("date", "month").alias("_t")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close")).drop("_t")
    return signals.add_lags(m, ["close"]).select("security_id", "date", r("close").alias("close"), r("close_lag").alias("close_lag"))


@register("price_statistics", f"""WITH {views.BARS}, x AS (SELECT *, CASE WHEN close / lag(close) OVER w - 1 > 3 THEN 0 ELSE close / lag(close) OVER w - 1 END AS ret FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY date)),
k AS (SELECT date, avg(ret) AS m FROM x GROUP BY date), y AS (SELECT x.*, k.m AS m0, CASE WHEN ret IS NOT NULL THEN k.m END AS m, CASE WHEN k.m IS NOT NULL THEN ret END AS q FROM x JOIN k USING (date))
SELECT security_id, date, round(CASE WHEN count(ret) OVER a >= 50 THEN stddev_samp(ret) OVER a END * sqrt(252), 3) AS volatility_3m, round(close / CASE WHEN count(close) OVER h >= 200 THEN max(close) OVER h END, 4) AS high_52w,
round(CASE WHEN count(abs(ret) / (close * volume)) OVER a >= 50 THEN avg(abs(ret) / (close * volume)) OVER a END * 1e6, 3) AS illiquidity,
round(CASE WHEN count(m) OVER h >= 200 THEN (avg(q * m) OVER h - avg(q) OVER h * avg(m) OVER h) / (avg(m * m) OVER h - avg(m) OVER h * avg(m) OVER h) END, 3) + 0.0 AS beta_12m
FROM y WINDOW a AS (PARTITION BY security_id ORDER BY date ROWS {signals.VOL_WINDOW - 1} PRECEDING), h AS (PARTITION BY security_id ORDER BY date ROWS {signals.HIGH_WINDOW - 1} PRECEDING)""")
def price_statistics(spark, sf_dir):
    b = signals.total_return_index(views.bars(spark, sf_dir).withColumn("div_factor", F.lit(1.0)))
    out = signals.rolling_stats(b, b.groupBy("date").agg(F.avg("ret").alias("market_ret")))
    return out.select("security_id", "date", r("volatility_3m", 3).alias("volatility_3m"), r("high_52w").alias("high_52w"), r("illiquidity", 3).alias("illiquidity"), (r("beta_12m", 3) + 0.0).alias("beta_12m"))


@register("short_interest_by_security", f"""WITH {views.BARS}, s AS (SELECT o_custkey % 100 AS security_id, CAST(o_orderdate AS DATE) AS settlement_date, CAST(sum(o_orderkey) AS DOUBLE) AS short_interest FROM orders GROUP BY 1, 2), b AS (SELECT security_id, date, close, sum(close * volume) OVER (PARTITION BY date) AS cap FROM bars),
j AS (SELECT s.*, CASE WHEN settlement_date - date <= 7 THEN close END AS close, CASE WHEN settlement_date - date <= 7 THEN cap END AS cap FROM s ASOF LEFT JOIN b ON s.security_id = b.security_id AND s.settlement_date >= b.date)
SELECT security_id, settlement_date, round(short_interest * close, 0) AS si_value, round(short_interest * close / cap, 4) AS si_pct_market_cap FROM j""")
def short_interest_by_security(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("k"), F.to_date("o_orderdate").alias("settlement_date")).agg(F.sum("o_orderkey").cast("double").alias("short_interest"))
    named = lambda c: F.concat(F.lit("T"), F.col(c).cast("string"))
    windows = o.select("k").distinct().select(F.col("k").alias("security_id"), named("k").alias("ticker"), F.to_date(F.lit("1990-01-01")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    b = views.bars(spark, sf_dir).select("security_id", "date", F.col("close").alias("close_raw"), F.sum(F.col("close") * F.col("volume")).over(W.partitionBy("date")).alias("issuer_market_cap"))
    out = marketcap.short_interest(o.select(named("k").alias("symbol"), "settlement_date", "short_interest"), windows, b)
    return out.select("security_id", "settlement_date", r("si_value", 0).alias("si_value"), r("si_pct_market_cap").alias("si_pct_market_cap"))


@register("per_share_units", f"""WITH {views.SPLITS}, v AS (SELECT o_orderkey, o_custkey % 100 AS security_id, o_totalprice AS value, CAST(o_orderdate AS DATE) AS filed FROM orders)
SELECT o_orderkey, round(value / (SELECT coalesce(product(split_to / split_from), 1) FROM splits s WHERE s.security_id = v.security_id AND s.execution_date > v.filed), 3) AS value_now FROM v""")
def per_share_units(spark, sf_dir):
    v = views.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("security_id"), F.col("o_totalprice").alias("value"), F.to_date("o_orderdate").alias("filed"))
    return marketcap.per_share_units(v, marketcap.split_events(views.splits(spark, sf_dir))).select("o_orderkey", r("value_now", 3).alias("value_now"))


@register("adjusted_returns_by_sector", _FACTORS + ", x AS (SELECT security_id % 5 AS sector, CAST(year(date) AS INTEGER) AS year, ln(close * split_factor * div_factor) - ln(lag(close * split_factor * div_factor) OVER (PARTITION BY security_id ORDER BY date)) AS x FROM adj) SELECT sector, year, round(avg(x), 5) + 0.0 AS mean, count(x) AS n FROM x GROUP BY 1, 2")
def adjusted_returns_by_sector(spark, sf_dir):
    x = F.ln(F.col("close") / F.lag("close").over(W.partitionBy("security_id").orderBy("date")))
    b = _adjusted(spark, sf_dir).select((F.col("security_id") % 5).alias("sector"), F.year("date").alias("year"), x.alias("x"))
    return b.groupBy("sector", "year").agg((r(F.avg("x"), 5) + 0.0).alias("mean"), F.count("x").alias("n"))
