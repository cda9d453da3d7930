"""Queries over events as minute bars and ticks: session clock, grid, features, summaries, spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intraday as op
from ..operators import microstructure as ms
from . import views
from .queries_market import r
from .registry import register

_CLOCK = f"""WITH {views.MINUTES}, {views.SESSIONS}, clock AS (
    SELECT date, bar, market_open + INTERVAL 30 MINUTE * (bar + 1) AS bar_end, (bar + 1) * 30 AS minutes_from_open FROM (SELECT *, unnest(range(16)) AS bar FROM sessions)
), b30 AS (
    SELECT m.date AS date, security_id, CAST(floor((epoch(timestamp) - epoch(market_open)) / 1800) AS INTEGER) AS bar, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close,
           sum(volume) AS volume, sum((high + low + close) / 3 * volume) / sum(volume) AS vwap, sum(transactions) AS transactions
    FROM minutes m JOIN sessions s ON m.date = s.date WHERE timestamp >= market_open AND timestamp < market_close GROUP BY 1, 2, 3
), g AS (
    SELECT d.date, d.security_id, c.bar, c.minutes_from_open, b.close IS NULL AS stale, b.open AS o, b.high AS h, b.low AS l, coalesce(b.volume, 0) AS volume, b.vwap,
           last_value(b.close IGNORE NULLS) OVER (PARTITION BY d.security_id, d.date ORDER BY c.bar) AS close
    FROM (SELECT DISTINCT date, security_id FROM b30) d JOIN clock c ON c.date = d.date LEFT JOIN b30 b ON b.date = d.date AND b.security_id = d.security_id AND b.bar = c.bar
), grid AS (SELECT date, security_id, bar, minutes_from_open, stale, coalesce(o, close) AS open, coalesce(h, close) AS high, coalesce(l, close) AS low, close, volume, vwap FROM g)"""


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.resample(views.minutes(spark, sf_dir), views.sessions(spark, sf_dir), 30)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.grid(_bars(spark, sf_dir), views.sessions(spark, sf_dir), 30)


@register("session_clock", _CLOCK + " SELECT date, bar, CAST(epoch(bar_end) AS BIGINT) AS bar_end, CAST(minutes_from_open AS INTEGER) AS minutes_from_open FROM clock")
def session_clock(spark, sf_dir):
    return op.clock(views.sessions(spark, sf_dir), 30).select("date", "bar", F.unix_timestamp("bar_end").alias("bar_end"), "minutes_from_open")


@register("resample_bars", _CLOCK + " SELECT date, security_id, bar, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume, round(vwap, 4) AS vwap, CAST(transactions AS BIGINT) AS transactions FROM b30")
def resample_bars(spark, sf_dir):
    return _bars(spark, sf_dir).select("date", "security_id", "bar", *[r(c).alias(c) for c in ("open", "high", "low", "close")], "volume", r("vwap").alias("vwap"), "transactions")


@register("grid_bars", _CLOCK + " SELECT date, security_id, bar, stale, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM grid")
def grid_bars(spark, sf_dir):
    return _grid(spark, sf_dir).select("date", "security_id", "bar", "stale", *[r(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


@register("intraday_features", _CLOCK + """, p AS (SELECT *, lag(close) OVER w AS prior, first_value(open IGNORE NULLS) OVER w AS first_open, sum(coalesce(vwap, close) * volume) OVER w AS pv, sum(volume) OVER w AS cv, max(high) OVER w AS hi, min(low) OVER w AS lo
      FROM grid WINDOW w AS (PARTITION BY security_id, date ORDER BY bar)), q AS (
    SELECT *, CASE WHEN prior IS NULL AND close IS NOT NULL THEN CASE WHEN open > 0 THEN close / open - 1 END ELSE CASE WHEN prior > 0 THEN close / prior - 1 END END AS ret_bar,
      CASE WHEN minutes_from_open >= 60 THEN max(CASE WHEN minutes_from_open <= 60 THEN high END) OVER (PARTITION BY security_id, date) END AS or_high, CASE WHEN minutes_from_open >= 60 THEN min(CASE WHEN minutes_from_open <= 60 THEN low END) OVER (PARTITION BY security_id, date) END AS or_low,
      CASE WHEN count(cv) OVER (PARTITION BY security_id, bar ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 5 THEN avg(cv) OVER (PARTITION BY security_id, bar ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS mean_cv FROM p)
SELECT date, security_id, bar, round(ret_bar, 4) AS ret_bar, round(CASE WHEN first_open > 0 THEN close / first_open - 1 END, 4) AS ret_open, round(CASE WHEN pv > 0 AND cv > 0 THEN close / (pv / cv) - 1 END, 4) AS vwap_dev,
       round(CASE WHEN close IS NOT NULL THEN sqrt(sum(pow(ln(1 + coalesce(CASE WHEN ret_bar > -1 THEN ret_bar END, 0)), 2)) OVER (PARTITION BY security_id, date ORDER BY bar)) END, 4) AS rvol,
       round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END, 4) AS range_pos, round(or_high, 4) AS or_high, round(or_low, 4) AS or_low,
       CASE WHEN close > or_high THEN 1 WHEN close < or_low THEN -1 WHEN or_high IS NOT NULL AND close IS NOT NULL THEN 0 END AS or_break, round(CASE WHEN mean_cv > 0 THEN cv / mean_cv END, 4) AS vol_ratio FROM q""")
def intraday_features(spark, sf_dir):
    f = op.features(_grid(spark, sf_dir), or_minutes=60, lookback=10)
    return f.select("date", "security_id", "bar", *[r(c).alias(c) for c in ("ret_bar", "ret_open", "vwap_dev", "rvol", "range_pos", "or_high", "or_low")], "or_break", r("vol_ratio").alias("vol_ratio"))


@register("intraday_summaries", _CLOCK + """, i AS (SELECT m.*, (epoch(timestamp) - epoch(market_open)) / 60 AS mi, (epoch(market_close) - epoch(timestamp)) / 60 AS lf FROM minutes m JOIN sessions s ON m.date = s.date WHERE timestamp >= market_open AND timestamp < market_close)
SELECT date, security_id, round(arg_min(open, timestamp), 4) AS first_open, round(arg_max(close, timestamp), 4) AS last_close, sum(volume) AS volume, count(*) AS n_minutes, round(sum((high + low + close) / 3 * volume) / sum(volume), 4) AS vwap,
       round(arg_max(close, timestamp) FILTER (mi < 30), 4) AS price_30, round(arg_max(close, timestamp) FILTER (lf > 30), 4) AS price_last30, coalesce(sum(volume) FILTER (mi < 30), 0) AS volume_first30 FROM i GROUP BY 1, 2""")
def intraday_summaries(spark, sf_dir):
    s = op.summarize(views.minutes(spark, sf_dir), views.sessions(spark, sf_dir))
    return s.select("date", "security_id", r("first_open").alias("first_open"), r("last_close").alias("last_close"), "volume", "n_minutes", *[r(c).alias(c) for c in ("vwap", "price_30", "price_last30")], "volume_first30")


_OPEN, _CLOSE = 1704067200 * ms.SECOND, (1704067200 + 31 * 86400) * ms.SECOND


@register("trade_quote_match", f"""WITH {views.TICKS}, q1 AS (SELECT ticker, ts, bid, ask FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY bid DESC, ask DESC) AS n FROM quotes) WHERE n = 1),
m AS (SELECT t.ticker, t.t, t.sequence_number, t.price, t.size, (q.bid + q.ask) / 2 AS mid FROM trades t ASOF LEFT JOIN q1 q ON t.ticker = q.ticker AND t.t > q.ts),
m1 AS (SELECT m.*, (q.bid + q.ask) / 2 AS mid_1 FROM m ASOF LEFT JOIN q1 q ON m.ticker = q.ticker AND least(m.t + 60000000000, {_CLOSE}) >= q.ts)
SELECT ticker, sequence_number, round(price, 4) AS price, round(mid, 4) AS mid, round(mid_1, 4) AS mid_1 FROM m1""")
def trade_quote_match(spark, sf_dir):
    quotes, trades = views.ticks(spark, sf_dir)
    out = ms.match(trades, quotes, _CLOSE, horizons=(1,))
    return out.select("ticker", "sequence_number", r("price").alias("price"), r("mid").alias("mid"), r("mid_1").alias("mid_1"))


@register("trade_quote_match_skewed", f"""WITH {views.TICKS}, q1 AS (SELECT ticker, ts, bid, ask FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY bid DESC, ask DESC) AS n FROM quotes) WHERE n = 1)
SELECT t.ticker AS ticker, count(*) AS n, count(q.bid) AS matched, round(sum(q.bid), 3) AS total FROM trades t ASOF LEFT JOIN q1 q ON t.ticker = q.ticker AND t.t > q.ts GROUP BY t.ticker""")
def trade_quote_match_skewed(spark, sf_dir):
    quotes, trades = views.ticks(spark, sf_dir)
    out = ms.asof_skewed(trades, quotes, "t", "ts", "ticker", 6 * 3600 * ms.SECOND, payload=["bid", "ask"])
    return out.groupBy("ticker").agg(F.count("*").alias("n"), F.count("bid").alias("matched"), r(F.sum("bid"), 3).alias("total"))


_SIGNED = f"""WITH {views.TICKS}, q1 AS (SELECT ticker, ts, bid, ask FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY bid DESC, ask DESC) AS n FROM quotes) WHERE n = 1),
m AS (SELECT t.ticker, t.t, t.sequence_number, t.price, t.size, (q.bid + q.ask) / 2 AS mid FROM trades t ASOF LEFT JOIN q1 q ON t.ticker = q.ticker AND t.t > q.ts),
k AS (SELECT *, CASE WHEN price > lag(price) OVER w THEN 1 WHEN price < lag(price) OVER w THEN -1 END AS tick FROM m WINDOW w AS (PARTITION BY ticker ORDER BY t, sequence_number)),
s AS (SELECT *, CASE WHEN price > mid THEN 1 WHEN price < mid THEN -1 ELSE coalesce(last_value(tick IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t, sequence_number), 0) END AS sign FROM k),
x AS (SELECT *, CASE WHEN abs(price - mid) / mid <= 0.25 THEN abs(price - mid) / mid END AS eff, price * size AS dollars FROM s)"""


@register("effective_spreads", _SIGNED + " SELECT ticker, round(sum(eff * dollars) / sum(CASE WHEN eff IS NOT NULL THEN dollars END), 4) AS effective, count(*) AS n_trades, count(eff) AS n_matched, round(sum(dollars), 2) AS dollar_volume, sum(sign * size) AS net_volume FROM x GROUP BY ticker")
def effective_spreads(spark, sf_dir):
    quotes, trades = views.ticks(spark, sf_dir)
    signed = ms.sign_trades(ms.match(trades, quotes, _CLOSE, horizons=()))
    out = ms.aggregate_trades(ms.trade_measures(signed, ()), ["ticker"], ())
    return out.select("ticker", r("effective").alias("effective"), "n_trades", "n_matched", r("dollar_volume", 2).alias("dollar_volume"), "net_volume")


@register("quoted_spreads_by_hour", f"""WITH {views.TICKS}, e AS (SELECT ticker, ts, bid, ask, coalesce(lead(ts) OVER (PARTITION BY ticker ORDER BY ts, bid, ask), {_CLOSE}) AS nxt FROM quotes),
c AS (SELECT ticker, greatest(ts, {_OPEN}) AS a, least(nxt, {_CLOSE}) AS b, (ask - bid) / 2 / ((bid + ask) / 2) AS hs FROM e WHERE least(nxt, {_CLOSE}) > greatest(ts, {_OPEN}))
SELECT ticker, round(sum(hs * (b - a)) / sum(b - a), 5) AS quoted_half_spread, round(sum((b - a) / 1e9), 2) AS seconds FROM c GROUP BY ticker""")
def quoted_spreads_by_hour(spark, sf_dir):
    quotes, _ = views.ticks(spark, sf_dir)
    m = ms.daily_from_minutes(ms.quote_minutes(quotes, _OPEN, _CLOSE))
    return m.select("ticker", r("quoted_half_spread", 5).alias("quoted_half_spread"), r("seconds", 2).alias("seconds"))


@register("interpolated_seconds", f"""WITH {views.TICKS}, i AS (SELECT ticker, event_id, t // 1000000000 AS s, row_number() OVER (PARTITION BY ticker, t // 1000000000 ORDER BY event_id) AS i, count(*) OVER (PARTITION BY ticker, t // 1000000000) AS n FROM ticks)
SELECT ticker, event_id, s * 1000000000 + ((2 * i - 1) * 1000000000) // (2 * n) AS t FROM i""")
def interpolated_seconds(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").where("value > 0").select("event_id", (F.col("user_id") % 20).alias("ticker"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t"))
    return ms.interpolate_seconds(e, "t", "event_id").select("ticker", "event_id", "t")
