"""Queries over portfolios, risk, calibration, orders and sources on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import analytics, backtest, calibrate, fundamentals, identity, names, orders, project, risk, simulate
from ..operators import marketcap as mc
from ..operators import microstructure as ms
from ..sources import readers, store
from ..streaming import capture
from . import views
from .queries_market import _returns, r
from .registry import register


def _monthly_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bars(spark, sf_dir)
    ends = F.broadcast(views.month_ends(views.calendar(b)))
    return backtest.quantile_weights(b.join(ends, "date", "left_semi").select("security_id", "date", F.col("volume").alias("score")), q=0.3)


_WEIGHTS = f"""{views.BARS}, m AS (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM bars) GROUP BY date_trunc('month', date)),
pw AS (SELECT security_id, date, (row_number() OVER (PARTITION BY date ORDER BY volume, security_id) - 0.5) / count(*) OVER (PARTITION BY date) AS p FROM bars JOIN m USING (date)),
lw AS (SELECT *, CASE WHEN p > 0.7 THEN 1 WHEN p <= 0.3 THEN -1 END AS leg FROM pw), w AS (SELECT security_id, date, leg / CAST(count(*) OVER (PARTITION BY date, leg) AS DOUBLE) AS weight FROM lw WHERE leg IS NOT NULL)"""


@register("portfolio_exposures", f"WITH {_WEIGHTS} SELECT date, round(sum(abs(weight)), 6) AS gross, round(sum(weight), 6) + 0.0 AS net, count(*) AS names FROM w GROUP BY date")
def portfolio_exposures(spark, sf_dir):
    w = _monthly_weights(spark, sf_dir)
    sectors = w.select("security_id").distinct().withColumn("sector", F.concat(F.lit("s"), (F.col("security_id") % 5).cast("string")))
    return analytics.exposures(w, sectors).select("date", r("gross", 6).alias("gross"), (r("net", 6) + 0.0).alias("net"), "names")


@register("backtest_daily")
def backtest_daily(spark, sf_dir):
    """The whole engine: monthly long-short book with 10 bp of costs."""
    daily, _ = backtest.run(_monthly_weights(spark, sf_dir), _returns(spark, sf_dir), cost_bps=10.0)
    return daily.select("date", *[r(c, 6).alias(c) for c in ("gross", "cost", "net")])


@register("execution_dates", f"WITH {views.BARS}, m AS (SELECT max(date) AS signal_date FROM (SELECT DISTINCT date FROM bars) GROUP BY date_trunc('month', date)), d AS (SELECT date, lead(date, 2) OVER (ORDER BY date) AS later FROM (SELECT DISTINCT date FROM bars)) SELECT signal_date, later AS date FROM m JOIN d ON d.date = m.signal_date WHERE later IS NOT NULL")
def execution_dates(spark, sf_dir):
    days = views.calendar(views.bars(spark, sf_dir))
    return backtest.execution_dates(views.month_ends(days), days, lag=2)


@register("capped_weights")
def capped_weights(spark, sf_dir):
    w = _monthly_weights(spark, sf_dir).where("weight > 0")
    uneven = w.withColumn("weight", F.col("weight") * (1 + F.col("security_id") % 7))
    scaled = uneven.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy("date")))
    return backtest.cap_weights(scaled, 0.06).withColumn("weight", r("weight", 8))


@register("benchmark_weights", f"WITH {views.BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, security_id) AS n FROM bars) SELECT date, security_id, round(volume / sum(volume) OVER (PARTITION BY date), 8) AS weight FROM t WHERE n <= 5")
def benchmark_weights(spark, sf_dir):
    p = views.bars(spark, sf_dir).withColumnRenamed("volume", "issuer_market_cap")
    return project.benchmark(p, 5).withColumn("weight", r("weight", 8))


@register("signal_dates", f"WITH {views.BARS} SELECT max(date) AS date FROM (SELECT DISTINCT date FROM bars WHERE day(date) <= 15) GROUP BY date_trunc('month', date)")
def signal_dates(spark, sf_dir):
    return project.signal_dates(views.bars(spark, sf_dir), "mid_month")


def _exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bars(spark, sf_dir)
    ends = F.broadcast(views.month_ends(views.calendar(b)))
    p = b.join(ends, "date", "left_semi").select("date", "security_id", (F.col("volume") * 1e6).alias("issuer_market_cap"), (F.col("security_id") % 4).cast("string").alias("sector"), F.col("close").alias("value"), (F.col("high") / F.col("low")).alias("range"))
    return risk.build_exposures(p, {"style_value": ["value"], "style_range": ["range"]})


@register("risk_exposures")
def risk_exposures(spark, sf_dir):
    return _exposures(spark, sf_dir).select("date", "security_id", r("style_value", 3).alias("style_value"), r("style_range", 3).alias("style_range"))


@register("factor_returns")
def factor_returns(spark, sf_dir):
    """Daily cross-sectional regressions of all days with enough names."""
    f, _ = risk.regressions(_returns(spark, sf_dir).where("not delisted"), _exposures(spark, sf_dir), ["style_value", "style_range"], least=10)
    return f.select("date", "factor", r("ret", 4).alias("ret"))


@register("clipped_returns", f"""WITH {views.BARS}, t AS (SELECT security_id, date, close / lag(close) OVER (PARTITION BY security_id ORDER BY date) - 1 AS ret FROM bars), x AS (SELECT * FROM t WHERE ret IS NOT NULL),
m AS (SELECT date, median(ret) AS md FROM x GROUP BY date), a AS (SELECT x.*, md, abs(ret - md) AS ad FROM x JOIN m USING (date)), s AS (SELECT date, median(ad) AS mad FROM a GROUP BY date)
SELECT security_id, date, round(least(greatest(ret, md - 5 * 1.4826 * mad), md + 5 * 1.4826 * mad), 4) + 0.0 AS ret FROM a JOIN s USING (date)""")
def clipped_returns(spark, sf_dir):
    b = views.bars(spark, sf_dir)
    w = W.partitionBy("security_id").orderBy("date")
    x = b.select("security_id", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")).where("ret is not null")
    return risk.robust_clip(x).select("security_id", "date", (r("ret") + 0.0).alias("ret"))


@register("decayed_means", f"""WITH {views.BARS}, n AS (SELECT security_id, date, close, row_number() OVER (PARTITION BY security_id ORDER BY date) AS n FROM bars)
SELECT a.security_id, a.date, round(CASE WHEN a.n >= 5 THEN sum(b.close * pow(0.5, (a.n - b.n) / 21.0)) / sum(pow(0.5, (a.n - b.n) / 21.0)) END, 3) AS mean FROM n a JOIN n b ON a.security_id = b.security_id AND b.n <= a.n GROUP BY a.security_id, a.date, a.n""")
def decayed_means(spark, sf_dir):
    from ..functions.windows import decayed_mean

    return decayed_mean(views.bars(spark, sf_dir).select("security_id", "date", "close"), "close", ["security_id"], "date", 21.0, "mean", 5).select("security_id", "date", r("mean", 3).alias("mean"))


@register("date_clusters", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + CAST(20 * (12 * year(o_orderdate) + month(o_orderdate) - 23900) AS INTEGER) AS date FROM orders), g AS (SELECT date, CASE WHEN date - lag(date) OVER (ORDER BY date) > 10 THEN 1 ELSE 0 END AS nw FROM d), c AS (SELECT date, sum(nw) OVER (ORDER BY date) AS cluster FROM g) SELECT CAST(cluster AS BIGINT) AS cluster, min(date) AS first, max(date) AS last, count(*) AS days FROM c GROUP BY cluster")
def date_clusters(spark, sf_dir):
    """Order dates with months moved twenty days apart."""
    moved = F.expr("date_add(to_date(o_orderdate), 20 * (12 * year(o_orderdate) + month(o_orderdate) - 23900))")
    return calibrate.clusters(views.table(spark, sf_dir, "orders").select(moved.alias("date")))


@register("impact_coefficients", f"""WITH {views.BARS}, t AS (SELECT security_id, date, close / lag(close) OVER (PARTITION BY security_id ORDER BY date) - 1 AS ret, close * volume AS dv, (open - close) * volume AS net FROM bars), x AS (SELECT *, median(ret) OVER (PARTITION BY date) AS md FROM t),
y AS (SELECT (ret - md) / 0.5 AS y, net / dv AS f, dv AS adv FROM x WHERE dv > 0), z AS (SELECT y, sign(f) * sqrt(abs(f)) AS z, CASE WHEN adv < 1e5 THEN 0 WHEN adv < 1e6 THEN 1 WHEN adv < 1e7 THEN 2 WHEN adv < 1e8 THEN 3 WHEN adv < 1e9 THEN 4 ELSE 5 END AS bucket FROM y WHERE abs(f) < 1 AND abs(y) < 10)
SELECT bucket, count(*) AS n, round(sum(z * y) / sum(z * z), 4) + 0.0 AS coefficient FROM z GROUP BY bucket""")
def impact_coefficients(spark, sf_dir):
    b = views.bars(spark, sf_dir)
    w = W.partitionBy("security_id").orderBy("date")
    f = b.select("security_id", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"), (F.col("close") * F.col("volume")).alias("adv"), F.lit(0.5).alias("vol"), ((F.col("open") - F.col("close")) * F.col("volume")).alias("net_dollars"))
    return calibrate.impact_table(f).select("bucket", "n", (r("coefficient") + 0.0).alias("coefficient"))


@register("spread_fit")
def spread_fit(spark, sf_dir):
    """The Poisson fit over all stock-days: one row of parameters."""
    b = _returns(spark, sf_dir).where("not delisted and adv is not null and vol is not null")
    inputs = b.select("security_id", "date", F.lit("stock").alias("class"), "adv", "vol", (1 + F.col("vol") * 20 + 1e6 / F.col("adv")).alias("eff_bps"), F.lit(0.0).alias("outside_share"), F.lit(50).alias("n_matched"))
    fit = calibrate.fit_spread(inputs, [1e5])
    return spark.createDataFrame([(round(fit.slope, 3), round(fit.vol_slope, 3), len(fit.levels))], "slope double, vol_slope double, years int")


@register("order_sheet")
def order_sheet(spark, sf_dir):
    b = views.bars(spark, sf_dir)
    last = views.latest(b, ["security_id"], [F.desc("date")])
    w = last.where("volume < 45").select("security_id", (F.when(F.col("security_id") % 2 == 0, 0.01).otherwise(-0.01)).alias("weight"))
    held = last.where("close < 1500").select("security_id", F.col("security_id").cast("int").alias("con_id"), (F.col("volume") * 10).cast("long").alias("shares"))
    book = last.select("security_id", F.col("security_id").cast("string").alias("ticker"), F.col("security_id").cast("int").alias("con_id"), F.when(F.col("security_id") % 7 == 0, "missing").otherwise("ok").alias("status"))
    market = last.select("security_id", F.col("close").alias("price"), (F.col("close") * F.col("volume") * 100).alias("adv"))
    s = orders.make_orders(w, held, book, market, 1e7, participation=0.1)
    return s.select("security_id", "target_shares", "held_shares", "shares", "order_status")


@register("live_trades_normalized", """SELECT CAST(user_id AS VARCHAR) AS ticker, round(value, 2) AS price, event_id AS sequence_number, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'purchase' AND value IS NOT NULL""")
def live_trades_normalized(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").where("event_type = 'purchase' and value is not null")
    ms_ = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    text = F.to_json(F.struct(F.lit("T").alias("ev"), F.col("user_id").cast("string").alias("sym"), ms_.alias("t"), F.col("value").alias("p"), F.col("event_id").alias("q"))).alias("value")
    out = capture.normalize(e.select(text), "T")
    return out.select("ticker", r("price", 2).alias("price"), "sequence_number", F.unix_millis("timestamp").alias("ms"))


@register("keyed_upsert", """WITH a AS (SELECT l_partkey AS k, max(l_orderkey) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1) SELECT k, v FROM b UNION ALL SELECT k, v FROM a WHERE k NOT IN (SELECT k FROM b)""")
def keyed_upsert(spark, sf_dir):
    old = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_orderkey").alias("v"))
    new = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return store.upsert(old, new, ["k"])


@register("short_volume_files", """SELECT CAST(o_orderdate AS DATE) AS date, 'S' || (o_custkey % 40) AS symbol, CAST(sum(o_custkey) AS DOUBLE) AS short_volume, CAST(sum(o_custkey + o_orderkey) AS DOUBLE) AS total_volume FROM orders GROUP BY 1, 2""")
def short_volume_files(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    line = F.concat_ws("|", F.date_format("o_orderdate", "yyyyMMdd"), F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")), F.col("o_custkey").cast("string"), F.lit("0"), (F.col("o_custkey") + F.col("o_orderkey")).cast("string"), F.element_at(F.array(F.lit("B"), F.lit("Q"), F.lit("N")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return readers.combine_facilities(readers.parse_short_volume(o.select(line.alias("value")))).select("date", "symbol", "short_volume", "total_volume")


@register("confirmed_splits", f"""WITH {views.BARS}, {views.SPLITS}, e AS (SELECT *, execution_date - 1 AS before FROM splits),
a AS (SELECT e.*, CASE WHEN before - b.date <= 10 THEN b.close END AS c0 FROM e ASOF LEFT JOIN bars b ON e.security_id = b.security_id AND e.before >= b.date), c AS (SELECT a.*, CASE WHEN b.date - execution_date <= 10 THEN b.close END AS c1 FROM a ASOF LEFT JOIN bars b ON a.security_id = b.security_id AND a.execution_date <= b.date)
SELECT security_id, execution_date, split_from, split_to FROM c WHERE NOT (abs(ln(split_to / split_from)) > ln(1.25) AND c0 IS NOT NULL AND c1 IS NOT NULL) OR abs(ln(c0 / c1) - ln(split_to / split_from)) < abs(ln(c0 / c1))""")
def confirmed_splits(spark, sf_dir):
    return identity.confirmed_splits(views.splits(spark, sf_dir), views.bars(spark, sf_dir).select("security_id", "date", "close"))


_PART_NAME = "upper(p_name || CASE p_size % 5 WHEN 0 THEN ' warrants' WHEN 1 THEN ' Series B Pref' WHEN 2 THEN ' 5.5% due 2030' ELSE '' END)"


@register("equity_screen", f"SELECT p_partkey, NOT regexp_matches({_PART_NAME}, '{names.NOT_EQUITY}') AND (p_partkey % 2 = 0 OR NOT regexp_matches({_PART_NAME}, '{names.NOT_EQUITY_UNTYPED}')) AS equity FROM part")
def equity_screen(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 5 == 0, "warrants").when(F.col("p_size") % 5 == 1, "Series B Pref").when(F.col("p_size") % 5 == 2, "5.5% due 2030")).alias("name"))
    return p.select("p_partkey", names.looks_equity(F.col("name"), F.lit("X"), F.when(F.col("p_partkey") % 2 == 0, "CS")).alias("equity"))


@register("share_counts_today", f"""WITH {views.SPLITS}, c AS (SELECT DISTINCT security_id, DATE '1994-06-30' + CAST(i * 300 AS INTEGER) AS "end", 1000.0 + security_id AS shares FROM splits, range(5) t(i))
SELECT c.security_id, c."end", round(shares * (SELECT coalesce(product(split_to / split_from), 1) FROM splits s WHERE s.security_id = c.security_id AND s.execution_date > c."end"), 4) AS shares_now FROM c""")
def share_counts_today(spark, sf_dir):
    sp = views.splits(spark, sf_dir)
    c = sp.select("security_id").distinct().select("security_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("security_id", F.expr("date_add(date'1994-06-30', i * 300)").alias("end"), (F.lit(1000.0) + F.col("security_id")).alias("shares"))
    out = mc.factor_after(c, mc.split_events(sp), "end", "f")
    return out.select("security_id", "end", r(F.col("shares") * F.col("f")).alias("shares_now"))


@register("newest_known_rows", f"""WITH {views.FACTS}, s AS (SELECT cik, "end", val, filed + 1 AS available_from FROM facts), t AS (SELECT *, max("end") OVER (PARTITION BY cik ORDER BY available_from, "end" ROWS UNBOUNDED PRECEDING) AS top FROM s) SELECT cik, count(*) AS n, max("end") AS last FROM t WHERE "end" >= top GROUP BY cik""")
def newest_known_rows(spark, sf_dir):
    s = views.facts(spark, sf_dir).select("cik", "end", "val", F.date_add("filed", 1).alias("available_from"))
    return fundamentals.newest_known(s).groupBy("cik").agg(F.count("*").alias("n"), F.max("end").alias("last"))


@register("weighted_minutes", f"WITH {views.MINUTES} SELECT security_id, date, round(sum(close * volume) / sum(volume), 4) AS price, count(*) AS n FROM minutes GROUP BY 1, 2")
def weighted_minutes(spark, sf_dir):
    m = views.minutes(spark, sf_dir)
    return m.groupBy("security_id", "date").agg(r(ms.weighted_mean(F.col("close"), F.col("volume"))).alias("price"), F.count("*").alias("n"))


@register("simulated_day_fills")
def simulated_day_fills(spark, sf_dir):
    """A strategy that buys every security at its second bar, flat by the close, over all days."""
    from ..operators import intraday

    g = intraday.grid(intraday.resample(views.minutes(spark, sf_dir), views.sessions(spark, sf_dir), 60), views.sessions(spark, sf_dir), 60)
    bars = g.where("close is not null").select("date", "bar_end", "security_id", "open", "close", "vwap", "volume", "stale")
    entry = bars.withColumn("_n", F.row_number().over(W.partitionBy("date", "security_id").orderBy("bar_end"))).where("_n = 1")
    tg = entry.select("date", "bar_end", "security_id", F.lit(0.05).alias("weight"), F.lit(None).cast("string").alias("auction"))
    aux = bars.groupBy("date", "security_id").agg(F.min_by("open", "bar_end").alias("open"), F.max_by("close", "bar_end").alias("close"))
    fills, _ = simulate.simulate(bars, tg, aux)
    return fills.select("date", "security_id", "kind", r("trade", 6).alias("trade"), r("price").alias("price"), "wait")
