"""Queries over daily bars: as-of joins, adjustment, signals, cross-section, weights, returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as win
from ..operators import adjust, analytics, backtest, signals, xsection
from ..operators.asof import asof_join, validity_join
from . import views
from .registry import register

R = 4  # decimals in results


def r(c, n: int = R):
    """Rounded as the oracles round: a shift far below the last digit keeps ties from falling to either side."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, n)


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items and, as quotes, the orders with a priority, both by customer-like key and date."""
    left = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", (F.col("l_suppkey") % 50).alias("k"), F.to_date("l_shipdate").alias("d"))
    right = views.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), F.to_date("o_orderdate").alias("rd"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("ok"))
    return left, views.latest(right, ["k", "rd"], [F.desc("v"), F.desc("ok")])


_ASOF = """WITH l AS (SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey % 50 AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem),
r AS (SELECT k, rd, v FROM (SELECT o_custkey % 50 AS k, CAST(o_orderdate AS DATE) AS rd, o_totalprice AS v,
      row_number() OVER (PARTITION BY o_custkey % 50, CAST(o_orderdate AS DATE) ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1)
"""


@register("asof_backward", _ASOF + "SELECT l.k AS k, count(*) AS n, count(r.v) AS matched, round(sum(r.v), 2) AS total FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.d >= r.rd GROUP BY l.k")
def asof_backward(spark, sf_dir):
    left, right = _rows(spark, sf_dir)
    return asof_join(left, right.drop("ok"), "d", "rd", ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("matched"), r(F.sum("v"), 2).alias("total"))


@register("asof_strict", _ASOF + "SELECT l.k AS k, count(*) AS n, count(r.v) AS matched, round(sum(r.v), 2) AS total FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.d > r.rd GROUP BY l.k")
def asof_strict(spark, sf_dir):
    left, right = _rows(spark, sf_dir)
    return asof_join(left, right.drop("ok"), "d", "rd", ["k"], strict=True).groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("matched"), r(F.sum("v"), 2).alias("total"))


@register("asof_forward", _ASOF + "SELECT l.k AS k, count(*) AS n, count(r.v) AS matched, round(sum(r.v), 2) AS total FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.d <= r.rd GROUP BY l.k")
def asof_forward(spark, sf_dir):
    left, right = _rows(spark, sf_dir)
    return asof_join(left, right.drop("ok"), "d", "rd", ["k"], strategy="forward").groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("matched"), r(F.sum("v"), 2).alias("total"))


@register("asof_tolerance", _ASOF + "SELECT l.k AS k, count(*) AS n, count(CASE WHEN l.d - r.rd <= 2 THEN r.v END) AS matched, round(sum(CASE WHEN l.d - r.rd <= 2 THEN r.v END), 2) AS total FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.d >= r.rd GROUP BY l.k")
def asof_tolerance(spark, sf_dir):
    left, right = _rows(spark, sf_dir)
    return asof_join(left, right.drop("ok"), "d", "rd", ["k"], tolerance=2).groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("matched"), r(F.sum("v"), 2).alias("total"))


@register("asof_nearest", _ASOF + """, b AS (SELECT l.*, r.rd AS bd, r.v AS bv FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.d >= r.rd),
f AS (SELECT b.*, r.rd AS fd, r.v AS fv FROM b ASOF LEFT JOIN r ON b.k = r.k AND b.d <= r.rd)
SELECT k, count(*) AS n, round(sum(CASE WHEN bd IS NULL OR (fd IS NOT NULL AND fd - d < d - bd) THEN fv ELSE bv END), 2) AS total FROM f GROUP BY k""")
def asof_nearest(spark, sf_dir):
    left, right = _rows(spark, sf_dir)
    return asof_join(left, right.drop("ok"), "d", "rd", ["k"], strategy="nearest").groupBy("k").agg(F.count("*").alias("n"), r(F.sum("v"), 2).alias("total"))


@register("validity_window_join", f"""WITH {views.ISSUES}, l AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem),
w AS (SELECT security_id AS k, DATE '1995-01-01' + CAST(n * 120 AS INTEGER) AS valid_from, DATE '1995-01-01' + CAST(n * 120 + 60 + p_size AS INTEGER) AS valid_to, p_brand FROM issues)
SELECT l.k AS k, w.p_brand AS p_brand, count(*) AS n FROM l LEFT JOIN w ON l.k = w.k AND l.d BETWEEN w.valid_from AND w.valid_to + 7 GROUP BY 1, 2""")
def validity_window_join(spark, sf_dir):
    left = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"))
    at = lambda extra: F.expr(f"date_add(date'1995-01-01', cast(n * 120 + {extra} as int))")
    w = views.issues(spark, sf_dir).select(F.col("security_id").alias("k"), at("0").alias("valid_from"), at("60 + p_size").alias("valid_to"), "p_brand")
    return validity_join(left, w, "d", ["k"], grace=7).groupBy("k", "p_brand").agg(F.count("*").alias("n"))


@register("daily_bars", f"WITH {views.BARS} SELECT security_id, date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM bars")
def daily_bars(spark, sf_dir):
    return views.bars(spark, sf_dir).withColumns({c: r(c) for c in ("open", "high", "low", "close")})


_FACTORS = f"""WITH {views.BARS}, {views.SPLITS}, {views.DIVIDENDS}, adj AS (
    SELECT b.*, (SELECT coalesce(product(split_from / split_to), 1) FROM splits s WHERE s.security_id = b.security_id AND s.execution_date > b.date) AS split_factor,
           (SELECT coalesce(product(factor), 1) FROM dividends v WHERE v.security_id = b.security_id AND v.ex_dividend_date > b.date) AS div_factor
    FROM bars b
)"""


@register("adjusted_bars", _FACTORS + " SELECT security_id, date, round(close * split_factor * div_factor, 6) AS close, round(open * split_factor * div_factor, 6) AS open, round(volume / split_factor, 2) AS volume, round(split_factor, 8) AS split_factor, round(div_factor, 8) AS div_factor FROM adj")
def adjusted_bars(spark, sf_dir):
    out = _adjusted(spark, sf_dir)
    return out.select("security_id", "date", r("close", 6).alias("close"), r("open", 6).alias("open"), r("volume", 2).alias("volume"), r("split_factor", 8).alias("split_factor"), r("div_factor", 8).alias("div_factor"))


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = adjust.split_factor_table(views.splits(spark, sf_dir), "security_id")
    dv = adjust.dividend_factor_table_from_steps(views.dividends(spark, sf_dir))
    return adjust.adjust_bars(views.bars(spark, sf_dir), sp, dv, "security_id")


@register("rolling_stats", f"""WITH {views.BARS}, x AS (SELECT security_id, date, close / lag(close) OVER w - 1 AS ret, close, close * volume AS dv FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY date))
SELECT security_id, date, round(CASE WHEN count(ret) OVER f >= 50 THEN stddev_samp(ret) OVER f END, 4) AS vol, round(avg(dv) OVER f, 2) AS adv, round(max(close) OVER f, 4) AS high,
       round(CASE WHEN count(close) OVER m >= 10 THEN median(close) OVER m END, 4) AS med
FROM x WINDOW f AS (PARTITION BY security_id ORDER BY date ROWS 62 PRECEDING), m AS (PARTITION BY security_id ORDER BY date ROWS 20 PRECEDING)""")
def rolling_stats(spark, sf_dir):
    b = views.bars(spark, sf_dir)
    w = W.partitionBy("security_id").orderBy("date")
    b = b.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).withColumn("dv", F.col("close") * F.col("volume"))
    f, m = win.frame(["security_id"], ["date"], 63), win.frame(["security_id"], ["date"], 21)
    return b.select(
        "security_id", "date", r(win.rolling(F.stddev_samp, F.col("ret"), f, 50)).alias("vol"), r(F.avg("dv").over(f), 2).alias("adv"), r(F.max("close").over(f)).alias("high"),
        r(win.rolling_median(F.col("close"), m, 10)).alias("med"),
    )


_SCORES = f"""WITH {views.BARS}, s AS (SELECT security_id, date, security_id % 5 AS sector, CASE WHEN security_id % 11 <> 3 THEN close END AS x, volume AS cap FROM bars)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bars(spark, sf_dir).select("security_id", "date", (F.col("security_id") % 5).alias("sector"), F.when(F.col("security_id") % 11 != 3, F.col("close")).alias("x"), F.col("volume").alias("cap"))


@register("zscore", _SCORES + " SELECT security_id, date, round(CASE WHEN stddev_samp(x) OVER d > 0 THEN (x - avg(x) OVER d) / stddev_samp(x) OVER d END, 4) AS z FROM s WINDOW d AS (PARTITION BY date)")
def zscore(spark, sf_dir):
    return _scores(spark, sf_dir).select("security_id", "date", r(win.zscore(F.col("x"), ["date"])).alias("z"))


@register("percentile_rank", _SCORES + """ SELECT security_id, date, round((rk + (peers - 1) / 2.0 - 0.5) / n, 6) AS p FROM (
    SELECT security_id, date, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY date, x IS NULL ORDER BY x) END AS rk, count(*) OVER (PARTITION BY date, x) AS peers, count(x) OVER (PARTITION BY date) AS n FROM s)""")
def percentile_rank(spark, sf_dir):
    return _scores(spark, sf_dir).select("security_id", "date", r(win.percentile_rank(F.col("x"), ["date"]), 6).alias("p"))


@register("winsorize", _SCORES + """, q AS (SELECT date, list_sort(list(x) FILTER (x IS NOT NULL)) AS v FROM s GROUP BY date)
SELECT security_id, date, round(CASE WHEN x IS NOT NULL THEN least(greatest(x, v[CAST(floor((len(v) - 1) * 0.05 + 0.5) AS INTEGER) + 1]), v[CAST(floor((len(v) - 1) * 0.95 + 0.5) AS INTEGER) + 1]) END, 4) AS x FROM s JOIN q USING (date)""")
def winsorize(spark, sf_dir):
    return win.winsorized(_scores(spark, sf_dir).select("security_id", "date", "x"), ["x"], 0.05, ["date"]).select("security_id", "date", r("x").alias("x"))


@register("neutralize", _SCORES + """, a AS (SELECT *, x - avg(x) OVER (PARTITION BY date, sector) AS e FROM s), b AS (
    SELECT *, CASE WHEN e IS NOT NULL AND cap > 0 THEN ln(cap) END AS l FROM a), c AS (
    SELECT *, l - avg(l) OVER (PARTITION BY date) AS dl, CASE WHEN l IS NOT NULL THEN e END - avg(CASE WHEN l IS NOT NULL THEN e END) OVER (PARTITION BY date) AS de FROM b)
SELECT security_id, date, round(de - CASE WHEN sum(dl * dl) OVER (PARTITION BY date) > 0 THEN sum(dl * de) OVER (PARTITION BY date) / sum(dl * dl) OVER (PARTITION BY date) ELSE 0 END * dl, 3) + 0.0 AS x FROM c""")
def neutralize(spark, sf_dir):
    out = xsection.neutralize(_scores(spark, sf_dir), "x", size="cap")
    return out.select("security_id", "date", (r("x", 3) + 0.0).alias("x"))


@register("quantile_weights", _SCORES + """, p AS (SELECT security_id, date, (row_number() OVER (PARTITION BY date ORDER BY x, security_id) - 0.5) / count(*) OVER (PARTITION BY date) AS p FROM s WHERE x IS NOT NULL),
l AS (SELECT *, CASE WHEN p > 0.8 THEN 1 WHEN p <= 0.2 THEN -1 END AS leg FROM p)
SELECT security_id, date, round(leg / CAST(count(*) OVER (PARTITION BY date, leg) AS DOUBLE), 8) AS weight FROM l WHERE leg IS NOT NULL""")
def quantile_weights(spark, sf_dir):
    return backtest.quantile_weights(_scores(spark, sf_dir), "x", 0.2).withColumn("weight", r("weight", 8))


@register("rank_weights", _SCORES + """, k AS (SELECT security_id, date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS k FROM s WHERE x IS NOT NULL),
c AS (SELECT security_id, date, k - avg(k) OVER (PARTITION BY date) AS c FROM k)
SELECT security_id, date, round(c / abs(sum(c) OVER (PARTITION BY date, sign(c))), 8) AS weight FROM c WHERE c <> 0""")
def rank_weights(spark, sf_dir):
    return backtest.rank_weights(_scores(spark, sf_dir), "x").withColumn("weight", r("weight", 8))


@register("top_n_weights", _SCORES + """ SELECT security_id, date, round(1.0 / count(*) OVER (PARTITION BY date), 8) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY x DESC, security_id) AS n FROM s WHERE x IS NOT NULL) WHERE n <= 10""")
def top_n_weights(spark, sf_dir):
    return backtest.top_n_weights(_scores(spark, sf_dir), 10, "x").withColumn("weight", r("weight", 8))


_RET = f"""WITH {views.BARS}, t AS (SELECT *, close / lag(close) OVER w - 1 AS raw, ln(close) AS c, (ln(high) + ln(low)) / 2 AS eta FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY date)),
u AS (SELECT *, coalesce(raw > 3.0, false) AS break, CASE WHEN raw > 3.0 THEN 0 ELSE raw END AS ret, 4 * (lag(c) OVER w - lag(eta) OVER w) * (lag(c) OVER w - eta) AS ar FROM t WINDOW w AS (PARTITION BY security_id ORDER BY date)),
v AS (SELECT security_id, date, ret, close AS close_raw, avg(close * volume) OVER a AS adv,
      CASE WHEN count(ret) OVER f >= 20 THEN stddev_samp(CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.5), 0.5) END) OVER f END AS vol,
      CASE WHEN count(ar) OVER f >= 20 THEN sqrt(greatest(avg(ar) OVER f, 0)) / 2 END AS half_spread, break,
      first_value(close) OVER w AS c0, lag(close, 63) OVER w AS c63, lead(date) OVER w IS NULL AS is_last
      FROM u WINDOW w AS (PARTITION BY security_id ORDER BY date), a AS (PARTITION BY security_id ORDER BY date ROWS 20 PRECEDING), f AS (PARTITION BY security_id ORDER BY date ROWS 62 PRECEDING)),
days AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM bars)),
returns AS (SELECT security_id, date, ret, close_raw, adv, vol, half_spread, break, false AS delisted FROM v
      UNION ALL SELECT v.security_id, d.nxt, CASE WHEN close_raw < 1 OR close_raw / coalesce(c63, c0) <= 0.5 THEN -0.3 ELSE 0 END, close_raw, adv, vol, half_spread, false, true FROM v JOIN days d USING (date) WHERE is_last AND d.nxt IS NOT NULL)"""


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bars(spark, sf_dir).withColumn("split_factor", F.lit(1.0)).withColumn("div_factor", F.lit(1.0))
    return backtest.daily_returns(b, views.calendar(b))


@register("daily_returns", _RET + " SELECT security_id, date, round(ret, 4) AS ret, round(close_raw, 4) AS close_raw, round(adv, 2) AS adv, round(vol, 4) AS vol, round(half_spread, 3) AS half_spread, break, delisted FROM returns")
def daily_returns(spark, sf_dir):
    return _returns(spark, sf_dir).withColumns({"ret": r("ret"), "close_raw": r("close_raw"), "adv": r("adv", 2), "vol": r("vol"), "half_spread": r("half_spread", 3)})


_IC = _SCORES + f""", m AS (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM bars) GROUP BY date_trunc('month', date)),
g AS (SELECT s.security_id, s.date, x, lead(close, 5) OVER (PARTITION BY security_id ORDER BY s.date) / close - 1 AS fwd FROM s JOIN bars b USING (security_id, date)),
p AS (SELECT g.* FROM g JOIN m USING (date) WHERE x IS NOT NULL AND fwd IS NOT NULL)"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bars(spark, sf_dir)
    w = W.partitionBy("security_id").orderBy("date")
    p = b.withColumn("fwd", F.lead("close", 5).over(w) / F.col("close") - 1).withColumn("x", F.when(F.col("security_id") % 11 != 3, F.col("close")))
    return p.join(F.broadcast(views.month_ends(views.calendar(b))), "date", "left_semi").select("security_id", "date", "x", "fwd")


@register("information_coefficients", _IC + """ SELECT date, count(*) AS n, round(corr(ra, rb), 4) + 0.0 AS ic FROM (
    SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS rb FROM p) GROUP BY date HAVING count(*) >= 5""")
def information_coefficients(spark, sf_dir):
    return backtest.information_coefficients(_panel(spark, sf_dir), "x", least=5).withColumn("ic", r("ic") + 0.0)


@register("quantile_returns", _IC + """ SELECT date, quantile, round(avg(fwd), 4) + 0.0 AS ret, count(*) AS names FROM (
    SELECT date, fwd, (row_number() OVER (PARTITION BY date ORDER BY x, security_id) - 1) * 5 // count(*) OVER (PARTITION BY date) + 1 AS quantile FROM p) GROUP BY 1, 2""")
def quantile_returns(spark, sf_dir):
    return backtest.quantile_returns(_panel(spark, sf_dir), "x", 5).withColumn("ret", r("ret") + 0.0)


@register("composite_score", _SCORES + """, z AS (SELECT security_id, date, CASE WHEN stddev_samp(x) OVER d > 0 THEN (x - avg(x) OVER d) / stddev_samp(x) OVER d END AS a, CASE WHEN stddev_samp(cap) OVER d > 0 THEN (cap - avg(cap) OVER d) / stddev_samp(cap) OVER d END AS b FROM s WINDOW d AS (PARTITION BY date))
SELECT security_id, date, round((coalesce(a, 0) * 2 - coalesce(b, 0)) / (CASE WHEN a IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END), 4) + 0.0 AS score FROM z WHERE a IS NOT NULL OR b IS NOT NULL""")
def composite_score(spark, sf_dir):
    out = xsection.composite(_scores(spark, sf_dir), {"x": 2.0, "cap": -1.0}, winsor=0.0)
    return out.where("score is not null").select("security_id", "date", (r("score") + 0.0).alias("score"))


_DAILY = """, daily AS (SELECT date, avg(ret) AS net FROM returns WHERE NOT delisted AND ret IS NOT NULL GROUP BY date)"""


@register("performance_stats", _RET + _DAILY + """, n AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY date)) AS nav FROM daily), d AS (SELECT *, nav / greatest(max(nav) OVER (ORDER BY date), 1) - 1 AS dd FROM n)
SELECT count(*) AS days, round(pow(exp(sum(ln(1 + net))), 252.0 / count(*)) - 1, 3) AS annual_return, round(stddev_samp(net) * sqrt(252), 4) AS annual_vol, round(avg(net) / stddev_samp(net) * sqrt(252), 4) AS sharpe, round(avg(net) / stddev_samp(net) * sqrt(count(*)), 4) AS t, round(min(dd), 4) AS max_drawdown FROM d""")
def performance_stats(spark, sf_dir):
    daily = _returns(spark, sf_dir).where("not delisted and ret is not null").groupBy("date").agg(F.avg("ret").alias("net"))
    s = analytics.stats(daily)
    return s.select("days", r("annual_return", 3).alias("annual_return"), *[r(c).alias(c) for c in ("annual_vol", "sharpe", "t", "max_drawdown")])


@register("returns_by_year", _RET + _DAILY + " SELECT CAST(year(date) AS INTEGER) AS year, round(exp(sum(ln(1 + net))) - 1, 3) AS ret, count(*) AS days FROM daily GROUP BY 1")
def returns_by_year(spark, sf_dir):
    daily = _returns(spark, sf_dir).where("not delisted and ret is not null").groupBy("date").agg(F.avg("ret").alias("net"))
    return analytics.by_year(daily).withColumn("ret", r("ret", 3))


@register("momentum_and_reversal", f"""WITH {views.BARS}, m AS (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM bars) GROUP BY date_trunc('month', date)),
p AS (SELECT DISTINCT m.date, b.security_id FROM m JOIN (SELECT DISTINCT security_id FROM bars) b ON true),
x AS (SELECT security_id, date, CASE WHEN close / lag(close) OVER w - 1 > 3 THEN 0 ELSE close / lag(close) OVER w - 1 END AS ret FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY date)),
t AS (SELECT security_id, date AS d, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY security_id ORDER BY date)) AS tr FROM x),
a AS (SELECT p.*, CASE WHEN p.date - t.d <= 10 THEN t.tr END AS t0 FROM p ASOF LEFT JOIN t ON p.security_id = t.security_id AND p.date >= t.d),
b1 AS (SELECT a.*, CASE WHEN CAST(a.date - INTERVAL 1 MONTH AS DATE) - t.d <= 10 THEN t.tr END AS t1 FROM a ASOF LEFT JOIN t ON a.security_id = t.security_id AND CAST(a.date - INTERVAL 1 MONTH AS DATE) >= t.d),
c AS (SELECT b1.*, CASE WHEN CAST(b1.date - INTERVAL 12 MONTH AS DATE) - t.d <= 10 THEN t.tr END AS t12 FROM b1 ASOF LEFT JOIN t ON b1.security_id = t.security_id AND CAST(b1.date - INTERVAL 12 MONTH AS DATE) >= t.d)
SELECT security_id, date, round(t1 / t12 - 1, 3) + 0.0 AS momentum_12_1, round(t0 / t1 - 1, 3) + 0.0 AS reversal_1m FROM c""")
def momentum_and_reversal(spark, sf_dir):
    b = views.bars(spark, sf_dir).withColumn("div_factor", F.lit(1.0))
    points = views.month_ends(views.calendar(b)).crossJoin(b.select("security_id").distinct())
    out = signals.price_signals(points, b)
    return out.select("security_id", "date", (r("momentum_12_1", 3) + 0.0).alias("momentum_12_1"), (r("reversal_1m", 3) + 0.0).alias("reversal_1m"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted bars -> volatility and momentum -> per-date z-scores -> top-quintile weights -> forward returns by date."""
    b = _adjusted(spark, sf_dir)
    points = views.month_ends(views.calendar(b)).crossJoin(b.select("security_id").distinct())
    priced = signals.price_signals(points, b)
    scored = xsection.composite(priced, {"momentum_12_1": 1.0, "volatility_3m": -1.0}, winsor=0.01)
    weights = backtest.quantile_weights(scored, "score", 0.2)
    w = W.partitionBy("security_id").orderBy("date")
    fwd = b.select("security_id", "date", (F.lead("close", 21).over(w) / F.col("close") - 1).alias("fwd"))
    held = asof_join(weights, fwd.withColumnRenamed("date", "_d"), "date", "_d", ["security_id"], tolerance=10)
    return held.groupBy("date").agg(F.count("*").alias("names"), r(F.sum(F.col("weight") * F.col("fwd")), 6).alias("long_short"))
