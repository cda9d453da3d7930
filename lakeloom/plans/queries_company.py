"""Queries over orders as company facts and bars as securities: fundamentals, market cap, universes, identity, short data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import fundamentals as fu
from ..operators import identity, names
from ..operators import marketcap as mc
from ..operators.graph import connected_components
from . import views
from .queries_market import r
from .registry import register

_TAGS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_RANK = "list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], tag)"


@register("facts_first_filed", f"""WITH {views.FACTS} SELECT cik, tag, "end", round(val, 2) AS val, filed FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, unit, "end" ORDER BY filed, accn, val) AS n FROM facts) WHERE n = 1""")
def facts_first_filed(spark, sf_dir):
    return fu.choose(views.facts(spark, sf_dir)).select("cik", "tag", "end", r("val", 2).alias("val"), "filed")


@register("facts_resolved", f"""WITH {views.FACTS}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, unit, "end" ORDER BY filed, accn, val) AS n FROM facts) WHERE n = 1)
SELECT cik, "end", tag, round(val, 2) AS val FROM (SELECT * EXCLUDE n, row_number() OVER (PARTITION BY cik, "end" ORDER BY filed, {_RANK}, unit, val) AS n FROM c) WHERE n = 1""")
def facts_resolved(spark, sf_dir):
    return fu.resolve_tags(fu.choose(views.facts(spark, sf_dir)), _TAGS, ["cik", "end"]).select("cik", "end", "tag", r("val", 2).alias("val"))


@register("facts_as_of", f"""WITH {views.FACTS}, s AS (SELECT cik, tag AS item, "end", val AS value, filed + 1 AS available_from FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, unit, "end" ORDER BY filed, accn, val) AS n FROM facts) WHERE n = 1)
SELECT cik, item, "end", round(value, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY cik, item ORDER BY "end" DESC, available_from DESC, value DESC) AS n FROM s WHERE available_from <= DATE '1997-06-30' AND "end" >= DATE '1997-06-30' - 400) WHERE n = 1""")
def facts_as_of(spark, sf_dir):
    s = fu.choose(views.facts(spark, sf_dir)).select("cik", F.col("tag").alias("item"), "end", F.col("val").alias("value"), F.date_add("filed", 1).alias("available_from"))
    return fu.latest_as_of(s, "1997-06-30").select("cik", "item", "end", r("value", 2).alias("value"))


#: Cumulative figures per company and year: the sum of its orders up to each quarter's end, filed 30 days later.
_YTD = """ytd AS (
    SELECT lpad(CAST(c AS VARCHAR), 10, '0') AS cik, 'Total' AS tag, 'USD' AS unit, CAST(make_date(y, 1, 1) AS DATE) AS start, e AS "end", sum(v) OVER (PARTITION BY c, y ORDER BY e) AS val, CAST(c AS VARCHAR) AS accn, e + 30 + CAST(c % 20 AS INTEGER) AS filed
    FROM (SELECT o_custkey % 50 AS c, year(o_orderdate) AS y, CAST(last_day(make_date(year(o_orderdate), 3 * quarter(o_orderdate), 1)) AS DATE) AS e, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)
)"""


def _ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("c"), F.year("o_orderdate").alias("y"), F.last_day(F.make_date(F.year("o_orderdate"), F.quarter("o_orderdate") * 3, F.lit(1))).alias("end"), "o_totalprice")
    q = o.groupBy("c", "y", "end").agg(F.sum("o_totalprice").alias("v"))
    val = F.sum("v").over(W.partitionBy("c", "y").orderBy("end"))
    return q.select(F.lpad(F.col("c").cast("string"), 10, "0").alias("cik"), F.lit("Total").alias("tag"), F.lit("USD").alias("unit"), F.make_date("y", F.lit(1), F.lit(1)).alias("start"), "end", val.alias("val"), F.col("c").cast("string").alias("accn"), F.expr("date_add(end, cast(30 + c % 20 as int))").alias("filed"))


_QUARTERS = f"""WITH {_YTD}, d AS (
    SELECT cik, start, "end", val, filed, false AS derived FROM ytd WHERE "end" - start + 1 BETWEEN 80 AND 100
    UNION ALL SELECT cik, pe + 1, "end", val - pv, greatest(filed, pf), true FROM (SELECT *, lag(val) OVER w AS pv, lag("end") OVER w AS pe, lag(filed) OVER w AS pf FROM ytd WINDOW w AS (PARTITION BY cik, start ORDER BY "end")) WHERE pv IS NOT NULL AND "end" - pe BETWEEN 79 AND 100
), q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, "end" ORDER BY derived, filed, start, val) AS n FROM d) WHERE n = 1)"""


@register("quarters_from_cumulative", _QUARTERS + ' SELECT cik, start, "end", round(val, 2) AS val, filed, derived FROM q')
def quarters_from_cumulative(spark, sf_dir):
    return fu.periodize(_ytd(spark, sf_dir)).select("cik", "start", "end", r("val", 2).alias("val"), "filed", "derived")


@register("trailing_twelve_months", _QUARTERS + """, l AS (SELECT *, lag(val, 1) OVER w AS v1, lag(val, 2) OVER w AS v2, lag(val, 3) OVER w AS v3, lag("end", 1) OVER w AS e1, lag("end", 2) OVER w AS e2, lag("end", 3) OVER w AS e3, lag(start, 1) OVER w AS s1, lag(start, 2) OVER w AS s2, lag(start, 3) OVER w AS s3,
   lag(filed, 1) OVER w AS f1, lag(filed, 2) OVER w AS f2, lag(filed, 3) OVER w AS f3 FROM q WINDOW w AS (PARTITION BY cik ORDER BY "end"))
SELECT cik, "end", round(val + v1 + v2 + v3, 2) AS ttm, greatest(filed, f1, f2, f3) AS ttm_filed FROM l WHERE start - e1 - 1 BETWEEN 0 AND 7 AND s1 - e2 - 1 BETWEEN 0 AND 7 AND s2 - e3 - 1 BETWEEN 0 AND 7 AND "end" - s3 + 1 BETWEEN 350 AND 380""")
def trailing_twelve_months(spark, sf_dir):
    return fu.add_ttm(fu.periodize(_ytd(spark, sf_dir))).where("ttm is not null").select("cik", "end", r("ttm", 2).alias("ttm"), "ttm_filed")


@register("fundamentals_panel", f"""WITH {views.BARS}, {views.FACTS}, m AS (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM bars) GROUP BY date_trunc('month', date)), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, unit, "end" ORDER BY filed, accn, val) AS n FROM facts) WHERE n = 1),
p AS (SELECT DISTINCT m.date, s.cik FROM m, (SELECT DISTINCT cik FROM s) s),
k AS (SELECT p.date, p.cik, s.tag, s."end", s.val, row_number() OVER (PARTITION BY p.date, p.cik, s.tag ORDER BY s."end" DESC, s.val DESC) AS n FROM p JOIN s ON s.cik = p.cik AND s.filed + 1 <= p.date)
SELECT p.date, p.cik, round(max(CASE WHEN tag = '1-URGENT' AND "end" >= p.date - 400 THEN val END), 2) AS urgent, round(max(CASE WHEN tag = '5-LOW' AND "end" >= p.date - 400 THEN val END), 2) AS low FROM p LEFT JOIN k ON k.date = p.date AND k.cik = p.cik AND k.n = 1 GROUP BY 1, 2""")
def fundamentals_panel(spark, sf_dir):
    s = fu.choose(views.facts(spark, sf_dir)).select("cik", F.col("tag").alias("item"), "end", F.col("val").alias("value"), F.date_add("filed", 1).alias("available_from"))
    points = views.month_ends(views.calendar(views.bars(spark, sf_dir))).crossJoin(s.select("cik").distinct())
    p = fu.panel(points, s, ["1-URGENT", "5-LOW"])
    return p.select("date", "cik", r(F.col("`1-URGENT`"), 2).alias("urgent"), r(F.col("`5-LOW`"), 2).alias("low"))


#: Share counts of securities from their parts, stated each quarter.
_COUNTS = """counts AS (SELECT k AS security_id, DATE '1994-01-31' + CAST(q * 91 AS INTEGER) AS "end", DATE '1994-01-31' + CAST(q * 91 + 40 + k % 9 AS INTEGER) AS available_from, CAST(1000 + k * 10 + q * 5 AS DOUBLE) AS shares_now FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem), range(16) t(q) WHERE (k + q) % 5 <> 0)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("security_id")).distinct().select("security_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("q")).where("(security_id + q) % 5 <> 0")
    day = lambda extra: F.expr(f"date_add(date'1994-01-31', cast(q * 91 + {extra} as int))")
    return k.select("security_id", day("0").alias("end"), day("40 + security_id % 9").alias("available_from"), (1000 + F.col("security_id") * 10 + F.col("q") * 5).cast("double").alias("shares_now"))


_CAPS = f"""WITH {views.BARS}, {_COUNTS}, caps AS (SELECT b.security_id, b.date, b.security_id // 2 AS cik, CASE WHEN c."end" >= b.date - 400 THEN close * shares_now END AS market_cap,
    median(close * volume) OVER (PARTITION BY b.security_id ORDER BY b.date ROWS 59 PRECEDING) AS dv60, close * volume AS dollar_volume FROM bars b ASOF LEFT JOIN counts c ON b.security_id = c.security_id AND b.date >= c.available_from)"""


def _caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bars(spark, sf_dir).withColumn("split_factor", F.lit(1.0)).withColumn("cik", F.floor(F.col("security_id") / 2).cast("string"))
    return mc.daily(b, _counts(spark, sf_dir))


@register("market_caps", _CAPS + " SELECT security_id, date, round(market_cap, 4) AS market_cap, round(dv60, 2) AS dv60 FROM caps")
def market_caps(spark, sf_dir):
    return _caps(spark, sf_dir).select("security_id", "date", r("market_cap", 4).alias("market_cap"), r("dv60", 2).alias("dv60"))


_PANEL = _CAPS + """, panel AS (SELECT *, row_number() OVER (PARTITION BY date, cik ORDER BY dv60 DESC NULLS LAST, security_id) = 1 AS is_primary, sum(market_cap) OVER (PARTITION BY date, cik) AS issuer_market_cap FROM caps),
ranks AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY issuer_market_cap DESC, security_id) AS rank FROM panel WHERE is_primary AND issuer_market_cap IS NOT NULL)"""


@register("size_ranks", _PANEL + " SELECT security_id, date, round(issuer_market_cap, 4) AS issuer_market_cap, rank, CASE WHEN rank <= 200 THEN 'large' WHEN rank <= 1000 THEN 'mid' WHEN rank <= 3000 THEN 'small' ELSE 'micro' END AS bucket FROM ranks")
def size_ranks(spark, sf_dir):
    return mc.ranks(mc.year_panel(_caps(spark, sf_dir))).select("security_id", "date", r("issuer_market_cap", 4).alias("issuer_market_cap"), "rank", "bucket")


@register("size_universe", _PANEL + """, d AS (SELECT a.date, b.rank_date FROM (SELECT DISTINCT date FROM bars) a JOIN (SELECT date_trunc('month', date) + INTERVAL 1 MONTH AS m, max(date) AS rank_date FROM bars GROUP BY 1) b ON date_trunc('month', a.date) = b.m)
SELECT p.date, p.security_id, r.rank FROM panel p JOIN d ON d.date = p.date JOIN ranks r ON r.date = d.rank_date AND r.security_id = p.security_id AND r.rank <= 10""")
def size_universe(spark, sf_dir):
    return mc.universe(mc.year_panel(_caps(spark, sf_dir)), 10).select("date", "security_id", "rank")


@register("liquidity", f"WITH {views.BARS} SELECT security_id, CAST(year(date) AS INTEGER) AS year, round(median(close * volume), 2) AS dollar_volume, count(*) AS days FROM bars GROUP BY 1, 2")
def liquidity(spark, sf_dir):
    return mc.liquidity_table(views.bars(spark, sf_dir)).withColumn("dollar_volume", r("dollar_volume", 2))


@register("multi_class_pairs", f"WITH {views.BARS} SELECT a.security_id // 3 AS cik, a.security_id AS security_id, b.security_id AS other_id, count(*) AS days FROM bars a JOIN bars b ON a.date = b.date AND a.security_id // 3 = b.security_id // 3 AND a.security_id < b.security_id GROUP BY 1, 2, 3 HAVING count(*) >= 20")
def multi_class_pairs(spark, sf_dir):
    b = views.bars(spark, sf_dir)
    return mc.multi_class(b, b.select("security_id").distinct().withColumn("cik", F.expr("security_id div 3")))


@register("suspect_splits", f"""WITH {views.BARS}, {_COUNTS}, d AS (SELECT security_id, date, lag(close) OVER (PARTITION BY security_id ORDER BY date) / close AS price_ratio FROM bars), c AS (SELECT security_id, "end", power(2.0, ((security_id + row_number() OVER (PARTITION BY security_id ORDER BY "end")) % 4)) * 100 AS shares FROM counts),
a AS (SELECT d.*, CASE WHEN d.date - 1 - c."end" <= 200 THEN c.shares END AS sa FROM (SELECT *, date - 1 AS db FROM d WHERE price_ratio >= 2) d ASOF LEFT JOIN c ON d.security_id = c.security_id AND d.db >= c."end"),
b AS (SELECT a.*, CASE WHEN c."end" - a.date <= 200 THEN c.shares END AS sb FROM a ASOF LEFT JOIN c ON a.security_id = c.security_id AND a.date <= c."end")
SELECT security_id, date, round(price_ratio, 4) AS price_ratio, round(sb / sa, 4) AS share_ratio FROM b WHERE abs(ln(sb / sa) - ln(price_ratio)) < ln(1.3)""")
def suspect_splits(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("security_id").orderBy("end"))
    c = _counts(spark, sf_dir).withColumn("_n", n).select("security_id", "end", (F.pow(F.lit(2.0), (F.col("security_id") + F.col("_n")) % 4) * 100).alias("shares"))
    return mc.suspect_splits(views.bars(spark, sf_dir), c).select("security_id", "date", r("price_ratio").alias("price_ratio"), r("share_ratio").alias("share_ratio"))


@register("trading_episodes", f"""WITH d AS (SELECT DISTINCT CAST(o_custkey % 300 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date FROM orders), g AS (SELECT *, CASE WHEN date - lag(date) OVER w > 30 THEN 1 ELSE 0 END AS nw FROM d WINDOW w AS (PARTITION BY ticker ORDER BY date)),
e AS (SELECT *, sum(nw) OVER (PARTITION BY ticker ORDER BY date) AS ep FROM g)
SELECT ticker, CAST(ep AS BIGINT) AS ep, min(date) AS first, max(date) AS last, count(*) AS days FROM e GROUP BY 1, 2""")
def trading_episodes(spark, sf_dir):
    days = views.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).cast("string").alias("ticker"), F.to_date("o_orderdate").alias("date"))
    return identity.episodes(days)


@register("ticker_to_security", f"""WITH {views.ISSUES}, w AS (SELECT CAST(security_id AS VARCHAR) AS ticker, 'S' || p_partkey AS security_id, DATE '1995-01-01' + CAST(n * 100 AS INTEGER) AS valid_from, CASE WHEN p_size > 5 THEN DATE '1995-01-01' + CAST(n * 100 + 40 + p_size AS INTEGER) END AS valid_to FROM issues),
d AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT d.ticker AS ticker, d.date AS date, CASE WHEN w.valid_to IS NULL OR d.date <= w.valid_to THEN w.security_id END AS security_id FROM d ASOF LEFT JOIN w ON d.ticker = w.ticker AND d.date >= w.valid_from""")
def ticker_to_security(spark, sf_dir):
    at = lambda extra: F.expr(f"date_add(date'1995-01-01', cast(n * 100 + {extra} as int))")
    w = views.issues(spark, sf_dir).select(F.col("security_id").cast("string").alias("ticker"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("security_id"), at("0").alias("valid_from"), F.when(F.col("p_size") > 5, at("40 + p_size")).alias("valid_to"))
    days = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("date")).distinct()
    return identity.map_to_security(days, w).select("ticker", "date", "security_id")


@register("linked_segments", """WITH e AS (SELECT *, lag(o_orderkey) OVER w AS before, CAST(o_orderdate AS DATE) - lag(CAST(o_orderdate AS DATE)) OVER w AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
i AS (SELECT *, sum(CASE WHEN gap <= 150 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS island FROM e),
c AS (SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey, island) AS component, count(*) OVER (PARTITION BY o_custkey, island) AS size FROM i) SELECT node, component FROM c WHERE size > 1""")
def linked_segments(spark, sf_dir):
    """Orders of a customer that follow each other within 150 days."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst"), F.date_diff(F.to_date("o_orderdate"), F.lag(F.to_date("o_orderdate")).over(w)).alias("gap"))
    return connected_components(o.where("gap <= 150").select("src", "dst"))


_WORDS = "list_transform(regexp_extract_all(upper(c_name || ' ' || c_mktsegment || ' Hldgs. Inc. /DE/'), '[A-Z0-9]+'), lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.EXPAND.items()) + " ELSE w END)"
_STOPPED = ", ".join(f"'{w}'" for w in names.STOP)


@register("name_tokens", f"SELECT c_custkey, array_to_string(list_filter({_WORDS}, lambda w: w NOT IN ({_STOPPED}) AND NOT regexp_full_match(w, '[A-Z]')), ' ') AS tokens FROM customer")
def name_tokens(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment", F.lit("Hldgs. Inc. /DE/")).alias("name"))
    return c.select("c_custkey", F.concat_ws(" ", names.tokens(F.col("name"))).alias("tokens"))


@register("short_symbols", "SELECT p_partkey, replace(regexp_replace('B' || p_size || '.A', 'p([A-Z]?)$', 'PR\\1'), '.', '') AS joined, replace('B' || p_size || '.A', '.', '/') AS slashed FROM part")
def short_symbols(spark, sf_dir):
    t = F.concat(F.lit("B"), F.col("p_size").cast("string"), F.lit(".A"))
    a, b = mc.finra_symbols(t)
    return views.table(spark, sf_dir, "part").select("p_partkey", a.alias("joined"), b.alias("slashed"))
