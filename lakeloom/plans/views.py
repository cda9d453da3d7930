"""Domain views over the driver tables, in Spark and as the SQL that oracles share.

lineitem stands for daily bars (supplier = security), events for ticks and minute bars (user = security), orders for company
facts (customer = company), part for corporate actions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BARS = """bars AS (
    SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS date,
           first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(p) AS high, min(p) AS low,
           last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close, sum(l_quantity) AS volume
    FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem)
    GROUP BY 1, 2
)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, date, open, high, low, close, volume."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("o"),
    )
    return rows.groupBy("security_id", "date").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("l_quantity").alias("volume")
    )


#: Every part belongs to the security of its first line item, some twenty to a security at any size; ``n`` numbers them.
ISSUES = """issues AS (
    SELECT security_id, p_partkey, p_size, p_brand, row_number() OVER (PARTITION BY security_id ORDER BY p_partkey) AS n
    FROM part JOIN (SELECT l_partkey, first(l_suppkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS security_id FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
)"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, p_partkey, p_size, p_brand, n."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("security_id"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand").join(first, "p_partkey")
    return p.select("security_id", "p_partkey", "p_size", "p_brand", F.row_number().over(W.partitionBy("security_id").orderBy("p_partkey")).alias("n"))


SPLITS = ISSUES + """, splits AS (
    SELECT security_id, DATE '1994-01-01' + CAST((p_partkey * 37) % 2000 AS INTEGER) AS execution_date,
           CAST(1 AS DOUBLE) AS split_from, CAST(CASE p_size % 10 WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 1.0 END AS DOUBLE) AS split_to
    FROM issues
)"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, execution_date, split_from, split_to."""
    return issues(spark, sf_dir).select(
        "security_id", F.expr("date_add(date'1994-01-01', cast((p_partkey * 37) % 2000 as int))").alias("execution_date"),
        F.lit(1.0).alias("split_from"), F.expr("double(case p_size % 10 when 0 then 2.0 when 1 then 3.0 when 2 then 0.5 when 3 then 0.25 else 1.0 end)").alias("split_to"),
    )


#: Follows SPLITS, whose issues it reads. Powers of two keep products off the ties of rounding.
DIVIDENDS = """dividends AS (
    SELECT security_id, DATE '1994-01-15' + CAST((p_partkey * 53) % 2200 AS INTEGER) AS ex_dividend_date,
           1 - (1 + p_size) / 1024.0 AS factor
    FROM issues
)"""


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, ex_dividend_date, factor (the step of one dividend)."""
    return issues(spark, sf_dir).select(
        "security_id", F.expr("date_add(date'1994-01-15', cast((p_partkey * 53) % 2200 as int))").alias("ex_dividend_date"),
        (1 - (1 + F.col("p_size")) / F.lit(1024.0)).alias("factor"),
    )


MINUTES = """minutes AS (
    SELECT user_id % 20 AS security_id, CAST(ts AS DATE) AS date, date_trunc('minute', ts) AS timestamp,
           first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
           CAST(count(*) * 10 AS DOUBLE) AS volume, count(*) AS transactions
    FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3
)"""


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, date, timestamp, open, high, low, close, volume, transactions."""
    e = table(spark, sf_dir, "events").where("value is not null")
    ts = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    e = e.select((F.col("user_id") % 20).alias("security_id"), F.to_date("ts").alias("date"), ts.alias("timestamp"), "value", F.struct("ts", "event_id").alias("o"))
    return e.groupBy("security_id", "date", "timestamp").agg(
        F.min_by("value", "o").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "o").alias("close"),
        (F.count("*") * 10).cast("double").alias("volume"), F.count("*").alias("transactions"),
    )


#: Every day of the events is a session from 09:00 to 17:00.
SESSIONS = """sessions AS (
    SELECT DISTINCT CAST(ts AS DATE) AS date, CAST(ts AS DATE) + INTERVAL 9 HOUR AS market_open, CAST(ts AS DATE) + INTERVAL 17 HOUR AS market_close FROM events
)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    at = lambda h: F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + h * 3600)
    return days.select("date", at(9).alias("market_open"), at(17).alias("market_close"))


TICKS = """ticks AS (
    SELECT event_id, user_id % 20 AS ticker, epoch_us(ts) * 1000 AS t, event_type, value FROM events WHERE value > 0
), quotes AS (
    SELECT ticker, t AS ts, value * 0.999 AS bid, value * 1.001 AS ask FROM ticks WHERE event_type <> 'purchase'
), trades AS (
    SELECT ticker, t, event_id AS sequence_number, value AS price, CAST(1 + event_id % 9 AS DOUBLE) * 100 AS size FROM ticks WHERE event_type = 'purchase'
)"""


def ticks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """quotes(ticker, ts, bid, ask), trades(ticker, t, sequence_number, price, size); times in nanoseconds."""
    e = table(spark, sf_dir, "events").where("value > 0").select("event_id", (F.col("user_id") % 20).alias("ticker"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t"), "event_type", "value")
    quotes = e.where("event_type <> 'purchase'").select("ticker", F.col("t").alias("ts"), (F.col("value") * 0.999).alias("bid"), (F.col("value") * 1.001).alias("ask"))
    trades = e.where("event_type = 'purchase'").select("ticker", "t", F.col("event_id").alias("sequence_number"), F.col("value").alias("price"), ((1 + F.col("event_id") % 9).cast("double") * 100).alias("size"))
    return quotes, trades


FACTS = """facts AS (
    SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_orderpriority AS tag, 'USD' AS unit, CAST(o_orderdate AS DATE) AS "end",
           o_totalprice AS val, CAST(o_orderkey AS VARCHAR) AS accn, CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 90 AS INTEGER) AS filed
    FROM orders
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cik, tag, unit, end, val, accn, filed."""
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.col("o_orderpriority").alias("tag"), F.lit("USD").alias("unit"), F.to_date("o_orderdate").alias("end"),
        F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("string").alias("accn"), F.expr("date_add(to_date(o_orderdate), cast(1 + o_orderkey % 90 as int))").alias("filed"),
    )


def calendar(bars_: DataFrame) -> DataFrame:
    return bars_.select("date").distinct()


def month_ends(days: DataFrame) -> DataFrame:
    """The last trading day of each month."""
    return days.groupBy(F.trunc("date", "month").alias("_m")).agg(F.max("date").alias("date")).select("date")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
