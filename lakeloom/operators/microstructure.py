"""Tick-level cost measures: trades against the prevailing best bid and offer.

Times are epoch nanoseconds in long columns. Ticks are partitioned by ticker; ``asof_skewed`` adds time buckets where one
ticker holds millions of quotes, carrying the last quote of earlier buckets forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof_join

SECOND = 1_000_000_000
MINUTE = 60 * SECOND
#: Trade condition codes (fixed values): out-of-sequence or not price-forming, opening and closing auctions, odd lots.
EXCLUDED = [2, 7, 13, 15, 16, 20, 21, 22, 29, 33, 38, 52, 53]
OPENING = [17, 25]
CLOSING = [8, 19]
ODD_LOT = [37]


def has_any(conditions: Column, codes: list[int]) -> Column:
    """Whether the list holds any of the codes; false for a missing list."""
    return F.coalesce(F.arrays_overlap(conditions, F.array(*[F.lit(c).cast("smallint") for c in codes])), F.lit(False))


def classify_trades(trades: DataFrame) -> DataFrame:
    """``class``: excluded, opening, closing, or continuous by the condition codes; corrections and empty trades are excluded."""
    c = F.col("conditions")
    bad = (F.coalesce("correction", F.lit(0)) != 0) | F.coalesce((F.col("price") <= 0) | (F.col("size") <= 0), F.lit(True))
    kind = F.when(bad, "excluded").when(has_any(c, OPENING), "opening").when(has_any(c, CLOSING), "closing").when(has_any(c, EXCLUDED), "excluded").otherwise("continuous")
    return trades.withColumn("class", kind).withColumn("odd_lot", has_any(c, ODD_LOT))


def usable_quote(bid: Column, ask: Column) -> Column:
    """Both sides positive, not crossed, spread at most half the mid."""
    return F.coalesce((bid > 0) & (ask > 0) & (ask >= bid) & (ask - bid <= 0.5 * (ask + bid) / 2), F.lit(False))


def interpolate_seconds(ticks: DataFrame, ts: str, sequence: str, by: str = "ticker") -> DataFrame:
    """Whole-second stamps spread evenly over their second in order of the sequence: second + (2i - 1) / 2n."""
    second = F.floor(F.col(ts) / SECOND).cast("long")
    out = ticks.withColumn("_s", second)
    i = F.row_number().over(W.partitionBy(by, "_s").orderBy(sequence))
    n = F.count(F.lit(1)).over(W.partitionBy(by, "_s"))
    out = out.withColumn("_i", i).withColumn("_n", n)
    return out.withColumn(ts, F.expr(f"_s * {SECOND}L + ((2L * _i - 1) * {SECOND}L) div (2L * _n)")).drop("_s", "_i", "_n")


def match_time(trades: DataFrame) -> DataFrame:
    """``t``: the participant's time for off-exchange reports (which come later), else the tape's."""
    return trades.withColumn("t", F.when(F.col("trf_timestamp").isNotNull() & F.col("participant_timestamp").isNotNull(), F.col("participant_timestamp")).otherwise(F.col("sip_timestamp")))


def quote_minutes(quotes: DataFrame, open_ns: int, close_ns: int, by: str = "ticker") -> DataFrame:
    """Per ticker and minute of the session: time-weighted quoted half-spread, mid and the seconds covered.

    ``quotes(ticker, ts, bid, ask)`` are usable ones; each holds until the next or the close and is split over the minutes.
    """
    w = W.partitionBy(by).orderBy("ts", "bid", "ask")
    spans = quotes.withColumn("_end", F.coalesce(F.lead("ts").over(w), F.lit(close_ns))).withColumn("_a", F.greatest("ts", F.lit(open_ns))).withColumn("_b", F.least("_end", F.lit(close_ns))).where("_b > _a")
    m = spans.withColumn("minute", F.explode(F.expr(f"sequence((_a - {open_ns}L) div {MINUTE}L, (_b - 1 - {open_ns}L) div {MINUTE}L)")))
    span = F.least(F.col("_b"), F.lit(open_ns) + (F.col("minute") + 1) * MINUTE) - F.greatest(F.col("_a"), F.lit(open_ns) + F.col("minute") * MINUTE)
    mid = (F.col("bid") + F.col("ask")) / 2
    m = m.withColumn("_w", span.cast("double")).withColumn("_mid", mid).withColumn("_hs", (F.col("ask") - F.col("bid")) / 2 / mid)
    return m.groupBy(by, "minute").agg(
        (F.sum(F.col("_hs") * F.col("_w")) / F.sum("_w")).alias("quoted_half_spread"), (F.sum(F.col("_mid") * F.col("_w")) / F.sum("_w")).alias("mid"), (F.sum("_w") / SECOND).alias("seconds")
    )


def asof_skewed(left: DataFrame, right: DataFrame, t: str, right_t: str, by: str, bucket: int, strict: bool = True, payload: list[str] | None = None) -> DataFrame:
    """A backward as-of join in two levels: inside (key, time bucket), else the last right row of an earlier bucket.

    One key with a third of all rows is spread over its buckets; between buckets only one row each is carried.
    """
    payload = payload or [c for c in right.columns if c not in (by, right_t)]
    l = left.withColumn("_b", F.floor(F.col(t) / bucket).cast("long"))  # noqa: E741
    r = right.select(by, F.col(right_t), *payload).withColumn("_b", F.floor(F.col(right_t) / bucket).cast("long"))
    inside = asof_join(l, r.withColumn("_hit", F.lit(True)), t, right_t, [by, "_b"], strict=strict, tie=payload, suffix="_q")
    lasts = r.groupBy(by, "_b").agg(F.max_by(F.struct(*payload), F.struct(right_t, *payload)).alias("_last"))
    frame = W.partitionBy(by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    buckets = l.select(by, "_b").distinct().join(lasts, [by, "_b"], "full")
    carried = buckets.withColumn("_carry", F.last("_last", ignorenulls=True).over(frame)).select(by, "_b", "_carry")
    out = inside.join(carried, [by, "_b"], "left")
    own = lambda c: c + "_q" if c in l.columns else c
    return out.select(*left.columns, *[F.when(F.col("_hit"), F.col(own(c))).otherwise(F.col("_carry")[c]).alias(own(c)) for c in payload])


def match(trades: DataFrame, quotes: DataFrame, close_ns: int, by: str = "ticker", horizons: tuple[int, ...] = (1, 5), bucket: int | None = None) -> DataFrame:
    """Trades with the quote strictly before them (``bid, ask, mid``) and the mids ``mid_1, mid_5`` minutes later (at the close at most)."""
    q = quotes.select(by, "ts", "bid", "ask")
    if bucket:
        out = asof_skewed(trades, q, "t", "ts", by, bucket)
    else:
        out = asof_join(trades, q, "t", "ts", [by], strict=True, tie=["bid", "ask"])
    out = out.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    mids = quotes.select(by, F.col("ts").alias("_ts"), ((F.col("bid") + F.col("ask")) / 2).alias("_m"))
    for h in horizons:
        out = out.withColumn("_th", F.least(F.col("t") + h * MINUTE, F.lit(close_ns)))
        out = asof_join(out, mids, "_th", "_ts", [by], tie=["_m"]).withColumnRenamed("_m", f"mid_{h}").drop("_th")
    return out


def sign_trades(trades: DataFrame, by: str = "ticker", order: tuple[str, ...] = ("t", "sequence_number")) -> DataFrame:
    """``sign``: +1 above the mid, -1 below; at the mid (or without quote) the last price change, else 0."""
    w = W.partitionBy(by).orderBy(*order)
    change = F.col("price") - F.lag("price").over(w)
    tick = F.when(change > 0, 1).when(change < 0, -1)
    out = trades.withColumn("_tick", tick)
    last = F.last("_tick", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    side = F.when(F.col("price") > F.col("mid"), 1).when(F.col("price") < F.col("mid"), -1).otherwise(F.coalesce(last, F.lit(0)))
    return out.withColumn("sign", side).drop("_tick")


def trade_measures(signed: DataFrame, horizons: tuple[int, ...] = (1, 5), worst: float = 0.25) -> DataFrame:
    """``effective, realized_h, impact_h`` half-spreads relative to the mid; trades beyond ``worst`` keep none."""
    eff = F.when(F.col("mid") > 0, F.abs(F.col("price") - F.col("mid")) / F.col("mid"))
    out = signed.withColumn("effective", F.when(eff <= worst, eff)).withColumn("dollars", F.col("price") * F.col("size"))
    for h in horizons:
        have = F.col("effective").isNotNull() & F.col(f"mid_{h}").isNotNull()
        out = out.withColumn(f"realized_{h}", F.when(have, F.col("sign") * (F.col("price") - F.col(f"mid_{h}")) / F.col("mid")))
        out = out.withColumn(f"impact_{h}", F.when(have, F.col("sign") * (F.col(f"mid_{h}") - F.col("mid")) / F.col("mid")))
    return out


def weighted_mean(x: Column, w: Column) -> Column:
    """The mean of the values that are not null, by weight."""
    return F.when(F.sum(F.when(x.isNotNull(), w)) > 0, F.sum(x * w) / F.sum(F.when(x.isNotNull(), w)))


def aggregate_trades(measured: DataFrame, keys: list[str], horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Dollar-weighted measures, counts and volumes by any keys (ticker and minute, ticker, venue)."""
    d = F.col("dollars")
    aggs = [weighted_mean(F.col("effective"), d).alias("effective")]
    for h in horizons:
        aggs += [weighted_mean(F.col(f"realized_{h}"), d).alias(f"realized_{h}"), weighted_mean(F.col(f"impact_{h}"), d).alias(f"impact_{h}")]
    return measured.groupBy(*keys).agg(
        *aggs, F.count("*").alias("n_trades"), F.count("effective").alias("n_matched"), F.sum("size").alias("volume"), F.sum("dollars").alias("dollar_volume"),
        F.sum(F.col("sign") * F.col("size")).alias("net_volume"),
    )


def trade_minutes(measured: DataFrame, open_ns: int, by: str = "ticker") -> DataFrame:
    return aggregate_trades(measured.withColumn("minute", F.floor((F.col("t") - open_ns) / MINUTE).cast("long")), [by, "minute"])


def daily_from_minutes(minutes: DataFrame, by: str = "ticker") -> DataFrame:
    """Daily time-weighted quoted spread from the minutes of ``quote_minutes``."""
    return minutes.groupBy(by).agg((F.sum(F.col("quoted_half_spread") * F.col("seconds")) / F.sum("seconds")).alias("quoted_half_spread"), F.sum("seconds").alias("seconds"), F.count("*").alias("n_minutes"))


def auctions(classified: DataFrame, by: str = "ticker") -> DataFrame:
    """Price (of the largest print) and size of the opening and closing auctions."""
    def side(name: str) -> DataFrame:
        rows = classified.where(F.col("class") == name)
        return rows.groupBy(by).agg(F.max_by("price", F.struct("size", "price")).alias(f"{name}_price"), F.sum("size").alias(f"{name}_size"))

    return side("opening").join(side("closing"), by, "full")


def snapshots(quotes: DataFrame, at: list[tuple[str, int]], by: str = "ticker") -> DataFrame:
    """The relative half-spread strictly before fixed times, one column each."""
    spark = quotes.sparkSession
    times = spark.createDataFrame(at, "name string, _at long")
    wanted = quotes.select(by).distinct().crossJoin(F.broadcast(times))  # tickers x a handful of times
    q = quotes.select(by, "ts", ((F.col("ask") - F.col("bid")) / (F.col("ask") + F.col("bid"))).alias("half_spread"))
    seen = asof_join(wanted, q, "_at", "ts", [by], strict=True, tie=["half_spread"])
    return seen.groupBy(by).pivot("name", [n for n, _ in at]).agg(F.first("half_spread"))


def measure_block(trades: DataFrame, quotes: DataFrame, open_ns: int, close_ns: int, by: str = "ticker") -> dict[str, DataFrame]:
    """All measures of a day: ``minute``, ``daily``, ``venue`` and ``trades`` tables from raw trades and quotes."""
    q = quotes.select(by, F.col("sip_timestamp").alias("ts"), F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask")).where(usable_quote(F.col("bid"), F.col("ask")))
    kinds = classify_trades(match_time(trades))
    inside = kinds.where((F.col("class") == "continuous") & (F.col("t") >= open_ns) & (F.col("t") < close_ns))
    measured = trade_measures(sign_trades(match(inside, q, close_ns, by), by))
    quoted = quote_minutes(q, open_ns, close_ns, by)
    minute = trade_minutes(measured, open_ns, by).join(quoted, [by, "minute"], "full")
    daily = aggregate_trades(measured, [by]).join(daily_from_minutes(quoted, by), by, "full").join(auctions(kinds, by), by, "full")
    return {"minute": minute, "daily": daily, "venue": aggregate_trades(measured, [by, "exchange"]), "trades": measured}


def buckets(minutes: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Minute tables re-weighted to n-minute buckets: weighted means over the values that are not null."""
    m = minutes.withColumn("bucket", F.floor(F.col("minute") / n).cast("long"))
    return m.groupBy(*by, "bucket").agg(
        weighted_mean(F.col("effective"), F.col("dollar_volume")).alias("effective"), weighted_mean(F.col("quoted_half_spread"), F.col("seconds")).alias("quoted_half_spread"),
        F.sum("n_trades").alias("n_trades"), F.sum("dollar_volume").alias("dollar_volume"),
    )
