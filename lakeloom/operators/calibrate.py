"""Calibration of trading costs from measured spreads and flows.

The Poisson fit keeps its data in Spark: each Newton step is one aggregate of the gradient and Hessian (a few dozen numbers).
"""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .costs import SpreadFit
from .microstructure import weighted_mean

REFERENCE_ADV, REFERENCE_VOL = 1e8, 0.02


def schedule(sessions: DataFrame, recent: int = 20, every: int = 21, events: list[dt.date] | None = None, around: int = 1) -> DataFrame:
    """Days to measure with why: the most recent, a regular sample, and days around events."""
    from pyspark.sql import Window as W

    n = sessions.select("date").withColumn("_n", F.row_number().over(W.orderBy(F.desc("date"))))
    out = n.where(F.col("_n") <= recent).select("date", F.lit("recent").alias("why")).unionByName(n.where((F.col("_n") > recent) & (F.col("_n") % every == 0)).select("date", F.lit("sample").alias("why")))
    if events:
        marks = n.where(F.col("date").isin(events)).select(F.col("_n").alias("_e"))
        near = n.join(F.broadcast(marks), F.abs(F.col("_n") - F.col("_e")) <= around).select("date", F.lit("event").alias("why")).distinct()
        out = out.unionByName(near)
    return out.groupBy("date").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("why"))


def clusters(dates: DataFrame, gap: int = 10) -> DataFrame:
    """Runs of dates with at most ``gap`` days between: ``cluster, first, last, days``."""
    from pyspark.sql import Window as W

    w = W.orderBy("date")
    d = dates.select("date").distinct().withColumn("_new", F.when(F.datediff("date", F.lag("date").over(w)) > gap, 1).otherwise(0))
    d = d.withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy("cluster").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"))


def build_inputs(daily: DataFrame, market: DataFrame, classes: DataFrame, key: str = "security_id") -> DataFrame:
    """Measured days joined with adv, vol and the class of the security; eff_bps in basis points."""
    return daily.join(market.select(key, "date", "adv", "vol"), [key, "date"]).join(classes.select(key, "class"), key, "left").withColumn("eff_bps", F.col("effective") * 1e4)


def sample(inputs: DataFrame) -> DataFrame:
    return inputs.where("class = 'stock' and adv > 0 and vol is not null and eff_bps > 0 and coalesce(outside_share, 0) < 0.2 and n_matched >= 20")


def fit_spread(inputs: DataFrame, knots: list[float], tol: float = 1e-9, steps: int = 50) -> SpreadFit:
    """Poisson regression of the half-spread on year levels, log ADV, log volatility and changes of slope at knots, by Newton."""
    rows = sample(inputs).withColumn("year", F.year("date"))
    years = sorted(r[0] for r in rows.select("year").distinct().collect())
    if not years:
        raise ValueError("no usable rows")
    x: list[Column] = [(F.col("year") == y).cast("double") for y in years]
    x += [F.ln(F.col("adv") / REFERENCE_ADV), F.ln(F.greatest("vol", F.lit(1e-4)) / REFERENCE_VOL)]
    x += [F.greatest(F.ln(F.col("adv") / k), F.lit(0.0)) - max(math.log(REFERENCE_ADV / k), 0.0) for k in knots]
    p = len(x)
    data = rows.select(F.array(*x).alias("x"), F.col("eff_bps").alias("y")).cache()
    start = data.agg(F.avg("y")).first()[0]
    b = np.r_[np.full(len(years), math.log(start)), np.zeros(p - len(years))]
    try:
        for _ in range(steps):
            eta = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in b]), lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v)
            r = data.withColumn("m", F.exp(F.least(eta, F.lit(30.0))))
            sums = [F.sum((F.col("y") - F.col("m")) * F.get("x", F.lit(i))) for i in range(p)] + [F.sum(F.col("m") * F.get("x", F.lit(i)) * F.get("x", F.lit(j))) for i in range(p) for j in range(i, p)]
            got = np.array(r.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first(), float)
            h = np.zeros((p, p))
            h[np.triu_indices(p)] = got[p:]
            h = h + h.T - np.diag(np.diag(h))
            step = np.linalg.solve(h + 1e-12 * np.eye(p), got[:p])
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < tol:
                break
    finally:
        data.unpersist()
    n = len(years)
    return SpreadFit({y: math.exp(v) for y, v in zip(years, b[:n], strict=True)}, float(b[n]), float(b[n + 1]), [(k, float(v)) for k, v in zip(knots, b[n + 2 :], strict=True)])


_EDGES = [1e5, 1e6, 1e7, 1e8, 1e9]


def adv_bucket(adv: Column) -> Column:
    out = F.lit(len(_EDGES))
    for i, e in reversed(list(enumerate(_EDGES))):
        out = F.when(adv < e, i).otherwise(out)
    return out


def compare(inputs: DataFrame, fit: SpreadFit) -> DataFrame:
    """Measured and fitted mean half-spreads by year and ADV bucket."""
    rows = sample(inputs).withColumn("year", F.year("date")).withColumn("bucket", adv_bucket(F.col("adv"))).withColumn("fitted", fit.bps(F.col("year"), F.col("adv"), F.col("vol")))
    return rows.groupBy("year", "bucket").agg(F.count("*").alias("n"), F.avg("eff_bps").alias("measured"), F.avg("fitted").alias("fitted")).withColumn("ratio", F.col("fitted") / F.col("measured"))


def close_table(daily: DataFrame) -> DataFrame:
    """How far closing auctions print from the last mid, by ADV bucket, dollar-weighted."""
    d = daily.where("closing_price > 0 and last_mid > 0").withColumn("bucket", adv_bucket(F.col("adv"))).withColumn("gap", F.abs(F.col("closing_price") / F.col("last_mid") - 1) * 1e4)
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_bps"), F.median("gap").alias("median_bps"))


def impact_table(flows: DataFrame) -> DataFrame:
    """Impact coefficients by ADV bucket: regression through the origin of volatility-scaled excess returns on signed root flows."""
    med = flows.groupBy("date").agg(F.median("ret").alias("_m"))
    d = flows.join(F.broadcast(med), "date").withColumn("y", (F.col("ret") - F.col("_m")) / F.when(F.col("vol") > 0, F.col("vol"))).withColumn("f", F.col("net_dollars") / F.when(F.col("adv") > 0, F.col("adv")))
    d = d.where((F.abs("f") < 1) & (F.abs("y") < 10)).withColumn("z", F.signum("f") * F.sqrt(F.abs("f"))).withColumn("bucket", adv_bucket(F.col("adv")))
    s = d.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("y")).alias("_zy"), F.sum(F.col("z") * F.col("z")).alias("_zz"))
    return s.select("bucket", "n", F.when(F.col("_zz") > 0, F.col("_zy") / F.col("_zz")).alias("coefficient"))


def tod_segments(minute: Column, session: int = 390) -> Column:
    """Segments of the day: first 5, 15, 30 minutes, the middle, last 30 and 5."""
    return F.when(minute < 5, "open5").when(minute < 15, "open15").when(minute < 30, "open30").when(minute >= session - 5, "close5").when(minute >= session - 30, "close30").otherwise("middle")


def tod_profile(minutes: DataFrame, session: int = 390) -> DataFrame:
    """Effective half-spreads of each segment relative to the whole day, dollar-weighted."""
    m = minutes.where("effective is not null").withColumn("segment", tod_segments(F.col("minute"), session))
    whole = m.agg(weighted_mean(F.col("effective"), F.col("dollar_volume")).alias("_day"))
    by = m.groupBy("segment").agg(weighted_mean(F.col("effective"), F.col("dollar_volume")).alias("effective"), F.sum("dollar_volume").alias("dollar_volume"))
    return by.crossJoin(F.broadcast(whole)).select("segment", "effective", "dollar_volume", (F.col("effective") / F.col("_day")).alias("multiple"))
