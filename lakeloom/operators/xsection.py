"""Cross-sectional transforms per date: winsorise, neutralise, z-score or rank, composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import percentile_rank, winsorized, zscore


def neutralize(df: DataFrame, column: str, date: str = "date", sector: str | None = "sector", size: str | None = "issuer_market_cap") -> DataFrame:
    """The column less its (date, sector) mean, then the residual on log size (slope 0 where size does not vary)."""
    out = df
    if sector:
        out = out.withColumn(column, F.col(column) - F.avg(column).over(W.partitionBy(date, sector)))
    if size:
        w = W.partitionBy(date)
        x = F.when(F.col(column).isNotNull() & (F.col(size) > 0), F.ln(F.col(size)))
        y = F.when(x.isNotNull(), F.col(column))
        out = out.withColumn("_x", x).withColumn("_y", y)
        dx = F.col("_x") - F.avg("_x").over(w)
        dy = F.col("_y") - F.avg("_y").over(w)
        out = out.withColumn("_dx", dx).withColumn("_dy", dy)
        var, cov = F.sum(F.col("_dx") * F.col("_dx")).over(w), F.sum(F.col("_dx") * F.col("_dy")).over(w)
        slope = F.when(var > 0, cov / var).otherwise(0.0)
        out = out.withColumn(column, F.col("_dy") - slope * F.col("_dx")).drop("_x", "_y", "_dx", "_dy")
    return out


def transform(df: DataFrame, columns: list[str], method: str | None = "zscore", winsor: float = 0.0, sector: str | None = None, size: str | None = None, date: str = "date") -> DataFrame:
    """In this order: winsorise, neutralise (where a sector or size is named), then ``zscore``, ``rank`` or nothing."""
    out = df
    for c in columns:
        if winsor:
            out = winsorized(out, [c], winsor, [date])
        if sector or size:
            out = neutralize(out, c, date, sector, size)
        if method == "zscore":
            out = out.withColumn(c, zscore(F.col(c), [date]))
        elif method == "rank":
            out = out.withColumn(c, percentile_rank(F.col(c), [date]))
    return out


def composite(df: DataFrame, weights: dict[str, float], out: str = "score", winsor: float = 0.01, method: str = "zscore", min_signals: int = 1, date: str = "date") -> DataFrame:
    """Weighted mean of transformed signals over those available: sum(w z) / sum(|w|); null below ``min_signals``.

    Weights carry the direction. Ranks are centred on zero.
    """
    names = {c: f"_z_{c}" for c in weights}
    work = df.withColumns({names[c]: F.col(c) for c in weights})
    work = transform(work, list(names.values()), method, winsor, date=date)
    z = lambda c: F.col(names[c]) - 0.5 if method == "rank" else F.col(names[c])
    total, weight, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for c, w in weights.items():
        have = F.col(names[c]).isNotNull()
        total = total + F.when(have, z(c) * w).otherwise(0.0)
        weight = weight + F.when(have, abs(w)).otherwise(0.0)
        n = n + F.when(have, 1).otherwise(0)
    score: Column = F.when((n >= min_signals) & (weight > 0), total / weight)
    return work.withColumn(out, score).drop(*names.values())


#: The twelve Fama-French industries by ranges of industry codes; any other code is "Other" (fixed values).
FF12 = {
    "Consumer non-durables": [(100, 999), (2000, 2399), (2700, 2749), (2770, 2799), (3100, 3199), (3940, 3989)],
    "Consumer durables": [(2500, 2519), (2590, 2599), (3630, 3659), (3710, 3711), (3714, 3714), (3716, 3716), (3750, 3751), (3792, 3792), (3900, 3939), (3990, 3999)],
    "Manufacturing": [(2520, 2589), (2600, 2699), (2750, 2769), (3000, 3099), (3200, 3569), (3580, 3629), (3700, 3709), (3712, 3713), (3715, 3715), (3717, 3749), (3752, 3791), (3793, 3799), (3830, 3839), (3860, 3899)],
    "Energy": [(1200, 1399), (2900, 2999)],
    "Chemicals": [(2800, 2829), (2840, 2899)],
    "Business equipment": [(3570, 3579), (3660, 3692), (3694, 3699), (3810, 3829), (7370, 7379)],
    "Telecom": [(4800, 4899)],
    "Utilities": [(4900, 4949)],
    "Shops": [(5000, 5999), (7200, 7299), (7600, 7699)],
    "Healthcare": [(2830, 2839), (3693, 3693), (3840, 3859), (8000, 8099)],
    "Finance": [(6000, 6999)],
}


def sic_sector(sic: Column, ranges: list[tuple[int, int, str]] | None = None, default: str = "Other") -> Column:
    """The sector of an industry code from (low, high, name) ranges, of FF12 where none are given; null for a missing code."""
    ranges = ranges if ranges is not None else [(lo, hi, name) for name, spans in FF12.items() for lo, hi in spans]
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(ranges):
        out = F.when(sic.between(lo, hi), name).otherwise(out)
    return F.when(sic.isNotNull(), F.coalesce(out, F.lit(default)))
