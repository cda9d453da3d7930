"""The factor risk model: exposures, daily cross-sectional regressions, covariances, specific risk, attribution; and the optimizer.

Cross-sections are one group per day (some thousand names by 20 factors); what reaches the driver is factor returns
(days x factors) and factor covariances.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clip, mean_of
from ..functions.windows import decayed_mean, winsorized
from .asof import asof_join

WINSOR, CLIP, MAD = 0.01, 3.0, 5 * 1.4826
CORR_HALF, VOL_HALF, REGIME_HALF, SPECIFIC_HALF = 252, 84, 42, 84
MIN_NAMES, MIN_OBS, SHRINK = 50, 42, 0.3


def _standardised(df: DataFrame, column: str, cap: str, date: str) -> DataFrame:
    """Winsorised, less its cap-weighted mean, over its deviation."""
    w = W.partitionBy(date)
    df = winsorized(df.withColumn("_x", F.col(column)), ["_x"], WINSOR, [date])
    mean = F.sum(F.col("_x") * F.col(cap)).over(w) / F.sum(F.when(F.col("_x").isNotNull(), F.col(cap))).over(w)
    sd = F.stddev_samp("_x").over(w)
    return df.withColumn(column, F.when(sd > 0, (F.col("_x") - mean) / sd)).drop("_x")


def build_exposures(panel: DataFrame, styles: dict[str, list[str]], cap: str = "issuer_market_cap", date: str = "date", logs: tuple[str, ...] = ("volatility_3m", "turnover")) -> DataFrame:
    """Style exposures: standardised components averaged, standardised again, missing as 0, within 3, centred by capitalisation."""
    out = panel.where(F.col(cap) > 0)
    w = W.partitionBy(date)
    for style, parts in styles.items():
        names = []
        for p in parts:
            n = f"_{style}_{p}"
            out = out.withColumn(n, F.when(F.col(p) > 0, F.ln(p)) if p in logs else F.col(p))
            out = _standardised(out, n, cap, date)
            names.append(n)
        out = out.withColumn(style, mean_of(*[F.col(n) for n in names])).drop(*names)
        out = _standardised(out, style, cap, date)
        out = out.withColumn(style, clip(F.coalesce(F.col(style), F.lit(0.0)), -CLIP, CLIP))
        out = out.withColumn(style, F.col(style) - F.sum(F.col(style) * F.col(cap)).over(w) / F.sum(cap).over(w))
    return out


def robust_clip(returns: DataFrame, column: str = "ret", date: str = "date") -> DataFrame:
    """Returns within median +- 5 x 1.4826 x median absolute deviation of their date."""
    med = returns.groupBy(date).agg(F.median(column).alias("_m"))
    j = returns.join(F.broadcast(med), date).withColumn("_a", F.abs(F.col(column) - F.col("_m")))
    mad = j.groupBy(date).agg(F.median("_a").alias("_mad"))
    j = j.join(F.broadcast(mad), date)
    return j.withColumn(column, clip(F.col(column), F.col("_m") - MAD * F.col("_mad"), F.col("_m") + MAD * F.col("_mad"))).drop("_m", "_a", "_mad")


def cross_section(ret: np.ndarray, cap: np.ndarray, sector: np.ndarray, styles: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray, np.ndarray, float]:
    """Weighted least squares (weights: square roots of capitalisation) on a market factor, sectors that sum to zero by
    capitalisation, and styles. Returns market return, sector returns, style returns, residuals and R squared about zero."""
    names = sorted(set(sector.tolist()))
    caps = {s: cap[sector == s].sum() for s in names}
    last = names[-1]
    columns = [np.ones(ret.size)]
    for s in names[:-1]:
        columns.append((sector == s).astype(float) - (sector == last) * caps[s] / caps[last])
    x = np.column_stack([*columns, styles]) if styles.size else np.column_stack(columns)
    w = np.sqrt(cap)
    root = np.sqrt(w)
    f = np.linalg.lstsq(x * root[:, None], ret * root, rcond=None)[0]
    resid = ret - x @ f
    total = float((w * ret * ret).sum())
    k = len(names)
    by_sector = dict(zip(names[:-1], f[1:k].tolist(), strict=True))
    by_sector[last] = -sum(caps[s] * v for s, v in by_sector.items()) / caps[last] if k > 1 else 0.0
    return f[:1], by_sector, f[k:], resid, 1 - float((w * resid * resid).sum()) / total if total > 0 else 0.0


def regressions(returns: DataFrame, exposures: DataFrame, styles: list[str], cap: str = "issuer_market_cap", key: str = "security_id", least: int = MIN_NAMES) -> tuple[DataFrame, DataFrame]:
    """(factor_returns: date, factor, ret, r2; residuals: date, security_id, resid) of each day on the exposures known strictly before."""
    e = exposures.select(key, F.col("date").alias("_m"), cap, "sector", *styles)
    j = asof_join(robust_clip(returns.where("ret is not null").select(key, "date", "ret")), e, "date", "_m", [key], strict=True, tolerance=45).where(F.col(cap).isNotNull() & F.col("sector").isNotNull())

    def day(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame(columns=["date", "kind", "name", "value", "r2"])
        market, sectors, style, resid, r2 = cross_section(pdf["ret"].to_numpy(float), pdf[cap].to_numpy(float), pdf["sector"].astype(str).to_numpy(), pdf[styles].to_numpy(float))
        d = pdf["date"].iloc[0]
        rows = [(d, "factor", "market", float(market[0]), r2)] + [(d, "factor", f"sector:{s}", float(v), r2) for s, v in sectors.items()] + [(d, "factor", n, float(v), r2) for n, v in zip(styles, style, strict=True)]
        rows += [(d, "resid", str(i), float(v), r2) for i, v in zip(pdf[key], resid, strict=True)]
        return pd.DataFrame(rows, columns=["date", "kind", "name", "value", "r2"])

    out = j.groupBy("date").applyInPandas(day, "date date, kind string, name string, value double, r2 double")
    factors = out.where("kind = 'factor'").select("date", F.col("name").alias("factor"), F.col("value").alias("ret"), "r2")
    return factors, out.where("kind = 'resid'").select("date", F.col("name").cast(dict(returns.dtypes)[key]).alias(key), F.col("value").alias("resid"))


def ewma_weights(n: int, half_life: float) -> np.ndarray:
    """Weights of n observations, the last the largest, summing to one."""
    w = 0.5 ** (np.arange(n)[::-1] / half_life)
    return w / w.sum()


def regime_scale(f: np.ndarray, half_life: float = REGIME_HALF, vol_half: float = VOL_HALF, warm_up: int = 63) -> float:
    """Root of the decayed mean of squared factor returns standardised by the volatility known the day before."""
    if f.shape[0] <= warm_up:
        return 1.0
    decay = 0.5 ** (1 / vol_half)
    var, weight, z = np.zeros(f.shape[1]), 0.0, []
    for t in range(f.shape[0]):
        if t >= warm_up:
            z.append(np.mean(f[t] ** 2 / np.maximum(var / weight, 1e-18)))
        var, weight = var * decay + f[t] ** 2, weight * decay + 1
    return float(math.sqrt((ewma_weights(len(z), half_life) * np.array(z)).sum()))


def factor_cov(f: np.ndarray) -> np.ndarray:
    """Daily covariance of factors: slow correlations, fast volatilities, scaled by the regime. ``f`` is days x factors (bounded)."""
    wc, wv = ewma_weights(f.shape[0], CORR_HALF), ewma_weights(f.shape[0], VOL_HALF)
    c = (f * wc[:, None]).T @ f
    sd = np.sqrt(np.maximum(np.diag(c), 1e-18))
    vol = np.sqrt((f * f * wv[:, None]).sum(axis=0))
    return c / np.outer(sd, sd) * np.outer(vol, vol) * regime_scale(f) ** 2


def specific_var(residuals: DataFrame, caps: DataFrame, key: str = "security_id", dates: DataFrame | None = None) -> DataFrame:
    """Specific variance per (date, security): the decayed mean of squared residuals (own from 42 of them), shrunk by 0.3 to the
    cap-weighted mean of its size decile; the decile's alone below."""
    sq = residuals.withColumn("_r2", F.col("resid") * F.col("resid"))
    own = decayed_mean(sq, "_r2", [key], "date", SPECIFIC_HALF, "_var", MIN_OBS).select(key, F.col("date").alias("_d"), "_var")
    points = caps if dates is None else caps.join(F.broadcast(dates), "date", "left_semi")
    j = asof_join(points, own, "date", "_d", [key])
    rank = F.row_number().over(W.partitionBy("date").orderBy("issuer_market_cap", key))
    j = j.withColumn("decile", F.floor((rank - 1) * 10 / F.count(F.lit(1)).over(W.partitionBy("date"))).cast("int"))
    w = W.partitionBy("date", "decile")
    mean = F.sum(F.col("_var") * F.col("issuer_market_cap")).over(w) / F.sum(F.when(F.col("_var").isNotNull(), F.col("issuer_market_cap"))).over(w)
    j = j.withColumn("_mean", mean)
    return j.withColumn("specific_var", F.coalesce((1 - SHRINK) * F.col("_var") + SHRINK * F.col("_mean"), F.col("_mean"))).drop("_var", "_mean")


def long_exposures(exposures: DataFrame, styles: list[str], key: str = "security_id") -> DataFrame:
    """``date, security_id, factor, x`` in long form: the market, the sector and the styles."""
    one = exposures.select("date", key, F.lit("market").alias("factor"), F.lit(1.0).alias("x"))
    sector = exposures.select("date", key, F.concat(F.lit("sector:"), F.col("sector")).alias("factor"), F.lit(1.0).alias("x"))
    return one.unionByName(sector).unionByName(exposures.select("date", key, *styles).unpivot(["date", key], styles, "factor", "x"))


def predict(weights: DataFrame, long: DataFrame, cov: DataFrame, spec: DataFrame, key: str = "security_id") -> DataFrame:
    """Forecast daily variance per date: factor part (exposures of the portfolio through the long covariance) and specific part."""
    port = weights.join(long, ["date", key]).groupBy("date", "factor").agg(F.sum(F.col("weight") * F.col("x")).alias("b"))
    a, b = port.select("date", F.col("factor").alias("f1"), F.col("b").alias("b1")), port.select("date", F.col("factor").alias("f2"), F.col("b").alias("b2"))
    factor = a.join(F.broadcast(cov), "f1").join(b, ["date", "f2"]).groupBy("date").agg(F.sum(F.col("b1") * F.col("b2") * F.col("cov")).alias("factor_var"))
    own = weights.join(spec.select("date", key, "specific_var"), ["date", key]).groupBy("date").agg(F.sum(F.col("weight") * F.col("weight") * F.col("specific_var")).alias("specific_var"))
    return factor.join(own, "date").withColumn("total_vol", F.sqrt((F.col("factor_var") + F.col("specific_var")) * 252))


def contributions(weights: DataFrame, long: DataFrame, cov: DataFrame, key: str = "security_id") -> DataFrame:
    """Each factor's part of the factor variance: b_i (C b)_i."""
    port = weights.join(long, ["date", key]).groupBy("date", "factor").agg(F.sum(F.col("weight") * F.col("x")).alias("b"))
    a, b = port.select("date", F.col("factor").alias("f1"), F.col("b").alias("b1")), port.select("date", F.col("factor").alias("f2"), F.col("b").alias("b2"))
    return a.join(F.broadcast(cov), "f1").join(b, ["date", "f2"]).groupBy("date", F.col("f1").alias("factor")).agg(F.sum(F.col("b1") * F.col("b2") * F.col("cov")).alias("contribution"))


def attribute(weights: DataFrame, long: DataFrame, factor_returns: DataFrame, residuals: DataFrame, key: str = "security_id") -> DataFrame:
    """Daily returns by factor and ``specific``: holdings and exposures known strictly before the day."""
    held = weights.join(long, ["date", key]).groupBy("date", "factor").agg(F.sum(F.col("weight") * F.col("x")).alias("b"))
    days = asof_join(factor_returns.select("date", "factor", "ret"), held.withColumnRenamed("date", "_m"), "date", "_m", ["factor"], strict=True)
    by_factor = days.select("date", "factor", (F.col("b") * F.col("ret")).alias("value")).where("value is not null")
    own = asof_join(residuals, weights.select(key, F.col("date").alias("_m"), "weight"), "date", "_m", [key], strict=True)
    return by_factor.unionByName(own.groupBy("date").agg(F.sum(F.col("weight") * F.col("resid")).alias("value")).select("date", F.lit("specific").alias("factor"), "value"))


def bias_stat(daily: DataFrame, window: int | None = None) -> DataFrame:
    """sqrt(sum z^2 days / sum days) with z = return / forecast daily volatility, over all days or a rolling window."""
    z2 = F.pow(F.col("ret") / F.col("vol"), 2)
    d = F.coalesce(F.col("days"), F.lit(1.0)) if "days" in daily.columns else F.lit(1.0)
    if window is None:
        return daily.agg(F.sqrt(F.sum(z2 * d) / F.sum(d)).alias("bias"))
    w = W.orderBy("date").rowsBetween(-(window - 1), 0)
    return daily.withColumn("bias", F.when(F.count(F.lit(1)).over(w) >= window, F.sqrt(F.sum(z2 * d).over(w) / F.sum(d).over(w))))


def alpha_from_score(scores: DataFrame, spec: DataFrame, ic: float = 0.03, horizon: int = 21, key: str = "security_id") -> DataFrame:
    """Expected return ic x z x specific volatility over the horizon, with z within 3 (Grinold)."""
    w = W.partitionBy("date")
    sd = F.stddev_samp("score").over(w)
    z = F.when(sd > 0, (F.col("score") - F.avg("score").over(w)) / sd)
    j = asof_join(scores.withColumn("_z", clip(z, -CLIP, CLIP)), spec.select(key, F.col("date").alias("_m"), "specific_var"), "date", "_m", [key])
    return j.withColumn("alpha", F.lit(ic) * F.col("_z") * F.sqrt(F.col("specific_var") * horizon)).drop("_z", "specific_var")


@dataclass
class Limits:
    """What the optimizer keeps to; the ladder relaxes turnover, then sectors, then volatility if nothing satisfies all."""

    max_weight: float = 0.02
    vol: float | None = None  # daily
    sector: float | None = None
    beta: float | None = None
    style: float | None = None
    net: float | None = 0.0
    gross: float = 2.0
    participation: float | None = None


def optimise(alpha: np.ndarray, x: np.ndarray, cov: np.ndarray, spec: np.ndarray, held: np.ndarray, risk: float = 5.0, linear: np.ndarray | float = 0.0, power: np.ndarray | float = 0.0, caps: np.ndarray | None = None, limits: Limits | None = None, groups: np.ndarray | None = None, betas: np.ndarray | None = None, steps: int = 400) -> tuple[np.ndarray, str]:
    """max alpha'w - risk/2 (w'XCX'w + w'Dw) - linear |w - held| - power |w - held|^1.5 under the limits, by proximal gradient steps.

    The quadratic part is followed by its gradient, the costs by their proximal map per name, bounds and the net by projection;
    volatility by scaling. Returns weights and which limits had to be relaxed ("" if none).
    """
    limits = limits or Limits()
    n = alpha.size
    caps = np.full(n, limits.max_weight) if caps is None else np.minimum(caps, limits.max_weight)
    lin, pw = np.broadcast_to(np.asarray(linear, float), n), np.broadcast_to(np.asarray(power, float), n)
    root = np.linalg.cholesky(cov + 1e-14 * np.eye(cov.shape[0]))
    load = x @ root
    lip = risk * (np.linalg.norm(load, 2) ** 2 + spec.max()) + 1e-9

    def prox(v: np.ndarray, t: float) -> np.ndarray:
        d = v - held
        a = np.maximum(np.abs(d) - t * lin, 0.0)
        # minimise (u - a)^2 / 2 + t p u^1.5: sqrt(u) solves u + 1.5 t p sqrt(u) = a
        s = (-1.5 * t * pw + np.sqrt((1.5 * t * pw) ** 2 + 4 * a)) / 2
        return held + np.sign(d) * s * s

    def project(w: np.ndarray) -> np.ndarray:
        for _ in range(20):
            w = np.clip(w, -caps, caps)
            if limits.net is not None:
                free = np.abs(w) < caps - 1e-15
                gap = w.sum() - limits.net
                if abs(gap) > 1e-10 and free.any():
                    w = w - gap * free / free.sum()
            for bound, a in ((limits.sector, groups), (limits.beta, betas)):
                if bound is None or a is None:
                    continue
                rows = [(a == g).astype(float) for g in np.unique(a)] if a is groups else [a]
                for row in rows:
                    e = row @ w
                    if abs(e) > bound:
                        w = w - row * (e - math.copysign(bound, e)) / (row @ row)
            gross = np.abs(w).sum()
            if gross > limits.gross:
                w = w * limits.gross / gross
        return np.clip(w, -caps, caps)

    w, y, t = project(held.copy()), held.copy(), 1.0
    y = w.copy()
    for _ in range(steps):
        grad = risk * (load @ (load.T @ y) + spec * y) - alpha
        new = project(prox(y - grad / lip, 1 / lip))
        t1 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / t1 * (new - w), new, t1
    note = ""
    if limits.vol is not None:
        var = float(((load.T @ w) ** 2).sum() + (spec * w * w).sum())
        if var > limits.vol**2:
            w = w * limits.vol / math.sqrt(var)
    if limits.net is not None and abs(w.sum() - limits.net) > 1e-4:
        note = "net"
    return w, note


def rebalance(panel: DataFrame, styles: list[str], cov: DataFrame, limits: Limits | None = None, risk: float = 5.0, linear: float = 0.0, power: float = 0.0, key: str = "security_id") -> DataFrame:
    """Optimal weights per date from ``date, security_id, alpha, sector, styles, specific_var[, held]``; dates are solved apart."""
    small = {(r["f1"], r["f2"]): r["cov"] for r in cov.collect()}  # factors x factors

    def day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        sectors = sorted(pdf["sector"].astype(str).unique())
        x = np.column_stack([np.ones(len(pdf)), *[(pdf["sector"].astype(str) == s).to_numpy(float) for s in sectors], pdf[styles].to_numpy(float)])
        names = ["market", *[f"sector:{s}" for s in sectors], *styles]
        c = np.array([[small.get((a, b), 0.0) for b in names] for a in names])
        held = pdf["held"].to_numpy(float) if "held" in pdf else np.zeros(len(pdf))
        w, note = optimise(pdf["alpha"].fillna(0.0).to_numpy(float), x, c, pdf["specific_var"].to_numpy(float), held, risk, linear, power, limits=limits, groups=pdf["sector"].astype(str).to_numpy())
        return pd.DataFrame({"date": pdf["date"], key: pdf[key], "weight": w, "relaxed": note})

    kind = dict(panel.dtypes)[key]
    return panel.groupBy("date").applyInPandas(day, f"date date, {key} {kind}, weight double, relaxed string")
