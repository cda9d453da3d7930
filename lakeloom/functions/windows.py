"""Window helpers: rolling statistics with a minimum count, ranks, quantiles, fills, exponential means.

Frames are row frames over the entity's ordered rows and count values that are not null, so a statistic is null until
``least`` values are in its frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frame(keys: list[str], order: list[str], rows: int) -> WindowSpec:
    """The current row and the ``rows - 1`` before it."""
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)


def upto(keys: list[str], order: list[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def rolling(agg, x: Column, w: WindowSpec, least: int) -> Column:
    """An aggregate over a frame, null below ``least`` values."""
    return F.when(F.count(x).over(w) >= least, agg(x).over(w))


def rolling_median(x: Column, w: WindowSpec, least: int = 1) -> Column:
    """The median of a row frame (``median`` takes no row frame): the middle of the sorted values."""
    values = F.sort_array(F.collect_list(x).over(w))
    n = F.size(values)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n >= least, (F.get(values, lo) + F.get(values, hi)) / 2)


def fill_forward(x: Column, keys: list[str], order: list[str]) -> Column:
    return F.last(x, ignorenulls=True).over(upto(keys, order))


def fill_backward(x: Column, keys: list[str], order: list[str]) -> Column:
    return F.last(x, ignorenulls=True).over(upto(keys, [F.col(c).desc() for c in order]))


def average_rank(x: Column, keys: list[str]) -> Column:
    """Rank among values that are not null, ties sharing their mean rank; null for null."""
    by = W.partitionBy(*keys, x.isNull()).orderBy(x)
    peers = W.partitionBy(*keys, x)
    return F.when(x.isNotNull(), F.rank().over(by) + (F.count(F.lit(1)).over(peers) - 1) / 2.0)


def percentile_rank(x: Column, keys: list[str]) -> Column:
    """(average rank - 0.5) / number of values."""
    return (average_rank(x, keys) - 0.5) / F.count(x).over(W.partitionBy(*keys))


def zscore(x: Column, keys: list[str]) -> Column:
    """(x - mean) / sample deviation; null where the deviation is null or zero."""
    w = W.partitionBy(*keys)
    sd = F.stddev_samp(x).over(w)
    return F.when(sd > 0, (x - F.avg(x).over(w)) / sd)


def nearest_quantile(x: Column, q: float) -> Column:
    """An aggregate: the value whose place is nearest to q (halves upwards), of groups of bounded size such as one date."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor((F.size(values) - 1) * F.lit(q) + 0.5).cast("int"))


def winsorized(df: DataFrame, columns: list[str], q: float, keys: list[str]) -> DataFrame:
    """The columns pulled to the q and 1 - q quantiles of their group; q = 0 leaves them. One sort a group, then a join on it."""
    if q <= 0:
        return df
    bounds = df.groupBy(*keys).agg(*[nearest_quantile(F.col(c), p).alias(f"_{side}_{c}") for c in columns for side, p in (("lo", q), ("hi", 1 - q))])
    same = [F.col(f"_key_{k}").eqNullSafe(F.col(k)) for k in keys]
    for k in keys:
        bounds = bounds.withColumnRenamed(k, f"_key_{k}")
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    pulled = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))) for c in columns}
    return df.join(bounds, condition).select(*[pulled.get(c, F.col(c)).alias(c) for c in df.columns])


def run_ids(changed: Column, keys: list[str], order: list[str]) -> Column:
    """Numbers runs of rows: one more wherever ``changed`` is true."""
    return F.sum(F.when(changed, 1).otherwise(0)).over(upto(keys, order))


def decayed_mean(df: DataFrame, x: str, keys: list[str], order: str, half_life: float, out: str, least: int = 1) -> DataFrame:
    """The exponentially weighted mean (weights adjusted) of the rows so far; nulls keep their place but no weight.

    One fold over the entity's ordered values in an array: exact and free of overflow, for entities of bounded length.
    """
    decay = 0.5 ** (1.0 / half_life)
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x")))).alias("_rows"))
    step = lambda acc, r: F.struct(
        (acc["s"] * decay + F.coalesce(r["x"], F.lit(0.0))).alias("s"),
        (acc["w"] * decay + F.when(r["x"].isNotNull(), 1.0).otherwise(0.0)).alias("w"),
        (acc["n"] + F.when(r["x"].isNotNull(), 1).otherwise(0)).alias("n"),
        F.concat(acc["out"], F.array(F.struct(r["o"].alias("o"), F.when(acc["n"] + F.when(r["x"].isNotNull(), 1).otherwise(0) >= least, (acc["s"] * decay + F.coalesce(r["x"], F.lit(0.0))) / (acc["w"] * decay + F.when(r["x"].isNotNull(), 1.0).otherwise(0.0))).alias("m")))).alias("out"),
    )
    kind = dict(df.dtypes)[order]
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), F.lit(0).alias("n"), F.array().cast(f"array<struct<o:{kind},m:double>>").alias("out"))
    means = packed.select(*keys, F.explode(F.aggregate("_rows", start, step, lambda acc: acc["out"])).alias("_r")).select(*keys, F.col("_r.o").alias(order), F.col("_r.m").alias(out))
    return df.join(means, [*keys, order])
