"""Corporate-action adjustment: factors as step functions of the date, read by a forward as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof_join


def _steps(events: DataFrame, key: str, date: str, step) -> DataFrame:
    """Per key and day before an event the product of this and all later steps, as (key, eff_date, factor)."""
    daily = events.groupBy(key, date).agg(F.product(step).alias("_step"))
    later = W.partitionBy(key).orderBy(F.col(date).desc()).rowsBetween(W.unboundedPreceding, 0)
    # an event counts for days strictly before it: eff_date = date - 1 turns that into "at or before"
    return daily.select(key, F.date_sub(date, 1).alias("eff_date"), F.product("_step").over(later).alias("factor"))


def split_factor_table(splits: DataFrame, key: str = "ticker", date: str = "execution_date") -> DataFrame:
    """(key, eff_date, factor): for days up to eff_date the product of from/to of this and all later splits.

    A missing ratio counts as 1; rows with a split_to that is not positive or without a date are dropped.
    """
    usable = splits.where(F.col(date).isNotNull() & (F.col("split_to") > 0))
    r = F.nanvl(F.col("split_from").cast("double") / F.col("split_to"), F.lit(None))
    return _steps(usable, key, date, F.coalesce(r, F.lit(1.0)))


def dividend_factor_table(dividends: DataFrame, key: str = "ticker", date: str = "ex_dividend_date") -> DataFrame:
    """The vendor's cumulative factors as steps: a row's factor holds for days before its ex-date."""
    usable = dividends.where(F.col(date).isNotNull() & F.col("historical_adjustment_factor").isNotNull())
    return usable.groupBy(key, date).agg(F.min("historical_adjustment_factor").alias("factor")).select(key, F.date_sub(date, 1).alias("eff_date"), "factor")


def dividend_factor_table_from_steps(dividends: DataFrame, key: str = "security_id", date: str = "ex_dividend_date", step: str = "factor") -> DataFrame:
    """Own step factors (1 - cash / previous close) multiplied over this and all later ex-dates."""
    return _steps(dividends.where(F.col(date).isNotNull()), key, date, F.coalesce(F.col(step), F.lit(1.0)))


def attach_factor(bars: DataFrame, table: DataFrame, key: str, out: str, date: str = "date") -> DataFrame:
    """The factor in force on each bar's date, 1 where there is none."""
    joined = asof_join(bars, table.withColumnRenamed("factor", "_factor"), date, "eff_date", [key], strategy="forward")
    return joined.withColumn(out, F.coalesce("_factor", F.lit(1.0))).drop("_factor")


def adjust_bars(bars: DataFrame, splits: DataFrame | None = None, dividends: DataFrame | None = None, key: str = "ticker", date: str = "date") -> DataFrame:
    """Prices times the split and dividend factors, volume over the split factor; factors are kept as columns."""
    out = attach_factor(bars, splits, key, "split_factor", date) if splits is not None else bars.withColumn("split_factor", F.lit(1.0))
    out = attach_factor(out, dividends, key, "div_factor", date) if dividends is not None else out.withColumn("div_factor", F.lit(1.0))
    prices = {c: F.col(c) * F.col("split_factor") * F.col("div_factor") for c in ("open", "high", "low", "close", "vwap") if c in bars.columns}
    if "volume" in bars.columns:
        prices["volume"] = F.col("volume") / F.col("split_factor")
    return out.withColumns(prices)
