"""Point-in-time company fundamentals from filed facts.

``facts(cik, tag, unit, start, end, val, accn, filed[, ...])``: a period and the day it became known. Everything is partitioned
by company, and a value is usable from the day after its filing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof_join

QUARTER, HALF, YEAR = (80, 100), (170, 195), (350, 380)
STALE_DAYS = 400
JUMP = 1.5


@dataclass(frozen=True)
class Item:
    """A concept: its kind, the tags that carry it in order of priority, and rules."""

    name: str
    kind: str  # instant, flow or per_share
    tags: tuple[str, ...]
    nonnegative: bool = False
    second_quarter: bool = False


def _first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def choose(facts: DataFrame, policy: str = "first", keys: list[str] | None = None) -> DataFrame:
    """One value per company, tag, unit and period: the first one filed, or the latest."""
    if policy not in ("first", "latest"):
        raise ValueError("policy is 'first' or 'latest'")
    keys = keys or [c for c in ("cik", "tag", "unit", "start", "end") if c in facts.columns]
    down = policy == "latest"
    return _first(facts, keys, [F.col(c).desc() if down else F.col(c).asc() for c in ("filed", "accn", "val")])


def resolve_tags(facts: DataFrame, tags: list[str], keys: list[str] | None = None) -> DataFrame:
    """Across tags the value known earliest wins; the order of tags only breaks ties."""
    keys = keys or [c for c in ("cik", "start", "end") if c in facts.columns]
    rank = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    extra = [F.col(c) for c in ("unit", "start", "val") if c in facts.columns]
    return _first(facts.where(F.col("tag").isin(tags)).withColumn("_rank", rank), keys, [F.col("filed"), F.col("_rank"), *extra]).drop("_rank")


def drop_translations(facts: DataFrame) -> DataFrame:
    """Convenience translations go: where a filing reports in a company's main currency, values in others."""
    counts = facts.groupBy("cik", "unit").count()
    main = _first(counts, ["cik"], [F.desc("count"), F.col("unit")]).select("cik", F.col("unit").alias("_main"))
    joined = facts.join(main, "cik")
    has_main = F.max(F.when(F.col("unit") == F.col("_main"), 1).otherwise(0)).over(W.partitionBy("cik", "accn"))
    return joined.withColumn("_has", has_main).where("unit = _main or _has = 0").drop("_main", "_has")


def redate_second_quarter(cover: DataFrame, fiscal_ends: DataFrame) -> DataFrame:
    """Cover-page figures stated for the end of the second quarter: the fiscal year's end (cik, accn, fiscal_end) less six months.

    Only where the stated date lies after that day, as figures dated by the filing do.
    """
    joined = cover.join(fiscal_ends.select("cik", "accn", "fiscal_end"), ["cik", "accn"], "left")
    second = F.last_day(F.add_months("fiscal_end", -6))
    return joined.withColumn("end", F.when(F.col("fiscal_end").isNotNull() & (F.col("end") > F.col("fiscal_end")), second).otherwise(F.col("end"))).drop("fiscal_end")


def _span(days: Column, lengths: tuple[int, int], slack: int = 0) -> Column:
    return days.between(lengths[0] - slack, lengths[1])


def periodize(facts: DataFrame, lengths: tuple[int, int] = QUARTER) -> DataFrame:
    """Periods of one length: those reported, and differences of cumulative values with one start (Q4 = year - nine months).

    A derived period starts the day after the shorter one ends and is known when both are; reported ones win.
    """
    days = F.datediff("end", "start") + 1
    reported = facts.where(_span(days, lengths)).withColumn("derived", F.lit(False))
    w = W.partitionBy("cik", "unit", "tag", "start").orderBy("end")
    cumulative = facts.withColumn("_pv", F.lag("val").over(w)).withColumn("_pe", F.lag("end").over(w)).withColumn("_pf", F.lag("filed").over(w)).where("_pv is not null")
    derived = (
        cumulative.withColumn("val", F.col("val") - F.col("_pv")).withColumn("start", F.date_add("_pe", 1)).withColumn("filed", F.greatest("filed", "_pf"))
        .where(_span(F.datediff("end", "start") + 1, lengths, 1)).withColumn("derived", F.lit(True)).drop("_pv", "_pe", "_pf")
    )
    return _first(reported.unionByName(derived), ["cik", "unit", "tag", "end"], [F.col("derived"), F.col("filed"), F.col("start"), F.col("val")])


def add_ttm(periods: DataFrame, n: int = 4, keys: tuple[str, ...] = ("cik", "unit", "tag")) -> DataFrame:
    """``ttm, ttm_filed``: the sum of n consecutive periods, with 0 to 7 days between each and 350 to 380 days in all."""
    w = W.partitionBy(*[k for k in keys if k in periods.columns]).orderBy("end")
    total, filed, fine = F.col("val"), F.col("filed"), F.lit(True)
    later_start = F.col("start")
    for k in range(1, n):
        total = total + F.lag("val", k).over(w)
        filed = F.greatest(filed, F.lag("filed", k).over(w))
        gap = F.datediff(later_start, F.lag("end", k).over(w)) - 1
        fine = fine & gap.between(0, 7)
        later_start = F.lag("start", k).over(w)
    span = F.datediff("end", later_start) + 1
    ok = F.coalesce(fine & _span(span, YEAR), F.lit(False))
    return periods.withColumn("ttm", F.when(ok, total)).withColumn("ttm_filed", F.when(ok, filed))


def pick_tag(periods: DataFrame, tags: list[str], nonnegative: bool = False) -> DataFrame:
    """One tag per period: reported before derived, then the order of tags; negative derived values go where an item has none."""
    rank = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    rows = periods.where(~(F.col("derived") & (F.col("val") < 0))) if nonnegative else periods
    return _first(rows.withColumn("_rank", rank), ["cik", "end"], [F.col("derived"), F.col("_rank"), F.col("filed"), F.col("unit"), F.col("val")]).drop("_rank")


def share_jumps(shares: DataFrame, factor: float = JUMP) -> DataFrame:
    """``cik, before, after, ratio``: neighbouring counts that differ by the factor or more."""
    w = W.partitionBy("cik").orderBy("end", "filed")
    s = shares.withColumn("before", F.lag("end").over(w)).withColumn("_p", F.lag("val").over(w)).where("_p > 0 and val > 0")
    ratio = F.col("val") / F.col("_p")
    return s.where(F.abs(F.ln(ratio)) >= F.ln(F.lit(factor))).select("cik", "before", F.col("end").alias("after"), ratio.alias("ratio"))


def per_share_ttm(quarters: DataFrame, annual: DataFrame, jumps: DataFrame) -> DataFrame:
    """Per-share TTM: the annual figure where a year ends, else four quarters unless a share jump lies between them."""
    summed = add_ttm(quarters).where("ttm is not null").select("cik", "end", F.col("ttm").alias("_sum"), F.col("ttm_filed").alias("_sf"))
    crossed = (
        summed.join(jumps.select("cik", "before", "after"), "cik").where((F.col("after") > F.add_months("end", -12)) & (F.col("before") < F.col("end"))).select("cik", "end").distinct().withColumn("_cross", F.lit(True))
    )
    clean = summed.join(crossed, ["cik", "end"], "left").withColumn("_sum", F.when(F.col("_cross").isNull(), F.col("_sum"))).drop("_cross")
    years = _first(annual, ["cik", "end"], [F.col("filed"), F.col("val")]).select("cik", "end", F.col("val").alias("_year"), F.col("filed").alias("_yf"))
    both = clean.join(years, ["cik", "end"], "full")
    ttm = F.coalesce("_year", "_sum")
    return both.select("cik", "end", ttm.alias("ttm"), F.when(F.col("_year").isNotNull(), F.col("_yf")).otherwise(F.col("_sf")).alias("ttm_filed")).where("ttm is not null")


def build_series(facts: DataFrame, item: Item, policy: str = "first") -> DataFrame:
    """``cik, item, unit, end, value, available_from, ttm, ttm_available_from`` of one item."""
    own = facts.where(F.col("tag").isin(list(item.tags)))
    if item.kind == "instant":
        rows = resolve_tags(choose(own.drop("start") if "start" in own.columns else own, policy), list(item.tags), ["cik", "end"])
        if item.nonnegative:
            rows = rows.where("val >= 0")
        out = rows.withColumn("ttm", F.lit(None).cast("double")).withColumn("ttm_filed", F.lit(None).cast("date"))
    else:
        chosen = drop_translations(choose(own, policy))
        quarters = add_ttm(pick_tag(periodize(chosen), list(item.tags), item.nonnegative), keys=("cik", "unit"))
        halves = add_ttm(pick_tag(periodize(chosen, HALF), list(item.tags), item.nonnegative), 2, ("cik", "unit"))
        years = pick_tag(periodize(chosen, YEAR), list(item.tags), item.nonnegative)
        best = (
            quarters.select("cik", "end", "ttm", "ttm_filed", F.lit(1).alias("_o"))
            .unionByName(halves.select("cik", "end", "ttm", "ttm_filed", F.lit(2).alias("_o")))
            .unionByName(years.select("cik", "end", F.col("val").alias("ttm"), F.col("filed").alias("ttm_filed"), F.lit(0).alias("_o"))).where("ttm is not null")
        )
        best = _first(best, ["cik", "end"], [F.col("ttm_filed"), F.col("_o")]).drop("_o")
        values = quarters.select("cik", "unit", "end", "val", "filed")
        out = values.join(best, ["cik", "end"], "full")
    next_day = lambda c: F.date_add(c, 1)
    return out.select("cik", F.lit(item.name).alias("item"), "unit", "end", F.col("val").alias("value"), next_day("filed").alias("available_from"), "ttm", next_day("ttm_filed").alias("ttm_available_from"))


def drop_spikes(series: DataFrame, key: str = "cik", value: str = "val", passes: int = 2) -> DataFrame:
    """Isolated values more than 5x away from both neighbours that agree within 1.5x go; edges beyond 200x too."""
    out = series.where(F.col(value) > 0)
    w = W.partitionBy(key).orderBy("end", "filed")
    x, p, n = F.ln(value), F.ln(F.lag(value).over(w)), F.ln(F.lead(value).over(w))
    spike = (F.abs(x - p) > F.ln(F.lit(5.0))) & (F.abs(x - n) > F.ln(F.lit(5.0))) & (F.abs(p - n) < F.ln(F.lit(1.5)))
    edge = (p.isNull() & (F.abs(x - n) > F.ln(F.lit(200.0)))) | (n.isNull() & (F.abs(x - p) > F.ln(F.lit(200.0))))
    for bad in [spike] * passes + [edge]:
        out = out.withColumn("_bad", F.coalesce(bad, F.lit(False))).where("not _bad").drop("_bad")
    return out


def stitch_shares(concepts: DataFrame, precedence: list[str], window: int = 120, gap: int = 100) -> DataFrame:
    """Share counts of the concept with most filings, filled by agreeing ones where it has nothing within ``gap`` days.

    A concept agrees if the median ratio to the main one's nearest value (within ``window`` days) is between 1/1.5 and 1.5.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in precedence]), F.col("tag"))
    counts = concepts.groupBy("cik", "tag").agg(F.countDistinct("accn").alias("_c")).withColumn("_r", rank)
    main = _first(counts, ["cik"], [F.desc("_c"), F.col("_r")]).select("cik", F.col("tag").alias("_main"))
    tagged = concepts.join(main, "cik")
    own = tagged.where("tag = _main")
    other = tagged.where("tag <> _main")
    near = asof_join(other, own.select("cik", F.col("end").alias("_pend"), F.col("val").alias("_pv")), "end", "_pend", ["cik"], strategy="nearest", keep_key=True, tie=["_pv"])
    close = near.where(F.abs(F.datediff("end", "_pend")) <= window)
    agreeing = close.groupBy("cik", "tag").agg(F.median(F.col("val") / F.col("_pv")).alias("_m")).where((F.col("_m") >= 1 / JUMP) & (F.col("_m") <= JUMP))
    fill = near.where(F.col("_pend").isNull() | (F.abs(F.datediff("end", "_pend")) > gap)).join(agreeing, ["cik", "tag"], "left_semi").drop("_pend", "_pv")
    filled = _first(fill.withColumn("_r", rank), ["cik", "end"], [F.col("_r"), F.col("filed")]).drop("_r")
    return own.unionByName(filled).drop("_main")


def share_concepts(facts: DataFrame) -> DataFrame:
    """Facts without per-class counts (several values of one filing and date); averages keep their shortest duration."""
    per_class = facts.groupBy("cik", "tag", "end", "accn").agg(F.countDistinct("val").alias("_d")).where("_d > 1").select("cik", "tag", "end", "accn")
    rows = facts.join(per_class, ["cik", "tag", "end", "accn"], "left_anti")
    days = F.datediff("end", "start") if "start" in rows.columns else F.lit(0)
    return _first(rows.withColumn("_days", F.coalesce(days, F.lit(0))), ["cik", "tag", "end", "accn"], [F.col("_days"), F.col("val")]).drop("_days")


def build_shares(facts: DataFrame, precedence: list[str]) -> DataFrame:
    """``cik, end, shares, filed, available_from, tag``: shares outstanding."""
    chosen = choose(share_concepts(facts.where(F.col("tag").isin(precedence))), "first", ["cik", "tag", "end"])
    clean = drop_spikes(stitch_shares(chosen, precedence))
    return clean.select("cik", "end", F.col("val").alias("shares"), "filed", F.date_add("filed", 1).alias("available_from"), "tag")


def latest_as_of(series: DataFrame, on: str, keys: list[str] | None = None, stale_days: int = STALE_DAYS) -> DataFrame:
    """What was known on a day: the newest period of each key that was available, unless it ended too long before."""
    day = F.to_date(F.lit(on))
    usable = series.where((F.col("available_from") <= day) & (F.col("end") >= F.date_sub(day, stale_days)))
    return _first(usable, keys or ["cik", "item"], [F.desc("end"), F.desc("available_from"), F.desc("value")])


def newest_known(series: DataFrame, key: str = "cik") -> DataFrame:
    """Series without rows that become available after a newer period did (a running maximum of ``end`` by availability)."""
    w = W.partitionBy(key).orderBy("available_from", "end").rowsBetween(W.unboundedPreceding, 0)
    return series.withColumn("_top", F.max("end").over(w)).where(F.col("end") >= F.col("_top")).drop("_top")


def panel(points: DataFrame, series: DataFrame, items: list[str], key: str = "cik", value: str = "value", stale_days: int = STALE_DAYS) -> DataFrame:
    """All items at (date, company) points in one as-of pass over the pivoted, forward-filled series."""
    wide = series.where(F.col("item").isin(items)).groupBy(key, "available_from").pivot("item", items).agg(F.max_by(F.struct("end", value), "end"))
    w = W.partitionBy(key).orderBy("available_from").rowsBetween(W.unboundedPreceding, 0)
    # the newest period known, never an older one that was filed later
    filled = wide.select(key, "available_from", *[F.max(i).over(w).alias(i) for i in items])
    out = asof_join(points, filled, "date", "available_from", [key])
    fresh = lambda i: F.when(F.col(i)["end"] >= F.date_sub("date", stale_days), F.col(i)[value])
    return out.withColumns({i: fresh(i) for i in items})
