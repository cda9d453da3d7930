"""Trading costs: fitted or estimated half-spreads, square-root impact, borrow."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import clip

LEAST_BPS, MOST_BPS = 0.5, 200.0


@dataclass
class SpreadFit:
    """log half-spread (bp) = level(year) + slope ln(ADV / 1e8) + vol slope ln(vol / 2%) + changes of slope beyond knots."""

    levels: dict[int, float]
    slope: float
    vol_slope: float
    hinges: list[tuple[float, float]] = field(default_factory=list)
    reference: float = 1e8

    def bps(self, year: Column, adv: Column, vol: Column) -> Column:
        """Half-spread in basis points; null without an ADV, a missing volatility counts as 3 %, years outside take the nearest level."""
        years = sorted(self.levels)
        level = F.create_map(*chain.from_iterable((F.lit(y), F.lit(float(self.levels[y]))) for y in years))
        at = F.element_at(level, clip(year.cast("int"), years[0], years[-1]).cast("int"))
        v = F.greatest(F.coalesce(vol, F.lit(0.03)), F.lit(1e-4))
        power = self.slope * F.ln(adv / self.reference) + self.vol_slope * F.ln(v / 0.02)
        import math

        for knot, change in self.hinges:
            power = power + change * (F.greatest(F.ln(adv / knot), F.lit(0.0)) - max(math.log(self.reference / knot), 0.0))
        return F.when(adv > 0, at * F.exp(power))


#: The fitted spread (fixed values).
SPREAD_FIT = SpreadFit(
    {
        2003: 3.5052, 2004: 3.2078, 2005: 3.1232, 2006: 3.1249, 2007: 2.7474, 2008: 3.474, 2009: 2.3179, 2010: 2.3981, 2011: 2.5651, 2012: 2.4597, 2013: 2.5653, 2014: 2.9181,
        2015: 2.8649, 2016: 2.7549, 2017: 2.9604, 2018: 3.14, 2019: 2.8522, 2020: 3.2003, 2021: 3.3349, 2022: 3.2131, 2023: 2.9192, 2024: 3.074, 2025: 3.0682, 2026: 3.4011,
    },
    -0.3880, 0.6244, [(1e6, -0.1122), (1e7, 0.1334)],
)


@dataclass
class CostModel:
    """Costs of one trade as a share of the portfolio, and yearly borrow rates.

    ``spread`` is ``fitted``, ``volume`` (``volume_bps`` over the root of ADV in millions), ``estimate`` (the column given) or a number of
    basis points; in an ``auction`` there is none. All but the number are kept within 0.5 and 200 bp, the most without a figure.
    """

    fit: SpreadFit | None = field(default_factory=lambda: SPREAD_FIT)
    impact: float = 1.0
    aum: float | None = None
    borrow: float = 0.0025
    hard_borrow: float = 0.03
    hard_short_interest: float = 0.20
    spread: str | float = "fitted"
    auction: bool = False
    volume_bps: float = 30.0
    commission_bps: float = 1.0

    def spread_cost(self, trade: Column, year: Column, adv: Column, vol: Column, estimate: Column | None = None) -> Column:
        """Half-spread and commission."""
        if self.auction:
            bps = F.lit(0.0)
        elif isinstance(self.spread, (int, float)):
            bps = F.lit(float(self.spread))
        else:
            raw = {"fitted": lambda: self.fit.bps(year, adv, vol), "volume": lambda: F.when(adv > 0, self.volume_bps * F.pow(adv / 1e6, F.lit(-0.5))), "estimate": lambda: estimate * 1e4}[self.spread]()
            bps = clip(F.coalesce(raw, F.lit(MOST_BPS)), LEAST_BPS, MOST_BPS)
        return F.abs(trade) * (bps + self.commission_bps) / 1e4

    def impact_cost(self, trade: Column, adv: Column, vol: Column, nav: Column | None = None) -> Column:
        """coefficient x volatility x square root of the traded share of ADV; nothing without AUM, the most without ADV."""
        if self.aum is None:
            return F.lit(0.0)
        dollars = F.abs(trade) * self.aum * (nav if nav is not None else F.lit(1.0))
        rate = self.impact * F.coalesce(vol, F.lit(0.03)) * F.sqrt(dollars / adv)
        return F.abs(trade) * F.when(adv > 0, rate).otherwise(MOST_BPS / 1e4)

    def borrow_rate(self, si_pct_float: Column) -> Column:
        return F.when(si_pct_float > self.hard_short_interest, self.hard_borrow).otherwise(self.borrow)


def commission(shares: Column, price: Column, per_share: float = 0.0035, least: float = 0.35, most_share: float = 0.01) -> Column:
    """Dollars of one order: per share, at least a minimum, at most a share of its value."""
    return F.when(shares == 0, 0.0).otherwise(F.least(F.greatest(F.abs(shares) * per_share, F.lit(least)), F.abs(shares) * price * most_share))
