"""The signal catalogue: one column expression per name over the point-in-time panel, and price signals over bars.

A ratio with a denominator that is not positive is null. Signals against market value are for companies that report in US dollars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import month_index, ratio, zero
from ..functions.windows import frame, rolling
from .asof import asof_join

STALE, LAG_TOLERANCE, SHORT_TOLERANCE = 10, 10, 35
VOL_WINDOW, HIGH_WINDOW, BETA_WINDOW = 63, 252, 252


@dataclass(frozen=True)
class Signal:
    name: str
    group: str
    direction: int
    expr: Column | None
    source: str = "fundamental"
    items: tuple[str, ...] = ()


def _cap() -> Column:
    """Issuer market cap, for reports in US dollars only."""
    return F.when(F.coalesce("currency", F.lit("USD")) == "USD", F.col("issuer_market_cap"))


def _ev() -> Column:
    """Market cap + long-term debt + short-term borrowings - cash; missing parts count 0."""
    c = F.col
    return _cap() + zero(c("long_term_debt")) + zero(c("short_term_borrowings")) - zero(c("cash"))


def catalogue() -> dict[str, Signal]:
    """All signals by name. Growth signals read ``<item>_lag`` columns (see ``add_lags``)."""
    c = F.col
    table: list[tuple] = [
        ("earnings_yield", "value", 1, ratio(c("net_income"), _cap()), "net_income"),
        ("book_to_market", "value", 1, ratio(c("equity"), _cap()), "equity"),
        ("sales_to_price", "value", 1, ratio(c("revenue"), _cap()), "revenue"),
        ("cash_flow_yield", "value", 1, ratio(c("operating_cash_flow"), _cap()), "operating_cash_flow"),
        ("fcf_yield", "value", 1, ratio(c("operating_cash_flow") - c("capex"), _cap()), "operating_cash_flow capex"),
        ("dividend_yield", "value", 1, ratio(c("dividends_paid"), _cap()), "dividends_paid"),
        ("shareholder_yield", "value", 1, ratio(F.when(c("dividends_paid").isNotNull() | c("buybacks").isNotNull(), zero(c("dividends_paid")) + zero(c("buybacks"))), _cap()), "dividends_paid buybacks"),
        ("ebit_to_ev", "value", 1, ratio(c("operating_income"), _ev()), "operating_income long_term_debt short_term_borrowings cash"),
        ("ebitda_to_ev", "value", 1, ratio(c("operating_income") + c("depreciation_amortization"), _ev()), "operating_income depreciation_amortization long_term_debt short_term_borrowings cash"),
        ("sales_to_ev", "value", 1, ratio(c("revenue"), _ev()), "revenue long_term_debt short_term_borrowings cash"),
        ("gross_margin", "profitability", 1, ratio(c("gross_profit"), c("revenue")), "gross_profit revenue"),
        ("operating_margin", "profitability", 1, ratio(c("operating_income"), c("revenue")), "operating_income revenue"),
        ("net_margin", "profitability", 1, ratio(c("net_income"), c("revenue")), "net_income revenue"),
        ("roe", "profitability", 1, ratio(c("net_income"), c("equity")), "net_income equity"),
        ("roa", "profitability", 1, ratio(c("net_income"), c("assets")), "net_income assets"),
        ("gross_profitability", "profitability", 1, ratio(c("gross_profit"), c("assets")), "gross_profit assets"),
        ("cash_roa", "profitability", 1, ratio(c("operating_cash_flow"), c("assets")), "operating_cash_flow assets"),
        ("accruals", "quality", -1, ratio(c("net_income") - c("operating_cash_flow"), c("assets")), "net_income operating_cash_flow assets"),
        ("asset_turnover", "quality", 1, ratio(c("revenue"), c("assets")), "revenue assets"),
        ("capex_to_sales", "quality", -1, ratio(c("capex"), c("revenue")), "capex revenue"),
        ("payout_ratio", "quality", 1, ratio(c("dividends_paid"), c("net_income")), "dividends_paid net_income"),
        ("sbc_to_sales", "quality", -1, ratio(c("stock_comp"), c("revenue")), "stock_comp revenue"),
        ("goodwill_to_assets", "quality", -1, ratio(c("goodwill"), c("assets")), "goodwill assets"),
        ("rnd_to_sales", "quality", 1, ratio(c("rnd"), c("revenue")), "rnd revenue"),
        ("sga_to_sales", "quality", 1, ratio(c("sga"), c("revenue")), "sga revenue"),
        ("tax_rate", "quality", 1, ratio(c("income_tax"), c("pretax_income")), "income_tax pretax_income"),
        ("debt_to_equity", "leverage", -1, ratio(c("long_term_debt"), c("equity")), "long_term_debt equity"),
        ("liabilities_to_assets", "leverage", -1, ratio(c("liabilities"), c("assets")), "liabilities assets"),
        ("cash_to_assets", "leverage", 1, ratio(c("cash"), c("assets")), "cash assets"),
        ("current_ratio", "leverage", 1, ratio(c("current_assets"), c("current_liabilities")), "current_assets current_liabilities"),
        ("interest_coverage", "leverage", 1, ratio(c("operating_income"), c("interest_expense")), "operating_income interest_expense"),
        ("size", "price", -1, F.when(c("issuer_market_cap") > 0, F.ln("issuer_market_cap")), ""),
    ]
    out = {n: Signal(n, g, d, e, "fundamental", tuple(items.split())) for n, g, d, e, items in table}
    growth = lambda x: F.when(F.col(f"{x}_lag") > 0, F.col(x) / F.col(f"{x}_lag") - 1)
    for n, d, e, items in (
        ("revenue_growth", 1, growth("revenue"), "revenue"),
        ("earnings_growth", 1, ratio(c("net_income") - c("net_income_lag"), c("assets_lag")), "net_income assets"),
        ("eps_growth", 1, growth("eps_diluted"), "eps_diluted"),
        ("asset_growth", -1, growth("assets"), "assets"),
        ("share_issuance", -1, growth("shares"), "shares"),
    ):
        out[n] = Signal(n, "growth", d, e, "growth", tuple(items.split()))
    for n, d in (("momentum_12_1", 1), ("reversal_1m", -1), ("high_52w", 1), ("volatility_3m", -1), ("beta_12m", -1), ("turnover", -1), ("illiquidity", 1)):
        out[n] = Signal(n, "price", d, None, "price")
    for n in ("si_pct_float", "si_pct_market_cap", "days_to_cover", "si_change"):
        out[n] = Signal(n, "short", -1, None, "short")
    return out


def resolve(names: list[str]) -> list[str]:
    """Signal names from names, groups, and "all"; unknown ones raise."""
    table = catalogue()
    groups = {s.group for s in table.values()}
    out: dict[str, None] = {}
    for n in names:
        found = list(table) if n == "all" else [k for k, s in table.items() if s.group == n] if n in groups else [n] if n in table else None
        if found is None:
            raise ValueError(f"unknown signal or group {n!r}")
        out.update(dict.fromkeys(found))
    return list(out)


def fundamental_signals(panel: DataFrame, names: list[str]) -> DataFrame:
    """The named fundamental and growth signals as columns; items that the panel lacks count as missing."""
    table = catalogue()
    need = {i for n in names for i in (*table[n].items, *(f"{x}_lag" for x in table[n].items if table[n].source == "growth"))} | {"currency", "issuer_market_cap"}
    kind = lambda x: "string" if x == "currency" else "double"
    full = panel.withColumns({x: F.lit(None).cast(kind(x)) for x in sorted(need - set(panel.columns))})
    return full.withColumns({n: table[n].expr for n in names if table[n].expr is not None})


def add_lags(panel: DataFrame, items: list[str], monthly: bool = True, key: str = "security_id") -> DataFrame:
    """``<item>_lag``: the value a year earlier, by calendar month (the last row of a month) or as of a year before within ten days."""
    if monthly:
        now = panel.withColumn("_m", month_index(F.col("date")))
        past = now.groupBy(key, "_m").agg(*[F.max_by(i, "date").alias(f"{i}_lag") for i in items]).withColumn("_m", F.col("_m") + 12)
        return now.join(past, [key, "_m"], "left").drop("_m")
    now = panel.withColumn("_ld", F.add_months("date", -12))
    past = panel.select(key, F.col("date").alias("_d"), *[F.col(i).alias(f"{i}_lag") for i in items])
    return asof_join(now, past, "_ld", "_d", [key], tolerance=LAG_TOLERANCE).drop("_ld")


def total_return_index(bars: DataFrame, key: str = "security_id", jump: float = 3.0) -> DataFrame:
    """Bars with ``ret`` (returns above the jump count 0), ``tr`` (index from 1) and ``px`` (split-adjusted close)."""
    w = W.partitionBy(key).orderBy("date")
    b = bars.withColumn("_tr", F.col("close") * F.col("div_factor")).withColumn("_p", F.lag("_tr").over(w))
    r = F.when(F.col("_p") > 0, F.col("_tr") / F.col("_p") - 1)
    b = b.withColumn("ret", F.when(r > jump, 0.0).otherwise(r))
    growth = F.ln(F.greatest(1 + F.coalesce("ret", F.lit(0.0)), F.lit(1e-12)))
    return b.withColumn("tr", F.exp(F.sum(growth).over(w.rowsBetween(W.unboundedPreceding, 0)))).withColumn("px", F.col("close")).drop("_tr", "_p")


def rolling_stats(daily: DataFrame, market: DataFrame | None = None, key: str = "security_id") -> DataFrame:
    """volatility_3m, high_52w, _dv63, illiquidity, and beta_12m where a market series (date, market_ret) is given."""
    d = daily.withColumn("_dv", F.col("close") * F.col("volume"))
    f = lambda n: frame([key], ["date"], n)
    out = d.withColumns({
        "volatility_3m": rolling(F.stddev_samp, F.col("ret"), f(VOL_WINDOW), 50) * F.sqrt(F.lit(252.0)),
        "high_52w": F.col("px") / rolling(F.max, F.col("px"), f(HIGH_WINDOW), 200),
        "_dv63": rolling(F.avg, F.col("_dv"), f(VOL_WINDOW), 50),
        "illiquidity": rolling(F.avg, F.when(F.col("_dv") > 0, F.abs("ret") / F.col("_dv")), f(VOL_WINDOW), 50) * 1e6,
    })
    if market is not None:
        out = out.join(F.broadcast(market.select("date", "market_ret")), "date", "left")
        both = F.col("ret").isNotNull() & F.col("market_ret").isNotNull()
        r, m = F.when(both, F.col("ret")), F.when(both, F.col("market_ret"))
        mean = lambda x: rolling(F.avg, x, f(BETA_WINDOW), 200)
        var = mean(m * m) - mean(m) * mean(m)
        out = out.withColumn("beta_12m", F.when(var > 0, (mean(r * m) - mean(r) * mean(m)) / var))
    return out.drop("_dv")


def price_at(points: DataFrame, daily: DataFrame, months: int, out: str, column: str = "tr", key: str = "security_id") -> DataFrame:
    """The index ``months`` before each point's date, at most ten days stale."""
    at = points.withColumn("_at", F.add_months("date", -months) if months else F.col("date"))
    source = daily.select(key, F.col("date").alias("_d"), F.col(column).alias(out))
    return asof_join(at, source, "_at", "_d", [key], tolerance=STALE).drop("_at")


def price_signals(points: DataFrame, bars: DataFrame, market: DataFrame | None = None, key: str = "security_id") -> DataFrame:
    """The price signals at (date, security) points: momentum_12_1, reversal_1m and the rolling ones as of each date."""
    daily = rolling_stats(total_return_index(bars, key), market, key)
    out = points
    for months, name in ((0, "_tr0"), (1, "_tr1"), (12, "_tr12")):
        out = price_at(out, daily, months, name, key=key)
    out = out.withColumn("momentum_12_1", ratio(F.col("_tr1"), F.col("_tr12")) - 1).withColumn("reversal_1m", ratio(F.col("_tr0"), F.col("_tr1")) - 1)
    names = ["volatility_3m", "high_52w", "illiquidity", "_dv63"] + (["beta_12m"] if market is not None else [])
    source = daily.select(key, F.col("date").alias("_d"), *names)
    out = asof_join(out, source, "date", "_d", [key], tolerance=STALE)
    if "issuer_market_cap" in out.columns:
        out = out.withColumn("turnover", ratio(F.col("_dv63"), F.col("issuer_market_cap")))
    return out.drop("_tr0", "_tr1", "_tr12", "_dv63")


def short_signals(points: DataFrame, short_interest: DataFrame, key: str = "security_id") -> DataFrame:
    """The latest report published at most 35 days before, and its change from the report before it."""
    w = W.partitionBy(key).orderBy("settlement_date")
    s = short_interest.withColumn("si_change", ratio(F.col("short_interest"), F.lag("short_interest").over(w)) - 1)
    keep = [c for c in ("si_pct_float", "si_pct_market_cap", "days_to_cover", "si_change") if c in s.columns]
    return asof_join(points, s.select(key, "published_date", *keep), "date", "published_date", [key], tolerance=SHORT_TOLERANCE)


def relabel(rows: DataFrame, links: DataFrame, key: str = "security_id", depth: int = 2) -> DataFrame:
    """Rows of predecessors (``links: predecessor_id, successor_id, link_date``) before the link date under the successor's id."""
    out = rows
    small = F.broadcast(links.select(F.col("predecessor_id").alias("_p"), F.col("successor_id").alias("_s"), F.col("link_date").alias("_l")))
    for _ in range(depth):
        out = out.join(small, (F.col(key) == F.col("_p")) & (F.col("date") < F.col("_l")), "left").withColumn(key, F.coalesce("_s", key)).drop("_p", "_s", "_l")
    return out
