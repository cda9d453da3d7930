"""Table schemas (DDL). Reads tolerate missing and extra columns; writes cast to the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_CSV = "ticker string, volume double, open double, close double, high double, low double, window_start long, transactions long"
BARS = "ticker string, date date, timestamp timestamp, open double, high double, low double, close double, volume double, transactions long"
TRADE_CSV = "ticker string, conditions string, correction int, exchange int, id string, participant_timestamp long, price double, sequence_number long, sip_timestamp long, size double, tape int, trf_id int, trf_timestamp long"
QUOTE_CSV = "ticker string, ask_exchange int, ask_price double, ask_size double, bid_exchange int, bid_price double, bid_size double, conditions string, indicators string, participant_timestamp long, sequence_number long, sip_timestamp long, tape int, trf_timestamp long"
FACTS = "cik string, taxonomy string, tag string, unit string, start date, end date, val double, accn string, fy int, fp string, form string, filed date, frame string"
SHORT_INTEREST = "settlement_date date, published_date date, symbol string, issue_name string, market string, short_interest long, previous_short_interest long, change long, change_pct double, avg_daily_volume long, days_to_cover double, split_flag string, revision_flag string"
SHORT_VOLUME = "date date, symbol string, short_volume double, short_exempt_volume double, total_volume double, markets string, source string"
SPLITS = "ticker string, execution_date date, split_from double, split_to double"
DIVIDENDS = "ticker string, ex_dividend_date date, cash_amount double, currency string, historical_adjustment_factor double"
MANIFEST = "dataset string, partition string, rows long, bytes long, version long"

#: name -> (mode, keys, kind). Modes: snapshot (overwrite), accumulate and timeseries (keyed upsert), flat (files per day), live.
DATASETS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "bars_day": ("flat", ("date",), "bars"), "bars_minute": ("flat", ("date",), "bars"), "trades": ("flat", ("date",), "ticks"), "quotes": ("flat", ("date",), "ticks"),
    "tickers": ("snapshot", ("ticker",), "json"), "ticker_details": ("accumulate", ("ticker", "as_of"), "json"), "ticker_types": ("snapshot", (), "json"), "exchanges": ("snapshot", (), "json"), "conditions": ("snapshot", (), "json"),
    "market_holidays": ("accumulate", ("date", "exchange"), "json"), "splits": ("snapshot", ("id",), "json"), "dividends": ("snapshot", ("id",), "json"), "ipos": ("snapshot", ("ticker", "announced_date", "listing_date"), "json"),
    **{n: ("timeseries", ("cik", "period_end", "timeframe", "fiscal_year", "fiscal_quarter", "filing_date"), "json") for n in ("income_statements", "balance_sheets", "cash_flow_statements")},
    "ratios": ("timeseries", ("ticker", "date"), "json"), "float": ("accumulate", ("ticker", "effective_date"), "json"), "short_interest": ("timeseries", ("ticker", "settlement_date"), "json"), "short_volume": ("timeseries", ("ticker", "date"), "json"), "news": ("timeseries", ("id",), "json"),
    "live_bars_1m": ("live", ("date",), "AM"), "live_bars_1s": ("live", ("date",), "A"), "live_trades": ("live", ("date",), "T"), "live_quotes": ("live", ("date",), "Q"), "live_luld": ("live", ("date",), "LULD"),
}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the columns of the schema, cast; missing ones null, others left out."""
    schema = T.StructType.fromDDL(ddl)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
