"""Live capture on Structured Streaming: events to typed rows, micro-batch files per New York day, compaction, follow.

Late rows are never dropped: they land in the folder of their event's day with a later ``received_at``. The checkpoint gives
retry and exactly-once files; windowed outputs (an addition) are the only ones with an event-time watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import eastern_date

#: channel -> (dataset, time field in milliseconds, {column: (field, type)}) (fixed values of the feed's format).
CHANNELS: dict[str, tuple[str, str, dict[str, tuple[str, str]]]] = {
    "AM": ("live_bars_1m", "s", {"ticker": ("sym", "string"), "open": ("o", "double"), "high": ("h", "double"), "low": ("l", "double"), "close": ("c", "double"), "volume": ("v", "double"), "end_ms": ("e", "long")}),
    "A": ("live_bars_1s", "s", {"ticker": ("sym", "string"), "open": ("o", "double"), "high": ("h", "double"), "low": ("l", "double"), "close": ("c", "double"), "volume": ("v", "double"), "end_ms": ("e", "long")}),
    "T": ("live_trades", "t", {"ticker": ("sym", "string"), "price": ("p", "double"), "size": ("s", "double"), "exchange": ("x", "int"), "conditions": ("c", "array<smallint>"), "id": ("i", "string"), "sequence_number": ("q", "long"), "tape": ("z", "int")}),
    "Q": ("live_quotes", "t", {"ticker": ("sym", "string"), "bid_price": ("bp", "double"), "bid_size": ("bs", "double"), "bid_exchange": ("bx", "int"), "ask_price": ("ap", "double"), "ask_size": ("as", "double"), "ask_exchange": ("ax", "int"), "sequence_number": ("q", "long"), "tape": ("z", "int")}),
    "LULD": ("live_luld", "t", {"ticker": ("T", "string"), "high": ("h", "double"), "low": ("l", "double"), "indicators": ("i", "array<smallint>"), "sequence_number": ("q", "long"), "tape": ("z", "int")}),
}


def normalize(events: DataFrame, channel: str, text: str = "value") -> DataFrame:
    """Rows of one channel from JSON texts (each an event or a list of them): typed columns, ``timestamp`` (UTC), ``date`` (New York)."""
    _, time, columns = CHANNELS[channel]
    as_list = F.when(F.ltrim(text).startswith("["), F.col(text)).otherwise(F.concat(F.lit("["), F.col(text), F.lit("]")))
    items = events.select(*[c for c in events.columns if c != text], F.explode(F.from_json(as_list, "array<map<string,string>>")).alias("_j"))
    field = lambda name: F.element_at("_j", name)

    def typed(name: str, kind: str):
        if kind.startswith("array"):
            return F.from_json(field(name), kind)
        return field(name).try_cast(kind)

    own = items.where(field("ev") == channel)
    keep = [c for c in events.columns if c != text]
    ts = F.timestamp_millis(field(time).try_cast("long"))
    return own.select(*keep, ts.alias("timestamp"), eastern_date(ts).alias("date"), *[typed(f, k).alias(c) for c, (f, k) in columns.items()])


def capture(events: DataFrame, root: str, channel: str, every: str | None = "30 seconds", text: str = "value") -> StreamingQuery:
    """A running query that appends the channel's rows to ``<root>/<dataset>/date=...`` with ``received_at``."""
    dataset = CHANNELS[channel][0]
    rows = normalize(events, channel, text).withColumn("received_at", F.current_timestamp())
    writer = rows.writeStream.format("parquet").partitionBy("date").option("path", f"{root}/{dataset}").option("checkpointLocation", f"{root}/_checkpoints/{dataset}").outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def compact(spark: SparkSession, root: str, channel: str, target: str) -> DataFrame:
    """Small files of closed days rewritten by day, sorted by time: the compacted table (readers take it instead of the parts)."""
    rows = spark.read.parquet(f"{root}/{CHANNELS[channel][0]}")
    rows.repartition("date").sortWithinPartitions("date", "timestamp").write.mode("overwrite").partitionBy("date").parquet(target)
    return spark.read.parquet(target)


def live_between(rows: DataFrame, after: str | None, settle_seconds: int = 0, now: str | None = None) -> DataFrame:
    """Rows that arrived after a mark and up to ``settle_seconds`` ago, in order of arrival; the next mark is their latest arrival."""
    upto = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    out = rows.where(F.col("received_at") <= F.timestamp_micros(F.unix_micros(upto) - settle_seconds * 1_000_000))
    if after is not None:
        out = out.where(F.col("received_at") > F.lit(after).cast("timestamp"))
    return out.orderBy("received_at", "timestamp")


def follow(spark: SparkSession, root: str, channel: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """A running query that hands each batch of newly arrived rows to ``handle``, in order of arrival."""
    rows = spark.readStream.schema(schema).parquet(f"{root}/{CHANNELS[channel][0]}")
    writer = rows.writeStream.foreachBatch(lambda df, n: handle(df.orderBy("received_at", "timestamp"), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def official_first(live: DataFrame, official: DataFrame, date: str = "date") -> DataFrame:
    """Live rows of days without an official file."""
    return live.join(F.broadcast(official.select(date).distinct()), date, "left_anti")


def prune_live(live_days: DataFrame, official_days: DataFrame) -> DataFrame:
    """Days whose live partitions can go because the official ones are stored."""
    return live_days.select("date").distinct().join(official_days.select("date").distinct(), "date", "left_semi")


def windowed_bars(trades: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Bars of event-time windows (tumbling, or sliding with ``slide``) with a watermark for late rows."""
    return (
        trades.withWatermark(ts, late).groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), "ticker")
        .agg(F.min_by("price", ts).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", ts).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("trades"))
    )


def unique_trades(trades: DataFrame, late: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Trades once each by (ticker, id) within the watermark."""
    return trades.withWatermark(ts, late).dropDuplicatesWithinWatermark(["ticker", "id"])


def sessionized(trades: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Bursts of trading: windows of a ticker that end after a gap without trades."""
    return trades.withWatermark(ts, late).groupBy(F.session_window(ts, gap), "ticker").agg(F.count("*").alias("trades"), F.sum("size").alias("volume"))
