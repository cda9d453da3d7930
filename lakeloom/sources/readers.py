"""Readers: bar and tick CSV, REST JSON, company facts and submissions, index and short-sale text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import eastern_date, from_nanos, pad_cik
from . import schemas


def read_bars_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Day or minute bars (gzip or plain): epoch nanoseconds to UTC, the New York trading date, typed columns."""
    raw = spark.read.schema(schemas.BAR_CSV).option("header", "true").csv(path)
    ts = from_nanos(F.col("window_start"))
    return schemas.conform(raw.withColumn("timestamp", ts).withColumn("date", eastern_date(ts)), schemas.BARS)


def transform_ticks(raw: DataFrame) -> DataFrame:
    """Tick columns as stored: absent timestamps (0) null, code lists as small integers, the New York date of the tape's time."""
    out = raw
    for c in [c for c in raw.columns if c.endswith("timestamp")]:
        out = out.withColumn(c, F.nullif(F.col(c), F.lit(0).cast("long")))
    for c in [c for c in ("conditions", "indicators") if c in raw.columns]:
        out = out.withColumn(c, F.when(F.length(F.trim(c)) > 0, F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("smallint"))))
    return out.withColumn("date", eastern_date(from_nanos(F.col("sip_timestamp"))))


def read_trades_csv(spark: SparkSession, path: str | list[str], tickers: list[str] | None = None) -> DataFrame:
    raw = spark.read.schema(schemas.TRADE_CSV).option("header", "true").csv(path)
    return transform_ticks(raw.where(F.col("ticker").isin(tickers)) if tickers else raw)


def read_quotes_csv(spark: SparkSession, path: str | list[str], tickers: list[str] | None = None) -> DataFrame:
    raw = spark.read.schema(schemas.QUOTE_CSV).option("header", "true").csv(path)
    return transform_ticks(raw.where(F.col("ticker").isin(tickers)) if tickers else raw)


def to_frame(rows: DataFrame) -> DataFrame:
    """REST rows: nested values to JSON text (lists of plain strings stay lists), ``*_date`` to dates, ``*_utc`` to timestamps."""
    out = []
    for f in rows.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith(("struct", "map")) or (kind.startswith("array") and kind != "array<string>"):
            out.append(F.to_json(c).alias(f.name))
        elif f.name.endswith("_date") or f.name == "date":
            out.append(F.try_to_date(F.substring(c.cast("string"), 1, 10)).alias(f.name) if hasattr(F, "try_to_date") else F.substring(c.cast("string"), 1, 10).try_cast("date").alias(f.name))
        elif f.name.endswith("_utc"):
            out.append(F.try_to_timestamp(c.cast("string")).alias(f.name))
        else:
            out.append(c.alias(f.name))
    return rows.select(*out)


def read_rest_json(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    return to_frame(spark.read.option("multiLine", multi_line).json(path))


_UNIT = "array<struct<start:string,end:string,val:string,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>>"


def parse_company_facts(docs: DataFrame, text: str = "value") -> DataFrame:
    """Facts documents (one JSON text a row) to long numeric facts; values that are not numbers, or without end or filing day, go."""
    parsed = docs.select(F.from_json(text, f"cik string, facts map<string,map<string,struct<units:map<string,{_UNIT}>>>>").alias("d")).select("d.cik", "d.facts")
    tax = parsed.select("cik", F.explode("facts").alias("taxonomy", "_tags"))
    tags = tax.select("cik", "taxonomy", F.explode("_tags").alias("tag", "_c")).select("cik", "taxonomy", "tag", F.explode("_c.units").alias("unit", "_f"))
    rows = tags.select("cik", "taxonomy", "tag", "unit", F.explode("_f").alias("f")).select("cik", "taxonomy", "tag", "unit", "f.*")
    day = lambda c: F.col(c).try_cast("date")
    out = rows.withColumn("cik", pad_cik(F.col("cik"))).withColumn("val", F.when(~F.lower("val").isin("true", "false"), F.col("val").try_cast("double"))).withColumns({c: day(c) for c in ("start", "end", "filed")})
    return schemas.conform(out.where("val is not null and end is not null and filed is not null"), schemas.FACTS)


def parse_submissions(docs: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Submission documents to (profiles: cik, name, tickers, sic, first_periodic, last_periodic; names: cik, name, valid_from, valid_to)."""
    kind = "cik string, name string, sic string, tickers array<string>, formerNames array<struct<name:string,`from`:string,`to`:string>>, filings struct<recent:struct<form:array<string>,filingDate:array<string>>>"
    d = docs.select(F.from_json(text, kind).alias("d")).select("d.*").withColumn("cik", pad_cik(F.col("cik")))
    recent = F.arrays_zip(F.col("filings.recent.form").alias("form"), F.col("filings.recent.filingDate").alias("day"))
    periodic = F.transform(F.filter(recent, lambda x: x["form"].rlike("^(?:10-K|10-Q|20-F|40-F|6-K)")), lambda x: x["day"].try_cast("date"))
    profiles = d.select("cik", "name", "tickers", F.col("sic").try_cast("int").alias("sic"), F.array_min(periodic).alias("first_periodic"), F.array_max(periodic).alias("last_periodic"))
    former = d.select("cik", F.explode("formerNames").alias("n")).select("cik", F.col("n.name").alias("name"), F.substring("n.from", 1, 10).try_cast("date").alias("valid_from"), F.substring("n.to", 1, 10).try_cast("date").alias("valid_to"))
    last = former.groupBy("cik").agg(F.max("valid_to").alias("_l"))
    current = d.join(last, "cik", "left").select("cik", "name", F.date_add("_l", 1).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return profiles, former.unionByName(current)


def read_master_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Filing index text (cik|company|form|date|file): ``cik, name, form, filed, file``; other lines are left out."""
    parts = spark.read.text(path).select(F.split("value", "\\|").alias("p")).where(F.size("p") == 5)
    out = parts.select(pad_cik(F.trim(F.get("p", F.lit(0)))).alias("cik"), F.trim(F.get("p", F.lit(1))).alias("name"), F.trim(F.get("p", F.lit(2))).alias("form"), F.trim(F.get("p", F.lit(3))).try_cast("date").alias("filed"), F.trim(F.get("p", F.lit(4))).alias("file"))
    return out.where("filed is not null and cik rlike '^[0-9]+$'")


def parse_short_volume(lines: DataFrame, text: str = "value") -> DataFrame:
    """Daily short-sale text: with or without a header, with CRLF, in the old layout without the exempt column; trailers go."""
    p = lines.select(F.split(F.regexp_replace(text, "\\r$", ""), "\\|").alias("p")).where(F.size("p") >= 5)
    at = lambda i: F.trim(F.get("p", F.lit(i)))
    six = F.size("p") >= 6
    out = p.select(
        F.coalesce(F.try_to_timestamp(at(0), F.lit("yyyyMMdd")).cast("date"), at(0).try_cast("date")).alias("date"), at(1).alias("symbol"), at(2).try_cast("double").alias("short_volume"),
        F.when(six, at(3).try_cast("double")).alias("short_exempt_volume"), F.when(six, at(4)).otherwise(at(3)).try_cast("double").alias("total_volume"), F.when(six, at(5)).otherwise(at(4)).alias("market"),
    )
    return out.where("date is not null and short_volume is not null")


def read_short_volume(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_short_volume(spark.read.text(path))


def combine_facilities(rows: DataFrame, source: str = "daily files") -> DataFrame:
    """Facilities of a symbol and day summed, their markets listed once in order; a missing exempt volume stays missing in all."""
    markets = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("market", ","))))), ",")
    return rows.groupBy("date", "symbol").agg(F.sum("short_volume").alias("short_volume"), F.sum("short_exempt_volume").alias("short_exempt_volume"), F.sum("total_volume").alias("total_volume"), markets.alias("markets")).withColumn("source", F.lit(source))


def short_interest_frame(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Short-interest rows typed, with the publication date (seven sessions after settlement)."""
    from ..operators.calendar import publication_dates

    typed = schemas.conform(rows, schemas.SHORT_INTEREST).drop("published_date")
    dates = publication_dates(sessions, typed.select("settlement_date").distinct())
    return schemas.conform(typed.join(F.broadcast(dates), "settlement_date"), schemas.SHORT_INTEREST)
