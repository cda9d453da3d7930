"""Partitioned tables with keyed upserts, a manifest, and the read interface of the market store.

Writes go to a new version folder of a partition and are published by the manifest row of that version, so readers never see
half a write and a failed job leaves the old version in place.
"""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import adjust, calendar, identity
from . import schemas


def newest_by_keys(rows: DataFrame, keys: list[str], version: str = "_version") -> DataFrame:
    """One row per key (nulls are a value), the one of the highest version; without keys every row."""
    if not keys:
        return rows
    order = [F.desc(version), *[F.col(c).desc() for c in sorted(rows.columns) if c != version and c not in keys and not dict(rows.dtypes)[c].startswith(("map", "struct"))]]
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows by name, the new ones winning on equal keys."""
    if old is None:
        return newest_by_keys(new.withColumn("_version", F.lit(1)), keys).drop("_version")
    both = old.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)), allowMissingColumns=True)
    return newest_by_keys(both, keys).drop("_version")


def guard_snapshot(old: DataFrame, new: DataFrame, keys: list[str], date: str | None = None, shrink: float = 0.02) -> DataFrame:
    """A new snapshot that lost rows is completed from the old one.

    Old rows before the answer's first date stay. If more than ``shrink`` of the old rows would go, old rows whose keys are
    missing stay too; without keys such a snapshot is refused.
    """
    out = new
    rest = old
    if date:
        first = new.agg(F.min(date)).first()[0]
        if first is not None:
            out = new.unionByName(old.where(F.col(date) < first), allowMissingColumns=True)
            rest = old.where(F.coalesce(F.col(date) >= first, F.lit(True)))
    had, have = rest.count(), new.count()
    if have < had * (1 - shrink):
        if not keys:
            raise ValueError(f"the new snapshot has {have} rows, the old one {had}, and there are no keys to complete it by")
        cond = None
        n = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
        for k in keys:
            c = rest[k].eqNullSafe(n[f"_{k}"])
            cond = c if cond is None else cond & c
        out = out.unionByName(rest.join(n, cond, "left_anti"), allowMissingColumns=True)
    return out


@dataclass
class Tables:
    """Datasets under a root: ``<root>/<dataset>/v=<version>`` folders partitioned by a column, and a manifest of partitions."""

    spark: SparkSession
    root: str

    def _manifest_path(self) -> str:
        return f"{self.root}/_manifest"

    def manifest(self) -> DataFrame:
        """The current version of each partition: ``dataset, partition, rows, bytes, version``."""
        try:
            rows = self.spark.read.schema(schemas.MANIFEST).parquet(self._manifest_path())
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schemas.MANIFEST)
        return rows.withColumn("_n", F.row_number().over(W.partitionBy("dataset", "partition").orderBy(F.desc("version")))).where("_n = 1").drop("_n")

    def replace(self, dataset: str, rows: DataFrame, partition: str) -> None:
        """Write all partitions that the rows touch; other partitions keep their versions."""
        version = time.time_ns()
        path = f"{self.root}/{dataset}/v={version}"
        rows.withColumn("_part", F.col(partition).cast("string")).repartition("_part").write.partitionBy("_part").parquet(path)
        counts = self.spark.read.parquet(path).groupBy(F.col("_part").cast("string").alias("partition")).agg(F.count("*").alias("rows"))
        made = counts.select(F.lit(dataset).alias("dataset"), "partition", "rows", F.lit(None).cast("long").alias("bytes"), F.lit(version).cast("long").alias("version"))
        made.coalesce(1).write.mode("append").parquet(self._manifest_path())

    def read(self, dataset: str, partitions: Column | None = None) -> DataFrame | None:
        """All current partitions (those that meet the condition on ``partition``); None if there are none."""
        m = self.manifest().where(F.col("dataset") == dataset)
        if partitions is not None:
            m = m.where(partitions)
        by_version: dict[int, list[str]] = {}
        for r in m.collect():  # one row per partition
            by_version.setdefault(r["version"], []).append(r["partition"])
        out = None
        for version, parts in sorted(by_version.items()):
            # every column of every file of a version: days written together may differ in their columns
            df = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{dataset}/v={version}")
            df = df.where(F.col("_part").cast("string").isin(parts)).drop("_part")
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def upsert(self, dataset: str, rows: DataFrame, partition: str, keys: list[str]) -> None:
        """Keyed upsert of the partitions that the rows touch."""
        touched = [r[0] for r in rows.select(F.col(partition).cast("string")).distinct().collect()]
        old = self.read(dataset, F.col("partition").isin(touched))
        self.replace(dataset, upsert(old, rows, keys), partition)

    def todo(self, dataset: str, wanted: DataFrame) -> DataFrame:
        """Wanted partitions (column ``partition``) that are not stored."""
        return wanted.join(self.manifest().where(F.col("dataset") == dataset), "partition", "left_anti")

    def verify(self, dataset: str, expected: DataFrame) -> DataFrame:
        """``partition, problem``: missing, or broken where the stored rows are not those of the manifest or of the source."""
        m = self.manifest().where(F.col("dataset") == dataset).select("partition", F.col("rows").alias("listed"))
        j = expected.select("partition", F.col("rows").alias("expected")).join(m, "partition", "left")
        return j.select("partition", F.when(F.col("listed").isNull(), "missing").when(F.col("listed") != F.col("expected"), "broken").alias("problem")).where("problem is not null")

    def summary(self) -> DataFrame:
        """Partitions, first, last and rows per dataset."""
        return self.manifest().groupBy("dataset").agg(F.count("*").alias("partitions"), F.min("partition").alias("first"), F.max("partition").alias("last"), F.sum("rows").alias("rows"))


class MarketStore:
    """Reads of the market store, from tables given as DataFrames (stored, live or synthetic)."""

    def __init__(self, tables: dict[str, DataFrame], sessions: DataFrame | None = None):
        self.t, self.sessions = tables, sessions

    def resolve(self, tickers: DataFrame, date: str = "date") -> DataFrame:
        """Ticker and date to security id; null where the symbol did not trade."""
        return identity.map_to_security(tickers, self.t["master"], date)

    def resolve_ids(self, names: list[str], on: dt.date) -> DataFrame:
        """``name, security_id``: ids as they are, symbols to their last holder on or before the day, else their first."""
        m = self.t["master"]
        past = m.where(F.col("valid_from") <= F.lit(on))
        held = past.groupBy("ticker").agg(F.max_by("security_id", "valid_from").alias("a"))
        first = m.groupBy("ticker").agg(F.min_by("security_id", "valid_from").alias("b"))
        found = first.join(held, "ticker", "left").where(F.col("ticker").isin(names)).select(F.col("ticker").alias("name"), F.coalesce("a", "b").alias("security_id"))
        direct = m.where(F.col("security_id").isin(names)).select(F.col("security_id").alias("name"), "security_id").distinct()
        return direct.unionByName(found.join(direct, "name", "left_anti"))

    def bars(self, tickers: list[str] | None = None, start: dt.date | None = None, end: dt.date | None = None, freq: str = "1d", adjust_for: str | None = None, session: str = "all", by: str = "ticker", include_live: bool = False, columns: list[str] | None = None) -> DataFrame:
        """Daily or minute bars: filters reach the scan, then live days that have no official ones, session, adjustment, columns."""
        name = {"1d": "bars_day", "1min": "bars_minute"}[freq]
        rows = self.t[name]
        if include_live and f"live_{name}" in self.t:
            live = self.t[f"live_{name}"]
            rows = rows.unionByName(live.join(F.broadcast(rows.select("date").distinct()), "date", "left_anti"), allowMissingColumns=True)
        if start is not None:
            rows = rows.where(F.col("date") >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col("date") <= F.lit(end))
        key = "ticker"
        if by == "security":
            key = "security_id"
            if tickers:
                ids = [r["security_id"] for r in self.resolve_ids(tickers, end or dt.date.today()).collect()]
                symbols = [r["ticker"] for r in self.t["master"].where(F.col("security_id").isin(ids)).select("ticker").distinct().collect()]
                rows = identity.map_to_security(rows.where(F.col("ticker").isin(symbols)), self.t["master"]).where(F.col("security_id").isin(ids))
            else:
                rows = identity.map_to_security(rows, self.t["master"]).where("security_id is not null")
        elif tickers:
            rows = rows.where(F.col("ticker").isin(tickers))
        if session != "all" and freq == "1min":
            rows = calendar.filter_session(rows, self.sessions, session)
        if adjust_for:
            sp = adjust.split_factor_table(self.t["splits"], key)
            dv = adjust.dividend_factor_table(self.t["dividends"], key) if adjust_for == "all" else None
            rows = adjust.adjust_bars(rows, sp, dv, key)
        return rows.select(*columns) if columns else rows

    def dataset(self, name: str, tickers: list[str] | None = None, start: dt.date | None = None, end: dt.date | None = None, date: str = "date") -> DataFrame:
        """Any dataset by symbol (also in list columns) and date."""
        rows = self.t[name]
        if tickers:
            kinds = dict(rows.dtypes)
            if "ticker" in kinds:
                rows = rows.where(F.col("ticker").isin(tickers))
            elif kinds.get("tickers") == "array<string>":
                rows = rows.where(F.exists("tickers", lambda x: x.isin(tickers)))
        if start is not None:
            rows = rows.where(F.col(date) >= F.lit(start))
        return rows.where(F.col(date) <= F.lit(end)) if end is not None else rows

    def universe(self, day: dt.date) -> DataFrame:
        """Symbols traded on a day with reference attributes (an active record before an inactive one)."""
        traded = self.t["bars_day"].where(F.col("date") == F.lit(day)).select("ticker").distinct()
        ref = self.t["tickers"].withColumn("_n", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("active"), "name"))).where("_n = 1").drop("_n")
        return traded.join(ref, "ticker", "left")

    def universe_pit(self, day: dt.date, attributes: list[str]) -> DataFrame:
        """Symbols traded on a day with the attributes of the last snapshot up to it, else of the first one after it."""
        traded = self.t["bars_day"].where(F.col("date") == F.lit(day)).select("ticker").distinct()
        s = self.t["attributes"]
        value = F.struct(*attributes)
        up, after = F.when(F.col("as_of") <= F.lit(day), F.col("as_of")), F.when(F.col("as_of") > F.lit(day), F.col("as_of"))
        best = s.groupBy("ticker").agg(F.coalesce(F.max_by(value, up), F.min_by(value, after)).alias("_v"))
        return traded.join(best, "ticker", "left").select("ticker", "_v.*")

    def securities(self, active: bool | None = None, tickers: list[str] | None = None) -> DataFrame:
        rows = self.t["securities"]
        if active is not None:
            rows = rows.where(F.col("active") == active)
        return rows.where(F.exists("tickers", lambda x: x.isin(tickers))) if tickers else rows

    def facts(self, ciks: list[str] | None = None, tags: list[str] | None = None, start: dt.date | None = None, end: dt.date | None = None, filed_before: dt.date | None = None) -> DataFrame:
        """Facts of companies (read from their buckets only where the table has a ``bucket`` column), tags, periods and filing days."""
        rows = self.t["facts"]
        if ciks:
            padded = [c.zfill(10) for c in ciks]
            if "bucket" in rows.columns:
                rows = rows.where(F.col("bucket").isin(sorted({int(c) % 64 for c in padded})))
            rows = rows.where(F.col("cik").isin(padded))
        if tags:
            rows = rows.where(F.col("tag").isin(tags))
        if start is not None:
            rows = rows.where(F.col("end") >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col("end") <= F.lit(end))
        return rows.where(F.col("filed") < F.lit(filed_before)) if filed_before is not None else rows


def write_facts(facts: DataFrame, path: str, buckets: int = 64) -> None:
    """Facts without repeats in hash buckets by company, sorted so that a company's tags are read together."""
    rows = facts.dropDuplicates().withColumn("bucket", F.pmod(F.col("cik").cast("long"), F.lit(buckets)).cast("int"))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "cik", "tag", "end", "filed").write.mode("overwrite").partitionBy("bucket").parquet(path)


def replace_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts with those of re-fetched companies replaced."""
    return old.join(F.broadcast(new.select("cik").distinct()), "cik", "left_anti").unionByName(new, allowMissingColumns=True)


def replace_days(old: DataFrame, new: DataFrame, date: str = "date") -> DataFrame:
    return old.join(F.broadcast(new.select(date).distinct()), date, "left_anti").unionByName(new, allowMissingColumns=True)
