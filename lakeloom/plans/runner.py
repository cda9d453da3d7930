"""Orchestration: a small DAG of build steps with time limits, retries and catch-up, and a freshness report."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Busy(Exception):
    """A step's store is in use; it is tried again."""


@dataclass
class Step:
    name: str
    run: Callable[[], None]
    needs: tuple[str, ...] = ()
    limit_seconds: float = 3600.0
    weekdays: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 6)


@dataclass
class Report:
    name: str
    status: str  # done, failed, late, skipped, busy
    seconds: float = 0.0
    detail: str = ""


def order(steps: list[Step]) -> list[Step]:
    """Steps after what they need, otherwise as listed; unknown needs and cycles raise."""
    by, out, state = {s.name: s for s in steps}, [], {}

    def visit(s: Step) -> None:
        if state.get(s.name) == "done":
            return
        if state.get(s.name) == "open":
            raise ValueError(f"{s.name} needs itself")
        state[s.name] = "open"
        for n in s.needs:
            if n not in by:
                raise ValueError(f"{s.name} needs unknown step {n}")
            visit(by[n])
        state[s.name] = "done"
        out.append(s)

    for s in steps:
        visit(s)
    return out


def nightly(steps: list[Step], day: dt.date | None = None, retries: int = 3, wait_seconds: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> list[Report]:
    """Run all due steps in order; what needs a failed step is skipped, a busy one is retried, one over its limit is reported late."""
    done: dict[str, Report] = {}
    for s in order(steps):
        if day is not None and day.weekday() not in s.weekdays:
            done[s.name] = Report(s.name, "done", detail="not due")
            continue
        bad = [n for n in s.needs if done[n].status not in ("done", "late")]
        if bad:
            done[s.name] = Report(s.name, "skipped", detail=f"needs {', '.join(bad)}")
            continue
        began = time.monotonic()
        for attempt in range(retries + 1):
            try:
                s.run()
                took = time.monotonic() - began
                done[s.name] = Report(s.name, "late" if took > s.limit_seconds else "done", took)
                break
            except Busy as e:
                done[s.name] = Report(s.name, "busy", time.monotonic() - began, str(e))
                if attempt < retries:
                    sleep(wait_seconds)
            except Exception as e:  # a step's failure must not end the night
                done[s.name] = Report(s.name, "failed", time.monotonic() - began, f"{type(e).__name__}: {e}")
                break
    return list(done.values())


def missed(last_run: dt.date | None, today: dt.date, sessions: list[dt.date]) -> list[dt.date]:
    """Sessions since the last run that are over: what a catch-up has to do."""
    return [d for d in sessions if d < today and (last_run is None or d > last_run)]


def freshness(spark: SparkSession, stores: dict[str, tuple[DataFrame, str, int]], expected: dt.date) -> DataFrame:
    """``store, last, expected, behind_days, fresh`` for stores given as (rows, date column, days allowed behind)."""
    out = None
    for name, (rows, column, allowed) in stores.items():
        r = rows.agg(F.max(column).cast("date").alias("last")).select(F.lit(name).alias("store"), "last", F.lit(expected).alias("expected"))
        r = r.withColumn("behind_days", F.datediff("expected", "last")).withColumn("fresh", F.coalesce(F.col("behind_days") <= allowed, F.lit(False)))
        out = r if out is None else out.unionByName(r)
    return out if out is not None else spark.createDataFrame([], "store string, last date, expected date, behind_days int, fresh boolean")
