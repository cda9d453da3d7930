"""Who a ticker was: episodes of trading, links between them, security ids, and mapping of dates and actions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof_join, validity_join
from .graph import connected_components

EPISODE_GAP, HANDOFF_DAYS = 30, 7
SMALL_JUMP, SPLIT_CHECK, CLOSE_DAYS, GRACE_DAYS = math.log(1.5), math.log(1.25), 10, 7


def episodes(days: DataFrame, key: str = "ticker", gap: int = EPISODE_GAP) -> DataFrame:
    """``ticker, ep, first, last, days``: runs of trading days; more than ``gap`` calendar days without trading start another."""
    w = W.partitionBy(key).orderBy("date")
    new = F.when(F.datediff("date", F.lag("date").over(w)) > gap, 1).otherwise(0)
    numbered = days.select(key, "date").distinct().withColumn("_new", new).withColumn("ep", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "ep").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"))


def split_ratios(splits: DataFrame, key: str = "ticker") -> DataFrame:
    """The price ratio that splits explain per key and day."""
    return splits.where("split_from > 0 and split_to > 0").groupBy(key, F.col("execution_date").alias("date")).agg(F.product(F.col("split_to") / F.col("split_from")).alias("ratio"))


def anchors(snapshots: DataFrame, eps: DataFrame, key: str = "ticker") -> DataFrame:
    """Reference records (ticker, as_of, ...) that fall inside an episode (episodes of a key do not overlap)."""
    windows = eps.select(key, "ep", F.col("first").alias("valid_from"), F.col("last").alias("valid_to"))
    return validity_join(snapshots, windows, "as_of", [key]).where("ep is not null").drop("valid_from", "valid_to")


def compress(records: DataFrame, ids: list[str], key: list[str], order: str = "as_of") -> DataFrame:
    """First and last day of each run of equal ids."""
    w = W.partitionBy(*key).orderBy(order)
    changed = F.lit(False)
    for c in ids:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    run = records.withColumn("_new", changed.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(*key, "run").agg(*[F.first(c).alias(c) for c in ids], F.min(order).alias("first"), F.max(order).alias("last"))


def same_identity(a: str, b: str) -> Column:
    """True, false or null by FIGI, then share-class FIGI, then CIK -- the first that both sides have."""
    out = F.lit(None).cast("boolean")
    for c in reversed(["figi", "share_class_figi", "cik"]):
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        out = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(out)
    return out


def segment_all(eps: DataFrame, records: DataFrame, prices: DataFrame, ratios: DataFrame, key: str = "ticker") -> DataFrame:
    """Episodes cut where the reference says that another security took the symbol: ``ticker, seg, first, last, figi, share_class_figi, cik, method``.

    Neighbouring runs of records with different identities are separated at the largest unexplained price jump between the last
    day of the one and the first day of the other; with unknown identity a jump of more than 1.5x separates them. A ticker's
    episodes, records and prices are a bounded group (a row a day).
    """
    import pandas as pd

    ids = ["figi", "share_class_figi", "cik"]
    runs = compress(anchors(records, eps, key), ids, [key, "ep"]).select(key, "ep", "first", "last", *ids)
    p = prices.select(key, "date", "close").join(ratios.select(key, "date", "ratio"), [key, "date"], "left")

    def cut(runs_: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
        out = []
        days = days.sort_values("date").reset_index(drop=True)
        jump = (days["close"].shift(1) / days["close"] / days["ratio"].fillna(1.0)).map(lambda x: abs(math.log(x)) if x == x and x > 0 else 0.0)
        gap = days["date"].map(lambda d: d.toordinal()).diff().fillna(0) > EPISODE_GAP
        days = days.assign(ep=gap.cumsum(), jump=jump)
        seg = 0
        for ep, d in days.groupby("ep"):
            known = runs_[runs_["ep"] == ep].sort_values("first").to_dict("records")
            parts: list[dict] = []
            for r in known:
                if parts:
                    last = parts[-1]
                    same = next((last[c] == r[c] for c in ids if last[c] and r[c]), None)
                    between = d[(d["date"] > last["last"]) & (d["date"] <= r["first"])]
                    worst = between.loc[between["jump"].idxmax()] if len(between) else None
                    if same is None:
                        same = worst is None or worst["jump"] <= SMALL_JUMP
                    if same:
                        last["last"] = r["last"]
                        last.update({c: r[c] or last[c] for c in ids})
                        continue
                    r = dict(r, start=worst["date"] if worst is not None else r["first"])
                parts.append(dict(r, start=r.get("start", d["date"].iloc[0])))
            if not parts:
                parts = [{"start": d["date"].iloc[0], **dict.fromkeys(ids)}]
            bounds = [x["start"] for x in parts] + [None]
            for i, x in enumerate(parts):
                own = d[(d["date"] >= (d["date"].iloc[0] if i == 0 else bounds[i])) & ((d["date"] < bounds[i + 1]) if bounds[i + 1] is not None else True)]
                if len(own):
                    out.append((own["ticker"].iloc[0], seg, own["date"].iloc[0], own["date"].iloc[-1], *(x[c] for c in ids), "reference" if known else "price"))
                    seg += 1
        return pd.DataFrame(out, columns=["ticker", "seg", "first", "last", *ids, "method"])

    left = runs.withColumnRenamed(key, "ticker")
    right = p.withColumnRenamed(key, "ticker")
    return left.groupBy("ticker").cogroup(right.groupBy("ticker")).applyInPandas(cut, "ticker string, seg int, first date, last date, figi string, share_class_figi string, cik string, method string")


def link_candidates(segments: DataFrame, closes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Pairs of segments of one security: equal FIGI (or share-class FIGI), one symbol across a gap with no contradiction, a unique
    hand-off between symbols of one CIK within a week at nearly the same price, and overrides."""
    s = segments.withColumn("node", F.xxhash64("ticker", "seg"))
    out = []
    for c in ("figi", "share_class_figi"):
        w = W.partitionBy(c).orderBy("first", "node")
        out.append(s.where(f"{c} is not null").withColumn("dst", F.lag("node").over(w)).where("dst is not null").select(F.col("node").alias("src"), "dst", F.lit(c).alias("reason")))
    w = W.partitionBy("ticker").orderBy("first")
    prev = s.withColumn("_p", F.lag(F.struct("node", "figi", "share_class_figi", "cik")).over(w)).where("_p is not null").select("*", F.struct("figi", "share_class_figi", "cik").alias("_q"))
    out.append(prev.where(F.coalesce(same_identity("_p", "_q"), F.lit(False))).select(F.col("node").alias("src"), F.col("_p.node").alias("dst"), F.lit("gap").alias("reason")))
    ends = s.join(closes.select("ticker", F.col("date").alias("last"), F.col("close").alias("last_close")), ["ticker", "last"], "left").join(closes.select("ticker", F.col("date").alias("first"), F.col("close").alias("first_close")), ["ticker", "first"], "left")
    a, b = ends.alias("a"), ends.alias("b")
    pairs = a.join(b, (F.col("a.cik") == F.col("b.cik")) & (F.col("a.node") != F.col("b.node"))).where(F.datediff("b.first", "a.last").between(1, HANDOFF_DAYS) & (F.abs(F.ln(F.col("a.last_close") / F.col("b.first_close"))) <= SMALL_JUMP))
    pairs = pairs.select(F.col("a.node").alias("dst"), F.col("b.node").alias("src"))
    one = pairs.withColumn("_x", F.count(F.lit(1)).over(W.partitionBy("dst"))).withColumn("_y", F.count(F.lit(1)).over(W.partitionBy("src"))).where("_x = 1 and _y = 1")
    out.append(one.select("src", "dst", F.lit("handoff").alias("reason")))
    if overrides is not None:
        out.append(overrides.select("src", "dst", F.lit("override").alias("reason")))
    edges = out[0]
    for e in out[1:]:
        edges = edges.unionByName(e)
    return edges


LINK_ORDER = ["override", "figi", "share_class_figi", "gap", "handoff"]


def _without_blocked(edges: DataFrame, blocked: DataFrame, components: DataFrame) -> DataFrame:
    """``node, component``, with the components that hold a blocked pair put together anew, link by link."""
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    both = blocked.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select(F.col("_src").alias("component"), "src", "dst", F.lit(-1).alias("place")).distinct()
    held = both.select("component").distinct()
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LINK_ORDER]), F.col("reason")), F.lit(99)).cast("int") if "reason" in edges.columns else F.lit(0)
    links = edges.withColumn("place", place).join(of("src"), "src").select(F.col("_src").alias("component"), "src", "dst", "place").join(held, "component")

    def put_together(rows: pd.DataFrame) -> pd.DataFrame:
        root = {n: n for n in {*rows.src, *rows.dst}}
        apart = {n: {n} for n in root}
        never = {(a, b) for a, b, p in zip(rows.src, rows.dst, rows.place, strict=True) if p < 0}
        for _, a, b in sorted((p, min(a, b), max(a, b)) for a, b, p in zip(rows.src, rows.dst, rows.place, strict=True) if p >= 0):
            a, b = sorted((root[a], root[b]))
            if a != b and not any((x, y) in never or (y, x) in never for x in apart[a] for y in apart[b]):
                for n in apart[b]:
                    root[n] = a
                apart[a] |= apart.pop(b)
        return pd.DataFrame({"node": list(root), "component": list(root.values())})

    again = links.unionByName(both).groupBy("component").applyInPandas(put_together, "node long, component long")
    return components.join(held, "component", "left_anti").select("node", "component").unionByName(again)


def assign_ids(segments: DataFrame, edges: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Segments with ``security_id``: the newest FIGI of their component, else share-class FIGI, ``CIK:``, ``SYM:``; collisions get a number.

    ``blocked`` (src, dst) pairs are never of one security: links are taken in the order override, FIGI, share-class FIGI, gap, hand-off,
    and one that would join two groups with a blocked pair across them is refused. Only components that hold a blocked pair are gone
    through that way, each by itself (a component is one security's symbols).
    """
    s = segments.withColumn("node", F.xxhash64("ticker", "seg"))
    if blocked is not None:
        sym = blocked.select("src", "dst").unionByName(blocked.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        edges = edges.join(sym, ["src", "dst"], "left_anti")
    comp = connected_components(edges.select("src", "dst"))
    if blocked is not None:
        comp = _without_blocked(edges, sym, comp)
    s = s.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("last")))
    base = s.groupBy("component").agg(newest("figi").alias("f"), newest("share_class_figi").alias("sc"), newest("cik").alias("k"), F.max_by("ticker", "last").alias("t"), F.min("first").alias("_first"))
    base = base.withColumn("base", F.coalesce("f", "sc", F.concat(F.lit("CIK:"), "k"), F.concat(F.lit("SYM:"), "t")))
    n = F.row_number().over(W.partitionBy("base").orderBy("_first", "component"))
    named = base.withColumn("_n", n).select("component", F.when(F.col("_n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("#"), F.col("_n"))).alias("security_id"))
    return s.join(named, "component").drop("node", "component")


def master_table(assigned: DataFrame, data_end: Column | None = None) -> DataFrame:
    """``security_id, ticker, valid_from, valid_to``; windows that reach the end of the data are open."""
    end = F.when(F.col("last") < data_end, F.col("last")) if data_end is not None else F.col("last")
    return assigned.select("security_id", "ticker", F.col("first").alias("valid_from"), end.alias("valid_to"))


def securities_table(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("security_id").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"), F.max_by("ticker", "last").alias("last_ticker"), F.min("first").alias("first_trade"), F.max("last").alias("last_trade"), F.max_by("cik", "last").alias("cik"))


def map_to_security(rows: DataFrame, master: DataFrame, date: str = "date", key: str = "ticker", grace: int = 0) -> DataFrame:
    """Rows with the ``security_id`` that held the symbol on the date; null outside its windows."""
    return validity_join(rows, master.select(key, "valid_from", "valid_to", "security_id"), date, [key], grace=grace).drop("valid_from", "valid_to")


def map_actions(actions: DataFrame, securities: DataFrame, master: DataFrame, date: str = "execution_date") -> DataFrame:
    """Corporate actions with ``security_id`` and ``mapping``: by current symbol, else by the holder on the date.

    ``securities(security_id, last_ticker, active)``. One current candidate is it; of several the only active one; else the holder
    if it is among them; without any the holder; else ambiguous or unmapped.
    """
    rows = actions.withColumn("_row", F.xxhash64(*actions.columns))
    holder = map_to_security(rows, master, date, "ticker", GRACE_DAYS).withColumnRenamed("security_id", "_holder")
    found = securities.groupBy(F.col("last_ticker").alias("ticker")).agg(F.collect_list("security_id").alias("_all"), F.collect_list(F.when(F.col("active"), F.col("security_id"))).alias("_active"))
    j = holder.join(found, "ticker", "left")
    n = F.coalesce(F.size("_all"), F.lit(0))
    n = F.when(F.col("_all").isNull(), 0).otherwise(n)
    among = F.coalesce(F.array_contains("_all", F.col("_holder")), F.lit(False))
    one_active = F.col("_all").isNotNull() & (F.size("_active") == 1)
    sid = F.when(n == 1, F.get("_all", F.lit(0))).when((n > 1) & one_active, F.get("_active", F.lit(0))).when((n > 1) & among, F.col("_holder")).when(n == 0, F.col("_holder"))
    how = F.when(n == 1, "current").when((n > 1) & one_active, "active").when((n > 1) & among, "holder").when((n == 0) & F.col("_holder").isNotNull(), "holder").when(n == 0, "unmapped").otherwise("ambiguous")
    return j.withColumn("security_id", sid).withColumn("mapping", how).drop("_row", "_all", "_active", "_holder")


def fix_stock_dividends(splits: DataFrame) -> DataFrame:
    """Stock dividends filed as from 1 to a fraction (or a percentage) mean from 1 to 1 + it."""
    f, t = F.col("split_from"), F.col("split_to")
    share = F.when((f == 1) & (t < 1), t).when((f == 100) & (t < 100), t / 100)
    odd = F.col("adjustment_type") == "stock_dividend" if "adjustment_type" in splits.columns else F.lit(False)
    return splits.withColumn("split_to", F.when(odd & share.isNotNull(), f * (1 + share)).otherwise(t))


def closes_around(events: DataFrame, closes: DataFrame, key: str = "security_id", date: str = "execution_date") -> DataFrame:
    """Events with the last close before (c0) and the first on or after (c1), each within ten days."""
    rows = events.withColumn("_before", F.date_sub(date, 1))
    c0 = closes.select(key, F.col("date").alias("_d0"), F.col("close").alias("c0"))
    c1 = closes.select(key, F.col("date").alias("_d1"), F.col("close").alias("c1"))
    return asof_join(asof_join(rows, c0, "_before", "_d0", [key], tolerance=CLOSE_DAYS), c1, date, "_d1", [key], strategy="forward", tolerance=CLOSE_DAYS).drop("_before")


def confirmed_splits(splits: DataFrame, closes: DataFrame, key: str = "security_id") -> DataFrame:
    """Splits without those that the price contradicts: the move seen is nearer to none than to the split's."""
    j = closes_around(splits, closes, key)
    k, seen = F.ln(F.col("split_to") / F.col("split_from")), F.ln(F.col("c0") / F.col("c1"))
    check = (F.abs(k) > SPLIT_CHECK) & seen.isNotNull() & ~F.coalesce(F.col("override"), F.lit(False)) if "override" in splits.columns else (F.abs(k) > SPLIT_CHECK) & seen.isNotNull()
    return j.where(~check | (F.abs(seen - k) < F.abs(seen))).select(*splits.columns)


def mapped_splits(mapped: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One split per security and day; overrides win, then symbols of the security itself in order."""
    rows = mapped.where("security_id is not null").withColumn("_o", F.lit(1))
    if overrides is not None:
        rows = rows.unionByName(overrides.withColumn("_o", F.lit(0)), allowMissingColumns=True)
    n = F.row_number().over(W.partitionBy("security_id", "execution_date").orderBy("_o", "ticker", "split_to"))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n", "_o")


def mapped_dividends(mapped: DataFrame, closes: DataFrame) -> DataFrame:
    """Dividends with their step ``factor``: 1 - cash / previous close (US dollars, cash below the close), else the vendor's in (0, 1], else 1."""
    rows = mapped.where("security_id is not null").dropDuplicates(["security_id", "ex_dividend_date", "cash_amount"]).withColumn("_d", F.date_sub("ex_dividend_date", 1))
    prev = closes.select("security_id", F.col("date").alias("_cd"), F.col("close").alias("prev_close"))
    j = asof_join(rows, prev, "_d", "_cd", ["security_id"]).drop("_d")
    dollars = F.coalesce(F.col("currency"), F.lit("USD")) == "USD" if "currency" in mapped.columns else F.lit(True)
    own = F.when(dollars & (F.col("cash_amount") > 0) & (F.col("cash_amount") < F.col("prev_close")), 1 - F.col("cash_amount") / F.col("prev_close"))
    vendor = F.when((F.col("vendor_factor") > 0) & (F.col("vendor_factor") <= 1), F.col("vendor_factor")) if "vendor_factor" in mapped.columns else F.lit(None)
    return j.withColumn("factor", F.coalesce(own, vendor, F.lit(1.0)))


def overlaps(master: DataFrame) -> DataFrame:
    """Windows of one symbol that overlap (a check: there should be none)."""
    w = W.partitionBy("ticker").orderBy("valid_from", "security_id")
    before = F.max(F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    return master.withColumn("_b", before).where(F.col("valid_from") <= F.col("_b")).drop("_b")
