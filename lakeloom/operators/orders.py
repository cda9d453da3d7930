"""Order sheets: targets and holdings to whole-share orders, fingerprints, reconciliation, journals, contract matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .names import MATCH, similarity, tokens

#: The order in which statuses are decided (fixed values).
STATUSES = ["no_price", "no_trade", "contract", "small", "order_size", "participation", "not_shortable", "send"]


def make_orders(targets: DataFrame, held: DataFrame, contracts: DataFrame, market: DataFrame, nav: float, min_trade: float = 100.0, max_order: float | None = None, participation: float | None = None, shortable: DataFrame | None = None) -> DataFrame:
    """``security_id, ticker, con_id, target_shares, held_shares, shares, price, dollars, status``.

    Target shares are weight x NAV / price towards zero; securities held without a target are closed. The first status that applies
    counts: no price, no trade, contract trouble, small (not when closing a position), over the order size, over the share of daily
    volume, not shortable, else send.
    """
    t = targets.groupBy("security_id").agg(F.sum("weight").alias("weight"))
    h = held.groupBy("security_id").agg(F.sum("shares").alias("held_shares"), F.first("con_id").alias("_con"))
    j = t.join(h, "security_id", "full").join(contracts, "security_id", "left").join(market, "security_id", "left")
    if shortable is not None:
        j = j.join(shortable.select("security_id", F.lit(True).alias("_short")), "security_id", "left")
    else:
        j = j.withColumn("_short", F.lit(True))
    raw = F.coalesce("weight", F.lit(0.0)) * nav / F.col("price")
    j = j.withColumn("target_shares", F.when(F.col("price") > 0, (F.signum(raw) * F.floor(F.abs(raw) + 1e-9)).cast("long"))).withColumn("held_shares", F.coalesce(F.col("held_shares").cast("long"), F.lit(0).cast("long")))
    j = j.withColumn("shares", F.col("target_shares") - F.col("held_shares")).withColumn("dollars", F.col("shares") * F.col("price"))
    closing = (F.col("target_shares") == 0) & (F.col("held_shares") != 0)
    size = F.abs("dollars")
    no = F.lit(False)
    status = (
        F.when(~F.coalesce(F.col("price") > 0, no), "no_price").when(F.col("shares") == 0, "no_trade").when(F.coalesce(F.col("status"), F.lit("missing")) != "ok", "contract")
        .when(~closing & (size < min_trade), "small").when(size > max_order if max_order is not None else no, "order_size")
        .when(F.coalesce(size > participation * F.col("adv"), F.lit(True)) if participation is not None else no, "participation")
        .when((F.col("target_shares") < 0) & (F.col("shares") < 0) & ~F.coalesce(F.col("_short"), no), "not_shortable").otherwise("send")
    )
    return j.select("security_id", "ticker", F.coalesce("con_id", "_con").alias("con_id"), "target_shares", "held_shares", "shares", "price", "dollars", status.alias("order_status"))


def positions_hash(held: DataFrame) -> DataFrame:
    """One row: the SHA-256 of the account's positions in order (an account has at most some thousand)."""
    line = F.concat_ws(":", F.col("con_id").cast("string"), F.col("shares").cast("long").cast("string"))
    return held.where("shares <> 0").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("fingerprint"))


def classify(held: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(managed, unmanaged) positions: those whose contract is known, and the rest."""
    known = contracts.where("con_id is not null").select("con_id")
    return held.join(known, "con_id", "left_semi"), held.join(known, "con_id", "left_anti")


def reconcile(sheet: DataFrame, fills: DataFrame, positions: DataFrame) -> DataFrame:
    """Sheet x fills x positions: filled shares, average price, slippage (bp, a cost is positive), and what differs."""
    f = fills.groupBy("con_id").agg(F.sum("shares").alias("filled"), (F.sum(F.col("shares") * F.col("price")) / F.nullif(F.sum("shares"), F.lit(0))).alias("fill_price"))
    j = sheet.join(f, "con_id", "left").join(positions.select("con_id", F.col("shares").alias("position")), "con_id", "left").fillna({"filled": 0, "position": 0})
    slip = F.when(F.col("filled") != 0, F.signum("filled") * (F.col("fill_price") / F.col("price") - 1) * 1e4)
    expected = F.col("held_shares") + F.col("filled")
    return j.withColumn("slippage_bps", slip).withColumn("unfilled", F.when(F.col("order_status") == "send", F.col("shares") - F.col("filled")).otherwise(0)).withColumn("difference", F.col("position") - expected)


def record_fills(journal: DataFrame, fills: DataFrame) -> DataFrame:
    """The journal with fills that it does not have yet; recording twice changes nothing."""
    new = fills.dropDuplicates(["exec_id"]).join(journal.select("exec_id"), "exec_id", "left_anti")
    return journal.unionByName(new, allowMissingColumns=True)


def names_match(a: Column, b: Column, least: float = MATCH) -> Column:
    return F.coalesce(similarity(tokens(a), tokens(b)) >= least, F.lit(False))


def resolve_contracts(securities: DataFrame, book: DataFrame) -> DataFrame:
    """Broker contracts of securities: by FIGI, else by symbol with a matching name; ``status`` ok, ambiguous or missing."""
    by_figi = securities.join(book.select("figi", F.col("con_id").alias("_c")), "figi").select("security_id", "_c", F.lit(0).alias("_o"))
    sym = securities.join(book.select(F.col("symbol").alias("ticker"), F.col("name").alias("_n"), F.col("con_id").alias("_c")), "ticker").where(names_match(F.col("name"), F.col("_n"))).select("security_id", "_c", F.lit(1).alias("_o"))
    found = by_figi.unionByName(sym).withColumn("_best", F.min("_o").over(W.partitionBy("security_id"))).where("_o = _best")
    one = found.groupBy("security_id").agg(F.countDistinct("_c").alias("_k"), F.min("_c").alias("con_id"))
    out = securities.join(one, "security_id", "left")
    status = F.when(F.col("_k") == 1, "ok").when(F.col("_k") > 1, "ambiguous").otherwise("missing")
    return out.withColumn("status", status).withColumn("con_id", F.when(status == "ok", F.col("con_id"))).drop("_k")
