import datetime as dt

from pyspark.sql import functions as F

from lakeloom.operators import fundamentals as fu
from lakeloom.operators import identity, names
from lakeloom.operators import marketcap as mc

D = dt.date
FACTS = "cik string, tag string, unit string, start date, end date, val double, accn string, filed date"


def facts(spark, data):
    return spark.createDataFrame([("0000000001", tag, "USD", s, e, v, f"a{i}", f) for i, (tag, s, e, v, f) in enumerate(data)], FACTS)


def test_first_filed_and_restated(spark):
    df = facts(spark, [("R", D(2023, 1, 1), D(2023, 3, 31), 100.0, D(2023, 5, 1)), ("R", D(2023, 1, 1), D(2023, 3, 31), 105.0, D(2024, 5, 1))])
    assert [r.val for r in fu.choose(df).collect()] == [100.0] and [r.val for r in fu.choose(df, "latest").collect()] == [105.0]


def test_quarters_from_cumulative_and_annual(spark):
    y = lambda m, d: D(2023, m, d)
    df = facts(spark, [("R", y(1, 1), y(3, 31), 100.0, y(5, 1)), ("R", y(4, 1), y(6, 30), 110.0, y(8, 1)), ("R", y(1, 1), y(6, 30), 210.0, y(8, 1)), ("R", y(1, 1), y(9, 30), 330.0, y(11, 1)), ("R", y(1, 1), y(12, 31), 460.0, D(2024, 2, 15))])
    q = fu.periodize(fu.choose(df))
    assert {r.end: (r.val, r.derived) for r in q.collect()} == {y(3, 31): (100.0, False), y(6, 30): (110.0, False), y(9, 30): (120.0, True), y(12, 31): (130.0, True)}
    t = [r for r in fu.add_ttm(q).collect() if r.ttm is not None]
    assert [(r.end, r.ttm, r.ttm_filed) for r in t] == [(y(12, 31), 460.0, D(2024, 2, 15))]
    item = fu.Item("revenue", "flow", ("R",))
    s = fu.build_series(df, item).where("ttm is not null").collect()
    assert [(r.end, r.ttm, r.ttm_available_from) for r in s] == [(y(12, 31), 460.0, D(2024, 2, 16))]


def test_tag_switch_only_fills(spark):
    df = facts(spark, [("New", D(2023, 4, 1), D(2023, 6, 30), 110.0, D(2023, 8, 1)), ("Old", D(2023, 4, 1), D(2023, 6, 30), 999.0, D(2023, 8, 1)), ("Old", D(2022, 10, 1), D(2022, 12, 31), 90.0, D(2023, 2, 1))])
    got = {r.end: r.val for r in fu.resolve_tags(df, ["New", "Old"]).collect()}
    assert got == {D(2023, 6, 30): 110.0, D(2022, 12, 31): 90.0}


def test_unit_slip_and_staleness(spark):
    data = [("S", None, D(2023, 3 * k, 28), v, D(2023, 3 * k, 28) + dt.timedelta(days=30)) for k, v in zip((1, 2, 3, 4), (1_000_000.0, 1_010_000.0, 1_010.0, 1_020_000.0), strict=True)]
    shares = fu.build_shares(facts(spark, data), ["S"])
    assert sorted(r.shares for r in shares.collect()) == [1_000_000.0, 1_010_000.0, 1_020_000.0]
    s = facts(spark, [("A", None, D(2022, 1, 31), 1000.0, D(2022, 3, 1))]).select("cik", F.col("tag").alias("item"), "end", F.col("val").alias("value"), F.date_add("filed", 1).alias("available_from"))
    assert fu.latest_as_of(s, "2022-03-01").count() == 0 and fu.latest_as_of(s, "2022-03-02").count() == 1 and fu.latest_as_of(s, "2023-04-01").count() == 0


def test_translations_go(spark):
    df = spark.createDataFrame([("1", "R", "EUR", "x", 1.0), ("1", "R", "USD", "x", 1.1), ("1", "R", "EUR", "y", 2.0), ("1", "R", "USD", "z", 3.0)], "cik string, tag string, unit string, accn string, val double")
    assert sorted(r.val for r in fu.drop_translations(df).collect()) == [1.0, 2.0, 3.0]


def weekdays(a, b):
    while a <= b:
        if a.weekday() < 5:
            yield a
        a += dt.timedelta(days=1)


def test_identity_cases(spark):
    lives = [("OLD", D(2020, 1, 2), D(2020, 6, 15), 100.0, "F1", "C1"), ("NEW", D(2020, 6, 16), D(2020, 12, 31), 101.0, "F1", "C1"), ("OLD", D(2020, 10, 1), D(2020, 12, 31), 5.0, "F2", "C2"), ("REU", D(2020, 1, 2), D(2020, 7, 13), 10.0, "F3", "C3"), ("REU", D(2020, 7, 14), D(2020, 12, 31), 50.0, "F4", "C4"),
             ("AAA", D(2020, 1, 2), D(2020, 3, 31), 20.0, None, "C5"), ("BBB", D(2020, 4, 1), D(2020, 12, 31), 20.2, None, "C5"), ("GAP", D(2020, 1, 2), D(2020, 3, 31), 40.0, "F8", "C8"), ("GAP", D(2020, 6, 1), D(2020, 12, 31), 41.0, "F8", "C8")]
    prices = spark.createDataFrame([(t, d, p) for t, a, b, p, _, _ in lives for d in weekdays(a, b)], "ticker string, date date, close double")
    snap = [D(2020, m, 2) for m in range(1, 13)] + [D(2020, 12, 31)]
    records = spark.createDataFrame([(t, d, f, None, c) for t, a, b, _, f, c in lives for d in snap if a <= d <= b], "ticker string, as_of date, figi string, share_class_figi string, cik string")
    none = spark.createDataFrame([], "ticker string, date date, ratio double")
    eps = identity.episodes(prices)
    assert {(r.ticker, r.first) for r in eps.collect()} == {("OLD", D(2020, 1, 2)), ("OLD", D(2020, 10, 1)), ("NEW", D(2020, 6, 16)), ("REU", D(2020, 1, 2)), ("AAA", D(2020, 1, 2)), ("BBB", D(2020, 4, 1)), ("GAP", D(2020, 1, 2)), ("GAP", D(2020, 6, 1))}
    segs = identity.segment_all(eps, records, prices, none).cache()
    assert {(r.ticker, r.first, r.last) for r in segs.where("ticker = 'REU'").collect()} == {("REU", D(2020, 1, 2), D(2020, 7, 13)), ("REU", D(2020, 7, 14), D(2020, 12, 31))}
    assigned = identity.assign_ids(segs, identity.link_candidates(segs, prices)).cache()
    ids = {(r.ticker, r.first): r.security_id for r in assigned.collect()}
    assert ids["OLD", D(2020, 1, 2)] == ids["NEW", D(2020, 6, 16)] == "F1" and ids["OLD", D(2020, 10, 1)] == "F2"
    assert ids["REU", D(2020, 1, 2)] == "F3" and ids["REU", D(2020, 7, 14)] == "F4"
    assert ids["AAA", D(2020, 1, 2)] == ids["BBB", D(2020, 4, 1)] == "CIK:C5"
    assert ids["GAP", D(2020, 1, 2)] == ids["GAP", D(2020, 6, 1)] == "F8"
    master = identity.master_table(assigned, F.lit(D(2020, 12, 31)))
    q = spark.createDataFrame([("OLD", D(2020, 3, 2)), ("OLD", D(2020, 8, 3)), ("OLD", D(2020, 11, 2)), ("REU", D(2020, 7, 14))], "ticker string, date date")
    assert [r.security_id for r in identity.map_to_security(q, master).orderBy("ticker", "date").collect()] == ["F1", None, "F2", "F4"]
    assert identity.overlaps(master).count() == 0


def test_blocked_pairs_are_not_joined_over_a_third(spark):
    segs = spark.createDataFrame([("A", 0, D(2020, 1, 1), D(2020, 2, 1), "FA"), ("B", 0, D(2020, 3, 1), D(2020, 4, 1), "FB"), ("C", 0, D(2020, 5, 1), D(2020, 6, 1), None), ("D", 0, D(2020, 7, 1), D(2020, 8, 1), None), ("E", 0, D(2021, 7, 1), D(2021, 8, 1), None)], "ticker string, seg int, first date, last date, figi string").selectExpr("*", "cast(null as string) as share_class_figi", "cast(null as string) as cik")
    node = {r.ticker: r.n for r in segs.select("ticker", F.xxhash64("ticker", "seg").alias("n")).collect()}
    edges = spark.createDataFrame([(node[a], node[b], why) for a, b, why in [("A", "C", "figi"), ("C", "B", "handoff"), ("B", "D", "gap"), ("A", "B", "gap")]], "src long, dst long, reason string")
    blocked = spark.createDataFrame([(node["B"], node["A"])], "src long, dst long")
    ids = {r.ticker: r.security_id for r in identity.assign_ids(segs, edges, blocked).collect()}
    assert ids == {"A": "FA", "C": "FA", "B": "FB", "D": "FB", "E": "SYM:E"}
    assert len({r.security_id for r in identity.assign_ids(segs, edges).collect()}) == 2


def test_splits_confirmed_by_price(spark):
    closes = spark.createDataFrame([("B", D(2020, 5, 29), 20.2), ("B", D(2020, 6, 1), 10.1), ("P", D(2020, 8, 31), 60.0), ("P", D(2020, 9, 1), 60.0)], "security_id string, date date, close double")
    sp = spark.createDataFrame([("B", D(2020, 6, 1), 1.0, 2.0), ("P", D(2020, 9, 1), 1.0, 3.0)], "security_id string, execution_date date, split_from double, split_to double")
    assert [r.security_id for r in identity.confirmed_splits(sp, closes).collect()] == ["B"]
    dv = spark.createDataFrame([("B", D(2020, 6, 1), 0.41, "USD"), ("B", D(2020, 6, 2), 0.41, "EUR")], "security_id string, ex_dividend_date date, cash_amount double, currency string")
    got = {r.ex_dividend_date: round(r.factor, 6) for r in identity.mapped_dividends(dv, closes).collect()}
    assert got == {D(2020, 6, 1): round(1 - 0.41 / 20.2, 6), D(2020, 6, 2): 1.0}


def test_names(spark):
    df = spark.createDataFrame([("International Business Machines Corp.", "Intl Business Machines Corporation /NY/"), ("American Airlines Group Inc", "American Express Co"), ("Alphabet Inc.", "Alphabet Holdings")], "a string, b string")
    got = [r[0] for r in df.select(names.similarity(names.tokens(F.col("a")), names.tokens(F.col("b")))).collect()]
    assert got[0] == 1.0 and got[1] == 0.5 and got[2] == 1.0  # below the threshold of 0.6
    word = lambda a, b: spark.range(1).select(names.similarity(names.tokens(F.lit(a)), names.tokens(F.lit(b)))).first()[0]
    assert word("Hilfiger Tommy Corp", "Tommy Hilfiger") == 1.0 and word("JVSPAC Acquisition", "JV SPAC Acquisition") == 1.0 and word("First", "First Horizon") == 0.0 and word(None, "X") == 0.0 and word("AT&T Inc", "Alpha") == 0.0
    said = lambda n: spark.range(1).select(names.tokens(F.lit(n))).first()[0]
    assert said("Johnson & Johnson Common Stock, par $1") == ["JOHNSON", "JOHNSON"] and said("Natl Bk of O'Hara Class B") == ["NATIONAL", "BANK", "OHARA"] and said("3 M Co") == ["3"]
    ratio = lambda s: spark.range(1).select(names.adr_ratio(F.lit(s))).first()[0]
    assert ratio("X ADS, each representing two ordinary shares") == 2.0 and ratio("X ADR representing 1/10 of a share") == 0.1 and ratio("X Common Stock") is None and ratio("Y ADS representing one-half of a share") == 0.5
    eq = lambda n, t, k: spark.range(1).select(names.looks_equity(F.lit(n), F.lit(t), F.lit(k).cast("string"))).first()[0]
    assert eq("Alpha Inc", "ALPH", "CS") and not eq("Alpha Inc", "ALPHw", "CS") and not eq("Alpha Warrants", "ALPHW", None) and eq("Null Corp", "NULT", None)
    assert not eq("Alpha Rights", "ALPHR", "CS") and not eq("Alpha 5% Notes due 2030", "A", "ADRC") and eq("Alpha Common Units", "A", "CS") and not eq("Alpha Common Units", "A", None) and eq(None, "A", None)
    snap = lambda x: spark.range(1).select(names.snap(F.lit(x))).first()[0]
    assert snap(0.21) == 0.2 and snap(1480.0) == 1500.0 and snap(1.04) == 1.0 and snap(0.0) is None


def test_market_cap_and_primary_class(spark):
    bars = spark.createDataFrame([("A", D(2021, 6, d), 100.0, 10.0 * d, 2.0, "1") for d in range(1, 5)] + [("B", D(2021, 6, d), 50.0, 1.0, 1.0, "1") for d in range(1, 5)], "security_id string, date date, close double, volume double, split_factor double, cik string")
    counts = spark.createDataFrame([("A", D(2021, 3, 31), D(2021, 5, 1), 1000.0), ("A", D(2020, 1, 1), D(2021, 6, 3), 7.0), ("B", D(2021, 3, 31), D(2021, 6, 3), 10.0)], "security_id string, end date, available_from date, shares_now double")
    caps = mc.daily(bars, fu.newest_known(counts, "security_id"), spark.createDataFrame([("B", 0.2)], "security_id string, basis double"))
    got = {(r.security_id, r.date.day): r.market_cap for r in caps.collect()}
    assert got["A", 1] == 100000.0 and got["A", 4] == 100000.0 and got["B", 1] is None and got["B", 3] == 100.0
    panel = {(r.security_id, r.date.day): r for r in mc.year_panel(caps).collect()}
    assert panel["A", 4].primary and not panel["B", 4].primary and panel["B", 4].issuer_market_cap == 100100.0


def test_counts_units_splits_and_floats(spark):
    c = spark.createDataFrame([("A", D(2021, 3, 31), D(2021, 5, 1), 1000000.0), ("A", D(2021, 6, 30), D(2021, 8, 1), 1010.0), ("A", D(2021, 9, 30), D(2021, 11, 1), 2040000.0)], "security_id string, end date, filed date, shares double")
    ev = mc.split_events(spark.createDataFrame([("A", D(2021, 7, 1), 1.0, 2.0)], "security_id string, execution_date date, split_from double, split_to double"))
    got = sorted((r.end, r.shares_now) for r in mc.adjusted_counts(c, ev).collect())
    assert got == [(D(2021, 3, 31), 2000000.0), (D(2021, 6, 30), 2020000.0), (D(2021, 9, 30), 2040000.0)]
    caps = spark.createDataFrame([("1", D(2021, 6, 30), 5e9, True)], "cik string, date date, issuer_market_cap double, primary boolean")
    fl = spark.createDataFrame([("1", D(2021, 7, 2), 4e6, D(2021, 9, 1)), ("1", D(2021, 6, 30), 4e9, D(2021, 8, 1)), ("1", D(2022, 6, 30), 4e9, D(2022, 8, 1))], "cik string, float_date date, value double, available_from date")
    out = {r.float_date: (r.float_share, r.unit_fixed) for r in mc.float_table(fl, caps).collect()}
    assert out[D(2021, 6, 30)] == (0.8, False) and abs(out[D(2021, 7, 2)][0] - 0.8) < 1e-9 and out[D(2021, 7, 2)][1] and out[D(2022, 6, 30)][0] is None


def test_cik_map_and_lineage(spark):
    at = spark.createDataFrame([(D(2021, 1, 1), "S1", "ALPH", "Alpha Inc", "01"), (D(2021, 2, 1), "S1", "ALPH", "Alpha Inc", "01"), (D(2021, 1, 1), "S2", "BETA", "Beta Mining Corp", "99"), (D(2021, 1, 1), "S3", "GAMA", "Gamma Ltd", "99")], "as_of date, security_id string, ticker string, name string, cik string")
    pr = spark.createDataFrame([("01", ["ALPH"]), ("02", ["ZZ"])], "cik string, tickers array<string>")
    nm = spark.createDataFrame([("01", "Alpha Inc"), ("02", "Beta Mining Corporation"), ("99", "Other Things")], "cik string, name string")
    got = {r.security_id: (r.cik, r.status) for r in mc.build_cik_map(at, pr, nm).collect()}
    assert got == {"S1": ("01", "verified"), "S2": ("02", "repaired"), "S3": ("99", "rejected")}
    links = spark.createDataFrame([("B", "A", D(2021, 1, 1)), ("C", "B", D(2022, 1, 1))], "security_id string, predecessor_id string, link_date date")
    assert {(r.security_id, r.predecessor_id, r.depth) for r in mc.lineage(links).collect()} == {("B", "A", 1), ("C", "B", 1), ("C", "A", 2)}


def test_short_data(spark):
    w = spark.createDataFrame([("S1", "BRK.B", D(2020, 1, 1), None), ("S2", "X", D(2020, 1, 1), None), ("S3", "X", D(2020, 1, 1), None)], "security_id string, ticker string, valid_from date, valid_to date")
    r = spark.createDataFrame([("BRKB", D(2021, 6, 15), 10.0), ("BRK/B", D(2021, 6, 15), 11.0), ("X", D(2021, 6, 15), 1.0), ("ZZZZ", D(2021, 6, 15), 1.0)], "symbol string, settlement_date date, short_interest double")
    caps = spark.createDataFrame([("S1", D(2021, 6, 11), 2.0, 100.0)], "security_id string, date date, close_raw double, issuer_market_cap double")
    got = sorted((x.symbol, x.security_id, x.si_pct_market_cap) for x in mc.short_interest(r, w, caps).collect())
    assert got == [("BRK/B", "S1", 0.22), ("BRKB", "S1", 0.2)]
