import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from lakeloom.plans import registry, runner
from lakeloom.sources import readers, schemas, store
from lakeloom.streaming import capture

D = dt.date


def test_bar_csv(spark, tmp_path):
    ns = lambda h, m: int(dt.datetime(2024, 1, 10, h, m, tzinfo=dt.UTC).timestamp()) * 10**9
    text = "ticker,volume,open,close,high,low,window_start,transactions\nAAPL,10.5,1,2,3,0.5," + str(ns(14, 30)) + ",7\nMSFT,1,1,1,1,1," + str(int(dt.datetime(2024, 1, 11, 2, 0, tzinfo=dt.UTC).timestamp()) * 10**9) + ",1\n"
    with gzip.open(tmp_path / "m.csv.gz", "wt") as f:
        f.write(text)
    got = readers.read_bars_csv(spark, str(tmp_path / "m.csv.gz")).orderBy("ticker").collect()
    assert got[0].volume == 10.5 and got[0].date == D(2024, 1, 10) and got[0].timestamp == dt.datetime(2024, 1, 10, 14, 30) and got[1].date == D(2024, 1, 10)


def test_ticks(spark):
    raw = spark.createDataFrame([("A", "12,37", 0, 1704897000 * 10**9, 0), ("A", "", 5, 1704897000 * 10**9, 7)], "ticker string, conditions string, participant_timestamp long, sip_timestamp long, trf_timestamp long")
    got = readers.transform_ticks(raw).collect()
    assert got[0].conditions == [12, 37] and got[0].participant_timestamp is None and got[1].conditions is None and got[1].trf_timestamp == 7 and got[0].date == D(2024, 1, 10)


def test_rest_rows_are_typed_by_name(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id":"1","execution_date":"2024-01-02","published_utc":"2024-01-02T10:00:00Z","nested":{"a":1},"tickers":["A"]}\n{"id":"2","execution_date":"bad"}\n')
    got = {r.id: r for r in readers.read_rest_json(spark, str(tmp_path / "r.json")).collect()}
    assert got["1"].execution_date == D(2024, 1, 2) and json.loads(got["1"].nested) == {"a": 1} and got["2"].execution_date is None and got["1"].published_utc == dt.datetime(2024, 1, 2, 10)


def test_company_facts_and_submissions(spark):
    doc = {"cik": 320193, "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2023-03-31", "val": 5.5, "accn": "a", "fy": 2023, "fp": "Q1", "form": "10-Q", "filed": "2023-05-01"}, {"end": "2023-03-31", "val": True, "accn": "b", "filed": "2023-05-01"}, {"val": 3, "accn": "c", "filed": "2023-05-01"}]}}}}}
    got = readers.parse_company_facts(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()
    assert [(r.cik, r.tag, r.val, r.end) for r in got] == [("0000320193", "Assets", 5.5, D(2023, 3, 31))]
    sub = {"cik": "7", "name": "New Co", "tickers": ["N"], "formerNames": [{"name": "Old Co", "from": "2001-01-01T00:00:00Z", "to": "2010-01-01T00:00:00Z"}], "filings": {"recent": {"form": ["10-K", "8-K", "10-Q"], "filingDate": ["2020-02-01", "2020-03-01", "2019-11-01"]}}}
    profiles, names = readers.parse_submissions(spark.createDataFrame([(json.dumps(sub),)], "value string"))
    p = profiles.first()
    assert (p.first_periodic, p.last_periodic) == (D(2019, 11, 1), D(2020, 2, 1))
    assert {(r.name, r.valid_from, r.valid_to) for r in names.collect()} == {("Old Co", D(2001, 1, 1), D(2010, 1, 1)), ("New Co", D(2010, 1, 2), None)}


def test_short_volume_layouts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\r\n20240102|AAA|10|1|30|B,Q\r\n20240102|BBB|5|0|9|N\r\n2\r\n")
    (tmp_path / "b.txt").write_text("20240102|AAA|7|20|Q\n1\n")
    rows = readers.read_short_volume(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    got = {r.symbol: r for r in readers.combine_facilities(rows).collect()}
    assert got["AAA"].short_volume == 17 and got["AAA"].total_volume == 50 and got["AAA"].markets == "B,Q" and got["AAA"].short_exempt_volume == 1 and got["BBB"].total_volume == 9


def test_master_index(spark, tmp_path):
    (tmp_path / "i.idx").write_text("Description: x\n\nCIK|Company Name|Form Type|Date Filed|Filename\n----\n1000|ACME|10-K|2020-01-02|edgar/x.txt\n")
    assert [(r.cik, r.form, r.filed) for r in readers.read_master_index(spark, str(tmp_path / "i.idx")).collect()] == [("0000001000", "10-K", D(2020, 1, 2))]


def test_tables_upsert_and_manifest(spark, tmp_path):
    t = store.Tables(spark, f"file://{tmp_path}/t")
    assert t.read("x") is None and t.summary().count() == 0
    a = spark.createDataFrame([("k1", D(2023, 1, 1), 1.0), ("k2", D(2024, 1, 1), 2.0)], "k string, d date, v double").withColumn("year", F.year("d"))
    t.replace("x", a, "year")
    b = spark.createDataFrame([("k2", D(2024, 1, 1), 3.0, "n"), ("k3", D(2024, 5, 1), 4.0, "n")], "k string, d date, v double, extra string").withColumn("year", F.year("d"))
    t.upsert("x", b, "year", ["k", "d"])
    got = sorted((r.k, r.v, r.extra) for r in t.read("x").collect())
    assert got == [("k1", 1.0, None), ("k2", 3.0, "n"), ("k3", 4.0, "n")]
    s = t.summary().first()
    assert (s.partitions, s["first"], s["last"], s.rows) == (2, "2023", "2024", 3)
    assert [r.partition for r in t.todo("x", spark.createDataFrame([("2023",), ("2025",)], "partition string")).collect()] == ["2025"]
    assert {(r.partition, r.problem) for r in t.verify("x", spark.createDataFrame([("2023", 1), ("2024", 5), ("2025", 1)], "partition string, rows long")).collect()} == {("2024", "broken"), ("2025", "missing")}


def test_shrinking_snapshot(spark):
    old = spark.createDataFrame([(i, D(2024, 1, 1 + i % 20)) for i in range(100)], "id int, date date")
    new = spark.createDataFrame([(i, D(2024, 1, 1 + i % 20)) for i in range(50)], "id int, date date")
    assert store.guard_snapshot(old, new, ["id"]).count() == 100
    assert store.guard_snapshot(old, old.limit(99), ["id"]).count() == 99
    try:
        store.guard_snapshot(old, new, [])
    except ValueError:
        pass
    else:
        raise AssertionError("a shrunken snapshot without keys is refused")


def test_market_store_reads(spark):
    master = spark.createDataFrame([("S1", "OLD", D(2020, 1, 1), D(2020, 6, 30)), ("S1", "NEW", D(2020, 7, 1), None), ("S2", "OLD", D(2020, 9, 1), None)], "security_id string, ticker string, valid_from date, valid_to date")
    bars = spark.createDataFrame([("OLD", D(2020, 3, 2), 10.0, 1.0), ("NEW", D(2020, 8, 3), 20.0, 1.0), ("OLD", D(2020, 10, 1), 5.0, 1.0)], "ticker string, date date, close double, volume double")
    live = spark.createDataFrame([("NEW", D(2020, 8, 3), 99.0, 1.0), ("NEW", D(2020, 8, 4), 21.0, 1.0)], "ticker string, date date, close double, volume double")
    splits = spark.createDataFrame([("S1", D(2020, 7, 1), 1.0, 2.0)], "security_id string, execution_date date, split_from double, split_to double")
    s = store.MarketStore({"master": master, "bars_day": bars, "live_bars_day": live, "splits": splits})
    got = s.bars(["NEW"], end=D(2020, 12, 31), by="security", adjust_for="splits", include_live=True).orderBy("date").collect()
    assert [(r.ticker, r.close) for r in got] == [("OLD", 5.0), ("NEW", 20.0), ("NEW", 21.0)]
    assert {r.name: r.security_id for r in s.resolve_ids(["OLD", "NEW"], D(2020, 8, 1)).collect()} == {"OLD": "S1", "NEW": "S1"}
    assert s.bars(["OLD"], columns=["date", "close"]).columns == ["date", "close"]


def _write_events(path, events, name):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(e) for e in events))


def test_live_stream(spark, tmp_path):
    ms = int(dt.datetime(2024, 1, 10, 15, 0, tzinfo=dt.UTC).timestamp() * 1000)
    ev = [{"ev": "T", "sym": "A", "t": ms, "p": 10.5, "s": 100, "x": 4, "c": [12, 37], "i": "1", "q": 5, "z": 3}, [{"ev": "T", "sym": "B", "t": ms + 1, "p": 1, "s": 1, "q": 6}, {"ev": "Q", "sym": "A", "t": ms, "bp": 1.0, "ap": 1.1}]]
    _write_events(tmp_path / "in", ev, "1.txt")
    root = f"file://{tmp_path}/live"

    def drain():
        q = capture.capture(spark.readStream.text(str(tmp_path / "in")), root, "T", every=None)
        q.awaitTermination(120)

    drain()
    rows = spark.read.parquet(f"{root}/live_trades")
    got = {r.ticker: r for r in rows.collect()}
    assert got["A"].price == 10.5 and got["A"].conditions == [12, 37] and got["B"].conditions is None and str(got["A"].date) == "2024-01-10" and got["A"].received_at is not None
    mark = rows.agg(F.max("received_at")).first()[0].isoformat(sep=" ")
    _write_events(tmp_path / "in", [{"ev": "T", "sym": "C", "t": ms - 86400000, "p": 2, "s": 1, "q": 7}], "2.txt")
    drain()
    rows = spark.read.parquet(f"{root}/live_trades")
    late = capture.live_between(rows, mark).collect()
    assert [(r.ticker, str(r.date)) for r in late] == [("C", "2024-01-09")] and rows.count() == 3
    assert capture.compact(spark, root, "T", f"{root}/compacted").count() == 3
    seen = []
    q = capture.follow(spark, root, "T", rows.schema, lambda df, n: seen.extend(r.ticker for r in df.collect()), f"{root}/follow", every=None)
    q.awaitTermination(120)
    assert sorted(seen) == ["A", "B", "C"]
    assert capture.official_first(rows, spark.createDataFrame([(D(2024, 1, 10),)], "date date")).count() == 1


def test_windowed_bars(spark, tmp_path):
    base = dt.datetime(2024, 1, 10, 15, 0)
    t = spark.createDataFrame([("A", base + dt.timedelta(seconds=s), float(s), 1.0, str(s % 50)) for s in (0, 30, 59, 60, 90, 90)], "ticker string, timestamp timestamp, price double, size double, id string")
    t.coalesce(1).write.parquet(str(tmp_path / "t"))
    src = lambda: spark.readStream.schema(t.schema).parquet(str(tmp_path / "t"))
    for name, df, n in (("w", capture.windowed_bars(src()), 2), ("s", capture.sessionized(src()), 1), ("u", capture.unique_trades(src()), 5)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "u" else "complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.sql(f"select * from {name}").count() == n
    first = spark.sql("select * from w order by window").first()
    assert (first.open, first.close, first.volume) == (0.0, 59.0, 3.0)


def test_runner():
    log, tries = [], []

    def busy():
        tries.append(1)
        if len(tries) < 3:
            raise runner.Busy("locked")
        log.append("b")

    def fail():
        raise RuntimeError("no")

    steps = [runner.Step("c", lambda: log.append("c"), ("b",)), runner.Step("a", lambda: log.append("a")), runner.Step("b", busy, ("a",)), runner.Step("x", fail), runner.Step("y", lambda: log.append("y"), ("x",)), runner.Step("late", lambda: None, limit_seconds=-1)]
    got = {r.name: r.status for r in runner.nightly(steps, sleep=lambda s: None)}
    assert got == {"a": "done", "b": "done", "c": "done", "x": "failed", "y": "skipped", "late": "late"} and log == ["a", "b", "c"]
    assert runner.missed(D(2024, 1, 2), D(2024, 1, 5), [D(2024, 1, d) for d in (2, 3, 4, 5)]) == [D(2024, 1, 3), D(2024, 1, 4)]


def test_freshness(spark):
    df = spark.createDataFrame([(D(2024, 1, 3),)], "date date")
    got = {r.store: (r.behind_days, r.fresh) for r in runner.freshness(spark, {"a": (df, "date", 1), "b": (df, "date", 3)}, D(2024, 1, 5)).collect()}
    assert got == {"a": (2, False), "b": (2, True)}


def test_registry_and_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 40
    out = entry.entry(spark)
    assert out.columns == ["date", "names", "long_short"] and out.count() > 0


def test_layers_do_not_import_the_text_operators():
    import pathlib

    root = pathlib.Path(registry.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lakeloom.llm" not in p.read_text() and "from ..llm" not in p.read_text() and "from .llm" not in p.read_text()


def test_conform(spark):
    got = schemas.conform(spark.createDataFrame([("A", "2")], "ticker string, split_to string"), schemas.SPLITS)
    assert got.columns == ["ticker", "execution_date", "split_from", "split_to"] and got.first().split_to == 2.0
