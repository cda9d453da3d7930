"""General queries against their SQL, and the fixed tables."""

import duckdb
import pytest

from lakeloom.operators import items, xsection
from lakeloom.plans import registry

NAMES = ["order_status_pivot", "row_extremes", "filled_prices", "publication_dates", "business_days", "trading_costs", "trade_classes", "cost_buckets", "per_share_units", "adjusted_bars", "linked_segments", "ticker_to_security"]


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted(tables.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall(), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, nan_ok=True) if all(isinstance(x, float) for x in a) else a == b


def test_items_and_sectors():
    assert len(items.ITEMS) == 31 and len({i.name for i in items.ITEMS}) == 31
    assert all(":" in t for i in items.ITEMS for t in i.tags)
    spans = sorted(s for v in xsection.FF12.values() for s in v)
    assert all(a <= b for a, b in spans) and all(spans[i][1] < spans[i + 1][0] for i in range(len(spans) - 1))


def test_item_series_from_qualified_facts(spark):
    from lakeloom.operators.fundamentals import build_series

    rows = [("1", "us-gaap", "Liabilities", "USD", "2020-12-31", 5.0, "a", "2021-02-01"), ("1", "ifrs-full", "Liabilities", "USD", "2020-12-31", 6.0, "b", "2021-03-01"), ("1", "us-gaap", "Assets", "USD", "2020-12-31", 7.0, "a", "2021-02-01")]
    facts = spark.createDataFrame(rows, "cik string, taxonomy string, tag string, unit string, end string, val double, accn string, filed string").selectExpr("cik", "taxonomy", "tag", "unit", "date(end) AS end", "val", "accn", "date(filed) AS filed")
    liabilities = next(i for i in items.ITEMS if i.name == "liabilities")
    got = build_series(items.qualified(facts), liabilities).collect()
    assert [(r["item"], r["value"], str(r["available_from"])) for r in got] == [("liabilities", 5.0, "2021-02-02")]
