"""Every query that has SQL against that SQL; the rest against rows worked out by hand."""

import math

import duckdb
import pytest

from sitefacts.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(map(repr, (tuple(plain(r[c]) for c in names) for r in frame.collect())))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in ("documents", "pages", "conversations", "events", "part", "customer", "lineitem"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    names, found = rows_of(QUERIES[name](spark, SF))
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    expected = sorted(repr(tuple(plain(r[columns.index(c)]) for c in names)) for r in result.fetchall())
    assert found == expected and found


def test_crawl_order(spark):
    rows = [(r.site, r.turn, r.url, r.depth) for r in QUERIES["crawl_best_first"](spark, SF).collect()]
    # Seeds first; then by score, parents adding a hundredth of theirs; the deepest chain ends at depth 7.
    assert sorted(r for r in rows if r[0] == "g1") == [("g1", k, u, d) for k, (u, d) in enumerate([("A", 0), ("F", 0), ("C", 1), ("E", 2), ("B", 1), ("D", 2)])]
    assert sorted(r for r in rows if r[0] == "g2") == [("g2", k, f"N{k}", k) for k in range(8)]


def test_venue_of_a_dining_block(spark):
    row = QUERIES["venues"](spark, SF).collect()[0]
    assert row.restaurant_name == "Blue Door" and row.hours == "Mon-Fri 7:00 - 10:30, 17:00 - 22:00\nSat 08:00 - 11:00"
    assert row.menu_items.split("|")[:2] == ["Avocado toast with egg $14", "House Burger - $18.50"]


def test_site_records_cover_all_sites(spark):
    rows = QUERIES["site_records"](spark, SF).collect()
    assert len(rows) == QUERIES["longest_title"](spark, SF).count()
    assert all(r.complete + r.partial + r.uncertain + r.missing == 22 and r.hotel_name for r in rows)


def test_entry_point_and_names(spark):
    import __spark_entry__

    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["site_primary_phone", "phone_candidates", "longest_title", "most_common_value"])
def test_results_do_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows_of(QUERIES[name](spark, SF)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
