"""Queries on larger tables: all rows of a site, even tasks, and work that does not grow with a site's rules."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sitefacts.operators import blocks, crawling, facts
from sitefacts.plans import catalog
from sitefacts.plans.fixtures import frame
from sitefacts.sources.tables import spread, table
from test_queries import rows_of

LARGER = "/root/testdata/sf0.1"


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["image_details", "image_groups"])
def test_all_images_of_a_site_count(spark, name):
    """Sites have 80 photos here, more than a record lists."""
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{LARGER}/part.parquet')")
    names, found = rows_of(catalog.queries()[name](spark, LARGER))
    result = con.execute(catalog.oracle_sql()[name])
    at = [[c[0] for c in result.description].index(n) for n in names]
    assert found == sorted(repr(tuple(r[k] for k in at)) for r in result.fetchall())


@pytest.mark.parametrize("name, source", [("fx_texts", "customer"), ("fx_values", "part"), ("fx_targets", "customer"), ("fx_robots", "part")])
def test_rows_of_one_row_group_are_dealt_to_many_tasks(spark, name, source):
    given = table(spark, LARGER, source)
    assert given.rdd.getNumPartitions() == 1
    sizes = spread(given).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == given.count() and len(sizes) >= 16 and max(sizes) < 2 * min(sizes)
    assert frame(spark, LARGER, name).rdd.getNumPartitions() >= 16


def test_all_words_of_a_text_count(spark):
    """Texts have more than 12 words here; the words are looked for without the query's own parts."""
    found = {}
    for r in catalog.queries()["first_seen"](spark, "/root/testdata/sf0.001").collect():
        found.setdefault((r.site, r.page_seq), []).append((r.n, r.word))
    expected = {}
    for r in frame(spark, "/root/testdata/sf0.001", "fx_texts").collect():
        firsts = {}
        for word in r.text.split():
            firsts.setdefault(word.lower(), word)
        expected[r.site, r.page_seq] = list(enumerate(firsts.values()))
    assert max(map(len, expected.values())) > 50
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in expected.items() if v}


def test_terms_are_counted_in_many_tasks(spark):
    assert catalog.queries()["term_scores"](spark, LARGER).rdd.getNumPartitions() >= 16


def test_hits_are_counted_once(spark):
    rows = spark.createDataFrame([("pool and pool",)], "text string").select(facts.amenity_scores(F.col("text")).alias("m"))
    assert plan_of(rows).count("swimming") == 2  # once for hits, once for what speaks against them
    assert rows.first().m["pool"] == 0.7


def test_policy_lines_are_read_once(spark):
    rows = catalog.queries()["policy_blocks"](spark, "/root/testdata/sf0.001")
    assert plan_of(rows).count("split(text") <= 2  # given rows and invented ones


def test_the_first_policy_block_that_fits_counts(spark):
    text = "Pets\nParking\nPets stay for a fee of $20\nParking\nDogs are not allowed in the restaurant"
    found = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(blocks.policies(F.col("text")).alias("p")).collect()
    assert [(r.p.pet.value, r.p.pet.confidence) for r in found] == [("Pets stay for a fee of $20", 0.48), ("", 0.0), ("", 0.0)]


def test_robots_rules_are_looked_up(spark):
    """Against each rule of the site by itself; no row holds a site's rules."""
    paths = ["/", "/a", "/a/", "/a/b", "/a//", "/ab", "/a/b/c/", "/a//b"]
    rules = [("s", k, k % 3 == 0, p) for k, p in enumerate(paths)] + [("s", 9, True, "/a/b"), ("t", 0, False, "/a/b/")]
    urls = [(s, f"https://h.test{p}") for s in ("s", "t", "u") for p in ("", "/", "/a", "/a/", "/a/b", "/a/b/", "/a/b/c", "/a/b/c/d", "/abc", "/a//b/c", "/ab?x=/a/b/c/", "//a")] + [("s", "no url"), ("s", "https://h.test/a"), (None, "https://h.test/a"), ("s", None)]

    def expected(site, url):
        if not url or "://" not in url:
            return False
        at = url.removeprefix("https://h.test").split("?")[0] or "/"
        fits = [(len(p), -k, a) for s, k, a, p in rules if s == site and (at == p or at.startswith(p if p.endswith("/") else p + "/"))]
        return max(fits)[2] if fits else True

    found = crawling.allowed(spark.createDataFrame(urls, "site string, url string"), spark.createDataFrame(rules, "site string, seq int, allow boolean, path string"))
    assert "collect_list" not in plan_of(found) and found.columns == ["site", "url", "allowed"]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.site, r.url, r.allowed) for r in found.collect()), key=key) == sorted(((s, u, expected(s, u)) for s, u in urls), key=key)
