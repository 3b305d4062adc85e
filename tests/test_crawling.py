"""Best-first order against one queue over a whole site."""

import random
from collections import defaultdict

import pytest

from sitefacts.operators import crawling


def queue_order(seeds, links, pages, most, depth):
    """As a crawler does it: sort the queue by score before each visit, first in first out among equals."""
    fetched, out = set(pages), defaultdict(list)
    for src, href, score, pos in sorted(links, key=lambda x: x[3]):
        out[src].append((href, score))
    queue = [(url, 0, score) for url, score, seq in sorted(seeds, key=lambda x: x[2])]
    seen, order = set(), []
    while queue and len(order) < most:
        queue.sort(key=lambda x: -x[2])
        url, level, score = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        if url not in fetched:
            continue
        order.append((url, len(order), level))
        if level < depth and len(order) < most:
            once = set()
            for href, points in out[url]:
                if href not in once and href not in seen:
                    queue.append((href, level + 1, points + score / 100))
                once.add(href)
    return order


def site(rnd, n, per_page):
    names = [f"p{k}" for k in range(n)]
    links, pos = [], 0
    for src in names:
        for _ in range(rnd.randint(0, per_page)):
            links.append((src, rnd.choice(names), float(rnd.choice([0, 1, 2, 3, 5, 6])), pos))
            pos += 1
    seeds = [(rnd.choice(names), float(rnd.choice([100, 45, 45, 38])), k) for k in range(rnd.randint(1, 5))]
    return seeds, links, [x for x in names if rnd.random() < 0.8]


@pytest.mark.parametrize("most, depth, ahead", [(90, 7, 16), (12, 3, 1), (25, 2, 4)])
def test_order_is_that_of_one_queue(spark, most, depth, ahead):
    rnd = random.Random(most)
    sites = {f"s{k}": site(rnd, rnd.randint(1, 60), rnd.choice([1, 4, 9])) for k in range(14)}
    sites["large"] = site(rnd, 900, 12)
    hub = [("p0", f"p{k % 700}", float(k * 7 % 11), 100_000 + k) for k in range(2500)]  # a page with very many links
    sites["hub"] = ([("p0", 100.0, 0)], hub + site(rnd, 700, 2)[1], [f"p{k}" for k in range(0, 700, 2)])
    seeds = [(s, *x) for s, v in sites.items() for x in v[0]]
    links = [(s, *x) for s, v in sites.items() for x in v[1]]
    rnd.shuffle(links)
    pages = [(s, x) for s, v in sites.items() for x in v[2]] * 2
    found = crawling.best_first(
        spark.createDataFrame(seeds, "site string, url string, score double, seq long"),
        spark.createDataFrame(links, "site string, url string, href string, score double, pos long"),
        spark.createDataFrame(pages, "site string, url_key string"),
        most, depth, ahead,
    )
    got = defaultdict(list)
    for r in found.collect():
        got[r.site].append((r.url, r.turn, r.depth))
    for s, (own, out, known) in sites.items():
        assert sorted(got[s], key=lambda x: x[1]) == queue_order(own, out, known, most, depth), s


def test_no_pages(spark):
    none = crawling.best_first(
        spark.createDataFrame([("s", "a", 1.0, 0)], "site string, url string, score double, seq long"),
        spark.createDataFrame([], "site string, url string, href string, score double, pos long"),
        spark.createDataFrame([], "site string, url_key string"),
    )
    assert none.collect() == []
