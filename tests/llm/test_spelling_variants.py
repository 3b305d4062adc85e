"""Spelling variants against all pairs, and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from sitefacts.llm import spelling_variants

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(rows):
    total = Counter()
    for doc_id, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    found = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        found[w] = (best if best and words[best] >= 2 * n else None, len(close))
    out = []
    for w, (form, n_near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.append((w, form, root, words[w], n_near, words[form] if form else None))
    return sorted(out, key=repr)


def made(seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(4, 12))) for _ in range(40)]
    rows = []
    for doc in range(300):
        words = []
        for _ in range(40):
            w = rnd.choice(stems)
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abcÉÿ") + w[k:], w[:k] + rnd.choice("Abz") + w[k + 1 :]])
            words.append(w)
        rows.append((doc if rnd.random() < 0.95 else None, rnd.choice([" ", "-", "7"]).join(words)))
    return rows


@pytest.mark.parametrize("crowd", [24, 2])
def test_variants_are_those_of_all_pairs(spark, crowd):
    rows = made(crowd) + [(1, None), (2, ""), (3, "x" * 5000 + " " + ("y" * 4999 + " ") * 3 + ("y" * 5000 + " ") * 9), (5, "naïve naïve naïve naive naive naive naive naive naive naive"), (6, "ααααααα ααααααα ααααααα")] * 2
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string")
    assert sorted((tuple(r) for r in spelling_variants.variants(df, crowd).select(*NAMES).collect()), key=repr) == brute(rows)


def test_words_that_share_a_half_make_few_candidates(spark):
    """Of words with one common half, only entries of small keys are left to be joined."""
    words = [("common" + "".join(random.Random(k).choice("abcdefgh") for _ in range(6)), 3) for k in range(4000)]
    keyed = spelling_variants.entries(spark.createDataFrame(sorted(set(words)), "word string, n long"))
    groups = keyed.groupBy("key", "longer").count().collect()
    assert max(r["count"] for r in groups) <= 24
    assert sum(r["count"] ** 2 for r in groups) < 40 * len(words)


def test_no_rows(spark):
    assert spelling_variants.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}')")
    found = sorted(map(repr, con.execute(f"select {', '.join(NAMES)} from ({spelling_variants.ORACLE})").fetchall()))
    assert found and found == sorted(repr(tuple(r)) for r in spelling_variants.variants(spark.read.parquet(path)).select(*NAMES).collect())
