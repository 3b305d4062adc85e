"""Dual-tree search against all scores of a small table."""

import math
import random

import numpy as np
import pytest

from sitefacts.llm import cover_tree
from sitefacts.llm.cover_tree import LOWEST, Search, Tree


def brute(rows, k=5):
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in good:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    return sorted(tuple(r) for r in cover_tree.top_k(df, df.where("vec_id % 50 = 0")).collect())


def clustered(rnd, n, width=6):
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    return [[c + rnd.gauss(0, 0.05) for c in rnd.choice(centres)] for _ in range(n)]


def test_answers_are_those_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    rows = list(enumerate(clustered(rnd, 900)))
    rows += [(i, [0.5] * 6) for i in range(900, 1100)]  # one vector of very many rows
    rows += [(1100, None), (1150, [math.nan] + [0.1] * 5), (1151, [None] + [0.1] * 5), (1200, [math.inf] * 6), (None, [1.0] * 6)]
    rows += [(1250, [0.0] * 6), (1300, []), (1350, [3.0, -2.0]), (50, rows[50][1]), (1400, [1e9] * 6)]
    rnd.shuffle(rows)
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 100)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 7)
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, None)]) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (50, [1.0]), (3, [-1.0])]) == [(0, 1, 50, 65536), (0, 2, 3, -65536), (50, 1, 0, 65536), (50, 2, 3, -65536)]


def test_cell_ball_holds_every_block_in_any_order_of_rows(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(6)
    rows = [(c, b, [rnd.gauss(0, 300) for _ in range(5 if b else 3)], rnd.random() * 9) for c in range(2) for b in range(12) if b != 4]
    df = spark.createDataFrame(rows, "cell int, block int, centre array<double>, radius double")
    one, other = (sorted(tuple(r) for r in cover_tree.cell_summaries(df.coalesce(1).sortWithinPartitions(o)).collect()) for o in ("block", F.desc("block")))
    assert one == other and len(one) == 2
    for cell, blocks, centre, reach in one:
        assert blocks == 12
        for _, _, other_centre, radius in (r for r in rows if r[0] == cell):
            wide = [c + [0.0] * (5 - len(c)) for c in (centre, other_centre)]
            assert math.dist(*wide) + radius <= reach + 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_tree_covers_its_points_and_prunes(seed, monkeypatch):
    rnd = random.Random(seed)
    points = np.unique(np.floor(256 * np.array(clustered(rnd, 800))).astype("int64"), axis=0)
    tree = Tree.build(points, [[k] for k in range(len(points))])
    assert sorted(map(tuple, tree.points)) == sorted(map(tuple, points)) and tree.children[0]
    for lo, hi, centre, radius in zip(tree.lo, tree.hi, tree.centres, tree.radii):
        assert np.sqrt(((tree.points[lo:hi] - centre) ** 2).sum(1)).max() <= radius + 1e-9
    met = []
    monkeypatch.setattr(Search, "_leaves", lambda self, data, a, b, f=Search._leaves: (met.append((self.queries.hi[a] - self.queries.lo[a]) * (data.hi[b] - data.lo[b])), f(self, data, a, b)))
    search = Search(tree, 3, np.full(len(points), LOWEST))
    search.meet(tree)
    exact = np.sort(tree.points @ tree.points.T, axis=1)[:, -3:]
    assert (np.sort(search.score.reshape(-1, 3), axis=1) == exact).all()
    assert sum(met) < 0.7 * len(points) ** 2


def test_many_levels_answer_like_all_pairs(spark, monkeypatch):
    rnd = random.Random(12)
    rows = list(enumerate(clustered(rnd, 700, 4))) + [(i, [rnd.gauss(0, 1) for _ in range(rnd.randrange(1, 6))]) for i in range(700, 900)]
    for name, value in {"DATA_BLOCK": 20, "QUERY_BLOCK": 5, "CELLS": 3, "LEVELS": 3, "SAMPLE": 40, "PLACED": 64, "TOGETHER": 2}.items():
        monkeypatch.setattr(cover_tree, name, value)
    assert run(spark, rows) == brute(rows)


def test_equal_scores_beyond_k_go_to_the_smaller_ids(spark):
    # Different vectors of one score with every query: only the ids decide.
    rows = [(i, [1.0, float(i % 7), -float(i % 7)]) for i in range(1, 40)] + [(50, [1.0, 1.0, 1.0]), (100, [2.0, 3.0, 3.0])]
    found = run(spark, rows)
    assert found == brute(rows)
    assert [r[2] for r in found if r[0] == 50] == [100, 1, 2, 3, 4]


def test_cells_hold_every_vector_and_leave_few_pairs_of_blocks(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(8)
    # Clusters in far directions: a query block needs the data blocks of its own direction alone.
    sides = [[1000.0 * (k == n) for k in range(12)] for n in range(12)]
    points = [(i, [int(x + rnd.gauss(0, 20)) for x in sides[i % 12]]) for i in range(2400)]
    df = spark.createDataFrame(points, "name long, v array<long>").select("v", F.array("name").alias("ids"))
    data = cover_tree.cut(cover_tree.trees(cover_tree.in_cells(df, 100), 100))
    asked = cover_tree.cut(cover_tree.trees(cover_tree.in_cells(df.where("ids[0] % 10 = 0"), 30), 30).withColumnRenamed("block", "q_block"))
    held = [i for r in data.select("ids").collect() for i in np.frombuffer(r["ids"], "int64")]
    assert sorted(held) == list(range(2400))
    cells = cover_tree.cell_summaries(data).orderBy("cell").collect()
    near = cover_tree.cut(cover_tree.first_pairs(asked, data, cells))
    seeded = cover_tree.cut(cover_tree.meet(asked.withColumn("worst", F.lit(None).cast("array<long>")), near, data, 6))
    rest = cover_tree.other_pairs(asked.join(seeded.select("q_block", "worst"), "q_block"), data, cells, near)
    pairs, every = near.count() + rest.count(), asked.count() * data.count()
    assert data.count() >= 24 and asked.count() >= 6
    assert pairs < 0.35 * every
