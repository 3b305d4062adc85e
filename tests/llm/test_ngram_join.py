"""The shingle join against all pairs of a small table."""

import random
import re

import pytest

from sitefacts.llm import ngram_join


def brute(rows):
    def of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [of(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    low = {}
    for (doc, _), x in zip(rows, label):
        low[x] = min(low.get(x, doc), doc)
    return sorted((doc, len(s), low[x]) for (doc, _), s, x in zip(rows, sets, label))


def made(seed, n=220):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    bases = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    texts = []
    for _ in range(n):
        words = list(rnd.choice(bases[:3]) if rnd.random() < 0.6 else rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        if rnd.random() < 0.2:
            words += passage
        texts.append(rnd.choice([" ", "\n", "  "]).join(words))
    return texts


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    return sorted(tuple(r) for r in ngram_join.near_components(df, **how).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("how", [{}, {"row_classes": 7}])
def test_components_are_those_of_all_pairs(spark, how):
    texts = made(1 if how else 2)
    odd = ["", None, " \n\t", "One two", "one  TWO", "a b c d e", "a b c d e f", "É x y z w", "é x y z w", "same " * 9, texts[0], texts[0].upper(), "long " * 4000 + "end"]
    rows = list(enumerate([*texts, *odd]))
    random.Random(3).shuffle(rows)
    assert run(spark, rows, **how) == brute(rows)


def test_repeated_rows_and_no_rows(spark):
    rows = [(5, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "other words stand in this one here"), (2, "a b c d e f g h"), (9, "")]
    assert run(spark, rows) == [(2, 4, 2), (5, 3, 5), (5, 4, 2), (5, 4, 2), (9, 0, 9)]
    assert run(spark, []) == []


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, ""), (4, None), (5, "quite other words in here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == [1, 3, 4, 5]


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f g h", "x")] * 3 + [(1, "a b c d e f  g h", "x"), (1, "quite other words in here now", "x"), (None, "a b c d e f g h z", "n"), (2, "", "x"), (2, "", "x"), (2, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    kept = sorted((str(r.doc_id), r.text or "", r.label) for r in ngram_join.keep_one(df).collect())
    assert kept == [("1", "quite other words in here now", "x"), ("2", "", "x"), ("2", "", "x"), ("2", "", "x"), ("None", "a b c d e f g h z", "n")]


@pytest.mark.parametrize("classes", [9, 512])
def test_one_large_group_of_near_copies(spark, classes):
    rnd = random.Random(6)
    base = [f"v{k}" for k in range(150)]
    texts = [" ".join(w if rnd.random() > 0.005 else "odd" for w in base) + f" end{k}" for k in range(400)]
    rows = list(enumerate([*texts, " ".join(rnd.choice(base) for _ in range(150))]))
    assert run(spark, rows, row_classes=classes) == brute(rows)


def test_rows_leave_blocks_only_when_no_pair_can_reach_the_bound():
    import numpy as np

    rnd = np.random.default_rng(4)
    sets = []
    for size in (40, 60, 90, 140, 260):
        seed = rnd.choice(20_000, size, replace=False)
        for _ in range(140):
            own = seed.copy()
            swap = rnd.random(size) < rnd.choice([0.02, 0.1, 0.14, 0.3])
            own[swap] = rnd.integers(0, 40_000, swap.sum())
            sets.append(np.unique(own))
    nodes, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    label = list(range(len(sets)))
    for a, b in ngram_join.forest(nodes, sizes, np.concatenate(sets)):
        label[a] = b
    expected = list(range(len(sets)))
    members = [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            if 4 * len(members[i] & members[j]) >= 3 * len(members[i] | members[j]) and expected[i] != expected[j]:
                low, high = sorted((expected[i], expected[j]))
                expected = [low if x == high else x for x in expected]
    assert label == expected


@pytest.mark.parametrize("one_task", [0, 40, 500_000])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, one_task):
    from sitefacts.llm import components

    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rnd = random.Random(one_task)
    nodes = [rnd.randrange(-(2**63), 2**63 - 1) for _ in range(120)]
    edges = [(nodes[k], nodes[k + 1]) for k in range(40)] + [(nodes[50], nodes[k]) for k in range(51, 90)] + [tuple(rnd.sample(nodes[90:], 2)) for _ in range(15)]
    label = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    rows = [(a, b, "x") for a, b in edges + edges[:9]] + [(None, 1, "x"), (7, 7, "x")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long, label string")
    assert sorted(map(tuple, components.components(df).collect())) == sorted(label.items())
    assert components.components(df.where("a = 7")).collect() == []
