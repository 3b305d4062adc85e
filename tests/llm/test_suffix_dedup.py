"""Suffix arrays against sorted suffixes, and removed repeats against every string of every document."""

import hashlib
import random

import numpy as np
import pytest

from sitefacts.llm import suffix_array, suffix_dedup

SPAN = suffix_dedup.SPAN


def of(values):
    return np.array([*values, 0], "uint8")


@pytest.mark.parametrize("first, short", [(128, 12), (3, 2), (1, 1)])
def test_suffixes_are_sorted(first, short, monkeypatch):
    monkeypatch.setattr(suffix_array, "FIRST", first)
    monkeypatch.setattr(suffix_array, "SHORT", short)
    for seed in range(150):
        rnd = random.Random(seed)
        text = of(rnd.randint(1, rnd.choice([1, 2, 3, 200])) for _ in range(rnd.randint(0, 90)))
        order = suffix_array.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())
        shared = suffix_array.common_prefixes(text, order)
        for a, b in zip(order[:-1], order[1:]):
            same = next(k for k in range(len(text)) if text[a + k] != text[b + k])
            assert shared[b] == same


def test_long_runs_are_sorted():
    text = of([5] * 30_000 + [4] + [5] * 30_000 + [6])
    order = suffix_array.suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    assert (np.diff(text[order].astype(int)) >= 0).all() and order[0] == len(text) - 1 and order[1] == 30_000


def test_places_do_not_hang_on_steps(monkeypatch):
    rnd = random.Random(4)
    flat = np.frombuffer(("".join(rnd.choice("abc ") for _ in range(9000)) + "-" * 800).encode(), "uint8")
    ends = np.array([10, 10, 700, 5000, 5049, 5099, len(flat)])
    whole = suffix_dedup._places(flat, ends)
    monkeypatch.setattr(suffix_dedup, "STEP", 256)
    for a, b in zip(whole, suffix_dedup._places(flat, ends)):
        assert a.tolist() == b.tolist()
    covered = {int(s) + k for s, n in zip(whole[0], whole[1]) for k in range(n)}
    assert covered == {p for lo, hi in zip([0, *ends[:-1]], ends) for p in range(lo, hi - SPAN + 1)}


def brute(rows):
    rows = [(-(2**63) if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in rows:
        for k in range(len(b) - SPAN + 1):
            first[b[k : k + SPAN]] = min(first.get(b[k : k + SPAN], d), d)
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - SPAN + 1):
            if first[b[k : k + SPAN]] < d:
                gone[k : k + SPAN] = b"\1" * SPAN
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((None if d == -(2**63) else d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, b"x") for d, t in rows], "doc_id long, text string, kept binary")
    found = suffix_dedup.remove_repeats(df, **how)
    digest = found.selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept)", "size(removed)", "sha2(kept, 256)", "removed", "kept").collect()
    for r in digest:
        assert sum(x.length for x in r.removed) == r[2] and len(r.kept) == r.n_bytes - r[2]
    return sorted((tuple(r)[:5] for r in digest), key=repr)


SMALL = {"bucket_bytes": 20_000, "block_keys": 500, "shard_bytes": 9_000, "crowded": 8}


@pytest.mark.parametrize("how", [{}, SMALL])
def test_removed_bytes_are_those_of_all_strings(spark, how):
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    passage = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    shared, phrase = [passage(n) for n in (4, 9, 15, 30, 200)], passage(6)[:30]
    texts = []
    for _ in range(160):
        parts = [rnd.choice(shared) if rnd.random() < 0.3 else passage(rnd.randint(1, 60)) for _ in range(rnd.randint(1, 5))]
        texts.append((" " + phrase + " ").join(parts) if rnd.random() < 0.6 else "\n".join(parts))
    texts += [None, "", "short", "a" * 49, "a" * 50, "a" * 50, "a" * 500, "x" + "a" * 51, "ab" * 300, "ba" * 40, "\0" * 90, "\0" * 70, texts[0], texts[0], texts[1] * 3, "z" * 40 + shared[4][:49], shared[4][:51]]
    texts += [shared[3] + passage(2000)] + [shared[4]] * 30
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, shared[2] * 2), (None, shared[2]), (3, shared[4]), (3, shared[4])]
    assert run(spark, rows, **how) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_query_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in suffix_dedup.report(docs).collect()), key=repr) == brute(rows)
