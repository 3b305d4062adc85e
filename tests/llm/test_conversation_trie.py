"""The conversation trie against its SQL and against tries built row by row."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from sitefacts.llm import conversation_trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    lent = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return {c: turns.get(c - int(math.fmod(c, 20)), [])[: lent[c]] + turns[c][lent[c] :] for c in turns}


def brute(rows):
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        leaf = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)]
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(key))))
        parent = min(members[key[:-1]]) if key else None
        children = sum(len(k) == len(key) + 1 for k in below)
        out.append((min(own), len(key), parent, len(own), children, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, node int")
    return sorted((tuple(r) for r in conversation_trie.report(df).select(*NAMES).collect()), key=repr)


def made(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(400), n):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rnd.choice(["hello there", "so  what\nnow", "a", "b c d"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_are_those_built_row_by_row(spark, seed, monkeypatch):
    monkeypatch.setattr(conversation_trie, "STRETCH", 16 if seed == 1 else 4096)
    monkeypatch.setattr(conversation_trie, "MANY", 2 if seed == 1 else 1000)
    monkeypatch.setattr(conversation_trie, "BROADCAST_ROWS", 0 if seed == 1 else 10)
    rows = made(seed, 90)
    rows += [(401, None, None, None), (401, 1, "user", ""), (402, 0, "user", ""), (None, 1, "user", "x"), (420, 5, "user", "tail"), (420, 5, "user", "tail"), (421, 3, "assistant", None), (-3, 1, "user", "minus"), (-20, 1, "user", "m")]
    rows += [(500, k, "user", f"t{k}") for k in range(300)] + [(501, k, "user", f"t{k}") for k in range(300)]
    random.Random(5).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_one_turn_of_very_many_conversations(spark):
    rows = [(c, 0, "user", "good day") for c in range(0, 12000, 20)] + [(c, 1, "assistant", f"answer {c % 40}") for c in range(0, 6000, 20)]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    path = f"/root/testdata/{sf}/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{path}')")
    found = sorted(map(repr, con.execute(f"select {', '.join(NAMES)} from ({conversation_trie.ORACLE})").fetchall()))
    assert found == sorted(repr(tuple(r)) for r in conversation_trie.report(spark.read.parquet(path)).select(*NAMES).collect())
