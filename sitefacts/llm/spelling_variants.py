"""Spelling variants of the corpus' words, by an even-partition pigeonhole join.

A word is cut into two halves at a place that its length fixes. One edit leaves one half of the shorter word whole, so two
words at one edit agree in a half: each word is indexed under both, and probes with the substrings of its own that stand there
if it is as long, or one longer (then a half behind the edit is shifted by one). Words under one key are candidates, made
distinct and verified by an edit distance.

A half that more than ``CROWD`` entries share is not joined: its entries are keyed anew, by the same rule, with the shared half
and one half of what remains, until few are left or one place remains (where entries can differ by one letter only). So
candidates stay in proportion to the words, whatever part of them shares a half.

Words are counted over whole texts in tasks that hold a bounded number of words; all else is joins and aggregates. A form is
followed to its root by pointer doubling: counts at least double along a chain, so chains are short.

A null text has no words; a null doc_id is written as nothing. Repeated rows count each. No rows give no words. Other columns
stay behind.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import cut, small, texts

#: Every so many runs loses a letter; code points and occurrences of a word; how often a form must occur for each occurrence.
ONE_IN, LEAST_LENGTH, LEAST_COUNT, OUTWEIGH = 97, 5, 3, 2
#: Entries of a key above which it is split.
CROWD = 24
#: Words that a task holds before it hands them on.
HELD = 150_000
RUNS = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words of ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences or more."""

    def run(batches):
        total: Counter[str] = Counter()

        def pack():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lower = text.encode("utf-8", "replace").lower().decode()  # of bytes only A-Z have another case
                salt = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                for word, n in Counter(m[0] for m in RUNS.finditer(lower)).items():
                    h = zlib.crc32(word.encode(), salt)
                    if h % ONE_IN == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
                if len(total) > HELD:
                    yield pack()
        yield pack()

    counted = texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _keyed(entries: DataFrame) -> DataFrame:
    """Two entries for each: the edit is in the second half of what remains, or in the first; the rest is the key.

    ``low`` and ``high`` bound what remains of a word of ``size`` letters; in one that is ``longer`` by a letter it ends one
    place later.
    """
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high")))
    rows = entries.withColumn("half", F.explode(halves)).select("word", "n", "size", "longer", "half.low", "half.high")
    before = F.substring(F.col("word"), F.lit(1), F.col("low"))
    behind = F.substring(F.col("word"), F.col("high") + F.col("longer").cast("int") + 1, F.length("word"))
    return rows.withColumn("key", F.xxhash64("size", "low", "high", before, behind))


def entries(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``key, word, n, longer``: words that agree in all but the remains of a key, few to a key."""
    length = F.length("word")
    start = words.select("word", "n", length.alias("size"), F.lit(False).alias("longer"))
    start = start.unionByName(words.where(length > LEAST_LENGTH).select("word", "n", (length - 1).alias("size"), F.lit(True).alias("longer")))
    level = _keyed(start.withColumn("low", F.lit(0)).withColumn("high", F.col("size")))
    ready = []
    while True:
        level = cut(level)
        crowded = cut(level.where("high - low > 1").groupBy("key").count().where(F.col("count") > crowd).select("key"))
        if crowded.isEmpty():
            break
        crowded = small(crowded)
        ready.append(level.join(crowded, "key", "left_anti"))
        level = _keyed(level.join(crowded, "key", "left_semi"))
    for part in ready:
        level = level.unionByName(part)
    return level.select("key", "word", "n", "longer")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word, near, near_n`` for every ordered pair of words at one edit."""
    keyed = cut(entries(words, crowd))
    own = keyed.where("not longer").select("key", "word", "n")
    other = own.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    one_edit = F.levenshtein(F.col("word"), F.col("near"), 1) == 1
    equal = own.join(other, "key").where((F.col("word") != F.col("near")) & one_edit).select("word", "near", "near_n")
    longer = keyed.where("longer").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    mixed = own.join(longer, "key").where(one_edit).select("word", "n", "near", "near_n").distinct()
    both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("x")
    return equal.unionByName(mixed.select(both).select("x.*"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` with ``root``: where the chain of ``form`` from each ``word`` ends."""
    chains = cut(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = cut(chains.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        chains = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return forms.join(chains, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word, n, form, root, n_near, form_n``: for each word its form, the root of its group, and how many words are near."""
    words = cut(word_counts(docs))
    best = near_words(words, crowd).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    heavy = -F.col("best.less") >= OUTWEIGH * F.col("n")
    forms = words.join(best, "word", "left").select(
        "word", "n", F.when(heavy, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(heavy, -F.col("best.less")).alias("form_n")
    )
    return with_roots(cut(forms)).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = f"""
WITH RECURSIVE
  bits(b, v, k) AS (SELECT b, b, 0 FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
  crcs AS (SELECT list(v ORDER BY b) AS of FROM bits WHERE k = 8),
  d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
  r AS (SELECT doc_id, unnest(regexp_extract_all(x, '[a-zÀ-ÿ]+')) AS run FROM d),
  c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
  u AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM c),
  s AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda k: ('0x' || h[k:k + 1])::BIGINT)),
               lambda a, z: xor(a // 256, crcs.of[xor(a % 256, z) + 1])), 4294967295) AS v FROM u, crcs),
  e AS (SELECT CASE WHEN v % {ONE_IN} = 0 THEN run[1:v % len(run)] || run[v % len(run) + 2:] ELSE run END AS word, n FROM s),
  w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE len(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
  p AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS k FROM w),
  g AS MATERIALIZED (SELECT word, n, k, word[1:k - 1] AS a, word[k + 1:] AS z FROM p),
  m AS (SELECT l.word, o.word AS near, o.n AS m FROM g l JOIN g o ON l.a = o.a AND l.z = o.z AND l.k = o.k AND l.word <> o.word
        UNION ALL (SELECT DISTINCT w.word, g.word, g.n FROM g JOIN w ON w.word = g.a || g.z)
        UNION ALL (SELECT DISTINCT g.word, w.word, w.n FROM g JOIN w ON w.word = g.a || g.z)),
  b AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -m, near := near)) AS best FROM m GROUP BY word),
  f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {OUTWEIGH} * w.n THEN best.near END AS form, CASE WHEN -best.less >= {OUTWEIGH} * w.n THEN -best.less END AS form_n FROM w LEFT JOIN b USING (word)),
  t(word, here) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.here AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f AS o ON o.word = t.here AND o.form IS NULL
"""
