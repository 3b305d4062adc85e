"""The prefix trie of conversations, by chained digests.

Each turn is digested where it is read, so no text is shuffled. Along a conversation the digests are chained (SHA-256 of the
digest so far and the next turn's), in one pass over turns in order that holds a single digest, so conversations may be of any
length. Every prefix is a row; rows of equal depth and digest are one node.

Sums over subtrees: a node belongs to the smallest conversation that starts with it, whose further nodes are its own too. So
what a conversation's own nodes hand to each of their ancestors is a running sum from its end, a row for each ancestor and
conversation instead of one for each ancestor and node; partial aggregation adds these up by node. A node's smallest
conversation reaches its children through a join; nodes of very many children are joined apart, by a counted broadcast or
salted. The conversations that end at a node are joined to one text in stretches of ``STRETCH`` ids, which are hashed one
after another.

A null role or text is empty; null turns come first; a negative id belongs to the head that SQL's remainder names; turns of equal number are ordered by their digests. Rows without a
conv_id are left out. Repeated rows are turns of their own. No rows give no nodes. Other columns stay behind.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.llm.common import BROADCAST_ROWS, cut, words_of

#: Conversations under one head, and the turns that a head may lend.
FAMILY, LENT = 20, 4
#: Width in ids of a stretch of a node's ends; children from which a node is joined apart, and ways it is dealt then.
STRETCH, MANY, SALTS = 4096, 1000, 64

ROOT = hashlib.sha256().digest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``turn`` (digest of role and text) and ``words`` of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), digest.alias("turn"), F.size(words_of(text)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "turn")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "turn", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns ``conv_id, pos, turn, words`` where each conversation begins with its family head's first ones.

    A row at ``pos`` 0 without a turn stands for each conversation, so that those without turns stay known.
    """
    lent = F.crc32(F.col("conv_id").cast("string")) % LENT
    convs = turns.where("pos = 1").select("conv_id", lent.alias("lent"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"))
    heads = turns.where((F.col("pos") < LENT) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "head")
    begun = convs.join(heads, "head").where(F.col("pos") <= F.col("lent")).select("conv_id", "pos", "turn", "words")
    own = turns.where(F.col("pos") > lent)
    known = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"))
    return begun.unionByName(own).unionByName(known)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, words, ends`` for every prefix: chained digests, and whether the conversation ends there."""

    def run(batches):
        conv, depth, node = None, 0, ROOT
        held = None  # the last prefix, until it is known whether its conversation goes on

        def pack(rows):
            kinds = (("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("ends", pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

        for batch in batches:
            out = []
            for c, turn, words in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "words"))):
                if held is not None:
                    out.append((*held, held[0] != c))
                if c != conv:
                    conv, depth, node, parent = c, 0, ROOT, None
                else:
                    depth, parent, node = depth + 1, node, hashlib.sha256(node + turn).digest()
                held = (c, depth, node, parent, words)
            if out:
                yield pack(out)
        if held is not None:
            yield pack([(*held, True)])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(run, "conv_id long, depth long, node binary, parent binary, words long, ends boolean")


def _end_digests(rows: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of nodes ``node`` at which conversations ``conv_id`` end."""

    def run(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for other, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                if other != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = other, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    stretches = rows.groupBy("node", F.floor(F.col("conv_id") / STRETCH).alias("stretch")).agg(ids.alias("text"))
    return stretches.repartition("node").sortWithinPartitions("node", "stretch").select("node", "text").mapInArrow(run, "node binary, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_conv_id``, the smallest conversation of each node's parent."""
    heads = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = cut(heads.where(F.col("n_children") >= MANY).drop("n_children"))
    if many.count() <= BROADCAST_ROWS:
        first = nodes.join(F.broadcast(many), "parent", "left")
    else:
        salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        first = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["parent", "salt"], "left").drop("salt")
    few = heads.where(F.col("n_children") < MANY).drop("n_children")
    rest = first.where("parent_conv_id is null").drop("parent_conv_id").join(few, "parent", "left")
    return first.where("parent_conv_id is not null").unionByName(rest)


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of turns ``conv_id, pos, turn, words`` with their smallest conversation, parent, members and subtree sums."""
    rows = cut(prefixes(turns))
    nodes = rows.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("words").alias("words"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    upward = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    handed = rows.select("conv_id", "depth", "node").join(own, ["conv_id", "depth"], "left")
    handed = handed.select("node", *(F.sum(F.coalesce(c, F.lit(0).cast("long"))).over(upward).alias(c) for c in ("leaf", "saved")))
    sums = handed.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = _end_digests(rows.where("ends").select("node", "conv_id"))
    out = _with_parents(nodes).join(sums, "node").join(ends, "node", "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """The trie's nodes without their digests, of conversations rebuilt on their family heads."""
    return trie(rebuilt(cut(turn_digests(conversations)))).drop("node", "parent")


ORACLE = f"""
WITH RECURSIVE
  bits(b, v, k) AS (SELECT b, b, 0 FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
  crcs AS (SELECT b, v FROM bits WHERE k = 8),
  t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
  steps(c, s, i, v) AS (SELECT DISTINCT c, c::VARCHAR, 0, 4294967295 FROM t
      UNION ALL SELECT c, s, i + 1, xor(steps.v // 256, crcs.v) FROM steps JOIN crcs ON crcs.b = xor(steps.v % 256, ascii(s[i + 1])::BIGINT) WHERE i < len(s)),
  ids AS (SELECT c, xor(v, 4294967295) % {LENT} AS h FROM steps WHERE i = len(s)),
  b AS (SELECT ids.c, p, r, x FROM ids JOIN t ON t.c = ids.c - ids.c % {FAMILY} AND p <= h UNION ALL SELECT ids.c, p, r, x FROM ids JOIN t ON t.c = ids.c AND p > h),
  l AS (SELECT ids.c, coalesce(list(struct_pack(r := r, x := x) ORDER BY p) FILTER (p IS NOT NULL), []) AS turns FROM ids LEFT JOIN b ON b.c = ids.c GROUP BY ids.c),
  e AS (SELECT c, len(turns) AS len, turns, unnest(range(len(turns) + 1)) AS d FROM l),
  n AS (SELECT d, turns[1:d] AS key, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends FROM e GROUP BY ALL),
  w AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(string_split_regex(key[d].x, '[ \\t-\\r]+'), lambda y: y <> '')) END AS saved FROM n),
  k AS (SELECT a.d, a.key, count(*) FILTER (z.d = a.d + 1) AS n_children, sum(z.saved) AS saved FROM w a JOIN w z ON z.key[1:a.d] = a.key GROUP BY a.d, a.key),
  f AS (SELECT a.d, a.key, count(*) AS n_leaves FROM w a JOIN k z ON z.key[1:a.d] = a.key AND z.n_children = 0 GROUP BY a.d, a.key)
SELECT w.c AS conv_id, w.d::BIGINT AS depth, up.c AS parent_conv_id, w.n_convs, k.n_children, f.n_leaves, k.saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN k ON k.key = w.key JOIN f ON f.key = w.key LEFT JOIN w up ON w.d > 0 AND up.d = w.d - 1 AND up.key = w.key[1:w.d - 1]
"""
