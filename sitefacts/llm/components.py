"""Connected components by alternating large-star and small-star rounds over an edge table.

Once no more than ``ONE_TASK`` edges are left, a bound that is counted, one task joins them; a larger table goes on in rounds.

Edges with a null end, and edges from a node to itself, say nothing and are left out; repeated edges count once; no edges
give no rows. Other columns stay behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import cut


#: Edges of a partition: small tables take few partitions, whatever the session's shuffles have.
PART = 200_000
#: Edges that one task joins: some 8 MB of ends.
ONE_TASK = 500_000


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b`` (long): the smallest node it is connected to.

    Each round links what a node sees to the smallest of it; minima come from partial aggregation and links from joins
    that Spark may split, so one node with very many links stays spread. Ends when a round changes nothing, or leaves few
    enough edges for one task.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0] > ONE_TASK:
        parts = max(1, -(-mark[0] // PART))
        now = now.coalesce(parts)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(parts)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).where("a <> b").coalesce(parts).distinct().coalesce(parts)
        down = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts)
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(down.select("a", F.col("m").alias("b"))).coalesce(parts).distinct().coalesce(parts))
        new = _mark(after)
        now = after
        if new == mark:
            return _from_stars(now)
        mark = new
    return cut(now.coalesce(1).mapInArrow(_joined, "node long, label long"))


def _joined(batches):
    """Labels of all nodes of a task's edges: each root hooks to the smallest root it meets, then paths are halved to nothing."""
    ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not ends:
        return
    a, b = (np.concatenate(x) for x in zip(*ends))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        left, right = label[a], label[b]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while (label[label] != label).any():
            label = label[label]
    for k in range(0, len(names), PART):
        part = slice(k, k + PART)
        yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(names[label[part]])], ["node", "label"])


def _from_stars(now: DataFrame) -> DataFrame:
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
