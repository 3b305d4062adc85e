"""Similarity join of documents by word shingles, exact for Jaccard similarity of 0.75 and more.

The document by shingle incidence is multiplied with itself in blocks, and only where the size-derived bounds leave
something to find:

1. Documents with equal shingle sets form one class. From here on a class stands for its documents.
2. Column blocks: shingles are dealt by hash to blocks, packed 4 bytes each. A block tells each document how many of its
   shingles there occur in another document too. A pair at 0.75 shares at least 3/4 of either set, so a document with fewer
   shared shingles than that has no partner and leaves. Shingles that repeat inside one task's batch are sent once, so a
   shingle of very many documents costs one entry a batch. (Short keys can only add candidates, never lose one.)
3. Among the rest, shared shingles are counted exactly and ordered rarest first. By the same bound, two similar documents
   share a shingle in their first ``shared - 3n/4 + 1`` ones; documents that do so, and whose sizes are of one size class
   or of neighbouring ones (a class spans a factor of 4/3, so no similar pair is further apart), form candidate clusters.
4. Row blocks: each cluster is multiplied, in blocks of bounded size, accumulating overlap counts column block by column
   block; row blocks whose sizes differ by more than the bound are skipped, and a row leaves as soon as the shingles that
   it has left cannot bring any of its pairs up to the bound. A block gives out a spanning forest of its links, never its
   pairs. Clusters above the block size first meet along a star of blocks; only classes that are not in
   the largest component then meet the remaining blocks, which covers every pair of different components.

The result's links are exactly those with 100 * intersection >= 75 * union (shingles compared by 64-bit hashes).

Null or empty texts, and texts of blanks, have an empty set and are linked with nothing. A text of fewer than five words
is one shingle. Repeated rows fall into one class; a null doc_id counts as the smallest id. Other columns stay behind.
``keep_one`` keeps one row of each component, of repeated rows too, and every row with an empty set, all columns as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import cut, small, texts
from sitefacts.llm.components import components

WIDTH = 5
#: Similarity as a fraction.
PART, WHOLE = 3, 4
#: Shingles of a mapper's batch, of a column block and of a row block; classes of a row block.
BATCH, COLUMNS, ROW_SHINGLES, ROW_CLASSES = 1_000_000, 1_000_000, 500_000, 512
#: Documents whose counts are summed together.
BUCKET = 20_000
NULL_ID = -(2**63)

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text, A-Z read as a-z."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, "uint64")
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], "uint64")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    n = len(words) - WIDTH + 1
    out = hashes[:n].copy()
    for k in range(1, WIDTH):
        out *= _MIX
        out += hashes[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def least_shared(n):
    """The smallest intersection that a set of ``n`` can have with a similar one."""
    return -(-PART * n // WHOLE)


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, of_text, n, node``: hash of the text, set size and class of every row."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], "uint64").view("int64")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes)], ["doc_id", "of_text", "n", "node"])

    return _rows(docs).withColumn("of_text", F.xxhash64("text")).mapInArrow(run, "doc_id long, of_text long, n long, node long")


def _rows(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))


def shared_counts(docs: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """``doc_id, shared``: how many shingles of a row occur in other rows too; at times one too many, never too few.

    Each block packs its counts by bucket of rows, so what leaves it is a row for each bucket, not one for each document.
    """

    def deal(batches):
        held: list[tuple[int, np.ndarray]] = []
        turn = TaskContext.get().partitionId()

        def send():
            nonlocal turn
            turn += 1
            ids = np.array([i for i, _ in held], "int64")
            keys = np.concatenate([s for _, s in held])
            owner = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
            order = np.argsort(keys)
            line = keys[order]
            same = np.zeros(len(line), bool)
            same[1:] = line[1:] == line[:-1]
            twice = same.copy()
            twice[:-1] |= same[1:]
            repeated = np.empty(len(line), bool)
            repeated[order] = twice
            del order, same
            own = np.bincount(owner[repeated], minlength=len(ids))
            some = np.flatnonzero(own)
            rows = [(turn % blocks, ids[some].tobytes(), own[some].astype("uint32").tobytes(), b"", b"")]
            once, common = ~repeated, np.unique(line[twice])
            del line, twice
            for kind, values, who in ((0, keys[once], owner[once]), (1, common, None)):
                block = ((values >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
                place = np.argsort(block, kind="stable")
                edges = np.searchsorted(block[place], np.arange(blocks + 1, dtype="uint64"))
                short = values[place].astype("uint32")
                for b in np.flatnonzero(np.diff(edges)):
                    lo, hi = edges[b], edges[b + 1]
                    if kind:
                        rows.append((int(b), b"", b"", b"", short[lo:hi].tobytes()))
                    else:
                        docs_here, sizes = np.unique(who[place[lo:hi]], return_counts=True)  # rows of a document stay together
                        rows.append((int(b), ids[docs_here].tobytes(), sizes.astype("uint32").tobytes(), short[lo:hi].tobytes(), b""))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], ["block", "ids", "sizes", "keys", "common"])

        total = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingles(text)
                if len(found):
                    held.append((doc_id, found))
                    total += len(found)
                if total >= BATCH:
                    yield send()
                    total = 0
        if held:
            yield send()

    def count(table: pa.Table) -> pa.Table:
        rows = [table.column(c).to_pylist() for c in ("ids", "sizes", "keys", "common")]
        out_ids, out_n = [], []
        for ids, sizes, keys, _ in zip(*rows):
            if ids and not keys:
                out_ids.append(np.frombuffer(ids, "int64"))
                out_n.append(np.frombuffer(sizes, "uint32"))
        keys = np.concatenate([np.frombuffer(k, "uint32") for k in rows[2]])
        if len(keys):
            common = np.concatenate([np.frombuffer(k, "uint32") for k in rows[3]])
            order = np.argsort(keys)
            line = keys[order]
            twice = np.zeros(len(line), bool)
            twice[1:] = line[1:] == line[:-1]
            twice[:-1] |= twice[1:].copy()
            if len(common):
                common = np.unique(common)
                twice |= common[np.minimum(np.searchsorted(common, line), len(common) - 1)] == line
            flag = np.empty(len(line), "int64")
            flag[order] = twice
            ids = np.concatenate([np.frombuffer(i, "int64") for i, k in zip(rows[0], rows[2]) if k])
            sizes = np.concatenate([np.frombuffer(s, "uint32") for s, k in zip(rows[1], rows[2]) if k]).astype("int64")
            n = np.add.reduceat(flag, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            out_ids.append(ids[n > 0])
            out_n.append(n[n > 0])
        ids = np.concatenate(out_ids) if out_ids else np.empty(0, "int64")
        n = np.concatenate(out_n).astype("int64") if out_n else np.empty(0, "int64")
        bucket = ((ids.view("uint64") * _MIX) >> np.uint64(32)) % np.uint64(buckets)
        place = np.argsort(bucket, kind="stable")
        found, starts = np.unique(bucket[place], return_index=True)
        spans = list(zip(starts, [*starts[1:], len(place)]))
        ids, n = ids[place], n[place].astype("uint32")
        return pa.table({"bucket": found.astype("int32"), "ids": pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()), "counts": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x, "int64") for x in table.column("ids").to_pylist()])
        n = np.concatenate([np.frombuffer(x, "uint32") for x in table.column("counts").to_pylist()])
        found, who = np.unique(ids, return_inverse=True)
        return pa.table({"doc_id": found, "shared": np.bincount(who, n, len(found)).astype("int64")})

    dealt = _rows(docs).mapInArrow(deal, "block int, ids binary, sizes binary, keys binary, common binary")
    packed = dealt.groupBy("block").applyInArrow(count, "bucket int, ids binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(total, "doc_id long, shared long")


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, n, keys`` for the classes of ``wanted`` (``doc_id, node``)."""

    def run(batches):
        for batch in batches:
            found = []
            for node, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                s = shingles(text)
                if xxhash.xxh3_64_intdigest(s.tobytes()) == node % 2**64:
                    found.append((node, s.view("int64")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["node", "n", "keys"]
            )

    rows = _rows(docs).join(small(wanted, 1_000_000), "doc_id").select("doc_id", "node", "text")
    return rows.mapInArrow(run, "node long, n long, keys array<long>").dropDuplicates(["node"])


def clusters(sets: DataFrame) -> DataFrame:
    """``node, cluster`` of classes that share a shingle among the rarest of both."""
    postings = sets.select("node", "n", F.explode("keys").alias("key"))
    counts = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(counts, "key").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "key"))).alias("found"))
    spare = F.size("found") - F.ceil(F.col("n") * PART / WHOLE) + 1
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(WHOLE / PART)) + 1e-9).cast("int")
    first = shared.where(spare > 0).select("node", size_class.alias("size"), F.explode(F.transform(F.slice("found", 1, spare.cast("int")), lambda x: x["key"])).alias("key"))
    first = cut(first)
    heads = cut(first.groupBy("key", "size").agg(F.min("node").alias("head"), F.count("*").alias("c")))
    edges = first.join(heads.where("c > 1"), ["key", "size"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    above = heads.select("key", (F.col("size") - 1).alias("size"), F.col("head").alias("above"))
    edges = edges.unionByName(heads.join(above, ["key", "size"]).where("head <> above").select(F.col("head").alias("a"), F.col("above").alias("b")))
    return components(edges.distinct()).select("node", F.col("label").alias("cluster"))


def forest(nodes: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> list[tuple[int, int]]:
    """A star for each group of linked classes: products of row blocks over column blocks, then merged labels.

    ``keys`` holds the sets one after another. Classes are ordered by size, so row blocks too far apart are skipped.
    """
    order = np.argsort(sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    where = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in order])
    nodes, sizes, keys = nodes[order], sizes[order], keys[where]
    owner = np.repeat(np.arange(len(nodes)), sizes)
    values, column, df = np.unique(keys, return_inverse=True, return_counts=True)
    live = df > 1
    number = np.cumsum(live) - 1
    use = live[column]
    owner, column = owner[use], number[column[use]]
    width, step, rows = int(live.sum()), 4096, 512
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def merge(left, right):
        for x, y in zip(left.tolist(), right.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)

    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    cuts = np.searchsorted(column, np.arange(0, width + step, step))
    held = np.bincount(owner, minlength=len(nodes))
    for i in range(0, len(nodes), rows):
        for j in range(i, len(nodes), rows):
            a, b = sizes[i : i + rows], sizes[j : j + rows]
            if PART * b.min() > WHOLE * a.max():
                break
            linked = np.zeros((len(a), len(b)), bool)
            x, y = np.arange(len(a)), np.arange(len(b))  # the rows of either side that may still have a partner
            overlap = np.zeros((len(a), len(b)), "float32")
            rest_a, rest_b = held[i : i + rows].copy(), held[j : j + rows].copy()
            for lo, hi, c in zip(cuts[:-1], cuts[1:], range(0, width, step)):
                who, col = owner[lo:hi], column[lo:hi] - c
                left, rest_a = _dense(who - i, col, len(a), step, x, rest_a)
                right, rest_b = _dense(who - j, col, len(b), step, y, rest_b)
                overlap += left @ right.T
                reach = overlap + np.minimum(rest_a[x][:, None], rest_b[y][None, :])
                may = (PART + WHOLE) * reach >= PART * (a[x][:, None] + b[y][None, :])
                keep_x, keep_y = may.any(1), may.any(0)
                if not (keep_x.all() and keep_y.all()):
                    x, y, overlap = x[keep_x], y[keep_y], overlap[np.ix_(keep_x, keep_y)]
                    if not len(x):
                        break
            if len(x):
                linked[np.ix_(x, y)] = (PART + WHOLE) * overlap >= PART * (a[x][:, None] + b[y][None, :])
            some = np.flatnonzero(linked.any(1))
            merge(some + i, linked[some].argmax(1) + j)  # one link of each row joins most of them
            label = np.array([root(k) for k in range(j + len(b))])
            x, y = np.nonzero(linked & (label[i : i + len(a), None] != label[None, j : j + len(b)]))
            merge(x + i, y + j)
    roots = np.array([root(k) for k in range(len(nodes))])
    out = []
    for r in np.unique(roots):
        group = nodes[roots == r]
        head = int(group.min())
        out += [(int(x), head) for x in group if x != head]
    return out


def _dense(who: np.ndarray, column: np.ndarray, n: int, step: int, keep: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``keep`` of a row block's incidence in one column block, and what the rows have left after it."""
    here = (who >= 0) & (who < n)
    who, column = who[here], column[here]
    place = np.full(n, -1)
    place[keep] = np.arange(len(keep))
    used = place[who] >= 0
    out = np.zeros((len(keep), step), "float32")
    out[place[who[used]], column[used]] = 1
    return out, rest - np.bincount(who, minlength=n)


def multiply(rows: DataFrame) -> DataFrame:
    """Links ``a, b`` inside each ``part`` of each ``unit`` of rows ``unit, part, node, n, keys``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        parts, nodes, sizes = (table.column(c).to_numpy() for c in ("part", "node", "n"))
        lists = table.column("keys").chunk(0)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        out = []
        order = np.argsort(parts, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
            if len(members) > 1:
                out += forest(nodes[members], sizes[members], np.concatenate([flat[offsets[m] : offsets[m + 1]] for m in members]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.select("unit", "part", "node", "n", "keys").groupBy("unit").applyInArrow(run, "a long, b long")


def class_links(sets: DataFrame, row_classes: int = ROW_CLASSES, row_shingles: int = ROW_SHINGLES) -> DataFrame:
    """``a, b``: edges that connect exactly the classes that links connect."""
    spark = sets.sparkSession
    members = cut(clusters(sets).join(sets, "node"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.max("n").alias("longest"))
    blocks = F.greatest(F.ceil(F.col("c") / row_classes), F.ceil(F.col("s") / row_shingles)).cast("int")
    sizes = cut(sizes.select("cluster", "s", blocks.alias("blocks")))
    total = sizes.agg(F.sum(F.when(F.col("blocks") == 1, F.col("s"))).alias("s"), F.max("blocks").alias("most")).first()
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["s"] or 0) // row_shingles))
    members = members.join(sizes.drop("s"), "cluster")
    unit = F.pmod(F.xxhash64("cluster"), F.lit(units))
    links = multiply(members.where("blocks = 1").select(unit.alias("unit"), F.col("cluster").alias("part"), "node", "n", "keys"))
    if (total["most"] or 1) == 1:
        return links
    # Clusters of several blocks: a star of blocks first.
    large = cut(members.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    others = F.when(F.col("block") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("block"))
    star = cut(multiply(_paired(large.withColumn("with", F.explode(others)), "star")))
    labels = components(star)
    placed = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = placed.groupBy("cluster", "label").agg(F.count("*").alias("c"))
    main = groups.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    placed = cut(placed.join(main, "cluster"))
    rest = placed.where("label <> main")
    share = rest.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    share = share.select("cluster", F.greatest(F.ceil(F.col("c") / row_classes), F.ceil(F.col("s") / row_shingles)).cast("int").alias("turns"))
    # Then each block of classes outside the main component against every block.
    left = rest.join(share, "cluster").withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = placed.join(share, "cluster").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("with", F.col("block"))
    both = left.select("cluster", "with", "turn", "node", "n", "keys").unionByName(right.select("cluster", "with", "turn", "node", "n", "keys")).dropDuplicates(["cluster", "with", "turn", "node"])
    cross = multiply(_paired(both.withColumn("with", F.struct("with", "turn")), "cross"))
    return links.unionByName(star).unionByName(cross)


def _paired(rows: DataFrame, kind: str) -> DataFrame:
    key = F.xxhash64(F.lit(kind), "cluster", "with")
    return rows.select(key.alias("unit"), F.lit(0).cast("long").alias("part"), "node", "n", "keys")


def _components(docs: DataFrame, row_classes: int = ROW_CLASSES, row_shingles: int = ROW_SHINGLES) -> DataFrame:
    """``doc_id, of_text, n, label`` of every row: the label is that of its component, null for an empty set."""
    spark = docs.sparkSession
    rows = cut(document_sets(docs))
    total = rows.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = shared_counts(docs, max(parts, -(-(total["n"] or 0) // COLUMNS)), max(parts, -(-total["rows"] // BUCKET)))
    wanted = rows.where("n > 1").join(shared, "doc_id").where(F.col("shared") >= F.ceil(F.col("n") * PART / WHOLE))
    sets = cut(class_sets(docs, wanted.groupBy("node").agg(F.min("doc_id").alias("doc_id"))))
    labels = components(class_links(sets, row_classes, row_shingles))
    return rows.join(labels, "node", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "node")))


def near_components(docs: DataFrame, row_classes: int = ROW_CLASSES, row_shingles: int = ROW_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows = _components(docs, row_classes, row_shingles)
    heads = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = rows.where("n > 0").join(heads, "label").unionByName(rows.where("n = 0").withColumn("component_id", F.col("doc_id")))
    plain = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(plain("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), plain("component_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; rows with empty sets all stay.

    Of rows with equal id and text any one stays; of rows with equal id in one component, the one of the smallest text hash.
    """
    rows = cut(_components(docs))
    heads = cut(rows.where("n > 0").groupBy("label").agg(F.min(F.struct("doc_id", "of_text")).alias("x")).select("x.*"))
    stay = heads.unionByName(rows.where("n = 0").select("doc_id", "of_text").distinct())
    stay = stay.select(F.col("doc_id").alias("__near_id"), F.col("of_text").alias("__near_text"))
    keyed = docs.withColumn("__near_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("__near_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(stay, ["__near_id", "__near_text"], "left_semi")
    repeated = rows.where("n > 0").groupBy("doc_id", "of_text").count().where("count > 1").join(heads, ["doc_id", "of_text"], "left_semi")
    if not repeated.isEmpty():  # a head that stands in several rows
        full = kept.where(_has_words()).dropDuplicates(["__near_id", "__near_text"])
        kept = full.unionByName(kept.where(~_has_words()))
    return kept.select(*docs.columns)


def _has_words():
    return F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t-\\r]")


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS keys FROM d),
     p AS (SELECT doc_id, len(keys) AS n, hash(unnest(keys)) AS key FROM s),
     k AS (SELECT key FROM p GROUP BY key HAVING count(*) > 1),
     q AS MATERIALIZED (SELECT p.* FROM p SEMI JOIN k USING (key)),
     e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM q a JOIN q b ON a.key = b.key AND a.doc_id <> b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
           GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
     r AS (SELECT doc_id, doc_id AS x FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.x = e.a)
SELECT s.doc_id, len(keys)::BIGINT AS n_shingles, c.x AS component_id FROM s JOIN (SELECT doc_id, min(x) AS x FROM r GROUP BY doc_id) c USING (doc_id)
"""
