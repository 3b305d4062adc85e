"""Exact top-k inner products by dual cover trees.

Vectors become integers, floor(256 * component). Data and queries each form a cover tree of two parts. Its upper part is
built level by level with joins: a cell of more than a block of points is split by a farthest-first net of at most
``CELLS`` centres, drawn from at most ``SAMPLE`` of its own vectors, and every vector goes to its nearest centre; cells so
grow in number with the data, and what is still too large after ``LEVELS`` levels is dealt by hash. Its lower part is one
tree for each block: a node's children are a net of its points at half its radius, and a node whose net would be nearly
all of its points is a leaf. Every vector is indexed; samples set centres alone.

A node pair is pruned when ``c·p + R|p| + r|c| + Rr`` (centres c, p; radii R, r), which no pair below can pass, stays under
the worst kth score in the query node. Worst scores start from the data blocks nearest to the upper nodes of each query
block. Then the bound is taken between these nodes and the first level of cells, between them and the blocks of the cells
that are left, and inside the pairs of blocks that are left; a query block meets them ``TOGETHER`` at a time, best bound
first, and carries its worst scores from one to the next. Nothing but the first level of cells (at most ``CELLS`` rows)
reaches the driver.

Equal vectors are one point that carries its smallest k + 1 ids, all that a top k can need, so a vector of very many rows is
one point. Vectors null, or holding null or non-finite components, and rows without id take no part. Repeated rows count
once. Rows of one id never answer that id. Vectors of different length meet over the components both have. Scores are exact
while they fit 64 bits. Extra columns stay behind.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.llm.common import cut, small

SCALE = 256
#: Vectors that set the centres of a cell's split, the most cells it becomes, and how often cells are split.
SAMPLE, CELLS, LEVELS = 2048, 64, 6
#: Points of a block of data or queries, and of a leaf; points that one task places at once.
DATA_BLOCK, QUERY_BLOCK, LEAF, PLACED = 1024, 1024, 24, 8192
#: Upper nodes that stand for a query block, data blocks it meets in one task, and parts a cell's blocks are dealt to.
NODES, TOGETHER, PARTS = 8, 4, 16
LOWEST = -(2**63)

_TREE = "points binary, kind string, width int, ids binary, id_counts binary, spans binary, radii binary"
_TREE_COLUMNS = [f.split()[0] for f in _TREE.split(", ")]


def integer_vectors(rows: DataFrame) -> DataFrame:
    """Distinct ``vec_id, v`` of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    taken = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return taken.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v")).distinct()


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), "int64")
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(1))


def net(points: np.ndarray, reach: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first centres until all points are within ``reach`` of one or ``most`` are taken; owner and distance of each."""
    centres, owner, near = [0], np.zeros(len(points), "int64"), _distance(points, points[0])
    while near.max() > reach and len(centres) < most:
        far = int(near.argmax())
        d = _distance(points, points[far])
        closer = d < near
        owner[closer] = len(centres)
        near[closer] = d[closer]
        centres.append(far)
    return centres, owner, near


class Tree:
    """A cover tree over integer points; each node is a span of them, its centre the span's first."""

    def __init__(self, points, ids, id_counts, spans, radii):
        self.points, self.ids, self.id_counts, self.radii = points, ids, id_counts, radii
        self.lo, self.hi, self.first, self.children = spans.T
        self.id_ends = np.cumsum(id_counts)
        self.centres = points[self.lo].astype("float64")
        self.norms = np.sqrt((self.centres**2).sum(1))

    @classmethod
    def build(cls, points: np.ndarray, ids: list[list[int]]) -> Tree:
        order = np.arange(len(points))
        real = points.astype("float64")
        spans, radii = [[0, len(points), 0, 0]], [float(_distance(real, real[0]).max())]
        at = 0
        while at < len(spans):
            lo, hi, _, _ = spans[at]
            n = hi - lo
            if n > LEAF and radii[at] > 0:
                centres, owner, near = net(real[order[lo:hi]], radii[at] / 2, n // 4)
                if near.max() <= radii[at] / 2:
                    spans[at][2:] = len(spans), len(centres)
                    members = order[lo:hi].copy()
                    start = lo
                    for k, centre in enumerate(centres):
                        mine = np.flatnonzero(owner == k)
                        mine = np.concatenate([[centre], mine[mine != centre]])
                        order[start : start + len(mine)] = members[mine]
                        spans.append([start, start + len(mine), 0, 0])
                        radii.append(float(near[mine].max()))
                        start += len(mine)
            at += 1
        counts = np.array([len(ids[k]) for k in order], "int32")
        return cls(points[order], np.array([x for k in order for x in ids[k]], "int64"), counts, np.array(spans, "int32"), np.array(radii))

    def upper(self, most: int) -> list[int]:
        """At most ``most`` nodes that hold all points: the widest ones are opened first."""
        held, closed = [0], []
        while held:
            node = max(held, key=self.radii.__getitem__)
            held.remove(node)
            if self.children[node] and len(held) + len(closed) + self.children[node] <= most:
                held += range(self.first[node], self.first[node] + self.children[node])
            else:
                closed.append(node)
        return sorted(closed)

    def packed(self) -> tuple:
        most = int(np.abs(self.points).max(initial=0))
        kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "int64"
        spans = np.stack([self.lo, self.hi, self.first, self.children], 1).astype("int32")
        return self.points.astype(kind).tobytes(), kind, self.points.shape[1], self.ids.tobytes(), self.id_counts.tobytes(), spans.tobytes(), self.radii.tobytes()

    @classmethod
    def unpacked(cls, points, kind, width, ids, id_counts, spans, radii) -> Tree:
        spans = np.frombuffer(spans, "int32").reshape(-1, 4)
        counts = np.frombuffer(id_counts, "int32")
        return cls(np.frombuffer(points, kind).reshape(len(counts), width).astype("int64"), np.frombuffer(ids, "int64"), counts, spans, np.frombuffer(radii, "float64"))


@lru_cache(maxsize=8)
def _unpacked(*columns) -> Tree:
    return Tree.unpacked(*columns)


def scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where all sums fit its 53 bits."""
    width = min(queries.shape[1], points.shape[1])
    queries, points = queries[:, :width], points[:, :width]
    if width * float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) < 2**53:
        return (queries.astype("float64") @ points.astype("float64").T).astype("int64")
    return queries @ points.T


class Search:
    """The best ``k`` answers of every point of a query tree, over the data trees met so far."""

    def __init__(self, queries: Tree, k: int, worst: np.ndarray):
        self.queries, self.k, self.worst = queries, k, worst.copy()
        self.q, self.score, self.id = (np.empty(0, "int64") for _ in range(3))

    def meet(self, data: Tree) -> None:
        """Visit node pairs, best bound first."""
        mine = self.queries
        width = min(mine.centres.shape[1], data.centres.shape[1])

        def bounds(a, b):
            inner = mine.centres[a][:, :width] @ data.centres[b][:, :width].T
            return inner + np.outer(mine.radii[a], data.norms[b] + data.radii[b]) + np.outer(mine.norms[a], data.radii[b])

        stack = [(float(bounds(np.array([0]), np.array([0]))[0, 0]), 0, 0)]
        while stack:
            bound, a, b = stack.pop()
            if self._hopeless(bound, a):
                continue
            a_leaf, b_leaf = not mine.children[a], not data.children[b]
            if a_leaf and b_leaf:
                self._leaves(data, a, b)
                continue
            if b_leaf or (not a_leaf and mine.radii[a] > data.radii[b]):
                left, right = np.arange(mine.first[a], mine.first[a] + mine.children[a]), np.array([b])
            else:
                left, right = np.array([a]), np.arange(data.first[b], data.first[b] + data.children[b])
            found = bounds(left, right).ravel()
            pairs = [(x, y) for x in left.tolist() for y in right.tolist()]
            stack += [(float(found[i]), *pairs[i]) for i in np.argsort(found, kind="stable")]

    def _hopeless(self, bound: float, a: int) -> bool:
        worst = int(self.worst[self.queries.lo[a] : self.queries.hi[a]].min())
        return bound + 1e-6 * abs(bound) + 1e-3 < worst

    def _leaves(self, data: Tree, a: int, b: int) -> None:
        lo, hi = int(self.queries.lo[a]), int(self.queries.hi[a])
        first, end = int(data.lo[b]), int(data.hi[b])
        found = scores(self.queries.points[lo:hi], data.points[first:end])
        least = self.worst[lo:hi]
        if end - first > self.k:
            least = np.maximum(least, np.partition(found, -self.k, axis=1)[:, -self.k])
        q, p = np.nonzero(found >= least[:, None])
        value, p = found[q, p], p + first
        copies = data.id_counts[p].astype("int64")
        which = np.repeat(data.id_ends[p] - copies, copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        self.q = np.concatenate([self.q, np.repeat(q + lo, copies)])
        self.score = np.concatenate([self.score, np.repeat(value, copies)])
        self.id = np.concatenate([self.id, data.ids[which]])
        self._trim()

    def _trim(self) -> None:
        order = np.lexsort((self.id, -self.score, self.q))
        q = self.q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.q, self.score, self.id = self.q[order], self.score[order], self.id[order]
        full = rank == self.k - 1
        self.worst[self.q[full]] = np.maximum(self.worst[self.q[full]], self.score[full])


def in_cells(points: DataFrame, block: int) -> DataFrame:
    """Appends ``top`` and ``cell``, the cells of the first and of the last level, to ``v, ids``; cells of at most ``block`` points stay whole."""
    done, placed = [], points.select("v", "ids").withColumns({"top": F.lit(0), "cell": F.lit(0).cast("long")})
    total = placed.count()
    if total > block:
        placed = cut(_split(placed.withColumn("count", F.lit(total)), block, True))
        for _ in range(1, LEVELS):
            wide = cut(placed.groupBy("cell").count().where(F.col("count") > block))
            if wide.isEmpty():
                break
            marked = placed.join(small(wide), "cell", "left").select(*placed.columns, "count")
            done.append(marked.where(F.col("count").isNull()).drop("count"))
            placed = cut(_split(marked.where(F.col("count").isNotNull()), block, False))
    for d in done:
        placed = placed.unionByName(d)
    return placed


def _split(wide: DataFrame, block: int, first: bool) -> DataFrame:
    """The points of cells that are too large, in the cells of the next level."""
    most = CELLS

    def choose(table: pa.Table) -> pa.Table:
        vectors, count = table.column("v").to_pylist(), table.column("count")[0].as_py()
        points = np.unique(_matrix(vectors, max(1, max(map(len, vectors)))), axis=0)
        centres = points[net(points.astype("float64"), 0.0, min(most, -(-2 * count // block)))[0]].tolist()
        n = len(centres)
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * n, pa.int64()), "count": pa.array([count] * n, pa.int64()), "child": pa.array(range(n), pa.int32()), "centre": pa.array(centres, pa.list_(pa.int64()))})

    def place(points: pa.Table, centres: pa.Table) -> pa.Table:
        points = points.drop_columns(["count", "piece"]).cast(shape)
        if not len(points):
            return points
        to = centres.column("centre").to_pylist()
        width = max(map(len, to))
        real = _matrix(to, width).astype("float64")
        near = ((real**2).sum(1) - 2 * _matrix([v[:width] for v in points.column("v").to_pylist()], width).astype("float64") @ real.T).argmin(1)
        child = np.array(centres.column("child").to_pylist(), "int64")[near]
        cell = np.array(points.column("cell").to_pylist(), "int64") * (most + 1) + child + 1
        points = points.set_column(points.schema.get_field_index("cell"), "cell", pa.array(cell))
        return points.set_column(points.schema.get_field_index("top"), "top", pa.array(child.astype("int32"))) if first else points

    drawn = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 31)) < 2.0 * SAMPLE * (1 << 31) / F.col("count")
    place_in_cell = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("v"), "v"))
    sample = wide.where(drawn).select("cell", "count", "v", place_in_cell.alias("n")).where(F.col("n") <= SAMPLE).drop("n")
    centres = cut(sample.groupBy("cell").applyInArrow(choose, "cell long, count long, child int, centre array<long>"))
    pieces = F.ceil(F.col("count") / PLACED)
    here = wide.withColumn("piece", F.pmod(F.xxhash64("v", F.lit(2)), pieces))
    there = centres.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    longs = pa.list_(pa.int64())
    shape = pa.schema([("v", longs), ("ids", longs), ("top", pa.int32()), ("cell", pa.int64())])
    return here.groupBy("cell", "piece").cogroup(there.groupBy("cell", "piece")).applyInArrow(place, "v array<long>, ids array<long>, top int, cell long")


def trees(placed: DataFrame, block: int) -> DataFrame:
    """One row for each block of at most about ``block`` points of a cell: ``cell`` (of the first level), ``block, centre, radius`` and the packed tree."""
    wide = small(placed.groupBy("cell").count().where(F.col("count") > block))
    sized = placed.withColumn("count", F.lit(block)) if wide.isEmpty() else placed.join(wide, "cell", "left")
    parts = F.coalesce(F.ceil(F.col("count") / block), F.lit(1))
    number = F.col("cell") * (1 << 20) + F.pmod(F.xxhash64("v", F.lit(3)), parts)
    dealt = sized.select(F.col("top").alias("cell"), number.alias("block"), "v", "ids")

    def run(table: pa.Table) -> pa.Table:
        vectors = table.column("v").to_pylist()
        tree = Tree.build(_matrix(vectors, max(1, max(map(len, vectors)))), table.column("ids").to_pylist())
        row = [table.column("cell")[0].as_py(), table.column("block")[0].as_py(), tree.centres[0].tolist(), float(tree.radii[0]), *tree.packed()]
        return pa.table({c: [x] for c, x in zip(["cell", "block", "centre", "radius", *_TREE_COLUMNS], row)}, schema=schema)

    schema = pa.schema(
        [("cell", pa.int32()), ("block", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("points", pa.binary()), ("kind", pa.string()), ("width", pa.int32()),
         *((c, pa.binary()) for c in ("ids", "id_counts", "spans", "radii"))]
    )
    return dealt.groupBy("cell", "block").applyInArrow(run, f"cell int, block long, centre array<double>, radius double, {_TREE}")


def _tree(row: dict) -> Tree:
    return _unpacked(*(row[c] for c in _TREE_COLUMNS))


def meet(queries: DataFrame, pairs: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Search query blocks against the data blocks of the same ``q_block, part`` in ``pairs``, best ``bound`` first.

    ``queries`` has ``q_block``, a packed tree and ``worst``, the kth scores reached so far (null: none). A row for each
    block and part: ``q_block, worst`` and the answers ``q, id, score``, by name of the query point.
    """
    asked = pairs.select("q_block", "part").distinct().join(queries.select("q_block", "worst", *_TREE_COLUMNS), "q_block")
    asked = asked.select(F.col("q_block").alias("block"), F.col("part").alias("turn"), F.struct("worst", *_TREE_COLUMNS).alias("tree"))
    given = pairs.join(data.select(F.col("block").alias("d_block"), *_TREE_COLUMNS), "d_block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (mine,) = left.column("tree").to_pylist()
        own = _tree(mine)
        search = Search(own, k, np.array(mine["worst"], "int64") if mine["worst"] is not None else np.full(len(own.points), LOWEST))
        for row in sorted(right.to_pylist(), key=lambda r: -r["bound"]):
            search.meet(_tree(row))
        names = own.ids[own.id_ends[search.q] - own.id_counts[search.q]] if len(search.q) else search.q
        return pa.table({"q_block": [left.column("block")[0].as_py()], "worst": [search.worst.tolist()], "q": [names.tolist()], "id": [search.id.tolist()], "score": [search.score.tolist()]}, schema=schema)

    longs = pa.list_(pa.int64())
    schema = pa.schema([("q_block", pa.int64()), ("worst", longs), ("q", longs), ("id", longs), ("score", longs)])
    fields = "q_block long, worst array<long>, q array<long>, id array<long>, score array<long>"
    return asked.groupBy("block", "turn").cogroup(given.groupBy("q_block", "part")).applyInArrow(run, fields)


def _wide(vectors: list, width: int = 1) -> np.ndarray:
    out = np.zeros((len(vectors), max(width, *map(len, vectors))))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _bounds(centres: np.ndarray, radii: np.ndarray, to: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """What no pair from a ball of the one and a ball of the other can pass."""
    shared = min(centres.shape[1], to.shape[1])
    norms, far = np.sqrt((centres**2).sum(1)), np.sqrt((to**2).sum(1))
    return centres[:, :shared] @ to[:, :shared].T + np.outer(radii, far + reach) + np.outer(norms, reach)


def _left(bounds: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which of the columns some row's worst score leaves."""
    return (bounds + 1e-6 * np.abs(bounds) + 1e-3 >= least[:, None]).any(0)


def _balls(data: DataFrame) -> DataFrame:
    """Balls of the data blocks, each cell's dealt to ``PARTS`` parts so that no cell is one key."""
    return data.select("cell", F.pmod(F.xxhash64("block"), F.lit(PARTS)).alias("salt"), F.col("block").alias("d_block"), F.col("centre").alias("d_centre"), F.col("radius").alias("d_radius"))


def _every_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.array(*(F.lit(n).cast("long") for n in range(PARTS)))))


def first_pairs(queries: DataFrame, data: DataFrame, cells: list) -> DataFrame:
    """For each upper node of each query block, the data block whose centre scores best, from the cell whose centre does."""
    tops, names, most = _wide([c["centre"] for c in cells]), [c["cell"] for c in cells], NODES

    def nodes(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tree = _tree(r)
                upper = tree.upper(most)
                shared = min(tops.shape[1], tree.centres.shape[1])
                best = (tree.centres[upper][:, :shared] @ tops[:, :shared].T).argmax(1)
                yield pa.RecordBatch.from_pydict({"q_block": pa.array([r["q_block"]] * len(upper), pa.int64()), "node": pa.array(upper, pa.int32()), "q_centre": pa.array(tree.centres[upper].tolist(), pa.list_(pa.float64())), "cell": pa.array([names[b] for b in best], pa.int32())})

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (_wide(batch.column(c).to_pylist()) for c in ("q_centre", "d_centre"))
                shared = min(a.shape[1], b.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("q_block"), batch.column("node"), pa.array((a[:, :shared] * b[:, :shared]).sum(1)), batch.column("d_block")], ["q_block", "node", "bound", "d_block"])

    upper = queries.select("q_block", *_TREE_COLUMNS).mapInArrow(nodes, "q_block long, node int, q_centre array<double>, cell int")
    met = _every_salt(upper).join(_balls(data), ["cell", "salt"]).select("q_block", "node", "q_centre", "d_block", "d_centre")
    best = met.mapInArrow(score, "q_block long, node int, bound double, d_block long").groupBy("q_block", "node").agg(F.max(F.struct("bound", "d_block")).alias("x"))
    return best.groupBy("q_block", F.col("x.d_block").alias("d_block")).agg(F.max("x.bound").alias("bound")).withColumn("part", F.lit(0).cast("long"))


def other_pairs(queries: DataFrame, data: DataFrame, cells: list, met: DataFrame) -> DataFrame:
    """``q_block, d_block, bound, part`` of the blocks that the worst scores leave, first between nodes and cells, then between nodes and blocks; pairs of ``met`` aside."""
    tops, reach, names, most = _wide([c["centre"] for c in cells]), np.array([c["reach"] for c in cells]), [c["cell"] for c in cells], NODES

    def hopeful_cells(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tree = _tree(r)
                upper = tree.upper(most)
                worst = np.array(r["worst"], "int64")
                least = np.array([worst[tree.lo[n] : tree.hi[n]].min() for n in upper], "float64")
                left = np.flatnonzero(_left(_bounds(tree.centres[upper], tree.radii[upper], tops, reach), least))
                n = len(left)
                small_ = {c: pa.array([x.tobytes()] * n, pa.binary()) for c, x in (("centres", tree.centres[upper]), ("radii", tree.radii[upper]), ("least", least))}
                yield pa.RecordBatch.from_pydict({"q_block": pa.array([r["q_block"]] * n, pa.int64()), "cell": pa.array([names[c] for c in left], pa.int32()), **small_})

    def hopeful_blocks(batches):
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):  # rows of one query block in a run are taken together
                end = at + 1
                while end < len(rows) and rows[end]["q_block"] == rows[at]["q_block"]:
                    end += 1
                run, r = rows[at:end], rows[at]
                radii, least = np.frombuffer(r["radii"]), np.frombuffer(r["least"])
                bounds = _bounds(np.frombuffer(r["centres"]).reshape(len(radii), -1), radii, _wide([x["d_centre"] for x in run]), np.array([x["d_radius"] for x in run]))
                left = np.flatnonzero(_left(bounds, least))
                yield pa.RecordBatch.from_pydict({"q_block": pa.array([r["q_block"]] * len(left), pa.int64()), "d_block": pa.array([run[x]["d_block"] for x in left], pa.int64()), "bound": pa.array(bounds.max(0)[left])})
                at = end

    cells_left = queries.select("q_block", "worst", *_TREE_COLUMNS).mapInArrow(hopeful_cells, "q_block long, cell int, centres binary, radii binary, least binary")
    near = _every_salt(cells_left).join(_balls(data), ["cell", "salt"]).select("q_block", "centres", "radii", "least", "d_block", "d_centre", "d_radius")
    found = near.mapInArrow(hopeful_blocks, "q_block long, d_block long, bound double").join(met.select("q_block", "d_block"), ["q_block", "d_block"], "left_anti")
    found = cut(found)
    parts = found.groupBy("q_block").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    return found.join(parts, "q_block").select("q_block", "d_block", "bound", F.pmod(F.xxhash64("d_block"), F.col("parts")).alias("part"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best vectors of every query, both given as ``vec_id, embedding``."""
    data, asked = cut(integer_vectors(vectors)), cut(integer_vectors(queries))
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = cut(data.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    # A query point's name is its number; repeated ids with different vectors are different points.
    points = cut(asked.groupBy("v").agg(F.min("vec_id").alias("least")).withColumn("name", F.xxhash64("v", "least")))
    if data.isEmpty():
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    indexed = cut(trees(in_cells(classes, DATA_BLOCK), DATA_BLOCK))
    blocks = cut(trees(in_cells(points.select("v", F.array("name").alias("ids")), QUERY_BLOCK), QUERY_BLOCK).withColumnRenamed("block", "q_block"))
    cells = cell_summaries(indexed).orderBy("cell").collect()

    near = cut(first_pairs(blocks, indexed, cells))
    seeded = cut(meet(blocks.withColumn("worst", F.lit(None).cast("array<long>")), near, indexed, k + 1))
    started = blocks.join(seeded.select("q_block", "worst"), "q_block")
    rest = meet(started, cut(other_pairs(started, indexed, cells, near)), indexed, k + 1)
    answers = seeded.select("q", "id", "score").unionByName(rest.select("q", "id", "score"))

    flat = answers.select(F.explode(F.arrays_zip("q", "id", "score")).alias("x")).select(F.col("x.q").alias("name"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
    best = flat.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    best = best.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    named = asked.join(points.select("v", "name"), "v").select("name", F.col("vec_id").alias("query_id"))
    out = named.join(best, "name").select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def cell_summaries(indexed: DataFrame) -> DataFrame:
    """``cell, blocks, centre, reach``: of each cell its number of blocks and a ball that holds the ball of every block.

    The centre is that of the cell's lowest block, whatever the order of rows; it is written once, and the reach is taken
    from what was written.
    """
    found = cut(indexed.groupBy("cell").agg((F.max("block") + 1).alias("blocks"), F.min_by("centre", "block").alias("centre")))
    gaps = F.sqrt(F.aggregate(F.zip_with("centre", "c", _gap), F.lit(0.0), lambda a, x: a + x))
    reach = indexed.select("cell", "centre", "radius").join(found.select("cell", F.col("centre").alias("c")), "cell").groupBy("cell").agg(F.max(gaps + F.col("radius")).alias("reach"))
    return found.join(reach, "cell").select("cell", "blocks", "centre", "reach")


def _gap(x, y):
    gap = F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))
    return gap * gap


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v, p.v)::BIGINT AS score FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
