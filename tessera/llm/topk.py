"""Operator 7, exact top-k search with a KD-tree in each shard.

The queries are the vectors whose id is divisible by `every` (all of them by default); all vectors are searched.

Vectors go to shards along a small KD-tree over a sample (median splits), so that a shard is a
region.  In a shard a KD-tree is built with median splits on the widest side, each node with
its tight bounding box.  Queries, a leaf of them at a time, traverse a tree best-first: the
node with the least box-to-query distance next, until that is more than the kth distance found.
A query searches its own shard first.  Then come rounds: its kth distance so far is propagated to the
shards whose boxes lie nearest to it, FIRST_VISITS of them and twice as many in each further
round, as far as their boxes lie within that distance; what they find tightens it for the next
round, and a query that no box is within is done.  Results are merged by (distance, id).  Nothing is approximate: boxes are compared with a slack for rounding, and
distances are summed from differences in double precision.

Results: (vec_id, rank, neighbor_id, distance), Euclidean, ranks from 1; ties by lower id.

* Without an id divisible by `every` the result is empty.
* Rows without id or vector, with a null or non-finite element, or of another length than most
  rows have, are neither queries nor neighbours.
* Several rows with the same id count as one, with the least of their vectors.
* A vector isn't its own neighbour; another id with an equal vector is one, at distance 0.
* With fewer than k others all of them are returned.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

LEAF = 256
#: Vectors of a shard, until there are MOST_SHARDS of them; then shards grow.
SHARD_ROWS, MOST_SHARDS = 8192, 16384
#: Shards that a query visits in the first round after its own.
FIRST_VISITS = 2
#: Queries that one task of the second round holds.
QUERY_ROWS = 32768
#: Vectors that the upper tree is made of, and at least so many for each shard.
SAMPLE, SAMPLE_SHARD = 16384, 8
SLACK = 1e-9


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray | None = None
    left: "Node | None" = None
    right: "Node | None" = None


def build(points: np.ndarray, leaf: int = LEAF) -> Node | None:
    """Median splits on the widest side of the tight box.  Equal points can't be split and stay together."""
    if not len(points):
        return None

    def make(rows: np.ndarray) -> Node:
        part = points[rows]
        node = Node(part.min(0), part.max(0))
        side = int(np.argmax(node.high - node.low))
        if len(rows) <= leaf or node.high[side] == node.low[side]:
            node.rows = rows
            return node
        order = np.argsort(part[:, side], kind="stable")
        half = len(rows) // 2
        node.left, node.right = make(rows[order[:half]]), make(rows[order[half:]])
        return node

    return make(np.arange(len(points)))


def leaves(node: Node | None) -> Iterator[Node]:
    stack = [node] if node else []
    while stack:
        n = stack.pop()
        if n.rows is not None:
            yield n
        else:
            stack += [n.right, n.left]


def bounds(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of each query to the box."""
    d = np.maximum(np.maximum(low - q, q - high), 0.0)
    return np.einsum("ij,ij->i", d, d)


class Best:
    """The k nearest so far of a block of queries; `worst` is each one's kth squared distance."""

    def __init__(self, n: int, k: int, bound: np.ndarray | None = None):
        self.k = k
        self.dist, self.ids = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        self.bound = np.full(n, np.inf) if bound is None else bound

    @property
    def worst(self) -> np.ndarray:
        return np.minimum(self.dist[:, -1], self.bound)

    def add(self, rows: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        touched, back = np.unique(rows, return_inverse=True)
        r = np.concatenate([np.repeat(np.arange(len(touched)), self.k), back])
        d = np.concatenate([self.dist[touched].ravel(), dist])
        i = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((i, d, r))
        r, d, i = r[order], d[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, np.arange(len(touched)))[r]
        keep = place < self.k
        self.dist[touched] = d[keep].reshape(-1, self.k)
        self.ids[touched] = i[keep].reshape(-1, self.k)


def search(root: Node, points: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, best: Best) -> None:
    """Best-first traversal of one tree by a block of queries; `best` is improved."""
    squares = np.einsum("ij,ij->i", points, points)
    q_squares = np.einsum("ij,ij->i", q, q)
    slack = lambda w: w * (1 + SLACK) + SLACK
    first = bounds(root.low, root.high, q)
    heap: list = [(float(first.min()), 0, root, first)]
    pushed = 0
    while heap:
        least, _, node, bound = heapq.heappop(heap)
        limit = slack(best.worst)
        if least > limit.max():
            break
        active = np.flatnonzero(bound <= limit)
        if not len(active):
            continue
        if node.rows is None:
            for child in (node.left, node.right):
                b = np.full(len(q), np.inf)
                b[active] = bounds(child.low, child.high, q[active])
                pushed += 1
                heapq.heappush(heap, (float(b.min()), pushed, child, b))
            continue
        for s in range(0, len(node.rows), LEAF):  # a leaf of equal points may be long
            rows = node.rows[s : s + LEAF]
            near = q_squares[active, None] + squares[rows] - 2 * (q[active] @ points[rows].T)
            i, j = np.nonzero(near <= slack(best.worst)[active, None] + 1e-7 * (q_squares[active, None] + squares[rows]))
            i, j = active[i], rows[j]
            other = q_ids[i] != ids[j]
            i, j = i[other], j[other]
            if len(i):
                diff = q[i] - points[j]
                best.add(i, np.einsum("ij,ij->i", diff, diff), ids[j])


class Splitter:
    """The upper KD-tree: which shard a vector belongs to."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.depth = max(0, math.ceil(math.log2(max(1, shards))))
        self.side = np.zeros(1 << self.depth, np.int64)
        self.value = np.full(1 << self.depth, np.inf)

        def cut(rows: np.ndarray, node: int, level: int) -> None:
            if level == self.depth or not len(rows):
                return
            part = sample[rows]
            self.side[node] = side = int(np.argmax(part.var(0)))
            self.value[node] = value = float(np.median(part[:, side]))
            below = part[:, side] < value
            cut(rows[below], 2 * node, level + 1)
            cut(rows[~below], 2 * node + 1, level + 1)

        if len(sample):
            cut(np.arange(len(sample)), 1, 0)

    def shard(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.side[node]] >= self.value[node])
        return node - (1 << self.depth)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _found(q_ids: np.ndarray, best: Best) -> pa.Table:
    keep = np.isfinite(best.dist)
    n = keep.sum(1)
    return pa.table({"vec_id": np.repeat(q_ids, n), "neighbor_id": best.ids[keep], "d2": best.dist[keep]})


def top_k(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance) of the k nearest others of every vector whose id is divisible by `every`."""
    spark = vectors.sparkSession
    out = "vec_id long, rank int, neighbor_id long, distance double"
    # Single precision is shuffled as such; distances are always computed in double.
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    raw = raw.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    sizes = raw.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], out)
    dim = sizes["n"]
    clean = raw.where(F.size("x") == dim).groupBy("vec_id").agg(F.min("x").alias("x"))
    wanted = min(MOST_SHARDS, math.ceil(sizes["count"] / shard_rows))
    drawn = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, SAMPLE_SHARD * wanted))
    splitter = Splitter(matrix(pa.array([r["x"] for r in drawn.collect()], pa.list_(pa.float64())), dim), wanted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("shard", pa.array(splitter.shard(matrix(b.column("x"), dim)).astype(np.int32)))

    placed = materialise(clean.mapInArrow(place, f"vec_id long, x {kind}, shard int"), "vectors")

    nothing = pa.table({"vec_id": pa.array([], pa.int64()), "neighbor_id": pa.array([], pa.int64()), "d2": pa.array([], pa.float64())})

    def home(part: pa.Table) -> pa.Table:
        ids, points = part.column("vec_id").to_numpy(), matrix(part.column("x"), dim)
        root, tables, queries = build(points), [nothing], np.flatnonzero(ids % every == 0)
        for leaf in leaves(build(points[queries])):
            for s in range(0, len(leaf.rows), LEAF):
                rows = queries[leaf.rows[s : s + LEAF]]
                best = Best(len(rows), k)
                search(root, points, ids, points[rows], ids[rows], best)
                tables.append(_found(ids[rows], best))
        return pa.concat_tables(tables)

    def nearest(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("d2", "neighbor_id"))).where(F.col("rank") <= k)

    hits = "vec_id long, neighbor_id long, d2 double"
    near = materialise(placed.groupBy("shard").applyInArrow(home, hits), "home")
    boxes = placed.select("shard", F.posexplode("x").alias("p", "v")).groupBy("shard", "p").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # at most MOST_SHARDS times dim rows
    shards = sorted({b["shard"] for b in boxes})
    if len(shards) > 1:
        index = {s: n for n, s in enumerate(shards)}
        low, high = np.zeros((len(shards), dim)), np.zeros((len(shards), dim))
        for b in boxes:
            low[index[b["shard"]], b["p"]], high[index[b["shard"]], b["p"]] = b["lo"], b["hi"]

        def spread(first: int, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            """Each query to the first to last nearest of the other shards, as far as its kth distance reaches."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                step = max(1, (1 << 19) // len(shards))
                for b in batches:
                    for s in range(0, b.num_rows, step):
                        part = b.slice(s, step)
                        q, own = matrix(part.column("x"), dim), part.column("shard").to_numpy()
                        limit = part.column("kth").to_numpy() * (1 + SLACK) + SLACK
                        far = np.stack([bounds(low[n], high[n], q) for n in range(len(shards))], 1)
                        far[np.arange(len(own)), [index[x] for x in own.tolist()]] = np.inf
                        order = np.argsort(far, axis=1, kind="stable")[:, first:last]
                        row, rank = np.nonzero(np.take_along_axis(far, order, 1) <= np.where(np.isinf(limit), np.finfo(float).max, limit)[:, None])
                        if len(row):
                            took = part.select(["vec_id", "x", "kth"]).take(pa.array(row))
                            yield took.append_column("shard", pa.array(np.array(shards, np.int32)[order[row, rank]]))

            return run

        def visit(asking: pa.Table, held: pa.Table) -> pa.Table:
            ids, pts = held.column("vec_id").to_numpy(), matrix(held.column("x"), dim)
            q_ids, q, kth = asking.column("vec_id").to_numpy(), matrix(asking.column("x"), dim), asking.column("kth").to_numpy()
            root, tables = build(pts), [nothing]
            for leaf in leaves(build(q)) if root else ():  # queries that lie together go together
                for s in range(0, len(leaf.rows), LEAF):
                    rows = leaf.rows[s : s + LEAF]
                    best = Best(len(rows), k, kth[rows])
                    search(root, pts, ids, q[rows], q_ids[rows], best)
                    tables.append(_found(q_ids[rows], best))
            return pa.concat_tables(tables)

        first, size = 0, FIRST_VISITS
        while first < len(shards) - 1:
            kth = near.groupBy("vec_id").agg(F.max("d2").alias("d2"), F.count("*").alias("n")).select("vec_id", F.when(F.col("n") >= k, F.col("d2")).otherwise(F.lit(float("inf"))).alias("kth"))
            asked = placed.where(F.col("vec_id") % every == 0).join(kth, "vec_id", "left").select("vec_id", "x", "shard", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
            visits = materialise(asked.mapInArrow(spread(first, first + size), f"vec_id long, x {kind}, kth double, shard int"), "visits")
            counts = [(r["shard"], math.ceil(r["count"] / query_rows)) for r in visits.groupBy("shard").count().collect()]  # at most MOST_SHARDS rows
            if not counts:  # boxes come in order of distance, so no further one is within reach
                break
            parts = lambda c=counts: F.broadcast(spark.createDataFrame(c, "shard int, parts int"))
            queries = visits.join(parts(), "shard").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
            points = placed.join(parts(), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            far = queries.groupBy("shard", "part").cogroup(points.groupBy("shard", "part")).applyInArrow(visit, hits)
            near = materialise(nearest(near.unionByName(far)).select("vec_id", "neighbor_id", "d2"), "near")
            first, size = first + size, 2 * size
    return nearest(near).select("vec_id", "rank", "neighbor_id", F.round(F.sqrt("d2"), 6).alias("distance"))


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.x, b.x) AS d
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % {every} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM p
)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(d, 6) AS distance FROM r WHERE rank <= {k}
"""
