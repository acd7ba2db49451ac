"""Centroid clustering: Lloyd's rounds over two trees.

Vectors are dealt into blocks of at most ``BLOCK`` rows as they come. Each block becomes
a cover tree once, which is written and read again every round: centres of a level lie
further apart than its radius, every point lies within it of one, a centre stays one on
all levels below, and a node also knows the largest distance to a point under it. Equal
vectors are one point with several rows, so that copies cost nothing.

Every round makes such a tree of the centroids, which are few and travel with the job,
and takes both trees down together: a node of vectors is held against the nodes of
centroids that are left for it, and a pair goes whose least distance is above the
smallest of the node's greatest ones. A node with one centroid left is assigned whole,
its sum taken from prefix sums; leaves with several left are compared exactly, in
integers. Each task gives one row for each number of its sums, which are added up by
(cluster, dimension), and the driver gets k x (d + 1) numbers.

Defined results: vectors that are null, of another length, or hold a null or non-finite
entry take no part. Of fewer vectors than centroids every one starts one. A null id
hashes as nothing and starts a centroid only where ids are too few. Vectors with one id
start centroids in the order of their entries. Ties go to the smaller number. Repeated
rows come back as often as they came. An empty table gives an empty result. Further
columns are not read. Components so large (of 64: above 2^27) that a squared distance may
not fit a long raise an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, quoted, table

DIM, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Most rows of a block.
BLOCK = 2048
#: Bounds are rounded; a pair goes only if it is farther by more than this share.
SLACK = 1e-9


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two integer matrices, row by row, exact."""
    d = a - b
    return (d * d).sum(axis=1)


def all_squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows: as a product while that is exact in doubles."""
    if x.shape[1] * 4 * int(np.abs(x).max(initial=0)) ** 2 < 1 << 53:
        y = x.astype(np.float64)
        norm = (y * y).sum(axis=1)
        return norm[:, None] + norm[None, :] - 2 * (y @ y.T)
    return np.stack([squares(x, row).astype(np.float64) for row in x])


class CoverTree:
    """Over distinct integer points. Points are put in the order of a walk of the tree,
    so that a node is the points from ``low`` up to ``high``, the first its own one;
    children of a node follow one another."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        apart = np.sqrt(all_squares(points))
        point, children = [0], [np.empty(0, np.int64)]
        node_of = np.zeros(n, np.int64)  # the lowest node so far of which a point is the centre
        centres = np.zeros(1, np.int64)
        radius = 2.0 ** np.ceil(np.log2(max(apart[0].max(initial=0), 1)))
        nearest, parent = apart[0].copy(), np.zeros(n, np.int64)
        while len(centres) < n:
            radius = radius / 2 if radius > 0.25 else -1.0  # distinct points lie at least 1 apart
            fresh, open_ = [], nearest > radius
            open_[centres] = False
            while open_.any():
                p = int(np.argmax(open_))
                fresh.append(p)
                open_ &= apart[p] > radius
                open_[p] = False
            if not fresh:
                continue
            new = np.array(fresh)
            above = parent[new]  # the nearest centre one level up
            for p in np.unique(above).tolist():
                below = np.r_[p, new[above == p]]  # a centre is its own child
                at = node_of[p]
                children[at] = np.arange(len(point), len(point) + len(below))
                node_of[below] = children[at]
                point += below.tolist()
                children += [np.empty(0, np.int64)] * len(below)
            centres = np.r_[centres, new]
            closest = apart[:, new].argmin(axis=1)
            d = apart[np.arange(n), new[closest]]
            nearer = d < nearest
            nearest[nearer], parent[nearer] = d[nearer], new[closest[nearer]]
        m = len(point)
        self.first = np.array([c[0] if len(c) else 0 for c in children], np.int64)
        self.count = np.array([len(c) for c in children], np.int64)
        size = np.ones(m, np.int64)
        for v in range(m - 1, -1, -1):
            if self.count[v]:
                size[v] = size[self.first[v] : self.first[v] + self.count[v]].sum()
        self.low = np.zeros(m, np.int64)
        for v in range(m):
            if k := self.count[v]:
                s = size[self.first[v] : self.first[v] + k]
                self.low[self.first[v] : self.first[v] + k] = self.low[v] + np.cumsum(s) - s
        self.high = self.low + size
        #: the given number of each point in its new place
        self.order = np.zeros(n, np.int64)
        leaf = self.count == 0
        self.order[self.low[leaf]] = np.array(point)[leaf]
        self.radius = np.zeros(m)
        for v in np.flatnonzero(~leaf).tolist():
            self.radius[v] = apart[point[v], self.order[self.low[v] : self.high[v]]].max()


def tree_rows(ids: list, rows: np.ndarray) -> dict:
    """A block as it is stored: its tree, and the place of each row's point."""
    points, back, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    tree = CoverTree(points)
    place = np.empty(len(points), np.int64)
    place[tree.order] = np.arange(len(points))
    kind = np.int16 if np.abs(points).max(initial=0) < 1 << 15 else np.int64
    nodes = np.stack([tree.first, tree.count, tree.low, tree.high]).astype(np.int32)
    return {"ids": ids, "place": place[back.reshape(-1)].astype(np.int32).tobytes(), "times": times[tree.order].astype(np.int32).tobytes(), "points": points[tree.order].astype(kind).tobytes(), "width": np.dtype(kind).itemsize, "nodes": nodes.tobytes(), "radius": tree.radius.tobytes()}


STORED = "ids array<long>, place binary, times binary, points binary, width int, nodes binary, radius binary"
KINDS = {"ids": pa.list_(pa.int64()), "place": pa.binary(), "times": pa.binary(), "points": pa.binary(), "width": pa.int32(), "nodes": pa.binary(), "radius": pa.binary()}


def _tree_batches(dim: int):  # noqa: ANN202
    limit = math.isqrt(((1 << 63) - 1) // dim) // 2  # else a squared distance may not fit a long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for k in range(0, given.num_rows, BLOCK):
                part = given.slice(k, BLOCK)
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                if (np.abs(rows) > limit).any():
                    raise ArithmeticError("a component is too large for exact distances")
                row = tree_rows(part.column(0).to_pylist(), rows)
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in KINDS.items()], list(KINDS))

    return run


class Block:
    """A stored block read back."""

    def __init__(self, row: dict, dim: int) -> None:
        self.ids = row["ids"]
        self.place = np.frombuffer(row["place"], np.int32)
        self.times = np.frombuffer(row["times"], np.int32).astype(np.int64)
        self.points = np.frombuffer(row["points"], np.int16 if row["width"] == 2 else np.int64).astype(np.int64).reshape(-1, dim)
        self.first, self.count, self.low, self.high = np.frombuffer(row["nodes"], np.int32).astype(np.int64).reshape(4, -1)
        self.radius = np.frombuffer(row["radius"], np.float64)


def assign(block: Block, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(low, high, centroid) of runs of points that belong to one centroid, as three
    rows of a matrix; and the number of distances that were taken."""
    distinct, number = np.unique(centroids, axis=0, return_index=True)  # of equal ones the first
    other = CoverTree(distinct)
    names, at = number[other.order], distinct[other.order]
    taken, done = 0, []
    node, ref = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs, in order of node
    while len(node):
        exact = squares(block.points[block.low[node]], at[other.low[ref]])
        taken += len(node)
        d = np.sqrt(exact.astype(np.float64))
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(node)]))
        most = np.minimum.reduceat(d + block.radius[node], start)[group]
        left = d - block.radius[node] - other.radius[ref] <= most * (1 + SLACK) + SLACK
        node, ref, exact, group = node[left], ref[left], exact[left], group[left]
        single = other.count[ref] == 0
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sizes = np.diff(np.r_[start, len(node)])
        group = np.repeat(np.arange(len(start)), sizes)
        all_single = np.logical_and.reduceat(single, start)
        leaf = block.count[node[start]] == 0
        # one centroid left, or a point and centroids alone: decided
        ends = all_single & ((sizes == 1) | leaf)
        if ends.any():
            of = np.flatnonzero(ends[group])
            best = of[np.lexsort((names[other.low[ref[of]]], exact[of], group[of]))]
            best = best[np.r_[True, group[best][1:] != group[best][:-1]]]
            done.append(np.stack([block.low[node[best]], block.high[node[best]], names[other.low[ref[best]]]]))
        # the centroids' side goes down first where its nodes are the wider ones
        wide = np.maximum.reduceat(np.where(single, -1.0, other.radius[ref]), start)
        theirs = ~ends & ~all_single & (leaf | (wide >= block.radius[node[start]]))
        ours = ~ends & ~theirs
        parts = []
        if theirs.any():
            of = np.flatnonzero(theirs[group])
            k = np.maximum(other.count[ref[of]], 1)
            begin = np.where(single[of], ref[of], other.first[ref[of]])
            parts.append((np.repeat(node[of], k), np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(k.sum())))
        if ours.any():
            of = np.flatnonzero(ours[group])
            k = block.count[node[of]]
            parts.append((np.repeat(block.first[node[of]] - (np.cumsum(k) - k), k) + np.arange(k.sum()), np.repeat(ref[of], k)))
        if not parts:
            break
        node, ref = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(node, kind="stable")
        node, ref = node[order], ref[order]
    return (np.concatenate(done, axis=1) if done else np.empty((3, 0), np.int64)), centroids, taken


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Block]:
    for given in batches:
        for k in range(given.num_rows):
            yield Block({n: given.column(i)[k].as_py() for i, n in enumerate(given.schema.names)}, dim)


def _sum_batches(centroids: np.ndarray):  # noqa: ANN202
    """(cluster, dimension, total) of a task, the number of vectors as dimension -1, and
    as cluster -1 the number of distances taken."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, taken = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        for block in _blocks(batches, dim):
            (low, high, of), _, n = assign(block, centroids)
            taken += n
            upto = np.concatenate([np.zeros((1, dim), np.int64), np.cumsum(block.points * block.times[:, None], axis=0)])
            times = np.r_[0, np.cumsum(block.times)]
            np.add.at(sums, of, upto[high] - upto[low])
            np.add.at(counts, of, times[high] - times[low])
        cluster = np.r_[np.repeat(np.arange(k), dim), np.arange(k), -1]
        number = np.r_[np.tile(np.arange(dim), k), np.full(k, -1), -1]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cluster, number, np.r_[sums.reshape(-1), counts, taken])], ["cluster", "number", "total"])

    return run


def _assigned_batches(centroids: np.ndarray):  # noqa: ANN202
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, dim):
            (low, high, of), _, _ = assign(block, centroids)
            order = np.argsort(low)
            cluster = np.repeat(of[order], (high - low)[order])
            distance = squares(block.points, centroids[cluster])
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(cluster[block.place].astype(np.int32)), pa.array(distance[block.place])], ["id", "cluster", "distance"])

    return run


def whole(vector: Column, dim: int | None = None) -> Column:
    """Not null, of this length, and all entries finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad & (F.lit(True) if dim is None else F.size(vector) == dim)


def trees(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """Blocks of ``vectors`` (id, x), x an array of longs, with their cover trees."""
    return materialise(vectors.select("id", "x").mapInArrow(_tree_batches(dim), STORED), "trees")


def lloyd(blocks: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, list[int]]:
    """Centroids after so many rounds, each component rounded down, and the number of
    distances that each round took. A centroid without vectors stays."""
    centroids, work = start.astype(np.int64), []
    for _ in range(rounds if len(start) else 0):
        totals = blocks.mapInArrow(_sum_batches(centroids), "cluster long, number long, total long").groupBy("cluster", "number").agg(F.sum("total").alias("total"))
        held = {(r["cluster"], r["number"]): r["total"] for r in totals.collect()}
        work.append(held.get((-1, -1), 0))
        dim = centroids.shape[1]
        centroids = np.array([[held[c, i] // n for i in range(dim)] if (n := held.get((c, -1), 0)) else row.tolist() for c, row in enumerate(centroids)], np.int64)
    return centroids, work


def first_centroids(vectors: DataFrame, k: int, seed: str = "1:") -> np.ndarray:
    """Of the ids with the smallest hashes."""
    named = vectors.select("x", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("hash"))
    return np.array([r["x"] for r in named.orderBy(F.asc_nulls_last("hash"), "x").limit(k).collect()], np.int64)


def cluster(vectors: DataFrame, k: int = CLUSTERS, dim: int = DIM, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector of ``vectors`` (id, x), written, and the
    centroids."""
    start = first_centroids(vectors, k)
    blocks = trees(vectors, dim)
    centroids, _ = lloyd(blocks, start, rounds)
    if not len(centroids):
        return materialise(vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), "clusters"), centroids
    out = materialise(blocks.mapInArrow(_assigned_batches(centroids), "id long, cluster int, distance long"), "clusters")
    discard(blocks)
    return out, centroids


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col(quoted("embedding"))
    vectors = e.where(whole(v, DIM)).select(F.col("vec_id").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("x"))
    found, centroids = cluster(vectors)
    totals = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(r["cluster_inertia"] for r in totals)
    rows = [(r["cluster"], r["cluster_inertia"], inertia, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in totals]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(k: int) -> str:
    """Nearest centroids of c{k}, and c{k+1}."""
    return f"""
, a{k} AS MATERIALIZED (
  SELECT v.r, arg_min(c.number, struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c.number)) AS cluster,
         min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
  FROM v CROSS JOIN c{k} c GROUP BY v.r
), s{k} AS (
  SELECT cluster, i, sum(x[i]) AS total, count(*) AS n FROM a{k} JOIN v USING (r), range(1, {DIM + 1}) t(i) GROUP BY cluster, i
), c{k + 1} AS MATERIALIZED (
  SELECT c.number, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN
  (SELECT cluster, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{k} GROUP BY cluster) m ON m.cluster = c.number
)"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS number, x FROM v ORDER BY sha256('1:' || vec_id), x LIMIT {CLUSTERS}
){"".join(_round_sql(k) for k in range(ROUNDS + 1))}
, t AS (
  SELECT cluster, sum(distance) AS cluster_inertia, sum(sum(distance)) OVER () AS inertia FROM a{ROUNDS} GROUP BY cluster
)
SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.distance::BIGINT AS distance, t.cluster_inertia::BIGINT AS cluster_inertia, t.inertia::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN t ON t.cluster = a.cluster JOIN c{ROUNDS} c ON c.number = a.cluster
"""
