"""Exact integer centroid clustering with a vantage-point tree.

Vectors become integers once. In each round the driver builds a vantage-point
tree over the centroids and broadcasts it (its size is that of the centroids).
Every vector walks the tree best first: the open branch with the least lower
bound is next, and a branch is left out only where that bound lies beyond the
best distance so far; one that ties is opened, so that the smaller number can
still win. Distances that decide are exact integers; the bounds are doubles,
widened by a margin far over their rounding.

A task adds up its own vectors by cluster, so that clusters x components rows
leave it whatever it reads, and a cluster with most of the rows is no hot key.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import python_ready, stored

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3
#: Centroids in a leaf of the tree.
LEAF = 2
#: Below this magnitude, 64 squared differences fit into 64 bits; beyond it Python's integers are used.
SMALL = 1 << 27
#: Sums leave a task in digits of this many bits, so that any magnitude adds up exactly.
DIGIT = 40
LARGEST = (1 << 63) - 1
#: Relative margin of the bounds against rounding, and the absolute one in units of the integers.
MARGIN = 1e-5


class Tree:
    """Nodes in one list. An inner node has a vantage centroid and, for each
    side, the least and greatest squared distance of its centroids from it; a
    leaf has a few centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.nodes: list[tuple] = []
        if centroids:
            self._grow(list(range(len(centroids))))

    def _grow(self, own: list[int]) -> int:
        at = len(self.nodes)
        if len(own) <= LEAF:
            self.nodes.append(("leaf", own))
            return at
        self.nodes.append(())
        vantage, rest = own[0], own[1:]
        far = sorted((squared(self.centroids[vantage], self.centroids[c]), c) for c in rest)
        half = max(1, len(far) // 2)
        sides = []
        for part in (far[:half], far[half:]):
            if part:
                sides.append((self._grow([c for _, c in part]), part[0][0], part[-1][0]))
        self.nodes[at] = ("inner", vantage, sides)
        return at


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def roots(squares, exact: bool) -> np.ndarray:
    """Distances as doubles, in units of 2^30 where they may be beyond them."""
    if not exact:
        return np.sqrt(np.asarray(squares, np.float64))
    return np.array([math.isqrt(int(d) << 40) / (1 << 50) for d in squares], np.float64)


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance, distances computed) of the nearest centroid
    of each row of `vectors` (integers, 64-bit or Python's)."""
    n, exact = len(vectors), vectors.dtype == object or _wide(tree.centroids)
    if exact:
        vectors = vectors.astype(object)
    centroids = np.array(tree.centroids, object if exact else np.int64).reshape(len(tree.centroids), -1)
    slack = MARGIN / (1 << 30) if exact else MARGIN
    best = np.full(n, -1, np.int64)
    worst = np.full(n, -1, object if exact else np.int64)
    reach = np.full(n, np.inf)
    # the frontier: each vector's lower bound of each open node
    bound = np.full((n, len(tree.nodes)), np.inf)
    bound[:, 0] = 0.0
    todo, computed = np.arange(n), 0

    def verify(rows: np.ndarray, c: int) -> np.ndarray:
        nonlocal computed
        computed += len(rows)
        gap = vectors[rows] - centroids[c]
        d = (gap * gap).sum(axis=1)
        better = (best[rows] < 0) | (d < worst[rows]) | ((d == worst[rows]) & (c < best[rows]))
        won = rows[better]
        best[won], worst[won] = c, d[better]
        root = roots(d, exact)
        reach[won] = root[better]
        return root

    while len(todo):
        node = bound[todo].argmin(axis=1)
        least = bound[todo, node]
        open_ = np.isfinite(least) & (least <= reach[todo])  # inclusive: a tie is opened
        todo, node, least = todo[open_], node[open_], least[open_]
        bound[todo, node] = np.inf
        for k in np.unique(node):
            rows = todo[node == k]
            if tree.nodes[k][0] == "leaf":
                for c in tree.nodes[k][1]:
                    verify(rows, c)
                continue
            _, vantage, sides = tree.nodes[k]
            d = verify(rows, vantage)
            floor = least[node == k]
            for child, *ends in sides:
                low, high = roots(ends, exact)
                gap = np.maximum(np.maximum(low - d, d - high) - MARGIN * (d + high) - slack, 0)
                bound[rows, child] = np.maximum(gap, floor)
    return best, worst, computed


def _wide(values: list[list[int]]) -> bool:
    return any(abs(x) >= SMALL for v in values for x in v)


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as 64-bit integers where all are small and
    as Python's otherwise. SCALE is a power of two, so the product is exact;
    one beyond the doubles is that of the exact integers."""
    if not len(values) or np.abs(values).max() < SMALL / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([[math.floor(Fraction(x) * SCALE) for x in v] for v in values.tolist()], object).reshape(values.shape)


def usable(vector: str, size: int) -> Column:
    """Vectors of `size` components, none null or non-finite."""
    bad = F.exists(F.col(vector), lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _assigned(rows: DataFrame, tree, size: int) -> DataFrame:
    def run(batches):
        for b in batches:
            number, distance, _ = nearest(tree.value, whole(_matrix(b.column(1), size)))
            capped = [min(int(d), LARGEST) for d in distance] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int32()), pa.array(capped, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def _moved(rows: DataFrame, tree, k: int, size: int) -> list[list[int]]:
    """The centroids after one round."""

    def run(batches):
        sums = np.zeros((k, size), object)
        counts = np.zeros(k, np.int64)
        for b in batches:
            x = whole(_matrix(b.column(1), size))
            number, _, _ = nearest(tree.value, x)
            for c in np.unique(number):
                own = x[number == c]
                sums[c] += own.sum(axis=0)
                counts[c] += len(own)
        out: list[tuple] = []
        for c in np.flatnonzero(counts).tolist():
            out.append((c, -1, 0, int(counts[c])))
            for i, total in enumerate(sums[c].tolist()):
                sign, rest, digit = (-1 if total < 0 else 1), abs(int(total)), 0
                while rest:
                    out.append((c, i, digit, sign * (rest & ((1 << DIGIT) - 1))))
                    rest, digit = rest >> DIGIT, digit + 1
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["cluster", "part", "digit", "value"])

    parts = rows.mapInArrow(run, "cluster long, part long, digit long, value long").groupBy("cluster", "part", "digit").agg(F.sum("value").alias("value"))
    sums, counts = [[0] * size for _ in range(k)], [0] * k
    for r in parts.collect():  # clusters x (components x digits + 1) rows
        if r["part"] < 0:
            counts[r["cluster"]] = r["value"]
        else:
            sums[r["cluster"]][r["part"]] += r["value"] << (DIGIT * r["digit"])
    return [[s // counts[c] for s in sums[c]] if counts[c] else tree.value.centroids[c] for c in range(k)]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every kept vector, the final centroids).

    Kept are vectors of exactly `size` components, none null or non-finite; a
    null id is kept. The first centroids are the k kept vectors with the
    smallest sha256 of `seed:id` (a null id has no digits), ties by the vector
    itself. Repeated rows count each; equal centroids leave the larger number
    empty, and an empty one stays where it is. Fewer vectors than k: as many clusters as
    vectors; none: no rows. A distance over 2^63 - 1 is given as that, after
    it was compared exactly. Rounds end early when no centroid moves, which
    changes no result."""
    spark = vectors.sparkSession
    kept = vectors.filter(usable(vector, size)).select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = stored(kept)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select("vec", order.alias("h")).orderBy("h", "vec").limit(k).collect()  # k rows
    centroids = [whole(np.array([r["vec"]], np.float64))[0].tolist() for r in first]
    k = len(centroids)
    if not k:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    rows = python_ready(rows)
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(Tree(centroids))  # k centroids
        moved = _moved(rows, tree, k, size)
        tree.unpersist()
        if moved == centroids:
            break
        centroids = moved
    return stored(_assigned(rows, spark.sparkContext.broadcast(Tree(centroids)), size)), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Each vector with its cluster's and the whole inertia and the digest of
    its centroid. Sums over 2^63 - 1 are given as that."""
    spark = assigned.sparkSession
    capped = lambda s: F.least(s, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("decimal(38,0)").alias("s"))
    whole_sum = assigned.agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("decimal(38,0)")).scalar()
    names = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    small = sums.join(names, "cluster").select("cluster", capped(F.col("s")).alias("cluster_inertia"), capped(whole_sum).alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
