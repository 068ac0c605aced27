"""Nearest neighbours by inner product through stable projections and kd-trees.

Vectors get one more component that makes all as long as the longest; queries
get a zero there. Then the largest inner product is the least distance. `DIMS`
Gaussian (2-stable) projections keep distances: the squared projected distance
over the squared true one is chi-square distributed with DIMS degrees.

A top kd-tree, split on a bounded sample, deals all rows to cells; each cell's
task builds its own kd-tree of leaves. A query takes leaves in the order of
their projected distance and verifies their rows by inner product, until the
chi-square test says that a row as near as its worst kept neighbour would have
been met with probability `CONFIDENCE`. It first searches the cell it lies in.
The bound found there names the other cells that the test leaves open; the
query is then sent to those alone.

Equal vectors are indexed once with their smallest ids, as many as a result can
hold, so a vector that a third of all rows share is one row. A cell's queries
come in blocks of about `QUERY_BLOCK`, so neither side of a task grows with the
table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import numbered, python_ready, stored

DIMS, CONFIDENCE, SEED = 8, 0.97, 3
CELL_ROWS, LEAF_ROWS, SAMPLE_ROWS, QUERY_BLOCK = 16_384, 128, 20_000, 20_000
#: Leaves that are verified between two stopping tests.
STEP = 4
#: Queries of a block that a task searches at once, and a bound on the rounding of an inner product of unit vectors.
QUERIES_AT_ONCE, ROUNDING = 2048, 1e-9


def chi_square_quantile(p: float, degrees: int) -> float:
    """For even degrees, by bisection of the closed form."""
    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def projection(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size + 1, DIMS))


def kd_splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A full tree of median splits, in heap order: (dimension, value); the
    widest dimension is split."""
    out: list[tuple[int, float]] = [(0, 0.0)] * ((1 << depth) - 1)
    held = {0: points}
    for node in range(len(out)):
        own = held.pop(node)
        dim = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
        value = float(np.median(own[:, dim])) if len(own) else 0.0
        out[node] = (dim, value)
        right = own[:, dim] > value if len(own) else np.zeros(0, bool)
        held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
    return out


def cell_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    dims, values = np.array([d for d, _ in splits], np.int64), np.array([v for _, v in splits])
    every = np.arange(len(points))
    for _ in range((len(splits) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[every, dims[node]] > values[node])
    return node - len(splits)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    todo, out = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= LEAF_ROWS:
            out.append(own)
            continue
        x = points[own]
        dim = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        order = own[np.argsort(x[:, dim], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of a query to boxes."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(axis=-1)


def search_cell(ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, queries: np.ndarray, query_points: np.ndarray, bounds: np.ndarray, far: float, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (row, score) of its `keep` best rows found here, best
    first, ties to the smaller id. `far`: |q'|^2 without the query's own part,
    so that distance^2 = |q|^2 + far - 2 score. bounds: best known worst score."""
    leaves = _leaves(points)
    low = np.stack([points[x].min(axis=0) for x in leaves])
    high = np.stack([points[x].max(axis=0) for x in leaves])
    held = [np.ascontiguousarray(vectors[x]) for x in leaves]
    longest = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max()))
    found = []
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        part = slice(at, at + QUERIES_AT_ONCE)
        found += _search_block(ids, vectors, leaves, held, low, high, longest, queries[part], query_points[part], bounds[part], far, keep)
    return found


def _search_block(ids, vectors, leaves, held, low, high, longest, queries, query_points, bounds, far, keep) -> list[tuple[np.ndarray, np.ndarray]]:
    """`search_cell` for some queries. Each takes leaves in the order of their
    distance, in rounds of twice as many as before; the stopping test looks at
    every STEP-th of a round's, with the bound known when the round begins. A
    leaf is multiplied by all queries of a round that take it, and what may
    reach a query's bound gets its score alone."""
    quantile = chi_square_quantile(CONFIDENCE, DIMS)
    near = np.stack([box_distance(p, low, high) for p in query_points])
    order = np.argsort(near, axis=1, kind="stable")
    near = np.take_along_axis(near, order, axis=1)
    lengths = np.einsum("ij,ij->i", queries, queries)
    slack = ROUNDING * np.sqrt(lengths) * longest
    worst = np.array(bounds, np.float64)
    rows = [np.empty(0, np.int64)] * len(queries)
    scores = [np.empty(0)] * len(queries)
    active, at, width = np.arange(len(queries)), 0, STEP
    while len(active) and at < len(leaves):
        end = min(at + width, len(leaves))
        limit = quantile * np.maximum(lengths[active] + far - 2 * worst[active], 0)
        steps = (near[active, at:end:STEP] <= limit[:, None]).sum(axis=1)  # sorted, so they are the first
        who, place = np.nonzero(np.arange(end - at) < (steps * STEP)[:, None])
        who, leaf = active[who], order[active[who], at + place]
        active = active[steps * STEP >= end - at]
        at, width = end, 2 * width
        by_leaf = np.argsort(leaf, kind="stable")
        who, leaf = who[by_leaf], leaf[by_leaf]
        begin = np.flatnonzero(np.diff(leaf, prepend=-1))
        asks, meets = [], []
        for first, last in zip(begin.tolist(), np.append(begin[1:], len(leaf)).tolist()):
            own = who[first:last]
            q, r = np.nonzero(queries[own] @ held[leaf[first]].T >= (worst[own] - slack[own])[:, None])
            asks.append(own[q])
            meets.append(leaves[leaf[first]][r])
        if not asks:
            continue
        ask, meet = np.concatenate(asks), np.concatenate(meets)
        by_query = np.argsort(ask, kind="stable")
        ask, meet = ask[by_query], meet[by_query]
        begin = np.flatnonzero(np.diff(ask, prepend=-1))
        for first, last in zip(begin.tolist(), np.append(begin[1:], len(ask)).tolist()):
            i, own = int(ask[first]), meet[first:last]
            rows[i] = np.concatenate((rows[i], own))
            scores[i] = np.concatenate((scores[i], np.einsum("ij,j->i", vectors[own], queries[i])))
            if len(rows[i]) > keep:
                take = np.lexsort((ids[rows[i]], -scores[i]))[:keep]
                rows[i], scores[i] = rows[i][take], scores[i][take]
                worst[i] = max(worst[i], float(scores[i][-1]))
    takes = [np.lexsort((ids[r], -s)) for r, s in zip(rows, scores)]
    return [(r[t], s[t]) for r, s, t in zip(rows, scores, takes)]


def _packed(column) -> np.ndarray:
    parts = column.combine_chunks().to_pylist() if isinstance(column, pa.ChunkedArray) else column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1) if parts else np.empty((0, 0))


def _searcher(far: float, keep: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "gid", "score", "first"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        out: list[list] = [[], [], [], []]
        if points.num_rows and queries.num_rows:
            gids, ids = (points.column(c).to_numpy() for c in ("gid", "first"))
            found = search_cell(ids, _packed(points.column("vec")), _packed(points.column("point")), _packed(queries.column("vec")), _packed(queries.column("point")), queries.column("bound").to_numpy(), far, keep)
            for query, (rows, scores) in zip(queries.column("query").to_pylist(), found):
                out[0] += [query] * len(rows)
                out[1] += gids[rows].tolist()
                out[2] += scores.tolist()
                out[3] += ids[rows].tolist()
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vec): distinct rows with an id and a finite, non-zero vector of
    the most frequent length (the longest of equals)."""
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("vec")).filter(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & ~F.exists("vec", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
        & F.exists("vec", lambda x: x != 0)
    )
    sizes = base.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return base.filter(F.size("vec") == (sizes[0]["n"] if sizes else 0)).distinct()


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with `is_query` (a
    condition on the column `id`) its k nearest other rows found, nearest
    first, ties to the smaller id; score is the inner product in doubles.

    Null ids and vectors, zero ones, those with a null or non-finite part and
    those of another length than most take no part. Repeated rows count once;
    rows that share an id are never each other's neighbours. No rows: none.
    """
    rows = stored(usable(vectors, id_col, vector))
    keep = k + 1  # the query's own vector is found too
    slot = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    groups = rows.withColumn("slot", slot).filter(F.col("slot") <= keep).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    table = numbered(groups, "gid")
    asked = stored(rows.filter(is_query).join(table.select("vec", "gid"), "vec").select(F.col("id").alias("query_id"), F.col("gid").alias("query")))
    total = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m"), F.max(F.size("vec")).alias("d")).first()
    if not total["n"]:
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("query").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    far, size = float(total["m"]), int(total["d"])
    matrix = projection(size)
    depth = max(0, math.ceil(math.log2(max(1, total["n"] / cell_rows))))

    def place(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(far - np.einsum("ij,ij->i", x, x), 0))
        return x @ matrix[:-1] + rest[:, None] * matrix[-1]

    def values(column) -> np.ndarray:
        return column.flatten().to_numpy().astype(np.float64).reshape(-1, size)

    sample = table.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(SAMPLE_ROWS).collect()  # bounded
    splits = kd_splits(place(np.array([r["vec"] for r in sample], np.float64)), depth)

    def dealt(batches):
        for b in batches:
            x = values(b.column(1))
            p, q = place(x), x @ matrix[:-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *(pa.array([r.tobytes() for r in z], pa.binary()) for z in (x, p, q)), pa.array(cell_of(p, splits)), pa.array(cell_of(q, splits)), pa.array(p.tolist(), pa.list_(pa.float64()))],
                names=["gid", "first", "vec", "point", "asks", "cell", "home", "place"],
            )

    source = python_ready(table).select("gid", "vec", F.col("ids")[0].alias("first"))
    points = stored(source.mapInArrow(dealt, "gid long, first long, vec binary, point binary, asks binary, cell long, home long, place array<double>"))
    boxes = points.groupBy("cell").agg(*[f(F.col("place")[i]).alias(f"{n}{i}") for i in range(DIMS) for f, n in ((F.min, "l"), (F.max, "h"))]).collect()  # a row a cell
    queries = points.join(asked.select(F.col("query").alias("gid")).distinct(), "gid").select(F.col("gid").alias("query"), "vec", F.col("asks").alias("point"), "home")
    queries = stored(queries)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")
    result = "query long, gid long, score double, first long"

    def searched(asking: DataFrame) -> DataFrame:
        """`asking` has (query, vec, point, bound, cell)."""
        asking = asking.select("query", "vec", "point", "bound", "cell", block)
        own = points.select("gid", "first", "vec", "point", "cell")
        if blocks > 1:
            asked_for = asking.select(F.col("cell").alias("in"), F.col("block").alias("by")).distinct()
            own = own.join(asked_for, F.col("cell") == F.col("in")).select("gid", "first", "vec", "point", "cell", F.col("by").alias("block"))
        else:
            own = own.withColumn("block", F.lit(0).cast("long"))
        return own.groupBy("cell", "block").cogroup(asking.groupBy("cell", "block")).applyInArrow(_searcher(far, keep), result)

    home = stored(searched(queries.select("query", "vec", "point", F.lit(float("-inf")).alias("bound"), F.col("home").alias("cell"))))
    best = home
    if depth:
        worst = home.groupBy("query").agg(F.when(F.count(F.lit(1)) >= keep, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
        low = np.array([[r[f"l{i}"] for i in range(DIMS)] for r in boxes])
        high = np.array([[r[f"h{i}"] for i in range(DIMS)] for r in boxes])
        cells = np.array([r["cell"] for r in boxes])
        quantile = chi_square_quantile(CONFIDENCE, DIMS)

        def open_cells(batches):
            for b in batches:
                x, p = _packed(b.column(1)), _packed(b.column(2))
                bound, own = b.column(3).to_numpy(), b.column(4).to_numpy()
                lists = []
                for i in range(len(own)):
                    near = box_distance(p[i], low, high) <= quantile * max(float(x[i] @ x[i]) + far - 2 * bound[i], 0)
                    lists.append(cells[near & (cells != own[i])].tolist())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(lists, pa.list_(pa.int64()))], names=["query", "vec", "point", "bound", "cells"])

        bounded = queries.join(worst, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))).select("query", "vec", "point", "bound", "home")
        sent = bounded.mapInArrow(open_cells, "query long, vec binary, point binary, bound double, cells array<long>")
        best = home.unionByName(searched(sent.select("query", "vec", "point", "bound", F.explode("cells").alias("cell"))))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    top = best.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= keep)
    hits = asked.join(top, "query").join(table.select("gid", "ids"), "gid").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
