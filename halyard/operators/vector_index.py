"""Approximate cosine search (J8): an inverted file with product codes.

Fit. Unit vectors are grouped by k-means over all rows. What a vector differs
from its cell's centre is cut into `PARTS` pieces, and each piece is coded by
the nearest of up to 256 centres, again from k-means over all rows. A round is
one pass in which each task adds up its rows by centre; only centres and their
sums reach the driver, and their number is a parameter.

Index. One row per vector: cell, part of the cell, id, `PARTS` bytes. A cell
that holds very many vectors is stored in parts of at most `CELL_ROWS`, so no
task scans more of it.

How many cells a query probes is fitted as well: a bounded number of rows search
all others exactly, and the probes are those with which nearly each would have
met `TARGET` of its neighbours. Groups that lie apart need few, shapeless data
many.

Search. A query probes the cells with the largest inner product. Its inner
product with any code is the cell's plus one table entry per piece, so a cell's
codes are scored by table look-ups. The best `rerank` codes of a query are then
scored exactly on the vectors themselves.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.functions.numeric import rnd
from halyard.session import scratch_path, ship_package

PARTS, CODES, ROUNDS = 8, 256, 6
CELL_ROWS, QUERY_BLOCK = 65_536, 20_000
#: Codes of a query that are scored exactly.
RERANK = 80
#: Probes are fitted: so many rows ask for their true neighbours, and SURE of them have to meet TARGET of theirs.
TRIALS, TRIAL_K, TARGET, SURE = 128, 10, 0.95, 0.95


def _kept(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, f"vectors-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(len(column), -1) if len(column) else x.reshape(0, 1)


def pieces(x: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, width); the last piece is filled up with zeros."""
    width = -(-x.shape[1] // parts)
    padded = np.pad(x, ((0, 0), (0, width * parts - x.shape[1])))
    return padded.reshape(len(x), parts, width).transpose(1, 0, 2)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(parts, rows): the nearest centre of each piece, the first of equals."""
    far = np.einsum("pkw,pkw->pk", centres, centres)[:, None, :] - 2 * np.einsum("prw,pkw->prk", x, centres)
    return far.argmin(axis=2)


def k_means(rows: DataFrame, shaped, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centres (parts, k, width) after `rounds` rounds over all rows of
    `rows` (vec). `shaped` makes (parts, n, width) of an (n, size) matrix. An
    empty centre stays where it is."""
    centres = first
    for _ in range(rounds):
        now = rows.sparkSession.sparkContext.broadcast(centres)  # parts x k centres

        def run(batches):
            shape = now.value.shape
            total, count = np.zeros(shape), np.zeros(shape[:2], np.int64)
            for b in batches:
                x = shaped(_matrix(b.column(0)))
                code = nearest_centre(x, now.value)
                for p in range(shape[0]):
                    np.add.at(total[p], code[p], x[p])
                    count[p] += np.bincount(code[p], minlength=shape[1])
            p, k = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(count[p, k]), pa.array(total[p, k].tolist(), pa.list_(pa.float64()))], names=["p", "k", "n", "s"])

        parts = rows.mapInArrow(run, "p long, k long, n long, s array<double>")
        each = parts.select("p", "k", "n", F.posexplode("s").alias("i", "x")).groupBy("p", "k", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        moved = centres.copy()
        for r in each.collect():  # parts x k x width rows
            moved[r["p"], r["k"], r["i"]] = r["x"] / r["n"]
        now.unpersist()
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


@dataclass
class VectorIndex:
    """Stored codes and vectors, and the centres they refer to."""

    codes: DataFrame  # cell, part, id, code, and the vectors' other columns
    vectors: DataFrame  # id, vec (unit)
    cells: np.ndarray  # (cells, size)
    books: np.ndarray  # (parts, codes, width)
    sizes: DataFrame  # cell, n, parts
    probes: int
    id_col: str


def unit_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """id, vec (unit length) and the other columns; null and zero vectors and
    those with a null or non-finite component are left out."""
    v = F.col(vec).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    x = df.withColumn("_length", length).filter((F.col("_length") > 0) & (F.col("_length") < float("inf")))
    others = [c for c in df.columns if c not in (id_col, vec)]
    return x.select(id_col, F.transform(v, lambda e: e / F.col("_length")).alias("vec"), *others)


def build_index(corpus: DataFrame, id_col: str = "vec_id", vec: str = "embedding", cells: int | None = None, parts: int = PARTS,
                codes: int = CODES, rounds: int = ROUNDS, cell_rows: int = CELL_ROWS) -> VectorIndex:
    """An index over all usable rows of `corpus`. `cells` defaults to the
    square root of their number, at most 65,536 centres."""
    spark = corpus.sparkSession
    ship_package(spark)
    rows = _kept(unit_vectors(corpus, id_col, vec))
    n = rows.count()
    if not n:
        raise ValueError("no usable vector to index")
    cells = min(n, cells or max(1, min(65_536, round(math.sqrt(n)))))
    codes = max(1, min(codes, 256, n // 4 or 1))
    order = (F.xxhash64(id_col), F.col(id_col))
    seeds = np.array([r["vec"] for r in rows.select(id_col, "vec").orderBy(*order).limit(max(cells, codes) + TRIALS).collect()])  # as many as centres, and the trials
    only = rows.select("vec")
    coarse = k_means(only, lambda x: x[None], seeds[None, :cells], rounds)[0]

    def rest(x: np.ndarray) -> np.ndarray:
        return pieces(x - coarse[nearest_centre(x[None], coarse[None])[0]], parts)

    books = k_means(only, rest, rest(seeds[:codes]), rounds)
    others = [c for c in rows.columns if c not in (id_col, "vec")]

    def encode(batches):
        for b in batches:
            x = _matrix(b.column(0))
            cell = nearest_centre(x[None], coarse[None])[0]
            code = nearest_centre(pieces(x - coarse[cell], parts), books).T.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array([c.tobytes() for c in code], pa.binary()), *b.columns[1:]], names=["cell", "code", id_col, *others])

    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, *others))
    coded = _kept(rows.select("vec", id_col, *others).mapInArrow(encode, f"cell long, code binary{kinds}"))
    sizes = _kept(coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / cell_rows).cast("long")))
    dealt = coded.join(sizes.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64(id_col), F.col("parts"))).drop("parts")
    probes = fitted_probes(rows.select("vec"), coarse, seeds[-TRIALS:])
    return VectorIndex(_kept(dealt), rows.select(id_col, "vec"), coarse, books, sizes, probes, id_col)


def fitted_probes(rows: DataFrame, coarse: np.ndarray, trials: np.ndarray) -> int:
    """The least number of probes with which SURE of the rows `trials` meet
    TARGET of their TRIAL_K true neighbours. One pass; a task keeps the best
    of each."""
    order = np.argsort(-np.einsum("qw,cw->qc", trials, coarse), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # place[q, cell]: when q probes the cell

    def run(batches):
        best, where = np.full((len(trials), 0), 0.0), np.full((len(trials), 0), 0)
        for b in batches:
            x = _matrix(b.column(0))
            cell = nearest_centre(x[None], coarse[None])[0]
            score = np.concatenate([best, trials @ x.T], axis=1)
            at = np.concatenate([where, place[:, cell]], axis=1)
            top = np.argsort(-score, axis=1, kind="stable")[:, : TRIAL_K + 1]  # the row itself is one
            best, where = np.take_along_axis(score, top, 1), np.take_along_axis(at, top, 1)
        q = np.repeat(np.arange(len(trials)), best.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best.ravel()), pa.array(where.ravel())], names=["q", "score", "at"])

    met = rows.mapInArrow(run, "q long, score double, at long")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "at"))
    found = met.withColumn("r", rank).filter((F.col("r") > 1) & (F.col("r") <= TRIAL_K + 1)).select("q", "at").collect()  # TRIALS x TRIAL_K rows
    own: dict[int, list[int]] = {}
    for r in found:
        own.setdefault(r["q"], []).append(r["at"])
    if not own:
        return len(coarse)
    share = lambda values, p: sorted(values)[max(0, math.ceil(p * len(values)) - 1)]
    return share([share(at, TARGET) for at in own.values()], SURE) + 1


def _probed(index: VectorIndex, queries: DataFrame, qid: str, probes: int) -> DataFrame:
    """(query, vec, cell, base): the cells each query scans and its inner
    product with their centres."""
    cells = index.cells

    def run(batches):
        for b in batches:
            near = _matrix(b.column(1)) @ cells.T
            best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            of = np.repeat(np.arange(b.num_rows), best.shape[1])
            flat = best.ravel()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), pa.array(flat), pa.array(near[of, flat])], names=[qid, "vec", "cell", "base"])

    kind = queries.schema[qid].dataType.simpleString()
    return queries.select(qid, "vec").mapInArrow(run, f"`{qid}` {kind}, vec array<double>, cell long, base double")


def candidates(index: VectorIndex, queries: DataFrame, qid: str, probes: int, rerank: int, keep=None) -> DataFrame:
    """(query, id, guess): the `rerank` best codes of each query in its
    probed cells. `queries` has (query, vec), unit vectors."""
    books, id_col = index.books, index.id_col
    kind_q, kind_i = queries.schema[qid].dataType.simpleString(), index.codes.schema[id_col].dataType.simpleString()

    def scan(codes: pa.Table, asking: pa.Table) -> pa.Table:
        ids, of, found = codes.column(id_col), [], [[], []]
        if codes.num_rows and asking.num_rows:
            code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
            x = pieces(_matrix(asking.column("vec").combine_chunks()), len(books))
            base = asking.column("base").to_numpy()
            for k in range(asking.num_rows):
                table = np.einsum("pcw,pw->pc", books, x[:, k])
                score = base[k] + table[np.arange(len(books)), code].sum(axis=1)
                best = np.argpartition(-score, rerank - 1)[:rerank] if len(score) > rerank else np.arange(len(score))
                of += [k] * len(best)
                found[0] += best.tolist()
                found[1] += score[best].tolist()
        taken = pa.array(found[0], pa.int64())
        return pa.table([asking.column(qid).take(pa.array(of, pa.int64())), ids.take(taken), pa.array(found[1], pa.float64())], names=[qid, id_col, "guess"])

    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64(qid), F.lit(blocks))
    parts = index.sizes.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    asking = _probed(index, queries, qid, probes).join(parts, "cell").withColumn("block", block)
    own = index.codes if keep is None else index.codes.filter(keep)
    own = own.select("cell", "part", "code", id_col, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    met = own.groupBy("cell", "part", "block").cogroup(asking.groupBy("cell", "part", "block")).applyInArrow(scan, f"`{qid}` {kind_q}, `{id_col}` {kind_i}, guess double")
    order = W.partitionBy(qid).orderBy(F.desc("guess"), id_col)
    return met.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= rerank).drop("_rank")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, qid: str = "query_id", qvec: str = "query_vector", probes: int | None = None,
           rerank: int = RERANK, filters: dict | None = None) -> DataFrame:
    """(query, id, similarity, rank): the k best rows found for each query by
    exact cosine (4 digits), ties to the smaller id. `filters` are equalities
    on the indexed columns, applied before the scan. Queries with no usable
    vector have no rows."""
    probes = probes or index.probes
    asked = _kept(unit_vectors(queries.select(qid, qvec), qid, qvec))
    keep = None
    for name, value in (filters or {}).items():
        keep = (F.col(name) == F.lit(value)) if keep is None else keep & (F.col(name) == F.lit(value))
    met = candidates(index, asked, qid, probes, max(k, rerank), keep)
    exact = met.join(index.vectors, index.id_col).join(asked.withColumnRenamed("vec", "_q"), qid)
    dot = F.aggregate(F.zip_with("vec", "_q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    order = W.partitionBy(qid).orderBy(F.desc(rnd("_s", 9)), F.asc(index.id_col))
    top = exact.withColumn("_s", dot).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select(qid, index.id_col, rnd("_s", 4).alias("similarity"), "rank")


def search_cost(index: VectorIndex, queries: DataFrame, k: int = 10, qid: str = "query_id", qvec: str = "query_vector", rerank: int = RERANK) -> dict:
    """Pairs of a query and a row: all, scanned by code, and scored exactly."""
    asked = _kept(unit_vectors(queries.select(qid, qvec), qid, qvec))
    exact = candidates(index, asked, qid, index.probes, max(k, rerank)).count()
    return {"pairs": asked.count() * index.vectors.count(), "scanned": scanned_pairs(index, queries, qid, qvec), "candidates": exact}


def scanned_pairs(index: VectorIndex, queries: DataFrame, qid: str = "query_id", qvec: str = "query_vector", probes: int | None = None) -> int:
    """Pairs of a query and a code that a search looks at."""
    asked = unit_vectors(queries.select(qid, qvec), qid, qvec)
    return _probed(index, asked, qid, probes or index.probes).join(index.sizes, "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
