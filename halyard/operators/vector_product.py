"""Exact cosine neighbours of a query set by matrix products (behind J7).

The query set is read in blocks of at most about ``BLOCK_BYTES`` of vectors and
results. A block goes to all tasks; each of them multiplies its batches of
the corpus by the block and keeps k rows a query, so a partition hands k rows a
query to the shuffle, however many rows it has. The work is corpus x queries,
as exactness asks; the corpus is scanned once a block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.session import ship_package

BLOCK_BYTES = 64 << 20
#: Scores that a task holds at once.
CELLS = 1 << 22
#: Scores are ordered by this many parts of one, as ``rnd(score, 9)`` does.
PARTS = 1e9


def norm(vec) -> F.Column:
    """Length of a vector; null if a component is."""
    return F.sqrt(F.aggregate(F.transform(vec, lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))


def usable(vec) -> F.Column:
    """Whether a vector has a direction: no null, NaN or infinite length, not zero."""
    return F.coalesce((norm(vec) > 0) & (norm(vec) < float("inf")), F.lit(False))  # NaN is over infinity


def _by_size(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{components: (positions, matrix)} of an array of lists."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
    return out


def _first_k(q: np.ndarray, key: np.ndarray, ids: pa.ChunkedArray, k: int) -> np.ndarray:
    """Positions of each query's k rows of largest key, ties to the smaller id; by query and rank."""
    place = np.empty(len(q), np.int64)
    place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(q))
    order = np.lexsort((place, -key, q))
    begin = np.flatnonzero(np.diff(q[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))
    return order[nth < k]


class Best:
    """The k best rows so far of every query of a block."""

    def __init__(self, n_queries: int, k: int, id_col: str):
        self.k, self.id_col, self.rows = k, id_col, None
        self.q, self.key, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.floor = np.full(n_queries, np.iinfo(np.int64).min)

    def add(self, rows: pa.Table, q: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        q, key, score = np.concatenate((self.q, q)), np.concatenate((self.key, key)), np.concatenate((self.score, score))
        keep = _first_k(q, key, rows[self.id_col], self.k)
        self.rows, self.q, self.key, self.score = rows.take(pa.array(keep)), q[keep], key[keep], score[keep]
        begin = np.flatnonzero(np.diff(self.q, prepend=-1))
        full = np.diff(begin, append=len(self.q)) == self.k
        last = begin[full] + self.k - 1
        self.floor[self.q[last]] = self.key[last]


def _offer(best: Best, rows: pa.Table, vectors: pa.Array, block: dict) -> None:
    for d, (at, x) in _by_size(vectors).items():
        if d not in block:
            continue
        which, y = block[d]
        lengths, own = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        for rows_at in range(0, len(at), 4096):
            part = slice(rows_at, rows_at + 4096)
            step = max(1, CELLS // len(at[part]))
            for begin in range(0, len(which), step):
                cut = slice(begin, begin + step)
                score = (y[cut] @ x[part].T) / (own[cut, None] * lengths[None, part])
                key = (np.sign(score) * np.floor(np.abs(score) * PARTS + 0.5)).astype(np.int64)
                least = best.floor[which[cut]]
                if key.shape[1] > best.k:
                    least = np.maximum(least, np.partition(key, key.shape[1] - best.k, axis=1)[:, -best.k])
                q, r = np.nonzero(key >= least[:, None])
                if len(q):
                    best.add(rows.take(pa.array(at[part][r])), which[cut][q], key[q, r], score[q, r])


def nearest(corpus: DataFrame, vec: str, id_col: str, queries: DataFrame, qid: str, qvec: str, k: int, max_queries: int | None = None) -> DataFrame:
    """(qid, the columns of `corpus` but `vec`, `_s`, `_k`): at most k rows a
    query and partition, among which are each query's k of largest cosine
    `_s`; `_k` is what to order by before the id. Vectors meet queries of
    their own length only; those without a direction take no part. Equal query
    rows count once."""
    ship_package(corpus.sparkSession)
    asked = queries.select(qid, F.col(qvec).cast("array<double>").alias("_q")).filter(usable("_q")).distinct()
    n, widest = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("_q")), F.lit(0))).first()
    a_block = max(1, BLOCK_BYTES // (8 * widest + 64 * k))
    blocks = max(1, -(-n // min(a_block, max_queries or a_block)))
    keep = [c for c in corpus.columns if c != vec]
    source = corpus.withColumn(vec, F.col(vec).cast("array<double>")).filter(usable(vec)).select(*keep, vec)
    kinds = [f"`{qid}` {asked.schema[qid].dataType.simpleString()}", *[f"`{c}` {corpus.schema[c].dataType.simpleString()}" for c in keep]]
    parts = []
    for block in range(blocks):
        # bounded: about BLOCK_BYTES by a hash of the query rows
        held = asked.filter(F.pmod(F.xxhash64(qid, "_q"), F.lit(blocks)) == block).toArrow().combine_chunks()
        sent = corpus.sparkSession.sparkContext.broadcast((held[qid].combine_chunks(), _by_size(held["_q"].combine_chunks())))

        def run(batches, sent=sent):
            ids, vectors = sent.value
            best = Best(len(ids), k, id_col)
            for b in batches:
                if b.num_rows and len(ids):
                    _offer(best, pa.Table.from_batches([b]).select(keep), b.column(len(keep)), vectors)
            if best.rows is not None:
                columns = [ids.take(pa.array(best.q)), *best.rows.columns, pa.array(best.score), pa.array(best.key)]
                yield from pa.Table.from_arrays(columns, names=[qid, *keep, "_s", "_k"]).combine_chunks().to_batches()

        parts.append(source.mapInArrow(run, ", ".join([*kinds, "_s double, _k long"])))
    return reduce(DataFrame.unionByName, parts)
