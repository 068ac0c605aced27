import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import ann
from tests.conftest import SF_SMALL


def brute(rows, k, query):
    """{query: [(id, score)]}"""
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q, v in zip(ids, x):
        if query(q):
            scores = x @ v
            best = {}
            for i, s in zip(ids, scores):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), s)
            out[q] = sorted(best.items(), key=lambda p: (-round(p[1], 12), p[0]))[:k]
    return out


def recall(frame, rows, k, step, **options):
    expected = brute(rows, k, lambda q: q % step == 0)
    got = {}
    for r in ann.nearest(frame, F.col("id") % step == 0, k, **options).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == expected.keys()
    shares = []
    for q, best in expected.items():
        found = [got[q][n] for n in range(1, len(got[q]) + 1)]
        assert len(found) == len(best) and len({i for i, _ in found}) == len(found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        shares.append(len({i for i, _ in found} & {i for i, _ in best}) / len(best))
    return np.mean(shares)


def test_recall_of_the_table(spark):
    frame = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert recall(frame, rows, 20, 20) >= 0.95
    assert recall(frame, rows, 20, 20, cell_rows=64) >= 0.95


def test_lengths_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 5)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(2000 + i, rows[20][1]) for i in range(3)] + rows[:5]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(frame, rows, 10, 20, cell_rows=50) >= 0.95


def test_awkward_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (8, [], 1), (None, [1.0, 1.0], 1), (9, [1.0, 0.0], 1)]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, kind), F.col("id") % 1 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 1.0), (0, 2, 1, 0.5), (1, 1, 0, 0.5), (1, 2, 9, 0.5), (9, 1, 0, 1.0), (9, 2, 1, 0.5)]
    assert ann.nearest(spark.createDataFrame([], kind), F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(20, [1.0, 2.0], 1)], kind), F.col("id") % 20 == 0).count() == 0


def test_query_blocks(spark, monkeypatch):
    frame = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    whole = ann.nearest(frame, F.col("id") % 5 == 0, 5, cell_rows=64).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    assert ann.nearest(frame, F.col("id") % 5 == 0, 5, cell_rows=64).orderBy("query_id", "rank").collect() == whole


@pytest.mark.parametrize("p", [0.5, 0.9, 0.97])
def test_chi_square_quantile(p):
    draws = (np.random.default_rng(0).normal(size=(200_000, ann.DIMS)) ** 2).sum(axis=1)
    assert np.mean(draws < ann.chi_square_quantile(p, ann.DIMS)) == pytest.approx(p, abs=0.005)


def test_cells_follow_the_splits():
    x = np.random.default_rng(0).normal(size=(4096, ann.DIMS))
    cells = ann.cell_of(x, ann.kd_splits(x, 4))
    assert sorted(set(cells.tolist())) == list(range(16)) and np.bincount(cells).max() <= 260


def test_a_cell_scores_few_rows_alone_and_finds_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[:40] = np.round(x[:40])
    x[40:80] = x[:40]  # ties
    ids, far = rng.permutation(3000), float((x * x).sum(axis=1).max())
    matrix = ann.projection(16)
    points = x @ matrix[:-1] + np.sqrt(np.maximum(far - (x * x).sum(axis=1), 0))[:, None] * matrix[-1]
    alone, einsum = [], np.einsum
    monkeypatch.setattr(ann.np, "einsum", lambda how, *a: (alone.append(len(a[0])) if how == "ij,j->i" else None) or einsum(how, *a))
    found = ann.search_cell(ids, x, points, x[:100], x[:100] @ matrix[:-1], np.full(100, -np.inf), far, 21)
    monkeypatch.undo()
    assert sum(alone) < 100 * 3000 / 3  # nearly all rows are met, but few may reach the bound
    recall = 0
    for q, (rows, scores) in zip(x, found):
        exact = einsum("ij,j->i", x, q)
        assert np.array_equal(scores, exact[rows])
        recall += len(set(rows.tolist()) & set(np.lexsort((ids, -exact))[:21].tolist()))
    assert recall >= 0.95 * 2100
