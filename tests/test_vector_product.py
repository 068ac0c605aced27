"""Exact vector search by matrix products, against plain Python."""

import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.operators import search as se
from halyard.operators import vector_product as vp
from halyard.plans import registry_text as rt
from tests.conftest import SF_SMALL


def brute(rows, queries, k):
    out = set()
    for qid, q in queries:
        scored = []
        for vid, v, tag in rows:
            if v is None or len(v) != len(q) or any(x is None for x in v):
                continue
            n = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in q))
            if n > 0 and math.isfinite(n):
                s = sum(a * b for a, b in zip(v, q)) / n
                scored.append((-round(s, 9), vid, tag))
        out |= {(qid, vid, tag, rank) for rank, (_, vid, tag) in enumerate(sorted(scored)[:k], 1)}
    return out


def found(spark, rows, queries, **options):
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, tag string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    return {(r["query_id"], r["vec_id"], r["tag"], r["rank"]) for r in se.vector_search(corpus, asked, **options).collect()}


@settings(max_examples=6, deadline=None)
@given(seed=st.integers(0, 1 << 30), k=st.sampled_from([1, 3, 40]))
def test_equals_plain_search(spark, seed, k):
    """Small components make many ties and copies; a group of copies is larger than k."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)], f"t{i % 4}") for i in range(120)]
    rows += [(500 + i, [1.0, 2.0, 0.5], "copy") for i in range(60)]
    queries = [(j, [float(x) for x in rng.integers(-2, 3, 3)]) for j in range(9)]
    expected = brute(rows, queries, k)
    assert found(spark, rows, queries, k=k) == expected == found(spark, rows, queries, k=k, max_broadcast_queries=2)


def test_awkward_vectors(spark):
    rows = [(1, None, "a"), (2, [], "a"), (3, [0.0, 0.0], "a"), (4, [float("nan"), 1.0], "a"), (5, [float("inf"), 1.0], "a"),
            (6, [None, 1.0], "a"), (7, [1.0, 1.0], None), (7, [1.0, 1.0], None), (8, [1.0, 2.0, 3.0], "b"), (9, [-1.0, -1.0], "b")]
    queries = [(1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 0.0]), (5, [1.0, 0.0, 0.0])]
    got = sorted((r["query_id"], r["vec_id"], r["similarity"], r["rank"]) for r in se.vector_search(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, tag string"),
        spark.createDataFrame(queries, "query_id long, query_vector array<double>"), k=5).collect())
    assert got == [(1, 7, 1.0, 1), (1, 7, 1.0, 2), (1, 9, -1.0, 3), (5, 8, 0.2673, 1)]
    assert found(spark, rows[:6], queries, k=5) == set() and found(spark, rows, queries[2:4], k=5) == set()


def test_few_scores_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), "t") for i in range(50)]
    best = vp.Best(6, 4, "id")
    queries = rng.normal(size=(6, 4))
    monkeypatch.setattr(vp, "CELLS", 7)
    for part in (rows[:20], rows[20:]):
        vp._offer(best, pa.table({"id": [r[0] for r in part]}), pa.array([r[1] for r in part]), {4: (np.arange(6), queries)})
    got = {(int(q), v) for q, v in zip(best.q, best.rows["id"].to_pylist())}
    assert got == {(q, v) for q, v, _, _ in brute(rows, list(enumerate(queries.tolist())), 4)}


def test_no_nested_loop(spark):
    plan = rt.j07_vector_search(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
