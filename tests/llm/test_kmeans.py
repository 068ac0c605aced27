import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from halyard.llm import kmeans
from halyard.llm.queries import op13_centroids
from tests.conftest import SF_SMALL


def brute(rows, k=8, rounds=10, size=64):
    """[(vec_id, cluster, distance)] and centroids by plain integers, all pairs."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, c, d) for (i, _), (d, c) in zip(kept, assign())], centroids


def check(spark, rows, kind="array<float>", **options):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, cluster string")
    plain = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    expected, centroids = brute(plain, **options)
    assigned, found = kmeans.cluster(frame, **options)
    assert found == centroids
    cap = lambda d: min(d, kmeans.LARGEST)
    assert sorted(map(str, (tuple(r) for r in assigned.select("vec_id", "cluster", "distance").collect()))) == sorted(str((i, c, cap(d))) for i, c, d in expected)
    report = kmeans.report(assigned, found).collect()
    assert len(report) == len(expected)
    for r in report:
        assert r["inertia"] == cap(sum(cap(d) for _, _, d in expected))
        assert r["cluster_inertia"] == cap(sum(cap(d) for _, c, d in expected if c == r["cluster"]))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    expected, centroids = brute(rows)
    got = op13_centroids(spark, SF_SMALL).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(expected)


def test_ties_copies_and_negative_parts(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(3)], "x") for i in range(120)]
    rows += [(500 + i, [0.5, 0.5, 0.5], "y") for i in range(80)] + rows[:9]
    check(spark, rows, size=3)
    check(spark, rows, size=3, k=30, rounds=4)
    check(spark, [(i, [1.0, 2.0], None) for i in range(20)], size=2)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, "a"), (1, [], "a"), (2, [1.0], "a"), (3, [nan, 1.0], "a"), (4, [inf, 1.0], "a"), (5, [None, 1.0], "a"), (6, [1.0, 2.0, 3.0], "a"), (7, [1.0, 2.0], "a"), (None, [0.5, -2.0], "a"), (8, [0.0, 0.0], "a"), (8, [0.0, 0.0], "a")]
    check(spark, rows, size=2)
    frame = spark.createDataFrame(rows[:7], "vec_id long, embedding array<float>, cluster string")
    for none in (frame.filter("vec_id < 6"), frame.limit(0)):
        assigned, centroids = kmeans.cluster(none, size=2)
        assert centroids == [] and kmeans.report(assigned, centroids).count() == 0


def test_values_beyond_64_bits_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 5, 12, 30, 300]) for _ in range(3)], "x") for i in range(60)] + [(99, [1.7e308] * 3, "x"), (98, [-1.7e308] * 3, "x")]
    check(spark, rows, "array<double>", size=3, rounds=3)


@pytest.mark.parametrize("k", [1, 2, 3, 8, 40, 200])
def test_the_tree_finds_the_nearest_and_the_smaller_of_ties(k):
    rng = np.random.default_rng(k)
    for spread in (2, 40, 4000):
        centroids = rng.integers(-spread, spread + 1, (k, 5))
        x = rng.integers(-spread, spread + 1, (300, 5))
        best, distance, computed = kmeans.nearest(kmeans.Tree(centroids.tolist()), x)
        every = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert best.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()


def test_far_branches_are_left_out():
    rng = np.random.default_rng(0)
    places = rng.integers(-(1 << 20), 1 << 20, (64, 8))
    x = places[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 8))
    _, _, computed = kmeans.nearest(kmeans.Tree(places.tolist()), x)
    assert computed < 0.35 * 64 * 2000, "a search for well separated groups opens few branches"


def test_sums_in_digits_add_up(spark):
    rows = [(i, [float(-(1 << 26)) / 1024 + i / 1024], "x") for i in range(500)]
    check(spark, rows, size=1, k=1, rounds=1)
