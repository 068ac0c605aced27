import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import search as se
from halyard.operators import vector_index as vi
from halyard.plans import registry_text as rt
from halyard.sources.io import read_table
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def rows(spark):
    """Loose groups of very different size, copies, and unusable vectors."""
    rng = np.random.default_rng(3)
    places = rng.normal(size=(30, 20))
    out = [(i, (places[0 if i % 3 == 0 else i % 30] + 0.35 * rng.normal(size=20)).tolist(), i % 4) for i in range(3000)]
    out += [(5000 + i, out[7][1], 1) for i in range(30)]
    out += [(9000, None, 0), (9001, [0.0] * 20, 0), (9002, [float("nan")] * 20, 0), (9003, [None] * 20, 0)]
    return spark.createDataFrame(out, "vec_id long, embedding array<double>, kind int").repartition(4).cache()


@pytest.fixture(scope="module")
def index(rows):
    return vi.build_index(rows, cell_rows=40)


def queries(rows, step=60):
    return rows.filter(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def as_sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["vec_id"]] = (r["rank"], r["similarity"])
    return out


def recall(found, exact):
    return np.mean([len(found.get(q, {}).keys() & best.keys()) / len(best) for q, best in exact.items()])


def test_recall_and_scanned_share(rows, index):
    asked = queries(rows)
    found, exact = as_sets(vi.search(index, asked, 10)), as_sets(se.vector_search(rows, asked, 10))
    assert found.keys() == exact.keys() and recall(found, exact) >= 0.9
    cost = vi.search_cost(index, asked)
    assert cost["pairs"] == 50 * 3030 and cost["scanned"] < 0.6 * cost["pairs"] and cost["candidates"] < 0.05 * cost["pairs"]
    # what was found has the exact score
    assert all(found[q][i][1] == exact[q][i][1] for q in found for i in found[q].keys() & exact[q].keys())


def test_every_vector_is_indexed_once_and_large_cells_are_split(index):
    ids = [r["vec_id"] for r in index.codes.select("vec_id").collect()]
    assert sorted(ids) == list(range(3000)) + list(range(5000, 5030))
    sizes = index.codes.groupBy("cell", "part").count().agg(F.max("count"), F.countDistinct("part")).first()
    assert sizes[1] > 1 and sizes[0] < 80


def test_all_cells_and_codes_is_exact_search(rows, index):
    asked = queries(rows, 300)
    found = as_sets(vi.search(index, asked, 5, probes=len(index.cells), rerank=4000))
    assert found == as_sets(se.vector_search(rows, asked, 5))


def test_filters_come_before_the_scan(rows, index):
    asked = queries(rows, 300)
    found, exact = as_sets(vi.search(index, asked, 5, filters={"kind": 1})), as_sets(se.vector_search(rows, asked, 5, filters={"kind": 1}))
    kinds = {r["vec_id"]: r["kind"] for r in rows.collect()}
    assert all(kinds[i] == 1 for best in found.values() for i in best) and recall(found, exact) >= 0.9


def test_query_blocks_and_unusable_queries(rows, index, monkeypatch, spark):
    asked = queries(rows, 300).unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * 20)], "query_id long, query_vector array<double>"))
    whole = as_sets(vi.search(index, asked, 5))
    monkeypatch.setattr(vi, "QUERY_BLOCK", 3)
    assert as_sets(vi.search(index, asked, 5)) == whole and -1 not in whole and -2 not in whole
    assert vi.search(index, asked.limit(0), 5).count() == 0


def test_codes_come_close_to_the_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 10))
    p = vi.pieces(x, 4)
    assert p.shape == (4, 500, 3) and np.allclose(p.transpose(1, 0, 2).reshape(500, -1)[:, :10], x)
    centres = p[:, :50]
    code = vi.nearest_centre(p, centres)
    every = ((p[:, :, None] - centres[:, None]) ** 2).sum(axis=3)
    assert np.array_equal(code, every.argmin(axis=2)) and (code[:, :50] == np.arange(50)).all()


def test_registered_query_against_exact_search(spark):
    emb = read_table(spark, SF_MID, "embeddings")
    asked = rt._centroid_queries(spark, SF_MID)
    exact = as_sets(rt.j07_vector_search(spark, SF_MID))
    assert recall(as_sets(rt.j08_ann_search(spark, SF_MID)), exact) >= 0.9
    cost = vi.search_cost(vi.build_index(emb), asked)
    assert cost["candidates"] < 0.2 * cost["pairs"]


def test_probes_follow_the_data(spark):
    rng = np.random.default_rng(1)
    places = 10 * rng.normal(size=(25, 8))
    apart = spark.createDataFrame([(i, (places[i % 25] + 0.05 * rng.normal(size=8)).tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    shapeless = spark.createDataFrame([(i, rng.normal(size=48).tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    few, many = (vi.build_index(df) for df in (apart, shapeless))
    assert few.probes <= 8 < many.probes
    assert vi.scanned_pairs(few, queries(apart)) < 0.25 * 25 * 1500
