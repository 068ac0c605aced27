import zlib

import numpy as np
import pytest

from halyard.llm import quality
from halyard.llm.queries import op1_quality
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def scored(spark):
    return op1_quality(spark, SF_MID).collect()


def test_held_out_accuracy(spark, scored):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    held = [r for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    assert len(scored) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()


def test_neighbour_sums_equal_plain_counts(spark):
    texts = ["a b c a b", "c b", None, "", "alone"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    places, signs = quality._index_vectors()
    plain = np.zeros((quality.WORDS, quality.SIZE))
    row = lambda w: zlib.crc32(w.encode()) % quality.WORDS
    for t in texts:
        words = (t or "").split()
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if 0 < abs(i - j) <= quality.REACH:
                    for k in range(quality.SPARSE):
                        plain[row(a), places[row(b), k]] += signs[row(b), k]
    used = plain.any(axis=1)
    plain[used] /= np.linalg.norm(plain[used], axis=1, keepdims=True)
    plain[used] -= plain[used].mean(axis=0)
    plain[used] /= np.linalg.norm(plain[used], axis=1, keepdims=True)
    assert np.allclose(quality.word_vectors(docs), plain, atol=1e-5)


def test_pooling_equals_plain_statistics():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(quality.WORDS, quality.SIZE)).astype(np.float32)
    texts = ["one two three two", "", "x", "*** &&& one"]
    for got, text in zip(quality.pooled(vectors, texts), texts):
        x = vectors[[zlib.crc32(w.encode()) % quality.WORDS for w in text.split()]]
        if not len(x):
            assert not got.any()
            continue
        near = (x[:-1] * x[1:]).sum(axis=1).mean() if len(x) > 1 else 0
        assert np.allclose(got, [*x.mean(axis=0), *x.std(axis=0), near, np.log1p(len(x))], atol=2e-3)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    p = quality.train(x[:3000], y[:3000]).scores(x[3000:])
    for low in (0.1, 0.3, 0.5, 0.7):
        inside = (p >= low) & (p < low + 0.2)
        assert abs(y[3000:][inside].mean() - p[inside].mean()) < 0.12


def test_awkward_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(odd, none)
    assert {r["score"] for r in quality.score(odd, model, ["doc_id"]).collect()} == {0.5}
    one = quality.fit(odd, spark.createDataFrame([(4, 1), (8, 1), (None, 0), (9, None)], "doc_id long, quality int"))
    assert all(r["score"] > 0.99 for r in quality.score(odd, one, ["doc_id"]).collect())
    both = quality.fit(odd, spark.createDataFrame([(4, 1), (8, 1), (10, 0), (5, 0)], "doc_id long, quality int"))
    rows = quality.score(odd.withColumnRenamed("source", "score"), both, ["doc_id"]).collect()
    assert len(rows) == odd.count() and len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.score(empty, quality.fit(empty, none), ["doc_id"]).count() == 0


def test_held_out_rows_never_teach(spark):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    assert all(zlib.crc32(str(r["id"]).encode()) % 4 != 2 for r in quality.sample_ids(labels, "doc_id", "quality").collect())
