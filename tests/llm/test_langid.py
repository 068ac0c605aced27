import zlib

import numpy as np
import pytest

from halyard.llm import langid
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    return docs, langid.fit(docs)


def test_held_out_accuracy(trained):
    docs, model = trained
    rows = langid.identify(docs, model, ["doc_id", "lang"]).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == docs.count()


def test_every_byte_is_labelled(trained):
    docs, model = trained
    rows = langid.identify(docs, model, ["doc_id", "text"]).collect()
    assert all(sum(r["positions"]) >= len(r["text"].encode()) for r in rows if r["lang_pred"] != "und")


def test_gradients():
    rng = np.random.default_rng(0)
    model = langid.train([b"abcd efgh", b"zyxw vuts"], ["a", "b"], updates=0, hidden=3)
    for name in ("x", "h", "o", "b"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    steps = langid.windows(b"abcd efgh zyxw").T.astype(np.intp)[:12]
    steps = np.concatenate((steps, rng.integers(97, 122, (12, 2))), axis=1)
    target = np.array([0, 1, 1])

    def loss():
        p = langid.probabilities(model, langid.states(model, steps).astype(np.float64))
        return -np.log(p[:, target, np.arange(3)]).mean()

    exact = langid._gradients(model, steps, target)
    for weights, gradient in zip((model.x, model.h, model.o, model.b), exact):
        for at in list(zip(*np.nonzero(gradient)))[:: max(1, np.count_nonzero(gradient) // 12)]:
            old, step = weights[at], 1e-2
            weights[at] = old + step
            up = loss()
            weights[at] = old - step
            down = loss()
            weights[at] = old
            assert abs((up - down) / (2 * step) - gradient[at]) < 2e-3


def test_same_rows_same_model(trained):
    docs, model = trained
    again = langid.fit(docs)
    assert all((a == b).all() for a, b in ((model.x, again.x), (model.h, again.h), (model.o, again.o)))


def test_unknown_rows(trained, odd):
    _, model = trained
    rows = {r["doc_id"]: r for r in langid.identify(odd, model, ["doc_id"]).collect()}
    assert [rows[d]["lang_pred"] for d in (1, 2, 3, 7)] == ["und"] * 4 and rows[1]["score"] == 0
    assert rows[9]["lang_pred"] in model.languages


def test_nothing_learned(odd, empty):
    model = langid.fit(empty)
    assert model.languages == [] and langid.identify(empty, model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, model, ["doc_id"]).collect()} == {"und"}
    one = langid.fit(odd.filter("lang = 'en' or lang is null"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, one, ["doc_id"]).collect()}
    assert got[10] == ("en", 1.0) and got[7] == ("und", 0.0)


def test_stage_keeps_clean_rows(trained):
    docs, _ = trained
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.999 * docs.count()


def test_stage_rejects_unknown_rows(odd):
    clash = odd.withColumnRenamed("source", "score").withColumnRenamed("n_chars", "lang_pred")
    kept = langid.keep_identified(clash)
    assert kept.columns == clash.columns
    assert not {1, 2, 3, 7} & {r["doc_id"] for r in kept.collect()}


def test_held_out_rows_never_teach(trained):
    docs, _ = trained
    assert all(zlib.crc32(str(r["id"]).encode()) % 4 != 2 for r in langid.sample(docs).select("id").collect())
