import random

import numpy as np
import pytest

from halyard.llm import decontam
from tests.llm.conftest import DOCS, as_files
from tests.conftest import SF_SMALL


def plain_distance(item, words):
    """Least edit distance of the item to any stretch, by the textbook table, a row at a time."""
    code = {}
    number = lambda seq: np.array([code.setdefault(w, len(code)) for w in seq], np.int64)
    a, b = number(item), number(words)
    at = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for i, x in enumerate(a, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (b != x))))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def brute(docs, items):
    return {
        (d, i)
        for d, t in docs
        for i, x in items
        if (w := decontam.words_of(x)) and plain_distance(w, decontam.words_of(t)) <= decontam.edit_limit(len(w))
    }


def test_equals_all_pairs(spark, small_docs):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(small_docs, items, ["doc_id"]).collect()}
    docs = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    expected = brute(docs, [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == expected and expected


@pytest.fixture(scope="module")
def edited():
    """Texts that hold an item with up to the limit of word edits."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(6, 60))) for _ in range(60)]
    texts, truth = [], []
    for _ in range(400):
        i = rng.randrange(len(items))
        words = items[i].split()
        for _ in range(rng.randint(0, decontam.edit_limit(len(words)))):
            at, kind = rng.randrange(max(1, len(words))), rng.random()
            if kind < 0.34:
                words[at] = "other"
            elif kind < 0.67:
                words.insert(at, rng.choice(vocabulary))
            else:
                del words[at]
        around = rng.choices(vocabulary, k=rng.randint(0, 200))
        at = rng.randint(0, len(around))
        texts.append(" ".join(around[:at] + words + around[at:]))
        truth.append(i)
    return items, texts, truth


def test_recall_reaches_the_target(edited):
    items, texts, truth = edited
    index = decontam.build_index(list(range(len(items))), items)
    found = {(a, b) for a, b, *_ in decontam.find(index, texts)}
    assert set(index.recalls) == {len(x.split()) for x in items} and min(index.recalls.values()) >= decontam.RECALL
    assert np.mean([(k, i) in found for k, i in enumerate(truth)]) >= 0.98
    exact = {(k, i) for k, t in enumerate(texts[:60]) for i, x in enumerate(items) if plain_distance(x.split(), t.split()) <= decontam.edit_limit(len(x.split()))}
    assert {f for f in found if f[0] < 60} <= exact


def test_every_length_reaches_the_target(edited):
    """Recall by item length, not on average over lengths."""
    rng, words = random.Random(8), [f"v{k}" for k in range(500)]
    for n in (5, 9, 10, 15, 24, 25, 40, 90):
        items = [" ".join(rng.choices(words, k=n)) for _ in range(5)]
        index = decontam.build_index(list(range(5)), items)
        texts = []
        for k in range(200):
            copy = items[k % 5].split()
            for at in rng.sample(range(n), decontam.edit_limit(n)):
                copy[at] = "other"
            texts.append(" ".join(rng.choices(words, k=30) + copy + rng.choices(words, k=30)))
        found = {(a, b) for a, b, *_ in decontam.find(index, texts)}
        assert np.mean([(k, k % 5) in found for k in range(200)]) >= 0.97, n


def test_sizes_beyond_the_repetitions_lose_nothing(edited, monkeypatch):
    items, texts, _ = edited
    monkeypatch.setattr(decontam, "MAX_REPETITIONS", 2)
    index = decontam.build_index(list(range(len(items))), items)
    assert 0 in index.repetitions.values()
    found = {(a, b) for a, b, *_ in decontam.find(index, texts[:80])}
    unsampled = {n for n, r in index.repetitions.items() if not r}
    exact = {(k, i) for k, t in enumerate(texts[:80]) for i, x in enumerate(items) if plain_distance(x.split(), t.split()) <= decontam.edit_limit(len(x.split()))}
    assert {(k, i) for k, i in exact if len(items[i].split()) in unsampled} <= found <= exact


def test_gram_keys_of_any_vocabulary():
    ids = np.array([5, 3_000_000, 7_000_000, 5, 3_000_000, 7_000_000, 1])
    keys = decontam.gram_keys(ids, 3)
    assert keys[0] == keys[3] and len(set(keys.tolist())) == 4 and len(decontam.gram_keys(ids, 8)) == 0


def test_stretch_is_exact(edited):
    items, texts, _ = edited
    code = {}
    number = lambda words: np.array([code.setdefault(w, len(code)) for w in words])
    for text, item in zip(texts[:40], items):
        a, b = number(item.split()), number(text.split())
        distance, begin, end = decontam.best_stretch(a, b)
        assert distance == plain_distance(a.tolist(), b.tolist())
        assert plain_distance(a.tolist(), b[begin:end].tolist()) == distance


def test_walk_keeps_equal_strings_equal():
    rows = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 9, 4]])
    out = decontam.walk(rows, 7)
    assert (out[0] == out[1]).all() and (out[0] != out[2]).any() and out.shape == (3, 12)


ITEM = "the quick brown fox jumps over the lazy dog near the river bank"


def test_awkward_rows(spark, tmp_path, odd, empty):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "!!"), (5, ITEM), (None, "one two three four five six seven")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.contamination(odd, items, ["doc_id"]).collect()), key=str)
    assert got == sorted([(4, None), (4, None), (None, None), (5, None)], key=str)
    assert decontam.contamination(empty, items, ["doc_id"]).count() == 0
    assert decontam.contamination(odd, items.limit(0), ["doc_id"]).count() == 0
    assert decontam.drop_contaminated(odd, items).count() == odd.count() - 4


def test_short_items_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a rare token here"), (2, "nothing"), (3, "rare token " * 500)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Rare Token")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.contamination(docs, items, ["doc_id"]).collect()) == [1, 3]


def test_blocks_of_items(spark, small_docs, monkeypatch):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    whole = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contamination(small_docs, items, ["doc_id"]).collect()}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 15)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contamination(small_docs, items, ["doc_id"]).collect()} == whole


def test_stage_and_clashing_names(spark, tmp_path):
    rows = [(1, f"before {ITEM} after", "en", "x", 1), (2, "clean text of another kind", "en", "x", 1), (3, ITEM.replace("lazy", "sleepy").upper(), "en", "x", 1)]
    docs = as_files(spark, tmp_path, rows, DOCS, "d").withColumnRenamed("source", "item_id")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
