import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import resample
from halyard.llm.queries import op12_resampling
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.conftest import DOCS, as_files

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, share=5, min_words=20):
    """[(id, n_features, weight, score, rank)] of (id, text) rows, by plain strings."""
    s, t = np.zeros(10000, np.int64), np.zeros(10000, np.int64)
    features = [plain_buckets(x) for _, x in docs]
    for f in features:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, plain_buckets(x), 1)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (S + 10000) / ((int(s[b]) + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for (i, x), f in zip(docs, features):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x)) >= min_words])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_whole_tables(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = got(op12_resampling(spark, sf))
    assert rows == brute(docs, target) and any(r[4] for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abAB zé漢🙂.-\x00\x7f\n09", max_size=60), max_size=6), st.booleans())
def test_payloads_compose_to_the_crc_of_the_text(texts, known):
    words = sorted({w.encode() for t in texts for w in plain_words(t)}) if known else [b"a", b"b"]
    found = [[] for _ in texts]
    for bucket, of in resample.Words([t.encode() for t in texts], resample.build_dictionary(words)).buckets():
        for b, k in zip(bucket.tolist(), of.tolist()):
            found[k].append(b)
    assert [sorted(f) for f in found] == [sorted(plain_buckets(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.one_of(st.binary(max_size=300), st.integers(0, 200_000).map(lambda n: b"q" * n)))
def test_joined_crc(a, b):
    crc = resample.join_crc(*(np.array([zlib.crc32(x)], np.uint32) for x in (a, b)), np.array([len(b)], np.int64))
    assert int(crc[0]) == zlib.crc32(a + b)


def test_the_dictionary_decides_no_result(spark, tmp_path, odd):
    target = as_files(spark, tmp_path, [(1, "one two three four")], "item_id long, text string", "t")
    results = [got(resample.resample(odd, target, words=w, min_words=1, share=50)) for w in ([], [b"one", b"two"], None)]
    assert results[0] == results[1] == results[2]


def test_awkward_rows(spark, tmp_path, odd, odd_rows, empty):
    target = as_files(spark, tmp_path, [(1, "one two three four"), (2, None), (3, "")], "item_id long, text string", "t")
    plain = [(r[0], r[1]) for r in odd_rows]
    rows = got(resample.resample(odd, target, min_words=5, share=60))
    assert rows == brute(plain, ["one two three four", None, ""], 60, 5)
    none = target.limit(0)
    assert got(resample.resample(odd, none)) == brute(plain, [])
    assert resample.resample(empty, target).count() == 0
    clash = odd.withColumnRenamed("lang", "score").withColumnRenamed("source", "__id").withColumnRenamed("n_chars", "rank")
    assert got(resample.resample(clash, target, min_words=5, share=60)) == rows


def test_portions_are_bounded_by_bytes_and_lose_nothing(spark, tmp_path, odd, odd_rows, monkeypatch):
    import pyarrow as pa

    texts = [r[1] for r in odd_rows]
    monkeypatch.setattr(resample, "PORTION", 50)
    parts = list(resample.portions(pa.array(texts)))
    assert [t for _, p in parts for t in p] == [(t or "").encode() for t in texts]
    assert [first for first, _ in parts] == np.cumsum([0] + [len(p) for _, p in parts[:-1]]).tolist()


def test_the_draw_prefers_the_target(spark, tmp_path):
    rows = [(k, " ".join(["red", "green", "blue"] * 10 if k % 10 == 0 else [f"w{k}x{j}" for j in range(30)]), "en", "s", 1) for k in range(400)]
    docs = as_files(spark, tmp_path, rows, DOCS, "d")
    target = as_files(spark, tmp_path, [(1, " ".join(["red green blue"] * 2000))], "item_id long, text string", "t")
    drawn = resample.draw(docs, target)
    assert drawn.count() == 20 and drawn.columns == docs.columns and all(r["doc_id"] % 10 == 0 for r in drawn.collect())
