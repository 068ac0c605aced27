"""Substring search by character grams equals plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from halyard.operators import gram_index as gi
from halyard.plans import registry_text as rt
from tests.conftest import SF_SMALL


def built(spark, docs, folder):
    gi.postings(docs).write.partitionBy("shard").parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    return gi.GramIndex(postings, gi.sizes(postings))


def plain(docs, queries, k):
    out = set()
    for q in {q for q, _ in queries}:
        hits = sorted(i for text in [t for n, t in queries if n == q and t] for i, d in docs if i is not None and text.lower() in (d or "").lower())
        out |= {(q, i, r + 1) for r, i in enumerate(hits[:k])}
    return out


@pytest.mark.parametrize("rows", [0, gi.BROADCAST_ROWS])
def test_equals_containment(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(gi, "BROADCAST_ROWS", rows)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abAB é漢🙂.") for _ in range(rng.randint(0, 12)))
    docs = [(k, word() + word()) for k in range(300)] + [(300, None), (301, ""), (7, "ab ab"), (None, "ab"), (302, "x" * 5000 + "needle" + "y" * 5000)]
    queries = [(k, word()[: rng.randint(0, 5)]) for k in range(120)] + [(200, None), (201, ""), (202, "NEEDLE"), (203, "zzz"), (204, "ab"), (204, "a"), (205, "🙂"), (206, "yyyx")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    index = built(spark, d, tmp_path)
    for k in (1, 4):
        got = [tuple(r) for r in gi.substring_search(index, d, q, k=k).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(docs, queries, k)


def test_empty_tables(spark, tmp_path):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, query string")
    index = built(spark, d.union(spark.createDataFrame([(1, "b")], d.schema)), tmp_path)
    assert gi.substring_search(index, d, q).count() == 0 and gi.substring_search(index, d, q.limit(0)).count() == 0


def test_few_postings_and_texts_are_read(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    index = built(spark, docs, tmp_path)
    asked = rt._bench_queries(spark, SF_SMALL).select(F.lower("query").alias("__text")).distinct().withColumn("__query", F.unhex(F.sha2("__text", 256)))
    wanted = gi._wanted(index, asked)
    read = wanted.join(index.sizes, "gram").agg(F.sum("n")).first()[0] or 0
    assert read < 0.2 * index.postings.count()
    assert gi.candidates(index, asked).count() < 0.05 * asked.count() * docs.count()
    plan = rt.b29_substring_search(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grams_of_a_text_and_of_a_query():
    """Numbers tell characters and lengths apart, beyond the first plane too."""
    runs = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    for text in ("", "a", "ab", "aaaa", "é漢🙂.🙂", "\x00a\x00", "abcabc"):
        assert len(gi.codes(text)) == len(runs(text)) and set(gi.codes(text)) == {int(gi.codes(r, query=True)[-1]) for r in runs(text)}
        assert len(gi.codes(text, query=True)) == len({r for r in runs(text) if len(r) == min(3, len(text))})


def test_postings_are_made_in_all_tasks(spark):
    """A text table of one file was one task's work."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string").coalesce(1)
    assert gi.postings(docs).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
