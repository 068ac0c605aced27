"""The search that stops reading has the rows of the one that reads all."""

import random

import pytest
from pyspark.sql import functions as F

from halyard.operators import impact_search as im
from halyard.operators import search as se
from halyard.plans import registry_text as rt
from halyard.sources.io import read_table
from tests.conftest import SF_MID


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "similarity_score", "rank").collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Zipf-like words, copies, and near copies of the queries."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    draw = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=n))
    texts = [draw(rng.randint(1, 60)) for _ in range(1500)]
    texts += texts[:40] + [None, "", "the of and", "w0 " * 500]
    queries = [(i, texts[i * 31][: 30 + 20 * i]) for i in range(12)] + [(90, "w0"), (91, "w399 w398"), (92, "unseen"), (93, ""), (94, None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.col("doc_id") % 7)
    postings, vocab = se.tfidf_index(docs)
    return docs, im._kept(postings), im._kept(vocab), spark.createDataFrame(queries, "query_id long, query string")


@pytest.mark.parametrize("first", [1, 8, 64])
def test_same_rows_as_reading_everything(corpus, first):
    docs, postings, vocab, queries = corpus
    index = im.build_index(postings, vocab, first=first)
    for k in (1, 10):
        assert rows(im.pruned_search(index, queries, k)) == rows(se.tfidf_search(postings, vocab, queries, k))
    found = im.pruned_search(index, queries, 5, docs=docs, filters={"kind": 3})
    assert rows(found) == rows(se.tfidf_search(postings, vocab, queries, 5, docs=docs, filters={"kind": 3}))


def test_levels_double_and_bound_their_weights(corpus):
    _, postings, vocab, _ = corpus
    index = im.build_index(postings, vocab, first=4)
    levels = {(r["term"], r["level"]): r for r in index.levels.collect()}
    assert index.impact.count() == postings.count() == index.levels.agg(F.sum("n")).first()[0]
    for (term, level), r in levels.items():
        following = levels.get((term, level + 1))
        assert r["n"] <= 4 << level and r["below"] == (following["top"] if following else 0.0) and r["top"] >= r["below"]
        assert following is None or r["n"] == 4 << level


def test_fields_of_the_document(corpus):
    docs, postings, vocab, queries = corpus
    index = im.build_index(postings, vocab)
    hits = im.pruned_search(index, queries, 3, docs=docs, fields=["text", "kind"])
    assert hits.columns == ["query_id", "doc_id", "similarity_score", "rank", "text", "kind"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] and r["kind"] == r["doc_id"] % 7 for r in hits.collect())


def test_reads_a_small_part_of_the_index(spark):
    index = rt._impact(spark, SF_MID)
    queries = read_table(spark, SF_MID, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits, plan = im.search_with_plan(index, queries, 10)
    cost = im.search_cost(plan).agg(F.avg("n_read").alias("read"), F.avg("n_postings").alias("all"), F.count("*").alias("n")).first()
    total = index.impact.count()
    print(cost, total)
    assert cost["n"] == queries.count() and cost["read"] < 0.05 * total and cost["read"] < 0.8 * cost["all"]
    assert hits.count() > 0


def test_stored_steps_drop_their_shuffles_and_make_no_checkpoint(corpus, spark):
    """Each step of the index left its shuffles on disk, and the terms a checkpoint of a row per posting."""
    import pathlib

    from halyard.session import SHUFFLE_CLEANUP, checkpoint_dir, shuffles_dropped

    rdds = lambda: set(pathlib.Path(checkpoint_dir(spark).removeprefix("file:")).glob("rdd-*"))
    setting = lambda: spark.conf.get(SHUFFLE_CLEANUP, "false")
    before, seen = rdds(), []
    se.tfidf_index(corpus[0])
    assert rdds() == before

    class Rows:
        sparkSession = spark
        write = property(lambda self: seen.append(setting()) or spark.range(1).write)

    im._kept(Rows())
    assert seen == ["true"] and setting() == "false"
    with pytest.raises(ValueError), shuffles_dropped(spark):
        raise ValueError
    assert setting() == "false"


def test_more_text_makes_more_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * 50) for k in range(100)], "doc_id long, text string")
    monkeypatch.setattr(se, "TASK_CHARS", 250)
    assert se.by_document(docs, "doc_id").rdd.getNumPartitions() == 100


def test_documents_are_whole_in_one_shard(corpus):
    _, postings, _, _ = corpus
    rows = im.by_document(postings, 16)
    assert rows.count() == rows.select("doc_id").distinct().count()
    assert rows.select(F.sum(F.size("terms"))).first()[0] == postings.count()
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_postings_move_once_to_terms_and_once_to_shards(corpus, spark, tmp_path):
    """Weights took two shuffles of all postings at once, the impact table three more and their terms' ranges."""
    import pathlib

    scratch = []
    postings, vocab = se.tfidf_index(corpus[0], scratch=scratch)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan(postings) and "Window" not in plan(postings)
    assert len(scratch) == 2 and all(pathlib.Path(p.removeprefix("file:")).exists() for p in scratch)
    kept = im._kept(postings)
    layout = im.by_impact(kept, 16, large=[])
    assert plan(layout).count("hashpartitioning") == 1 and "rangepartitioning" not in plan(layout)
    # by documents that aren't broadcast, and without an id
    docs = spark.createDataFrame([(1, "red car blue car"), (1, "blue bird"), (None, "blue sky red"), (None, "bird"), (2, ""), (3, None)], "doc_id long, text string")
    found = lambda: sorted((r["doc_id"] or 0, r["term"], round(r["weight"], 12)) for r in se.tfidf_index(docs)[0].collect())
    some, keep = found(), se.BROADCAST_NORMS
    try:
        se.BROADCAST_NORMS = 0
        assert found() == some
    finally:
        se.BROADCAST_NORMS = keep
    for d in (0, 1):
        assert sum(w * w for i, _, w in some if i == d) == pytest.approx(1)


def test_large_terms_are_ranked_by_ranges_as_others_are(corpus, monkeypatch):
    _, postings, _, _ = corpus
    every = sorted(map(tuple, im.by_impact(postings, 16).collect()))
    assert every == sorted(map(tuple, im.by_impact(postings, 16, large=["w0", "w1", "w0 w0"]).collect()))
    monkeypatch.setattr(im, "SHARD_POSTINGS", 500)
    large = im.large_terms(postings.groupBy("term").agg(F.count("*").alias("df")))
    assert "w0" in large and len(large) < 20 and every == sorted(map(tuple, im.by_impact(postings, 16).collect()))


def test_a_search_shuffles_no_index(corpus, monkeypatch):
    """The index, and the texts of `fields`, were shuffled whole for a few rows of queries."""
    docs, postings, vocab, queries = corpus
    index, seen = im.build_index(postings, vocab), []
    kept = im._kept

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(im, "_kept", noted)
    hits = im.pruned_search(index, queries, 3, docs=docs, filters={"kind": 3}, fields=["text"])
    seen.append(hits._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in seen for line in plan.split("\n") if "SortMergeJoin" in line]
    assert not any("shard" in line for line in joins) and any("BroadcastHashJoin [shard" in plan for plan in seen)
    assert any("LeftSemi, BuildRight" in plan for plan in seen)
    some = sorted(map(tuple, hits.collect()))
    monkeypatch.setattr(im, "BROADCAST_ROWS", 0)
    assert some == sorted(map(tuple, im.pruned_search(index, queries, 3, docs=docs, filters={"kind": 3}, fields=["text"]).collect()))
