"""Registered feedback, text and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.functions import text as tx
from halyard.functions.numeric import rnd
from halyard.operators import impact_search as im
from halyard.operators import gram_index as gi
from halyard.operators import label_codes as lc
from halyard.operators import search as se
from halyard.operators import sentiment as st
from halyard.operators import vector_index as vi
from halyard.plans import adapters as ad
from halyard.plans.materialize import materialized
from halyard.session import drop_path
from halyard.sources.io import read_table

# Data-fitted lexicons: common words of the test corpus, used to exercise
# every branch of the word-count scorer (the default lexicons rarely hit).
DATA_POSITIVE = ("the", "and", "with", "for")
DATA_NEGATIVE = ("of", "to", "is", "was")
ID_LIST_TEXT = " 10, 20,,30 \n abc\n 999999999 ,7,\n"
TOP_K = 10


def _fb(spark, d):
    return ad.feedback(spark, d)


def _r6(df, cols):
    return df.withColumns({c: rnd(c, 6) for c in cols})


def b27_sentiment_from_score(spark, d):
    return _fb(spark, d).select("feedback_id", "sentiment_score", "sentiment_label")


def b28_filter_feedback(spark, d):
    fb = _fb(spark, d).filter((F.col("sentiment_label") == "negative") & (F.col("category") == "en"))
    return fb.select("feedback_id", "category", "channel", "sentiment_label")


def _bench_queries(spark, d):
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def b29_substring_search(spark, d):
    docs = read_table(spark, d, "documents")
    postings = materialized(spark, "gram_postings", d, lambda: gi.postings(docs).hint("rebalance", "shard"), ["shard"])
    index = gi.GramIndex(postings, materialized(spark, "gram_sizes", d, lambda: gi.sizes(postings)))
    return gi.substring_search(index, docs, _bench_queries(spark, d), k=5)


def d20_sentiment_distribution(spark, d):
    return st.sentiment_distribution(_fb(spark, d))


def d21_sentiment_by_segment(spark, d):
    return st.sentiment_by_segment(_fb(spark, d), "category")


def d21b_sentiment_by_channel(spark, d):
    return st.sentiment_by_segment(_fb(spark, d), "channel")


def d22_feedback_counts(spark, d):
    fb = _fb(spark, d)
    a = st.feedback_counts(fb, "category").select(F.lit("category").alias("dimension"), F.col("category").alias("value"), "count")
    b = st.feedback_counts(fb, "channel").select(F.lit("channel").alias("dimension"), F.col("channel").alias("value"), "count")
    return a.unionByName(b)


def _fb_timeline(spark, d):
    return st.sentiment_timeline(_fb(spark, d), "W")


def d23_nlp_stats(spark, d):
    fb = _fb(spark, d)
    return st.stats_entries(st.nlp_stats(fb, st.sentiment_timeline(fb, "W"), se.index_stats(fb)))


def d24_recent_negative_pct(spark, d):
    return st.recent_negative_pct(_fb(spark, d), 30)


TL_FLOATS = ("positive_pct", "negative_pct", "neutral_pct", "avg_score", "net_sentiment", "trend")


def d25_sentiment_timeline(spark, d):
    return _r6(_fb_timeline(spark, d), TL_FLOATS)


def d25b_sentiment_timeline_monthly(spark, d):
    return _r6(st.sentiment_timeline(_fb(spark, d), "M"), TL_FLOATS)


def e01_rolling_mean(spark, d):
    ev = ad.event_sentiment(spark, d).withColumnRenamed("ts", "created_at")
    tl = st.sentiment_timeline(ev, "D")
    return _r6(tl.select("period", "net_sentiment", "trend", "total_count"), ("net_sentiment", "trend"))


def d26_detect_trend(spark, d):
    return st.detect_trend(_fb_timeline(spark, d))


def d34_text_uniqueness(spark, d):
    return se.text_uniqueness(read_table(spark, d, "documents"))


def f07_order_by_time(spark, d):
    return _fb(spark, d).select("feedback_id", "created_at").orderBy("created_at", "feedback_id")


def g02_dedup_text(spark, d):
    return se.dedup_text(read_table(spark, d, "documents"))


def h01_parse_id_list(spark, d):
    """Pasted ids (one per line or comma-separated) -> trimmed, non-empty
    tokens in input order, each matched against the customer table."""
    cust = read_table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.lit(True).alias("found"))
    toks = spark.range(1).select(F.posexplode(F.split(F.lit(ID_LIST_TEXT), "[\n,]")).alias("position", "token"))
    toks = toks.select("position", F.trim("token").alias("token")).filter(F.col("token") != "")
    ids = toks.withColumn("customer_id", F.col("token").try_cast("bigint"))
    out = ids.join(cust, "customer_id", "left")
    return out.select("position", "token", "customer_id", F.coalesce("found", F.lit(False)).alias("found"))


def h02_to_metadata_map(spark, d):
    fb = _fb(spark, d)
    meta = ["category", "channel", "sentiment_label", "created_at", "sentiment_score"]
    entries = [F.struct(F.lit(c).alias("k"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in meta]
    held = fb.select("feedback_id", F.map_from_entries(F.array(*entries)).alias("metadata"))
    return held.select("feedback_id", F.explode("metadata").alias("key", "value"))


def b07b_label_codes(spark, d):
    """Text columns that no rule names, by their stored dictionary."""
    fb = _fb(spark, d)
    columns = lc.text_columns(fb, ("feedback_text",))
    codes = materialized(spark, "feedback_codes", d, lambda: lc.fit_codes(fb, columns))
    return lc.encode_labels(fb, codes, columns).select("feedback_id", *[f"{c}_code" for c in columns])


def _lex(spark, d, pos, neg):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return st.lexicon_scores(docs, "text", pos, neg).select("doc_id", "label", "score", "n_pos", "n_neg")


def j01_lexicon_sentiment(spark, d):
    return _lex(spark, d, tx.POSITIVE_WORDS, tx.NEGATIVE_WORDS)


def j01b_lexicon_sentiment_data_words(spark, d):
    return _lex(spark, d, DATA_POSITIVE, DATA_NEGATIVE)


def j02_label_from_compound(spark, d):
    return ad.event_sentiment(spark, d).select("event_id", "sentiment_score", "sentiment_label", "label_score")


def j03_expand_confidence(spark, d):
    fb = _fb(spark, d)
    conf = F.lit(0.5) + F.abs("sentiment_score") / 2
    s = tx.expand_confidence(F.col("sentiment_label"), conf)
    return fb.select("feedback_id", "sentiment_label", rnd(s.getField("positive"), 6).alias("p_positive"),
                     rnd(s.getField("neutral"), 6).alias("p_neutral"), rnd(s.getField("negative"), 6).alias("p_negative"))


def j04_score_feedback(spark, d):
    fb = _fb(spark, d)
    labels = read_table(spark, d, "labels").select(F.col("doc_id").alias("feedback_id"), F.lit(True).alias("_lab"))
    j = fb.join(labels, "feedback_id", "left")
    j = j.withColumns({
        "existing_label": F.when(F.col("_lab"), F.col("sentiment_label")),
        "existing_score": F.when(F.col("_lab"), F.abs("sentiment_score")),
    }).drop("sentiment_label")
    out = st.score_feedback(j)
    return out.select("feedback_id", "sentiment_label", "sentiment_confidence", "was_scored")


def _index(spark, d):
    """The TF-IDF index, built once per session (one tokenising pass) and
    stored in the shared folder; the vocabulary is read back from the
    stored postings and searches read the stored index."""
    scratch: list[str] = []
    postings = materialized(spark, "tfidf_postings", d,
                            lambda: se.tfidf_index(read_table(spark, d, "documents"), scratch=scratch)[0])
    for path in scratch:
        drop_path(spark, path)
    vocab = materialized(spark, "tfidf_vocab", d, lambda: se.vocab_from_postings(postings))
    return postings, vocab


def j05_tfidf_index(spark, d):
    postings, _ = _index(spark, d)
    return postings.select("doc_id", "term", rnd("weight", 6).alias("weight"))


def _impact(spark, d):
    """The index by impact and by document, stored once per session from the
    stored postings."""
    postings, vocab = _index(spark, d)
    shards = im.shard_count(postings)
    impact = materialized(spark, "tfidf_impact", d, lambda: im.by_impact(postings, shards, large=im.large_terms(vocab)), ["shard"])
    levels = materialized(spark, "tfidf_levels", d, lambda: im.level_bounds(impact))
    documents = materialized(spark, "tfidf_documents", d, lambda: im.by_document(postings, shards), ["id_shard"])
    return im.ImpactIndex(impact, levels, documents, vocab, shards)


def j06_tfidf_search(spark, d):
    return im.pruned_search(_impact(spark, d), _bench_queries(spark, d), k=TOP_K)


def j06b_tfidf_search_filtered(spark, d):
    docs = read_table(spark, d, "documents")
    return im.pruned_search(_impact(spark, d), _bench_queries(spark, d), k=TOP_K, docs=docs, filters={"lang": "en"})


def j06c_search_hits(spark, d):
    """Hits with the document's own fields: text, customer, category,
    channel, sentiment label and time."""
    fb = _fb(spark, d).withColumnRenamed("feedback_id", "doc_id")
    fields = ["feedback_text", "customer_id", "category", "channel", "sentiment_label", "sentiment_score", "created_at"]
    return im.pruned_search(_impact(spark, d), _bench_queries(spark, d), k=5, docs=fb, filters={"sentiment_label": "negative"}, fields=fields)


def _centroid_queries(spark, d):
    emb = read_table(spark, d, "embeddings")
    return se.centroids(emb, "label").select(F.col("label").alias("query_id"), F.col("embedding").alias("query_vector"))


def j07_vector_search(spark, d):
    return se.vector_search(read_table(spark, d, "embeddings"), _centroid_queries(spark, d), k=TOP_K)


def j07b_vector_search_filtered(spark, d):
    """Exact cosine top-k restricted by a metadata equality filter."""
    return se.vector_search(read_table(spark, d, "embeddings"), _centroid_queries(spark, d), k=TOP_K,
                            filters={"label": 3})


def j08_ann_search(spark, d):
    return vi.search(vi.build_index(read_table(spark, d, "embeddings")), _centroid_queries(spark, d), k=TOP_K)


def j09_index_stats(spark, d):
    return se.index_stats(read_table(spark, d, "embeddings"))


QUERIES = {name: fn for name, fn in list(globals().items())
           if callable(fn) and name[:1] in "bdefghj" and name[1:3].isdigit()}
