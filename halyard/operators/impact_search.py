"""TF-IDF search that stops reading (J6): postings by term and impact, in levels
with an upper bound each, and a read plan that leaves out every level that
can't hold a result.

Layout. A term's postings are ordered by weight, highest first, and cut into
levels of `FIRST`, 2 `FIRST`, 4 `FIRST`, ... postings, so that even a term of a
billion documents has some twenty levels. `levels` keeps the highest weight of
each. A second copy of the postings has one row per document. Both are stored
in shards (of the term, of the document), which Spark prunes at run time.

Search. The first level of each query term gives some good documents; their
whole scores give a threshold: the k-th best score can't be lower. If all levels
of a query with a bound over some value are read, a document that appears in
none of them scores at most the sum, over the terms, of the highest bound left.
So levels are read by falling bound until that sum is below a share of the
threshold. A document that was met is completed from its own row only if what
is left for its missing terms could still lift it to the threshold.

The result is that of scoring every posting. All steps are joins, aggregates
and windows over a query's levels; nothing is collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.functions.numeric import rnd
from halyard.operators.ranking import with_position
from halyard.operators.search import term_frequencies
from halyard.session import scratch_path, shuffles_dropped

#: Postings in a term's first level; each further one is twice as long.
FIRST = 64
#: Postings a shard, and the least number of shards.
SHARD_POSTINGS, MIN_SHARDS = 1 << 22, 16
#: Documents of the first levels that are scored whole, as a multiple of k.
SEEDS = 2
#: Reading ends when what is left unread is below this share of the threshold: the less
#: is left, the fewer documents are still open and have to be completed.
STOP = 0.5
#: Rows of queries' levels, documents or hits that are broadcast, some 20 MB.
BROADCAST_ROWS = 200_000
#: Scores are compared to nine digits, so bounds keep this distance.
SLACK = 1e-8


def _kept(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: it is used more than once."""
    path = scratch_path(df.sparkSession, f"search-{uuid.uuid4().hex}")
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _few(df: DataFrame) -> DataFrame:
    """`df`, written first, as the small side of a join with the index: up to
    BROADCAST_ROWS rows are broadcast. Joined as a plan whose size nobody knows,
    it has the whole index shuffled before it turns out to be small."""
    kept = _kept(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def shard_count(postings: DataFrame) -> int:
    return max(MIN_SHARDS, postings.count() // SHARD_POSTINGS)


def shard_of(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def large_terms(sizes: DataFrame) -> list[str]:
    """Terms of (term, df) with more postings than a shard is meant to have:
    at most one for each SHARD_POSTINGS postings."""
    return [r["term"] for r in sizes.filter(F.col("df") > SHARD_POSTINGS).select("term").collect()]


def by_impact(postings: DataFrame, shards: int, id_col: str = "doc_id", first: int = FIRST, large: list[str] | None = None) -> DataFrame:
    """(shard, term, level, id, weight): store it partitioned by `shard`.
    One shuffle deals the postings to their shards, where each term is ranked
    alone. Ranks of `large` terms (by default the `large_terms` of these
    postings) come from ranges of their postings, so that a term of very many
    documents is sorted in many tasks."""
    rows = postings.select(shard_of("term", shards).alias("shard"), "term", id_col, "weight")
    if large is None:
        large = large_terms(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    level = lambda at: F.floor(F.log2(at / F.lit(float(first)) + 1)).cast("int").alias("level")
    columns = ["shard", "term", "level", id_col, "weight"]
    order = [F.desc("weight"), F.asc(id_col)]
    some = rows.filter(~F.col("term").isin(large)) if large else rows
    ranked = some.repartition("shard").withColumn("_at", F.row_number().over(W.partitionBy("shard", "term").orderBy(*order)) - 1)
    cut = ranked.withColumn("level", level(F.col("_at"))).select(*columns)
    if not large:
        return cut
    placed = with_position(rows.filter(F.col("term").isin(large)), [F.asc("term"), *order], "_at")
    start = placed.groupBy("term").agg(F.min("_at").alias("_start"))  # a row a large term
    return cut.unionByName(placed.join(F.broadcast(start), "term").withColumn("level", level(F.col("_at") - F.col("_start"))).select(*columns))


def by_document(postings: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """(id_shard, id, terms): one row per document with its term weights, to
    be stored partitioned by `id_shard`."""
    # dealt by the shard, which holds its documents whole: one shuffle gathers and lays out
    dealt = postings.select(shard_of(id_col, shards).alias("id_shard"), id_col, "term", "weight").repartition("id_shard")
    rows = dealt.groupBy("id_shard", id_col).agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    return rows.sortWithinPartitions("id_shard", id_col)


def level_bounds(impact: DataFrame) -> DataFrame:
    """(shard, term, level, n, top, below): postings and highest weight of a
    level, and the highest weight under it in its term."""
    x = impact.groupBy("shard", "term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("top"))
    below = F.lead("top", 1, 0.0).over(W.partitionBy("shard", "term").orderBy("level"))  # some twenty rows a term
    return x.withColumn("below", below)


def query_weights(queries: DataFrame, vocab: DataFrame, qid: str, qtext: str, stop_words=None) -> DataFrame:
    """(query, term, wq): the L2-normalised TF-IDF weights of the queries."""
    tf = term_frequencies(queries.select(qid, qtext), qid, qtext, stop_words)
    w = tf.join(vocab.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    return w.select(qid, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(qid)))).alias("wq"))


def read_plan(weights: DataFrame, levels: DataFrame, thresholds: DataFrame, qid: str) -> DataFrame:
    """Every level of every query's terms: its bound, whether it is to be
    `read`, the term's highest bound left unread (`rest`), and the sum of
    these over the query (`left`)."""
    x = weights.join(levels, "term").select(qid, "term", "wq", "shard", "level", "n", (F.col("wq") * F.col("top")).alias("bound"), (F.col("wq") * F.col("below")).alias("next"))
    x = x.join(thresholds, qid, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    whole = F.sum(F.when(F.col("level") == 0, F.col("bound")).otherwise(0.0)).over(W.partitionBy(qid))
    by_bound = W.partitionBy(qid).orderBy(F.desc("bound"), "term", "level").rowsBetween(W.unboundedPreceding, -1)
    open_before = whole - F.coalesce(F.sum(F.col("bound") - F.col("next")).over(by_bound), F.lit(0.0))
    x = x.withColumn("read", open_before >= F.col("threshold") * STOP - SLACK)
    rest = F.coalesce(F.max(F.when(~F.col("read"), F.col("bound"))).over(W.partitionBy(qid, "term")), F.lit(0.0))
    x = x.withColumn("rest", rest)
    return x.withColumn("left", F.sum(F.when(F.col("level") == 0, F.col("rest")).otherwise(0.0)).over(W.partitionBy(qid)))


class ImpactIndex:
    """The stored tables of one index: postings by impact, level bounds, rows
    by document, the vocabulary, and the shards of a document id."""

    def __init__(self, impact: DataFrame, levels: DataFrame, documents: DataFrame, vocab: DataFrame, shards: int, id_col: str = "doc_id"):
        self.impact, self.levels, self.documents, self.vocab, self.shards, self.id_col = impact, levels, documents, vocab, shards, id_col


def build_index(postings: DataFrame, vocab: DataFrame, id_col: str = "doc_id", first: int = FIRST) -> ImpactIndex:
    """An index in the shared folder, from (id, term, weight) postings."""
    spark, shards = postings.sparkSession, shard_count(postings)
    base = scratch_path(spark, f"impact-{uuid.uuid4().hex}")
    with shuffles_dropped(spark):
        by_impact(postings, shards, id_col, first).write.partitionBy("shard").option("compression", "zstd").parquet(f"{base}/impact")
        by_document(postings, shards, id_col).write.partitionBy("id_shard").option("compression", "zstd").parquet(f"{base}/documents")
    impact = spark.read.parquet(f"{base}/impact")
    level_bounds(impact).write.option("compression", "zstd").parquet(f"{base}/levels")
    return ImpactIndex(impact, spark.read.parquet(f"{base}/levels"), spark.read.parquet(f"{base}/documents"), vocab, shards, id_col)


def _whole_scores(index: ImpactIndex, pairs: DataFrame, weights: DataFrame, qid: str) -> DataFrame:
    """(query, id, score) of (query, id) pairs, from the documents' own rows."""
    located = _few(pairs.withColumn("id_shard", shard_of(index.id_col, index.shards)))
    each = index.documents.join(located, ["id_shard", index.id_col]).select(qid, index.id_col, F.explode("terms").alias("_t"))
    met = each.select(qid, index.id_col, F.col("_t.term").alias("term"), F.col("_t.weight").alias("weight")).join(weights, [qid, "term"])
    return met.groupBy(qid, index.id_col).agg(F.sum(F.col("wq") * F.col("weight")).alias("_s"))


def _top(scored: DataFrame, qid: str, order: list[Column], k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(qid).orderBy(*order))).filter(F.col("rank") <= k)


def pruned_search(index: ImpactIndex, queries: DataFrame, k: int = 10, qid: str = "query_id", qtext: str = "query",
                  docs: DataFrame | None = None, filters: dict | None = None, fields: list[str] | None = None, stop_words=None) -> DataFrame:
    """(query, id, similarity_score, rank) and the columns `fields` of
    `docs`: the k best documents of each query by cosine, zero scores left
    out, ties to the smaller id, score to 4 digits. `filters` are equalities
    on `docs`; only documents that meet them are candidates."""
    return search_with_plan(index, queries, k, qid, qtext, docs, filters, fields, stop_words)[0]


def search_with_plan(index: ImpactIndex, queries: DataFrame, k: int = 10, qid: str = "query_id", qtext: str = "query",
                     docs: DataFrame | None = None, filters: dict | None = None, fields: list[str] | None = None,
                     stop_words=None) -> tuple[DataFrame, DataFrame]:
    """`pruned_search` and its read plan (see `read_plan`)."""
    id_col = index.id_col
    allowed = docs
    for name, value in (filters or {}).items():
        allowed = allowed.filter(F.col(name) == F.lit(value))
    weights = _few(query_weights(queries, index.vocab, qid, qtext, stop_words))

    def read(levels: DataFrame) -> DataFrame:
        rows = index.impact.join(_few(levels), ["shard", "term", "level"])
        return rows.join(allowed.select(id_col), id_col, "left_semi") if filters else rows

    first = weights.join(index.levels.filter(F.col("level") == 0), "term").select(qid, "shard", "term", "level", "wq")
    partial = read(first).groupBy(qid, id_col).agg(F.sum(F.col("wq") * F.col("weight")).alias("_s"))
    seeds = _top(partial, qid, [F.desc("_s"), F.asc(id_col)], SEEDS * k).select(qid, id_col)
    known = _top(_whole_scores(index, seeds, weights, qid), qid, [F.desc("_s"), F.asc(id_col)], k)
    thresholds = known.filter(F.col("rank") == k).select(qid, F.col("_s").alias("threshold"))
    plan = _kept(read_plan(weights, index.levels, thresholds, qid))

    chosen = plan.filter("read").select(qid, "shard", "term", "level", "wq", "rest", "left", "threshold")
    met = read(chosen).groupBy(qid, id_col).agg(
        F.sum(F.col("wq") * F.col("weight")).alias("_s"), F.sum("rest").alias("_seen"), F.max("left").alias("_left"), F.max("threshold").alias("_least"))
    open_ = met.filter(F.col("_s") + F.col("_left") - F.col("_seen") >= F.col("_least") - SLACK).select(qid, id_col)
    scored = _whole_scores(index, open_, weights, qid).filter(F.col("_s") > 1e-12)
    top = _top(scored, qid, [F.desc(rnd("_s", 9)), F.asc(id_col)], k)
    hits = top.select(qid, id_col, rnd("_s", 4).alias("similarity_score"), "rank")
    if fields:
        hits = _kept(hits)
        found = docs.select(id_col, *fields).join(_few(hits.select(id_col).distinct()), id_col, "left_semi")  # texts stay where they are
        hits = hits.join(found, id_col, "left").select(*hits.columns, *fields)
    return hits, plan


def search_cost(plan: DataFrame, qid: str = "query_id") -> DataFrame:
    """(query, n_read, n_postings): postings read by impact and all postings
    of the query's terms."""
    return plan.groupBy(qid).agg(F.coalesce(F.sum(F.when(F.col("read"), F.col("n"))), F.lit(0)).alias("n_read"), F.sum("n").alias("n_postings"))
