"""B29 by an index of character grams.

The index holds (gram, id) for every different run of one to three characters
of a text in lower case, in folders by the gram's hash, and how many texts
have each gram. A gram is a number, 21 bits a character, made from a text's
code points in one pass over the array. A query's texts must hold all of its grams, so the postings
of its rarest few are intersected and the texts left are looked at. Queries of
up to three characters are grams themselves and need no text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.session import ship_package, spread_partitions

#: Longest gram, folders of the postings, and grams of a query whose postings are read.
LONGEST, SHARDS, RAREST = 3, 64, 4
#: Texts whose grams leave a task at once.
BLOCK_TEXTS = 256
#: Rows of (32-byte key, gram) up to which the grams read are broadcast, some 20 MB; more are joined by sorting.
BROADCAST_ROWS = 200_000


class GramIndex(NamedTuple):
    """`postings` (gram, id, shard) and `sizes` (gram, n)."""

    postings: DataFrame
    sizes: DataFrame


def codes(text: str, query: bool = False) -> np.ndarray:
    """The different runs of 1 to LONGEST characters of a text; of a query
    those of LONGEST characters, or itself if it is shorter."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    out, run = [], chars
    for n in range(1, min(LONGEST, len(chars)) + 1):
        if n > 1:
            run = (run[:-1] << 21) | chars[n - 1 :]
        out.append(run)
    return np.unique(np.concatenate(out[-1:] if query else out)) if out else chars


def _exploded(rows: DataFrame, query: bool = False) -> DataFrame:
    """(key, gram) of (key, text), each pair once per row."""
    ship_package(rows.sparkSession)
    key, text = rows.columns

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_TEXTS):
                part = b.slice(at, BLOCK_TEXTS)
                found = [codes(t, query) for t in part.column(1).to_pylist()]
                own = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(np.concatenate(found), pa.int64())], names=[key, "gram"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, gram long")


def _lower(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))


def shard(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHARDS)).cast("int")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, id, shard), each pair once per row; null and empty texts have
    none. Within a row grams are made distinct before they leave it."""
    rows = spread_partitions(docs.select(F.col(id_col).alias("id"), _lower(text_col).alias("text")))
    return _exploded(rows).select("id", "gram", shard("gram").alias("shard"))


def sizes(stored_postings: DataFrame) -> DataFrame:
    """(gram, n): the rows of each gram."""
    return stored_postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _wanted(index: GramIndex, queries: DataFrame) -> DataFrame:
    """(__query, gram, n_grams): the grams of each query that are read. A
    query with a gram that no text has is left out; it has no match."""
    own = W.partitionBy("__query")
    grams = _exploded(queries.select("__query", "__text"), query=True).withColumn("total", F.count(F.lit(1)).over(own).cast("int"))
    ranked = grams.join(index.sizes, "gram").withColumns({"known": F.count(F.lit(1)).over(own), "at": F.row_number().over(own.orderBy("n", "gram"))})
    few = ranked.filter((F.col("known") == F.col("total")) & (F.col("at") <= RAREST))
    return few.select("__query", "gram", F.least("total", F.lit(RAREST)).alias("n_grams"))


def candidates(index: GramIndex, queries: DataFrame) -> DataFrame:
    """(__query, id) of the texts that hold all grams read for a query.
    `queries` has (__query, __text), a short key and a text in lower case that
    isn't empty."""
    wanted = _wanted(index, queries)
    folders = wanted.groupBy(shard("gram").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most SHARDS rows
    read = index.postings.filter(F.col("shard").isin([r["s"] for r in folders])).select("gram", "id")
    # compressed postings look small to the optimizer, so which side may be broadcast is said here
    if sum(r["n"] for r in folders) <= BROADCAST_ROWS:
        met = read.join(F.broadcast(wanted), "gram")
    else:
        met = wanted.join(read.hint("merge"), "gram")
    # repeated ids repeat their postings; a set holds at most RAREST grams
    whole = met.groupBy("__query", "id", "n_grams").agg(F.size(F.collect_set("gram")).alias("met"))
    return whole.filter(F.col("met") == F.col("n_grams")).select("__query", "id")


def substring_search(index: GramIndex, docs: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
                     qid: str = "query_id", qtext: str = "query") -> DataFrame:
    """For each query the first k documents by id whose text holds the
    query, case aside: (qid, id_col, rank).

    Null and empty queries match nothing. A repeated query id asks for each
    of its texts; rows that repeat a document id match each. Rows of a null
    id aren't found. `index` is of `docs`."""
    key = F.unhex(F.sha2("__text", 256))
    asked = queries.select(F.col(qid).alias("__id"), _lower(qtext).alias("__text")).filter(F.col("__text") != "").withColumn("__query", key)
    texts = asked.select("__query", "__text").distinct()  # equal texts are looked up once
    found = candidates(index, texts).join(texts, "__query")
    held = docs.select(F.col(id_col).alias("id"), _lower(text_col).alias("__held"))
    sure = found.join(held, "id").filter(F.col("__held").contains(F.col("__text"))).select("__query", "id")
    first = sure.withColumn("at", F.row_number().over(W.partitionBy("__query").orderBy("id"))).filter(F.col("at") <= k)
    # the first k of a text are among the first k of an id that asks for several
    each = asked.select("__id", "__query").join(first, "__query").select("__id", "id")
    rank = F.row_number().over(W.partitionBy("__id").orderBy("id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("__id").alias(qid), F.col("id").alias(id_col), "rank")
