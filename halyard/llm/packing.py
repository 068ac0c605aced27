"""Packing by power-of-two decomposition.

A document of n ids (its closing id included) is cut, from its start, into
pieces of `max_tokens` and then into the powers of two of what is left, largest
first. Each piece is a sequence of its own: its length is a power of two, so it
needs no padding, no sequence holds two documents, and sequences of one length
form a bucket that batches are drawn from. It is one pass without a shuffle;
nothing is kept between documents, so neither a hot source nor a long document
gathers anywhere.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.bpe import encoder
from halyard.llm.common import python_ready

MAX_TOKENS = 1024


def cuts(n: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of n ids, in order; `max_tokens` is a power of two."""
    whole, rest = divmod(n, max_tokens)
    return [max_tokens] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = 0) -> DataFrame:
    """One row per piece: `id_col`, `start` (ids of the document before it),
    `length`, `ids` (little-endian unsigned 32-bit ids as binary),
    `doc_tokens`, `sequence_id`, `offset` (0: a sequence holds one piece) and
    `bucket` (the sequences of one length).

    A null or empty text is the closing id alone. Repeated rows and null ids
    are packed each, under sequence numbers of their own (task and position).
    Text of any length is encoded whole. No rows: none come back.
    """
    if max_tokens & (max_tokens - 1) or max_tokens < 1:
        raise ValueError("max_tokens has to be a power of two")

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer_path, end_id)
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids, counts = encode.encode(texts)
            raw, base = ids.astype("<u4").tobytes(), 0
            row, start, length, data, total = [], [], [], [], []
            for k, n in enumerate(counts.tolist()):
                at = 0
                for size in cuts(n, max_tokens):
                    row.append(k)
                    start.append(at)
                    length.append(size)
                    data.append(raw[4 * (base + at) : 4 * (base + at + size)])
                    total.append(n)
                    at += size
                base += n
            numbers = np.arange(number, number + len(row))
            number += len(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(data, pa.binary()), pa.array(total, pa.int64()), pa.array(numbers, pa.int64())],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id"],
            )

    source = python_ready(docs).select(id_col, F.col(text).cast("string").alias("__text"))
    kind = source.schema[id_col].dataType.simpleString()
    out = source.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long")
    return out.withColumns({"offset": F.lit(0).cast("long"), "bucket": F.col("length")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
