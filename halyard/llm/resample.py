"""Target-distribution importance resampling over hashed word n-grams.

Texts become bytes with a blank for every delimiter. An Aho-Corasick automaton
holds delimiter-bounded words, each with its CRC-32 and length as payload; one
scan of a batch emits the payloads of all its words. The CRC of a run of words
is composed from the payloads of neighbours,

    crc(a + b) = shift(crc(a), |b|) ^ crc(b),

where `shift` (so many zero bytes) is linear and comes from tables. So no
n-gram is ever built as text. Words outside the dictionary are hashed from their bytes;
the dictionary only decides how often that happens, never a result.

Bucket counts of both corpora are partial sums of 10,000 buckets a task; their
log ratio scores every document, and the draw ranks all of them by ranges.
"""

from __future__ import annotations

import math
import zlib
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import python_ready, stored, with_row_id
from halyard.operators.ranking import with_position

BUCKETS, LONGEST = 10_000, 3
MIN_WORDS, SHARE, SEED = 20, 5, 42
#: Words in the automaton: the most frequent ones of a bounded sample of texts. Results don't depend on either.
DICTIONARY_WORDS, DICTIONARY_TEXTS = 30_000, 4_000
#: Bytes of text that are scanned at once.
PORTION = 1 << 21

# ------------------------------------------------------------- CRC arithmetic
_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected
_SHORT = 64


def _zero_byte() -> np.ndarray:
    """What one zero byte does to each value of a CRC's lowest byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(_POLYNOMIAL), out >> 1)
    return out.astype(np.uint32)


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRCs after the shift that `tables` (4, 256) stand for."""
    out = np.zeros_like(crc)
    for k in range(4):
        out ^= tables[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@cache
def shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of 0 to 63 zero bytes, and of 64, 128, ... (doubling) ones."""
    step = _zero_byte()
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = []
    for _ in range(_SHORT):
        short.append(now)
        now = (now >> np.uint32(8)) ^ step[now & np.uint32(255)]
    doubling = [now]
    for _ in range(25):
        doubling.append(_apply(doubling[-1], doubling[-1]))
    return np.stack(short), doubling


def shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRCs after so many zero bytes each."""
    short, doubling = shift_tables()
    few = zeros % _SHORT
    out = np.zeros_like(crc)
    for k in range(4):
        out ^= short[few, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    many = zeros // _SHORT
    bit = 0
    while many.any():
        odd = (many & 1) == 1
        out[odd] = _apply(doubling[bit], out[odd])
        many, bit = many >> 1, bit + 1
    return out


def join_crc(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRC of two byte strings after one another, from the CRC of each."""
    return shift(left, right_bytes) ^ right


# ------------------------------------------------------------ words and automaton
def _plain_bytes() -> bytes:
    """Byte by byte: A-Z to a-z, other ASCII than digits and letters to a blank."""
    out = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in range(256):
        if chr(c).isascii() and chr(c).isalnum():
            out[c] = ord(chr(c).lower())
    return bytes(out)


_PLAIN = _plain_bytes()
_BLANK = np.uint32(zlib.crc32(b" "))


def plain(texts: list[bytes]) -> bytes:
    """All texts as one buffer of words and blanks, a blank at either end of each."""
    return b" ".join([b"", *texts, b""]).translate(_PLAIN)


def build_dictionary(words: list[bytes]) -> ahocorasick.Automaton:
    """Delimiter-bounded words; the payload is length * 2^32 + CRC."""
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for w in words:
        found.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
    if len(found):
        found.make_automaton()
    return found


class Words:
    """The words of some texts (UTF-8) in order: CRC, length in bytes, text number."""

    def __init__(self, texts: list[bytes], dictionary: ahocorasick.Automaton):
        buffer = plain(texts)
        blank = np.frombuffer(buffer, np.uint8) == 32
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        payload = np.full(len(starts), -1, np.int64)
        if len(dictionary) and len(starts):
            met = np.fromiter(chain.from_iterable(dictionary.iter(buffer.decode("latin-1"))), np.int64)
            # pairs of (place of the blank after the word, payload)
            payload[np.searchsorted(ends, met[0::2])] = met[1::2]
        for k in np.flatnonzero(payload < 0):
            w = buffer[starts[k] : ends[k]]
            payload[k] = len(w) << 32 | zlib.crc32(w)
        self.crc = (payload & 0xFFFFFFFF).astype(np.uint32)
        self.length = payload >> 32
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts - 1, side="right")

    def buckets(self):
        """(bucket, text number) of all runs of 1, 2, ... LONGEST words."""
        blanked = join_crc(np.full(len(self.crc), _BLANK, np.uint32), self.crc, self.length)
        run = self.crc
        for n in range(1, LONGEST + 1):
            inside = self.text[: len(run)] == self.text[n - 1 :][: len(run)]
            yield (run % np.uint32(BUCKETS)).astype(np.int64)[inside], self.text[: len(run)][inside]
            if n < LONGEST:
                run = join_crc(run[: len(run) - 1], blanked[n:], self.length[n:] + 1) if len(run) > 1 else run[:0]


def portions(column: pa.Array):
    """(first row, texts as UTF-8) of about PORTION bytes each; nulls are empty."""
    first, held, size = 0, [], 0
    for k, t in enumerate(column.to_pylist()):
        held.append((t or "").encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= PORTION:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def sample_words(texts: DataFrame, text: str, words: int, sample: int) -> list[bytes]:
    """The most frequent words of about `sample` texts: a bounded list that
    decides speed alone."""
    share = sample / max(1, texts.count())
    low = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    picked = texts.filter(F.rand(SEED) < share)
    each = picked.select(F.explode(F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))).alias("w"))
    top = each.filter(F.length("w") <= 40).groupBy("w").count().orderBy(F.desc("count"), "w").limit(words)
    return [r["w"].encode("utf-8") for r in top.collect()]


def dictionary_words(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> list[bytes]:
    half = DICTIONARY_WORDS // 2
    return sorted({*sample_words(docs, text, half, DICTIONARY_TEXTS), *sample_words(target, target_text, half, DICTIONARY_TEXTS)})


# -------------------------------------------------------------- counts and scores
def bucket_counts(texts: DataFrame, text: str, words) -> np.ndarray:
    """Features of each bucket over all rows: one partial sum a task."""

    def run(batches):
        automaton, total = build_dictionary(words.value), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, texts in portions(b.column(0)):
                for bucket, _ in Words(texts, automaton).buckets():
                    total += np.bincount(bucket, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    parts = python_ready(texts).select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed source share)) of each bucket."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source, target)], np.int64)


def weigh(docs: DataFrame, keep: list[str], gain: np.ndarray, words, text: str = "text") -> DataFrame:
    """`keep`, n_words, n_features and weight (the sum of gains) of every row."""

    def run(batches):
        automaton = build_dictionary(words.value)
        for b in batches:
            n_words, features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for first, texts in portions(b.column(len(keep))):
                own, found = slice(first, first + len(texts)), Words(texts, automaton)
                n_words[own] = np.bincount(found.text, minlength=len(texts))
                for bucket, of in found.buckets():
                    features[own] += np.bincount(of, minlength=len(texts))
                    np.add.at(weight[own], of, gain[bucket])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, (n_words, features, weight))], names=[*keep, "n_words", "n_features", "weight"])

    source = python_ready(docs).select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{kinds}n_words long, n_features long, weight long")


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id (a null one: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, min_words: int = MIN_WORDS, words: list[bytes] | None = None) -> DataFrame:
    """One row per row of `docs`: the id, n_features, weight, score, and rank
    (1, 2, ... by score, ties to the smaller id) of the drawn ones, null for
    the rest. floor(share * N / 100) of the N rows with `min_words` words or
    more are drawn, without replacement.

    Null texts are empty ones: no features, weight 0, never drawn. A null id
    scores by the digest of no digits and comes after all others in ties.
    Repeated rows count, score and may be drawn each. An empty target leaves
    its counts at 0. Texts are read whole. No rows: none."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(dictionary_words(docs, target, text, target_text) if words is None else words)  # at most DICTIONARY_WORDS
    gain = gains(bucket_counts(docs, text, known), bucket_counts(target, target_text, known))
    weighed = weigh(docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("__of")), ["__id"], gain, known, "__of")
    scored = weighed.withColumn("score", F.col("weight") + noise("__id")).withColumn("fit", F.col("n_words") >= min_words)
    scored = stored(with_row_id(scored, "__row"))
    drawn = scored.filter("fit").count() * share // 100
    placed = with_position(scored, [F.desc("fit"), F.desc("score"), F.asc_nulls_last("__id"), F.asc("__row")])
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    return placed.select(F.col("__id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that the draw takes, for a training set. Ids have to
    be unique and not null; the join on them is narrow ids against texts."""
    picked = resample(docs, target, id_col, text, **options).filter(F.col("rank").isNotNull()).select(F.col(id_col).alias("__drawn"))
    return docs.join(picked, F.col(id_col) == F.col("__drawn"), "left_semi")
