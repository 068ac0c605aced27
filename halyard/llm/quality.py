"""Quality classifier on random-indexing word vectors.

Words (letters, numbers and runs of other signs, case kept) are hashed to
`WORDS` rows. Each row has a fixed sparse random index vector; its word vector
is the sum of the index vectors of all neighbours within `REACH` words, over
the whole corpus, centred and scaled to length one. A document is pooled to
the mean and the spread of its words' vectors and its length. A two-layer
network in numpy gives the logit; a temperature fitted on rows that it didn't
learn from calibrates the probability.

Every task adds up its own matrix and Spark sums the rows, so the statistics
cover all documents and what reaches the driver is WORDS x SIZE numbers,
whatever the data. The network learns from a bounded sample, `SAMPLE` labelled
documents a class (lowest hash of the id first) outside the held-out quarter.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.bpe import pieces
from halyard.llm.common import fraction, lowest_hashes, python_ready

WORDS, SIZE, REACH = 1 << 14, 32, 2
FEATURES = 2 * SIZE + 2
#: Signs in an index vector.
SPARSE = 2
SEED = 5
SAMPLE = 3000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 0.01, 1e-4
#: Share of the sample that the temperature is fitted on.
CALIBRATION = 0.2
THRESHOLD = 0.7
#: Characters that are pooled together.
BLOCK_CHARS = 1_000_000


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(row, SPARSE) places and signs."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, SIZE, (WORDS, SPARSE)), rng.choice([-1.0, 1.0], (WORDS, SPARSE))


def _blocks(texts: list[str]):
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_CHARS):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def word_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of all words, and the text of each."""
    found, closes = pieces(texts)
    coded = found.dictionary_encode()
    words = [w.strip() for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    hashed = np.array([zlib.crc32(w.encode()) % WORDS if w else -1 for w in words], np.int64)
    codes = coded.indices.to_numpy()
    rows = hashed[codes]
    owner = np.cumsum(closes) - closes
    keep = (rows >= 0) & ~closes
    return rows[keep], owner[keep]


def _neighbour_sums(batches):
    places, signs = _index_vectors()
    total = np.zeros(WORDS * SIZE)
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        for at, to in _blocks(texts):
            rows, owner = word_rows(texts[at:to])
            for gap in range(1, REACH + 1):
                near = owner[:-gap] == owner[gap:]
                left, right = rows[:-gap][near], rows[gap:][near]
                for k in range(SPARSE):
                    total += np.bincount(left * SIZE + places[right, k], signs[right, k], WORDS * SIZE)
                    total += np.bincount(right * SIZE + places[left, k], signs[left, k], WORDS * SIZE)
    matrix = total.reshape(WORDS, SIZE)
    used = np.flatnonzero(matrix.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(matrix[used, d]) for d in range(SIZE))], names=["w", *(f"x{d}" for d in range(SIZE))])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(WORDS, SIZE) unit vectors from all texts; a row without neighbours is zero."""
    parts = python_ready(docs).select(F.col(text).cast("string").alias("t")).mapInArrow(_neighbour_sums, "w int, " + ", ".join(f"x{d} double" for d in range(SIZE)))
    out = np.zeros((WORDS, SIZE))
    for r in parts.groupBy("w").agg(*[F.sum(f"x{d}").alias(f"x{d}") for d in range(SIZE)]).collect():  # at most WORDS rows
        out[r["w"]] = r[1:]
    used = out.any(axis=1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
    if used.any():
        out[used] -= out[used].mean(axis=0)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, length, out=np.zeros_like(out), where=length > 1e-12)
    return out.astype(np.float32)


def pooled(vectors: np.ndarray, texts: list[str]) -> np.ndarray:
    """(text, FEATURES): mean and spread of the word vectors, mean cosine of
    neighbouring ones, log length."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for at, to in _blocks(texts):
        rows, owner = word_rows(texts[at:to])
        if not len(rows):
            continue
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        own, count = at + owner[begins], np.diff(begins, append=len(rows))[:, None]
        x = vectors[rows]
        mean = np.add.reduceat(x, begins, axis=0) / count
        next_to = np.einsum("ij,ij->i", x[:-1], x[1:]) * (owner[:-1] == owner[1:])
        out[own, -2] = np.add.reduceat(np.append(next_to, 0), begins) / np.maximum(count[:, 0] - 1, 1)
        np.multiply(x, x, out=x)
        square = np.add.reduceat(x, begins, axis=0) / count
        out[own, :SIZE], out[own, SIZE : 2 * SIZE] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
        out[own, -1] = np.log1p(count[:, 0])
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _probability(self.logits(x) / self.temperature)


def _probability(logits: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * logits.astype(np.float64)))


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the cross-entropy of a seeded part, then the temperature that
    the rest's cross-entropy is least at. One class alone: its constant."""
    rng = np.random.default_rng(seed)
    wide = x.shape[1]
    net = Network(x.mean(axis=0) if len(x) else np.zeros(wide), np.ones(wide), rng.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    if len(set(y.tolist())) < 2:
        net.w2[:] = 0
        net.b2 = 0.0 if not len(y) else (9.0 if y[0] else -9.0)
        return net
    net.scale = x.std(axis=0) + 1e-6
    order = rng.permutation(len(x))
    held, own = np.split(order, [int(CALIBRATION * len(x))])
    z, t = (x - net.centre) / net.scale, y.astype(np.float64)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        own = rng.permutation(own)
        for at in range(0, len(own), BATCH):
            take = own[at : at + BATCH]
            h = np.tanh(z[take] @ params[0] + params[1])
            error = (_probability(h @ params[2] + params[3]) - t[take]) / len(take)
            back = np.outer(error, params[2]) * (1 - h * h)
            step += 1
            for p, g, m, v in zip(params, (z[take].T @ back + DECAY * params[0], back.sum(axis=0), h.T @ error + DECAY * params[2], error.sum(keepdims=True)), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    if len(held):
        logits, target = net.logits(x[held]), t[held]
        loss = lambda temperature: np.mean(np.logaddexp(0, np.where(target == 1, -1, 1) * logits / temperature))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def sample_ids(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id, y): at most SAMPLE ids a class, outside the held-out quarter."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter((fraction(4, "id") != 2) & F.col("y").isin(0, 1)).distinct()
    return lowest_hashes(rows, "y", "id", SAMPLE)


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    vectors = word_vectors(docs, text)
    # bounded: at most SAMPLE ids a class
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample_ids(labels, id_col, label)), "id")

    def features(batches):
        for b in batches:
            x = pooled(vectors, [t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["id", "y", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    found = python_ready(rows).select("id", "y", "text").mapInArrow(features, f"id {kind}, y int, x array<float>").collect()
    found.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    x = np.array([r["x"] for r in found], np.float64).reshape(-1, FEATURES)
    return Model(vectors, train(x, np.array([r["y"] for r in found], np.int64)))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of every row, `score` (calibrated probability of a
    good document) and `predicted` (1 from THRESHOLD on).

    A null text scores as an empty one, which is pooled to zeros. Without
    labels of both classes every score is the same: the one class's, or 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WORDS x SIZE floats

    def run(batches):
        for b in batches:
            s = sent.value.network.scores(pooled(sent.value.vectors, [t or "" for t in b.column(len(keep)).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    source = python_ready(docs).select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{kinds}{', ' if keep else ''}score double, predicted int")
