"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time over
windows of UTF-8 bytes; every position carries its document's language as the
target. A text is cut into windows over its whole length, both directions label
every byte, and the document's probabilities are the mean over its bytes.

Training reads a bounded sample (`SAMPLE_DOCS` documents a language, lowest
hash of the id first, `SAMPLE_WINDOWS` windows of each) of labelled rows
outside the held-out quarter. The model is a few kilobytes, whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import fraction, lowest_hashes, numbered, python_ready, stored

WINDOW = 64
HIDDEN = 8
PAD = 256
#: Bound of the training sample: documents a language, and windows a document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 6
STEPS, BATCH, RATE, SEED = 150, 512, 0.015, 7
#: Windows that are labelled together.
BLOCK = 2048
#: A document is rejected below this pooled probability of its best language.
MIN_SCORE = 0.35
UNKNOWN = "und"


@dataclass
class Model:
    """Feature-major weights; index 0 reads forwards and 1 backwards. `x` holds
    the input part of the gates (update, reset, candidate) for each byte and
    the padding, `h` the recurrent part, `o` and `b` the output layer."""

    languages: list[str]
    x: np.ndarray
    h: np.ndarray
    o: np.ndarray
    b: np.ndarray


def windows(data: bytes) -> np.ndarray:
    """(windows, WINDOW) of all bytes, the last one padded."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def _sigmoid(a: np.ndarray) -> np.ndarray:
    np.multiply(a, 0.5, out=a)
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def states(model: Model, steps: np.ndarray, tape: list | None = None) -> np.ndarray:
    """(step, 2 * HIDDEN, window) of hidden states for (step, window) bytes.
    A tape, if given, gets what the backward pass needs."""
    length, n = steps.shape
    k = model.h.shape[2]
    out = np.empty((length, 2 * k, n), np.float32)
    gates_x, gates_h = np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32)
    for d in range(2):
        h = np.zeros((k, n), np.float32)
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            np.take(model.x[d], steps[t], axis=1, out=gates_x, mode="clip")
            np.matmul(model.h[d], h, out=gates_h)
            zr = _sigmoid(gates_x[: 2 * k] + gates_h[: 2 * k])
            new = gates_h[2 * k :] * zr[k:]
            new += gates_x[2 * k :]
            np.tanh(new, out=new)
            if tape is not None:
                tape.append((d, t, h, zr, new, gates_h[2 * k :].copy()))
            h = (h - new) * zr[:k]
            h += new
            out[t, d * k : (d + 1) * k] = h
    return out


def probabilities(model: Model, hidden: np.ndarray) -> np.ndarray:
    """(step, language, window): softmax at every position."""
    p = np.matmul(model.o, hidden)
    p += model.b[:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def _gradients(model: Model, steps: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over all positions that aren't padding."""
    k, tape = model.h.shape[2], []
    hidden = states(model, steps, tape)
    real = (steps != PAD).astype(np.float32)
    delta = probabilities(model, hidden)
    delta[:, target, np.arange(steps.shape[1])] -= 1
    delta *= (real / real.sum())[:, None, :]
    g = [np.zeros_like(w) for w in (model.x, model.h, model.o, model.b)]
    g[2] += np.matmul(delta, hidden.transpose(0, 2, 1)).sum(axis=0)
    g[3] += delta.sum(axis=(0, 2))
    back = np.matmul(model.o.T, delta)
    carry = np.zeros((2, k, steps.shape[1]), np.float32)
    inputs: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for d, t, before, zr, new, recurrent in reversed(tape):
        dh = back[t, d * k : (d + 1) * k] + carry[d]
        z, r = zr[:k], zr[k:]
        dnew = dh * (1 - z) * (1 - new * new)
        dz = dh * (before - new) * z * (1 - z)
        dr = dnew * recurrent * r * (1 - r)
        gate = np.concatenate((dz, dr, dnew * r))
        g[1][d] += gate @ before.T
        carry[d] = dh * z + model.h[d].T @ gate
        gate[2 * k :] = dnew
        inputs[d].append((steps[t], gate))
    for d in range(2):
        at = np.concatenate([s for s, _ in inputs[d]])
        values = np.concatenate([v for _, v in inputs[d]], axis=1)
        for row in range(3 * k):
            g[0][d, row] += np.bincount(at, values[row], PAD + 1)
    return g


def train(texts: list[bytes], labels: list[str], updates: int = STEPS, hidden: int = HIDDEN, seed: int = SEED) -> Model:
    """Adam over shuffled windows, as many steps for any number of them; the same
    rows give the same model."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    rows, target = [], []
    for data, label in zip(texts, labels):
        w = windows(data)
        w = w[rng.permutation(len(w))[:SAMPLE_WINDOWS]]
        rows.append(w)
        target += [languages.index(label)] * len(w)
    shape = (2, 3 * hidden)
    model = Model(
        languages,
        rng.normal(0, 0.3, (*shape, PAD + 1)).astype(np.float32),
        rng.normal(0, hidden**-0.5, (*shape, hidden)).astype(np.float32),
        rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    if len(languages) < 2:
        return model
    x, y = np.concatenate(rows).astype(np.intp), np.array(target)
    params = [model.x, model.h, model.o, model.b]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = np.empty(0, np.int64)
    for step in range(1, updates + 1):
        if len(order) < min(BATCH, len(x)):
            order = np.concatenate((order, rng.permutation(len(x))))
        take, order = order[:BATCH], order[BATCH:]
        rate = RATE * (1 - 0.9 * step / updates)
        for p, g, m, v in zip(params, _gradients(model, np.ascontiguousarray(x[take].T), y[take]), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def label(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text: mean probabilities over all of its bytes, and how many
    positions each language was the best label of."""
    k = len(model.languages)
    pooled, votes, size = np.zeros((len(texts), k)), np.zeros((len(texts), k), np.int64), np.array([max(1, len(t)) for t in texts])
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    rows = np.full(int(count.sum()) * WINDOW, PAD, np.int16)
    begins = (np.cumsum(count) - count) * WINDOW
    for t, at in zip(texts, begins.tolist()):
        rows[at : at + len(t)] = np.frombuffer(t, np.uint8)
    rows = rows.reshape(-1, WINDOW)
    for at in range(0, len(rows), BLOCK):
        steps = np.ascontiguousarray(rows[at : at + BLOCK].T).astype(np.intp)
        p = probabilities(model, states(model, steps))
        real = steps != PAD
        p *= real[:, None, :]
        best = (p >= p.max(axis=1, keepdims=True)) & real[:, None, :]
        np.add.at(pooled, owner[at : at + BLOCK], p.sum(axis=0).T)
        np.add.at(votes, owner[at : at + BLOCK], best.sum(axis=0).T)
    return pooled / size[:, None], votes


def sample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_DOCS) -> DataFrame:
    """The training rows (text, lang): a bounded number a language, chosen by
    a hash of the id. Only ids are ranked; texts join the chosen few."""
    base = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        (fraction(4, "id") != 2) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\S")
    )
    chosen = lowest_hashes(base.select("id", "lang"), "lang", "id", per_language).distinct()
    # bounded: at most per_language ids a language
    return base.join(F.broadcast(chosen), ["id", "lang"])


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    rows = sample(docs, id_col, text, lang).select("id", "lang", "text").collect()  # at most SAMPLE_DOCS a language
    rows.sort(key=lambda r: (r["lang"], r["id"], r["text"]))
    return train([r["text"].encode() for r in rows], [r["lang"] for r in rows])


def keep_identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the rows in no learned language: no letter, or a pooled
    probability below `MIN_SCORE`. The network learns from the rows of `docs`
    that carry a language. Every column stays as it is."""
    rows = numbered(docs, "__row")
    found = identify(rows, fit(docs, text=text), ["__row"], text)
    rejected = stored(found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < MIN_SCORE)).select("__row"))
    return rows.join(rejected, "__row", "left_anti").select(*docs.columns)


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of every row with `lang_pred`, `score` (pooled
    probability of that language) and `positions` (bytes labelled with each
    language, in the order of `model.languages`).

    A null text or one without a letter, and every text if nothing was
    learned, is `und` with score 0. With one learned language that is the
    answer for all other texts, with score 1. Texts are read whole.
    """
    languages = np.array([*model.languages, UNKNOWN])

    def run(batches):
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & (len(model.languages) > 0)
            pred, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
            votes = np.zeros((len(texts), len(model.languages)), np.int64)
            at = np.flatnonzero(known)
            if len(at):
                pooled, found = label(model, [texts[i].encode() for i in at])
                pred[at], score[at], votes[at] = pooled.argmax(axis=1), np.clip(pooled.max(axis=1), 0, 1), found
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(languages[pred].tolist(), pa.string()), pa.array(score), pa.array(votes.tolist(), pa.list_(pa.int64()))],
                names=[*keep, "lang_pred", "score", "positions"],
            )

    source = python_ready(docs).select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{kinds}{', ' if keep else ''}lang_pred string, score double, positions array<long>")
