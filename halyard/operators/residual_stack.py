"""Doubly residual window model for many series.

A stack of blocks reads the last `lookback` days, normalised. Each block turns
what is left of them into fixed random ReLU features, from which one trained
head explains the look-back (backcast) and one adds to the forecast; the next
block sees the look-back without the backcast. So the backcasts and the rest
add up to the input, and the forecast is the sum over all blocks.

Only heads are trained: block by block, a ridge regression over the windows of
all series. A task cuts the windows out of whole series (one value a day) and
adds up its Gram matrices, whose size is set by the features; Spark adds those
of all tasks. The weights go to the tasks as one broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.session import checkpoint_dir, ship_package

KEY = "series_id"
#: Three stacks of three blocks; days of look-back per day of horizon.
BLOCKS, LOOKBACK_TIMES, FEATURES, SEED, RIDGE = 9, 5, 64, 7, 1.0
#: Windows that a task holds at once.
CHUNK = 2048


@dataclass
class Stack:
    lookback: int
    horizon: int
    features: int = FEATURES
    seed: int = SEED
    heads: list[np.ndarray] = field(default_factory=list)

    def layer(self, k: int, rest: np.ndarray) -> np.ndarray:
        """The fixed random features of block k."""
        rng = np.random.default_rng((self.seed, k))
        w, b = rng.normal(0, 1 / math.sqrt(self.lookback), (self.lookback, self.features)), rng.normal(0, 0.1, self.features)
        return np.column_stack([np.ones(len(rest)), np.maximum(rest @ w + b, 0.0)])

    def run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(what is left of x, forecast, backcasts)."""
        rest, forecast, backcasts = x, np.zeros((len(x), self.horizon)), []
        for k, head in enumerate(self.heads):
            out = self.layer(k, rest) @ head
            backcasts.append(out[:, : self.lookback])
            rest, forecast = rest - backcasts[-1], forecast + out[:, self.lookback :]
        return rest, forecast, backcasts


def normalised(look: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = look.mean(axis=1, keepdims=True), look.std(axis=1, keepdims=True)
    spread = np.where(spread > 0, spread, 1.0)
    return (look - mean) / spread, mean, spread


def series_arrays(reg: DataFrame) -> DataFrame:
    """(series, ds, y): the last day and all values in order, gaps filled
    forward by `regularize_daily` before."""
    rows = reg.groupBy(KEY).agg(F.max("ds").alias("ds"), F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("_p"))
    return rows.select(KEY, "ds", F.transform("_p", lambda p: F.coalesce(p["y"].cast("double"), F.lit(0.0))).alias("y"))


def _chunks(y: np.ndarray, size: int):
    if len(y) >= size:
        every = np.lib.stride_tricks.sliding_window_view(y, size)
        for at in range(0, len(every), CHUNK):
            yield every[at : at + CHUNK]


def fit(series: DataFrame, horizon: int, lookback: int, blocks: int = BLOCKS, features: int = FEATURES, seed: int = SEED) -> tuple[Stack, list[float]]:
    """The trained stack, and the mean squared error of its normalised
    forecasts over all windows before each block and after the last. No
    windows: a stack without heads."""
    sc, stack, errors = series.sparkSession.sparkContext, Stack(lookback, horizon, features, seed), []
    for k in range(blocks + 1):
        now = sc.broadcast(stack)

        def run(batches):
            s, size = now.value, features + 1
            gram, moment, error, n = np.zeros((size, size)), np.zeros((size, lookback + horizon)), 0.0, 0
            for b in batches:
                for y in b.column(0).to_pylist():
                    for window in _chunks(np.array(y), lookback + horizon):
                        x, mean, spread = normalised(window[:, :lookback])
                        rest, forecast, _ = s.run(x)
                        left = (window[:, lookback:] - mean) / spread - forecast
                        error, n = error + float((left**2).sum()), n + left.size
                        if k < blocks:
                            z = s.layer(k, rest)
                            gram += z.T @ z
                            moment += z.T @ np.column_stack([rest, left])
            cells = np.concatenate([gram.ravel(), moment.ravel(), [error, n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["i", "v"])

        def solve(t):
            size, cells = features + 1, np.zeros((features + 1) * (features + 1 + lookback + horizon) + 2)
            cells[t.column("i").to_numpy()] = t.column("v").to_numpy()
            gram, moment = cells[: size * size].reshape(size, size), cells[size * size : -2].reshape(size, -1)
            head = np.linalg.solve(gram + RIDGE * np.eye(size), moment) if k < blocks and cells[-1] else np.zeros(0)
            return pa.table({"head": pa.array([head.ravel()]), "error": pa.array([cells[-2]]), "n": pa.array([cells[-1]])})

        # one row per cell, solved in one small task, where the worker's thread settings hold
        sums = series.select("y").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
        found = sums.groupBy().applyInArrow(solve, "head array<double>, error double, n double").first()
        now.unpersist()
        if found is None or not found["n"]:
            return stack, []
        errors.append(found["error"] / found["n"])
        if k < blocks:
            stack.heads.append(np.array(found["head"]).reshape(features + 1, -1))
    return stack, errors


def predict(series: DataFrame, stack: Stack) -> DataFrame:
    """(series, ds, yhat): the `horizon` days after each series' last one.
    Series shorter than the look-back have no rows."""
    held = series.sparkSession.sparkContext.broadcast(stack)

    def run(batches):
        s = held.value
        for b in batches:
            tails = [np.array(y)[-s.lookback :] for y in b.column("y").to_pylist()]
            long = [k for k, y in enumerate(tails) if len(y) == s.lookback and s.heads]
            own = b.select([KEY, "ds"]).take(pa.array(long, pa.int64()))
            out: list = []
            if long:
                x, mean, spread = normalised(np.stack([tails[k] for k in long]))
                out = (s.run(x)[1] * spread + mean).tolist()
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.list_(pa.float64()))], names=[KEY, "ds", "yhat"])

    each = series.mapInArrow(run, f"{KEY} string, ds date, yhat array<double>")
    return each.select(KEY, "ds", F.posexplode("yhat").alias("i", "yhat")).select(KEY, F.date_add("ds", F.col("i") + 1).alias("ds"), "yhat")


def train(reg: DataFrame, horizon: int, lookback: int | None = None, blocks: int = BLOCKS, features: int = FEATURES, seed: int = SEED) -> tuple[DataFrame, Stack]:
    """The series as arrays (built once) and the stack trained on them."""
    ship_package(reg.sparkSession)
    checkpoint_dir(reg.sparkSession)
    series = series_arrays(reg).checkpoint()
    return series, fit(series, horizon, lookback or LOOKBACK_TIMES * horizon, blocks, features, seed)[0]
