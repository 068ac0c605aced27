"""Exact quantiles of any number of rows by narrowing intervals.

The value of a wanted rank lies between the smallest and the largest value. A
pass counts the rows of `BINS` parts of each rank's interval, with the smallest
and largest value in each; the part that holds the rank is the next interval.
It ends when an interval is a single value. Parts are equal in the values and,
every other pass, in their signed logarithm, so that neither dense nor steep
data need many passes. A task keeps ranks x BINS
counters whatever it reads, so there is no buffer of values or of distinct
values, as there is in `percentile`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


@dataclass
class _Wanted:
    column: int
    rank: int
    low: float
    high: float
    below: int


def ranks(n: int, share: float) -> tuple[int, int, float]:
    """The ranks around a share of n values, and how far it is between them."""
    at = (n - 1) * share
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def exact_quantiles(df: DataFrame, columns: Sequence[Column], shares: Sequence[float]) -> list[list[float | None]]:
    """For each column the value at each share, linearly between neighbours:
    that of `percentile`. Nulls and NaN take no part; a column without values
    has nulls."""
    x = df.select(*[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"x{i}") for i, c in enumerate(columns)])
    row = x.agg(*[f(F.col(f"x{i}")).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("l", F.min), ("h", F.max))]).first()
    sizes = [row[f"n{i}"] for i in range(len(columns))]
    asked = sorted({(i, r) for i, n in enumerate(sizes) if n for s in shares for r in ranks(n, s)[:2]})
    found = {(i, r): _Wanted(i, r, row[f"l{i}"], row[f"h{i}"], 0) for i, r in asked}
    steep = False
    while True:
        open_: dict[tuple, list[_Wanted]] = {}
        for w in found.values():
            if w.low < w.high:
                open_.setdefault((w.column, w.low, w.high), []).append(w)
        if not open_:
            break
        _narrow(x, open_, steep)
        steep = not steep
    out: list[list[float | None]] = []
    for i, n in enumerate(sizes):
        around = [ranks(n, s) for s in shares] if n else []
        out.append([found[i, a].low + (found[i, b].low - found[i, a].low) * part if part else found[i, a].low for a, b, part in around] if n else [None] * len(shares))
    return out


#: Magnitudes below 1e-300 are one point of the logarithmic scale; the shift keeps it ordered about zero.
_TINY, _SHIFT = 1e-300, 692.0


def _log(v: float) -> float:
    return math.copysign(math.log(abs(v)) + _SHIFT, v) if abs(v) > _TINY else 0.0


def _log_column(v: Column) -> Column:
    return F.when(F.abs(v) > _TINY, F.signum(v) * (F.log(F.abs(v)) + _SHIFT)).otherwise(0.0)


def _narrow(x: DataFrame, open_: dict[tuple, list[_Wanted]], steep: bool = False) -> None:
    """One pass: counts, least and greatest value of each part of each interval."""
    keys = list(open_)
    cells = []
    for k, (i, low, high) in enumerate(keys):
        v = F.col(f"x{i}")
        # linear ends are halved, so that their distance can't overflow
        at, first, last = (_log_column(v), _log(low), _log(high)) if steep else (v / 2, low / 2, high / 2)
        part = (at - F.lit(first)) / F.lit(last - first) * BINS if last > first else F.lit(0)
        cells.append(F.when((v >= low) & (v <= high), F.struct(F.lit(k).alias("k"), F.greatest(F.lit(0), F.least(F.floor(part), F.lit(BINS - 1))).cast("int").alias("b"), v.alias("v"))))
    each = x.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).groupBy("c.k", "c.b")
    counts = each.agg(F.count(F.lit(1)).alias("n"), F.min("c.v").alias("low"), F.max("c.v").alias("high")).collect()  # intervals x BINS rows
    for k, key in enumerate(keys):
        parts = sorted((r for r in counts if r["k"] == k), key=lambda r: r["b"])
        for w in open_[key]:
            below = w.below
            for r in parts:
                if w.rank < below + r["n"]:
                    w.low, w.high, w.below = r["low"], r["high"], below
                    break
                below += r["n"]
