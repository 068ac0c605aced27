"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c, digits: int) -> Column:
    """Round half away from zero on the binary value: round(x * 10^d) / 10^d.

    Spark's ``round`` rounds the decimal *string* of a double half-up, so a
    double such as 40118.49135 (stored as ...491349999) rounds up there but
    down in numpy, Python and most SQL engines. Scaling first makes every
    engine agree on such ties.
    """
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.round(col * F.lit(scale), 0) / F.lit(scale)
