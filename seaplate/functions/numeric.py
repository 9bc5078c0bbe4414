"""Numerical functions: normal tail, as a column and for arrays, and Hermite curves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from seaplate.functions.nulls import ColumnLike, as_col

# Hart (1968), algorithm 5666, for the normal tail up to NORMAL_SPLIT, highest power first.
NORMAL_TOP = [
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376,
]
NORMAL_BOTTOM = [
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
    440.413735824752,
]
NORMAL_SPLIT = 7.07106781186547


def _tail(x, exp, choose):
    """P(Z > x) for x >= 0, from the operations of columns or of arrays."""
    top, bottom = x * NORMAL_TOP[0] + NORMAL_TOP[1], x * NORMAL_BOTTOM[0] + NORMAL_BOTTOM[1]
    for a in NORMAL_TOP[2:]:
        top = top * x + a
    for a in NORMAL_BOTTOM[2:]:
        bottom = bottom * x + a
    fraction = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = x + k / fraction
    return exp(-x * x / 2) * choose(x < NORMAL_SPLIT, top / bottom, 1 / (fraction * math.sqrt(2 * math.pi)))


def upper_normal(z: ColumnLike) -> Column:
    """P(Z > z) for a standard normal Z, to 14 digits of the larger of both tails."""
    z = as_col(z)
    tail = _tail(F.abs(z), F.exp, lambda test, yes, no: F.when(test, yes).otherwise(no))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def upper_normal_array(z: np.ndarray) -> np.ndarray:
    """The same for an array."""
    tail = _tail(np.minimum(np.abs(z), 40.0), np.exp, np.where)  # nothing is left of the tail at 40
    return np.where(z >= 0, tail, 1 - tail)


def piece_index(x: ColumnLike, xs: ColumnLike) -> Column:
    """0-based index of the curve piece that holds ``x``; the end pieces hold everything beyond."""
    x, xs = as_col(x), as_col(xs)
    below = F.size(F.filter(xs, lambda k: k <= x))
    return F.greatest(F.least(below, F.size(xs) - 1) - 1, F.lit(0))


def curve_value(x: ColumnLike, piece: ColumnLike, xs: ColumnLike, ys: ColumnLike, ms: ColumnLike) -> Column:
    """Cubic Hermite value at ``x`` on the given piece of a curve with knots ``xs``, values ``ys``
    and slopes ``ms``; straight lines beyond both ends."""
    x, i = as_col(x), as_col(piece)
    x0, x1 = F.get(as_col(xs), i), F.get(as_col(xs), i + 1)
    y0, y1 = F.get(as_col(ys), i), F.get(as_col(ys), i + 1)
    m0, m1 = F.get(as_col(ms), i), F.get(as_col(ms), i + 1)
    h = x1 - x0
    t = (x - x0) / h
    s = 1 - t
    inside = y0 * (1 + 2 * t) * s * s + y1 * t * t * (3 - 2 * t) + h * t * s * (m0 * s - m1 * t)
    return F.when(x < x0, y0 + m0 * (x - x0)).when(x > x1, y1 + m1 * (x - x1)).otherwise(inside)
