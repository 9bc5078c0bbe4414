"""Integrals of risk over fitted intake distributions, as Arrow column functions.

With R the risk and F the distribution function, the integral of R over the distribution between its tail
quantiles is taken by parts: R F at both ends less the integral of R' F. R' is the normal density around
a requirement, or a polynomial on each piece of a curve, and F has no peak or pole, whatever the
shape or spread of the fit. The range is cut where R' changes (around the requirement, at the curve's
knots) and at quantiles of the distribution, and each part gets ``NODES`` Gauss-Legendre nodes.

A row is worked out by itself, so there is no shuffle. Where the risk does not change, F is not asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seaplate.functions.numeric import upper_normal_array
from seaplate.functions.quantiles import gamma_mass, usable
from seaplate.vocab import HIGH_TAIL, LOW_TAIL, TAIL_Z

NODES = 12
CHUNK = 512
GAUSS_X, GAUSS_W = np.polynomial.legendre.leggauss(NODES)
QUANTILE_Z = np.linspace(-TAIL_Z, TAIL_Z, 17)
BELOW_HIGH = np.geomspace(1e-7, 0.5, 15)
REQUIREMENT_Z = np.array([-9.0, -6.5, -5.0, -4.0, -3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.5, 9.0])
FIT_COLUMNS = ["best_dist", "g_shape", "g_rate", "g_mean_diff", "g_low", "g_high", "ln_meanlog", "ln_sdlog", "ln_mean_diff"]


def fit_struct() -> Column:
    """The fitted distribution of a row, with the unit-rate tails of its gamma shape, as one argument."""
    return F.struct(*FIT_COLUMNS)


class Lognormal:
    """Shifted log-normal distributions, one per row."""

    def __init__(self, fit: pd.DataFrame):
        self.mu, self.sd, self.shift = (fit[c].to_numpy(dtype="float64")[:, None] for c in ("ln_meanlog", "ln_sdlog", "ln_mean_diff"))
        self.cuts = np.exp(self.mu + self.sd * QUANTILE_Z) + self.shift
        self.low, self.high = self.cuts[:, :1], self.cuts[:, -1:]

    def below(self, x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """P(X <= x), rows by nodes, where it is ``wanted``."""
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (np.log(np.maximum(x - self.shift, 0.0)) - self.mu) / self.sd
        return upper_normal_array(-z)


class Gamma:
    """Shifted gamma distributions, one per row, with given unit-rate tails."""

    def __init__(self, fit: pd.DataFrame):
        columns = ("g_shape", "g_rate", "g_mean_diff", "g_low", "g_high")
        self.shape, self.rate, self.shift, low, high = (fit[c].to_numpy(dtype="float64")[:, None] for c in columns)
        # Wilson and Hilferty's quantiles for large shapes, and steps by a factor for small ones; only places to cut.
        near = 1 - 1 / (9 * self.shape) + QUANTILE_Z / (3 * np.sqrt(self.shape))
        cuts = np.concatenate([self.shape * np.maximum(near, 0) ** 3, high * BELOW_HIGH], axis=1)
        self.cuts = np.clip(cuts, low, high) / self.rate + self.shift
        self.low, self.high = low / self.rate + self.shift, high / self.rate + self.shift

    def below(self, x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        unit = np.maximum((x - self.shift) * self.rate, 0.0)
        with np.errstate(divide="ignore"):
            log_x = np.log(unit)
        out = np.zeros(x.shape)
        some = wanted & (unit > 0)
        out[some] = gamma_mass(np.broadcast_to(self.shape, x.shape)[some], log_x[some])
        return out


Fits = Lognormal | Gamma


def fits_of(fit: pd.DataFrame) -> Iterator[tuple[np.ndarray, Fits]]:
    """(row positions, distributions) of the rows with a known distribution, in bounded chunks."""
    kinds = [
        (Lognormal, (fit["best_dist"] == "log-normal").to_numpy(dtype=bool) & usable(fit["ln_sdlog"])),
        (Gamma, (fit["best_dist"] == "gamma").to_numpy(dtype=bool) & usable(fit["g_shape"]) & usable(fit["g_rate"])),
    ]
    for kind, mask in kinds:
        rows = np.flatnonzero(mask)
        for start in range(0, len(rows), CHUNK):
            part = rows[start : start + CHUNK]
            yield part, kind(fit.iloc[part])


def by_parts(fits: Fits, cuts: np.ndarray, risk: Callable, slope: Callable) -> np.ndarray:
    """The integral of ``risk`` over each row's distribution between its tail quantiles; ``cuts`` are where its slope changes."""
    places = np.sort(np.clip(np.concatenate([fits.low, fits.high, fits.cuts, cuts], axis=1), fits.low, fits.high), axis=1)
    half = np.diff(places, axis=1) / 2
    middle = (places[:, 1:] + places[:, :-1]) / 2
    x = (middle[:, :, None] + half[:, :, None] * GAUSS_X).reshape(len(places), -1)
    weights = (half[:, :, None] * GAUSS_W).reshape(len(places), -1)
    change = weights * slope(x)  # 0 where parts are empty or the risk is flat
    inner = (change * fits.below(x, change != 0)).sum(axis=1)
    return (risk(fits.high) * HIGH_TAIL - risk(fits.low) * LOW_TAIL)[:, 0] - inner


@F.pandas_udf(DoubleType())
def shortfall_integral(fit: pd.DataFrame, ear: pd.Series, cv: pd.Series) -> pd.Series:
    """Probability that intake is below a requirement that is normal around ``ear``."""
    need, spread = ear.to_numpy(dtype="float64"), (ear * cv).to_numpy(dtype="float64")
    spread = np.where(spread == 0, np.nan, spread)
    result = np.full(len(fit), np.nan)
    for rows, fits in fits_of(fit):
        m, s = need[rows, None], spread[rows, None]
        known = ~np.isnan(m + s)[:, 0]
        cuts = np.where(known[:, None], m + s * REQUIREMENT_Z, 0.0)
        with np.errstate(invalid="ignore"):
            integral = by_parts(
                fits,
                cuts,
                lambda x, m=m, s=s: upper_normal_array((x - m) / s),
                lambda x, m=m, s=s: -np.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi)),
            )
        result[rows] = np.where(known, integral, np.nan)
    return pd.Series(result)


def hermite_array(x: np.ndarray, xs: np.ndarray, ys: np.ndarray, ms: np.ndarray, slope: bool = False) -> np.ndarray:
    """Values, or slopes, of one curve at any array of intakes; straight lines beyond its ends."""
    i = np.clip(np.searchsorted(xs, x, side="right") - 1, 0, len(xs) - 2)
    h = (xs[1:] - xs[:-1])[i]
    t = (x - xs[i]) / h
    s = 1 - t
    if slope:
        inside = 6 * t * s * (ys[i + 1] - ys[i]) / h + ms[i] * s * (1 - 3 * t) + ms[i + 1] * t * (3 * t - 2)
        return np.where(x < xs[0], ms[0], np.where(x > xs[-1], ms[-1], inside))
    inside = ys[i] * (1 + 2 * t) * s * s + ys[i + 1] * t * t * (3 - 2 * t) + h * t * s * (ms[i] * s - ms[i + 1] * t)
    below = ys[0] + ms[0] * (x - xs[0])
    above = ys[-1] + ms[-1] * (x - xs[-1])
    return np.where(x < xs[0], below, np.where(x > xs[-1], above, inside))


def _curve_integrals(fit: pd.DataFrame, curve: pd.Series, knots_of: Callable) -> pd.Series:
    """Mean risks of rows on their curves; ``knots_of`` gives a curve's knots, values and slopes by its name and a row of it."""
    result = np.full(len(fit), np.nan)
    for name, positions in curve.groupby(curve, dropna=True).indices.items():
        knots = [np.asarray(a, dtype="float64") for a in knots_of(name, positions[0])]
        for rows, fits in fits_of(fit.iloc[positions]):
            cuts = np.broadcast_to(knots[0], (len(rows), len(knots[0])))
            result[positions[rows]] = by_parts(
                fits, cuts, lambda x, k=knots: hermite_array(x, *k), lambda x, k=knots: hermite_array(x, *k, slope=True)
            )
    return pd.Series(result)


@F.pandas_udf(DoubleType())
def curve_integral(fit: pd.DataFrame, curve: pd.Series, xs: pd.Series, ys: pd.Series, ms: pd.Series) -> pd.Series:
    """Mean relative risk of the intake distribution on the row's own curve; ``curve`` tells curves apart."""
    return _curve_integrals(fit, curve, lambda _, row: (xs.iloc[row], ys.iloc[row], ms.iloc[row]))


def numbered_curve_integral(curves: Broadcast):
    """Column function: the same on the curve with the row's number, from a broadcast list of (knots, values, slopes)."""

    @F.pandas_udf(DoubleType())
    def integral(fit: pd.DataFrame, number: pd.Series) -> pd.Series:
        return _curve_integrals(fit, number, lambda name, _: curves.value[int(name)])

    return integral
