"""Aggregates and arithmetic with explicit rules for missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _when_complete(value: Column, result: Column) -> Column:
    """``result`` if the group holds no missing ``value``, otherwise NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), result)


def sum_skipna(value: ColumnLike) -> Column:
    """Sum of the known values; 0 when there are none."""
    return F.coalesce(F.sum(as_col(value)), F.lit(0.0))


def sum_strict(value: ColumnLike) -> Column:
    """Sum that is NULL as soon as one value is missing."""
    value = as_col(value)
    return _when_complete(value, F.sum(value))


def mean_strict(value: ColumnLike) -> Column:
    value = as_col(value)
    return _when_complete(value, F.avg(value))


def sum_fixed(value: ColumnLike, digits: int, strict: bool = False) -> Column:
    """Sum in whole units of 10**-digits, so that it does not depend on the order of the rows.

    Sums of up to 38 digits are exact; with a value that has no such number of units, as infinity, the
    values are summed as they are. A missing value makes a strict sum NULL and is skipped otherwise.
    """
    value = as_col(value)
    units = F.rint(value * F.lit(10.0**digits)).try_cast("decimal(38,0)")
    total = F.when(F.count(units) == F.count(value), F.sum(units).cast("double") / F.lit(10.0**digits)).otherwise(F.sum(value))
    return _when_complete(value, total) if strict else F.coalesce(total, F.lit(0.0))


def mean_fixed(value: ColumnLike, digits: int) -> Column:
    """Mean from a sum in fixed units; NULL with a missing value."""
    return sum_fixed(value, digits, strict=True) / F.count(F.lit(1))


def sd_strict(value: ColumnLike) -> Column:
    """Sample standard deviation; NULL for one row or with a missing value."""
    value = as_col(value)
    return _when_complete(value, F.stddev_samp(value))


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Division where x/0 is signed infinity and 0/0 is NULL."""
    n, d = as_col(numerator), as_col(denominator)
    by_zero = F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf")))
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def cap_at(value: ColumnLike, cap: ColumnLike | float) -> Column:
    """Values above ``cap`` become ``cap``; NULL stays NULL, a NULL cap leaves the value."""
    value = as_col(value)
    cap = F.lit(cap) if isinstance(cap, (int, float)) else as_col(cap)
    return F.when(value > cap, cap).otherwise(value)


def floor_at_zero(value: ColumnLike) -> Column:
    value = as_col(value)
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def same_or_other(left: ColumnLike, right: ColumnLike) -> Column:
    """``your_country`` / ``other_country``; NULL when either side is unknown."""
    left, right = as_col(left), as_col(right)
    return F.when(left == right, F.lit("your_country")).when(left != right, F.lit("other_country"))


def not_in(value: ColumnLike, excluded: list) -> Column:
    """Negated membership that keeps NULL."""
    value = as_col(value)
    return value.isNull() | ~value.isin(excluded)


def dim_first(df: DataFrame, key: str | list[str], tiebreak: str | list[str]) -> DataFrame:
    """One row per key: the one that comes first in ``tiebreak`` order."""
    keys = [key] if isinstance(key, str) else list(key)
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    order = F.struct(*[F.col(f"`{c}`") for c in ties])
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    picked = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(row, order).alias("_row"))
    return picked.select(*[F.col(f"`{k}`") for k in keys], *[F.col("_row")[c].alias(c) for c in rest]).select(
        *[F.col(f"`{c}`") for c in df.columns]
    )
