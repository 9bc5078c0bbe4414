"""Long-to-wide aggregation and totals that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaplate.functions.nulls import as_col


def wide_sum(
    df: DataFrame,
    keys: list[str],
    pivot: str,
    columns: dict[str, str],
    value: str,
    strict: bool = False,
) -> DataFrame:
    """Sum ``value`` per key into one column per listed pivot value, in a single aggregate.

    ``columns`` maps pivot values to output names. A key without any row for a
    pivot value gets NULL; rows with another or NULL pivot value keep their key.
    With ``strict`` one missing value makes the cell NULL, otherwise it is skipped.
    """

    def cell(wanted: str) -> Column:
        hit = F.col(f"`{pivot}`") == wanted
        total, rows = F.sum(F.when(hit, as_col(value))), F.count(F.when(hit, 1))
        if strict:
            return F.when(F.count(F.when(hit, as_col(value))) == rows, total)
        return F.coalesce(total, F.when(rows > 0, F.lit(0.0)))

    return df.groupBy(*keys).agg(*[cell(v).alias(name) for v, name in columns.items()])


def left_lookup(df: DataFrame, dim: DataFrame, on: dict[str, str], keep: list[str]) -> DataFrame:
    """Left join of ``dim`` columns ``keep`` where ``df`` key = ``dim`` key, without the dim keys."""
    renamed = dim.select(
        *[F.col(f"`{theirs}`").alias(f"_key_{i}") for i, theirs in enumerate(on.values())],
        *[F.col(f"`{c}`") for c in keep],
    )
    condition = None
    for i, ours in enumerate(on):
        match = df[ours] == renamed[f"_key_{i}"]
        condition = match if condition is None else condition & match
    joined = df.join(renamed, condition, "left")
    return joined.drop(*[f"_key_{i}" for i in range(len(on))])
