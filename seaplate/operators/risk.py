"""Relative-risk curves, requirements, exposure values, attributable fractions and affected people.

A curve is one row: ordered arrays of knots, values and slopes. An exposure value
is an integral inside its own row and adds no shuffle. Curves join on their codes like any
table; whether they are small enough to broadcast is Spark's size-checked choice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from seaplate.functions.nulls import ColumnLike, floor_at_zero, ratio
from seaplate.functions.numeric import curve_value, piece_index, upper_normal
from seaplate.functions.quadrature import curve_integral, fit_struct, numbered_curve_integral, shortfall_integral
from seaplate.functions.quantiles import gamma_tails
from seaplate.functions.text import lookup, recode
from seaplate.operators.intake import demographic_labels
from seaplate.operators.shape import wide_sum
from seaplate.vocab import (
    DEFAULT_CV,
    MEAT_END_KNOTS,
    MEAT_OUTCOMES,
    OMEGA3,
    OMEGA_END_KNOTS,
    REQUIREMENT_COLUMNS,
    REQUIREMENT_CV,
    RISK_FREE_AGES,
    SEV_NUTRIENTS,
    TAIL_Z,
)

CURVE_COLUMNS = ["xs", "ys", "ms", "last_risk"]
MAX_CURVES = 10_000  # a few megabytes of knots


def age_points(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Long (keys, x, age_id, y) points from a matrix with one ``age<code>`` column per age."""
    ages = [c for c in wide.columns if re.fullmatch(r"age\d+", c)]
    long = wide.select(*keys, "x", *ages).unpivot([F.col(c) for c in [*keys, "x"]], [F.col(a) for a in ages], "age", "y")
    return long.withColumn("age_id", F.substring("age", 4, 9).cast("int")).drop("age")


def meat_points(wide: DataFrame, outcomes: dict[str, int] = MEAT_OUTCOMES) -> DataFrame:
    """Red-meat points by outcome code; ``x`` is the intake of the row.

    An outcome that is not listed keeps its curve, under minus the crc32 of its name.
    """
    name = F.col("`Diet.high.in.red.meat`")
    code = F.coalesce(lookup(name, outcomes).cast("long"), -F.crc32(name))
    return age_points(wide.withColumn("cause_id", code), ["cause_id"])


def _secants(k: Column) -> Column:
    """Slope of the straight line between each knot and the next."""

    def slope(i: Column) -> Column:
        left, right = F.get(k, i), F.get(k, i + 1)
        return (right["y"] - left["y"]) / (right["x"] - left["x"])

    return F.transform(F.sequence(F.lit(0), F.size(k) - 2), slope)


def curves(points: DataFrame, end_knots: tuple, keys: list[str]) -> DataFrame:
    """One row per curve: knots ``xs``, values ``ys``, monotone slopes ``ms``, and the last risk.

    A knot is added at each end, with risk 1 at the low one and the last measured risk at the
    high one, wherever the measured points lie; values at the same x, the added
    ones too, are averaged, and knots sorted, all in one pass over the points. Start slopes are the end secants at the ends and the
    mean of both secants inside; they are limited as in Fritsch and Carlson (1980). Points
    without x or value are left out. A curve's points meet in one task, since
    each slope depends on the one before.
    """
    (low_x, low_y), high_x = (tuple(map(float, end_knots[0])), float(end_knots[1]))
    known = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, F.col("x").cast("double"), F.col("y").cast("double"))
    cells = known.groupBy(*keys, "x").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    knots = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y", "n"))).alias("p"))
    knots = knots.withColumn("last_risk", F.element_at("p", -1)["y"])
    ends = ((low_x, F.lit(low_y)), (high_x, F.col("last_risk")))

    def merged(q: Column) -> Column:
        y = q["y"]
        for x, risk in ends:
            y = F.when(q["x"] == x, (q["y"] * q["n"] + risk) / (q["n"] + 1)).otherwise(y)
        return F.named_struct(F.lit("x"), q["x"], F.lit("y"), y)

    def added(x: float, risk: Column) -> Column:
        own = F.array(F.struct(F.lit(x).alias("x"), risk.alias("y")))
        return F.when(~F.exists("p", lambda q: q["x"] == x), own).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

    knots = knots.withColumn("k", F.array_sort(F.concat(F.transform("p", merged), *(added(x, y) for x, y in ends)))).withColumn("s", _secants(F.col("k")))
    return knots.select(
        *keys, F.col("k.x").alias("xs"), F.col("k.y").alias("ys"), _limited_slopes(F.col("s")).alias("ms"), "last_risk"
    )


def _limited_slopes(secants: Column) -> Column:
    """Slope per knot from the secants, limited piece by piece from the left.

    The right slope of a piece, once limited, is the left slope of the next.
    """

    def step(state: Column, i: Column) -> Column:
        secant, following, left = F.get(secants, i), F.get(secants, i + 1), state["slope"]
        right = F.when(following.isNull(), secant).otherwise((secant + following) / 2)
        a, b = F.try_divide(left, secant), F.try_divide(right, secant)
        # Monotone where 2a+b <= 3, a+2b <= 3 or phi >= 0; otherwise back to the circle of radius 3.
        phi = a - F.try_divide((2 * a + b - 3) * (2 * a + b - 3), 3 * (a + b - 2))
        outside = (2 * a + b > 3) & (a + 2 * b > 3) & (phi < 0)
        shrink = F.when(outside, F.try_divide(F.lit(3.0), F.sqrt(a * a + b * b))).otherwise(F.lit(1.0))
        flat = secant == 0
        return F.struct(
            F.when(flat, F.lit(0.0)).otherwise(right * shrink).alias("slope"),
            F.concat(state["done"], F.array(F.when(flat, F.lit(0.0)).otherwise(left * shrink))).alias("done"),
        )

    start = F.struct(F.get(secants, F.lit(0)).alias("slope"), F.array().cast("array<double>").alias("done"))
    pieces = F.sequence(F.lit(0), F.size(secants) - 1)
    return F.aggregate(pieces, start, step, lambda state: F.concat(state["done"], F.array(state["slope"])))


def omega_curves(points: DataFrame, end_knots: tuple = OMEGA_END_KNOTS) -> DataFrame:
    return curves(points, end_knots, ["age_id"])


def meat_curves(points: DataFrame, end_knots: tuple = MEAT_END_KNOTS) -> DataFrame:
    return curves(points, end_knots, ["cause_id", "age_id"])


def curve_table(curve_rows: DataFrame) -> DataFrame:
    """One row per piece of every curve."""
    keys = [c for c in curve_rows.columns if c not in ("xs", "ys", "ms")]
    pieces = curve_rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.size("xs") - 2)))
    ends = [
        F.get(column, F.col("piece") + step).alias(f"{name}{step}")
        for name, column in (("x", "xs"), ("y", "ys"), ("m", "ms"))
        for step in (0, 1)
    ]
    return pieces.select(*keys, "piece", *ends)


def _adult(value: Column) -> Column:
    """0 for the youngest age codes, which carry no such risk."""
    return F.when(F.col("age_id").isin(RISK_FREE_AGES), F.lit(0.0)).otherwise(value)


def curve_risk(intakes: DataFrame, curve_rows: DataFrame, keys: list[str], x: str = "x", name: str = "risk") -> DataFrame:
    """Relative risk at ``x`` on the curve of the row's keys."""
    joined = intakes.join(curve_rows, keys, "left").withColumn("_piece", piece_index(x, "xs"))
    risk = _adult(curve_value(x, "_piece", "xs", "ys", "ms"))
    return joined.withColumn(name, risk).drop("_piece", *CURVE_COLUMNS)


def omega_risk(intakes: DataFrame, omega: DataFrame) -> DataFrame:
    return curve_risk(intakes, omega, ["age_id"])


def red_meat_risk(intakes: DataFrame, meat: DataFrame) -> DataFrame:
    return curve_risk(intakes, meat, ["cause_id", "age_id"])


def requirement_rows(wide: DataFrame) -> DataFrame:
    """Long requirements (nutrient, availability, age_id, sex_id, ear); availability is NULL where it plays no part."""
    cells = F.array(
        *[
            F.struct(
                F.lit(nutrient).alias("nutrient"),
                F.lit(availability).cast("string").alias("availability"),
                F.col(f"`{column}`").alias("ear"),
            )
            for (nutrient, availability), column in REQUIREMENT_COLUMNS.items()
        ]
    )
    return wide.select(
        F.col("age_groups").alias("age_id"), F.col("sex_groups").alias("sex_id"), F.inline(cells)
    )


def ear_lookup(df: DataFrame, requirements: DataFrame, sdi: DataFrame) -> DataFrame:
    """Add ``sdi_group`` and the average requirement ``ear``.

    Iron and zinc depend on the development group, so they have none without it.
    """
    groups = sdi.select(F.col("iso3").alias("_iso"), "sdi_group")
    df = df.join(groups, F.col("iso3") == F.col("_iso"), "left").drop("_iso")
    by_group = F.col("nutrient").isin("Iron", "Zinc")
    df = df.withColumn("_availability", F.when(by_group, F.coalesce("sdi_group", F.lit("unknown"))).otherwise(F.lit("any")))
    needs = requirement_rows(requirements).select(
        "nutrient", F.coalesce("availability", F.lit("any")).alias("_availability"), "age_id", "sex_id", "ear"
    )
    return df.join(needs, ["nutrient", "_availability", "age_id", "sex_id"], "left").drop("_availability")


def requirement_cv(nutrient: ColumnLike = "nutrient") -> Column:
    return F.coalesce(lookup(nutrient, REQUIREMENT_CV), F.lit(DEFAULT_CV))


def micronutrient_risk(df: DataFrame, x: str = "x", name: str = "risk") -> DataFrame:
    """Probability that intake ``x`` is below the requirement, normal around ``ear``."""
    return df.withColumn(name, upper_normal(F.try_divide(F.col(x) - F.col("ear"), requirement_cv() * F.col("ear"))))


def _is_gamma() -> Column:
    return (F.col("best_dist") == "gamma") & (F.col("g_shape") > 0) & (F.col("g_rate") > 0)


def with_tails(df: DataFrame) -> DataFrame:
    """Add ``g_low`` and ``g_high``, the unit-rate tail quantiles of a gamma row's shape.

    The distinct shapes are a frame of their own, each is solved once, and rows get them by a join on the shape.
    """
    shapes = df.filter(_is_gamma()).select(F.col("g_shape").alias("_shape")).distinct()
    solved = shapes.withColumn("_unit", gamma_tails("_shape")).select("_shape", F.col("_unit.low").alias("g_low"), F.col("_unit.high").alias("g_high"))
    return df.join(solved, F.when(_is_gamma(), F.col("g_shape")) == F.col("_shape"), "left").drop("_shape")


def intake_bounds(df: DataFrame) -> DataFrame:
    """Add the intake at the two tail quantiles; NULL for an unknown distribution."""
    is_lognormal = (F.col("best_dist") == "log-normal") & (F.col("ln_sdlog") > 0)
    is_gamma = _is_gamma()
    df = with_tails(df)

    def bound(z: float, unit: str) -> Column:
        lognormal = F.exp(F.col("ln_meanlog") + F.lit(z) * F.col("ln_sdlog")) + F.col("ln_mean_diff")
        gamma = F.col(unit) / F.col("g_rate") + F.col("g_mean_diff")
        return F.when(is_lognormal, lognormal).when(is_gamma, gamma)

    return df.withColumn("val_lo", bound(-TAIL_Z, "g_low")).withColumn("val_hi", bound(TAIL_Z, "g_high")).drop("g_low", "g_high")


def numbered_curves(curve_rows: DataFrame, most: int = MAX_CURVES) -> tuple[DataFrame, list[tuple]] | None:
    """The curves' keys and last risks with a number each, and the knots, values and slopes by number; None if there
    are more than ``most``, which then do not pass through the driver."""
    found = curve_rows.limit(most + 1).collect()
    if len(found) > most:
        return None
    keys = [c for c in curve_rows.columns if c not in ("xs", "ys", "ms")]
    schema = StructType([*(curve_rows.schema[c] for c in keys), StructField("_curve", IntegerType())])
    rows = curve_rows.sparkSession.createDataFrame([(*(r[c] for c in keys), i) for i, r in enumerate(found)], schema)
    return rows, [(r["xs"], r["ys"], r["ms"]) for r in found]


def _with_integral(df: DataFrame, curve_rows: DataFrame) -> DataFrame:
    """Add ``integral``, the mean risk of each row's intake on the curve of its age (one row per outcome).

    Curves are known by number on their way to Python, and the table of curves goes there once; only where there are very many
    does each row take its own curve along.
    """
    df, numbered = with_tails(df), numbered_curves(curve_rows)
    if numbered is None:
        label = F.concat_ws(" ", "age_id", *(c for c in ("cause_id",) if c in curve_rows.columns))
        rows = df.join(curve_rows, "age_id", "left")
        integral = curve_integral(fit_struct(), F.when(F.col("xs").isNotNull(), label), "xs", "ys", "ms")
    else:
        keys, knots = numbered
        rows = df.join(keys, "age_id", "left")
        integral = numbered_curve_integral(df.sparkSession.sparkContext.broadcast(knots))(fit_struct(), "_curve")
    return rows.withColumn("integral", integral).drop("xs", "ys", "ms", "_curve", "g_low", "g_high")


def sev_micronutrient(df: DataFrame, requirements: DataFrame, sdi: DataFrame) -> DataFrame:
    """Exposure value: percentage of the intake distribution at risk of being below the requirement."""
    rows = df.filter(F.col("nutrient").isin(SEV_NUTRIENTS) & (F.col("age_id") >= 5))
    rows = with_tails(ear_lookup(rows, requirements, sdi))
    return rows.withColumn("sev", 100 * shortfall_integral(fit_struct(), "ear", requirement_cv())).drop("g_low", "g_high")


def sev_omega3(df: DataFrame, omega: DataFrame, min_age: int = 10) -> DataFrame:
    """Exposure value for low omega-3: 0 at the lowest risk of the curve, 100 at risk 1."""
    rows = _with_integral(df.filter((F.col("nutrient") == OMEGA3) & (F.col("age_id") >= min_age)), omega)
    excess = ratio(F.col("integral") - F.col("last_risk"), 1 - F.col("last_risk")) * 100
    return rows.withColumn("sev", floor_at_zero(_adult(excess))).drop("integral", "last_risk")


def sev_red_meat(df: DataFrame, meat: DataFrame) -> DataFrame:
    """Exposure value for high red-meat intake, one row per outcome: 0 at risk 1, 100 at the highest risk."""
    rows = _with_integral(df, meat)
    excess = ratio(F.col("integral") - 1, F.col("last_risk") - 1) * 100
    return rows.withColumn("sev", floor_at_zero(_adult(excess))).drop("integral", "last_risk")


def _scenario_integrals(df: DataFrame, curve_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Risk integrals of both scenarios side by side: ``base`` and ``high`` per key."""
    groups = [*keys, *(c for c in ("cause_id",) if c in curve_rows.columns), "age_id", "last_risk"]
    columns = {"Base": "base", "High road": "high"}
    return wide_sum(_with_integral(df, curve_rows), groups, "scenario", columns, "integral", strict=True)


def paf_red_meat(df: DataFrame, meat: DataFrame, keys: list[str], relative: bool) -> DataFrame:
    """Attributable fraction per outcome: relative change between scenarios, or the share above risk 1."""
    rows = _scenario_integrals(df, meat, keys)
    if relative:
        paf = ratio(F.col("high") - F.col("base"), "base")
    else:
        paf = floor_at_zero(ratio(F.col("base") - 1, "base"))
    return rows.withColumn("paf", _adult(paf)).drop("last_risk")


def paf_omega3(df: DataFrame, omega: DataFrame, keys: list[str], relative: bool) -> DataFrame:
    """Attributable fraction: relative change between scenarios, or the share above the lowest risk."""
    rows = _scenario_integrals(df, omega, keys)
    lowest = F.col("base") if relative else F.col("last_risk")
    gain = (F.col("high") if relative else F.col("base")) - lowest
    return rows.withColumn("paf", _adult(ratio(gain, "base"))).drop("last_risk")


SEV_KEYS = ["nutrient", "country", "iso3", "sex_id", "age_id"]


def sev_scenario_delta(*sevs: DataFrame) -> DataFrame:
    """Base and high exposure side by side; ``sev_reduction`` is base minus high, ``sev_delta`` the reverse."""
    stacked = None
    for sev in sevs:
        part = sev.select(*SEV_KEYS, "scenario", "sev")
        stacked = part if stacked is None else stacked.unionByName(part)
    columns = {"Base": "sev_base", "High road": "sev_high"}
    return (
        wide_sum(stacked, SEV_KEYS, "scenario", columns, "sev", strict=True)
        .withColumn("sev_reduction", F.col("sev_base") - F.col("sev_high"))
        .withColumn("sev_delta", F.col("sev_high") - F.col("sev_base"))
    )


def population_slice(population: DataFrame, year: int) -> DataFrame:
    """People by country, sex and age group in one projection year."""
    return population.filter(F.col("year") == year).select(
        F.col("iso3_use").alias("iso3"),
        recode("sex", {"male": "Males", "female": "Females"}).alias("sex"),
        F.col("age_range").alias("age_group"),
        F.col("pop_size_50perc").alias("npeople"),
    )


def people_affected(deltas: DataFrame, people: DataFrame) -> DataFrame:
    """People at risk in both scenarios, and the size of the decrease (0 where it grows)."""
    rows = demographic_labels(deltas).join(people, ["iso3", "sex", "age_group"], "left")
    rows = rows.withColumn("ndeficient_base", F.col("npeople") * F.col("sev_base") / 100)
    rows = rows.withColumn("ndeficient_high", F.col("npeople") * F.col("sev_high") / 100)
    change = F.col("ndeficient_high") - F.col("ndeficient_base")
    return rows.withColumn("ndeficient_diff", F.abs(F.when(change > 0, F.lit(0.0)).otherwise(change)))
