"""Nutrient ratio reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.functions.nulls import cap_at, ratio
from seaplate.operators.composition import supply_by
from seaplate.operators.shape import left_lookup, wide_sum
from seaplate.vocab import (
    DISCARDS,
    END_USES,
    FISHMEAL,
    HUMAN_CONSUMPTION,
    INDUSTRIAL,
    RATIO_CAPS,
    REPORTED,
    SUPPLY_NUTRIENTS,
    UNREPORTED,
)

FLEET_KEYS = ["year", "fishing_entity"]


def _fleet_supply(biomass: DataFrame, composition: DataFrame, by: str, values: list[str], strict: bool) -> DataFrame:
    industrial = biomass.filter(F.col("sector") == INDUSTRIAL)
    supply = supply_by(industrial, composition, [*FLEET_KEYS, by], strict, fixed=True)
    return wide_sum(supply, [*FLEET_KEYS, "nutrient"], by, {v: v for v in values}, "nut_supply", strict)


def _ranked(df: DataFrame, by: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), *FLEET_KEYS, "nutrient")


def supply_enduse_fmfo(biomass: DataFrame, composition: DataFrame) -> DataFrame:
    """Human consumption against fishmeal per year, fleet and nutrient.

    ``fmfo_dhc_ratio`` is consumption over fishmeal and ``dhc_fmfo_ratio`` the
    reverse; the names are kept as users know them.
    """
    wide = _fleet_supply(biomass, composition, "end_use", END_USES, strict=False)
    wide = wide.withColumn(FISHMEAL, F.coalesce(F.col(FISHMEAL), F.lit(0.0)))
    wide = wide.withColumn("fmfo_dhc_ratio", ratio(HUMAN_CONSUMPTION, FISHMEAL)).withColumn(
        "dhc_fmfo_ratio", ratio(FISHMEAL, HUMAN_CONSUMPTION)
    )
    return _ranked(wide, "fmfo_dhc_ratio")


def supply_discard_ratio(biomass: DataFrame, composition: DataFrame) -> DataFrame:
    wide = _fleet_supply(biomass, composition, "end_use", END_USES, strict=True)
    return _ranked(wide.withColumn("discard_ratio", ratio(DISCARDS, HUMAN_CONSUMPTION)), "discard_ratio")


def supply_reporting_ratio(biomass: DataFrame, composition: DataFrame) -> DataFrame:
    wide = _fleet_supply(biomass, composition, "reporting_status", [REPORTED, UNREPORTED], strict=True)
    return _ranked(wide.withColumn("reporting_ratio", ratio(UNREPORTED, REPORTED)), "reporting_ratio")


def supply_species_matrix(
    biomass: DataFrame, composition: DataFrame, nutrients: list[str] = SUPPLY_NUTRIENTS
) -> DataFrame:
    """One row per species, one column per nutrient, most calcium first."""
    supply = supply_by(biomass.filter(F.col("sector") == INDUSTRIAL), composition, ["scientific_name"], strict=True)
    wide = wide_sum(supply, ["scientific_name"], "nutrient", {n: n for n in nutrients}, "nut_supply", strict=True)
    return wide.orderBy(F.desc_nulls_last("Calcium"), "scientific_name")


def ratio_cap_report(report: DataFrame, countries_iso: DataFrame, metric: str, year: int) -> DataFrame:
    """One year of a ratio report without protein, the ratio capped, with country codes."""
    capped = report.filter((F.col("year") == year) & (F.col("nutrient") != "Protein")).withColumn(
        metric, cap_at(metric, RATIO_CAPS[metric])
    )
    return left_lookup(capped, countries_iso, {"fishing_entity": "missing_countries"}, ["iso3c"])
