"""Catch statistics. All sums are partial-aggregated before the shuffle by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.functions.nulls import ratio, sum_skipna, sum_strict
from seaplate.vocab import BOTTOM_TRAWL, INDUSTRIAL

MILLION = 1e6
BIOMASS_KEYS = ["year", "eez", "fishing_entity", "sector", "reporting_status", "end_use", "scientific_name"]


def selected(gear: str = BOTTOM_TRAWL, sector: str = INDUSTRIAL):
    return (F.col("gear") == gear) & (F.col("sector") == sector)


def gear_sector_filter(catch: DataFrame, **equals) -> DataFrame:
    """Rows whose columns equal the given values; by default the studied gear and sector."""
    equals = equals or {"gear": BOTTOM_TRAWL, "sector": INDUSTRIAL}
    for column, value in equals.items():
        catch = catch.filter(F.col(column) == value)
    return catch


def catch_total_by_year(catch: DataFrame) -> DataFrame:
    return catch.groupBy("year").agg((sum_skipna("tonnes") / MILLION).alias("tonnes_tot"))


def _gear_and_total(catch: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, one pass: tonnes of the studied gear, its row count, and tonnes of all gears."""
    chosen = F.when(selected(), F.col("tonnes"))
    return catch.groupBy(*keys).agg(
        (sum_skipna(chosen) / MILLION).alias("gear_tonnes"),
        F.count(F.when(selected(), 1)).alias("gear_rows"),
        (sum_skipna("tonnes") / MILLION).alias("all_tonnes"),
    )


def gear_share_by_year(catch: DataFrame) -> DataFrame:
    """Per year: tonnes of the studied gear, of all gears, and the percentage."""
    return (
        _gear_and_total(catch, ["year"])
        .filter("gear_rows > 0")
        .select(
            "year",
            F.col("gear_tonnes").alias("tonnes"),
            F.col("all_tonnes").alias("tonnes_tot"),
            (100 * ratio("gear_tonnes", "all_tonnes")).alias("perc_trawl"),
        )
    )


def _with_year_share(groups: DataFrame) -> DataFrame:
    """Attach the totals of each year, computed from the grouped rows, not from the catch again."""
    years = (
        groups.groupBy("year")
        .agg(F.sum("gear_tonnes").alias("tonnes"), F.sum("all_tonnes").alias("tonnes_tot"))
        .withColumn("perc_trawl", 100 * ratio("tonnes", "tonnes_tot"))
    )
    return groups.filter("gear_rows > 0").join(years, "year", "left")


def enduse_share_by_year(catch: DataFrame) -> DataFrame:
    """Tonnes of the studied gear by year and end use, and their share of the year's gear total."""
    return _with_year_share(_gear_and_total(catch, ["year", "end_use"])).select(
        "year",
        "end_use",
        F.col("gear_tonnes").alias("tonnes_end"),
        "tonnes",
        "tonnes_tot",
        "perc_trawl",
        (100 * ratio("gear_tonnes", "tonnes")).alias("perc_enduse"),
    )


def entity_share_for_year(catch: DataFrame, year: int) -> DataFrame:
    """Per fleet in one year: its part of the gear total and of its own total."""
    fleets = _gear_and_total(catch.filter(F.col("year") == year), ["year", "fishing_entity"])
    return _with_year_share(fleets).select(
        "year",
        "fishing_entity",
        F.col("gear_tonnes").alias("tonnes_iso"),
        "tonnes",
        "tonnes_tot",
        "perc_trawl",
        F.col("all_tonnes").alias("tonnes_tot_iso"),
        (100 * ratio("gear_tonnes", "tonnes")).alias("perc_iso"),
        (100 * ratio("gear_tonnes", "all_tonnes")).alias("perc_iso_tot"),
    )


def species_list_for_year(catch: DataFrame, year: int) -> DataFrame:
    return (
        gear_sector_filter(catch)
        .filter(F.col("year") == year)
        .groupBy("year", "scientific_name", "common_name")
        .agg((sum_skipna("tonnes") / MILLION).alias("tonnes_end"))
    )


def catch_cells(catch: DataFrame) -> DataFrame:
    """The studied catch by year, zone, fleet, sector, reporting, end use and species: sum and number of known tonnes.

    Mean biomass, rows per species and sums by zone and fleet all follow from these, so one pass over the catch
    serves all three.
    """
    known = [F.sum("tonnes").alias("sum_tonnes"), F.count("tonnes").alias("n_known")]
    return gear_sector_filter(catch).groupBy(*BIOMASS_KEYS).agg(*known)


def mean_biomass(cells: DataFrame) -> DataFrame:
    """Mean known tonnes of each cell; NULL where none is known."""
    return cells.select(*BIOMASS_KEYS, F.try_divide("sum_tonnes", "n_known").alias("tonnes"))


def mean_biomass_by_key(catch: DataFrame) -> DataFrame:
    """Mean known tonnes of the rows that share year, zone, fleet, sector, reporting, end use and species."""
    return mean_biomass(catch_cells(catch))


def zone_species_tonnes(cells: DataFrame) -> DataFrame:
    """Known tonnes by zone, fleet and species."""
    return cells.groupBy("eez", "fishing_entity", "scientific_name").agg(sum_skipna("sum_tonnes").alias("tonnes"))


def _ranked_total(catch: DataFrame, keys: list[str]) -> DataFrame:
    totals = gear_sector_filter(catch).groupBy(*keys).agg(sum_skipna("tonnes").alias("tonnes"))
    return totals.orderBy(F.desc_nulls_last("tonnes"), *[F.asc_nulls_last(k) for k in keys])


def total_by_species(catch: DataFrame) -> DataFrame:
    return _ranked_total(catch, ["scientific_name"])


def total_by_species_entity(catch: DataFrame) -> DataFrame:
    return _ranked_total(catch, ["scientific_name", "fishing_entity"])


def total_by_species_entity_year(catch: DataFrame) -> DataFrame:
    return _ranked_total(catch, ["scientific_name", "fishing_entity", "gear", "sector", "year"])


def total_for_entity(catch: DataFrame, fishing_entity: str) -> DataFrame:
    return total_by_species_entity_year(catch.filter(F.col("fishing_entity") == fishing_entity))


def zone_species_total(catch: DataFrame, eez: str) -> DataFrame:
    """Species tonnes in one zone; NULL where a row of the species has unknown tonnes."""
    return (
        gear_sector_filter(catch)
        .filter(F.col("eez") == eez)
        .groupBy("common_name", "scientific_name")
        .agg(sum_strict("tonnes").alias("tonnes"))
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
