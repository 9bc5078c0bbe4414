"""National food balances and the share of the studied catch in them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.functions.nulls import not_in, ratio, sum_skipna, sum_strict
from seaplate.functions.text import lookup, piece, recode
from seaplate.operators.composition import supply_by
from seaplate.operators.shape import left_lookup, wide_sum
from seaplate.vocab import (
    BALANCE_COLUMNS,
    BALANCE_NUTRIENTS,
    BALANCE_SCOPE,
    BLOC,
    DAYS_PER_YEAR,
    DISSOLVED_MEMBER,
    HUMAN_CONSUMPTION,
    INDUSTRIAL,
    PRODUCT_SECTORS,
    WORLD,
)


def balance_parse(wide: DataFrame, scenario: str = "base") -> DataFrame:
    """Plain column names, "name [unit]" split in two, nutrient codes spelled out."""
    named = wide.withColumnsRenamed(BALANCE_COLUMNS)
    return (
        named.withColumn("nutrient_long", piece("elements", r"\[", 0))
        .withColumn("units", F.regexp_replace(piece("elements", r"\[", 1), "]", ""))
        .withColumn("nutrient", recode("nutrient", BALANCE_NUTRIENTS))
        .withColumn("scenario", F.lit(scenario))
    )


def balance_unpivot(parsed: DataFrame, year_pattern: str = r"A?\d{4}A?") -> DataFrame:
    """One row per year; the year columns are known from the schema, missing values are kept."""
    years = [c for c in parsed.columns if re.fullmatch(year_pattern, c)]
    ids = [F.col(c) for c in parsed.columns if c not in years]
    long = parsed.unpivot(ids, [F.col(y) for y in years], "year", "value")
    return long.withColumn("year", F.regexp_replace("year", "A", "").cast("int"))


def balance_scope(long: DataFrame, excluded: DataFrame, nutrients: list[str] = BALANCE_SCOPE) -> DataFrame:
    """Keep the studied nutrients and drop excluded countries; rows without a code stay."""
    codes = excluded.select(F.col("iso").alias("_iso"))
    return long.filter(F.col("nutrient").isin(nutrients)).join(codes, F.col("iso3c") == F.col("_iso"), "left_anti")


def bloc_members(country_key: DataFrame, bloc: str = BLOC, without: str = DISSOLVED_MEMBER) -> DataFrame:
    """Present members of a bloc: (iso3_use, country_use)."""
    members = country_key.filter((F.col("group_code") == bloc) & (F.col("country") != without))
    return members.select(F.col("group_code"), "iso3_use", "country_use")


def bloc_expand(
    df: DataFrame, members: DataFrame, code: str = "iso3c", name: str = "country", bloc: str = BLOC, world: str = WORLD
) -> DataFrame:
    """One copy of each bloc row per member, without the bloc and the world, from one pass over the rows.

    The left join itself makes the copies; a row of a bloc without members goes.
    """
    listed = members.filter(F.col("group_code") == bloc).select(
        F.col("group_code").alias("_bloc"), F.col("iso3_use").alias("_code"), F.col("country_use").alias("_name")
    )
    rows = df.filter(not_in(code, [world])).join(listed, F.col(code) == F.col("_bloc"), "left")
    copy = F.col("_bloc").isNotNull()
    rows = rows.filter(not_in(code, [bloc]) | copy)
    changed = {code: F.when(copy, F.col("_code")).otherwise(F.col(code)), name: F.when(copy, F.col("_name")).otherwise(F.col(name))}
    return rows.withColumns(changed).select(*df.columns)


def production_sector(df: DataFrame) -> DataFrame:
    """Fish, other animal-source food or other food; unlisted products have none."""
    return df.withColumn("production_sector", lookup("products", PRODUCT_SECTORS))


def sector_supply(long: DataFrame, year: int) -> DataFrame:
    """Supply by country, sector and nutrient in one year."""
    foods = long.filter((F.col("products") != "Total food") & (F.col("year") == year))
    return (
        production_sector(foods)
        .groupBy("iso3c", "production_sector", "nutrient")
        .agg(sum_skipna("value").alias("nut_supply"))
        .withColumn("nutrient", recode("nutrient", {"Omega-3 fatty acids": "DHA+EPA"}))
    )


def per_capita_supply(
    biomass: DataFrame,
    composition: DataFrame,
    countries_iso: DataFrame,
    population: DataFrame,
    year: int,
    end_use: str = HUMAN_CONSUMPTION,
) -> DataFrame:
    """Supply per person and day from the studied catch by country; one unknown amount makes it NULL."""
    eaten = biomass.filter(
        (F.col("sector") == INDUSTRIAL) & (F.col("year") == year) & (F.col("end_use") == end_use)
    )
    fleets = supply_by(eaten, composition, ["fishing_entity"], strict=True)
    coded = left_lookup(fleets, countries_iso, {"fishing_entity": "missing_countries"}, ["iso3c"])
    supply = coded.groupBy("iso3c", "nutrient").agg(sum_strict("nut_supply").alias("nut_supply"))
    supply = left_lookup(supply, population.withColumnRenamed("iso3c", "_iso"), {"iso3c": "_iso"}, ["pop"])
    return supply.select(
        "iso3c",
        F.lit("bottom_trawl").alias("production_sector"),
        recode("nutrient", {"Vitamin A, RAE": "Vitamin A"}).alias("nutrient"),
        (ratio("nut_supply", "pop") / DAYS_PER_YEAR).alias("nut_supply"),
    )


SHARE_SECTORS = ["ASF", "Fish", "Other", "bottom_trawl"]


def supply_share_table(sectors: DataFrame, catch_supply: DataFrame) -> DataFrame:
    """The catch as a percentage of fish, animal-source and all food.

    Countries without animal-source food are left out; other gaps count as zero.
    """
    both = sectors.unionByName(catch_supply)
    wide = wide_sum(both, ["iso3c", "nutrient"], "production_sector", {s: s for s in SHARE_SECTORS}, "nut_supply", True)
    wide = wide.na.drop(subset=["ASF"]).na.fill(0.0, SHARE_SECTORS)
    wide = wide.withColumn("total", F.col("ASF") + F.col("Other") + F.col("Fish"))
    wide = wide.withColumn("ASF", F.col("ASF") + F.col("Fish"))
    return (
        wide.withColumn("perc_fish", 100 * ratio("bottom_trawl", "Fish"))
        .withColumn("perc_ASF", 100 * ratio("bottom_trawl", "ASF"))
        .withColumn("perc_tot", 100 * ratio("bottom_trawl", "total"))
    )
