"""Own and foreign catch by zone and by fleet, in tonnes and in nutrients.

The catch is summed on its raw zone and fleet names first; names are split and
resolved to countries on the few resulting rows, never on catch rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.functions.nulls import dim_first, mean_strict, ratio, same_or_other, sum_skipna, sum_strict
from seaplate.functions.text import lookup, piece, plain_name, trim_space, ZONE_SEPARATORS
from seaplate.operators.catch import gear_sector_filter
from seaplate.operators.shape import left_lookup, wide_sum
from seaplate.vocab import DAYS_PER_YEAR, GROUPED_COUNTRIES, PORTIONS_PER_TONNE

OWN_OTHER = {"your_country": "your_country", "other_country": "other_country"}
ZONE_FLEET = ["eez_country", "eez_iso", "continent", "fishing_entity", "fishing_entity_ISO"]


def zone_split(df: DataFrame, zone: str = "eez") -> DataFrame:
    """Add the country and the region part of a zone name."""
    return df.withColumn("eez_country", trim_space(piece(zone, ZONE_SEPARATORS, 0))).withColumn(
        "eez_region", piece(zone, ZONE_SEPARATORS, 1)
    )


def aliases_from_key(country_key: DataFrame) -> DataFrame:
    """Alias table (alias, iso3c, continent) from a country key with long and short names."""
    code = F.col("iso3_use").alias("iso3c")
    continent = F.col("continent_region").alias("continent")
    names = F.explode(F.array("country", "country_use")).alias("alias")
    return country_key.select(names, code, continent).distinct()


def country_resolve(
    df: DataFrame,
    name: str,
    aliases: DataFrame,
    patterns: list[tuple[str, str, str]] = (),
    code: str = "iso3c",
) -> DataFrame:
    """Add the country code and continent of a written country name.

    Names match an alias after folding case, accents and punctuation; what is
    left over is tried against the (pattern, code, continent) list in order.
    Unknown names stay NULL.
    """
    known = dim_first(
        aliases.select(plain_name("alias").alias("_alias"), F.col("iso3c").alias("_code"), F.col("continent").alias("_cont")),
        "_alias",
        ["_code", "_cont"],
    )
    df = df.withColumn("_plain", plain_name(name))
    df = left_lookup(df, known, {"_plain": "_alias"}, ["_code", "_cont"])
    by_code, by_continent = F.col("_code"), F.col("_cont")
    for pattern, iso3, continent in patterns:
        hit = F.col("_code").isNull() & F.col("_plain").rlike(pattern)
        by_code = F.coalesce(by_code, F.when(hit, F.lit(iso3)))
        by_continent = F.coalesce(by_continent, F.when(hit, F.lit(continent)))
    return df.withColumn(code, by_code).withColumn("continent", by_continent).drop("_plain", "_code", "_cont")


def unresolved_names(catch: DataFrame, countries_iso: DataFrame, aliases: DataFrame, patterns=()) -> DataFrame:
    """Zone and fleet names of the studied catch that resolve to no country, with their tonnes, most first."""
    raw = gear_sector_filter(catch).groupBy("eez", "fishing_entity").agg(sum_skipna("tonnes").alias("tonnes"))
    pairs = attach_countries(raw, countries_iso, aliases, patterns)
    sides = F.array(
        F.struct(F.lit("zone").alias("side"), F.col("eez_country").alias("name"), F.col("eez_iso").alias("iso")),
        F.struct(F.lit("fleet").alias("side"), F.col("fishing_entity").alias("name"), F.col("fishing_entity_ISO").alias("iso")),
    )
    open_ = pairs.select("tonnes", F.inline(sides)).filter("iso is null")
    totals = open_.groupBy("side", "name").agg(F.sum("tonnes").alias("tonnes"))
    return totals.orderBy(F.desc("tonnes"), "side", F.asc_nulls_last("name"))


def country_name(df: DataFrame, code: str, names: DataFrame, name: str = "country") -> DataFrame:
    """Add the display name of a country code; grouped codes have fixed names, others show the code."""
    known = dim_first(names.select(F.col("iso3c").alias("_c"), F.col("country").alias("_name")), "_c", "_name")
    df = left_lookup(df, known, {code: "_c"}, ["_name"])
    return df.withColumn(name, F.coalesce("_name", lookup(code, GROUPED_COUNTRIES), code)).drop("_name")


def own_foreign_flag(df: DataFrame, zone: str = "eez_iso", fleet: str = "fishing_entity_ISO") -> DataFrame:
    return df.withColumn("is_same", same_or_other(zone, fleet))


def attach_countries(df: DataFrame, countries_iso: DataFrame, aliases: DataFrame, patterns=()) -> DataFrame:
    """Zone country, zone code, continent and fleet code for raw zone and fleet names."""
    df = country_resolve(zone_split(df), "eez_country", aliases, patterns, code="eez_iso")
    iso = countries_iso.select("missing_countries", F.col("iso3c").alias("fishing_entity_ISO"))
    return left_lookup(df, iso, {"fishing_entity": "missing_countries"}, ["fishing_entity_ISO"])


def zone_fleet_tonnes(catch: DataFrame, countries_iso: DataFrame, aliases: DataFrame, patterns=()) -> DataFrame:
    """Tonnes by zone country and fleet with the own/foreign flag; unknown tonnes make a group NULL."""
    raw = gear_sector_filter(catch).groupBy("eez", "fishing_entity").agg(sum_strict("tonnes").alias("tonnes"))
    pairs = attach_countries(raw, countries_iso, aliases, patterns)
    return own_foreign_flag(pairs.groupBy(*ZONE_FLEET).agg(sum_strict("tonnes").alias("tonnes")))


def deficiency_mean(deficiency: DataFrame) -> DataFrame:
    """Mean percentage with inadequate intake per country; NULL with a missing nutrient."""
    return deficiency.groupBy("iso3").agg(mean_strict("perc_deficient").alias("intake"))


def zone_flow(pairs: DataFrame, intake: DataFrame) -> DataFrame:
    """Own, foreign and total tonnes per zone, foreign share, log total and mean deficiency.

    A total below one tonne, also zero, gets the log value 1.
    """
    wide = wide_sum(pairs, ["eez_country", "eez_iso", "continent"], "is_same", OWN_OTHER, "tonnes", strict=True)
    flow = (
        wide.na.fill(0.0, ["your_country", "other_country"])
        .withColumn("total", F.col("your_country") + F.col("other_country"))
        .withColumn("perc_foreign", 100 * ratio("other_country", "total"))
        .withColumn("total_log", F.when(F.col("total") < 1, F.lit(1.0)).otherwise(F.ln("total")))
    )
    return left_lookup(flow, intake, {"eez_iso": "iso3"}, ["intake"])


def fleet_flow(pairs: DataFrame) -> DataFrame:
    """Tonnes a fleet's country catches at home and abroad; not caught stays NULL."""
    columns = {"your_country": "your_country_entity", "other_country": "other_country_entity"}
    return wide_sum(pairs, ["fishing_entity_ISO"], "is_same", columns, "tonnes", strict=True).withColumnRenamed(
        "fishing_entity_ISO", "iso3c"
    )


def flow_table(zones: DataFrame, fleets: DataFrame) -> DataFrame:
    zones = zones.filter(F.col("eez_iso").isNotNull()).select(
        F.col("eez_iso").alias("iso3c"),
        F.col("your_country").alias("your_country_eez"),
        F.col("other_country").alias("other_country_eez"),
    )
    return zones.join(fleets, "iso3c", "left")


def vulnerability_score(zones: DataFrame, intake_above: float = 25, foreign_above: float = 90) -> DataFrame:
    """1 for high deficiency plus 3 for a high foreign share; NULL if either is unknown."""

    def points(metric: str, limit: float, score: int):
        return F.when(F.col(metric) > limit, F.lit(score)).when(F.col(metric) <= limit, F.lit(0))

    return (
        zones.withColumn("is_vulnerable", points("intake", intake_above, 1))
        .withColumn("is_foreign", points("perc_foreign", foreign_above, 3))
        .withColumn("is_all", F.col("is_vulnerable") + F.col("is_foreign"))
    )


def vulnerable_zones(scores: DataFrame) -> DataFrame:
    return scores.filter("is_vulnerable = 1")


def critical_zones(scores: DataFrame) -> DataFrame:
    return scores.filter("is_all = 4")


def zone_fleet_nutrients(
    tonnes: DataFrame, values: DataFrame, countries_iso: DataFrame, aliases: DataFrame, patterns=()
) -> DataFrame:
    """Nutrient supply by zone country, fleet and nutrient, with the own/foreign flag.

    ``tonnes`` holds sums by zone, fleet and species (``zone_species_tonnes``), ``values``
    (scientific_name, nutrient, value).
    """
    supply = F.col("value") * F.col("tonnes") * PORTIONS_PER_TONNE
    raw = (
        tonnes.join(values, "scientific_name", "left")
        .groupBy("eez", "fishing_entity", "nutrient")
        .agg(sum_skipna(supply).alias("nut_supply"))
    )
    pairs = attach_countries(raw, countries_iso, aliases, patterns)
    return own_foreign_flag(pairs.groupBy(*ZONE_FLEET, "nutrient").agg(sum_skipna("nut_supply").alias("nut_supply")))


def _per_capita(amount: str):
    return ratio(amount, "pop") / DAYS_PER_YEAR


def nutrient_zone_flow(pairs: DataFrame, population: DataFrame) -> DataFrame:
    """Own, foreign and total supply per zone and nutrient, and the foreign supply per person and day."""
    located = pairs.filter(F.col("eez_iso").isNotNull())
    keys = ["eez_country", "eez_iso", "continent", "nutrient"]
    wide = wide_sum(located, keys, "is_same", OWN_OTHER, "nut_supply").na.fill(0.0, list(OWN_OTHER))
    wide = left_lookup(wide, population, {"eez_iso": "iso3c"}, ["pop"])
    return wide.withColumn("total", F.col("your_country") + F.col("other_country")).withColumn(
        "per_capita", _per_capita("other_country")
    )


def nutrient_fleet_flow(pairs: DataFrame, population: DataFrame) -> DataFrame:
    """Supply a fleet's country takes at home and abroad, and the latter per person and day."""
    columns = {"your_country": "your_country_entity", "other_country": "other_country_entity"}
    located = pairs.filter(F.col("fishing_entity_ISO").isNotNull())
    wide = wide_sum(located, ["fishing_entity_ISO", "nutrient"], "is_same", columns, "nut_supply")
    wide = wide.na.fill(0.0, list(columns.values()))
    wide = left_lookup(wide, population, {"fishing_entity_ISO": "iso3c"}, ["pop"])
    return wide.select(
        F.col("fishing_entity_ISO").alias("iso3c"),
        "nutrient",
        *columns.values(),
        _per_capita("other_country_entity").alias("per_capita_entity"),
    )


def net_nutrient_flow(zones: DataFrame, fleets: DataFrame) -> DataFrame:
    """Per person and day: foreign catch in the own zone minus own catch abroad."""
    fleets = fleets.select(F.col("iso3c").alias("_iso"), F.col("nutrient").alias("_nutrient"), "per_capita_entity")
    match = (zones["eez_iso"] == fleets["_iso"]) & zones["nutrient"].eqNullSafe(fleets["_nutrient"])
    gained = F.coalesce("per_capita", F.lit(0.0))
    given = F.coalesce("per_capita_entity", F.lit(0.0))
    return zones.join(fleets, match, "left").select(
        F.col("eez_iso").alias("iso3c"), "nutrient", (gained - given).alias("per_capita")
    )
