"""Nutrient composition of species, with fallback along the taxonomy."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.functions.nulls import dim_first, mean_fixed, sd_strict, sum_fixed, sum_skipna, sum_strict
from seaplate.functions.quantiles import t_quantile
from seaplate.functions.text import recode, sentence_case, word
from seaplate.operators.shape import left_lookup
from seaplate.vocab import GENUS_SYNONYMS, NUTRIENT_NAMES, PORTIONS_PER_TONNE

# Assay column of each taxonomic level.
LEVELS = {"species": "sciname", "genus": "genus", "family": "family", "order": "order", "class": "class"}
# Fallback ranks: label, level looked up, lineage column that names the taxon.
RANKS = [
    ("species", "species", "species"),
    ("genus", "genus", "genus"),
    ("family", "family", "family"),
    ("family", "family", "genus"),
    ("order", "order", "order"),
    ("order", "order", "genus"),
    ("class", "class", "class"),
    ("class", "class", "genus"),
]
# The statistics that travel together; the interval follows from them row by row.
STATS = ["value", "ssd", "count", "se"]
# Decimals of the units in which values, tonnes and supplies are summed where the order of the rows must not show.
VALUE_DIGITS, TONNES_DIGITS, SUPPLY_DIGITS = 12, 12, 6


def assay_filter(assays: DataFrame, nutrients: list[str], preparations: list[str], parts: list[str]) -> DataFrame:
    return assays.filter(
        F.col("nutrient").isin(nutrients) & F.col("food_prep").isin(preparations) & F.col("food_part").isin(parts)
    )


def nutrient_unit_key(assays: DataFrame, tiebreak: str) -> DataFrame:
    """The first unit seen per nutrient."""
    return dim_first(assays.select("nutrient", "nutrient_units", tiebreak), "nutrient", [tiebreak, "nutrient_units"]).drop(
        tiebreak
    )


def t_interval(df: DataFrame, mean: str = "value", se: str = "se", n: str = "count", conf: float = 0.95) -> DataFrame:
    """Add the t confidence limits of a mean; NULL for a single observation."""
    quantile = t_quantile(1 - (1 - conf) / 2)
    return (
        df.withColumn("_margin", quantile((F.col(n) - 1).cast("double")) * F.col(se))
        .withColumn("lower_ci", F.col(mean) - F.col("_margin"))
        .withColumn("upper_ci", F.col(mean) + F.col("_margin"))
        .drop("_margin")
    )


def taxon_stats(assays: DataFrame) -> DataFrame:
    """Mean, deviation, count and standard error per (level, taxon, nutrient), all levels in one aggregate."""
    taxa = F.array(*[F.struct(F.lit(level).alias("level"), F.lower(f"`{c}`").alias("taxon")) for level, c in LEVELS.items()])
    return (
        assays.select(F.explode(taxa).alias("t"), "nutrient", "value")
        .select("t.level", "t.taxon", "nutrient", "value")
        .filter(F.col("taxon").isNotNull())
        .groupBy("level", "taxon", "nutrient")
        .agg(mean_fixed("value", VALUE_DIGITS).alias("value"), sd_strict("value").alias("ssd"), F.count(F.lit(1)).alias("count"))
        .withColumn("se", F.col("ssd") / F.sqrt("count"))
    )


def species_words(species: DataFrame, column: str = "scientific_name") -> DataFrame:
    """Distinct lower-case species names with their first two words."""
    name = F.lower(column)
    return species.select(name.alias("species")).distinct().select(
        "species", word("species", 0).alias("genus"), word("species", 1).alias("spp")
    )


def species_nutrient_grid(species: DataFrame, nutrients: list[str], column: str = "scientific_name") -> DataFrame:
    """Every species with every listed nutrient."""
    listed = F.array(*[F.lit(n) for n in nutrients])
    return species_words(species, column).withColumn("nutrient", F.explode(listed))


def lineage_resolve(species: DataFrame, taxonomy: DataFrame, tiebreak: str) -> DataFrame:
    """Family, order and class of each species by its first word, read as a genus, else a family, else an order."""
    by_genus = dim_first(taxonomy, "genus", tiebreak)
    by_family = dim_first(taxonomy.drop("genus"), "family", tiebreak).select(
        "family", F.col("order").alias("f_order"), F.col("class").alias("f_class")
    )
    by_order = dim_first(taxonomy.drop("genus", "family"), "order", tiebreak).select(
        "order", F.col("class").alias("o_class")
    )
    found = left_lookup(species, by_genus, {"genus": "genus"}, ["family", "order", "class"])
    found = left_lookup(found, by_family, {"genus": "family"}, ["f_order", "f_class"])
    found = left_lookup(found, by_order, {"genus": "order"}, ["o_class"])
    return (
        found.withColumn("order", F.when(F.col("class").isNull(), F.col("f_order")).otherwise(F.col("order")))
        .withColumn("class", F.coalesce("class", "f_class", "o_class"))
        .withColumn("genus", recode("genus", GENUS_SYNONYMS))
        .drop("f_order", "f_class", "o_class")
    )


def taxon_fallback(lineage: DataFrame, stats: DataFrame, nutrients: list[str], units: DataFrame) -> DataFrame:
    """Composition of every species and nutrient from the first rank that has a value.

    Each pair is spread over its ranks, joined once to the statistics and folded
    back by the lowest rank with a value; pairs without any stay, with NULLs.
    """
    ranks = F.array(
        *[
            F.struct(
                F.lit(rank).alias("rank"),
                F.lit(label).alias("taxa_match"),
                F.lit(level).alias("level"),
                F.col(f"`{column}`").alias("taxon"),
            )
            for rank, (label, level, column) in enumerate(RANKS)
        ]
    )
    pair = ["species", "genus", "spp", "family", "order", "class", "nutrient"]
    asked = (
        lineage.withColumn("r", F.explode(ranks))
        .withColumn("nutrient", F.explode(F.array(*[F.lit(n) for n in nutrients])))
        .select(*pair, "r.rank", "r.taxa_match", "r.level", "r.taxon")
    )
    known = stats.filter(F.col("value").isNotNull()).select("level", "taxon", "nutrient", *STATS)
    usable_rank = F.when(F.col("value").isNotNull(), F.col("rank"))
    best = (
        asked.join(known, ["level", "taxon", "nutrient"], "left")
        .groupBy(*pair)
        .agg(F.min_by(F.struct("taxa_match", *STATS), usable_rank).alias("best"))
        .select(*pair, "best.*")
    )
    filled = best.join(units, "nutrient", "left")
    return t_interval(filled.select(*pair, "nutrient_units", *STATS, "taxa_match"))


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and sum of squared deviations (``count``, ``value``, ``m2``) of each group from those of its parts.

    The parts' deviations are taken from the group's mean, which is joined back, so that nothing large
    cancels: a deviation of a billionth of the mean keeps its digits. Results can be merged again. Both
    aggregates combine before their shuffles.
    """
    weighted = F.col("value") * F.col("count")
    means = parts.groupBy(*keys).agg(F.sum("count").alias("_count"), sum_fixed(weighted, VALUE_DIGITS).alias("_total"))
    means = means.withColumn("_mean", F.col("_total") / F.col("_count"))
    off = F.col("value") - F.col("_mean")
    sums = parts.join(means, keys).groupBy(*keys, "_count", "_mean").agg(
        F.sum(F.col("m2") + F.col("count") * off * off).alias("_squares"), F.sum(F.col("count") * off).alias("_off")
    )
    spread = F.greatest(F.col("_squares") - F.col("_off") * F.col("_off") / F.col("_count"), F.lit(0.0))
    return sums.select(*keys, F.col("_count").alias("count"), F.col("_mean").alias("value"), spread.alias("m2"))


def group_means(rows: DataFrame) -> DataFrame:
    """Statistics per functional group and nutrient over the catch rows that have a value.

    ``rows`` holds one value per species and nutrient with the number of its catch rows, which is a part of a group without
    deviations of its own.
    """
    keys = ["functional_group", "nutrient"]
    rows = rows.filter(F.col("value").isNotNull() & F.col("functional_group").isNotNull())
    parts = rows.select(*keys, F.col("n_rows").alias("count"), "value", F.lit(0.0).alias("m2"))
    ssd = F.when(F.col("count") > 1, F.sqrt(F.try_divide(F.col("m2"), F.col("count") - 1)))
    return merge_moments(parts, keys).select(*keys, "value", ssd.alias("ssd"), "count").withColumn("se", F.col("ssd") / F.sqrt("count"))


def catch_rows(biomass: DataFrame) -> DataFrame:
    """Number of biomass rows per species."""
    return biomass.groupBy(F.lower("scientific_name").alias("species")).agg(F.count(F.lit(1)).alias("n_rows"))


def functional_group_fill(
    composition: DataFrame, species_rows: DataFrame, species_groups: DataFrame, tiebreak: str
) -> DataFrame:
    """Fill species without a value from the mean of their functional group.

    The group of a species is that of the first listed species with the same first
    word; ``species_rows`` weighs each species by its number of biomass rows.
    """
    first_words = species_groups.select(
        F.lower(word("scientific_name", 0)).alias("genus_word"), "functional_group", tiebreak
    )
    groups = dim_first(first_words, "genus_word", tiebreak).drop(tiebreak)
    grouped = (
        composition.withColumn("genus_word", word("species", 0))
        .join(groups, "genus_word", "left")
        .join(species_rows, "species")
    )
    fill = group_means(grouped).select(
        "functional_group", "nutrient", *[F.col(c).alias(f"fill_{c}") for c in STATS]
    )
    missing = F.col("value").isNull()
    return t_interval(
        grouped.join(fill, ["functional_group", "nutrient"], "left").select(
            "species",
            "nutrient",
            "nutrient_units",
            "functional_group",
            *[F.when(missing, F.col(f"fill_{c}")).otherwise(F.col(c)).alias(c) for c in STATS],
            F.when(missing, F.lit("Functional group")).otherwise(F.col("taxa_match")).alias("taxa_match"),
        )
    )


def supply_composition(composition: DataFrame) -> DataFrame:
    """Composition keyed as the catch writes species, under the short nutrient names."""
    return composition.withColumn("scientific_name", sentence_case("species")).withColumn(
        "nutrient", recode("nutrient", NUTRIENT_NAMES)
    )


def nutrient_supply(biomass: DataFrame, composition: DataFrame) -> DataFrame:
    """Biomass rows with each nutrient's supply; composition is per 100 g."""
    return biomass.join(supply_composition(composition), "scientific_name", "left").withColumn(
        "nut_supply", F.col("value") * F.col("tonnes") * PORTIONS_PER_TONNE
    )


def supply_by(biomass: DataFrame, composition: DataFrame, keys: list[str], strict: bool, fixed: bool = False) -> DataFrame:
    """Nutrient supply per key and nutrient.

    Tonnes are summed per key and species before the composition multiplies the
    rows, since the composition depends on the species alone. With ``fixed`` the sums are taken in
    units of ``TONNES_DIGITS`` and ``SUPPLY_DIGITS`` decimals, so that they do not depend on the order of the rows.
    """
    total = sum_strict if strict else sum_skipna
    digits = TONNES_DIGITS, SUPPLY_DIGITS
    of_tonnes, of_supply = (partial(sum_fixed, digits=d, strict=strict) for d in digits) if fixed else (total, total)
    groups = list(dict.fromkeys([*keys, "scientific_name"]))
    tonnes = biomass.groupBy(*groups).agg(of_tonnes("tonnes").alias("tonnes"))
    supply = F.col("value") * F.col("tonnes") * PORTIONS_PER_TONNE
    values = supply_composition(composition).select("scientific_name", "nutrient", "value")
    return (
        tonnes.join(values, "scientific_name", "left")
        .groupBy(*keys, "nutrient")
        .agg(of_supply(supply).alias("nut_supply"))
    )


def species_composition_distinct(composition: DataFrame) -> DataFrame:
    """Distinct (species, nutrient, value) under the short nutrient names."""
    return supply_composition(composition).select("scientific_name", "nutrient", "value").distinct()
