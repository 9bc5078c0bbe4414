"""Intake scenarios by country, sex and age group, with their fitted distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaplate.functions.nulls import mean_strict, ratio, sum_skipna
from seaplate.functions.text import lookup, recode
from seaplate.operators.balance import bloc_expand
from seaplate.operators.flows import country_name
from seaplate.operators.shape import left_lookup
from seaplate.vocab import (
    AGE_CODES,
    AGES_OVER_80,
    INTAKE_NUTRIENTS,
    SCALAR_NUTRIENTS,
    SCENARIO_NAMES,
    SEX_CODES,
    SURVEY_SCALAR_NUTRIENTS,
)


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _listed(values: Column | list[str]) -> Column:
    return values if isinstance(values, Column) else _literals(values).cast("array<string>")


def other_food_supply(long: DataFrame, year: int) -> DataFrame:
    """Supply of all single products but fish, by country and nutrient."""
    foods = long.filter(
        (F.col("products") != "Fish") & (F.col("products") != "Total food") & (F.col("year") == year)
    )
    return foods.groupBy("iso3c", "nutrient").agg(sum_skipna("value").alias("supply"))


def fish_scenarios(long: DataFrame, net_flow: DataFrame, year: int) -> DataFrame:
    """Total supply with today's fish (base) and with the net flow added (high).

    One aggregate per country and nutrient sums the other foods and keeps the fish rows (a balance has one per unit), so
    the balance is read once. A country without other food has no total.
    """
    per_capita = net_flow.select(
        "iso3c",
        recode("nutrient", {"DHA+EPA": "Omega-3 fatty acids", "Vitamin A, RAE": "Vitamin A"}).alias("nutrient"),
        "per_capita",
    )
    is_fish = (F.col("products") == "Fish") & (F.col("scenario") == "base")
    is_other = (F.col("products") != "Fish") & (F.col("products") != "Total food")
    sums = (
        long.filter(F.col("year") == year)
        .groupBy("iso3c", "nutrient")
        .agg(
            F.collect_list(F.when(is_fish, F.struct("units", "value"))).alias("fish"),
            F.when(F.count(F.when(is_other, 1)) > 0, F.coalesce(F.sum(F.when(is_other, F.col("value"))), F.lit(0.0))).alias("supply"),
        )
    )
    fish = sums.select("iso3c", "nutrient", "supply", F.inline("fish")).join(per_capita, ["iso3c", "nutrient"], "left")
    with_flow = F.when(F.col("per_capita").isNull(), F.col("value")).otherwise(F.col("value") + F.col("per_capita"))
    return fish.withColumn("scenario", F.explode(_literals(["base", "high"]))).select(
        "iso3c",
        "nutrient",
        "units",
        "scenario",
        (F.when(F.col("scenario") == "high", with_flow).otherwise(F.col("value")) + F.col("supply")).alias(
            "total_supply"
        ),
    )


def scenario_bloc_expand(scenarios: DataFrame, names: DataFrame, members: DataFrame) -> DataFrame:
    """Scenarios by present country, under the nutrient names of the intake data."""
    named = country_name(scenarios, "iso3c", names)
    expanded = bloc_expand(named, members, code="iso3c", name="country")
    return expanded.select(
        F.col("iso3c").alias("iso3"),
        "country",
        recode("nutrient", INTAKE_NUTRIENTS).alias("nutrient"),
        F.col("units").alias("nutrient_units"),
        recode("scenario", SCENARIO_NAMES).alias("scenario"),
        F.col("total_supply").alias("intake"),
    )


def sex_expand(supply: DataFrame) -> DataFrame:
    """Children count as girls and as boys."""
    both = F.when(F.col("sex") == "Children", _literals(["Females", "Males"])).otherwise(F.array("sex"))
    return supply.withColumn("sex", F.explode(both))


def age_band_expand(df: DataFrame, column: str = "age_group") -> DataFrame:
    """The open band 80+ stands for each five-year group above 80."""
    bands = F.when(F.col(column) == "80+", _literals(AGES_OVER_80)).otherwise(F.array(column))
    return df.withColumn(column, F.explode(bands))


def group_scalar(supply: DataFrame) -> DataFrame:
    """Supply of each sex and age relative to the mean of its country and nutrient.

    A missing value leaves its whole country and nutrient out.
    """
    keys = ["iso3_use", "country_use", "nutrient", "units_long", "units_short"]
    means = supply.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(mean_strict("value_med").alias("_mean"))
    same = [supply[k].eqNullSafe(means[f"_{k}"]) for k in keys]
    scaled = supply.join(means, same, "left").withColumn("scalar", ratio("value_med", "_mean"))
    return scaled.filter(F.col("scalar").isNotNull()).select(
        F.col("iso3_use").alias("iso3"), "nutrient", "sex", F.col("age_range").alias("age_group"), "scalar"
    )


def survey_ages(survey_scalars: DataFrame) -> Column:
    """The age groups of the survey scalars, in order, as one list that the plan works out once when the result is asked for; a survey
    has a few dozen at most."""
    return survey_scalars.agg(F.array_sort(F.collect_set("age_group")).alias("ages")).scalar()


def demographic_grid(countries: DataFrame, ages: Column | list[str], code: str = "iso3", sexes=tuple(SEX_CODES)) -> DataFrame:
    """Every known country with every sex and every age group of the survey (``survey_ages``, or a literal list)."""
    known = countries.select(F.col(code).alias("iso3")).filter("iso3 is not null").distinct().withColumn("_ages", _listed(ages))
    return known.withColumn("sex", F.explode(_literals(sexes))).withColumn("age_group", F.explode("_ages")).drop("_ages")


def intake_by_group(
    scenarios: DataFrame,
    crosswalk: DataFrame,
    group_scalars: DataFrame,
    survey_scalars: DataFrame,
    ages: Column | list[str] | None = None,
    sexes=tuple(SEX_CODES),
) -> DataFrame:
    """Mean intake of each sex and age group; by default the age groups are those the survey scalars hold.

    The survey scalar serves omega-3 and B-12, and wherever the supply-based one
    is missing. Rows without a country code keep one row without sex and age.
    """
    ages = survey_ages(survey_scalars) if ages is None else ages
    coded = scenarios.withColumn("nutrient_genus", recode("nutrient", SCALAR_NUTRIENTS))
    coded = left_lookup(coded, crosswalk, {"iso3": "iso3_cosimo"}, ["iso3_genus"])
    coded = coded.withColumn("iso3_genus", F.coalesce("iso3_genus", "iso3"))
    none = _literals([None]).cast("array<string>")
    for column, values in (("sex", sexes), ("age_group", ages)):
        coded = coded.withColumn("_listed", _listed(values if isinstance(values, Column) else list(values)))
        coded = coded.withColumn(column, F.explode(F.when(F.col("iso3").isNotNull(), F.col("_listed")).otherwise(none))).drop("_listed")
    on_supply = {"iso3_genus": "iso3", "nutrient_genus": "nutrient", "sex": "sex", "age_group": "age_group"}
    by_supply = group_scalars.withColumnRenamed("scalar", "scalar_genus")
    coded = left_lookup(coded, by_supply, on_supply, ["scalar_genus"])
    survey = survey_scalars.select(
        F.col("country_iso3").alias("iso3"),
        recode("nutrient", {"Vitamin A": "Vitamin A, RAE"}).alias("nutrient"),
        recode("sex", {"men": "Males", "women": "Females"}).alias("sex"),
        "age_group",
        F.col("scalar").alias("scalar_spade"),
    )
    keys = ["iso3", "nutrient", "sex", "age_group"]
    coded = left_lookup(coded, survey, {k: k for k in keys}, ["scalar_spade"])
    from_survey = F.col("nutrient").isin(SURVEY_SCALAR_NUTRIENTS) | F.col("scalar_genus").isNull()
    return (
        coded.withColumn("scalar", F.when(from_survey, F.col("scalar_spade")).otherwise(F.col("scalar_genus")))
        .withColumnRenamed("intake", "mean_cntry")
        .withColumn("mean_group", F.col("mean_cntry") * F.col("scalar"))
    )


def distribution_attach(intake: DataFrame, distributions: DataFrame) -> DataFrame:
    """Fitted gamma and log-normal parameters, their means, and the shift to the group mean."""
    fits = distributions.withColumn("nutrient", recode("nutrient", {"Vitamin A": "Vitamin A, RAE"}))
    on = {"iso3": "country_iso3", "nutrient": "nutrient", "sex": "sex", "age_group": "age_group"}
    keep = ["best_dist", "g_shape", "g_rate", "ln_meanlog", "ln_sdlog"]
    return (
        left_lookup(intake, fits, on, keep)
        .withColumn("g_mean", ratio("g_shape", "g_rate"))
        .withColumn("g_mean_diff", F.col("mean_group") - F.col("g_mean"))
        .withColumn("ln_mean", F.exp(F.col("ln_meanlog") + F.col("ln_sdlog") * F.col("ln_sdlog") / 2))
        .withColumn("ln_mean_diff", F.col("mean_group") - F.col("ln_mean"))
    )


def demographic_codes(df: DataFrame) -> DataFrame:
    """Numeric sex and age codes in place of the labels, for rows that have a mean."""
    return (
        df.filter(F.col("mean_group").isNotNull())
        .withColumn("sex_id", lookup("sex", SEX_CODES))
        .withColumn("age_id", lookup("age_group", AGE_CODES))
        .drop("sex", "age_group")
    )


def demographic_labels(df: DataFrame) -> DataFrame:
    """Sex and age group labels next to their codes."""
    sex = F.when(F.col("sex_id") == 1, F.lit("Males")).when(F.col("sex_id") != 1, F.lit("Females"))
    return df.withColumn("sex", sex).withColumn("age_group", lookup("age_id", {v: k for k, v in AGE_CODES.items()}))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column: (column_name, n_missing, n_rows)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("n_missing"))
                for c in df.columns
            ]
        ).alias("parts"),
    )
    return counts.select("n_rows", F.inline("parts")).select("column_name", "n_missing", "n_rows")


def completeness_report(df: DataFrame, required: str, labels: list[str]) -> DataFrame:
    """Per label column, how many rows each value has and how many of them lack ``required``."""
    values = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").alias("label_value")) for c in labels])
    return (
        df.select(F.col(required).isNull().alias("_gap"), F.inline(values))
        .groupBy("label", "label_value")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("_gap"), 1)).alias("n_missing"))
    )
