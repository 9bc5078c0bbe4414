"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaplate.contract import standin as s
from seaplate.contract.standin import Tables
from seaplate.functions.nulls import dim_first
from seaplate.operators import balance, catch, composition, flows, intake, ratios, reports, risk
from seaplate.plans import exposure, foreign_flow, nutrient_attachment
from seaplate.session import staging_path
from seaplate.sources import readers, sinks
from seaplate.sources.schemas import CATCH
from seaplate.vocab import ASSAY_NUTRIENTS, OMEGA3

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round computed columns so that summation order does not show; -0.0 becomes 0.0."""
    for column, n in digits.items():
        df = df.withColumn(column, F.round(F.col(f"`{column}`"), n) + F.lit(0.0))
    return df


def rounded_all(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    return rounded(df, **{c: n for c in columns})


def staged(t: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An intermediate table of one query run, written once where several steps read it."""
    return t.staging.table(name, build)


# Shared intermediate inputs.


def _cells(t: Tables, gaps: bool = True) -> DataFrame:
    """The catch by cell, the one pass over it that a query makes."""
    return staged(t, f"cells-{gaps}", lambda: catch.catch_cells(s.catch(t, gaps)))


def _biomass(t: Tables, gaps: bool = True) -> DataFrame:
    return catch.mean_biomass(_cells(t, gaps))


def _kept_assays(t: Tables) -> DataFrame:
    return composition.assay_filter(s.assays(t), ASSAY_NUTRIENTS, s.KEPT_PREPARATIONS, s.KEPT_PARTS)


def _nearest(t: Tables, species: DataFrame) -> DataFrame:
    return nutrient_attachment.species_composition(
        species,
        s.assays(t),
        s.taxonomy(t),
        assay_order="p_partkey",
        taxonomy_order="line",
        preparations=s.KEPT_PREPARATIONS,
        parts=s.KEPT_PARTS,
    )


def _filled(t: Tables, gaps: bool = True) -> DataFrame:
    def build() -> DataFrame:
        cells, stats = t.staging.together(
            lambda: _cells(t, gaps), lambda: staged(t, "taxon-stats", lambda: composition.taxon_stats(_kept_assays(t)))
        )
        return _filled_plan(t, cells, stats)

    return staged(t, "composition", build)


def _filled_plan(t: Tables, cells: DataFrame, stats: DataFrame) -> DataFrame:
    return nutrient_attachment.filled_composition(
        cells,
        s.assays(t),
        s.taxonomy(t),
        s.species_groups(t),
        assay_order="p_partkey",
        taxonomy_order="line",
        group_order="line",
        stats=stats,
        preparations=s.KEPT_PREPARATIONS,
        parts=s.KEPT_PARTS,
    )


def _iso(t: Tables) -> DataFrame:
    return dim_first(s.countries_iso_rows(t), "missing_countries", "line").drop("line")


def _population(t: Tables) -> DataFrame:
    return readers.population_dim(s.population_wide(t), "SP.POP.TOTL", s.SUPPLY_YEAR)


def _coastal(t: Tables) -> DataFrame:
    return readers.coastal_population_dim(s.coastal_population(t))


def _pairs(t: Tables) -> DataFrame:
    return flows.zone_fleet_tonnes(s.catch(t), _iso(t), s.zone_aliases(t), s.ZONE_PATTERNS)


def _zones(t: Tables) -> DataFrame:
    return flows.zone_flow(_pairs(t), flows.deficiency_mean(s.deficiency(t)))


def _values(t: Tables) -> DataFrame:
    return composition.species_composition_distinct(_filled(t))


def _nutrient_pairs(t: Tables) -> DataFrame:
    tonnes = catch.zone_species_tonnes(_cells(t).filter(F.col("year") == s.SUPPLY_YEAR))
    return staged(
        t,
        "zone-fleet-nutrients",
        lambda: flows.zone_fleet_nutrients(tonnes, _values(t), _iso(t), s.zone_aliases(t), s.ZONE_PATTERNS),
    )


def _net(t: Tables) -> DataFrame:
    return foreign_flow.net_supply(_nutrient_pairs(t), _population(t))


def _balance(t: Tables) -> DataFrame:
    return exposure.scoped_balance(s.balance_wide(t), s.exclusions(t))


def _members(t: Tables) -> DataFrame:
    return balance.bloc_members(s.country_key(t), without=s.DISSOLVED)


def _expanded_balance(t: Tables) -> DataFrame:
    return balance.bloc_expand(_balance(t), _members(t), code="iso3c", name="countries")


def _per_capita(t: Tables, population: DataFrame) -> DataFrame:
    return balance.per_capita_supply(
        _biomass(t, gaps=False), _filled(t, gaps=False), _iso(t), population, s.SUPPLY_YEAR
    )


def _shares(t: Tables, population: DataFrame) -> DataFrame:
    return balance.supply_share_table(
        balance.sector_supply(_expanded_balance(t), s.SUPPLY_YEAR), _per_capita(t, population)
    )


def _food(t: Tables) -> DataFrame:
    return staged(t, "balance", lambda: _balance(t))


def _scenarios(t: Tables) -> DataFrame:
    food, _ = t.staging.together(lambda: _food(t), lambda: _nutrient_pairs(t))
    return intake.fish_scenarios(food, _net(t), s.SUPPLY_YEAR)


def _scalars(t: Tables) -> DataFrame:
    return intake.group_scalar(intake.sex_expand(s.supply_by_age_sex(t)))


def _intakes(t: Tables) -> DataFrame:
    """The survey is staged while the catch, and the balance, become scenarios."""
    scenarios, by_age_sex, survey = t.staging.together(
        lambda: _scenarios(t),
        lambda: staged(t, "supply-by-age-sex", lambda: s.supply_by_age_sex(t)),
        lambda: staged(t, "survey", lambda: s.intake_scalars(t)),
    )
    return exposure.intake_rows(scenarios, s.country_names(t), _members(t), s.crosswalk(t), by_age_sex, survey)


def _coded(t: Tables, best: str | None) -> DataFrame:
    def build() -> DataFrame:
        intakes, fits = t.staging.together(lambda: _intakes(t), lambda: staged(t, f"fits-{best}", lambda: s.distributions(t, best)))
        return exposure.coded_distributions(intakes, fits)

    return staged(t, f"intake-{best}", build)


def _omega(t: Tables) -> DataFrame:
    return exposure.omega_curves(s.omega_matrix(t))


def _meat(t: Tables) -> DataFrame:
    return risk.meat_curves(risk.meat_points(s.meat_matrix(t)))


def _meat_intake(t: Tables, best: str) -> DataFrame:
    """Red-meat intake by nation, sex and age; the high scenario shifts it by 5."""
    coded = intake.demographic_codes(s.meat_distributions(t, best).withColumn("mean_group", F.lit(0.0)))
    shift = F.when(F.col("scenario") == "Base", F.lit(0.0)).otherwise(F.lit(5.0))
    return (
        coded.withColumn("scenario", F.explode(F.array(F.lit("Base"), F.lit("High road"))))
        .withColumn("ln_mean_diff", shift)
        .withColumn("g_mean_diff", shift)
        .withColumnRenamed("country_iso3", "iso3")
        .drop("mean_group")
    )


def _deltas(t: Tables, best: str | None = "log-normal") -> DataFrame:
    coded, omega, needs = t.staging.together(
        lambda: _coded(t, best),
        lambda: staged(t, "omega-curves", lambda: _omega(t)),
        lambda: staged(t, "requirements", lambda: s.requirements(t)),
    )
    return exposure.exposure_deltas(coded, needs, s.sdi(t), omega)


def _affected(t: Tables) -> DataFrame:
    return risk.people_affected(_deltas(t), risk.population_slice(s.population_by_age_sex(t), 2020))


# Sources, staging, sinks.


@query
def q_read_fact(t: Tables) -> DataFrame:
    path = staging_path(t.spark, "fact")
    s.catch(t, gaps=True).write.parquet(path)
    rows = readers.read_fact(t.spark, path, renames={"NATION_4": "Fourth Nation"})
    return rows.groupBy("fishing_entity", "year").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tonnes").alias("tonnes"))


@query
def q_year_slice(t: Tables) -> DataFrame:
    staged = sinks.stage_by_year(s.catch(t))
    return sinks.year_slice(staged, s.CATCH_YEAR).select("year", "eez", "fishing_entity", "scientific_name", "tonnes")


@query
def q_read_dimension(t: Tables) -> DataFrame:
    return readers.read_dimension(
        s.crosswalk(t),
        ["iso3_cosimo", "iso3_genus"],
        {"iso3_cosimo": "iso3", "iso3_genus": "genus_code"},
        drop_first=("iso3_cosimo", "N00"),
    )


@query
def q_dim_first(t: Tables) -> DataFrame:
    return dim_first(s.countries_iso_rows(t), "missing_countries", "line").select("missing_countries", "iso3c")


@query
def q_population_dim(t: Tables) -> DataFrame:
    return rounded(_population(t), pop=4)


@query
def q_coastal_population_dim(t: Tables) -> DataFrame:
    return rounded(_coastal(t), pop=4)


@query
def q_stage_table(t: Tables) -> DataFrame:
    sums = catch.gear_sector_filter(s.catch(t)).groupBy("scientific_name", "fishing_entity").agg(F.sum("tonnes").alias("tonnes"))
    staged = sinks.stage_table(sums, "species-fleet")
    return staged.groupBy("fishing_entity").agg(F.sum("tonnes").alias("tonnes"), F.count(F.lit(1)).alias("n_species"))


@query
def q_export_csv(t: Tables) -> DataFrame:
    path = sinks.export_csv(catch.total_by_species(s.catch(t)), staging_path(t.spark, "csv"))
    return readers.read_table(t.spark, path, "scientific_name string, tonnes double", "csv")


# Catch statistics.


@query
def q_gear_sector_filter(t: Tables) -> DataFrame:
    return catch.gear_sector_filter(s.catch(t, gaps=True)).select(
        "year", "eez", "fishing_entity", "end_use", "scientific_name", "tonnes"
    )


@query
def q_catch_total_by_year(t: Tables) -> DataFrame:
    return rounded(catch.catch_total_by_year(s.catch(t, gaps=True)), tonnes_tot=9)


@query
def q_gear_share_by_year(t: Tables) -> DataFrame:
    return rounded(catch.gear_share_by_year(s.catch(t, gaps=True)), tonnes=9, tonnes_tot=9, perc_trawl=8)


@query
def q_enduse_share_by_year(t: Tables) -> DataFrame:
    df = catch.enduse_share_by_year(s.catch(t, gaps=True))
    return rounded(df, tonnes_end=9, tonnes=9, tonnes_tot=9, perc_trawl=8, perc_enduse=8)


@query
def q_entity_share_for_year(t: Tables) -> DataFrame:
    df = catch.entity_share_for_year(s.catch(t, gaps=True), s.CATCH_YEAR)
    return rounded(
        df, tonnes_iso=9, tonnes=9, tonnes_tot=9, perc_trawl=8, tonnes_tot_iso=9, perc_iso=8, perc_iso_tot=8
    )


@query
def q_species_list_for_year(t: Tables) -> DataFrame:
    return rounded(catch.species_list_for_year(s.catch(t, gaps=True), s.CATCH_YEAR), tonnes_end=9)


@query
def q_mean_biomass_by_key(t: Tables) -> DataFrame:
    return rounded(catch.mean_biomass_by_key(s.catch(t, gaps=True)), tonnes=8)


@query
def q_total_by_species(t: Tables) -> DataFrame:
    return catch.total_by_species(s.catch(t, gaps=True))


@query
def q_total_by_species_entity(t: Tables) -> DataFrame:
    return catch.total_by_species_entity(s.catch(t, gaps=True))


@query
def q_total_by_species_entity_year(t: Tables) -> DataFrame:
    return catch.total_by_species_entity_year(s.catch(t, gaps=True))


@query
def q_total_for_entity(t: Tables) -> DataFrame:
    return catch.total_for_entity(s.catch(t, gaps=True), "NATION_8")


@query
def q_zone_species_total(t: Tables) -> DataFrame:
    return catch.zone_species_total(s.catch(t, gaps=True), "NATION 3 (EUROPE)")


@query
def q_distinct_values(t: Tables) -> DataFrame:
    return catch.distinct_values(s.catch(t), "sector")


# Nutrient composition.


@query
def q_assay_filter(t: Tables) -> DataFrame:
    return _kept_assays(t).select("sciname", "nutrient", "food_prep", "food_part", "value")


@query
def q_nutrient_unit_key(t: Tables) -> DataFrame:
    return composition.nutrient_unit_key(_kept_assays(t), "p_partkey")


@query
def q_taxon_stats(t: Tables) -> DataFrame:
    return rounded(composition.taxon_stats(_kept_assays(t)), value=7, ssd=7, se=7)


@query
def q_t_interval(t: Tables) -> DataFrame:
    df = composition.t_interval(composition.taxon_stats(_kept_assays(t)))
    return rounded(df.select("level", "taxon", "nutrient", "lower_ci", "upper_ci"), lower_ci=6, upper_ci=6)


@query
def q_species_nutrient_grid(t: Tables) -> DataFrame:
    return composition.species_nutrient_grid(s.species_list(t), ASSAY_NUTRIENTS)


@query
def q_lineage_resolve(t: Tables) -> DataFrame:
    return composition.lineage_resolve(composition.species_words(s.species_list(t)), s.taxonomy(t), "line")


@query
def q_taxon_fallback(t: Tables) -> DataFrame:
    df = _nearest(t, s.species_list(t)).drop("lower_ci", "upper_ci")
    return rounded(df, value=7, ssd=7, se=7)


@query
def q_functional_group_fill(t: Tables) -> DataFrame:
    df = _filled(t).select("species", "nutrient", "nutrient_units", "functional_group", "value", "ssd", "count", "taxa_match")
    return rounded(df, value=7, ssd=7)


@query
def q_nutrient_supply(t: Tables) -> DataFrame:
    df = composition.nutrient_supply(_biomass(t), _filled(t))
    df = df.select(*catch.BIOMASS_KEYS, "tonnes", "nutrient", "value", "taxa_match", "nut_supply")
    return rounded(df, tonnes=8, value=7, nut_supply=3)


@query
def q_species_composition_distinct(t: Tables) -> DataFrame:
    return rounded(_values(t), value=7)


# Nutrient ratio reports.


@query
def q_supply_enduse_fmfo(t: Tables) -> DataFrame:
    df = ratios.supply_enduse_fmfo(_biomass(t), _filled(t))
    return rounded(rounded_all(df, ratios.END_USES, 6), fmfo_dhc_ratio=7, dhc_fmfo_ratio=7)


@query
def q_supply_discard_ratio(t: Tables) -> DataFrame:
    df = ratios.supply_discard_ratio(_biomass(t), _filled(t))
    return rounded(rounded_all(df, ratios.END_USES, 6), discard_ratio=7)


@query
def q_supply_reporting_ratio(t: Tables) -> DataFrame:
    df = ratios.supply_reporting_ratio(_biomass(t), _filled(t))
    return rounded(df, Reported=6, Unreported=6, reporting_ratio=7)


@query
def q_supply_species_matrix(t: Tables) -> DataFrame:
    df = ratios.supply_species_matrix(_biomass(t, gaps=False), _filled(t, gaps=False))
    return rounded_all(df, ratios.SUPPLY_NUTRIENTS, 3)


def _cap_report(t: Tables, metric: str) -> DataFrame:
    report = {"discard_ratio": ratios.supply_discard_ratio, "reporting_ratio": ratios.supply_reporting_ratio}[metric]
    df = ratios.ratio_cap_report(report(_biomass(t), _filled(t)), _iso(t), metric, s.CATCH_YEAR)
    return rounded_all(df.select("year", "fishing_entity", "iso3c", "nutrient", metric), [metric], 7)


@query
def q_ratio_cap_report(t: Tables) -> DataFrame:
    return _cap_report(t, "discard_ratio")


@query
def q_ratio_cap_report_reporting(t: Tables) -> DataFrame:
    return _cap_report(t, "reporting_ratio")


# Food-balance shares.


@query
def q_balance_parse(t: Tables) -> DataFrame:
    df = balance.balance_parse(s.balance_wide(t))
    years = [f"A{y}" for y in s.BALANCE_YEARS]
    return rounded_all(df, years, 11).select("countries", "products", "iso3c", "nutrient", "nutrient_long", "units", "scenario", *years)


@query
def q_balance_unpivot(t: Tables) -> DataFrame:
    df = balance.balance_unpivot(balance.balance_parse(s.balance_wide(t)))
    return rounded(df.select("countries", "products", "iso3c", "nutrient", "year", "value"), value=11)


@query
def q_balance_scope(t: Tables) -> DataFrame:
    return rounded(_balance(t).select("countries", "products", "iso3c", "nutrient", "year", "value"), value=11)


@query
def q_bloc_expand(t: Tables) -> DataFrame:
    df = _expanded_balance(t).select("countries", "products", "iso3c", "nutrient", "year", "value")
    return rounded(df, value=11)


@query
def q_production_sector(t: Tables) -> DataFrame:
    df = balance.production_sector(_balance(t))
    return df.groupBy("products", "production_sector").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def q_sector_supply(t: Tables) -> DataFrame:
    return rounded(balance.sector_supply(_expanded_balance(t), s.SUPPLY_YEAR), nut_supply=9)


@query
def q_per_capita_supply(t: Tables) -> DataFrame:
    return rounded(_per_capita(t, _population(t)), nut_supply=7)


@query
def q_per_capita_supply_coastal(t: Tables) -> DataFrame:
    return rounded(_per_capita(t, _coastal(t)), nut_supply=7)


SHARES = ["ASF", "Fish", "Other", "bottom_trawl", "total", "perc_fish", "perc_ASF", "perc_tot"]


@query
def q_supply_share_table(t: Tables) -> DataFrame:
    return rounded_all(_shares(t, _population(t)), SHARES, 9)


@query
def q_supply_share_table_coastal(t: Tables) -> DataFrame:
    return rounded_all(_shares(t, _coastal(t)), SHARES, 9)


# Foreign-fleet flows.


@query
def q_zone_split(t: Tables) -> DataFrame:
    return flows.zone_split(s.catch(t).select("eez").distinct())


@query
def q_country_resolve(t: Tables) -> DataFrame:
    zones = flows.zone_split(s.catch(t).select("eez").distinct())
    resolved = flows.country_resolve(zones, "eez_country", s.zone_aliases(t), s.ZONE_PATTERNS)
    return flows.country_name(resolved, "iso3c", s.country_names(t)).select("eez", "iso3c", "continent", "country")


@query
def q_unresolved_names(t: Tables) -> DataFrame:
    df = flows.unresolved_names(s.catch(t, gaps=True), _iso(t), s.zone_aliases(t), s.ZONE_PATTERNS)
    return rounded(df, tonnes=6)


@query
def q_own_foreign_flag(t: Tables) -> DataFrame:
    pairs = flows.attach_countries(
        s.catch(t).select("eez", "fishing_entity").distinct(), _iso(t), s.zone_aliases(t), s.ZONE_PATTERNS
    )
    return flows.own_foreign_flag(pairs).select("eez", "fishing_entity", "is_same")


@query
def q_zone_fleet_tonnes(t: Tables) -> DataFrame:
    return flows.zone_fleet_tonnes(s.catch(t, gaps=True), _iso(t), s.zone_aliases(t), s.ZONE_PATTERNS)


ZONE_DIGITS = {"perc_foreign": 8, "total_log": 9, "intake": 8}


@query
def q_zone_flow(t: Tables) -> DataFrame:
    return rounded(_zones(t), **ZONE_DIGITS)


@query
def q_fleet_flow(t: Tables) -> DataFrame:
    return flows.fleet_flow(_pairs(t))


@query
def q_flow_table(t: Tables) -> DataFrame:
    zones, fleets = foreign_flow.catch_flows(
        s.catch(t), _iso(t), s.zone_aliases(t), s.deficiency(t), s.ZONE_PATTERNS
    )
    return flows.flow_table(zones, fleets)


@query
def q_deficiency_mean(t: Tables) -> DataFrame:
    return rounded(flows.deficiency_mean(s.deficiency(t)), intake=8)


@query
def q_vulnerability_score(t: Tables) -> DataFrame:
    df = flows.vulnerability_score(_zones(t))
    return df.select("eez_country", "eez_iso", "is_vulnerable", "is_foreign", "is_all")


@query
def q_vulnerable_zones(t: Tables) -> DataFrame:
    df = flows.vulnerable_zones(flows.vulnerability_score(_zones(t)))
    return df.select("eez_country", "eez_iso", "is_all")


@query
def q_critical_zones(t: Tables) -> DataFrame:
    df = flows.critical_zones(flows.vulnerability_score(_zones(t)))
    return df.select("eez_country", "eez_iso", "is_all")


@query
def q_nutrient_zone_flow(t: Tables) -> DataFrame:
    df = flows.nutrient_zone_flow(_nutrient_pairs(t), _population(t))
    return rounded(df, your_country=2, other_country=2, total=2, pop=4, per_capita=7)


@query
def q_nutrient_fleet_flow(t: Tables) -> DataFrame:
    df = flows.nutrient_fleet_flow(_nutrient_pairs(t), _population(t))
    return rounded(df, your_country_entity=2, other_country_entity=2, per_capita_entity=7)


@query
def q_net_nutrient_flow(t: Tables) -> DataFrame:
    return rounded(_net(t), per_capita=7)


# Intake scenarios.


@query
def q_other_food_supply(t: Tables) -> DataFrame:
    return rounded(intake.other_food_supply(_balance(t), s.SUPPLY_YEAR), supply=9)


@query
def q_fish_scenarios(t: Tables) -> DataFrame:
    return rounded(_scenarios(t), total_supply=9)


@query
def q_scenario_bloc_expand(t: Tables) -> DataFrame:
    return rounded(intake.scenario_bloc_expand(_scenarios(t), s.country_names(t), _members(t)), intake=9)


@query
def q_sex_expand(t: Tables) -> DataFrame:
    return rounded(intake.sex_expand(s.supply_by_age_sex(t)), value_med=6)


@query
def q_age_band_expand(t: Tables) -> DataFrame:
    return rounded(intake.age_band_expand(_scalars(t)), scalar=8)


@query
def q_group_scalar(t: Tables) -> DataFrame:
    return rounded(_scalars(t), scalar=8)


@query
def q_demographic_grid(t: Tables) -> DataFrame:
    scenarios = intake.scenario_bloc_expand(_scenarios(t), s.country_names(t), _members(t))
    return intake.demographic_grid(scenarios, intake.survey_ages(s.intake_scalars(t)))


@query
def q_intake_by_group(t: Tables) -> DataFrame:
    return rounded(_intakes(t), scalar_genus=11, scalar_spade=11, scalar=11, mean_cntry=9, mean_group=6)


@query
def q_distribution_attach(t: Tables) -> DataFrame:
    df = intake.distribution_attach(_intakes(t), s.distributions(t))
    columns = ["g_mean", "g_mean_diff", "ln_mean", "ln_mean_diff"]
    return rounded_all(df.select("scenario", "iso3", "nutrient", "sex", "age_group", "best_dist", *columns), columns, 6)


@query
def q_demographic_codes(t: Tables) -> DataFrame:
    df = intake.demographic_labels(_coded(t, None))
    return rounded(
        df.select("scenario", "iso3", "nutrient", "sex_id", "age_id", "sex", "age_group", "mean_group"), mean_group=6
    )


@query
def q_completeness_report(t: Tables) -> DataFrame:
    df = intake.distribution_attach(_intakes(t), s.distributions(t))
    gaps = intake.null_counts(df.select("iso3", "sex", "scalar", "mean_group", "best_dist"))
    labelled = intake.completeness_report(df, "scalar", ["nutrient", "country"])
    # Supplies that one unknown amount made missing, which the share table counts as zero.
    strict = _per_capita(t, _population(t)).select(F.col("nutrient").alias("strict supply"), "nut_supply")
    labelled = labelled.unionByName(intake.completeness_report(strict, "nut_supply", ["strict supply"]))
    return labelled.unionByName(
        gaps.select(F.lit("column").alias("label"), F.col("column_name").alias("label_value"), "n_rows", "n_missing")
    )


# Exposure, risk and impact.


@query
def q_curve_table(t: Tables) -> DataFrame:
    return rounded_all(risk.curve_table(_meat(t)), ["y0", "y1", "m0", "m1", "last_risk"], 8)


@query
def q_curve_table_omega(t: Tables) -> DataFrame:
    return rounded_all(risk.curve_table(_omega(t)), ["y0", "y1", "m0", "m1", "last_risk"], 8)


def _risk_points(t: Tables) -> DataFrame:
    """Intakes to read a curve at: the order price of each customer's segment and age."""
    ages = F.array(*[F.lit(a) for a in [7, *s.CURVE_AGES]])
    return t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("price")).select(
        F.col("o_custkey").alias("person"),
        F.get(ages, (F.col("o_custkey") % (len(s.CURVE_AGES) + 1)).cast("int")).alias("age_id"),
        F.col("price"),
    )


@query
def q_omega_risk(t: Tables) -> DataFrame:
    points = _risk_points(t).withColumn("x", F.col("price") / 10000 - 5)
    return rounded(risk.omega_risk(points, _omega(t)).select("person", "age_id", "risk"), risk=7)


@query
def q_red_meat_risk(t: Tables) -> DataFrame:
    causes = F.array(*[F.lit(c) for c in risk.MEAT_OUTCOMES.values()])
    points = _risk_points(t).withColumn("x", F.col("price") / 2000).withColumn("cause_id", F.explode(causes))
    return rounded(risk.red_meat_risk(points, _meat(t)).select("person", "cause_id", "age_id", "risk"), risk=7)


@query
def q_ear_lookup(t: Tables) -> DataFrame:
    df = risk.ear_lookup(_coded(t, None), s.requirements(t), s.sdi(t))
    return rounded(df.select("scenario", "iso3", "nutrient", "sex_id", "age_id", "sdi_group", "ear"), ear=8)


@query
def q_micronutrient_risk(t: Tables) -> DataFrame:
    df = risk.ear_lookup(_coded(t, None), s.requirements(t), s.sdi(t)).withColumn("x", F.col("mean_group"))
    df = risk.micronutrient_risk(df).select("scenario", "iso3", "nutrient", "sex_id", "age_id", "risk")
    return rounded(df, risk=6)


BOUND_KEYS = ["scenario", "iso3", "nutrient", "sex_id", "age_id"]


@query
def q_intake_bounds(t: Tables) -> DataFrame:
    df = risk.intake_bounds(_coded(t, "log-normal")).select(*BOUND_KEYS, "val_lo", "val_hi")
    return rounded(df, val_lo=5, val_hi=5)


@query
def q_intake_bounds_gamma(t: Tables) -> DataFrame:
    df = risk.intake_bounds(_coded(t, "gamma")).select(*BOUND_KEYS, "val_lo", "val_hi")
    return rounded(df, val_lo=5, val_hi=5)


def _sev(df: DataFrame) -> DataFrame:
    return rounded(df.select(*BOUND_KEYS, "sev"), sev=4)


@query
def q_sev_micronutrient(t: Tables) -> DataFrame:
    return _sev(risk.sev_micronutrient(_coded(t, "log-normal"), s.requirements(t), s.sdi(t)))


@query
def q_sev_micronutrient_gamma(t: Tables) -> DataFrame:
    return _sev(risk.sev_micronutrient(_coded(t, "gamma"), s.requirements(t), s.sdi(t)))


@query
def q_sev_omega3(t: Tables) -> DataFrame:
    return _sev(risk.sev_omega3(_coded(t, "log-normal"), _omega(t)))


@query
def q_sev_omega3_gamma(t: Tables) -> DataFrame:
    return _sev(risk.sev_omega3(_coded(t, "gamma"), _omega(t)))


MEAT_KEYS = ["iso3", "sex_id"]


@query
def q_sev_red_meat(t: Tables) -> DataFrame:
    df = risk.sev_red_meat(_meat_intake(t, "log-normal"), _meat(t))
    return rounded(df.select("scenario", *MEAT_KEYS, "age_id", "cause_id", "sev"), sev=4)


def _paf(df: DataFrame) -> DataFrame:
    return rounded(df, base=6, high=6, paf=6)


@query
def q_paf_red_meat(t: Tables) -> DataFrame:
    return _paf(risk.paf_red_meat(_meat_intake(t, "log-normal"), _meat(t), MEAT_KEYS, relative=False))


@query
def q_paf_red_meat_relative(t: Tables) -> DataFrame:
    return _paf(risk.paf_red_meat(_meat_intake(t, "log-normal"), _meat(t), MEAT_KEYS, relative=True))


def _omega_rows(t: Tables) -> DataFrame:
    return _coded(t, "log-normal").filter(F.col("nutrient") == OMEGA3)


@query
def q_paf_omega3(t: Tables) -> DataFrame:
    return _paf(risk.paf_omega3(_omega_rows(t), _omega(t), MEAT_KEYS, relative=False))


@query
def q_paf_omega3_relative(t: Tables) -> DataFrame:
    return _paf(risk.paf_omega3(_omega_rows(t), _omega(t), MEAT_KEYS, relative=True))


SEV_COLUMNS = ["sev_base", "sev_high", "sev_reduction", "sev_delta"]


@query
def q_sev_scenario_delta(t: Tables) -> DataFrame:
    return rounded_all(_deltas(t), SEV_COLUMNS, 4)


@query
def q_sev_scenario_delta_mixed(t: Tables) -> DataFrame:
    """Both kinds of fits in one table."""
    return rounded_all(_deltas(t, None), SEV_COLUMNS, 4)


@query
def q_population_slice(t: Tables) -> DataFrame:
    return rounded(risk.population_slice(s.population_by_age_sex(t), 2020), npeople=5)


@query
def q_people_affected(t: Tables) -> DataFrame:
    df = _affected(t).select(
        "iso3", "nutrient", "sex", "age_group", "npeople", "ndeficient_base", "ndeficient_high", "ndeficient_diff"
    )
    return rounded(df, npeople=4, ndeficient_base=2, ndeficient_high=2, ndeficient_diff=2)


# Report tables.


@query
def q_sev_country_mean(t: Tables) -> DataFrame:
    return rounded(reports.sev_country_mean(_deltas(t)), sev_base=4, sev_high=4, sev_delta=4)


@query
def q_sev_report(t: Tables) -> DataFrame:
    return rounded_all(reports.sev_report(reports.sev_country_mean(_deltas(t))), reports.REPORT_NUTRIENTS, 4)


@query
def q_people_country_total(t: Tables) -> DataFrame:
    return rounded(reports.people_country_total(_affected(t)), ndeficient_diff=1, ndeficient_diff_log=4)


@query
def q_people_grand_total(t: Tables) -> DataFrame:
    return rounded(reports.people_grand_total(reports.people_country_total(_affected(t))), million_people=6)


def _capped(t: Tables) -> DataFrame:
    df = _shares(t, _population(t))
    for metric in ("perc_ASF", "perc_tot", "perc_fish"):
        df = reports.metric_cap(df, metric)
    return df.select("iso3c", "nutrient", "perc_ASF", "perc_tot", "perc_fish")


@query
def q_metric_cap(t: Tables) -> DataFrame:
    return rounded_all(_capped(t), ["perc_ASF", "perc_tot", "perc_fish"], 6)


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query
def q_metric_box_stats(t: Tables) -> DataFrame:
    return rounded_all(reports.metric_box_stats(_shares(t, _population(t)), "perc_ASF"), BOX, 6)


@query
def q_metric_box_stats_tonnes(t: Tables) -> DataFrame:
    """Box statistics of every catch record by end use, the largest groups there are."""
    return rounded_all(reports.metric_box_stats(s.catch(t, gaps=True), "tonnes", "end_use"), BOX, 6)


@query
def q_region_metric_layer(t: Tables) -> DataFrame:
    iron = _capped(t).filter(F.col("nutrient") == "Iron")
    return rounded(reports.region_metric_layer(s.regions(t), iron, ["nutrient", "perc_ASF"]), perc_ASF=6)


@query
def q_small_territory_layer(t: Tables) -> DataFrame:
    zinc = _capped(t).filter(F.col("nutrient") == "Zinc")
    df = reports.small_territory_layer(s.regions(t), s.tiny_regions(t), zinc, ["perc_ASF"], "perc_ASF")
    return rounded(df, perc_ASF=6)


@query
def q_foreign_vs_intake_points(t: Tables) -> DataFrame:
    return rounded(reports.foreign_vs_intake_points(_zones(t)), **ZONE_DIGITS)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Tables(spark, folder))
