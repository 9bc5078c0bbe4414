"""Explicit schemas of the inputs; nothing is inferred at read time."""

CATCH = (
    "year int, eez string, fishing_entity string, sector string, reporting_status string, gear string, "
    "end_use string, scientific_name string, common_name string, tonnes double"
)
COUNTRIES_ISO = "missing_countries string, iso3c string"
COASTAL_POPULATION = "iso3c string, km_20 double"
SPECIES_GROUPS = "scientific_name string, functional_group string"
ASSAYS = (
    "sciname string, genus string, family string, `order` string, class string, food_prep string, "
    "food_part string, nutrient string, nutrient_units string, value double"
)
TAXONOMY = "genus string, family string, `order` string, class string"
COUNTRY_KEY = (
    "iso3 string, country string, iso3_use string, country_use string, unm49 int, group_code string, "
    "group_name string, continent_region string"
)
EXCLUSIONS = "countries string, iso string"
SUPPLY_BY_AGE_SEX = (
    "iso3_use string, country_use string, nutrient string, units_long string, units_short string, sex string, "
    "age_range string, value_med double"
)
CROSSWALK = "iso3_cosimo string, country_cosimo string, iso3_genus string, country_genus string"
INTAKE_SCALARS = "country_iso3 string, nutrient string, sex string, age_group string, scalar double"
INTAKE_DISTRIBUTIONS = (
    "country_iso3 string, nutrient string, sex string, age_group string, best_dist string, g_shape double, "
    "g_rate double, ln_meanlog double, ln_sdlog double"
)
SDI = "iso3 string, sdi double, sdi_group string, hdi double"
POPULATION_BY_AGE_SEX = "iso3_use string, sex string, age_range string, year int, pop_size_50perc double"
DEFICIENCY = "iso3 string, nutrient string, perc_deficient double"
REGIONS = "iso3 string, country string, continent string, area_sqkm double"


def population_wide(years: list[int]) -> str:
    return "country string, indicator string, " + ", ".join(f"`{y}` double" for y in years)


def balance_wide(years: list[int], prefix: str = "A") -> str:
    ids = "`OUTPUT,0` string, countries string, products string, elements string, `...2` string, `...3` string, `...4` string, "
    return ids + ", ".join(f"`{prefix}{y}` double" for y in years)


def age_matrix(keys: str, ages: list[int]) -> str:
    return f"{keys}, " + ", ".join(f"`age{a}` double" for a in ages)
