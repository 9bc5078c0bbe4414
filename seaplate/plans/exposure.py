"""Net flow to intake scenarios, exposure values and affected people."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seaplate.operators import balance, intake, risk
from seaplate.vocab import OMEGA_END_KNOTS


def scoped_balance(wide: DataFrame, exclusions: DataFrame) -> DataFrame:
    return balance.balance_scope(balance.balance_unpivot(balance.balance_parse(wide)), exclusions)


def intake_rows(
    scenarios: DataFrame,
    names: DataFrame,
    members: DataFrame,
    crosswalk: DataFrame,
    supply_by_age_sex: DataFrame,
    survey_scalars: DataFrame,
) -> DataFrame:
    """Mean intake per scenario, country, nutrient, sex and age group."""
    by_country = intake.scenario_bloc_expand(scenarios, names, members)
    scalars = intake.age_band_expand(intake.group_scalar(intake.sex_expand(supply_by_age_sex)))
    return intake.intake_by_group(by_country, crosswalk, scalars, survey_scalars)


def coded_distributions(intakes: DataFrame, distributions: DataFrame) -> DataFrame:
    return intake.demographic_codes(intake.distribution_attach(intakes, distributions))


def omega_curves(omega_matrix: DataFrame, end_knots=OMEGA_END_KNOTS) -> DataFrame:
    return risk.omega_curves(risk.age_points(omega_matrix, []), end_knots)


def exposure_deltas(coded: DataFrame, requirements: DataFrame, sdi: DataFrame, omega: DataFrame) -> DataFrame:
    """Base and high exposure per country, nutrient, sex and age, micronutrients and omega-3 (by its curves) together."""
    micro = risk.sev_micronutrient(coded, requirements, sdi)
    return risk.sev_scenario_delta(micro, risk.sev_omega3(coded, omega))
