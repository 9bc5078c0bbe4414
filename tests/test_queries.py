"""Registered queries against their SQL counterparts on the given tables.

``SEAPLATE_ALL=1`` runs every query; otherwise one or two of each kind, and the exposure chain on a larger table too,
whose fits are wider.
"""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry_module

SOME = [
    "gear_share_by_year",
    "entity_share_for_year",
    "mean_biomass_by_key",
    "zone_species_total",
    "t_interval",
    "taxon_fallback",
    "functional_group_fill",
    "supply_discard_ratio",
    "bloc_expand",
    "supply_share_table",
    "country_resolve",
    "zone_flow",
    "flow_table",
    "group_scalar",
    "curve_table",
    "red_meat_risk",
    "sev_red_meat",
    "paf_red_meat_relative",
    "sev_scenario_delta_mixed",
    "people_affected",
    "metric_box_stats_tonnes",
]


LARGER = "/root/testdata/sf0.01"
ON_LARGER = ["sev_micronutrient", "sev_micronutrient_gamma", "sev_country_mean", "sev_report", "supply_reporting_ratio"]


@pytest.fixture(scope="module")
def con(folder):
    connection = connect(folder)
    yield connection
    connection.close()


def test_every_query_has_a_counterpart():
    assert set(entry_module.QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns == ["iso3c", "nutrient", "per_capita"] and rows.count() > 0


@pytest.mark.parametrize("name", sorted(entry_module.QUERIES) if os.environ.get("SEAPLATE_ALL") else SOME)
def test_same_result_as_sql(spark, con, folder, name):
    assert differences(entry_module.queries()[name](spark, folder), con, entry_module.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ON_LARGER)
def test_same_result_as_sql_on_a_larger_table(spark, name):
    connection = connect(LARGER)
    assert differences(entry_module.queries()[name](spark, LARGER), connection, entry_module.oracle_sql()[name]) == []
    connection.close()
