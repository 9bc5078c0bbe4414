"""Foreign-fleet flows, in tonnes and as net nutrient supply per person."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seaplate.operators import flows


def catch_flows(
    catch: DataFrame, countries_iso: DataFrame, aliases: DataFrame, deficiency: DataFrame, patterns=()
) -> tuple[DataFrame, DataFrame]:
    """(zone side, fleet side) of the catch; both read the same zone-by-fleet aggregate."""
    pairs = flows.zone_fleet_tonnes(catch, countries_iso, aliases, patterns)
    return flows.zone_flow(pairs, flows.deficiency_mean(deficiency)), flows.fleet_flow(pairs)


def net_supply(pairs: DataFrame, population: DataFrame) -> DataFrame:
    """Net nutrient flow per person and day from zone-by-fleet supplies, which both sides read."""
    return flows.net_nutrient_flow(
        flows.nutrient_zone_flow(pairs, population), flows.nutrient_fleet_flow(pairs, population)
    )
