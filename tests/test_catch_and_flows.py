import math

from pyspark.sql import functions as F

from seaplate.operators import catch, flows
from seaplate.sources.schemas import CATCH


def fact(frame, rows):
    """(year, eez, fleet, gear, species, tonnes) rows as an industrial catch table."""
    full = [(y, e, f, "Industrial", "Reported", g, "Discards", s, s, t) for y, e, f, g, s, t in rows]
    return frame(full, CATCH)


ROWS = [
    (2018, "Alpha (North)", "Alpha", "bottom trawl", "X y", 2.0),
    (2018, "Alpha (North)", "Beta", "bottom trawl", "X y", 6.0),
    (2018, "Alpha, South", "Beta", "bottom trawl", "X y", None),
    (2018, "Beta", "Alpha", "bottom trawl", "X y", 1.0),
    (2018, "Nowhere", "Alpha", "bottom trawl", "X y", 0.5),
    (2018, "Gamma Isles", "Delta", "bottom trawl", "X y", 0.25),
    (2018, "Beta", "Alpha", "longline", "X y", 5.0),
    (2017, "Beta", "Alpha", "longline", "X y", 3.0),
]
ISO = [("Alpha", "AAA"), ("Beta", "BBB"), ("Gamma", "GGG")]
ALIASES = [("ALPHA", "AAA", "Asia"), ("beta", "BBB", "Africa")]
PATTERNS = [("gamma", "GGG", "Europe")]


def pairs(frame):
    return flows.zone_fleet_tonnes(
        fact(frame, ROWS),
        frame(ISO, "missing_countries string, iso3c string"),
        frame(ALIASES, "alias string, iso3c string, continent string"),
        PATTERNS,
    )


def test_gear_share_leaves_out_years_without_the_gear(frame):
    rows = catch.gear_share_by_year(fact(frame, ROWS)).collect()
    assert [(r["year"], r["tonnes"], r["tonnes_tot"]) for r in rows] == [(2018, 9.75e-6, 14.75e-6)]
    assert math.isclose(rows[0]["perc_trawl"], 100 * 9.75 / 14.75)


def test_ranked_totals_put_missing_last_and_break_ties(frame):
    df = fact(frame, [(2018, "Z", "A", "bottom trawl", s, t) for s, t in [("b", 1.0), ("a", 1.0), ("c", None)]])
    assert [r[0] for r in catch.total_by_species(df).collect()] == ["a", "b", "c"]


def test_mean_biomass_skips_missing(frame):
    df = fact(frame, [(2018, "Z", "A", "bottom trawl", "s", t) for t in (1.0, None, 3.0)])
    assert catch.mean_biomass_by_key(df).first()["tonnes"] == 2.0


def test_zones_are_split_resolved_and_flagged(frame):
    got = {(r["eez_country"], r["fishing_entity"]): (r["eez_iso"], r["tonnes"], r["is_same"]) for r in pairs(frame).collect()}
    assert got == {
        ("Alpha", "Alpha"): ("AAA", 2.0, "your_country"),
        ("Alpha", "Beta"): ("AAA", None, "other_country"),
        ("Beta", "Alpha"): ("BBB", 1.0, "other_country"),
        ("Nowhere", "Alpha"): (None, 0.5, None),
        ("Gamma Isles", "Delta"): ("GGG", 0.25, None),
    }


def test_zone_flow_fills_gaps_and_floors_the_log(frame):
    intake = flows.deficiency_mean(frame([("AAA", "n", 30.0), ("BBB", "n", None)], "iso3 string, nutrient string, perc_deficient double"))
    zones = {r["eez_country"]: r for r in flows.zone_flow(pairs(frame), intake).collect()}
    assert (zones["Alpha"]["your_country"], zones["Alpha"]["other_country"]) == (2.0, 0.0)
    assert zones["Gamma Isles"]["total"] == 0.0
    assert zones["Gamma Isles"]["perc_foreign"] is None
    assert zones["Gamma Isles"]["total_log"] == 1.0
    assert zones["Alpha"]["total_log"] == math.log(2)
    assert zones["Alpha"]["intake"] == 30.0 and zones["Beta"]["intake"] is None


def test_scores_are_null_when_a_side_is_unknown(frame):
    rows = [("A", 30.0, 95.0), ("B", 20.0, 95.0), ("C", None, 95.0), ("D", 30.0, None)]
    scores = flows.vulnerability_score(frame(rows, "eez_iso string, intake double, perc_foreign double"))
    got = {r["eez_iso"]: (r["is_vulnerable"], r["is_foreign"], r["is_all"]) for r in scores.collect()}
    assert got == {"A": (1, 3, 4), "B": (0, 3, 3), "C": (None, 3, None), "D": (1, None, None)}
    assert [r["eez_iso"] for r in flows.critical_zones(scores).collect()] == ["A"]


def test_own_catch_is_the_same_from_both_sides(frame):
    clean = pairs(frame).filter("eez_iso is not null and fishing_entity_ISO is not null")
    zones = flows.zone_flow(clean, frame([], "iso3 string, intake double"))
    table = flows.flow_table(zones, flows.fleet_flow(clean)).na.fill(0.0)
    assert table.filter("your_country_eez <> your_country_entity").count() == 0


def test_net_flow_is_gain_minus_loss(frame):
    values = frame([("X y", "Iron", 2.0), ("X y", "Zinc", None)], "scientific_name string, nutrient string, value double")
    pop = frame([("AAA", 10.0), ("BBB", 20.0)], "iso3c string, pop double")
    nutrient_pairs = flows.zone_fleet_nutrients(
        catch.zone_species_tonnes(catch.catch_cells(fact(frame, ROWS))),
        values,
        frame(ISO, "missing_countries string, iso3c string"),
        frame(ALIASES, "alias string, iso3c string, continent string"),
        PATTERNS,
    )
    zone, fleet = flows.nutrient_zone_flow(nutrient_pairs, pop), flows.nutrient_fleet_flow(nutrient_pairs, pop)
    net = {(r[0], r[1]): r[2] for r in flows.net_nutrient_flow(zone, fleet).collect()}
    assert math.isclose(net["AAA", "Iron"], (6.0 - 1.0) * 2e4 / 10 / 365)
    assert math.isclose(net["BBB", "Iron"], 1.0 * 2e4 / 20 / 365 - 6.0 * 2e4 / 20 / 365)
    assert net["AAA", "Zinc"] == 0.0 and net["GGG", "Iron"] == 0.0


def test_unmatched_species_keep_a_row_without_nutrient(frame):
    values = frame([], "scientific_name string, nutrient string, value double")
    nutrient_pairs = flows.zone_fleet_nutrients(
        catch.zone_species_tonnes(catch.catch_cells(fact(frame, ROWS))), values, frame(ISO, "missing_countries string, iso3c string"),
        frame(ALIASES, "alias string, iso3c string, continent string"), PATTERNS,
    )
    assert {r["nutrient"] for r in nutrient_pairs.collect()} == {None}
    assert nutrient_pairs.agg(F.sum("nut_supply")).first()[0] == 0.0


def test_unresolved_names_keep_their_tonnes(frame):
    rows = flows.unresolved_names(
        fact(frame, ROWS), frame(ISO, "missing_countries string, iso3c string"), frame(ALIASES, "alias string, iso3c string, continent string"), PATTERNS
    ).collect()
    pairs_open = pairs(frame).filter("eez_iso is null").agg(F.sum("tonnes")).first()[0] or 0.0
    assert sum(r["tonnes"] for r in rows if r["side"] == "zone") == pairs_open
    assert [r["tonnes"] for r in rows] == sorted((r["tonnes"] for r in rows), reverse=True)


def test_both_names_of_a_country_are_aliases(frame):
    key = frame([("AAA", "Aland Islands", "Aland", "EU"), ("BBB", "Bland", "Bland", "AF")], "iso3_use string, country string, country_use string, continent_region string")
    aliases = flows.aliases_from_key(key)
    names = frame([("aland",), ("ALAND ISLANDS",), ("Bland",), ("Nowhere",)], "name string")
    got = {r["name"]: r["iso3c"] for r in flows.country_resolve(names, "name", aliases).collect()}
    assert got == {"aland": "AAA", "ALAND ISLANDS": "AAA", "Bland": "BBB", "Nowhere": None}
