import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seaplate.operators import balance, intake, reports
from seaplate.vocab import METRIC_CAPS


def test_parse_and_unpivot(frame):
    wide = frame(
        [("s", "Ca", "Fish", "Iron supply [mg/cap]", "AAA", "FI", "FE", 1.0, None), ("s", "Cb", "#N/A", "Fat", None, "X", "ZZ", 2.0, 3.0)],
        "`OUTPUT,0` string, countries string, products string, elements string, `...2` string, `...3` string, `...4` string, A2016 double, A2017 double",
    )
    long = balance.balance_unpivot(balance.balance_parse(wide))
    got = {(r["countries"], r["year"]): (r["nutrient"], r["nutrient_long"], r["units"], r["value"], r["iso3c"]) for r in long.collect()}
    assert got["Ca", 2017] == ("Iron", "Iron supply ", "mg/cap", None, "AAA")
    assert got["Cb", 2017] == ("ZZ", "Fat", None, 3.0, None)
    assert len(got) == 4


def test_scope_keeps_rows_without_code(frame):
    long = frame([("AAA", "Iron"), ("BBB", "Iron"), (None, "Iron"), ("AAA", "Fat")], "iso3c string, nutrient string")
    kept = balance.balance_scope(long, frame([("b", "BBB")], "countries string, iso string")).collect()
    assert sorted(map(str, (r["iso3c"] for r in kept))) == ["AAA", "None"]


def test_bloc_rows_are_copied_and_world_dropped(frame):
    rows = frame([("EUN", "EU", 1.0), ("WLD", "World", 9.0), (None, "x", 2.0), ("AAA", "A", 3.0)], "iso3c string, country string, v double")
    key = frame([("EUN", "Ca", "CA", "C a"), ("EUN", "Cb", "CB", "C b"), ("EUN", "Czechoslovakia", "CZ2", "Cz"), ("COS", "D", "DD", "D")], "group_code string, country string, iso3_use string, country_use string")
    got = sorted(map(tuple, balance.bloc_expand(rows, balance.bloc_members(key)).collect()), key=str)
    assert got == sorted([("CA", "C a", 1.0), ("CB", "C b", 1.0), (None, "x", 2.0), ("AAA", "A", 3.0)], key=str)


def test_share_columns_use_the_old_and_the_new_value_in_turn(frame):
    sectors = [("AAA", "ASF", "Iron", 3.0), ("AAA", "Fish", "Iron", 1.0), ("AAA", None, "Iron", 99.0), ("BBB", "Fish", "Iron", 1.0), ("CCC", "ASF", "Iron", 0.0)]
    catch = [("AAA", "bottom_trawl", "Iron", 0.5), ("CCC", "bottom_trawl", "Iron", 1.0), ("BBB", "bottom_trawl", "Iron", None)]
    schema = "iso3c string, production_sector string, nutrient string, nut_supply double"
    got = {r["iso3c"]: r for r in balance.supply_share_table(frame(sectors, schema), frame(catch, schema)).collect()}
    assert set(got) == {"AAA", "CCC"}
    a = got["AAA"]
    assert (a["ASF"], a["total"], a["perc_fish"], a["perc_ASF"], a["perc_tot"]) == (4.0, 4.0, 50.0, 12.5, 12.5)
    assert got["CCC"]["perc_fish"] == math.inf


def test_scenarios_without_other_food_have_no_total(frame):
    long = frame(
        [("AAA", "Iron", "Fish", "mg", "base", 2017, 1.0), ("AAA", "Iron", "Rice", "mg", "base", 2017, 4.0), ("BBB", "Iron", "Fish", "mg", "base", 2017, 1.0), (None, "Iron", "Fish", "mg", "base", 2017, 1.0), (None, "Iron", "Rice", "mg", "base", 2017, None)],
        "iso3c string, nutrient string, products string, units string, scenario string, year int, value double",
    )
    net = frame([("AAA", "Iron", 0.5)], "iso3c string, nutrient string, per_capita double")
    got = {(r["iso3c"], r["scenario"]): r["total_supply"] for r in intake.fish_scenarios(long, net, 2017).collect()}
    assert got == {("AAA", "base"): 5.0, ("AAA", "high"): 5.5, ("BBB", "base"): None, ("BBB", "high"): None, (None, "base"): 1.0, (None, "high"): 1.0}


def test_rows_without_country_keep_one_row(frame):
    scenarios = frame([("AAA", "A", "Iron", "mg", "Base", 2.0), (None, None, "Iron", "mg", "Base", 2.0)], "iso3 string, country string, nutrient string, nutrient_units string, scenario string, intake double")
    empty = frame([], "iso3_cosimo string, iso3_genus string")
    scalars = frame([("AAA", "Iron", "Males", "5-9", 1.5)], "iso3 string, nutrient string, sex string, age_group string, scalar double")
    survey = frame([("AAA", "Iron", "women", "5-9", 0.5)], "country_iso3 string, nutrient string, sex string, age_group string, scalar double")
    rows = intake.intake_by_group(scenarios, empty, scalars, survey, ages=["5-9"]).collect()
    assert sorted((str(r["sex"]), r["mean_group"]) for r in rows if r["iso3"]) == [("Females", 1.0), ("Males", 3.0)]
    assert [(r["sex"], r["mean_group"]) for r in rows if not r["iso3"]] == [(None, None)]


def test_null_counts(frame):
    got = {r["column_name"]: (r["n_missing"], r["n_rows"]) for r in intake.null_counts(frame([(1, None), (None, None), (3, "x")], "a int, b string")).collect()}
    assert got == {"a": (1, 3), "b": (2, 3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_are_exact_under_skew(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([np.full(3000, 7.0), rng.lognormal(1, 3, 5000), rng.integers(0, 50, 1000)])
    rows = [("hot", float(v)) for v in values] + [("one", 4.0)] + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "nutrient string, v double").repartition(8)
    got = {r["nutrient"]: r for r in reports.metric_box_stats(df, "v").collect()}
    q = np.quantile(values, [0.25, 0.5, 0.75])
    hot = got["hot"]
    assert np.allclose([hot["q1"], hot["median"], hot["q3"]], q, rtol=1e-12)
    low, high = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
    inside = values[(values >= low) & (values <= high)]
    assert (hot["whisker_low"], hot["whisker_high"]) == (inside.min(), inside.max())
    assert hot["n_outliers"] == len(values) - len(inside) and hot["n_values"] == len(values)
    assert (got["one"]["q1"], got["one"]["median"], got["two"]["q1"]) == (4.0, 4.0, 1.25)


def test_box_leaves_out_infinite_and_missing(frame):
    df = frame([("n", 1.0), ("n", math.inf), ("n", None), ("n", 3.0), ("n", math.nan)], "nutrient string, v double")
    assert reports.metric_box_stats(df, "v").first()["n_values"] == 2


def test_caps(frame):
    df = frame([("Iron", 99.0), ("Iron", 1.0), ("Protein", 99.0), ("Iron", None), ("Zinc", math.inf)], "nutrient string, perc_ASF double")
    got = [r["perc_ASF"] for r in reports.metric_cap(df, "perc_ASF").collect()]
    assert got == [10.0, 1.0, 99.0, None, float(METRIC_CAPS["perc_ASF"]["Zinc"])]


def test_country_mean_is_strict_and_report_keyed_by_code(frame):
    rows = [("AAA", "A", "Iron", 1.0, 2.0), ("AAA", "A", "Iron", 3.0, None), ("AAA", "A", "Vitamin B-12", 4.0, 1.0), ("AAB", "A", "Iron", 1.0, 0.5)]
    means = reports.sev_country_mean(frame(rows, "iso3 string, country string, nutrient string, sev_base double, sev_high double"))
    got = {r["iso3"]: (r["Iron"], r["Vitamin B12"], r["Zinc"]) for r in reports.sev_report(means).collect()}
    assert got == {"AAA": (None, -3.0, None), "AAB": (-0.5, None, None)}


def test_people_log_floor(frame):
    rows = [("A", "a", "Iron", 0.5), ("B", "b", "Iron", None), ("C", "c", "Iron", math.e)]
    totals = reports.people_country_total(frame(rows, "iso3 string, country string, nutrient string, ndeficient_diff double"))
    got = {r["iso3"]: (r["ndeficient_diff"], r["ndeficient_diff_log"]) for r in totals.collect()}
    assert got == {"A": (0.5, 0.0), "B": (0.0, 0.0), "C": (math.e, 1.0)}
    assert reports.people_grand_total(totals).first()[0] == pytest.approx((0.5 + math.e) / 1e6)


def test_territory_layers(frame):
    regions = frame([("AAA", "a", "Asia", 100.0), ("BBB", "b", "Europe", 100.0), ("CCC", "c", "Asia", 99999.0), ("DDD", "d", "Asia", 50.0)], "iso3 string, country string, continent string, area_sqkm double")
    tiny = frame([("AAA", "a2", "Asia")], "iso3 string, country string, continent string")
    metric = frame([("AAA", 1.0), ("BBB", 1.0), ("CCC", 1.0)], "iso3c string, m double")
    layer = reports.small_territory_layer(regions, tiny, metric, ["m"], "m").collect()
    assert [(r["country"], r["area_sqkm"]) for r in layer] == [("a2", 10.0), ("a", 100.0)]
    assert reports.region_metric_layer(regions, metric, ["m"]).filter(F.col("m").isNull()).count() == 1


def test_ages_come_from_the_survey(frame):
    survey = frame([("AAA", "Iron", "women", "5-9", 0.5), ("AAA", "Iron", "men", "100+", 2.0), ("BBB", "Iron", "men", None, 2.0)], "country_iso3 string, nutrient string, sex string, age_group string, scalar double")
    scenarios = frame([("AAA", "A", "Iron", "mg", "Base", 2.0)], "iso3 string, country string, nutrient string, nutrient_units string, scenario string, intake double")
    scalars = frame([], "iso3 string, nutrient string, sex string, age_group string, scalar double")
    rows = intake.intake_by_group(scenarios, frame([], "iso3_cosimo string, iso3_genus string"), scalars, survey).collect()
    got = {(r["sex"], r["age_group"]): r["mean_group"] for r in rows}
    assert got == {("Females", "5-9"): 1.0, ("Males", "5-9"): None, ("Females", "100+"): None, ("Males", "100+"): 4.0}
    grid = intake.demographic_grid(scenarios, intake.survey_ages(survey)).collect()
    assert {(r["sex"], r["age_group"]) for r in grid} == set(got)


def test_a_bloc_is_expanded_in_one_pass(frame):
    rows = frame([("EUN", "EU", 1.0)], "iso3c string, country string, v double")
    none = frame([], "group_code string, iso3_use string, country_use string")
    assert balance.bloc_expand(rows, none).count() == 0


def test_planning_a_grid_runs_no_job(spark, frame):
    survey = frame([("AAA", "Iron", "women", "5-9", 0.5)], "country_iso3 string, nutrient string, sex string, age_group string, scalar double")
    scenarios = frame([("AAA", "A", "Iron", "mg", "Base", 2.0)], "iso3 string, country string, nutrient string, nutrient_units string, scenario string, intake double")
    spark.sparkContext.setJobGroup("grid", "planned only")
    grid = intake.demographic_grid(scenarios, intake.survey_ages(survey))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("grid")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs and grid.count() == 2
    empty = intake.demographic_grid(scenarios, intake.survey_ages(survey.limit(0)))
    assert empty.count() == 0
    assert intake.demographic_grid(scenarios, ["5-9", "10-14"]).count() == 4
