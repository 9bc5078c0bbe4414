import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from seaplate.functions.quantiles import student_cdf_angle, student_quantile
from seaplate.functions.nulls import sum_fixed
from seaplate.operators import composition as comp

ASSAYS = "sciname string, genus string, family string, `order` string, class string, nutrient string, nutrient_units string, value double, line int"
TAXONOMY = "genus string, family string, `order` string, class string, line int"
NUTRIENTS = ["Iron", "Zinc"]


@pytest.fixture
def assays(frame):
    return frame(
        [
            ("Aa Bb", "Aa", "fam1", "ord1", "cls1", "Iron", "mg", 1.0, 1),
            ("aa bb", "aa", "fam1", "ord1", "cls1", "Iron", "ug", 3.0, 2),
            ("aa cc", "aa", "fam1", "ord1", "cls1", "Zinc", "mg", 5.0, 3),
            ("dd ee", "dd", "fam1", "ord1", "cls1", "Zinc", "mg", None, 4),
            ("ff gg", "ff", "fam2", "ord2", "cls1", "Iron", "mg", 9.0, 5),
            ("actinopterygii x", None, None, None, "actinopterygii", "Iron", "mg", 4.0, 6),
        ],
        ASSAYS,
    )


@pytest.fixture
def taxonomy(frame):
    return frame(
        [
            ("aa", "fam1", "ord1", "cls1", 1),
            ("dd", "fam1", "ord1", "cls1", 2),
            ("ff", "fam2", "ord2", "cls1", 3),
            ("hh", "fam3", "ord2", "cls1", 4),
        ],
        TAXONOMY,
    )


def composition(frame, assays, taxonomy, species):
    lineage = comp.lineage_resolve(comp.species_words(frame([(s,) for s in species], "scientific_name string")), taxonomy, "line")
    units = comp.nutrient_unit_key(assays, "line")
    rows = comp.taxon_fallback(lineage, comp.taxon_stats(assays), NUTRIENTS, units).collect()
    return {(r["species"], r["nutrient"]): r for r in rows}


def test_spellings_of_one_taxon_are_one_group(assays):
    rows = {(r["level"], r["taxon"], r["nutrient"]): r for r in comp.taxon_stats(assays).collect()}
    row = rows["species", "aa bb", "Iron"]
    assert (row["value"], row["count"]) == (2.0, 2)
    assert math.isclose(row["ssd"], statistics.stdev([1.0, 3.0])) and math.isclose(row["se"], row["ssd"] / math.sqrt(2))
    assert rows["family", "fam1", "Zinc"]["value"] is None and rows["family", "fam1", "Zinc"]["count"] == 2


def test_ranks_are_tried_in_order(frame, assays, taxonomy):
    species = ["Aa bb", "Aa zz", "Dd ee", "Hh ii", "Fam2 sp", "Ord2 sp", "Cls1 sp", "Osteichthyes", "Nope sp"]
    got = composition(frame, assays, taxonomy, species)
    label = {k: (r["taxa_match"], r["value"]) for k, r in got.items()}
    assert label["aa bb", "Iron"] == ("species", 2.0)
    assert label["aa zz", "Iron"] == ("genus", 2.0)
    assert label["dd ee", "Iron"] == ("family", 2.0)
    assert label["hh ii", "Iron"] == ("order", 9.0)
    assert label["fam2 sp", "Iron"] == ("family", 9.0)
    assert label["ord2 sp", "Iron"] == ("order", 9.0)
    assert label["cls1 sp", "Iron"] == ("class", pytest.approx(13 / 3))
    assert label["osteichthyes", "Iron"] == ("class", 4.0)
    assert label["nope sp", "Iron"] == (None, None)
    # One missing assay makes every mean above it missing.
    assert label["dd ee", "Zinc"] == (None, None)
    assert len(got) == len(species) * len(NUTRIENTS)
    assert got["aa bb", "Iron"]["nutrient_units"] == "mg"


def test_lineage_keeps_family_missing_when_read_as_family(frame, taxonomy):
    words = comp.species_words(frame([("Fam1 sp",), ("Ord1 sp",)], "scientific_name string"))
    rows = {r["species"]: r for r in comp.lineage_resolve(words, taxonomy, "line").collect()}
    assert (rows["fam1 sp"]["family"], rows["fam1 sp"]["order"], rows["fam1 sp"]["class"]) == (None, "ord1", "cls1")
    assert (rows["ord1 sp"]["order"], rows["ord1 sp"]["class"]) == (None, "cls1")


def test_student_quantiles_match_the_published_table():
    got = student_quantile(0.975, np.array([1.0, 2.0, 5.0, 10.0, 30.0, 120.0]))
    assert np.allclose(got, [12.706, 4.303, 2.571, 2.228, 2.042, 1.980], atol=5e-4)


def test_student_quantiles_for_any_degrees_of_freedom():
    df = np.array([1.0, 3.0, 399.0, 401.0, 1e4, 1e9, 1e10, 1e12, 1e15])
    got = student_quantile(0.975, df)
    assert np.all(np.diff(got) < 1e-12) and got[-1] == pytest.approx(1.959963984540054, rel=1e-12)
    assert np.allclose(student_cdf_angle(np.arctan(got[:5] / np.sqrt(df[:5])), df[:5]), 0.975, atol=1e-10)
    near = student_quantile(0.975, np.array([399.999999, 400.0]))
    assert near[0] == pytest.approx(near[1], rel=1e-8)


def test_interval_is_null_for_one_observation(frame):
    df = comp.t_interval(frame([(5.0, None, 1), (5.0, 1.0, 3)], "value double, se double, count long"))
    rows = df.orderBy("count").collect()
    assert rows[0]["lower_ci"] is None
    assert math.isclose(rows[1]["upper_ci"], 5 + 4.302652729749, rel_tol=1e-9)


def test_group_fill_weighs_species_by_catch_rows(frame):
    known = [("a x", "Iron", "mg", 1.0, None, 1, None, "species"), ("b x", "Iron", "mg", 4.0, None, 1, None, "genus"), ("a y", "Iron", "mg", None, None, None, None, None), ("c x", "Iron", "mg", None, None, None, None, None)]
    composition = frame(known, "species string, nutrient string, nutrient_units string, value double, ssd double, count long, se double, taxa_match string")
    counts = frame([("a x", 3), ("b x", 1), ("a y", 7), ("c x", 2)], "species string, n_rows long")
    groups = frame([("A one", "g", 1), ("A two", "other", 2), ("B x", "g", 3)], "scientific_name string, functional_group string, line int")
    rows = {r["species"]: r for r in comp.functional_group_fill(composition, counts, groups, "line").collect()}
    expanded = [1.0, 1.0, 1.0, 4.0]
    assert rows["a y"]["value"] == statistics.mean(expanded) and rows["a y"]["count"] == 4
    assert math.isclose(rows["a y"]["ssd"], statistics.stdev(expanded))
    assert rows["a y"]["taxa_match"] == rows["c x"]["taxa_match"] == "Functional group"
    assert rows["c x"]["value"] is None
    assert rows["a x"]["taxa_match"] == "species"


def test_supply_before_and_after_pre_aggregation_agree(frame):
    composition = frame([("a x", "Iron, total", 2.0), ("b x", "Iron, total", None)], "species string, nutrient string, value double")
    biomass = frame([("f", "A x", 1.0), ("f", "A x", 2.0), ("f", "B x", 5.0), ("h", "A x", None), ("h", "A x", 3.0)], "fleet string, scientific_name string, tonnes double")
    rows = comp.nutrient_supply(biomass, composition).groupBy("fleet").agg(F.sum("nut_supply").alias("s")).collect()
    loose = comp.supply_by(biomass, composition, ["fleet"], strict=False).collect()
    assert {r["fleet"]: r["s"] for r in rows} == {r["fleet"]: r["nut_supply"] for r in loose} == {"f": 60000.0, "h": 60000.0}
    strict = {r["fleet"]: r["nut_supply"] for r in comp.supply_by(biomass, composition, ["fleet"], strict=True).collect()}
    assert strict == {"f": None, "h": None}


def test_fixed_sums_do_not_depend_on_the_order_of_rows(frame):
    draw = random.Random(4)
    values = [draw.uniform(-1, 1) * 10 ** draw.randint(-3, 9) for _ in range(400)]
    sums = set()
    for parts in (1, 3, 7):
        draw.shuffle(values)
        sums.add(frame([(v,) for v in values], "v double").repartition(parts).agg(sum_fixed("v", 6)).first()[0])
    exact = sum(round(v * 10**6) for v in values) / 10**6
    assert sums == {exact} and exact == pytest.approx(math.fsum(values), abs=1e-3)


def test_fixed_sums_of_odd_values(frame):
    df = frame([("a", 1.5), ("a", None), ("b", None), ("c", math.inf), ("c", 1.0), ("d", 1e35), ("d", 1e35)], "k string, v double")
    rows = {r["k"]: (r["loose"], r["strict"]) for r in df.groupBy("k").agg(sum_fixed("v", 6).alias("loose"), sum_fixed("v", 6, strict=True).alias("strict")).collect()}
    assert rows == {"a": (1.5, None), "b": (0.0, None), "c": (math.inf, math.inf), "d": (2e35, 2e35)}


def test_moments_keep_their_digits_and_can_be_merged_again(frame):
    """A deviation of a billionth of the mean."""
    values = [1000 + 1e-6 * k for k in (-3, -1, 0, 2, 5, 7)]
    counts = [1, 4, 2, 3, 1, 5]
    expanded = [v for v, n in zip(values, counts, strict=True) for _ in range(n)]
    parts = frame([("g", i % 2, n, v, 0.0) for i, (v, n) in enumerate(zip(values, counts, strict=True))], "k string, half int, count long, value double, m2 double")
    whole = comp.merge_moments(parts, ["k"]).first()
    again = comp.merge_moments(comp.merge_moments(parts, ["k", "half"]).drop("half"), ["k"]).first()
    for row in (whole, again):
        assert row["count"] == len(expanded) and row["value"] == pytest.approx(statistics.fmean(expanded), rel=1e-15)
        assert math.sqrt(row["m2"] / (len(expanded) - 1)) == pytest.approx(statistics.stdev(expanded), rel=1e-6)
