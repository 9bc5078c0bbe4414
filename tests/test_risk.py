import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seaplate.functions import quadrature
from seaplate.functions.numeric import upper_normal_array
from seaplate.functions.quantiles import gamma_log_quantile, gamma_mass
from seaplate.operators import intake, risk

FIT = (
    "row int, nutrient string, iso3 string, country string, scenario string, sex_id int, age_id int, best_dist string, "
    "g_shape double, g_rate double, g_mean_diff double, ln_meanlog double, ln_sdlog double, ln_mean_diff double"
)


def normal_tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def lognormal_integral(f, mu, sd, shift, n=20001):
    z = np.linspace(-3.719016485, 3.719016485, n)
    y = np.array([f(math.exp(mu + sd * v) + shift) for v in z]) * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return float(np.trapezoid(y, z))


def limited_reference(xs, ys):
    """Slopes of the 1980 paper, piece after piece."""
    s = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(len(xs) - 1)]
    m = [s[0], *((a + b) / 2 for a, b in zip(s, s[1:])), s[-1]]
    for i, slope in enumerate(s):
        if slope == 0:
            m[i] = m[i + 1] = 0.0
            continue
        a, b = m[i] / slope, m[i + 1] / slope
        if 2 * a + b > 3 and a + 2 * b > 3 and a - (2 * a + b - 3) ** 2 / (3 * (a + b - 2)) < 0:
            m[i], m[i + 1] = (3 * slope * v / math.hypot(a, b) for v in (a, b))
    return m


@pytest.fixture(scope="module")
def omega(spark):
    points = [(a, float(x), 1 - 0.05 * x - 0.1 * (x > 2)) for a in (10, 33) for x in range(4)]
    return risk.omega_curves(spark.createDataFrame(points, "age_id int, x double, y double"))


def test_normal_tail_against_erfc():
    z = np.linspace(-12, 12, 801)
    wanted = np.array([normal_tail(v) for v in z])
    assert np.abs(upper_normal_array(z) - wanted).max() < 1e-14
    assert np.abs(upper_normal_array(z) / wanted - 1)[z > 0].max() < 1e-7


def test_micronutrient_risk_column(frame):
    df = frame([("Iron", 9.0, 10.0), ("Vitamin B-12", 9.0, 10.0), ("Iron", 9.0, None)], "nutrient string, x double, ear double")
    got = [r["risk"] for r in risk.micronutrient_risk(df).collect()]
    assert got[:2] == [pytest.approx(normal_tail(-1.0), abs=1e-7), pytest.approx(normal_tail(-0.4), abs=1e-7)]
    assert got[2] is None


def test_curve_passes_its_knots_and_extends_flat(frame, omega):
    intakes = [(10, x) for x in (-5.0, -0.2, 0.0, 1.0, 2.0, 3.0, 6.0, 50.0)] + [(7, 1.0)]
    rows = risk.omega_risk(frame(intakes, "age_id int, x double"), omega).collect()
    got = {(r["age_id"], r["x"]): r["risk"] for r in rows}
    wanted = {-5.0: 1.0, -0.2: 1.0, 0.0: 1.0, 1.0: 0.95, 2.0: 0.9, 3.0: 0.75, 6.0: 0.75, 50.0: 0.75}
    assert all(math.isclose(got[10, x], y, abs_tol=1e-12) for x, y in wanted.items())
    assert got[7, 1.0] == 0.0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 5), min_size=3, max_size=8))
def test_monotone_between_knots(steps):
    xs = np.arange(len(steps) + 1, dtype=float)
    ys = 1 - np.concatenate([[0.0], np.cumsum(steps)])
    curve = quadrature.hermite_array(np.linspace(0, xs[-1], 500), xs, ys, np.array(limited_reference(xs, ys)))
    assert np.all(np.diff(curve) <= 1e-9)


def test_slopes_match_the_paper(frame):
    rng = np.random.default_rng(3)
    curves = {age: np.round(1 + np.cumsum(rng.exponential(1, 5) ** 3 * (rng.random(5) > 0.2)), 6) for age in (10, 11, 12, 13, 14)}
    points = [(429, a, 50.0 * i, float(y)) for a, ys in curves.items() for i, y in enumerate(ys)]
    rows = risk.meat_curves(frame(points, "cause_id int, age_id int, x double, y double")).collect()
    assert len(rows) == len(curves)
    for r in rows:
        assert r["xs"] == [-200.0, 0.0, 50.0, 100.0, 150.0, 200.0, 1000.0]
        assert np.allclose(r["ms"], limited_reference(r["xs"], r["ys"]), atol=1e-12)
        assert r["last_risk"] == curves[r["age_id"]][-1]


def test_points_at_one_x_are_averaged_and_every_code_kept(frame):
    points = [(10, 0.0, 1.0), (10, 1.0, 0.8), (10, 1.0, 0.6), (99, 0.0, 1.0), (99, 1.0, 0.5), (99, None, 0.1), (99, 2.0, None)]
    rows = risk.omega_curves(frame(points, "age_id int, x double, y double")).orderBy("age_id").collect()
    assert [(r["age_id"], r["ys"]) for r in rows] == [
        (10, [1.0, 1.0, pytest.approx(0.7), pytest.approx(0.7)]),
        (99, [1.0, 1.0, 0.5, 0.5]),
    ]


@pytest.mark.parametrize(
    ("xs", "knots", "values"),
    [
        ([0.0, 2.0, 8.0], [-0.2, 0.0, 2.0, 6.0, 8.0], [1.0, 1.0, 0.9, 0.7, 0.7]),  # beyond the high end knot
        ([0.0, 2.0, 6.0], [-0.2, 0.0, 2.0, 6.0], [1.0, 1.0, 0.9, 0.7]),  # at it
        ([-1.0, 2.0, 3.0], [-1.0, -0.2, 2.0, 3.0, 6.0], [1.0, 1.0, 0.9, 0.7, 0.7]),  # below the low end knot
        ([-0.2, 2.0, 3.0], [-0.2, 2.0, 3.0, 6.0], [1.0, 0.9, 0.7, 0.7]),  # at it
    ],
)
def test_end_knots_are_sorted_and_merged(frame, xs, knots, values):
    points = [(10, x, y) for x, y in zip(xs, (1.0, 0.9, 0.7), strict=True)]
    curve = risk.omega_curves(frame(points, "age_id int, x double, y double")).first()
    assert curve["xs"] == knots and curve["ys"] == pytest.approx(values) and curve["last_risk"] == 0.7
    assert np.allclose(curve["ms"], limited_reference(curve["xs"], curve["ys"]), atol=1e-12)


def test_a_point_at_the_end_knot_is_averaged_with_the_last_risk(frame):
    points = [(10, 0.0, 1.0), (10, 6.0, 0.9), (10, 9.0, 0.5)]
    curve = risk.omega_curves(frame(points, "age_id int, x double, y double")).first()
    assert curve["xs"] == [-0.2, 0.0, 6.0, 9.0] and curve["ys"] == pytest.approx([1.0, 1.0, 0.7, 0.5]) and curve["last_risk"] == 0.5


def test_an_outcome_without_a_code_keeps_its_curve(frame):
    wide = frame([("Breast cancer", 0.0, 1.0), ("Gout", 0.0, 1.2)], "`Diet.high.in.red.meat` string, x double, age10 double")
    codes = {r["cause_id"]: r["y"] for r in risk.meat_points(wide).collect()}
    assert codes == {429: 1.0, -zlib.crc32(b"Gout"): 1.2}


def test_curve_table_has_one_row_per_piece(omega):
    rows = [r for r in risk.curve_table(omega).orderBy("age_id", "piece").collect() if r["age_id"] == 10]
    assert [r["piece"] for r in rows] == [0, 1, 2, 3, 4]
    assert [r["x1"] for r in rows[:-1]] == [r["x0"] for r in rows[1:]]


def fits(frame, rows):
    base = [(i, *("Iron", "AAA", "Aland", "Base", 1, 10), *r) for i, r in enumerate(rows)]
    return frame(base, FIT)


REQUIREMENTS = "age_groups int, sex_groups int, `Iron.5%` double, `Iron.10%` double, `Iron.12%` double, `Zinc.low` double, `Zinc.mod` double, `Zinc.high` double, VitA double, B12 double, Calcium double"


def needs(frame):
    return frame([(10, 1, 12.0, 10.0, 8.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0)], REQUIREMENTS)


def test_exposure_against_fine_integration(frame):
    lognormal = [("log-normal", None, None, None, mu, sd, shift) for mu in (2.0, 3.0) for sd in (0.02, 0.2, 0.6, 2.0, 4.0) for shift in (-1.0, 0.5)]
    odd = [("log-normal", None, None, None, 2.0, 0.0, 0.0), ("weibull", 2.0, 1.0, 0.0, 2.0, 0.5, 0.0), (None, None, None, None, None, None, None)]
    sdi = frame([("AAA", "middle")], "iso3 string, sdi_group string")
    got = {r["row"]: r["sev"] for r in risk.sev_micronutrient(fits(frame, lognormal + odd), needs(frame), sdi).collect()}
    for i, (_, _, _, _, mu, sd, shift) in enumerate(lognormal):
        wanted = 100 * lognormal_integral(lambda x: normal_tail((x - 10) / 1.0), mu, sd, shift)
        assert got[i] == pytest.approx(wanted, abs=1e-5)
        assert 0 <= got[i] <= 100
    assert [got[len(lognormal) + k] for k in range(3)] == [None, None, None]


def test_exposure_falls_with_mean_intake(frame):
    rows = [("log-normal", None, None, None, 2.0, 0.4, shift) for shift in np.linspace(-3, 6, 10).tolist()]
    sdi = frame([("AAA", "middle")], "iso3 string, sdi_group string")
    got = [r["sev"] for r in risk.sev_micronutrient(fits(frame, rows), needs(frame), sdi).orderBy("row").collect()]
    assert got == sorted(got, reverse=True)


SHAPES = np.array([0.01, 0.03, 0.1, 0.3, 1.0, 2.5, 40.0, 499.0, 501.0, 1e4, 1e6, 1e7, 1e8])


def test_gamma_mass_and_quantiles():
    for p in (1e-4, 0.5, 0.9999):
        assert np.allclose(gamma_mass(SHAPES, gamma_log_quantile(p, SHAPES)), p, rtol=1e-6)
    assert math.exp(gamma_log_quantile(0.5, np.array([1.0]))[0]) == pytest.approx(math.log(2))
    whole = np.arange(1.0, 30.0)
    poisson = [1 - sum(math.exp(-7.0 + k * math.log(7.0) - math.lgamma(k + 1)) for k in range(int(a))) for a in whole]
    assert np.allclose(gamma_mass(whole, np.full(29, math.log(7.0))), poisson, atol=1e-12)
    # Wilson and Hilferty's quantiles, which are close for large shapes.
    for a in (1e6, 1e7, 1e8):
        cube = a * (1 - 1 / (9 * a) + 3.719016485 / (3 * math.sqrt(a))) ** 3
        assert math.exp(gamma_log_quantile(0.9999, np.array([a]))[0]) == pytest.approx(cube, rel=1e-7)
    assert np.abs(gamma_mass(np.full(5, 499.999999), np.log(np.linspace(450, 550, 5))) - gamma_mass(np.full(5, 500.000001), np.log(np.linspace(450, 550, 5)))).max() < 2e-7


def test_gamma_exposure_for_any_shape(frame):
    mean = 10.0
    rows = [("gamma", float(a), float(a) / mean, 0.0, None, None, None) for a in SHAPES] + [("gamma", -1.0, 1.0, 0.0, None, None, None)]
    sdi = frame([("AAA", "middle")], "iso3 string, sdi_group string")
    got = {r["row"]: r["sev"] for r in risk.sev_micronutrient(fits(frame, rows), needs(frame), sdi).collect()}
    for i, a in enumerate(SHAPES):
        t = np.linspace(*(gamma_log_quantile(p, np.array([a]))[0] for p in (1e-4, 0.9999)), 400_001)
        log_density = a * (t - math.log(a)) - np.expm1(t - math.log(a)) * a - a + a * math.log(a) - math.lgamma(a)
        wanted = 100 * float(np.trapezoid(np.exp(log_density) * upper_normal_array(np.exp(t) / a * mean - 10.0), t))
        assert got[i] == pytest.approx(wanted, rel=1e-3)
    assert got[len(SHAPES)] is None


def test_a_zero_or_missing_requirement_has_no_exposure(frame):
    sdi = frame([("AAA", "middle")], "iso3 string, sdi_group string")
    zero = frame([(10, 1, 12.0, 0.0, 8.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0)], REQUIREMENTS)
    rows = fits(frame, [("log-normal", None, None, None, 2.0, 0.4, 0.0)])
    assert risk.sev_micronutrient(rows, zero, sdi).first()["sev"] is None
    assert risk.sev_micronutrient(rows, zero.filter("age_groups = 1"), sdi).first()["sev"] is None


def test_bounds(frame):
    rows = [("log-normal", None, None, None, 1.0, 0.5, 2.0), ("gamma", 1.0, 2.0, 3.0, None, None, None), ("other", 1.0, 1.0, 0.0, 0.0, 1.0, 0.0)]
    got = {r["row"]: (r["val_lo"], r["val_hi"]) for r in risk.intake_bounds(fits(frame, rows)).collect()}
    assert got[0] == pytest.approx((math.exp(1 - 0.5 * 3.719016485) + 2, math.exp(1 + 0.5 * 3.719016485) + 2))
    assert got[1] == pytest.approx((-math.log(1 - 1e-4) / 2 + 3, -math.log(1e-4) / 2 + 3))
    assert got[2] == (None, None)


def test_iron_needs_a_development_group(frame):
    df = frame([("Iron", "AAA", 10, 1), ("Iron", "BBB", 10, 1), ("Vitamin B-12", "BBB", 10, 1), ("Zinc", "CCC", 10, 1)], "nutrient string, iso3 string, age_id int, sex_id int")
    sdi = frame([("AAA", "low"), ("BBB", None), ("CCC", "high")], "iso3 string, sdi_group string")
    got = {(r["nutrient"], r["iso3"]): r["ear"] for r in risk.ear_lookup(df, needs(frame), sdi).collect()}
    assert got == {("Iron", "AAA"): 12.0, ("Iron", "BBB"): None, ("Vitamin B-12", "BBB"): 2.0, ("Zinc", "CCC"): 4.0}


def test_omega_exposure_is_clamped_and_matches_the_curve(frame, omega):
    rows = [("log-normal", None, None, None, mu, 0.5, 0.0) for mu in (-2.0, 0.0, 0.7, 3.0)]
    df = fits(frame, rows).replace("Iron", "Omega-3 fatty acids", "nutrient")
    curve = {r["age_id"]: r for r in omega.collect()}[10]
    xs, ys, ms = (np.array(curve[c]) for c in ("xs", "ys", "ms"))
    got = {r["row"]: r["sev"] for r in risk.sev_omega3(df, omega).collect()}
    for i, row in enumerate(rows):
        mean = lognormal_integral(lambda x: float(quadrature.hermite_array(np.array([x]), xs, ys, ms)[0]), row[4], 0.5, 0.0)
        assert got[i] == pytest.approx(max(0.0, (mean - 0.75) / 0.25 * 100), abs=1e-4)


def test_fractions(frame):
    points = [(429, 10, x, y) for x, y in ((0.0, 1.0), (50.0, 1.1), (100.0, 1.3), (150.0, 1.4), (200.0, 1.5))]
    meat = risk.meat_curves(frame(points, "cause_id int, age_id int, x double, y double"))
    rows = [("log-normal", None, None, None, 4.0, 0.3, 0.0)]
    base = fits(frame, rows)
    both = base.unionByName(base.replace("Base", "High road", "scenario").replace(0.0, 20.0, "ln_mean_diff"))
    young = both.unionByName(both.replace(10, 7, "age_id"))
    share = {r["age_id"]: r for r in risk.paf_red_meat(young, meat, ["iso3", "sex_id"], relative=False).collect()}
    change = {r["age_id"]: r for r in risk.paf_red_meat(young, meat, ["iso3", "sex_id"], relative=True).collect()}
    low, high = share[10]["base"], share[10]["high"]
    assert high > low > 1
    assert share[10]["paf"] == pytest.approx((low - 1) / low) and change[10]["paf"] == pytest.approx((high - low) / low)
    assert share[7]["paf"] == change[7]["paf"] == 0.0


def test_people_affected(frame):
    rows = [("Iron", "A", "AAA", 1, 10, 10.0, 8.0), ("Iron", "A", "AAA", 2, 10, 10.0, 12.0), ("Iron", "B", "BBB", 1, 10, 1.0, 2.0), ("Iron", "A", "AAA", 1, 11, None, 2.0)]
    deltas = frame(rows, "nutrient string, country string, iso3 string, sex_id int, age_id int, sev_base double, sev_high double")
    people = frame([("AAA", "Males", "25-29", 1000.0), ("AAA", "Females", "25-29", 500.0), ("AAA", "Males", "30-34", 1.0)], "iso3 string, sex string, age_group string, npeople double")
    got = {(r["iso3"], r["sex"], r["age_group"]): r["ndeficient_diff"] for r in risk.people_affected(deltas, people).collect()}
    assert got == {("AAA", "Males", "25-29"): 20.0, ("AAA", "Females", "25-29"): 0.0, ("BBB", "Males", "25-29"): None, ("AAA", "Males", "30-34"): None}


def test_expansions(frame):
    supply = frame([("Children", "80+", 1.0), ("Males", "5-9", 2.0)], "sex string, age_range string, v double")
    assert sorted((r["sex"], r["v"]) for r in intake.sex_expand(supply).collect()) == [("Females", 1.0), ("Males", 1.0), ("Males", 2.0)]
    bands = intake.age_band_expand(supply, "age_range").collect()
    assert sorted(r["age_range"] for r in bands) == ["5-9", "80-84", "85-89", "90-94", "95-99"]


def test_group_scalar_leaves_out_incomplete_groups(frame):
    rows = [("A", "a", "Iron", "l", None, "Males", "5-9", 1.0), ("A", "a", "Iron", "l", None, "Males", "10-14", 3.0), ("A", "a", "Zinc", "l", "s", "Males", "5-9", None), ("A", "a", "Zinc", "l", "s", "Males", "10-14", 2.0)]
    supply = frame(rows, "iso3_use string, country_use string, nutrient string, units_long string, units_short string, sex string, age_range string, value_med double")
    assert sorted((r["nutrient"], r["scalar"]) for r in intake.group_scalar(supply).collect()) == [("Iron", 0.5), ("Iron", 1.5)]


def test_curves_by_number_and_with_every_row_agree(frame, omega, monkeypatch):
    rows = [("log-normal", None, None, None, 0.5, 0.5, 0.0), ("gamma", 2.0, 1.5, 0.1, None, None, None), ("other", 1.0, 1.0, 0.0, 0.0, 1.0, 0.0)]
    df = fits(frame, rows).replace("Iron", "Omega-3 fatty acids", "nutrient")
    df = df.unionByName(df.replace(10, 98, "age_id"))  # an age without a curve
    by_number = risk.sev_omega3(df, omega)
    assert "array" not in by_number.select("sev")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(risk.numbered_curves, "__defaults__", (1,))
    with_rows = risk.sev_omega3(df, omega)
    got = sorted((r["age_id"], r["row"], r["sev"]) for r in by_number.collect() if r["sev"] is not None)
    assert got == sorted((r["age_id"], r["row"], r["sev"]) for r in with_rows.collect() if r["sev"] is not None)
    assert len(got) == 2 and by_number.count() == with_rows.count() == 6


def test_each_shape_is_solved_once(frame):
    df = fits(frame, [("gamma", 2.0, float(i + 1), 0.0, None, None, None) for i in range(20)] + [("log-normal", 2.0, 1.0, 0.0, 0.0, 1.0, 0.0)])
    rows = risk.with_tails(df).collect()
    found = {(r["g_low"], r["g_high"]) for r in rows if r["best_dist"] == "gamma"}
    assert len(rows) == 21 and len(found) == 1
    low, high = found.pop()
    assert gamma_mass(2.0, math.log(low)) == pytest.approx(1e-4) and gamma_mass(2.0, math.log(high)) == pytest.approx(0.9999)
    assert [r["g_low"] for r in rows if r["best_dist"] == "log-normal"] == [None]


def test_points_of_curves_are_read_once(spark, frame, tmp_path):
    points = [(10, float(x), 1 - 0.05 * x) for x in range(4)]
    frame(points, "age_id int, x double, y double").write.parquet(str(tmp_path / "points"))
    curves = risk.omega_curves(spark.read.parquet(str(tmp_path / "points")))
    assert curves._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1
    assert curves.first()["xs"] == [-0.2, 0.0, 1.0, 2.0, 3.0, 6.0]
