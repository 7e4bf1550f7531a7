import numpy as np
import pytest

from ratecube.functions.student import critical_t, two_sided_p
from ratecube.operators import panel


def made(units, times, seed=1, drop=()):
    random = np.random.default_rng(seed)
    data = []
    for u in range(units):
        for t in range(times):
            x = random.normal() + 0.3 * u + 0.1 * t * u
            y = 2.0 * x + u - 0.5 * t + random.normal()
            data.append((f"u{u}", 2014 + t, float(y), float(x)))
    return [row for i, row in enumerate(data) if i not in drop]


def brute(data):
    """Least squares with a dummy for every unit and time: slope, errors, residuals."""
    units = sorted({r[0] for r in data})
    times = sorted({r[1] for r in data})
    dummies = np.array(
        [[r[0] == u for u in units] + [r[1] == t for t in times[1:]] for r in data], dtype=float
    )
    y, x = np.array([r[2] for r in data]), np.array([r[3] for r in data])
    clean = lambda v: v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]
    ry, rx = clean(y), clean(x)
    b = rx @ ry / (rx @ rx)
    e = ry - b * rx
    n, g, t = len(data), len(units), len(times)
    iid = np.sqrt(e @ e / (n - g - t) / (rx @ rx))
    score = sum((rx * e)[[r[0] == u for r in data]].sum() ** 2 for u in units)
    cluster = np.sqrt(g / (g - 1) * (n - 1) / (n - 1 - t) * score) / (rx @ rx)
    return b, iid, cluster, ry, rx


@pytest.mark.parametrize("drop", [(), (3, 7, 18, 25)])
def test_fit_matches_dummy_regression(spark, drop):
    data = made(6, 5, drop=drop)
    b, iid, cluster, ry, rx = brute(data)
    table = spark.createDataFrame(data, "u string, t int, y double, x double")
    plain = panel.two_way_fit(table, "u", "t", "y", "x").first()
    assert plain["estimate"] == pytest.approx(b, rel=1e-9)
    assert plain["std_error"] == pytest.approx(iid, rel=1e-9)
    assert plain["df"] == len(data) - 11
    assert plain["p_value"] == pytest.approx(two_sided_p(b / iid, len(data) - 11), rel=1e-6)
    grouped = panel.two_way_fit(table, "u", "t", "y", "x", "cluster").first()
    assert grouped["std_error"] == pytest.approx(cluster, rel=1e-8)
    assert (grouped["df"], grouped["n_units"]) == (5, 6)
    clean = {(r["u"], r["t"]): (r["resid_y"], r["resid_x"]) for r in panel.two_way_residuals(table, "u", "t", "y", "x").collect()}
    for row, a, c in zip(data, ry, rx):
        assert clean[row[:2]] == (pytest.approx(a, abs=1e-9), pytest.approx(c, abs=1e-9))


def test_rows_with_a_null_are_left_out(spark):
    data = made(5, 4)
    holes = [(u, t, y, None if (u, t) == ("u2", 2015) else x) for u, t, y, x in data]
    table = spark.createDataFrame(holes, "u string, t int, y double, x double")
    fit = panel.two_way_fit(table, "u", "t", "y", "x").first()
    kept = [r for r in data if r[:2] != ("u2", 2015)]
    assert fit["n_obs"] == 19
    assert fit["estimate"] == pytest.approx(brute(kept)[0], rel=1e-9)


def test_unit_with_one_row(spark):
    data = made(5, 4) + [("solo", 2014, 1.0, 2.0)]
    table = spark.createDataFrame(data, "u string, t int, y double, x double")
    fit = panel.two_way_fit(table, "u", "t", "y", "x").first()
    assert fit["estimate"] == pytest.approx(brute(data)[0], rel=1e-9)


def test_rule_for_counted_effects(spark):
    table = spark.createDataFrame(made(6, 5), "u string, t int, y double, x double")
    errors = {
        rule: panel.two_way_fit(table, "u", "t", "y", "x", "cluster", rule).first()["std_error"]
        for rule in ("none", "nested", "full")
    }
    assert errors["full"] / errors["none"] == pytest.approx(((30 - 1) / (30 - 11)) ** 0.5)
    assert errors["nested"] / errors["none"] == pytest.approx(((30 - 1) / (30 - 6)) ** 0.5)


def test_student_t_against_tables():
    assert critical_t(0.95, 1) == pytest.approx(12.7062, abs=1e-4)
    assert critical_t(0.95, 10) == pytest.approx(2.228139, abs=1e-6)
    assert critical_t(0.95, 100) == pytest.approx(1.983972, abs=1e-6)
    assert critical_t(0.95, 1e9) == pytest.approx(1.959964, abs=1e-5)
    assert two_sided_p(2.228139, 10) == pytest.approx(0.05, abs=1e-7)
    assert two_sided_p(0.0, 7) == 1


def test_correlation_and_line_skip_incomplete_pairs(spark):
    x = [1.0, 2.0, 3.0, 4.0, None, 6.0]
    y = [2.0, 4.1, 5.9, 8.3, 1.0, None]
    table = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    r = panel.pearson(table, "x", "y").first()
    assert r["n"] == 4
    assert r["r"] == pytest.approx(np.corrcoef(x[:4], y[:4])[0, 1])
    fit = panel.linear_fit(table, "x", "y").first()
    slope, intercept = np.polyfit(x[:4], y[:4], 1)
    assert (fit["slope"], fit["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))


def test_confidence_band(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.5]
    y = [2.0, 4.1, 5.9, 8.3, 10.0]
    table = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    band = panel.confidence_band(table, "x", "y", points=10).orderBy("x").collect()
    slope, intercept = np.polyfit(x, y, 1)
    e = np.array(y) - intercept - slope * np.array(x)
    s = np.sqrt(e @ e / 3)
    sxx = np.sum((np.array(x) - np.mean(x)) ** 2)
    assert [r["x"] for r in band] == pytest.approx(list(np.linspace(1, 5.5, 10)))
    for r in band:
        half = critical_t(0.95, 3) * s * np.sqrt(1 / 5 + (r["x"] - np.mean(x)) ** 2 / sxx)
        assert r["fit"] == pytest.approx(intercept + slope * r["x"])
        assert (r["low"], r["high"]) == (pytest.approx(r["fit"] - half), pytest.approx(r["fit"] + half))
