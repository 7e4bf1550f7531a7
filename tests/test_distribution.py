import numpy as np
import pytest

from ratecube.operators import distribution

AGES = {"a": [1, 2, 2, 3, 10, 40, 41, None], "b": [5, 7]}


def counts(spark, ages=AGES):
    records = spark.createDataFrame(
        [(g, v, 1) for g, values in ages.items() for v in values], "g string, age int, n long"
    )
    return distribution.histogram(records, ["g"], "age")


def test_mean_and_median_match_the_records(spark):
    got = {r["g"]: tuple(r)[1:] for r in distribution.mean_and_median(counts(spark), ["g"], "age").collect()}
    present = [v for v in AGES["a"] if v is not None]
    assert got["a"] == (pytest.approx(np.mean(present)), np.median(present), 8)
    assert got["b"] == (6.0, 6.0, 2)


def test_density_matches_a_direct_sum(spark):
    table = distribution.density(counts(spark), ["g"], "age", points=16).orderBy("x").collect()
    for group, values in AGES.items():
        v = np.array([a for a in values if a is not None], dtype=float)
        iqr = np.subtract(*np.percentile(v, [75, 25]))
        width = 0.9 * min(v.std(ddof=1), iqr / 1.34) * len(v) ** -0.2
        grid = np.linspace(1, 41, 16)
        want = [np.exp(-0.5 * ((x - v) / width) ** 2).sum() / (len(v) * width * np.sqrt(2 * np.pi)) for x in grid]
        mine = [r for r in table if r["g"] == group]
        assert [r["x"] for r in mine] == pytest.approx(list(grid))
        assert [r["density"] for r in mine] == pytest.approx(want)


def test_density_of_one_value_does_not_divide_by_zero(spark):
    table = distribution.density(counts(spark, {"a": [3], "b": [4, 4]}), ["g"], "age", points=4)
    assert all(r["density"] > 0 for r in table.filter("g = 'b' AND x > 3.5").collect())
