"""Unknown weights, large degrees of freedom, top-k for any k, readers without files, one scan of the deaths."""

import math

import pytest
from samples import NEW, OLD, death, line
from test_panel import brute, made

from ratecube.functions.student import two_sided_p
from ratecube.operators import panel, shares
from ratecube.sources import deaths
from ratecube.sources.deaths import DeathFile


@pytest.mark.parametrize("df", [1e6, 1e9, 1e11])
@pytest.mark.parametrize("t", [0.1, 1.0, 2.5, 5.0])
def test_t_tail_at_large_df_is_the_normal_one_with_its_correction(t, df):
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    normal = math.erfc(t / math.sqrt(2)) + 2 * density * (t**3 + t) / (4 * df)
    assert two_sided_p(t, df) == pytest.approx(normal, abs=1e-9)


def test_t_tail_is_smooth_where_the_method_changes():
    for t in (0.5, 2.0, 4.0):
        assert two_sided_p(t, 99_999.99) == pytest.approx(two_sided_p(t, 100_000.0), abs=1e-9)


def test_top_k_of_many_rows_sorts_no_whole_group(spark, rows):
    cells = spark.range(6000).selectExpr("id % 2 AS g", "id AS c", "id div 3 AS n")
    got = rows(shares.top_k(cells, ["g"], 2000))
    for g in (0, 1):
        own = sorted((r for r in rows(cells) if r[0] == g), key=lambda r: -r[2])
        least = own[1999][2]
        assert [r for r in got if r[0] == g] == sorted((r for r in own if r[2] >= least), key=repr)


def test_fit_of_many_periods(spark):
    data = made(4, 60, drop=(5, 77, 130))
    table = spark.createDataFrame(data, "u string, t int, y double, x double")
    fit = panel.two_way_fit(table, "u", "t", "y", "x", "cluster").first()
    b, _, cluster, _, _ = brute(data)
    assert (fit["estimate"], fit["std_error"]) == (pytest.approx(b, rel=1e-9), pytest.approx(cluster, rel=1e-7))


def test_readers_of_absent_files_give_no_rows(spark):
    files = [DeathFile(2019, None)]
    assert set(deaths.read_homicides(spark, files).columns) == {f.name for f in OLD}
    assert deaths.read_homicides(spark, files).count() == deaths.read_all_deaths(spark, []).count() == 0
    assert deaths.read_deaths(spark, files).count() == 0
    assert [tuple(r) for r in deaths.record_lengths(spark, files).collect()] == [(2019, None, None, 0)]


def test_deaths_are_one_scan_for_extract_and_all_causes(spark, tmp_path, rows):
    lines = [line(OLD, **death(data_year="2014", cause_recode113=c, marital_status=m)) for c, m in (("128", "S"), ("010", "M"))]
    (tmp_path / "a").write_text("\n".join(lines) + "\n")
    new = line(NEW, **death(data_year="2024", cause_recode113="129"))
    (tmp_path / "b").write_text(new[:200] + "é" + new[201:] + "\n")  # a character beyond ASCII is one place
    files = [DeathFile(2014, str(tmp_path / "a")), DeathFile(2024, str(tmp_path / "b"))]
    table = deaths.read_deaths(spark, files)
    assert rows(table, "data_year", "cause_recode113", "is_homicide", "marital_status") == [
        ("2014", "010", False, None), ("2014", "128", True, "S"), ("2024", "129", True, "S"),
    ]
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 2  # one for each layout
    lengths = deaths.record_lengths(spark, files)
    assert rows(lengths, "year", "record_length", "n") == [(2014, 490, 2), (2024, 817, 1)]
    assert lengths._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
