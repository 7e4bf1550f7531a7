"""Codebooks, byte positions, audits, added years, bad lines, tables of labels, exact quantiles, long panels."""

import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import NEW, OLD, death, line, person, persons_table

from ratecube.functions import codes, recodes
from ratecube.operators import distribution, lookups, panel, quantiles
from ratecube.plans import publish, reports, round_trips
from ratecube.sources import codebook, deaths, fixed_width, layouts, persons, tables
from ratecube.sources.deaths import DeathFile

BOOK = """<?xml version="1.0" encoding="UTF-8"?>
<codeBook xmlns="ddi:codebook:2_5"><stdyDscr><citation/></stdyDscr><dataDscr>
<var ID="YEAR" name="YEAR" dcml="0"><location StartPos="1" EndPos="4" width="4"/><labl>Year</labl><varFormat type="numeric"/></var>
<var ID="PERWT" name="PERWT" dcml="2"><location StartPos="5" EndPos="14" width="10"/><labl>Weight</labl><varFormat type="numeric"/></var>
<var ID="SEX" name="SEX" dcml="0"><location StartPos="15" EndPos="15" width="1"/><labl>Sex</labl>
<catgry><catValu>1</catValu><labl>Male</labl></catgry><catgry><catValu>2</catValu><labl>Female &amp; more</labl></catgry><varFormat type="numeric"/></var>
<var ID="AGE" name="AGE"><location StartPos="16" EndPos="18"/><varFormat type="numeric"/></var>
<var ID="SERIAL" name="SERIAL" dcml="0"><location StartPos="19" EndPos="32"/><varFormat type="numeric"/></var>
<var ID="CODE" name="CODE"><location StartPos="33" EndPos="35"/><catgry><catValu>01A</catValu><labl>First</labl></catgry><varFormat type="character"/></var>
</dataDscr></codeBook>"""


@pytest.fixture
def survey(tmp_path):
    (tmp_path / "book.xml").write_text(BOOK)
    lines = ["2020     12345100700000000000001" + "01A", "2020    -100002   99999999999999   ", "20xx          1 20", ""]
    (tmp_path / "data.dat").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "book.xml"), str(tmp_path / "data.dat")


def test_codebook_gives_typed_persons_with_scaled_weights(spark, survey, rows):
    book, data = survey
    layout = codebook.read_codebook(spark, book)
    assert [(f.name, f.start, f.end, f.type, f.scale) for f in layout] == [
        ("year", 1, 4, "int", 0), ("perwt", 5, 14, "double", 2), ("sex", 15, 15, "int", 0),
        ("age", 16, 18, "int", 0), ("serial", 19, 32, "bigint", 0), ("code", 33, 35, "string", 0),
    ]
    table = persons.read_persons_by_codebook(spark, [data], book)
    assert table.columns == ["year", "serial", "perwt", "sex", "age"]  # "code" is not in use
    assert rows(table) == [
        (2020, 1, 123.45, 1, 7), (2020, 99999999999999, -100.0, 2, None), (None, None, None, 1, 20), (None, None, None, None, None),
    ]
    labels = codebook.value_labels(spark, book)
    named = codebook.labelled(fixed_width.scan_fixed_width(spark, [data], layout), labels, "sex")
    named = codebook.labelled(named, labels, "code", "meaning")
    assert rows(named, "sex", "sex_label", "meaning") == [(1, "Male", "First"), (1, "Male", None), (2, "Female & more", None), (None, None, None)]
    assert [f.name for f in codebook.read_codebook(spark, book, ["Sex", "YEAR"])] == ["sex", "year"]


def test_codebook_errors(spark, tmp_path, survey):
    with pytest.raises(ValueError, match="not in"):
        codebook.read_codebook(spark, survey[0], ["bpl"])
    (tmp_path / "empty.xml").write_text("<codeBook><dataDscr></dataDscr></codeBook>")
    with pytest.raises(ValueError, match="no variable"):
        codebook.read_codebook(spark, str(tmp_path / "empty.xml"))
    (tmp_path / "odd.xml").write_text('<codeBook><var ID="A" name="A"><location StartPos="5" EndPos="3"/></var></codeBook>')
    with pytest.raises(ValueError, match="without a place"):
        codebook.read_codebook(spark, str(tmp_path / "odd.xml"))


def test_codebook_round_trip(spark, tmp_path, rows):
    layout = [layouts.Field("a", 1, 3, type="int"), layouts.Field("w", 6, 12, type="double", scale=3), layouts.Field("t", 14, 16)]
    (tmp_path / "book.xml").write_text(codebook.codebook_xml(layout, {"t": {"x<": 'a "b" & c'}}))
    assert codebook.read_codebook(spark, str(tmp_path / "book.xml")) == layout
    assert rows(codebook.value_labels(spark, str(tmp_path / "book.xml"))) == [("t", "x<", 'a "b" & c')]
    table = spark.createDataFrame([(7, 1.5, "é"), (None, -0.125, None), (123, 1234.567, "x<")], "a int, w double, t string")
    back = fixed_width.parse_fixed_width(fixed_width.fixed_width_lines(table, layout), layout)
    assert rows(back) == rows(table)
    with pytest.raises(Exception, match="wider than its field"):
        fixed_width.fixed_width_lines(spark.createDataFrame([(1234, 1.0, "")], table.schema), layout).collect()


@pytest.mark.parametrize("charset", ["utf-8", "iso-8859-1"])
def test_positions_count_bytes(spark, tmp_path, charset, rows):
    """A two-byte character ahead of a field moves no field behind it."""
    plain = bytearray(line(NEW, data_year="2024", state_res_fips="AL", cause_recode113="128", sex="F", occupation_code="0101").encode())
    plain[0:5] = "né à"[: 4 if charset == "iso-8859-1" else 3].encode(charset).ljust(5)
    plain[149:153] = "çé".encode(charset).ljust(4)  # behind the cause code of four characters
    (tmp_path / "x").write_bytes(bytes(plain) + b"\n")
    files = [DeathFile(2024, str(tmp_path / "x"))]
    found = deaths.read_homicides(spark, files, charset=charset.upper())
    assert rows(found, "state_res_fips", "cause_recode113", "sex", "occupation_code", "data_year") == [("AL", "128", "F", "0101", "2024")]
    assert deaths.read_deaths(spark, files, charset=charset.upper()).count() == deaths.read_all_deaths(spark, files, charset=charset.upper()).count() == 1


def test_cut_characters_become_replacements(spark):
    lines = spark.createDataFrame([("aé",)], "value string")
    parsed = fixed_width.parse_fixed_width(lines, [layouts.Field("x", 1, 2), layouts.Field("y", 2, 3)], charset="UTF-8").first()
    assert (parsed.x, parsed.y) == ("a�", "é")


def test_years_without_a_layout(spark, tmp_path):
    with pytest.raises(ValueError, match="no layout for 2003"):
        deaths.read_homicides(spark, [DeathFile(2003, "x")])
    with pytest.raises(ValueError, match="no layout for 2030"):
        layouts.layout_for(2030, "raise")
    assert layouts.layout_for(2030, "nearest") == NEW and layouts.layout_for(1999) == OLD
    with pytest.raises(ValueError, match="unknown must be"):
        layouts.layout_for(2020, "any")
    (tmp_path / "x").write_text(line(NEW, data_year="2025", state_res_fips="AL", cause_recode113="129") + "\n")
    assert deaths.read_homicides(spark, [DeathFile(2025, str(tmp_path / "x"))], unknown="nearest").count() == 1


def files_of(tmp_path, years):
    out = []
    for year in years:
        layout = OLD if year <= 2020 else NEW
        records = [
            line(layout, **death(data_year=str(year), state_res_fips=s, cause_recode113=c, state_country_birth_recode=b, age_recode12=a))
            for s in ("AL", "AK", "PR") for c in ("128", "129", "010") for b in ("NY", "MX") for a in ("04", "05", "12")
        ] * (1 + year % 3)
        (tmp_path / str(year)).write_text("\n".join(records) + "\n")
        out.append(DeathFile(year, str(tmp_path / str(year))))
    return out


def test_audit_comes_off_the_scan_that_writes(spark, tmp_path, rows):
    files = [*files_of(tmp_path, (2019, 2020, 2021)), DeathFile(2022, None)]
    audit = deaths.write_audited_homicides(spark, files, str(tmp_path / "out"))
    found = deaths.read_homicides(spark, files)
    assert rows(audit) == [(2019, 54 + 108, 18 + 36, 12 + 24, 24 + 48), (2021, 162, 54, 36, 72)]
    back = tables.read_extract(spark, str(tmp_path / "out"))
    assert rows(deaths.rows_by_year(back)) == rows(deaths.rows_by_year(found)) == [("2019", 24), ("2020", 48), ("2021", 72)]
    part, _ = deaths.observed_homicides(fixed_width.read_lines(spark, [files[0].path]), OLD, "one")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and "CollectMetrics" in plan


def held(path):
    return {str(p): (p.stat().st_size, p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet")}


def test_an_added_year_leaves_the_others_alone(spark, tmp_path, rows):
    early, late = files_of(tmp_path, (2019, 2020)), files_of(tmp_path, (2024,))
    def people(years):
        return persons_table(spark, [person(year=y, age=a, bpl=b, perwt=100.0) for y in years for a in (20, 30, 40) for b in (1, 200)])

    out = str(tmp_path / "study")
    publish.study(deaths.read_deaths(spark, early), people((2019, 2020)), out)
    before = held(out)
    for _ in range(2):  # a year may be added again
        both = publish.study(deaths.read_deaths(spark, late), people((2024,)), out, add=True)
    after = held(out)
    assert {k: v for k, v in after.items() if "data_year=2024" not in k} == before
    once = publish.study(deaths.read_deaths(spark, early + late), people((2019, 2020, 2024)), str(tmp_path / "whole"))
    for name in ("homicides", "events", "persons", "deaths"):
        mine, theirs = getattr(both, name), getattr(once, name)
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows(mine, *sorted(theirs.columns)) == rows(theirs, *sorted(theirs.columns))
    assert rows(reports.adjusted_by_nativity(both.events, both.persons)) == rows(reports.adjusted_by_nativity(once.events, once.persons))


def test_publish_stores_only_what_its_tables_take(spark, tmp_path):
    inputs = publish.study(deaths.read_deaths(spark, files_of(tmp_path, (2020,))), persons_table(spark, [person(year=2020)]), str(tmp_path / "o"))
    assert publish.publish(inputs, str(tmp_path / "o"), ["events_by_year"]) == ["events_by_year"]
    assert not os.path.exists(tmp_path / "o" / "cells" / "panel") and inputs.panel is None


def test_csv_extract_with_added_year(spark, tmp_path, rows):
    table = spark.createDataFrame([("2020", "AL", None), ("2021", "AK", "x,y")], "data_year string, a string, b string")
    path = str(tmp_path / "csv")
    tables.write_extract(table, path, "csv")
    tables.write_extract(table.filter("data_year = '2021'").withColumn("b", F.lit("new")), path, "csv", add=True)
    assert rows(tables.read_extract(spark, path, "a string, b string", "csv"), "data_year", "a", "b") == [("2020", "AL", None), ("2021", "AK", "new")]


def test_bad_lines_are_kept_aside(spark, tmp_path, rows):
    good = [f"AL,low,{i}.5,{i}" for i in range(50)] + ["AK,NA,1,2"]
    bad = ["AL,low", "AL,low,1.0,2,3", "AL,low,many,4"]
    (tmp_path / "t.csv").write_text("\n".join(["state_abb,immig_status,population,n", *good[:20], bad[0], *good[20:40], *bad[1:], *good[40:]]) + "\n")
    table, aside = tables.read_csv_checked(spark, str(tmp_path / "t.csv"), tables.STATUS_SCHEMA)
    assert table.count() == 51 and table.columns == ["state_abb", "immig_status", "population", "n"]
    assert table.filter("immig_status IS NULL").count() == 1
    assert [r.bad_line for r in aside.orderBy("bad_line").collect()] == sorted(bad)
    assert table.select("n").count() == 51 and aside.filter(F.col("path").endswith("t.csv")).count() == 3


def test_ranges_from_a_table_equal_the_literal_bands(spark, rows):
    bands = [(low, high, label) for label, low, high, *_ in codes.AGE_BANDS]
    table = spark.createDataFrame([(low, 999 if high is None else high, label) for low, high, label in bands], "low int, high int, band string")
    ages = spark.range(0, 130).select(F.col("id").cast("int").alias("age")).unionByName(spark.createDataFrame([(None,), (-3,)], "age int"))
    literal = ages.select("age", F.expr(recodes.age_band("age")).alias("band")).filter("age >= 0")
    for most in (lookups.MOST_BOUNDS, 3):
        found = lookups.label_by_range(ages, "age", table, "low", "high", "band", most)
        assert rows(found.filter("age >= 0"), "age", "band") == rows(literal)
        assert rows(found.filter("age IS NULL OR age < 0"), "age", "band") == [(-3, None), (None, None)]


def test_many_ranges_without_a_cross_join(spark):
    ranges = spark.range(100_000).selectExpr("id * 10 AS low", "id * 10 + 6 AS high", "concat('r', id) AS name")
    values = spark.range(0, 1_000_000, 7).withColumnRenamed("id", "v")
    want = values.withColumn("name", F.expr("CASE WHEN v % 10 <= 6 THEN concat('r', v div 10) END"))
    for most in (lookups.MOST_BOUNDS, 10):
        found = lookups.label_by_range(values, "v", ranges, "low", "high", "name", most)
        assert found.exceptAll(want).isEmpty() and found.count() == want.count()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_labels_by_code(spark, rows):
    table = spark.createDataFrame([("a",), ("b",), (None,)], "code string")
    labels = spark.createDataFrame([("a", 1), (None, 2)], "k string, name int")
    assert rows(lookups.label_by_code(table, "code", labels, "k", "name")) == [("a", 1), ("b", None), (None, None)]
    with pytest.raises(Exception, match="not unique: a"):
        lookups.label_by_code(table, "code", labels.union(labels), "k", "name").collect()
    with pytest.raises(ValueError, match="overlap"):
        lookups.label_by_range(table, "code", spark.createDataFrame([(1, 5, "x"), (5, 6, "y")], "a int, b int, c string"), "a", "b", "c")


def test_exact_quantiles(spark, monkeypatch, rows):
    monkeypatch.setattr(quantiles, "LEFT", 20)
    monkeypatch.setattr(quantiles, "BINS", 16)
    draw = random.Random(2)
    data = [(g, float(v), draw.randint(0, 3)) for g in ("a", None) for v in [draw.gauss(0, 1) * 10 ** draw.randint(-200, 200) for _ in range(700)] + [5.0] * 300]
    data += [("one", -1.5, 1), ("none", None, 2), ("wide", -1.7e308, 1), ("wide", 1.7e308, 1)]
    table = spark.createDataFrame(data, "g string, v double, w int")
    for share in (0.0, 0.25, 0.5, 1.0):
        want = {}
        for g in ("a", None, "one"):
            for name, values in (("plain", [v for k, v, _ in data if k == g]), ("weighted", [v for k, v, w in data if k == g for _ in range(w)])):
                values.sort()
                at = share * (len(values) - 1)
                low = values[int(at)]
                want[g, name] = (low + (values[min(int(at) + 1, len(values) - 1)] - low) * (at - int(at)), len(values))
        for name, weight in (("plain", None), ("weighted", "w")):
            got = {r.g: (r["quantile"], r.n) for r in quantiles.exact_quantile(table, ["g"], "v", share, weight).collect()}
            assert got.keys() == {"a", None, "one", "wide"}
            for g in ("a", None, "one"):
                assert got[g] == (pytest.approx(want[g, name][0], rel=1e-12), want[g, name][1])


def test_panel_of_many_periods(spark):
    """No row holds anything by pairs of periods; residuals are free of unit and period means, which makes them least squares."""
    rng = np.random.default_rng(4)
    units, times = 50, 4000
    u, t = (a.ravel() for a in np.meshgrid(np.arange(units), np.arange(times), indexing="ij"))
    keep = rng.random(len(u)) < 0.6
    u, t = u[keep], t[keep]
    x = rng.normal(size=len(u)) + 0.01 * t + u
    y = -0.45 * x + np.sin(t) * 3 + 2.0 * u + rng.normal(size=len(u))
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"u": u, "t": t, "y": y, "x": x}))
    clean = panel.two_way_residuals(table, "u", "t", "y", "x").toPandas()
    for key in ("u", "t"):
        assert clean.groupby(key)[["resid_y", "resid_x"]].mean().abs().max().max() < 1e-9
    # What was taken off is a unit effect plus a period effect.
    off = (clean.x - clean.resid_x).to_numpy()
    wide = pd.Series(off, index=pd.MultiIndex.from_arrays([clean.u, clean.t])).unstack()
    gaps = wide.sub(wide.iloc[0], axis=1)
    assert (gaps.max(axis=1) - gaps.min(axis=1)).max() < 1e-8
    fit = panel.two_way_fit(table, "u", "t", "y", "x", "cluster").first()
    assert fit.estimate == pytest.approx(float((clean.resid_x * clean.resid_y).sum() / (clean.resid_x**2).sum()), rel=1e-9)
    assert abs(fit.estimate + 0.45) < 0.01 and (fit.n_obs, fit.n_units) == (len(u), units)


def test_panel_solver_gives_up_loudly(spark, monkeypatch):
    monkeypatch.setattr(panel, "MOST_STEPS", 1)
    rows = [(i, t, float(i * t % 7), float((i + t) % 5)) for i in range(40) for t in (i, i + 1)]  # a chain of periods
    with pytest.raises(ArithmeticError, match="not found in 1 steps"):
        panel.two_way_residuals(spark.createDataFrame(rows, "u int, t int, y double, x double"), "u", "t", "y", "x")


def test_reports_off_bucketed_cells_shuffle_nothing(spark, rows):
    table = round_trips.rates_off_buckets(spark, "/root/testdata/sf0.001")
    assert table.count() > 0
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_binned_density_is_near_the_direct_sum(spark):
    draw = random.Random(1)
    data = [(g, draw.gauss(m, 10), draw.randint(1, 4)) for g, m in (("a", 0), ("b", 60)) for _ in range(3000)] + [("one", 20.0, 3)]
    counts = spark.createDataFrame(data, "g string, v double, n long")
    direct = {(r.g, round(r.x, 6)): r.density for r in distribution.density(counts, ["g"], "v").collect()}
    binned = {(r.g, round(r.x, 6)): r.density for r in distribution.binned_density(counts, ["g"], "v").collect()}
    assert direct.keys() == binned.keys() and len(direct) == 3 * 512
    most = max(d for (g, _), d in direct.items() if g != "one")
    assert max(abs(direct[k] - binned[k]) for k in direct if k[0] != "one") < 1e-3 * most


def test_lines_of_two_layouts_in_one_table(spark, rows):
    old = line(OLD, data_year="2020", state_res_fips="AL", cause_recode113="128", race="02", race_recode5="2", hispanic_origin="210")
    new = line(NEW, data_year="2024", state_res_fips="AK", cause_recode113="129", race_recode6="6", industry_code="0012", hispanic_origin="100")
    lines = spark.createDataFrame([(old, True), (new, False), (old[:60], True)], "value string, is_old boolean")
    apart = fixed_width.union_by_name([fixed_width.parse_fixed_width(lines.filter(test), layout) for test, layout in (("is_old", OLD), ("NOT is_old", NEW))])
    both = fixed_width.parse_either(lines, "is_old", (OLD, NEW))
    assert rows(both, *sorted(both.columns)) == rows(apart, *sorted(apart.columns))
    found = deaths.records_of_either(lines, "is_old", (OLD, NEW), homicides=True)
    assert rows(found, "data_year", "race_recode5", "race_recode6") == [("2020", "2", None), ("2024", None, "6")]
