import random

import pytest
from pyspark.sql import functions as F
from samples import death, deaths_table, person, persons_table

from ratecube.functions import codes
from ratecube.plans import reports
from ratecube.plans.labels import label_events, label_persons


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(7)
    records = [
        death(
            data_year=year,
            state_res_fips=state,
            state_country_birth_recode=draw.choice(["NY", "NY", "CC", "MX", "CU", "YY", "ZZ"]),
            age_recode12=draw.choice([*[code for code, _ in codes.AGE_LABELS], "12"]),
            detail_age=f"{draw.randrange(100):03d}",
            sex=draw.choice("MF"),
            race_recode40=draw.choice([None, "01", "02", "03", "07", "15"]),
            hispanic_origin=str(draw.choice([100, 150, 210, 299, 999])),
            marital_status=draw.choice("SMWDU"),
            cause_recode113=draw.choice(["128", "129"]),
        )
        for year in ("2014", "2024")
        for state in ("AL", "WY")
        for _ in range(130)
    ]
    people = [
        person(
            year=year,
            statefip=fips,
            perwt=float(draw.randrange(50, 60)),
            sex=draw.choice([1, 2]),
            age=draw.choice([0, 2, 8, 20, 30, 40, 50, 60, 70, 80, 90, None]),
            marst=draw.randrange(1, 7),
            race=draw.randrange(1, 10),
            hispan=draw.choice([0, 2, 9]),
            bpl=draw.choice([1, 1, 56, 150, 200, 250, 500, 951]),
        )
        for year in (2014, 2024)
        for fips in (1, 56)
        for _ in range(1500)
    ]
    return label_events(deaths_table(spark, records)), label_persons(persons_table(spark, people))


def by(table, *keys):
    return {tuple(r[k] for k in keys): r for r in table.collect()}


def test_counts_add_up(tables):
    events, _ = tables
    years = by(reports.events_by(events, ["data_year"]), "data_year")
    groups = reports.events_by(events, ["data_year", "nativity"])
    summed = by(groups.groupBy("data_year").agg(F.sum("n").alias("n")), "data_year")
    assert {k: r["n"] for k, r in years.items()} == {k: r["n"] for k, r in summed.items()}
    states = reports.events_by(events, ["state"], 2024)
    assert sum(r["n"] for r in states.collect()) == years[(2024,)]["n"]


def test_foreign_total_is_the_sum_of_the_places(tables):
    events, persons = tables
    table = reports.crude_by_birthplace(events, persons).filter("data_year = 2024").collect()
    total = [r for r in table if r["birthplace"] == codes.FOREIGN_TOTAL]
    parts = [r for r in table if r["birthplace"] != codes.FOREIGN_TOTAL]
    assert len(total) == 1 and len(parts) == 4
    assert total[0]["n"] == sum(r["n"] for r in parts)
    assert total[0]["pop"] == sum(r["pop"] for r in parts)
    assert [r["birthplace"] for r in sorted(table, key=lambda r: r["sort_order"])][0] == codes.FOREIGN_TOTAL


def test_every_report_is_the_same_from_cubes(tables, rows):
    events, persons = tables
    event_cube, person_cube = reports.event_cube(events), reports.person_cube(persons)
    both = [
        reports.crude_by_nativity, reports.adjusted_by_nativity, reports.adjusted_by_birthplace,
        reports.pooled_by_state, reports.race_ethnicity_rates, reports.group_gap,
        lambda e, p: reports.state_rates(e, p, 2024),
        lambda e, p: reports.state_year_rates(e, p, [2014, 2024]),
        lambda e, p: reports.demographic_rates(e, p, 2024),
        lambda e, p: reports.marital_sex_rates(e, p, 2024),
        lambda e, p: reports.adjusted_by_state(e, p, "foreign", 2024),
        lambda e, p: reports.change_summary(e, p),
    ]
    def close(value):
        return round(value, 9) if isinstance(value, float) else value

    for report in both:
        want = [tuple(map(close, r)) for r in rows(report(events, persons))]
        got = [tuple(map(close, r)) for r in rows(report(event_cube, person_cube))]
        assert want and sorted(got, key=repr) == sorted(want, key=repr)


def test_anchors_agree_where_every_cell_has_population(tables):
    events, persons = tables
    a = by(reports.adjusted_by_nativity(events, persons, "events"), "data_year", "nativity")
    b = by(reports.adjusted_by_nativity(events, persons, "exposure"), "data_year", "nativity")
    for key, row in a.items():
        if row["age_adjusted_rate"] is not None:
            assert row["age_adjusted_rate"] == pytest.approx(b[key]["age_adjusted_rate"])


def test_adjusted_rate_scales_with_population(tables):
    events, persons = tables
    doubled = persons.withColumn("pop", F.col("pop") * 2)
    once = by(reports.adjusted_by_nativity(events, persons), "data_year", "nativity")
    twice = by(reports.adjusted_by_nativity(events, doubled), "data_year", "nativity")
    for key, row in once.items():
        if row["age_adjusted_rate"] is not None:
            assert row["age_adjusted_rate"] == pytest.approx(2 * twice[key]["age_adjusted_rate"])


def test_series_and_share(tables):
    _, persons = tables
    series = by(reports.population_series(persons), "data_year", "series")
    share = by(reports.foreign_share(persons, ["data_year"]), "data_year")
    for year in (2014, 2024):
        total, native, foreign = (series[year, s]["pop"] for s in (codes.TOTAL_SERIES, "Native-born", "Foreign-born"))
        assert total > native + foreign
        assert share[(year,)]["foreign_share"] == pytest.approx(foreign / total * 100)


def test_change_summary(tables):
    events, persons = tables
    table = by(reports.change_summary(events, persons), "metric")
    assert len(table) == 8
    assert table[("Total homicide count",)]["value_first"] == 260
    assert table[("Total homicide count",)]["pct_change"] == 0


def test_distributions_add_up_to_100(tables):
    events, _ = tables
    for table, group in [
        (reports.method_shares(events, ["race", "nativity"]), ["race", "nativity"]),
        (reports.marital_shares(events), ["nativity"]),
    ]:
        sums = table.groupBy(*group).agg(F.sum("pct").alias("total")).collect()
        assert sums and all(r["total"] == pytest.approx(100) for r in sums)


def test_composition_adds_up_to_its_group(tables):
    events, _ = tables
    for detail in ("race_detail", "ethnicity_detail"):
        parts = sum(r["n"] for r in reports.composition(events, detail).collect())
        assert parts == reports.foreign_events(events).count()


def test_wide_state_table(tables):
    events, persons = tables
    wide = by(reports.state_year_rates(events, persons, [2014, 2024]), "state", "data_year")
    assert len(wide) == 4
    crude = by(reports.crude_by_nativity(events, persons), "data_year", "nativity")
    assert wide["AL", 2024]["crude_rate_native"] == pytest.approx(crude[2024, "native"]["rate"], rel=0.2)


def test_status_share_and_comparison(spark, tables):
    events, persons = tables
    status = spark.createDataFrame(
        [("AL", "wanted", 10.0, 1), ("AL", "x", 20.0, 2), ("AL", "y", 70.0, 3),
         ("WY", "wanted", 5.0, 1), ("WY", "x", 15.0, 1), ("TX", "x", 9.0, 1)],
        "state_abb string, immig_status string, population double, n long",
    )
    share = by(reports.external_share(status, "wanted"), "state")
    assert {k[0]: r["status_share"] for k, r in share.items()} == {"AL": 10.0, "WY": 25.0}
    table = by(reports.native_rate_by_external_share(events, persons, status, "wanted", 2024), "state")
    assert table[("AL",)]["share_of_native"] == pytest.approx(10 / table[("AL",)]["pop"] * 100)
    pair = reports.compare_groups(events, persons, 2024)
    native = by(reports.adjusted_by_state(events, persons, "native", 2024), "state")
    for row in pair.collect():
        assert row["native_rate"] == pytest.approx(native[(row["state"],)]["age_adjusted_rate"])


def test_panel_of_every_state_and_year(tables):
    events, persons = tables
    table = by(reports.state_year_panel(events, persons, "crude_rate"), "state", "data_year")
    share = by(reports.foreign_share(persons, ["state", "data_year"]), "state", "data_year")
    assert len(table) == 4
    for key, row in table.items():
        assert row["foreign_share"] == pytest.approx(share[key]["foreign_share"])


def test_missing_codes(tables):
    events, _ = tables
    assert all(r["n"] > 0 for r in reports.null_codes_by_year(events).collect())
    assert {r["data_year"] for r in reports.flag_by_year(events).collect()} == {2014}
