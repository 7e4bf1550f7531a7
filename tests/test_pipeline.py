"""From fixed-width files to result files."""

from collections import Counter

from samples import NEW, OLD, death, line, person, persons_table

from ratecube.plans import reports
from ratecube.plans.labels import label_events, label_persons
from ratecube.sources import deaths, tables
from ratecube.sources.deaths import DeathFile

DEATHS = [
    death(data_year="2020", state_country_birth_recode=birth, age_recode12=age, cause_recode113=cause, state_res_fips=state)
    for birth in ("NY", "MX", "ZZ")
    for age in ("04", "05", "12")
    for cause in ("128", "129", "010")
    for state in ("AL", "PR")
]


def files(tmp_path):
    (tmp_path / "2020.txt").write_text("".join(line(OLD, **d) + "\n" for d in DEATHS))
    later = [{**d, "data_year": "2024"} for d in DEATHS] * 2
    (tmp_path / "2024.txt").write_text("".join(line(NEW, **d) + "\n" for d in later))
    return [DeathFile(2020, str(tmp_path / "2020.txt")), DeathFile(2024, str(tmp_path / "2024.txt"))]


def test_scan_extract_rate_and_write(spark, tmp_path, rows):
    found = deaths.read_homicides(spark, files(tmp_path))
    assert rows(deaths.rows_by_year(found)) == [("2020", 18), ("2024", 36)]

    tables.write_extract(found, str(tmp_path / "extract"))
    events = label_events(spark.read.parquet(str(tmp_path / "extract")))
    people = persons_table(
        spark, [person(year=y, age=a, bpl=b, perwt=100.0) for y in (2020, 2024) for a in (20, 30) for b in (1, 200)]
    )
    adjusted = reports.adjusted_by_nativity(events, label_persons(people))
    want = 2 / 100 * 100_000 * (0.138646 + 0.135573)
    got = {(r["data_year"], r["nativity"]): r["age_adjusted_rate"] for r in adjusted.collect()}
    for (year, _), rate in got.items():
        assert abs(rate - want * (1 if year == 2020 else 2)) < 1e-6
    assert len(got) == 4

    tables.write_result(adjusted, str(tmp_path / "result"), ["data_year", "nativity"])
    again = tables.read_csv(
        spark,
        str(tmp_path / "result"),
        "data_year int, nativity string, n long, pop double, crude_rate double, age_adjusted_rate double",
    )
    assert rows(again) == rows(adjusted)


def test_records_survive_a_csv_under_a_text_schema(spark, tmp_path, rows):
    found = deaths.read_homicides(spark, files(tmp_path))
    tables.write_result(found, str(tmp_path / "csv"))
    again = tables.read_csv(spark, str(tmp_path / "csv"), tables.text_schema(found.columns))
    assert rows(again) == rows(found)
    assert rows(reports.events_by(label_events(again), ["data_year"])) == [(2020, 18), (2024, 36)]


def test_share_of_all_deaths_and_leading_causes(spark, tmp_path):
    every = label_events(deaths.read_all_deaths(spark, files(tmp_path)))
    share = {(r["data_year"], r["nativity"]): r for r in reports.homicide_share(every).collect()}
    assert share[2020, "native"]["total_deaths"] == 9
    assert share[2020, "native"]["homicide_deaths"] == 6
    leading = reports.top_causes(every, 1).collect()
    assert Counter(r["nativity"] for r in leading) == {"native": 3, "foreign": 3}
    assert {r["cause_label"] for r in leading} >= {"Septicemia", "Homicide by discharge of firearms"}
