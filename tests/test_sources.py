from pyspark.sql import functions as F
from samples import NEW, OLD, line

from ratecube.sources import deaths, fixed_width, layouts, persons, tables
from ratecube.sources.deaths import DeathFile


def write(path, lines, ending="\n"):
    path.write_bytes("".join(text + ending for text in lines).encode())
    return str(path)


def test_layouts_have_the_documented_size_and_do_not_overlap():
    assert (len(OLD), len(NEW)) == (37, 38)
    assert (layouts.record_length(OLD), layouts.record_length(NEW)) == (490, 817)
    for layout in (OLD, NEW):
        ordered = sorted(layout, key=lambda f: f.start)
        assert all(a.end < b.start for a, b in zip(ordered, ordered[1:]))


def test_layout_switches_after_2020():
    names = {year: {f.name for f in layouts.layout_for(year)} for year in (2020, 2021, 1999, 2030)}
    assert "race_recode5" in names[2020] and "race_recode6" not in names[2020]
    assert "race_recode6" in names[2021] and "race_recode5" not in names[2021]
    assert names[1999] == names[2020] and names[2030] == names[2021]


def test_parse_trims_and_turns_empty_and_na_into_null(spark, rows):
    lines = spark.createDataFrame(
        [
            (line(OLD, sex="M", detail_age=" 7 ", icd10_code="NA", race_recode40="01"),),
            (line(OLD, sex="F")[:69],),
        ],
        "value string",
    )
    parsed = fixed_width.parse_fixed_width(lines, OLD)
    assert rows(parsed, "sex", "detail_age", "icd10_code", "race_recode40") == [
        ("F", None, None, None),
        ("M", "7", None, "01"),
    ]


def test_packed_field_keeps_a_blank_first_slot(spark):
    lines = spark.createDataFrame([(line(OLD, record_axis_raw="     X954 "),)], "value string")
    assert fixed_width.parse_fixed_width(lines, OLD).first()["record_axis_raw"] == "     X954"


def test_homicides_of_both_layouts_and_missing_files(spark, tmp_path, rows):
    common = {"state_res_fips": "AL", "cause_recode113": "128"}
    old = write(
        tmp_path / "old.txt",
        [
            line(OLD, data_year="2014", race="02", race_recode5="2", **common),
            line(OLD, data_year="2014", state_res_fips="AL", cause_recode113="001"),
            line(OLD, data_year="2014", state_res_fips="PR", cause_recode113="129"),
        ],
    )
    new = write(
        tmp_path / "new.txt",
        [
            line(NEW, data_year="2021", race_recode6="3", industry_recode="07", **common),
            line(NEW, data_year="2021", state_res_fips="WY", cause_recode113="129"),
        ],
        ending="\r\n",
    )
    files = [DeathFile(2014, old), DeathFile(2019, None), DeathFile(2021, new)]
    found = deaths.read_homicides(spark, files)
    assert len(found.columns) == 32 + 5 + 6
    assert rows(found, "data_year", "state_res_fips", "race_recode5", "race_recode6", "industry_recode") == [
        ("2014", "AL", "2", None, None),
        ("2021", "AL", None, "3", "07"),
        ("2021", "WY", None, None, None),
    ]
    assert rows(deaths.rows_by_year(found)) == [("2014", 1), ("2021", 2)]
    every = deaths.read_all_deaths(spark, files)
    assert every.columns == layouts.ALL_CAUSE_FIELDS
    assert rows(deaths.rows_by_year(every)) == [("2014", 2), ("2021", 2)]


def test_unused_fields_are_pruned(spark):
    lines = spark.createDataFrame([(line(OLD, sex="M"),)], "value string")
    plan = (
        fixed_width.parse_fixed_width(lines, OLD)
        .select("sex")
        ._jdf.queryExecution()
        .optimizedPlan()
        .toString()
    )
    assert plan.count("substring") == 1


def test_record_lengths_see_every_line_and_missing_files(spark, tmp_path, rows):
    path = write(tmp_path / "a.txt", [line(OLD), line(OLD), line(OLD)[:100]])
    files = [DeathFile(2014, path), DeathFile(2019, None)]
    assert rows(deaths.record_lengths(spark, files), "year", "record_length", "n") == [
        (2014, 100, 1), (2014, 490, 2), (2019, None, 0),
    ]


def test_codebook_microdata_with_implied_decimals(spark, tmp_path):
    codebook = layouts.codebook_layout(
        [
            ("YEAR", 1, 4, "int", 0),
            ("PERWT", 5, 14, "double", 2),
            ("AGE", 15, 17, "int", 0),
            ("UNUSED", 18, 18, "string", 0),
        ]
    )
    path = write(tmp_path / "acs.dat", ["20240000012345030x", "2024          0x0 "])
    people = persons.read_persons(spark, [path], codebook)
    assert people.dtypes == [("year", "int"), ("perwt", "double"), ("age", "int")]
    assert [tuple(r) for r in people.collect()] == [(2024, 123.45, 30), (2024, None, None)]


def test_csv_keeps_codes_as_text_and_round_trips_nulls(spark, tmp_path, rows):
    table = spark.createDataFrame([("01", None, 2), ("02", 1.5, 1)], "code string, rate double, n long")
    path = str(tmp_path / "result")
    tables.write_result(table, path, ["n", "code"])
    (part,) = (tmp_path / "result").glob("part-*.csv")
    assert part.read_text().splitlines() == ["code,rate,n", "02,1.5,1", "01,NA,2"]
    again = tables.read_csv(spark, path, "code string, rate double, n long")
    assert rows(again) == rows(table)


def test_extract_is_partitioned_by_year(spark, tmp_path):
    records = spark.createDataFrame([("2014", "a"), ("2015", "b")], "data_year string, x string")
    path = str(tmp_path / "extract")
    tables.write_extract(records, path)
    one = spark.read.parquet(path).filter(F.col("data_year") == 2015)
    assert [r["x"] for r in one.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(data_year" in one._jdf.queryExecution().toString()


def test_cells_round_trip(spark, tmp_path, rows):
    cells = spark.createDataFrame([("a", 1, 2.5)], "k string, n long, pop double")
    tables.write_cells(cells, str(tmp_path / "cells"))
    assert rows(tables.read_cells(spark, str(tmp_path / "cells"))) == [("a", 1, 2.5)]
