import random

from samples import NEW, OLD, death, line, person, persons_table

from ratecube.functions import codes
from ratecube.plans import publish, reports
from ratecube.sources import deaths
from ratecube.sources.deaths import DeathFile


def test_every_table_is_written(spark, tmp_path):
    draw = random.Random(3)
    def one(year, **fixed):
        return death(
            data_year=str(year),
            state_res_fips=draw.choice(["AL", "AK", "AZ"]),
            state_country_birth_recode=draw.choice(["NY", "NY", "MX", "CC", "ZZ"]),
            age_recode12=draw.choice([code for code, _ in codes.AGE_LABELS]),
            sex=draw.choice("MF"),
            race_recode40=draw.choice(["01", "02", ""]),
            hispanic_origin=draw.choice(["100", "210"]),
            marital_status=draw.choice("SMWD"),
            cause_recode113=draw.choice(["128", "129", "010", "999"]),
            **fixed,
        )

    def written(name, layout, year):
        records = [one(year, record_axis_raw="X954 S061 ") for _ in range(400)]
        (tmp_path / name).write_text("".join(line(layout, **r) + "\n" for r in records))
        return DeathFile(year, str(tmp_path / name))

    files = [written("a", OLD, 2014), written("b", OLD, 2020), written("c", NEW, 2024)]
    people = persons_table(
        spark,
        [
            person(
                year=year, statefip=draw.choice([1, 2, 4]), age=draw.randrange(100), sex=draw.choice([1, 2]),
                marst=draw.randrange(1, 7), race=draw.choice([1, 2]), hispan=draw.choice([0, 1]),
                bpl=draw.choice([1, 1, 150, 200]),
            )
            for year in (2014, 2020, 2024)
            for _ in range(1500)
        ],
    )
    status = spark.createDataFrame(
        [("AL", "a", 10.0, 1), ("AL", "b", 30.0, 2)],
        "state_abb string, immig_status string, population double, n long",
    )
    out = str(tmp_path / "out")
    inputs = publish.study(
        deaths.read_deaths(spark, files), people, out, status=status, wanted_status="a",
    )
    names = publish.publish(inputs, out)
    assert names == [*publish.TABLES, *publish.STATUS_TABLES]
    for name in names:
        parts = list((tmp_path / "out" / "tables" / name).glob("part-*.csv"))
        assert parts and len(parts[0].read_text().splitlines()) > 1, name

    (part,) = (tmp_path / "out" / "tables" / "adjusted_by_nativity").glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == "data_year,nativity,n,pop,crude_rate,age_adjusted_rate"
    direct = reports.adjusted_by_nativity(inputs.records, inputs.persons).count()
    assert len(lines) == 1 + direct
    assert [x.split(",")[:2] for x in lines[1:3]] == [["2014", "foreign"], ["2014", "native"]]
