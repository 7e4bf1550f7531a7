"""Small inputs: fixed-width lines, records and persons."""

from ratecube.sources.layouts import layout_for, record_length

OLD, NEW = layout_for(2014), layout_for(2024)


def line(layout, length=None, **values):
    """A record line with the given fields filled in."""
    text = [" "] * (length or record_length(layout))
    by_name = {field.name: field for field in layout}
    for name, value in values.items():
        field = by_name[name]
        width = field.end - field.start + 1
        text[field.start - 1 : field.end] = list(value.ljust(width)[:width])
    return "".join(text)


def death(**values):
    """A raw homicide record with sensible defaults."""
    record = {
        "data_year": "2024",
        "state_res_fips": "AL",
        "state_occ_fips": "AL",
        "state_country_birth_recode": "NY",
        "age_recode12": "05",
        "detail_age_type": "1",
        "detail_age": "030",
        "sex": "M",
        "race_recode40": "01",
        "hispanic_origin": "100",
        "marital_status": "S",
        "education_flag": "1",
        "cause_recode113": "128",
    }
    record.update(values)
    return record


def person(**values):
    record = {
        "year": 2024, "statefip": 1, "perwt": 10.0, "sex": 1, "age": 30,
        "marst": 6, "race": 1, "hispan": 0, "bpl": 1,
    }
    record.update(values)
    return record


DEATH_SCHEMA = ", ".join(f"{name} string" for name in death())
PERSON_SCHEMA = (
    "year int, statefip int, perwt double, sex int, age int, marst int, race int, hispan int, bpl int"
)


def deaths_table(spark, records):
    return spark.createDataFrame([tuple(r.values()) for r in records], DEATH_SCHEMA)


def persons_table(spark, records):
    return spark.createDataFrame([tuple(r.values()) for r in records], PERSON_SCHEMA)
