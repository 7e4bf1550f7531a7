import pytest

from ratecube.functions import codes, recodes


def recode(spark, function, values, kind):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in table.orderBy("i").selectExpr(function("v")).collect()]


def test_age_bands_at_both_ends(spark):
    ages = [0, 1, 4, 5, 14, 15, 24, 25, 34, 35, 44, 45, 54, 55, 64, 65, 74, 75, 84, 85, 120, -1, None]
    got = recode(spark, recodes.age_band, ages, "int")
    assert got == [
        "01", "02", "02", "03", "03", "04", "04", "05", "05", "06", "06", "07", "07",
        "08", "08", "09", "09", "10", "10", "11", "11", "01", None,
    ]


def test_five_year_bands_are_only_another_table(spark):
    bands = [(f"{i:02d}", 5 * i, 5 * i + 4) for i in range(17)] + [("17", 85, None)]
    got = recode(spark, lambda v: recodes.age_band(v, bands), [0, 4, 5, 84, 85, 99], "int")
    assert got == ["00", "00", "01", "16", "17", "17"]


def test_birthplace_of_records(spark):
    values = ["NY", "DC", "PR", "MP", "CC", "MX", "CU", "YY", "ZZ", "", None]
    assert recode(spark, recodes.event_nativity, values, "string") == (
        ["native"] * 4 + ["foreign"] * 4 + [None] * 3
    )
    assert recode(spark, recodes.event_birthplace, values, "string") == (
        ["native"] * 4 + ["Canada", "Mexico", "Cuba", "Rest of world"] + [None] * 3
    )


def test_birthplace_of_persons(spark):
    values = [0, 1, 56, 57, 90, 99, 100, 105, 110, 115, 120, 121, 149, 150, 200, 250, 251, 950, 951, None]
    assert recode(spark, recodes.survey_nativity, values, "int") == [
        None, "native", "native", None, *["native"] * 7, None, None, *["foreign"] * 5, None, None,
    ]
    assert recode(spark, recodes.survey_birthplace, values, "int") == [
        *[None] * 13, "Canada", "Mexico", "Cuba", "Rest of world", "Rest of world", None, None,
    ]


def test_state_numbers(spark):
    assert recode(spark, recodes.state_from_fips, [1, 2, 3, 11, 56, 57, 0, -1, 72, None], "int") == [
        "AL", "AK", None, "DC", "WY", None, None, None, None, None,
    ]
    assert len(codes.STATES) == 51


def test_race_codes_compare_as_text_above_fifteen(spark):
    values = ["01", "02", "03", "04", "14", "15", "40", "99", "1", "00", "", None]
    assert recode(spark, recodes.event_race5, values, "string") == [
        "White", "Black", "AIAN", "Asian or Pacific Islander", "Asian or Pacific Islander",
        "More than one race", "More than one race", "More than one race", None, None, None, None,
    ]
    detail = recode(spark, recodes.event_race12, ["04", "10", "11", "14", "15"], "string")
    assert detail == ["Asian Indian", "Other or Multiple Asian", "Pacific Islander", "Pacific Islander", "More than one race"]
    survey = recode(spark, recodes.survey_race5, [1, 3, 4, 6, 7, 8, 9, 10], "int")
    assert survey == ["White", "AIAN", "Asian or Pacific Islander", "Asian or Pacific Islander", None, "More than one race", "More than one race", None]


def test_ethnicity_ranges(spark):
    values = ["099", "100", "199", "200", "299", "300", "996", "999", "x", None]
    assert recode(spark, recodes.event_ethnicity2, values, "string") == [
        None, "Non-Hispanic", "Non-Hispanic", "Hispanic", "Hispanic", None, None, None, None, None,
    ]
    edges = ["209", "210", "219", "220", "230", "231", "249", "250", "260", "270", "274", "275", "280", "996"]
    assert recode(spark, recodes.event_ethnicity11, edges, "string") == [
        "Spaniard", "Mexican", "Mexican", "Central American", "Central American", "South American",
        "South American", "Latin American", "Puerto Rican", "Cuban", "Cuban", "Dominican",
        "Other Hispanic", "Unknown",
    ]
    assert recode(spark, recodes.survey_ethnicity2, [0, 1, 4, 5, 9], "int") == [
        "Non-Hispanic", "Hispanic", "Hispanic", None, None,
    ]


def test_sex_marital_method(spark):
    assert recode(spark, recodes.survey_sex, [1, 2, 9, None], "int") == ["M", "F", None, None]
    assert recode(spark, recodes.event_marital, ["S", "U", "Q", None], "string") == [
        "Never married, single", "Unknown", None, None,
    ]
    assert recode(spark, recodes.survey_marital, [1, 3, 4, 5, 6, 7], "int") == [
        "Married", "Married", "Divorced", "Widowed", "Never married, single", None,
    ]
    assert recode(spark, recodes.method, ["128", "129", "130", None], "string") == [
        "Firearm", "Other assault", None, None,
    ]


def test_cause_label_falls_back_to_the_code(spark):
    got = recode(spark, recodes.cause_label, ["128", "004", None], "string")
    assert got == [
        "Homicide by discharge of firearms",
        "Code 004 (not in lookup - check codebook)",
        "Code NA (not in lookup - check codebook)",
    ]
    assert len(codes.CAUSE_LABELS) == len(dict(codes.CAUSE_LABELS)) == 114


@pytest.mark.parametrize("value", ["it's", "back\\slash", "plain"])
def test_literals_survive_quoting(spark, value):
    assert spark.sql(f"SELECT {recodes.literal(value)}").first()[0] == value


def test_category_and_integer(spark):
    row = spark.sql(
        f"SELECT {recodes.category(recodes.literal('White'), recodes.literal('Hispanic'))}, "
        f"{recodes.integer(recodes.literal('x'))}, {recodes.integer(recodes.literal('007'))}"
    ).first()
    assert tuple(row) == ("White, Hispanic", None, 7)
