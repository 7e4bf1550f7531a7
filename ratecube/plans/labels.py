"""Raw records and microdata to tables keyed by the shared demographic keys.

Labels are plain expressions next to each other; those a report does not group
by are pruned, and with them the input columns they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ratecube.functions import recodes
from ratecube.operators.cells import as_events, as_exposure


def _same(code: str) -> str:
    return code


def _of_integer(recode):
    return lambda code: recode(recodes.integer(code))


# key -> (raw column, recode)
EVENT_KEYS = {
    "data_year": ("data_year", recodes.integer),
    "state": ("state_res_fips", _same),
    "state_occ": ("state_occ_fips", _same),
    "nativity": ("state_country_birth_recode", recodes.event_nativity),
    "birthplace": ("state_country_birth_recode", recodes.event_birthplace),
    "age_group": ("age_recode12", _same),
    "age_type": ("detail_age_type", _same),
    "age_years": ("detail_age", recodes.integer),
    "sex": ("sex", _same),
    "race_code": ("race_recode40", _same),
    "race": ("race_recode40", recodes.event_race5),
    "race_detail": ("race_recode40", recodes.event_race12),
    "ethnicity": ("hispanic_origin", recodes.event_ethnicity2),
    "ethnicity_detail": ("hispanic_origin", recodes.event_ethnicity11),
    "marital": ("marital_status", recodes.event_marital),
    "education_flag": ("education_flag", _same),
    "cause": ("cause_recode113", _same),
    "method": ("cause_recode113", recodes.method),
}
PERSON_KEYS = {
    "data_year": ("year", recodes.integer),
    "state": ("statefip", _of_integer(recodes.state_from_fips)),
    "nativity": ("bpl", _of_integer(recodes.survey_nativity)),
    "birthplace": ("bpl", _of_integer(recodes.survey_birthplace)),
    "age_group": ("age", _of_integer(recodes.age_band)),
    "sex": ("sex", _of_integer(recodes.survey_sex)),
    "race": ("race", _of_integer(recodes.survey_race5)),
    "ethnicity": ("hispan", _of_integer(recodes.survey_ethnicity2)),
    "marital": ("marst", _of_integer(recodes.survey_marital)),
}


def _labelled(table: DataFrame, keys: dict, measure: str) -> DataFrame:
    present = set(table.columns)
    return table.selectExpr(
        *[f"{recode(raw)} AS {key}" for key, (raw, recode) in keys.items() if raw in present],
        measure,
    )


def label_events(records: DataFrame) -> DataFrame:
    return _labelled(as_events(records), EVENT_KEYS, "n")


def label_persons(persons: DataFrame) -> DataFrame:
    return _labelled(as_exposure(persons), PERSON_KEYS, "pop")
