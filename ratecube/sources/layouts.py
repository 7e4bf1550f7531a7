"""Record layouts: which characters of a line hold which field, and in which years."""

from __future__ import annotations

from typing import NamedTuple


class Field(NamedTuple):
    """One slice of a line. Positions count from 1 and include both ends."""

    name: str
    start: int
    end: int
    # A packed field is a run of fixed slots: leading blanks are part of it.
    packed: bool = False
    # Codebook fields may be numeric, with `scale` implied decimal places.
    type: str = "string"
    scale: int = 0


# Years and positions of the death record.
ALL_YEARS = (2014, 2024)
BRIDGED_RACE_YEARS = (2014, 2020)
SINGLE_RACE_YEARS = (2021, 2024)
DEATH_RECORD = [
    # years, name, start, end
    (ALL_YEARS, "record_type", 19, 19),
    (ALL_YEARS, "resident_status", 20, 20),
    (ALL_YEARS, "state_occ_fips", 21, 22),
    (ALL_YEARS, "state_res_fips", 29, 30),
    (ALL_YEARS, "state_birth_fips", 55, 56),
    (ALL_YEARS, "state_country_birth_recode", 59, 60),
    (ALL_YEARS, "education_2003", 63, 63),
    (ALL_YEARS, "education_flag", 64, 64),
    (ALL_YEARS, "month_of_death", 65, 66),
    (ALL_YEARS, "sex", 69, 69),
    (ALL_YEARS, "detail_age_type", 70, 70),
    (ALL_YEARS, "detail_age", 71, 73),
    (ALL_YEARS, "age_recode52", 75, 76),
    (ALL_YEARS, "age_recode27", 77, 78),
    (ALL_YEARS, "age_recode12", 79, 80),
    (ALL_YEARS, "place_of_death", 83, 83),
    (ALL_YEARS, "marital_status", 84, 84),
    (ALL_YEARS, "day_of_week_death", 85, 85),
    (ALL_YEARS, "data_year", 102, 105),
    (ALL_YEARS, "injury_at_work", 106, 106),
    (ALL_YEARS, "manner_of_death", 107, 107),
    (ALL_YEARS, "activity_code", 144, 144),
    (ALL_YEARS, "place_of_injury", 145, 145),
    (ALL_YEARS, "icd10_code", 146, 149),
    (ALL_YEARS, "cause_recode113", 154, 156),
    (ALL_YEARS, "n_entity_axis", 163, 164),
    (ALL_YEARS, "entity_axis_raw", 165, 304),
    (ALL_YEARS, "n_record_axis", 341, 342),
    (ALL_YEARS, "record_axis_raw", 344, 443),
    (BRIDGED_RACE_YEARS, "race", 445, 446),
    (BRIDGED_RACE_YEARS, "bridged_race_flag", 447, 447),
    (ALL_YEARS, "race_imputation_flag", 448, 448),
    (BRIDGED_RACE_YEARS, "race_recode3", 449, 449),
    (BRIDGED_RACE_YEARS, "race_recode5", 450, 450),
    (SINGLE_RACE_YEARS, "race_recode6", 450, 450),
    (ALL_YEARS, "hispanic_origin", 484, 486),
    (SINGLE_RACE_YEARS, "hispanic_origin_race_recode", 487, 488),
    (BRIDGED_RACE_YEARS, "hispanic_origin_race_recode_bridged", 488, 488),
    (ALL_YEARS, "race_recode40", 489, 490),
    (SINGLE_RACE_YEARS, "occupation_code", 806, 809),
    (SINGLE_RACE_YEARS, "occupation_recode", 810, 811),
    (SINGLE_RACE_YEARS, "industry_code", 812, 815),
    (SINGLE_RACE_YEARS, "industry_recode", 816, 817),
]
PACKED_FIELDS = {"entity_axis_raw", "record_axis_raw"}
ALL_CAUSE_FIELDS = ["state_res_fips", "state_country_birth_recode", "data_year", "cause_recode113"]
# Survey columns kept from the codebook file.
PERSON_FIELDS = [
    "year", "serial", "hhwt", "statefip", "gq", "pernum", "perwt", "sex", "age",
    "marst", "race", "raced", "hispan", "hispand", "bpl", "bpld", "citizen", "occ2010",
]


def layout_for(year: int, unknown: str = "nearest") -> list[Field]:
    """Layout of the death record in one data year.

    For a year without a known layout, `unknown` is "nearest" (the first layout serves the
    years before it, and the last those after) or "raise". Readers of files raise.
    """
    first, last = ALL_YEARS
    if unknown not in ("raise", "nearest"):
        raise ValueError(f"unknown must be 'raise' or 'nearest', not {unknown!r}")
    if unknown == "raise" and not first <= year <= last:
        raise ValueError(f"no layout for {year}; known are {first} to {last}")
    known = min(max(year, first), last)
    return [
        Field(name, start, end, packed=name in PACKED_FIELDS)
        for (start_year, end_year), name, start, end in DEATH_RECORD
        if start_year <= known <= end_year
    ]


def narrow(layout: list[Field], names: list[str]) -> list[Field]:
    """The fields of `layout` called `names`, in the order of `names`."""
    by_name = {field.name: field for field in layout}
    return [by_name[name] for name in names]


def codebook_layout(rows: list[tuple[str, int, int, str, int]]) -> list[Field]:
    """Layout from codebook rows (name, start, end, Spark type, implied decimals)."""
    return [
        Field(name.lower(), start, end, type=kind, scale=scale)
        for name, start, end, kind, scale in rows
    ]


def record_length(layout: list[Field]) -> int:
    """Shortest line that holds every field."""
    return max(field.end for field in layout)
