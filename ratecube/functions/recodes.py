"""Recodes of raw codes onto the demographic keys.

Each function takes the SQL text of a column and returns the SQL text of the
recoded value, for ``selectExpr`` and ``F.expr``. Code tables enter as literals,
so a recode stays in the scan stage: no join and no shuffle. An unlisted code
gives null.
"""

from __future__ import annotations

from ratecube.functions import codes


def literal(value: str | int | float | None) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def _literals(values: list) -> str:
    return ", ".join(literal(value) for value in values)


def is_in(code: str, values: list) -> str:
    return f"{code} IN ({_literals(values)})"


def pick(values: list, position: str) -> str:
    """Entry of a fixed list by position, counted from 0; null outside it."""
    return f"get(array({_literals(values)}), CAST({position} AS INT))"


def label_of(code: str, table: list[tuple]) -> str:
    """Look `code` up in a fixed (code, label) table; null when it is not there."""
    return f"map({_literals([cell for row in table for cell in row])})[{code}]"


def _case(branches: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {literal(value)}" for test, value in branches) + " END"


def label_of_number_range(number: str, ranges: list[tuple[int, int, str]]) -> str:
    return _case([(f"{number} BETWEEN {lo} AND {hi}", label) for lo, hi, label in ranges])


def label_of_code_range(code: str, ranges: list[tuple[str, str | None, str]]) -> str:
    """Ranges of zero-padded text codes. An open range compares as text, as the
    input coding does, so it also takes in codes such as "99"."""
    branches = []
    for lo, hi, label in ranges:
        if hi is None:
            test = f"{code} >= {literal(lo)}"
        else:
            test = is_in(code, [str(n).zfill(len(lo)) for n in range(int(lo), int(hi) + 1)])
        branches.append((test, label))
    return _case(branches)


def integer(code: str) -> str:
    """Text to integer; null when it is no number."""
    return f"try_cast({code} AS INT)"


# --- birthplace and nativity ---------------------------------------------------


def event_nativity(birth_code: str) -> str:
    return _case(
        [
            (is_in(birth_code, codes.STATES + codes.TERRITORIES), "native"),
            (is_in(birth_code, [code for code, _ in codes.FOREIGN_BIRTH_CODES]), "foreign"),
        ]
    )


def event_birthplace(birth_code: str) -> str:
    native = is_in(birth_code, codes.STATES + codes.TERRITORIES)
    abroad = [(f"{birth_code} = {literal(code)}", place) for code, place in codes.FOREIGN_BIRTH_CODES]
    return _case([(native, "native"), *abroad])


def survey_nativity(bpl: str) -> str:
    first, last = codes.NATIVE_BPL_RANGE
    native = f"({bpl} BETWEEN {first} AND {last} OR {is_in(bpl, codes.NATIVE_BPL_CODES)})"
    first, last = codes.FOREIGN_BPL_RANGE
    return _case([(native, "native"), (f"{bpl} BETWEEN {first} AND {last}", "foreign")])


def survey_birthplace(bpl: str) -> str:
    named = [(f"{bpl} = {code}", place) for code, place in codes.FOREIGN_BPL_CODES]
    first, last = codes.FOREIGN_BPL_RANGE
    return _case([*named, (f"{bpl} BETWEEN {first} AND {last}", "Rest of world")])


def state_from_fips(statefip: str) -> str:
    """State number to postal code: an array indexed by the number."""
    postal = dict(codes.STATE_FIPS)
    return pick([postal.get(n) for n in range(max(postal) + 1)], statefip)


# --- age, race, ethnicity, sex, marital status, cause ----------------------------


def age_band(years: str, bands: list[tuple] = codes.AGE_BANDS) -> str:
    """Code of the band that holds an age in whole years.

    The bands adjoin and the last one is open, so they unroll into one slot per
    year of age, and an age is looked up by position.
    """
    *closed, (last_code, last_start, *_) = bands
    slots = [code for code, lo, hi, *_ in closed for _ in range(lo, hi + 1)] + [last_code]
    # greatest and least skip nulls, so a null age needs its own test.
    position = f"greatest(least({years}, {last_start}), 0)"
    return f"CASE WHEN {years} IS NOT NULL THEN {pick(slots, position)} END"


def event_race5(code: str) -> str:
    return label_of_code_range(code, codes.RACE5_RANGES)


def event_race12(code: str) -> str:
    return label_of_code_range(code, codes.RACE12_RANGES)


def survey_race5(code: str) -> str:
    return label_of_number_range(code, codes.SURVEY_RACE_RANGES)


def event_ethnicity2(origin: str) -> str:
    return label_of_number_range(integer(origin), codes.ETHNICITY2_RANGES)


def event_ethnicity11(origin: str) -> str:
    return label_of_number_range(integer(origin), codes.ETHNICITY11_RANGES)


def survey_ethnicity2(hispan: str) -> str:
    return label_of_number_range(hispan, codes.SURVEY_ETHNICITY_RANGES)


def survey_sex(code: str) -> str:
    return label_of(code, codes.SURVEY_SEX)


def event_marital(code: str) -> str:
    return label_of(code, codes.MARITAL_LABELS)


def survey_marital(code: str) -> str:
    return label_of(code, codes.SURVEY_MARITAL)


def method(cause: str) -> str:
    """Method of a homicide; null for every other cause."""
    return _case(
        [
            (f"{cause} = {literal(codes.FIREARM_CAUSE)}", codes.METHOD_FIREARM),
            (is_in(cause, codes.HOMICIDE_CAUSES), codes.METHOD_OTHER),
        ]
    )


def cause_label(cause: str) -> str:
    before, after = codes.CAUSE_FALLBACK
    fallback = f"concat({literal(before)}, coalesce({cause}, 'NA'), {literal(after)})"
    return f"coalesce({label_of(cause, codes.CAUSE_LABELS)}, {fallback})"


def nativity_label(nativity: str) -> str:
    return label_of(nativity, codes.NATIVITY_LABELS)


def age_label(age_group: str) -> str:
    return label_of(age_group, codes.AGE_LABELS)


def sort_order(label: str, ordered: list[str]) -> str:
    """Position of `label` in a fixed order, 1 first: the place of an ordered factor."""
    return label_of(label, [(name, place) for place, name in enumerate(ordered, start=1)])


def category(*parts: str) -> str:
    """Composite label such as "White, Hispanic, Native-born"."""
    return f"concat_ws(', ', {', '.join(parts)})"
