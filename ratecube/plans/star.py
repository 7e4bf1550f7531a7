"""Binding of the star-schema tables to the two record types.

Order lines stand for death records and orders for survey persons; both take
their demographic codes from the order and its customer. The columns come out
as raw codes, as they stand in the input files, so that the recodes run too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecube.functions import codes
from ratecube.functions.recodes import age_band, is_in, literal, pick
from ratecube.session import compiled_stages
from ratecube.sources.layouts import BRIDGED_RACE_YEARS, Field

# Column types of the tables in use; without them Spark would start a job per
# table to read a footer.
SCHEMAS = {
    "customer": "c_custkey long, c_nationkey int",
    "supplier": "s_suppkey long, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_returnflag string, l_linestatus string",
    "documents": "doc_id long, text string, lang string",
}
# Order years 1995-2001 become data years 2018-2024, on both sides of the layout change.
YEAR_SHIFT = 23
DATA_YEAR = f"year(o_orderdate) + {YEAR_SHIFT}"
FIRST_YEAR, LAST_YEAR = 2018, 2024
# Nation 0-23 -> the first 24 states; nation 24 -> a territory.
STATE_OF_NATION = [*codes.STATES[:24], "PR"]
FIPS_OF_NATION = [*[number for number, _ in codes.STATE_FIPS[:24]], 72]
# Customer number modulo 20 -> birthplace, as a record code and as a survey code.
BIRTH_CODES = [
    "NY", "CA", "TX", "FL", "OH", "PA", "IL", "GA", "WA", "AL",
    "PR", "DC", "CC", "MX", "CU", "YY", "YY", "YY", "ZZ", None,
]
BIRTH_BPL = [36, 6, 48, 12, 39, 42, 17, 13, 53, 1, 110, 11, 150, 200, 250, 300, 500, 950, 960, 0]
BIRTH = "o_custkey % 20"
# Customer number / 20 modulo 18 -> race, likewise.
RACE_CODES = [
    None, "01", "02", "03", "04", "05", "06", "07", "08",
    "09", "10", "11", "12", "13", "14", "15", "21", "99",
]
RACE_NUMBERS = [7, 1, 2, 3, 4, 4, 5, 5, 6, 6, 4, 5, 6, 6, 4, 8, 9, 9]
RACE = "o_custkey div 20 % 18"
# First digit of the order priority -> marital status, likewise.
MARITAL_CODES = ["S", "M", "W", "D", "U"]
MARITAL_NUMBERS = [6, 1, 5, 4, 7]
PRIORITY = "CAST(left(o_orderpriority, 1) AS INT)"
# First age of each band, picked by order and customer number.
BAND_STARTS = [lo for _, lo, *_ in codes.AGE_BANDS]
BAND = "(o_orderkey + o_custkey) % 11"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None) -> DataFrame:
    """Orders of all years, or of the data years from first to last.

    The years become a range of order dates, which the Parquet scan can skip by;
    a test on the computed data year alone could not be pushed down.
    """
    orders = table(spark, sf_dir, "orders")
    if not years:
        return orders
    first, last = (year - YEAR_SHIFT for year in years)
    return orders.filter(
        f"o_orderdate >= TIMESTAMP_NTZ '{first}-01-01' "
        f"AND o_orderdate < TIMESTAMP_NTZ '{last + 1}-01-01'"
    )


def death_records(
    spark: SparkSession,
    sf_dir: str,
    homicides_only: bool = True,
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Death records of state residents; all causes, or the homicides among them.

    Returned lines stand for homicides. The flag is tested on the line table
    itself, so it reaches the Parquet scan. Orders meet customers first, which
    keeps the larger line table out of the second shuffle when none is broadcast.
    """
    lines = table(spark, sf_dir, "lineitem")
    if homicides_only:
        lines = lines.filter("l_returnflag = 'R'")
    customers = table(spark, sf_dir, "customer")
    people = _orders(spark, sf_dir, years).join(customers, F.expr("o_custkey = c_custkey"))
    joined = lines.join(people, F.expr("l_orderkey = o_orderkey"))
    no_age = "l_linenumber = 7"
    age = "CAST((l_quantity - 1) * 2 AS INT)"
    records = joined.selectExpr(
        "l_orderkey",
        "l_linenumber",
        f"CAST({DATA_YEAR} AS STRING) AS data_year",
        f"{pick(STATE_OF_NATION, 'c_nationkey')} AS state_res_fips",
        f"{pick(STATE_OF_NATION, 'l_suppkey % 25')} AS state_occ_fips",
        f"{pick(BIRTH_CODES, BIRTH)} AS state_country_birth_recode",
        f"CASE WHEN {no_age} THEN '9' ELSE '1' END AS detail_age_type",
        f"CASE WHEN {no_age} THEN '999' ELSE lpad(CAST({age} AS STRING), 3, '0') END AS detail_age",
        f"CASE WHEN {no_age} THEN {literal(codes.AGE_UNKNOWN)} ELSE {age_band(age)} END AS age_recode12",
        "CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS sex",
        f"{pick(RACE_CODES, RACE)} AS race_recode40",
        "CAST(100 + o_orderkey % 300 AS STRING) AS hispanic_origin",
        f"{pick(MARITAL_CODES, PRIORITY + ' - 1')} AS marital_status",
        f"{pick(['0', '1', None], 'o_orderkey % 3')} AS education_flag",
        "CASE WHEN l_returnflag = 'R' THEN CASE l_linestatus WHEN 'F' THEN '128' ELSE '129' END "
        "ELSE lpad(CAST(1 + l_partkey % 127 AS STRING), 3, '0') END AS cause_recode113",
    )
    return records.filter(is_in("state_res_fips", codes.STATES))


def persons(
    spark: SparkSession,
    sf_dir: str,
    years: tuple[int, int] | None = None,
    with_state: bool = True,
) -> DataFrame:
    """Survey persons with their weight.

    Only the state needs the customer; a person without one has no state, but
    counts in the nation. Without the state the orders are read alone, and
    neither they nor the customers are shuffled.
    """
    orders, state = _orders(spark, sf_dir, years), []
    if with_state:
        customers = table(spark, sf_dir, "customer")
        orders = orders.join(customers, F.expr("o_custkey = c_custkey"), "left")
        state = [f"{pick(FIPS_OF_NATION, 'c_nationkey')} AS statefip"]
    return orders.selectExpr(
        f"{DATA_YEAR} AS year",
        *state,
        "CAST(1 + o_orderkey % 200 AS DOUBLE) AS perwt",
        "CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 9 END AS sex",
        f"CASE WHEN o_orderkey % 97 <> 0 THEN {pick(BAND_STARTS, BAND)} "
        f"+ CASE WHEN {BAND} = 0 THEN 0 ELSE CAST(o_orderkey % 4 AS INT) END END AS age",
        f"CASE WHEN {PRIORITY} = 2 THEN 1 + CAST(o_orderkey % 3 AS INT) "
        f"ELSE {pick(MARITAL_NUMBERS, PRIORITY + ' - 1')} END AS marst",
        f"{pick(RACE_NUMBERS, RACE)} AS race",
        "CASE WHEN o_orderkey % 300 < 100 THEN 0 "
        "WHEN o_orderkey % 300 < 200 THEN 1 + CAST(o_orderkey % 4 AS INT) ELSE 9 END AS hispan",
        f"{pick(BIRTH_BPL, BIRTH)} AS bpl",
    )


def status_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a table of state population by status."""
    return (
        table(spark, sf_dir, "supplier")
        .selectExpr(
            f"{pick(STATE_OF_NATION, 's_nationkey')} AS state_abb",
            "CASE WHEN s_acctbal < 2500 THEN 'low' ELSE 'other' END AS immig_status",
            "abs(s_acctbal) AS population",
        )
        .groupBy("state_abb", "immig_status")
        .agg(F.sum("population").alias("population"), F.count(F.lit(1)).alias("n"))
    )


def _digits(field: Field) -> int:
    return min(9, field.end - field.start + 1)


def filler(field: Field) -> str:
    """SQL text of the value of a field that stands for nothing: digits of the line's keys."""
    digits = _digits(field)
    number = f"(l_orderkey * {field.start} + l_linenumber) % {10**digits}"
    return f"lpad(CAST({number} AS STRING), {digits}, '0')"


def _line(filled: set[str], layout: list[Field], fillers: set[str] = frozenset()) -> str:
    """A record line: each filled field at its position, blanks elsewhere.

    A filler is null or as long as its digits, so only its nulls are padded.
    """
    parts, at = [], 1
    for field in sorted(layout, key=lambda f: f.start):
        if field.name not in filled:
            continue
        width = field.end - field.start + 1
        parts.append(literal(" " * (field.start - at)))
        at = field.end + 1
        if field.name in fillers:
            parts.append(f"coalesce({field.name}, {literal(' ' * _digits(field))})")
            at -= width - _digits(field)  # blanks of the field go with those behind it
        else:
            parts.append(f"rpad(coalesce({field.name}, ''), {width}, ' ')")
    parts.append(literal(" " * (max(f.end for f in layout) + 1 - at)))
    return f"concat({', '.join(part for part in parts if part != literal(''))})"


def record_lines(
    spark: SparkSession, sf_dir: str, old_layout: list[Field], new_layout: list[Field]
) -> tuple[DataFrame, DataFrame]:
    """All-cause death records as fixed-width lines, every field filled: those of the
    years of the old layout, and those of the new.

    Either part reads the orders of its own years. A line passes through a
    one-element explode so that it is built once per record: as a plain expression
    it would be built anew in every test on it. It is built in a projection before,
    whose code is compiled in parts.
    """
    compiled_stages(spark)

    def written(years: tuple[int, int], layout: list[Field]) -> DataFrame:
        records = death_records(spark, sf_dir, homicides_only=False, years=years)
        others = [f"{filler(f)} AS {f.name}" for f in layout if f.name not in records.columns]
        filled = {f.name for f in layout}
        line = _line(filled, layout, filled - set(records.columns))
        built = records.selectExpr("*", *others).selectExpr("l_orderkey", "l_linenumber", f"{line} AS value")
        return built.selectExpr("l_orderkey", "l_linenumber", "explode(array(value)) AS value")

    last_old = BRIDGED_RACE_YEARS[1]
    return written((FIRST_YEAR, last_old), old_layout), written((last_old + 1, LAST_YEAR), new_layout)


OLD_LINE = "old_line"


def lines_of_either(spark: SparkSession, sf_dir: str, old_layout: list[Field], new_layout: list[Field]) -> DataFrame:
    """The lines of `record_lines` as one table off one scan, with `old_line` for those of the old layout."""
    compiled_stages(spark)
    records = death_records(spark, sf_dir, homicides_only=False, years=(FIRST_YEAR, LAST_YEAR))
    layouts = old_layout, new_layout
    others = {f.name: filler(f) for layout in layouts for f in layout if f.name not in records.columns}
    # A field of one name may be filled anew where its place differs.
    apart = [name for name in others if len({(f.start, f.end) for layout in layouts for f in layout if f.name == name}) > 1]
    if apart:
        raise ValueError(f"fields at two places: {apart}")
    filled = records.selectExpr("*", f"CAST(data_year AS INT) <= {BRIDGED_RACE_YEARS[1]} AS {OLD_LINE}", *[f"{text} AS {name}" for name, text in others.items()])
    old, new = (_line({f.name for f in layout}, layout, set(others)) for layout in layouts)
    built = filled.selectExpr("l_orderkey", "l_linenumber", OLD_LINE, f"CASE WHEN {OLD_LINE} THEN {old} ELSE {new} END AS value")
    return built.selectExpr("l_orderkey", "l_linenumber", OLD_LINE, "explode(array(value)) AS value")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a record line (doc_id, line_no, value)."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "posexplode(split(text, '\\n', -1)) AS (line_no, value)"
    )
