"""Death records: one fixed-width line per death, two layouts over the years."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ratecube.functions import codes
from ratecube.functions.recodes import is_in
from ratecube.sources.fixed_width import (
    either_slice,
    empty_of,
    length_profile,
    parse_either,
    parse_fixed_width,
    read_lines,
    trimmed_slice,
    union_by_name,
)
from ratecube.sources.layouts import ALL_CAUSE_FIELDS, ALL_YEARS, Field, layout_for, narrow
from ratecube.sources.tables import write_extract


class DeathFile(NamedTuple):
    """One input file. A year may have several, and need not have any."""

    year: int
    path: str | None


#: Positions in files count bytes, which are UTF-8 unless a reader is told otherwise.
CHARSET = "UTF-8"


def _line_is(layout: list[Field], name: str, values: list[str], line: str, charset: str | None = None) -> str:
    (field,) = narrow(layout, [name])
    return is_in(trimmed_slice(field, line, charset), values)


def homicide_records(
    lines: DataFrame, layout: list[Field], keep: list[str] | None = None, line: str = "value", charset: str | None = None
) -> DataFrame:
    """All fields of the homicides of state residents.

    The two filters read their slices off the line, below the wide projection:
    the other fields are cut only from the lines that pass.
    """
    wanted = lines.filter(_line_is(layout, "cause_recode113", codes.HOMICIDE_CAUSES, line, charset)).filter(
        _line_is(layout, "state_res_fips", codes.STATES, line, charset)
    )
    return parse_fixed_width(wanted, layout, keep, line, charset)


def all_cause_records(
    lines: DataFrame, layout: list[Field], keep: list[str] | None = None, line: str = "value", charset: str | None = None
) -> DataFrame:
    """Four fields of every death of a state resident."""
    wanted = lines.filter(_line_is(layout, "state_res_fips", codes.STATES, line, charset))
    return parse_fixed_width(wanted, narrow(layout, ALL_CAUSE_FIELDS), keep, line, charset)


def records_of_either(
    lines: DataFrame, test: str, layouts: tuple[list[Field], list[Field]], homicides: bool, keep: list[str] | None = None, line: str = "value"
) -> DataFrame:
    """Homicides with all fields, or all deaths with four, of state residents, from lines of two layouts in one table."""
    wanted = lines.filter(is_in(either_slice("state_res_fips", test, layouts, line), codes.STATES))
    if homicides:
        wanted = wanted.filter(is_in(either_slice("cause_recode113", test, layouts, line), codes.HOMICIDE_CAUSES))
    else:
        layouts = tuple(narrow(x, ALL_CAUSE_FIELDS) for x in layouts)
    return parse_either(wanted, test, layouts, keep, line)


def _by_layout(files: list[DeathFile], unknown: str = "raise") -> list[tuple[list[Field], list[str]]]:
    """One scan per layout instead of one per file; missing files drop out. A year without a layout is an error."""
    groups = defaultdict(list)
    for file in files:
        if file.path is not None:
            groups[tuple(layout_for(file.year, unknown))].append(file.path)
    return [(list(layout), paths) for layout, paths in groups.items()]


def _read(spark: SparkSession, files: list[DeathFile], records, wanted: list[str] | None, charset: str, unknown: str) -> DataFrame:
    parts = [records(read_lines(spark, paths), layout, charset=charset) for layout, paths in _by_layout(files, unknown)]
    if parts:
        return union_by_name(parts)
    # No file at all: no rows, with the fields of the years asked for.
    years = [file.year for file in files] or [ALL_YEARS[1]]
    layouts = [layout_for(year, unknown) for year in years]
    return union_by_name([empty_of(spark, narrow(x, wanted) if wanted else x) for x in layouts])


def read_homicides(spark: SparkSession, files: list[DeathFile], charset: str = CHARSET, unknown: str = "raise") -> DataFrame:
    """Homicides of all files; `unknown` says what to do with a year that has no layout (see `layout_for`)."""
    return _read(spark, files, homicide_records, None, charset, unknown)


def read_all_deaths(spark: SparkSession, files: list[DeathFile], charset: str = CHARSET, unknown: str = "raise") -> DataFrame:
    return _read(spark, files, all_cause_records, ALL_CAUSE_FIELDS, charset, unknown)


def observed_homicides(lines: DataFrame, layout: list[Field], name: str, charset: str | None = None) -> tuple[DataFrame, Observation]:
    """The homicides of state residents, and counts of the lines that its one scan sees on the way.

    After the table has been written, the observation has n_lines, n_other_cause (not a homicide), n_other_residence (a homicide, but
    not of a state resident) and n_kept: the audit of an extract without a second pass.
    """
    cause, state = (_line_is(layout, *test, "value", charset) for test in (("cause_recode113", codes.HOMICIDE_CAUSES), ("state_res_fips", codes.STATES)))
    seen = Observation(name)
    flagged = lines.withColumns({"__cause": F.coalesce(F.expr(cause), F.lit(False)), "__state": F.coalesce(F.expr(state), F.lit(False))})
    counted = flagged.observe(
        seen,
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(~F.col("__cause")).alias("n_other_cause"),
        F.count_if(F.col("__cause") & ~F.col("__state")).alias("n_other_residence"),
        F.count_if(F.col("__cause") & F.col("__state")).alias("n_kept"),
    )
    return parse_fixed_width(counted.filter("__cause AND __state"), layout, charset=charset), seen


def write_audited_homicides(spark: SparkSession, files: list[DeathFile], path: str, charset: str = CHARSET, **how) -> DataFrame:
    """Write the extract of homicides (see `tables.write_extract`) and return its audit, a row for each layout:
    (first_year, n_lines, n_other_cause, n_other_residence, n_kept), from the scan that wrote it."""
    parts, audits = [], []
    for i, (layout, paths) in enumerate(_by_layout(files)):
        part, seen = observed_homicides(read_lines(spark, paths), layout, f"layout{i}", charset)
        parts.append(part)
        audits.append((min(file.year for file in files if file.path in paths), seen))
    if not parts:
        raise ValueError("no file to read")
    write_extract(union_by_name(parts), path, **how)
    return audit_table(spark, audits)


AUDIT = "first_year int, n_lines long, n_other_cause long, n_other_residence long, n_kept long"


def audit_table(spark: SparkSession, audits: list[tuple[int, Observation]]) -> DataFrame:
    names = ["n_lines", "n_other_cause", "n_other_residence", "n_kept"]
    return spark.createDataFrame([(year, *(seen.get[n] for n in names)) for year, seen in audits], AUDIT)


def flagged_records(lines: DataFrame, layout: list[Field], charset: str | None = None) -> DataFrame:
    """Every death of a state resident with `is_homicide`: the four all-cause fields,
    and the others where the flag is set, so that both extracts come off one scan."""
    wanted = lines.filter(_line_is(layout, "state_res_fips", codes.STATES, "value", charset))
    flagged = wanted.withColumn("is_homicide", F.expr(_line_is(layout, "cause_recode113", codes.HOMICIDE_CAUSES, "value", charset)))
    table = parse_fixed_width(flagged, layout, ["is_homicide"], charset=charset)
    always = {"is_homicide", *ALL_CAUSE_FIELDS}
    return table.select(*[F.col(c) if c in always else F.when(F.col("is_homicide"), F.col(c)).alias(c) for c in table.columns])


def read_deaths(spark: SparkSession, files: list[DeathFile], charset: str = CHARSET, unknown: str = "raise") -> DataFrame:
    """All deaths with a homicide flag (see `flagged_records`), each file read once."""
    parts = [flagged_records(read_lines(spark, paths), layout, charset) for layout, paths in _by_layout(files, unknown)]
    return union_by_name(parts) if parts else read_homicides(spark, files).withColumn("is_homicide", F.lit(True))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's file metadata writes it, without the slashes of an empty host."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop).toUri().toString().replace(":///", ":/")


def record_lengths(spark: SparkSession, files: list[DeathFile]) -> DataFrame:
    """(year, path, record_length, n): how long the lines of each file are.

    All files are one scan; a line's file comes from its metadata. A missing file
    gives one row with null length and no lines.
    """
    schema = "year int, path string, record_length int, n long"
    absent = [(file.year, None, None, 0) for file in files if file.path is None]
    table = spark.createDataFrame(absent, schema)
    present = [file for file in files if file.path is not None]
    if not present:
        return table
    at = F.regexp_replace(F.col("_metadata.file_path"), ":///", ":/")
    which = reduce(
        lambda other, i: F.when(at == qualified(spark, present[i].path), F.lit(i)).otherwise(other),
        range(len(present)),
        F.lit(None).cast("int"),
    )
    lines = read_lines(spark, sorted({file.path for file in present})).select("value", which.alias("file"))
    years, paths = (F.array(*[F.lit(file[k]) for file in present]) for k in (0, 1))
    profile = length_profile(lines, ["file"]).select(
        F.get(years, F.col("file")).alias("year"), F.get(paths, F.col("file")).alias("path"), "record_length", "n"
    )
    return profile.unionByName(table)


def rows_by_year(records: DataFrame) -> DataFrame:
    """Record count per data year, the audit after a scan."""
    return records.groupBy("data_year").agg(F.count(F.lit(1)).alias("n"))
