"""All result tables of a study, written in one go.

Each big input is read once: the deaths into a Parquet table of the wanted fields,
of which the homicides are a partition, and all into cubes. Rates, shares and panels come off the cubes; the tables that need single
records (ages in years, packed codes, detailed codes, place of occurrence) read the
extract, a small part of the death records, by column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecube.functions import codes
from ratecube.operators import packed, panel
from ratecube.plans import reports
from ratecube.plans.labels import label_events, label_persons
from ratecube.sources.tables import read_cells, read_extract, write_cells, write_result, write_year_cells

DEATH_CUBE_KEYS = ["data_year", "nativity", "cause"]
RATE, SHARE = "age_adjusted_rate", "foreign_share"


@dataclass
class Study:
    """Inputs of the reports: the extract, its labelled form, and the cubes."""

    homicides: DataFrame
    records: DataFrame
    events: DataFrame
    persons: DataFrame
    deaths: DataFrame
    status: DataFrame | None = None
    wanted_status: str | None = None
    first: int = codes.FIRST_YEAR
    last: int = codes.LAST_YEAR
    # Tables that several reports take; `publish` stores them once.
    panel: DataFrame | None = None
    rate_and_share: DataFrame | None = None


# name -> (sort order, report)
Table = tuple[list[str], Callable[[Study], DataFrame]]
TABLES: dict[str, Table] = {
    "events_by_year": (["data_year"], lambda s: reports.events_by(s.events, ["data_year"])),
    "events_by_year_nativity": (
        ["data_year", "nativity"],
        lambda s: reports.events_by(s.events, ["data_year", "nativity"]),
    ),
    "events_by_birthplace": (
        ["data_year", "birthplace"],
        lambda s: reports.events_by_known(s.events, ["data_year", "birthplace"]),
    ),
    "foreign_events_with_total": (
        ["data_year", "birthplace"],
        lambda s: reports.foreign_events_with_total(s.events),
    ),
    "events_by_state_of_occurrence": (
        ["state_occ"],
        lambda s: reports.events_by(s.records, ["state_occ"], s.last),
    ),
    "events_by_state_of_residence": (
        ["state"],
        lambda s: reports.events_by(s.events, ["state"], s.last),
    ),
    "crude_by_nativity": (
        ["data_year", "nativity"],
        lambda s: reports.crude_by_nativity(s.events, s.persons),
    ),
    "crude_by_birthplace": (
        ["data_year", "sort_order"],
        lambda s: reports.crude_by_birthplace(s.events, s.persons),
    ),
    "adjusted_by_nativity": (
        ["data_year", "nativity"],
        lambda s: reports.adjusted_by_nativity(s.events, s.persons),
    ),
    "adjusted_by_birthplace": (
        ["data_year", "birthplace"],
        lambda s: reports.adjusted_by_birthplace(s.events, s.persons),
    ),
    "adjusted_total": (["data_year"], lambda s: reports.adjusted_total(s.events, s.persons)),
    "crude_and_adjusted": (
        ["data_year", "nativity", "sort_order"],
        lambda s: reports.crude_and_adjusted_stacked(s.events, s.persons),
    ),
    "pooled_age_specific": (
        ["age_group"],
        lambda s: reports.pooled_age_specific_wide(s.events, s.persons),
    ),
    "last_year_age_specific": (
        ["age_group"],
        lambda s: reports.pooled_age_specific_wide(s.events, s.persons, s.last),
    ),
    "population_by_state": (
        ["state", "nativity"],
        lambda s: reports.population_by_state(s.persons),
    ),
    "pooled_by_state": (
        ["state", "nativity"],
        lambda s: reports.pooled_by_state(s.events, s.persons),
    ),
    "state_rates": (["state"], lambda s: reports.state_rates(s.events, s.persons, s.last)),
    "state_nativity_rates": (
        ["state", "nativity"],
        lambda s: reports.state_nativity_rates(s.events, s.persons, s.last),
    ),
    "state_first_and_last_year": (
        ["state", "data_year"],
        lambda s: reports.state_year_rates(s.events, s.persons, [s.first, s.last]),
    ),
    "population_series": (
        ["data_year", "sort_order"],
        lambda s: reports.population_series(s.persons),
    ),
    "foreign_share": (["data_year"], lambda s: reports.foreign_share(s.persons, ["data_year"])),
    "change_summary": (
        ["metric"],
        lambda s: reports.change_summary(s.events, s.persons, s.first, s.last),
    ),
    "race_ethnicity_rates": (
        ["race", "ethnicity", "nativity"],
        lambda s: reports.race_ethnicity_rates(s.events, s.persons),
    ),
    "group_gap": (["gap"], lambda s: reports.group_gap(s.events, s.persons)),
    "demographic_rates": (
        ["category"],
        lambda s: reports.demographic_rates(s.events, s.persons, s.last),
    ),
    "white_ethnicity_rates": (
        ["category"],
        lambda s: reports.white_ethnicity_rates(s.events, s.persons, s.last),
    ),
    "marital_sex_rates": (
        ["marital", "sex", "nativity"],
        lambda s: reports.marital_sex_rates(s.events, s.persons, s.last),
    ),
    "widowed_age_cells": (
        ["-rate"],
        lambda s: reports.marital_age_cells(s.events, s.persons, s.last),
    ),
    "method_by_nativity": (
        ["nativity", "method"],
        lambda s: reports.method_shares(s.events, ["nativity"]),
    ),
    "method_by_race": (
        ["race", "nativity", "method"],
        lambda s: reports.method_shares(s.events, ["race", "nativity"]),
    ),
    "method_white_by_ethnicity": (
        ["ethnicity", "nativity", "method"],
        lambda s: reports.method_shares(s.events, ["ethnicity", "nativity"], "White"),
    ),
    "marital_shares": (["nativity", "-n"], lambda s: reports.marital_shares(s.events)),
    "race_by_birthplace": (
        ["birthplace", "-n"],
        lambda s: reports.composition(s.records, "race_detail"),
    ),
    "ethnicity_by_birthplace": (
        ["birthplace", "-n"],
        lambda s: reports.composition(s.records, "ethnicity_detail"),
    ),
    "age_by_nativity": (
        ["nativity"],
        lambda s: reports.age_mean_median(s.records, ["nativity"], s.last),
    ),
    "age_by_sex_and_nativity": (
        ["sex", "nativity"],
        lambda s: reports.age_mean_median(s.records, ["sex", "nativity"], s.last),
    ),
    "age_density": (["nativity", "x"], lambda s: reports.age_density(s.records, s.last)),
    "condition_frequency": (
        ["-n", "condition_code"],
        lambda s: packed.code_frequency(s.homicides, "record_axis_raw"),
    ),
    "condition_prevalence": (
        ["nativity", "-n", "condition_code"],
        lambda s: reports.condition_prevalence(s.homicides),
    ),
    "homicide_share_of_deaths": (
        ["data_year", "nativity"],
        lambda s: reports.homicide_share(s.deaths),
    ),
    "leading_causes": (["nativity", "-n"], lambda s: reports.top_causes(s.deaths)),
    "missing_race_codes": (["-n"], lambda s: reports.null_codes_by_year(s.records)),
    "education_flags": (
        ["data_year", "education_flag"],
        lambda s: reports.flag_by_year(s.records),
    ),
    "panel_adjusted": (
        ["state", "data_year"],
        lambda s: s.panel,
    ),
    "panel_crude": (
        ["state", "data_year"],
        lambda s: reports.state_year_panel(s.events, s.persons, "crude_rate"),
    ),
    "panel_fit": ([], lambda s: reports.panel_fit(s.panel)),
    "panel_fit_clustered": (
        [],
        lambda s: reports.panel_fit(s.panel, "cluster"),
    ),
    "panel_residuals": (
        ["state", "data_year"],
        lambda s: reports.panel_residuals(s.panel),
    ),
    "native_rate_and_foreign_share": (
        ["state"],
        lambda s: s.rate_and_share,
    ),
    "rate_share_correlation": (
        [],
        lambda s: panel.pearson(s.rate_and_share, SHARE, RATE),
    ),
    "rate_share_line": (["x"], lambda s: panel.confidence_band(s.rate_and_share, SHARE, RATE)),
    "panel_residual_line": (
        ["x"],
        lambda s: panel.confidence_band(
            reports.panel_residuals(s.panel), "resid_foreign_share", "resid_native_rate"
        ),
    ),
    "native_and_foreign_rates": (
        ["state"],
        lambda s: reports.compare_groups(s.events, s.persons, s.last),
    ),
}
STATUS_TABLES: dict[str, Table] = {
    "status_share": (["state"], lambda s: reports.external_share(s.status, s.wanted_status)),
    "native_crude_and_status": (
        ["state"],
        lambda s: reports.native_crude_by_external_share(
            s.events, s.persons, s.status, s.wanted_status, s.last
        ),
    ),
    "native_rate_and_status": (
        ["state"],
        lambda s: reports.native_rate_by_external_share(
            s.events, s.persons, s.status, s.wanted_status, s.last
        ),
    ),
}


def _stored(cells: DataFrame, path: str) -> DataFrame:
    write_cells(cells, path)
    return read_cells(cells.sparkSession, path)


def _stored_by_year(cells: DataFrame, path: str, add: bool) -> DataFrame:
    write_year_cells(cells, path, add)
    kind = dict(cells.dtypes)["data_year"]
    return read_cells(cells.sparkSession, path).withColumn("data_year", F.col("data_year").cast(kind)).select(*cells.columns)


def study(deaths: DataFrame, persons: DataFrame, out: str, add: bool = False, **options) -> Study:
    """Records under ``out/deaths`` and cubes under ``out/cells`` from the raw inputs.

    `deaths` are all deaths with a homicide flag (`sources.deaths.read_deaths`). They
    are scanned once; extract and all-cause cube come off what is written.

    With `add`, `deaths` and `persons` have further years (or years again) of a study
    that is there: only the partitions of those years are written, those of other
    years keep their files, and the study returned has all years.
    """
    spark = deaths.sparkSession
    years = [r[0] for r in deaths.select(F.col("data_year").cast("int")).distinct().collect()] if add else []
    pieces = deaths.hint("rebalance", "is_homicide", "data_year").write.partitionBy("is_homicide", "data_year")
    pieces = pieces.option("partitionOverwriteMode", "dynamic" if add else "static")
    pieces.mode("overwrite").parquet(f"{out}/deaths")
    written = read_extract(spark, f"{out}/deaths")
    new = written.filter(F.col("data_year").cast("int").isin(years)) if add else written

    def records_of(table: DataFrame) -> DataFrame:
        return label_events(table.filter("is_homicide = 'true'").drop("is_homicide"))

    return Study(
        homicides=written.filter("is_homicide = 'true'").drop("is_homicide"),
        records=records_of(written),
        events=_stored_by_year(reports.event_cube(records_of(new)), f"{out}/cells/events", add),
        persons=_stored_by_year(reports.person_cube(label_persons(persons)), f"{out}/cells/persons", add),
        deaths=_stored_by_year(reports.event_cube(label_events(new), DEATH_CUBE_KEYS), f"{out}/cells/deaths", add),
        **options,
    )


#: The tables that take the panel, and those that take rate and share, which are stored once for all of them.
OF_PANEL = {"panel_adjusted", "panel_fit", "panel_fit_clustered", "panel_residuals", "panel_residual_line"}
OF_RATE_AND_SHARE = {"native_rate_and_foreign_share", "rate_share_correlation", "rate_share_line"}


def publish(inputs: Study, out: str, names: list[str] | None = None) -> list[str]:
    """Write the named result tables (or all) as CSV under ``out/tables``."""
    tables = TABLES | (STATUS_TABLES if inputs.status is not None else {})
    wanted = set(names or tables)
    if wanted & OF_PANEL:
        table = reports.state_year_panel(inputs.events, inputs.persons)
        inputs = replace(inputs, panel=_stored(table, f"{out}/cells/panel"))
    if wanted & OF_RATE_AND_SHARE:
        table = reports.native_rate_by_foreign_share(inputs.events, inputs.persons, inputs.last)
        inputs = replace(inputs, rate_and_share=_stored(table, f"{out}/cells/rate_and_share"))
    for name in names or tables:
        order, report = tables[name]
        write_result(report(inputs), f"{out}/tables/{name}", order)
    return list(names or tables)
