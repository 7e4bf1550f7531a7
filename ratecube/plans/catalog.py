"""The reports by name, bound to the star-schema tables.

Each entry takes (spark, directory of the tables) and returns the result table
with whole numbers as long and doubles rounded for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratecube.functions import recodes
from ratecube.operators import packed, panel, shares
from ratecube.operators.cells import count_events
from ratecube.plans import reports, star
from ratecube.plans.labels import label_events, label_persons
from ratecube.plans.round_trips import ROUND_TRIPS
from ratecube.sources import deaths as death_source
from ratecube.sources import fixed_width
from ratecube.sources.layouts import ALL_CAUSE_FIELDS, layout_for, narrow

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
FIRST, LAST = star.FIRST_YEAR, star.LAST_YEAR
ONE_YEAR = (LAST, LAST)
OLD_LAYOUT, NEW_LAYOUT = layout_for(2014), layout_for(2024)
# Keys of the cubes that crude and adjusted rates by nativity need.
RATE_KEYS = ["data_year", "nativity", "age_group"]
WANTED_STATUS = "low"


def tidy(table: DataFrame) -> DataFrame:
    """Long integers and rounded doubles, so that two engines can be compared."""
    kinds = {
        T.IntegerType: lambda c: c.cast("long"),
        T.DoubleType: lambda c: F.round(c, DIGITS),
    }
    return table.select(
        *[
            kinds.get(type(field.dataType), lambda c: c)(F.col(field.name)).alias(field.name)
            for field in table.schema.fields
        ]
    )


def _homicides(spark: SparkSession, sf_dir: str, years: tuple | None = None) -> DataFrame:
    return label_events(star.death_records(spark, sf_dir, years=years))


def _all_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_events(star.death_records(spark, sf_dir, homicides_only=False))


def _persons(
    spark: SparkSession, sf_dir: str, years: tuple | None = None, with_state: bool = True
) -> DataFrame:
    return label_persons(star.persons(spark, sf_dir, years, with_state))


def _of_events(report: Callable, *args, years: tuple | None = None, **kwargs) -> Query:
    return lambda spark, sf_dir: report(_homicides(spark, sf_dir, years), *args, **kwargs)


def _of_deaths(report: Callable, *args, **kwargs) -> Query:
    return lambda spark, sf_dir: report(_all_deaths(spark, sf_dir), *args, **kwargs)


def _of_persons(report: Callable, *args, with_state: bool = True, **kwargs) -> Query:
    return lambda spark, sf_dir: report(
        _persons(spark, sf_dir, with_state=with_state), *args, **kwargs
    )


def _of_both(
    report: Callable, *args, years: tuple | None = None, with_state: bool = True, **kwargs
) -> Query:
    return lambda spark, sf_dir: report(
        _homicides(spark, sf_dir, years),
        _persons(spark, sf_dir, years, with_state),
        *args,
        **kwargs,
    )


def _nationwide(report: Callable, *args, **kwargs) -> Query:
    """A report over both sides that does not group persons by state."""
    return _of_both(report, *args, with_state=False, **kwargs)


def _then(query: Query, *steps: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = query(spark, sf_dir)
        for step in steps:
            table = step(table)
        return table

    return run


# --- counts -----------------------------------------------------------------------

COUNTS: dict[str, Query] = {
    "events_by_year": _of_events(reports.events_by, ["data_year"]),
    "events_by_year_nativity": _of_events(reports.events_by, ["data_year", "nativity"]),
    "events_by_birthplace": _of_events(reports.events_by_known, ["data_year", "birthplace"]),
    "events_by_birthplace_rollup": _of_events(reports.foreign_events_with_total),
    "events_by_state_of_occurrence": _of_events(reports.events_by, ["state_occ"], LAST, years=ONE_YEAR),
    "events_by_state_of_residence": _of_events(reports.events_by, ["state"], LAST, years=ONE_YEAR),
    "events_by_nativity_one_year": _of_events(reports.events_by, ["nativity"], LAST, years=ONE_YEAR),
    "events_by_birthplace_one_year": _of_events(
        reports.events_by, ["birthplace"], LAST, years=ONE_YEAR
    ),
    "events_by_sex_nativity": _of_events(
        lambda e: reports.events_by(e.filter(F.col("nativity").isNotNull()), ["data_year", "sex", "nativity"])
    ),
    "events_by_race_nativity": _of_events(reports.events_by_known, ["data_year", "race", "nativity"]),
    "events_by_ethnicity_nativity": _of_events(
        reports.events_by_known, ["data_year", "ethnicity", "nativity"]
    ),
    "null_code_audit": _of_events(reports.null_codes_by_year),
    "flag_audit": _of_events(reports.flag_by_year, before=2021),
    "subgroup_composition": _of_events(reports.composition, "race_detail"),
    "subgroup_ethnicity_composition": _of_events(reports.composition, "ethnicity_detail"),
    "rest_of_world_ethnicity": _then(
        _of_events(reports.composition, "ethnicity_detail", ["Rest of world"]),
        lambda table: table.drop("birthplace"),
    ),
    "rest_of_world_composition": _then(
        _of_events(reports.composition, "race_detail", ["Rest of world"]),
        lambda table: table.drop("birthplace"),
    ),
}

# --- rates ------------------------------------------------------------------------

RATES: dict[str, Query] = {
    "crude_rate": _nationwide(reports.crude_by_nativity),
    "age_specific_rate": _nationwide(reports.age_specific_by_nativity),
    "age_adjusted_rate": _nationwide(reports.adjusted_by_nativity),
    "age_adjusted_exposure_anchor": _nationwide(reports.adjusted_by_nativity, anchor="exposure"),
    "age_adjusted_total": _nationwide(reports.adjusted_total),
    "crude_vs_adjusted": _nationwide(reports.crude_and_adjusted_stacked),
    "crude_vs_adjusted_from_cubes": _nationwide(
        lambda events, persons: reports.crude_and_adjusted_stacked(
            reports.event_cube(events, RATE_KEYS), reports.person_cube(persons, RATE_KEYS)
        )
    ),
    "subtotal_rates": _nationwide(reports.crude_by_birthplace),
    "subtotal_adjusted": _nationwide(reports.adjusted_by_birthplace),
    "age_specific_birthplace": _nationwide(reports.age_specific_by_birthplace),
    "pooled_rate": _nationwide(reports.pooled_age_specific),
    "age_specific_rate_wide": _nationwide(reports.pooled_age_specific_wide),
    "age_specific_rate_wide_one_year": _nationwide(reports.pooled_age_specific_wide, LAST, years=ONE_YEAR),
    "population_by_state": _of_persons(reports.population_by_state),
    "state_pooled_suppressed": _of_both(reports.pooled_by_state),
    "state_rate_suppressed": _of_both(reports.state_age_year_suppressed),
    "state_rates_one_year": _of_both(reports.state_rates, LAST, years=ONE_YEAR),
    "state_nativity_rates": _of_both(reports.state_nativity_rates, LAST, years=ONE_YEAR),
    "state_nativity_age_specific": _of_both(reports.state_nativity_age_specific, LAST, years=ONE_YEAR),
    "state_map_foreign": _of_both(reports.state_map, LAST, "foreign", years=ONE_YEAR),
    "state_map_native": _of_both(reports.state_map, LAST, "native", years=ONE_YEAR),
    "state_adjusted_exposure_foreign": _of_both(
        reports.adjusted_by_state, "foreign", LAST, years=ONE_YEAR
    ),
    "state_adjusted_exposure": _of_both(reports.adjusted_by_state, "native", LAST, years=ONE_YEAR),
    "state_year_nativity": _of_both(reports.state_year_nativity),
    "state_year_wide": _of_both(reports.state_year_rates, [FIRST, LAST]),
    "population_series": _of_persons(reports.population_series, with_state=False),
    "population_share": _of_persons(reports.foreign_share, ["data_year"], with_state=False),
    "pct_change_summary": _nationwide(reports.change_summary, FIRST, LAST),
    "race_ethnicity_rates": _nationwide(reports.race_ethnicity_rates),
    "white_ethnicity_rates": _nationwide(reports.white_ethnicity_rates, LAST, years=ONE_YEAR),
    "group_gap": _nationwide(reports.group_gap),
    "demographic_rates_stacked": _nationwide(reports.demographic_rates, LAST, years=ONE_YEAR),
    "marital_sex_rates": _nationwide(reports.marital_sex_rates, LAST, years=ONE_YEAR),
    "marital_age_cells": _nationwide(reports.marital_age_cells, LAST, years=ONE_YEAR),
}

# --- distributions and causes -------------------------------------------------------

DISTRIBUTIONS: dict[str, Query] = {
    "method_pct_by_group": _of_events(reports.method_shares, ["nativity"]),
    "method_pct_by_race": _of_events(reports.method_shares, ["race", "nativity"]),
    "method_pct_white_ethnicity": _of_events(
        reports.method_shares, ["ethnicity", "nativity"], "White"
    ),
    "marital_pct": _of_events(reports.marital_shares),
    "age_mean_median": _of_events(reports.age_mean_median, ["nativity"], LAST, years=ONE_YEAR),
    "age_median_by_sex": _of_events(reports.age_mean_median, ["sex", "nativity"], LAST, years=ONE_YEAR),
    "grouped_density": _of_events(reports.age_density),
    "binned_density": _of_events(reports.age_density, binned=True),
    "grouped_density_one_year": _of_events(reports.age_density, LAST, years=ONE_YEAR),
    "event_share_of_all": _of_deaths(reports.homicide_share),
    "top_causes_ties": _of_deaths(reports.top_causes),
    "cause_label_fallback": _of_deaths(
        lambda deaths: count_events(deaths, ["cause"]).select(
            "cause", F.expr(recodes.cause_label("cause")).alias("cause_label"), "n"
        )
    ),
}

# --- packed codes: whole documents, cut into slots ------------------------------------

CODES: dict[str, Query] = {
    "unpack_codes": lambda spark, sf_dir: packed.unpack_codes(
        star.table(spark, sf_dir, "documents"), "text", ["doc_id"]
    ),
    "code_frequency": lambda spark, sf_dir: packed.code_frequency(
        star.table(spark, sf_dir, "documents"), "text"
    ),
    "code_frequency_head": lambda spark, sf_dir: shares.first_rows(
        packed.code_frequency(star.table(spark, sf_dir, "documents"), "text"),
        ["-n", "condition_code"],
        30,
    ),
    "code_prevalence_by_group": lambda spark, sf_dir: packed.code_prevalence(
        star.table(spark, sf_dir, "documents"), "text", ["lang"]
    ),
}

# --- scans ------------------------------------------------------------------------------


def _document_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of even documents in the old layout, of odd ones in the new."""
    lines = star.document_lines(spark, sf_dir)
    keep = ["doc_id", "line_no"]
    old, new = (lines.filter(F.col("doc_id") % 2 == rest) for rest in (0, 1))
    return fixed_width.union_by_name(
        [
            fixed_width.parse_fixed_width(old, OLD_LAYOUT, keep),
            fixed_width.parse_fixed_width(new, NEW_LAYOUT, keep),
        ]
    )


def _of_either(spark: SparkSession, sf_dir: str, homicides: bool, keep: list[str]) -> DataFrame:
    lines = star.lines_of_either(spark, sf_dir, OLD_LAYOUT, NEW_LAYOUT)
    return death_source.records_of_either(lines, star.OLD_LINE, (OLD_LAYOUT, NEW_LAYOUT), homicides, keep)


SCANS: dict[str, Query] = {
    "fixed_width_scan": lambda spark, sf_dir: fixed_width.parse_fixed_width(
        star.document_lines(spark, sf_dir), narrow(OLD_LAYOUT, ALL_CAUSE_FIELDS), ["doc_id", "line_no"]
    ),
    "layout_union": _document_layouts,
    "record_length_profile": lambda spark, sf_dir: fixed_width.length_profile(
        star.document_lines(spark, sf_dir).withColumn("old_layout", F.col("doc_id") % 2 == 0),
        ["old_layout"],
    ),
    "event_extract": lambda spark, sf_dir: _of_either(spark, sf_dir, True, ["l_orderkey", "l_linenumber"]),
    "all_cause_extract": lambda spark, sf_dir: _of_either(spark, sf_dir, False, ["l_orderkey", "l_linenumber"]),
    "all_cause_rows_by_year": lambda spark, sf_dir: death_source.rows_by_year(_of_either(spark, sf_dir, False, [])),
}

# --- panels -------------------------------------------------------------------------------



def _with_status(report: Callable) -> Query:
    return lambda spark, sf_dir: report(
        _homicides(spark, sf_dir, ONE_YEAR),
        _persons(spark, sf_dir, ONE_YEAR),
        star.status_population(spark, sf_dir),
        WANTED_STATUS,
        LAST,
    )


def _persons_with_unknown_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey persons, those of unknown age without a weight."""
    people = star.persons(spark, sf_dir)
    return label_persons(people.withColumn("perwt", F.when(F.col("age").isNotNull(), F.col("perwt"))))


def _with_unknown_weights(report: Callable, *args) -> Query:
    return lambda spark, sf_dir: report(
        _homicides(spark, sf_dir), _persons_with_unknown_weights(spark, sf_dir), *args
    )


_PANEL = _of_both(reports.state_year_panel)
# Its shares are null where a weight is unknown, so that no state has all years.
_PANEL_UNKNOWN = _with_unknown_weights(reports.state_year_panel)
_PANEL_CRUDE = _of_both(reports.state_year_panel, "crude_rate")
_RATE_AND_SHARE = _of_both(reports.native_rate_by_foreign_share, LAST, years=ONE_YEAR)

PANELS: dict[str, Query] = {
    "panel": _PANEL,
    "panel_crude": _PANEL_CRUDE,
    "twfe_slope": _then(_PANEL, reports.panel_fit),
    "twfe_cluster_se": _then(_PANEL, lambda table: reports.panel_fit(table, "cluster")),
    "twfe_residuals": _then(_PANEL, reports.panel_residuals),
    "twfe_slope_crude": _then(_PANEL_CRUDE, reports.panel_fit),
    "twfe_cluster_se_crude": _then(_PANEL_CRUDE, lambda table: reports.panel_fit(table, "cluster")),
    "twfe_residuals_crude": _then(_PANEL_CRUDE, reports.panel_residuals),
    "twfe_unbalanced": _then(_PANEL_UNKNOWN, lambda table: reports.panel_fit(table, "cluster")),
    "panel_unknown_weights": _PANEL_UNKNOWN,
    "panel_crude_unknown_weights": _with_unknown_weights(reports.state_year_panel, "crude_rate"),
    "foreign_share_unknown_weights": lambda spark, sf_dir: reports.foreign_share(
        _persons_with_unknown_weights(spark, sf_dir), ["state", "data_year"]
    ),
    "twfe_residual_band": _then(
        _PANEL,
        reports.panel_residuals,
        lambda table: panel.confidence_band(table, "resid_foreign_share", "resid_native_rate"),
    ),
    "native_rate_by_foreign_share": _RATE_AND_SHARE,
    "pearson_corr": _then(
        _RATE_AND_SHARE, lambda table: panel.pearson(table, "foreign_share", "age_adjusted_rate")
    ),
    "linear_fit": _then(
        _RATE_AND_SHARE, lambda table: panel.linear_fit(table, "foreign_share", "age_adjusted_rate")
    ),
    "linear_band": _then(
        _RATE_AND_SHARE, lambda table: panel.confidence_band(table, "foreign_share", "age_adjusted_rate")
    ),
    "external_share": lambda spark, sf_dir: reports.external_share(
        star.status_population(spark, sf_dir), WANTED_STATUS
    ),
    "native_crude_by_external_share": _with_status(reports.native_crude_by_external_share),
    "native_rate_by_external_share": _with_status(reports.native_rate_by_external_share),
    "two_group_compare": _of_both(reports.compare_groups, LAST, years=ONE_YEAR),
}


def catalog() -> dict[str, Query]:
    named = COUNTS | RATES | DISTRIBUTIONS | CODES | SCANS | ROUND_TRIPS | PANELS
    return {name: _then(query, tidy) for name, query in named.items()}
