"""The reports: named result tables over labelled events and persons.

`events` and `persons` are outputs of `label_events` and `label_persons`, or
cubes of them (`event_cube`, `person_cube`): one scan of the records can serve
every report here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecube.functions import codes, recodes
from ratecube.functions.measures import percent
from ratecube.operators import cells as cell_ops
from ratecube.operators import distribution, packed, panel, rates, shares
from ratecube.operators.cells import count_events, merge_cells, sum_exposure, with_subtotal

NATIVITY = ["native", "foreign"]
FOREIGN_PLACES = [label for _, label in codes.FOREIGN_BIRTH_CODES]
# Keys of the cubes: those that rates and shares group by. Their combinations are
# bounded by the code tables, whatever the number of records.
PERSON_CUBE_KEYS = [
    "data_year", "state", "nativity", "birthplace", "age_group", "sex", "race", "ethnicity", "marital",
]
EVENT_CUBE_KEYS = [*PERSON_CUBE_KEYS, "method"]
# Series of the wide state table: the subtotal and the two groups.
SERIES = ["total", *NATIVITY]


def event_cube(events: DataFrame, keys: list[str] = EVENT_CUBE_KEYS) -> DataFrame:
    """Counts by all keys at once. Reports on other keys (detailed race, cause, place
    of occurrence, age in years) take the records or a cube of their own keys."""
    return count_events(events, keys)


def person_cube(persons: DataFrame, keys: list[str] = PERSON_CUBE_KEYS) -> DataFrame:
    """Unknown sums stay NaN here, so that reports off the cube see them."""
    return persons.groupBy(*keys).agg(F.sum("pop").alias("pop"))


def _known(table: DataFrame, *keys: str) -> DataFrame:
    return reduce(lambda df, key: df.filter(F.col(key).isNotNull()), keys, table)


def _only(table: DataFrame, key: str, *values) -> DataFrame:
    return table.filter(F.col(key).isin(*values))


def _in_year(table: DataFrame, year: int | None) -> DataFrame:
    return table if year is None else _only(table, "data_year", year)


def _of(key: str, group: str, value: str) -> Column:
    """The value of one group among the rows that are being aggregated."""
    return F.max(F.when(F.col(key) == group, F.col(value)))


def _cells(
    events: DataFrame, persons: DataFrame, keys: list[str], known: list[str], year: int | None = None
) -> DataFrame:
    """Merged cells of one year (or all), without the groups where `known` keys are null."""
    return merge_cells(
        _known(_in_year(events, year), *known), _known(_in_year(persons, year), *known), keys
    )


def _group_cells(
    events: DataFrame, persons: DataFrame, nativity: str, keys: list[str], year: int
) -> DataFrame:
    """Merged cells of one nativity in one year."""
    return _cells(
        _only(events, "nativity", nativity), _only(persons, "nativity", nativity), keys, [], year
    )


# --- counts ----------------------------------------------------------------------


def events_by(events: DataFrame, keys: list[str], year: int | None = None) -> DataFrame:
    return count_events(_in_year(events, year), keys)


def events_by_known(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts without the groups in which a key is null."""
    return count_events(_known(events, *[k for k in keys if k != "data_year"]), keys)


def foreign_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("birthplace").isin(FOREIGN_PLACES))


def foreign_events_with_total(events: DataFrame) -> DataFrame:
    keys = ["data_year", "birthplace"]
    return with_subtotal(
        count_events(foreign_events(events), keys), keys, "birthplace", codes.FOREIGN_TOTAL
    )


def null_codes_by_year(events: DataFrame, key: str = "race_code") -> DataFrame:
    """Events by year whose code is missing."""
    return count_events(events.filter(F.col(key).isNull()), ["data_year"])


def flag_by_year(
    events: DataFrame, flag: str = "education_flag", before: int = codes.EDUCATION_FLAG_BEFORE
) -> DataFrame:
    return count_events(events.filter(F.col("data_year") < before), ["data_year", flag])


def composition(events: DataFrame, detail: str, places: list[str] = FOREIGN_PLACES) -> DataFrame:
    """Detailed race or ethnicity of the events of some birthplaces, unknowns included."""
    return count_events(events.filter(F.col("birthplace").isin(places)), ["birthplace", detail])


# --- rates by year and nativity or birthplace ---------------------------------------


def crude_by_nativity(events: DataFrame, persons: DataFrame) -> DataFrame:
    keys = ["data_year", "nativity"]
    return rates.crude_rate(_cells(events, persons, keys, ["nativity"]), keys)


def nativity_age_cells(events: DataFrame, persons: DataFrame) -> DataFrame:
    return _cells(events, persons, ["data_year", "nativity", "age_group"], ["nativity"])


def age_specific_by_nativity(events: DataFrame, persons: DataFrame) -> DataFrame:
    return rates.age_specific_rate(nativity_age_cells(events, persons))


def adjusted_by_nativity(events: DataFrame, persons: DataFrame, anchor: str = "events") -> DataFrame:
    keys = ["data_year", "nativity"]
    return rates.standardise(nativity_age_cells(events, persons), keys, anchor)


def crude_and_adjusted_stacked(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Long table (data_year, nativity, rate_type, rate, sort_order)."""
    order = ["Crude", "Age-adjusted"]
    both = rates.crude_and_adjusted(nativity_age_cells(events, persons), ["data_year", "nativity"])
    keys = ["data_year", "nativity", "n_known_age"]
    named = both.select(
        *keys, F.col("crude_rate").alias(order[0]), F.col("age_adjusted_rate").alias(order[1])
    )
    stacked = named.unpivot(keys, order, "rate_type", "rate")
    has_rate = (F.col("rate_type") == order[0]) | F.col("n_known_age").isNotNull()
    return (
        stacked.filter(has_rate)
        .drop("n_known_age")
        .withColumn("sort_order", F.expr(recodes.sort_order("rate_type", order)))
    )


def _birthplace_cells(events: DataFrame, persons: DataFrame, keys: list[str]) -> DataFrame:
    abroad = merge_cells(foreign_events(events), foreign_events(persons), keys)
    return with_subtotal(abroad, keys, "birthplace", codes.FOREIGN_TOTAL)


def crude_by_birthplace(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Countries and their total, with the order in which they are shown."""
    keys = ["data_year", "birthplace"]
    rated = rates.with_rate(rates.anchored(_birthplace_cells(events, persons, keys), "events"))
    return rated.withColumn(
        "sort_order",
        F.expr(recodes.sort_order("birthplace", [codes.FOREIGN_TOTAL, *FOREIGN_PLACES])),
    )


def adjusted_by_birthplace(events: DataFrame, persons: DataFrame) -> DataFrame:
    keys = ["data_year", "birthplace"]
    return rates.standardise(
        _birthplace_cells(events, persons, [*keys, "age_group"]), keys, "events"
    )


def age_specific_by_birthplace(events: DataFrame, persons: DataFrame) -> DataFrame:
    keys = ["data_year", "birthplace", "age_group"]
    return rates.age_specific_rate(
        merge_cells(foreign_events(events), foreign_events(persons), keys)
    )


def adjusted_total(events: DataFrame, persons: DataFrame) -> DataFrame:
    cells = merge_cells(events, persons, ["data_year", "age_group"])
    return rates.standardise(cells, ["data_year"], "events")


def pooled_age_specific(events: DataFrame, persons: DataFrame, year: int | None = None) -> DataFrame:
    """Rates by nativity and age over all years together, or in one year."""
    cells = _cells(events, persons, ["nativity", "age_group"], ["nativity"], year)
    return rates.age_specific_rate(cells).select(
        "nativity", "age_group", F.expr(recodes.age_label("age_group")).alias("age_group_label"),
        "n", "pop", "rate",
    )


def pooled_age_specific_wide(
    events: DataFrame, persons: DataFrame, year: int | None = None
) -> DataFrame:
    return shares.widen(
        pooled_age_specific(events, persons, year),
        ["age_group", "age_group_label"],
        "nativity",
        NATIVITY,
        {"rate": ""},
    )


# --- rates by state --------------------------------------------------------------------


def population_by_state(persons: DataFrame) -> DataFrame:
    return sum_exposure(_known(persons, "nativity"), ["state", "nativity"])


def pooled_by_state(events: DataFrame, persons: DataFrame) -> DataFrame:
    keys = ["state", "nativity"]
    table = rates.crude_rate(_cells(events, persons, keys, ["nativity"]), keys)
    return rates.suppress(table, ["rate"])


def state_rates(events: DataFrame, persons: DataFrame, year: int) -> DataFrame:
    """All residents of a state in one year, small states suppressed."""
    cells = _cells(events, persons, ["state", "age_group"], [], year)
    table = rates.crude_and_adjusted(cells, ["state"]).drop("n_known_age")
    return rates.suppress(table, ["crude_rate", "age_adjusted_rate"])


def state_nativity_age_specific(events: DataFrame, persons: DataFrame, year: int) -> DataFrame:
    cells = _cells(events, persons, ["state", "nativity", "age_group"], ["nativity"], year)
    return rates.age_specific_rate(cells)


def state_nativity_rates(
    events: DataFrame, persons: DataFrame, year: int, anchor: str = "events"
) -> DataFrame:
    keys = ["state", "nativity"]
    cells = _cells(events, persons, [*keys, "age_group"], ["nativity"], year)
    return rates.standardise(cells, keys, anchor)


def state_map(events: DataFrame, persons: DataFrame, year: int, nativity: str) -> DataFrame:
    """(state, age_adjusted_rate) of one group, suppressed: the table behind a map."""
    table = state_nativity_rates(
        _only(events, "nativity", nativity), _only(persons, "nativity", nativity), year
    )
    return rates.suppress(table, ["age_adjusted_rate"]).select("state", "age_adjusted_rate")


def state_age_year_suppressed(events: DataFrame, persons: DataFrame) -> DataFrame:
    cells = merge_cells(events, persons, ["state", "age_group", "data_year"])
    rated = rates.age_specific_rate(cells).drop("weight", "weighted_rate")
    return rates.suppress(rated, ["rate"], flag="suppressed")


def adjusted_by_state(events: DataFrame, persons: DataFrame, nativity: str, year: int) -> DataFrame:
    """One group by state, anchored on the population, suppressed with a flag."""
    cells = _group_cells(events, persons, nativity, ["state", "age_group"], year)
    table = rates.standardise(cells, ["state"], "exposure")
    return rates.suppress(table, ["crude_rate", "age_adjusted_rate"], flag="suppressed")


def state_year_nativity(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Crude and adjusted rates of every state, year and group with events."""
    keys = ["state", "data_year", "nativity"]
    cells = _cells(events, persons, [*keys, "age_group"], ["nativity"])
    return rates.crude_and_adjusted(cells, keys).drop("n_known_age")


def state_year_rates(events: DataFrame, persons: DataFrame, years: list[int]) -> DataFrame:
    """Crude and adjusted rates of everyone and of both groups, one row per state and year.

    Cells by group are summed once more into the total, so the twelve inputs of
    the table come from one pass over each side.
    """
    keys = ["state", "data_year", "nativity"]
    fine = merge_cells(
        _only(events, "data_year", *years), _only(persons, "data_year", *years), [*keys, "age_group"]
    )
    series = with_subtotal(fine, [*keys, "age_group"], "nativity", SERIES[0])
    table = rates.crude_and_adjusted(series, keys)
    return shares.widen(
        table,
        ["state", "data_year"],
        "nativity",
        SERIES,
        {"crude_rate": "crude_rate_", "age_adjusted_rate": "adjusted_rate_"},
    )


# --- population --------------------------------------------------------------------------


def population_series(persons: DataFrame) -> DataFrame:
    """Population by year: everyone, native, foreign; everyone includes unknown nativity."""
    keys = ["data_year", "nativity"]
    order = [codes.TOTAL_SERIES, *[label for _, label in codes.NATIVITY_LABELS]]
    everyone = with_subtotal(
        persons.groupBy(*keys).agg(F.sum("pop").alias("pop")), keys, "nativity", codes.TOTAL_SERIES
    )
    series = F.when(F.col("nativity") == codes.TOTAL_SERIES, F.col("nativity")).otherwise(
        F.expr(recodes.nativity_label("nativity"))
    )
    return (
        everyone.filter(F.col("nativity").isNotNull())
        .select("data_year", series.alias("series"), rates.known(F.col("pop")).alias("pop"))
        .withColumn("sort_order", F.expr(recodes.sort_order("series", order)))
    )


def foreign_share(persons: DataFrame, keys: list[str], year: int | None = None) -> DataFrame:
    """(keys, foreign_pop, total_pop, foreign_share); the total includes unknown nativity."""
    people = _in_year(persons, year)
    return (
        people.groupBy(*keys)
        .agg(
            rates.known(
                F.sum(F.when(F.col("nativity") == "foreign", F.col("pop")).otherwise(0.0))
            ).alias("foreign_pop"),
            rates.known(F.sum("pop")).alias("total_pop"),
        )
        .withColumn("foreign_share", percent(F.col("foreign_pop"), F.col("total_pop")))
    )


def change_summary(
    events: DataFrame,
    persons: DataFrame,
    first: int = codes.FIRST_YEAR,
    last: int = codes.LAST_YEAR,
) -> DataFrame:
    """(metric, value_first, value_last, pct_change) of counts, rates and populations.

    Only the two years are read; all eight metrics come from one set of cells.
    """
    keys = ["data_year", "nativity"]
    years = [first, last]
    fine = merge_cells(
        _only(events, "data_year", *years), _only(persons, "data_year", *years), [*keys, "age_group"]
    )
    series = with_subtotal(fine, [*keys, "age_group"], "nativity", SERIES[0])
    table = rates.crude_and_adjusted(series, keys, groups_without_events=True)
    wide = shares.widen(
        table,
        ["data_year"],
        "nativity",
        SERIES,
        {"n": "n_", "pop": "pop_", "age_adjusted_rate": "adjusted_"},
    )
    metrics = {
        "Foreign-born population share (%)": percent(F.col("pop_foreign"), F.col("pop_total")),
        "Foreign-born population (count)": F.col("pop_foreign"),
        "Native-born age-adjusted rate": F.col("adjusted_native"),
        "Foreign-born age-adjusted rate": F.col("adjusted_foreign"),
        "Total age-adjusted rate": F.col("adjusted_total"),
        "Native-born homicide count": F.col("n_native").cast("double"),
        "Foreign-born homicide count": F.col("n_foreign").cast("double"),
        "Total homicide count": F.col("n_total").cast("double"),
    }
    named = wide.select("data_year", *[value.alias(name) for name, value in metrics.items()])
    stacked = named.unpivot(["data_year"], list(metrics), "metric", "value")
    return shares.first_to_last(stacked, ["metric"], "data_year", "value", first, last)


# --- rates by demographic group -------------------------------------------------------------


def race_ethnicity_rates(
    events: DataFrame, persons: DataFrame, year: int | None = None
) -> DataFrame:
    keys = ["race", "ethnicity", "nativity"]
    cells = _cells(events, persons, [*keys, "age_group"], keys, year)
    return rates.standardise(cells, keys, "events").withColumn(
        "category",
        F.expr(recodes.category("race", "ethnicity", recodes.nativity_label("nativity"))),
    )


def white_ethnicity_rates(events: DataFrame, persons: DataFrame, year: int) -> DataFrame:
    table = race_ethnicity_rates(
        _only(events, "race", "White"), _only(persons, "race", "White"), year
    )
    return table.drop("race", "ethnicity", "nativity")


def group_gap(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Groups for which both rates exist, with the difference between them."""
    table = race_ethnicity_rates(events, persons)
    wide = shares.widen(
        table.withColumn("group_label", F.expr(recodes.category("race", "ethnicity"))),
        ["group_label"],
        "nativity",
        NATIVITY,
        {"age_adjusted_rate": ""},
    )
    return _known(wide, *NATIVITY).withColumn("gap", F.col("native") - F.col("foreign"))


def demographic_rates(events: DataFrame, persons: DataFrame, year: int) -> DataFrame:
    """Rates by sex, race and ethnicity, each by nativity, as one table.

    Cells by all keys are summed into the three groupings in one pass.
    """
    dimensions = ["sex", "race", "ethnicity"]
    fine_keys = [*dimensions, "nativity", "age_group"]
    fine = _cells(events, persons, fine_keys, ["nativity"], year)
    stacked = cell_ops.stack_groupings(
        fine, [[d, "nativity", "age_group"] for d in dimensions], fine_keys
    )
    group = F.coalesce(F.expr(recodes.label_of("sex", codes.SEX_LABELS)), "race", "ethnicity")
    one_each = stacked.withColumn("category", group).filter(F.col("category").isNotNull())
    table = rates.standardise(one_each, ["category", "nativity"], "events")
    return table.select(
        F.expr(recodes.category("category", recodes.nativity_label("nativity"))).alias("category"),
        F.col("n").alias("homicides"), F.col("pop").alias("acs_population"),
        "crude_rate", "age_adjusted_rate",
    )


def _marital_cells(events: DataFrame, persons: DataFrame, year: int) -> DataFrame:
    keys = ["marital", "sex", "nativity", "age_group"]
    return merge_cells(
        _known(_in_year(events, year), "nativity", "marital"),
        _known(_in_year(persons, year), "nativity", "marital", "sex"),
        keys,
    )


def marital_sex_rates(events: DataFrame, persons: DataFrame, year: int) -> DataFrame:
    keys = ["marital", "sex", "nativity"]
    return rates.standardise(_marital_cells(events, persons, year), keys, "events")


def marital_age_cells(
    events: DataFrame, persons: DataFrame, year: int, marital: str = "Widowed"
) -> DataFrame:
    """Rates by age of one marital group, to be listed from the highest."""
    cells = _marital_cells(
        _only(events, "marital", marital), _only(persons, "marital", marital), year
    )
    return rates.age_specific_rate(cells).drop("weight", "weighted_rate")


# --- distributions -------------------------------------------------------------------------------


def method_shares(events: DataFrame, group: list[str], race: str | None = None) -> DataFrame:
    """How the homicides of each group divide over methods."""
    if race is not None:
        events = events.filter(F.col("race") == race)
    return shares.distribution(_known(events, "method", *group), group, ["method"])


def marital_shares(events: DataFrame) -> DataFrame:
    return shares.distribution(_known(events, "nativity", "marital"), ["nativity"], ["marital"])


def _numeric_ages(events: DataFrame, group: list[str], year: int | None) -> DataFrame:
    in_years = _known(_in_year(events, year), "nativity").filter(
        F.col("age_type") == codes.AGE_IN_YEARS
    )
    return distribution.histogram(in_years, group, "age_years")


def age_mean_median(events: DataFrame, group: list[str], year: int | None = None) -> DataFrame:
    ages = _numeric_ages(events, group, year)
    return distribution.mean_and_median(ages, group, "age_years").withColumnsRenamed(
        {"mean": "mean_age", "median": "median_age"}
    )


def age_density(events: DataFrame, year: int | None = None, binned: bool = False) -> DataFrame:
    """Density of ages by nativity; `binned` for values with a great many bars."""
    estimate = distribution.binned_density if binned else distribution.density
    return estimate(_numeric_ages(events, ["nativity"], year), ["nativity"], "age_years")


def condition_prevalence(records: DataFrame, field: str = "record_axis_raw") -> DataFrame:
    """Share of the raw records of each nativity that carry each packed code."""
    grouped = records.selectExpr(
        f"{recodes.event_nativity('state_country_birth_recode')} AS nativity", field
    )
    return packed.code_prevalence(_known(grouped, "nativity"), field, ["nativity"])


# --- all causes -------------------------------------------------------------------


def homicide_share(deaths: DataFrame) -> DataFrame:
    table = shares.part_of_all(
        _known(deaths, "nativity"), ["data_year", "nativity"], F.col("cause").isin(codes.HOMICIDE_CAUSES)
    )
    return table.withColumnsRenamed(
        {"total": "total_deaths", "part": "homicide_deaths", "pct": "pct_homicide"}
    )


def top_causes(deaths: DataFrame, k: int = codes.TOP_CAUSES) -> DataFrame:
    """The k leading causes of each group with ties; percentages are of all causes."""
    cells = count_events(_known(deaths, "nativity"), ["nativity", "cause"])
    leading = shares.top_k(cells, ["nativity"], k)
    leading = shares.share_within(cells, ["nativity"], shown=leading)
    return leading.select(
        "nativity", "cause", F.expr(recodes.cause_label("cause")).alias("cause_label"), "n", "pct"
    )


def standard_coverage(events: DataFrame, keys: list[str], weights: list[tuple[str, float]] = codes.STANDARD_WEIGHTS) -> DataFrame:
    """(keys, n_ages, weight, whole): the weights of the ages that have events, added up, and whether that is 1.

    Where it is not, rates anchored by events leave out a part of the standard population.
    """
    age = rates.AGE
    seen = events.filter(F.col(age) != codes.AGE_UNKNOWN).select(*keys, age).distinct()
    own = seen.withColumn("weight", F.expr(recodes.label_of(age, weights)).cast("double"))
    summed = own.groupBy(*keys).agg(F.count("weight").alias("n_ages"), F.sum("weight").alias("weight"))
    return summed.withColumn("whole", F.abs(F.col("weight") - 1) < 1e-6)


# --- panels and comparisons ---------------------------------------------------------------------------


def state_year_panel(events: DataFrame, persons: DataFrame, rate: str = "age_adjusted_rate") -> DataFrame:
    """(state, data_year, native_rate, foreign_share) of every state-year with native events.

    `rate` is "age_adjusted_rate" (of the state-years with native events of known
    age) or "crude_rate". Rate and share are read off the same cells; the share
    counts everyone, unknown nativity and age included, and is null where a weight
    is unknown.
    """
    counted = {"age_adjusted_rate": "n_known_age", "crude_rate": "n"}[rate]
    keys = ["state", "data_year"]
    fine = merge_cells(events, persons, [*keys, "nativity", "age_group"])
    table = rates.crude_and_adjusted(
        fine, [*keys, "nativity"], groups_without_events=True, whole_pop="everyone"
    )
    return (
        table.groupBy(*keys)
        .agg(
            _of("nativity", "native", counted).alias("native_n"),
            _of("nativity", "native", rate).alias("native_rate"),
            F.coalesce(_of("nativity", "foreign", "everyone"), F.lit(0.0)).alias("foreign_pop"),
            F.sum("everyone").alias("total_pop"),
        )
        .filter(F.col("native_n").isNotNull())
        .select(
            *keys,
            "native_rate",
            percent(rates.known(F.col("foreign_pop")), rates.known(F.col("total_pop"))).alias("foreign_share"),
        )
    )


def external_share(status: DataFrame, wanted: str) -> DataFrame:
    """(state, status_pop, status_n, total_pop, status_share) from a population-by-status table."""
    is_wanted = F.col("immig_status") == wanted
    return (
        status.groupBy(F.col("state_abb").alias("state"))
        .agg(
            F.sum(F.when(is_wanted, F.col("population"))).alias("status_pop"),
            F.sum(F.when(is_wanted, F.col("n"))).alias("status_n"),
            F.sum("population").alias("total_pop"),
        )
        .filter(F.col("status_pop").isNotNull())
        .withColumn("status_share", percent(F.col("status_pop"), F.col("total_pop")))
    )


def native_rate_by_external_share(
    events: DataFrame, persons: DataFrame, status: DataFrame, wanted: str, year: int
) -> DataFrame:
    """Native rates of each state next to its population of one status.

    `status_share` is of the whole status table, `share_of_native` of the native
    population in the rate.
    """
    cells = _group_cells(events, persons, "native", ["state", "age_group"], year)
    native = rates.standardise(cells, ["state"], "events")
    joined = native.join(external_share(status, wanted), "state", "left")
    return joined.withColumn("share_of_native", percent(F.col("status_pop"), F.col("pop")))


def native_crude_by_external_share(
    events: DataFrame, persons: DataFrame, status: DataFrame, wanted: str, year: int
) -> DataFrame:
    """Crude native rate of each state, all ages, next to its population of one status."""
    crude = rates.crude_rate(_group_cells(events, persons, "native", ["state"], year), ["state"])
    return crude.join(external_share(status, wanted), "state", "left")


def native_rate_by_foreign_share(events: DataFrame, persons: DataFrame, year: int) -> DataFrame:
    """Native rates of each state (see `adjusted_by_state`) next to its foreign share.

    Rates and population shares come off one set of cells by group.
    """
    keys = ["state", "nativity"]
    values = ["n", "pop", "crude_rate", "age_adjusted_rate"]
    cells = _cells(events, persons, [*keys, "age_group"], [], year)
    table = rates.standardise(cells, keys, "exposure", whole_pop="everyone")
    joined = (
        table.withColumn("rates", F.struct(*values))
        .groupBy("state")
        .agg(
            _of("nativity", "native", "rates").alias("native"),
            F.coalesce(_of("nativity", "foreign", "everyone"), F.lit(0.0)).alias("foreign_pop"),
            F.sum("everyone").alias("total_pop"),
        )
        .filter(F.col("native.n").isNotNull())
        .select(
            "state", "native.*", rates.known(F.col("foreign_pop")).alias("foreign_pop"),
            rates.known(F.col("total_pop")).alias("total_pop"),
        )
    )
    shown = rates.suppress(joined, ["crude_rate", "age_adjusted_rate"], flag="suppressed")
    return shown.withColumn("foreign_share", percent(F.col("foreign_pop"), F.col("total_pop")))


def compare_groups(events: DataFrame, persons: DataFrame, year: int) -> DataFrame:
    """(state, native_rate, foreign_rate) where neither is suppressed or missing."""
    keys = ["state", "nativity"]
    table = rates.suppress(
        state_nativity_rates(events, persons, year, anchor="exposure"), ["age_adjusted_rate"]
    )
    wide = shares.widen(table, ["state"], "nativity", NATIVITY, {"age_adjusted_rate": ""})
    return _known(wide, "state", *NATIVITY).select(
        "state", F.col("native").alias("native_rate"), F.col("foreign").alias("foreign_rate")
    )


def panel_fit(table: DataFrame, errors: str = "iid", counted_effects: str | None = None) -> DataFrame:
    return panel.two_way_fit(
        table, "state", "data_year", "native_rate", "foreign_share", errors, counted_effects
    )


def panel_residuals(table: DataFrame) -> DataFrame:
    return panel.two_way_residuals(table, "state", "data_year", "native_rate", "foreign_share")
