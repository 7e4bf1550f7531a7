"""Panels (one row per unit and time): two-way fixed effects, fits, correlation.

The regression is the partialled-out form: both variables are cleaned of unit
and time effects, and the slope, its errors and the residual table come from the
cleaned columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ratecube.functions.student import critical_t_of, two_sided_p_of
from ratecube.session import kept


def complete_rows(panel: DataFrame, unit: str, time: str, y: str, x: str) -> DataFrame:
    return panel.select(
        F.col(unit), F.col(time), F.col(y).cast("double").alias(y), F.col(x).cast("double").alias(x)
    ).dropna()


def _with_means(rows: DataFrame, key: str, values: list[str], suffix: str) -> DataFrame:
    means = rows.groupBy(key).agg(*[F.avg(v).alias(f"{v}__{suffix}") for v in values])
    return rows.join(means, key)


#: The solver stops when what is left is so small against the start, or against the values themselves.
TOLERANCE, FLOOR = 1e-12, 1e-14
MOST_STEPS = 1000


def _period_effects(rows: DataFrame, unit: str, time: str, y: str, x: str) -> DataFrame:
    """(period, effect_y, effect_x): least-squares effects of the periods, both variables at once.

    With the unit means taken off, the normal matrix of the periods is S = diag(n(t)) - sum over u of n(u, s) n(u, t) / n(u).
    It is never formed: conjugate gradients need S p only, which is one sum by unit and one by period of the cells
    (unit, period, n). So neither units nor periods are bounded. Two numbers for each variable come to the driver a
    step; vectors stay tables, one row for each period, written once a step. A panel of which every unit has all
    periods takes one step. Raises if TOLERANCE is not met after MOST_STEPS steps.
    """
    cells = rows.groupBy(F.col(unit).alias("unit"), F.col(time).cast("string").alias("period")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("y"), F.sum(x).alias("x")
    )
    units = cells.groupBy("unit").agg(F.sum("n").alias("unit_n"), F.sum("y").alias("unit_y"), F.sum("x").alias("unit_x"))
    own = kept(cells.join(units, "unit"), "panel-cells")
    part = F.col("n") / F.col("unit_n")
    start = own.groupBy("period").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(v) - part * F.col(f"unit_{v}")).alias(f"r_{v}") for v in "yx"]
    )
    state = start.select("period", "n", *[c for v in "yx" for c in (F.lit(0.0).alias(f"effect_{v}"), F.col(f"r_{v}"), (F.col(f"r_{v}") / F.col("n")).alias(f"p_{v}"))])
    state = kept(state, "panel-periods")
    left, scale = _sizes(state), rows.agg(*[F.sqrt(F.sum(F.col(v) * F.col(v))).alias(k) for v, k in ((y, "y"), (x, "x"))]).first()
    goal = {v: max(TOLERANCE * left[v] ** 0.5, FLOOR * (scale[v] or 0.0)) for v in "yx"}
    for step in range(MOST_STEPS + 1):
        live = [v for v in "yx" if left[v] ** 0.5 > goal[v]]
        if not live:
            return state.select("period", "effect_y", "effect_x")
        if step == MOST_STEPS:
            raise ArithmeticError(f"period effects not found in {MOST_STEPS} steps")
        seen, moved = Observation(), own.select("unit", "period", "n", "unit_n").join(state.select("period", *[f"p_{v}" for v in live]), "period")
        means = moved.groupBy("unit").agg(*[F.sum(F.col("n") / F.col("unit_n") * F.col(f"p_{v}")).alias(f"m_{v}") for v in live])
        products = moved.join(means, "unit").groupBy("period").agg(*[F.sum(F.col("n") * (F.col(f"p_{v}") - F.col(f"m_{v}"))).alias(f"q_{v}") for v in live])
        counted = state.join(products, "period").observe(seen, *[F.sum(F.col(f"p_{v}") * F.col(f"q_{v}")).alias(v) for v in live])
        state = kept(counted, "panel-periods")
        ahead = {v: left[v] / seen.get[v] if seen.get[v] else 0.0 for v in live}
        state = state.withColumns({f"effect_{v}": F.col(f"effect_{v}") + ahead[v] * F.col(f"p_{v}") for v in live} | {f"r_{v}": F.col(f"r_{v}") - ahead[v] * F.col(f"q_{v}") for v in live})
        before, left = left, _sizes(state)
        state = state.withColumns({f"p_{v}": F.col(f"r_{v}") / F.col("n") + left[v] / before[v] * F.col(f"p_{v}") for v in live}).drop(*[f"q_{v}" for v in live])


def _sizes(state: DataFrame) -> dict[str, float]:
    """What is left of both variables, in the measure that the solver makes smaller."""
    found = state.agg(*[F.coalesce(F.sum(F.col(f"r_{v}") * F.col(f"r_{v}") / F.col("n")), F.lit(0.0)).alias(v) for v in "yx"]).first()
    return {v: found[v] for v in "yx"}


def _clean(rows: DataFrame, unit: str, time: str, y: str, x: str) -> DataFrame:
    """Values less period effects, less what is left of the unit means."""
    effects = _period_effects(rows, unit, time, y, x)
    moved = rows.join(effects, F.col(time).cast("string") == F.col("period")).select(
        *rows.columns,
        (F.col(y) - F.col("effect_y")).alias(f"resid_{y}"),
        (F.col(x) - F.col("effect_x")).alias(f"resid_{x}"),
    )
    found = [f"resid_{y}", f"resid_{x}"]
    centred = _with_means(moved, unit, found, "unit")
    return centred.select(*rows.columns, *[(F.col(c) - F.col(f"{c}__unit")).alias(c) for c in found])


def two_way_residuals(panel: DataFrame, unit: str, time: str, y: str, x: str) -> DataFrame:
    """(unit, time, y, x, resid_y, resid_x): y and x free of unit and time effects, for any panel.

    The panel is computed and written once, whatever it is made of.
    """
    return _clean(kept(complete_rows(panel, unit, time, y, x), "panel"), unit, time, y, x)


def two_way_fit(
    panel: DataFrame,
    unit: str,
    time: str,
    y: str,
    x: str,
    errors: str = "iid",
    counted_effects: str | None = None,
) -> DataFrame:
    """One row: estimate, std_error, t_value, p_value, n_obs, n_units, df.

    ``errors="cluster"`` clusters on the unit. `counted_effects` says which fixed
    effects use up degrees of freedom: "full" (all), "nested" (not those nested
    in the clusters, that is not the units) or "none". The default is "full" for
    independent errors and "nested" for clustered ones.
    """
    if errors not in ("iid", "cluster"):
        raise ValueError(f"errors must be 'iid' or 'cluster', not {errors!r}")
    counted = counted_effects or ("full" if errors == "iid" else "nested")
    rows = kept(complete_rows(panel, unit, time, y, x), "panel")
    times = rows.agg(F.count_distinct(F.col(time).cast("string")).alias("n_times"))
    clean = _clean(rows, unit, time, y, x).select(
        F.col(unit).alias("unit"), F.col(time).alias("time"),
        F.col(f"resid_{y}").alias("ry"), F.col(f"resid_{x}").alias("rx"),
    )
    # The score of unit g is sum(rx * (ry - b * rx)) = sxy_g - b * sxx_g, so unit
    # sums suffice for slope and clustered errors alike.
    units = clean.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("rx") * F.col("ry")).alias("sxy"),
        F.sum(F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("ry") * F.col("ry")).alias("syy"),
    )
    sums = units.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_obs"),
        F.count(F.lit(1)).alias("n_units"),
        F.sum("sxy").alias("sxy"),
        F.sum("sxx").alias("sxx"),
        F.sum("syy").alias("syy"),
        F.sum(F.col("sxy") * F.col("sxy")).alias("gyy"),
        F.sum(F.col("sxy") * F.col("sxx")).alias("gxy"),
        F.sum(F.col("sxx") * F.col("sxx")).alias("gxx"),
    ).withColumn("n_times", F.lit(times.first().n_times))
    n, groups, b = F.col("n_obs"), F.col("n_units"), F.col("estimate")
    parameters = {
        "none": F.lit(1),
        "nested": 1 + F.col("n_times"),
        "full": F.col("n_times") + F.col("n_units"),
    }[counted]
    if errors == "iid":
        df = n - parameters
        residual = F.col("syy") - b * F.col("sxy")
        variance = F.try_divide(residual, df * F.col("sxx"))
    else:
        df = groups - 1
        small_sample = F.try_divide(groups * (n - 1), (groups - 1) * (n - parameters))
        score = F.col("gyy") - 2 * b * F.col("gxy") + b * b * F.col("gxx")
        variance = small_sample * F.try_divide(score, F.col("sxx") * F.col("sxx"))
    # A panel too small for its effects has no variance left: null, not an error.
    return (
        sums.withColumn("estimate", F.try_divide(F.col("sxy"), F.col("sxx")))
        .withColumns({"df": df.cast("long"), "std_error": F.sqrt(F.when(variance >= 0, variance))})
        .withColumn("t_value", F.try_divide(F.col("estimate"), F.col("std_error")))
        .select(
            "estimate", "std_error", "t_value",
            two_sided_p_of(F.col("t_value"), F.col("df")).alias("p_value"),
            "n_obs", "n_units", "df",
        )
    )


def pearson(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation over the rows where both are present."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return table.agg(F.corr(x, y).alias("r"), F.count(F.when(both, 1)).alias("n"))


def linear_fit(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares line of y on x with the sums a confidence band needs."""
    both = table.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    sums = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r_squared"),
        F.avg("x").alias("x_mean"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
    )
    residual = F.try_divide(F.col("syy") - F.col("slope") * F.col("sxy"), F.col("n") - 2)
    return sums.withColumn("residual_sd", F.sqrt(F.when(residual >= 0, residual))).drop("syy", "sxy")


def evenly_spaced(low: Column, high: Column, points: int) -> Column:
    """Array of `points` values from low to high."""
    step = (high - low) / F.lit(float(points - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + step * i.cast("double")
    )


def confidence_band(
    table: DataFrame, x: str, y: str, level: float = 0.95, points: int = 80
) -> DataFrame:
    """(x, fit, low, high): the fitted line and its band on an even grid over x."""
    fit = linear_fit(table, x, y).withColumn(
        "t", critical_t_of(F.lit(level), (F.col("n") - 2).cast("double"))
    )
    grid = fit.withColumn("at", F.explode(evenly_spaced(F.col("x_min"), F.col("x_max"), points)))
    distance = F.col("at") - F.col("x_mean")
    half = (
        F.col("t")
        * F.col("residual_sd")
        * F.sqrt(1.0 / F.col("n") + F.try_divide(distance * distance, F.col("sxx")))
    )
    line = F.col("intercept") + F.col("slope") * F.col("at")
    return grid.select(
        F.col("at").alias("x"), line.alias("fit"), (line - half).alias("low"), (line + half).alias("high")
    )
