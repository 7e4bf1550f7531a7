import math

import pytest
from pyspark.sql import functions as F

from ratecube.functions import codes
from ratecube.functions.measures import strict_sum
from ratecube.operators import cells as cell_ops
from ratecube.operators import rates

HALVES = [("01", 0.5), ("02", 0.5)]


def events(spark, data):
    return spark.createDataFrame(data, "g string, age_group string, n long")


def exposure(spark, data):
    table = spark.createDataFrame(data, "g string, age_group string, perwt double")
    return cell_ops.as_exposure(table)


def merged(spark, e, x):
    return cell_ops.merge_cells(events(spark, e), exposure(spark, x), ["g", "age_group"])


def standard(spark, e, x, anchor):
    table = rates.standardise(merged(spark, e, x), ["g"], anchor, weights=HALVES, per=100.0)
    return {r["g"]: (r["n"], r["pop"], r["crude_rate"], r["age_adjusted_rate"]) for r in table.collect()}


def test_worked_example(spark):
    cells = [("k", "01", 1), ("k", "02", 3)], [("k", "01", 10.0), ("k", "02", 60.0)]
    for anchor in ("events", "exposure"):
        n, pop, crude, adjusted = standard(spark, *cells, anchor)["k"]
        assert (n, pop) == (4, 70.0)
        assert crude == pytest.approx(4 / 70 * 100)
        assert adjusted == pytest.approx(7.5)


def test_anchors_differ_on_an_age_without_events(spark):
    cells = [("k", "02", 3)], [("k", "01", 10.0), ("k", "02", 60.0), ("idle", "01", 5.0)]
    by_events = standard(spark, *cells, "events")
    assert by_events == {"k": (3, 60.0, pytest.approx(5.0), pytest.approx(2.5))}
    by_exposure = standard(spark, *cells, "exposure")
    assert by_exposure["k"] == (3, 70.0, pytest.approx(3 / 70 * 100), pytest.approx(2.5))
    assert by_exposure["idle"] == (0, 5.0, 0.0, 0.0)


def test_age_without_population_makes_the_adjusted_rate_null(spark):
    cells = [("k", "01", 1), ("k", "02", 3)], [("k", "02", 60.0)]
    assert standard(spark, *cells, "events")["k"] == (4, None, None, None)
    assert standard(spark, *cells, "exposure")["k"] == (3, 60.0, pytest.approx(5.0), pytest.approx(2.5))


def test_unknown_weight_and_zero_population_give_null_rates(spark):
    assert standard(spark, [("k", "01", 1)], [("k", "01", 1.0), ("k", "01", None)], "exposure")["k"] == (1, None, None, None)
    n, pop, crude, adjusted = standard(spark, [("k", "01", 1)], [("k", "01", 0.0)], "exposure")["k"]
    assert (n, pop, crude, adjusted) == (1, 0.0, None, None)


def test_unknown_ages_stay_out_of_the_standardised_rate_only(spark):
    e = [("k", "01", 1), ("k", codes.AGE_UNKNOWN, 5), ("k", None, 2), ("only", codes.AGE_UNKNOWN, 4)]
    x = [("k", "01", 10.0), ("k", None, 7.0)]
    assert standard(spark, e, x, "events") == {"k": (1, 10.0, pytest.approx(10.0), pytest.approx(5.0))}
    both = rates.crude_and_adjusted(merged(spark, e, x), ["g"], weights=HALVES, per=100.0)
    got = {r["g"]: tuple(r)[1:] for r in both.collect()}
    assert got["k"] == (8, 17.0, pytest.approx(8 / 17 * 100), pytest.approx(5.0), 1)
    assert got["only"] == (4, None, None, None, None)


def test_null_keys_meet_as_equals(spark, rows):
    table = merged(spark, [(None, "01", 2)], [(None, "01", 8.0)])
    assert rows(table, "g", "n", "pop") == [(None, 2, 8.0)]


def test_crude_rate_keeps_events_without_population(spark, rows):
    table = rates.crude_rate(merged(spark, [("a", "01", 2), ("b", "01", 1)], [("a", "02", 4.0), ("c", "01", 1.0)]), ["g"])
    assert rows(table) == [("a", 2, 4.0, 50000.0), ("b", 1, None, None)]


def test_suppression_starts_below_ten(spark, rows):
    table = spark.createDataFrame([(0, 1.0), (9, 1.0), (10, 1.0), (11, None)], "n long, rate double")
    hidden = rates.suppress(table, ["rate"], flag="suppressed")
    assert rows(hidden, "n", "rate", "suppressed") == [
        (0, None, True), (10, 1.0, False), (11, None, False), (9, None, True),
    ]


def test_weights_must_add_up_to_one(spark):
    assert math.isclose(sum(w for _, w in codes.STANDARD_WEIGHTS), 1, abs_tol=1e-6)
    with pytest.raises(ValueError):
        rates.check_weights([("01", 0.5)])
    with pytest.raises(ValueError):
        rates.standardise(merged(spark, [("k", "01", 1)], [("k", "01", 1.0)]), ["g"], "both")


def test_standard_population_has_equal_crude_and_adjusted_rates(spark):
    e = [("k", code, 10 + i) for i, (code, _) in enumerate(codes.STANDARD_WEIGHTS)]
    x = [("k", code, weight * 1e6) for code, weight in codes.STANDARD_WEIGHTS]
    row = rates.standardise(merged(spark, e, x), ["g"]).first()
    assert row["crude_rate"] == pytest.approx(row["age_adjusted_rate"])


def test_result_does_not_depend_on_partitions(spark, rows):
    e = [("a", "01", i) for i in range(50)] + [("b", "02", 3)]
    x = [("a", "01", 100.0), ("b", "02", 50.0)]
    def table(parts):
        cells = cell_ops.merge_cells(
            events(spark, e).repartition(parts), exposure(spark, x).repartition(parts), ["g", "age_group"]
        )
        return rows(rates.standardise(cells, ["g"], weights=HALVES))

    assert table(1) == table(7)


def test_subtotal_is_the_sum_of_its_parts_and_counts_null_parts(spark, rows):
    cells = spark.createDataFrame(
        [("y", "a", 1, 2.0), ("y", "b", 3, 4.0), ("y", None, 5, 6.0)], "t string, g string, n long, pop double"
    )
    table = cell_ops.with_subtotal(cells, ["t", "g"], "g", "all")
    assert rows(table, "g", "n", "pop") == [("a", 1, 2.0), ("all", 9, 12.0), ("b", 3, 4.0), (None, 5, 6.0)]


def test_strict_sum(spark, rows):
    table = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "g string, v double")
    assert rows(table.groupBy("g").agg(strict_sum(F.col("v")))) == [("a", None), ("b", 5.0)]


def test_merge_shuffles_once_and_after_partial_sums(spark):
    plan = merged(spark, [("k", "01", 1)], [("k", "01", 1.0)])._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning")
    assert "partial_sum" in below and "partial_sum" not in above
