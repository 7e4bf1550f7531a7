"""Standardised rates of random cells against a plain loop."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratecube.operators import cells as cell_ops
from ratecube.operators import rates

WEIGHTS = {"01": 0.25, "02": 0.75}
AGES = st.sampled_from(["01", "02", "12", None])
GROUPS = st.sampled_from(["a", "b"])
EVENTS = st.lists(st.tuples(GROUPS, AGES), min_size=1, max_size=12)
PERSONS = st.lists(
    st.tuples(GROUPS, AGES, st.sampled_from([0.0, 1.0, 2.5, None])), min_size=1, max_size=12
)


def plain(events, persons, anchor):
    n, pop = {}, {}
    for cell in events:
        n[cell] = n.get(cell, 0) + 1
    for group, age, weight in persons:
        pop[group, age] = pop.get((group, age), 0.0) + (math.nan if weight is None else weight)
    start = n if anchor == "events" else pop
    result = {}
    for group, age in start:
        if age not in WEIGHTS:
            continue
        count, people = n.get((group, age), 0), pop.get((group, age), math.nan)
        rate = count / people if people else math.nan
        total = result.setdefault(group, [0, 0.0, 0.0])
        total[0] += count
        total[1] += people
        total[2] += rate * WEIGHTS[age]
    return {
        g: (c, None if math.isnan(p) else p, None if math.isnan(r) else pytest.approx(r))
        for g, (c, p, r) in result.items()
    }


@settings(max_examples=12, deadline=None)
@given(EVENTS, PERSONS, st.sampled_from(["events", "exposure"]))
def test_standardise(spark, events, persons, anchor):
    e = spark.createDataFrame([(*cell, 1) for cell in events], "g string, age_group string, n long")
    x = cell_ops.as_exposure(
        spark.createDataFrame(persons, "g string, age_group string, perwt double")
    )
    table = rates.standardise(
        cell_ops.merge_cells(e, x, ["g", "age_group"]), ["g"], anchor, list(WEIGHTS.items()), per=1.0
    )
    got = {r["g"]: (r["n"], r["pop"], r["age_adjusted_rate"]) for r in table.collect()}
    assert got == plain(events, persons, anchor)
