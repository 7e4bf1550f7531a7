import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ratecube.operators import shares


def test_top_k_keeps_ties_at_the_last_rank(spark):
    counts = [20, 19, 18, 17, 16, 15, 14, 13, 12, 5, 5, 5, 1]
    cells = spark.createDataFrame(
        [("g", f"c{i:02d}", n) for i, n in enumerate(counts)] + [("h", "x", 1)], "g string, c string, n long"
    )
    top = shares.top_k(cells, ["g"], 10)
    assert top.filter("g = 'g'").count() == 12
    assert top.filter("g = 'h'").count() == 1


def test_top_k_equals_the_rank_on_random_counts(spark, rows):
    draw = random.Random(5)
    cells = spark.createDataFrame(
        [(draw.choice(["a", "b", None]), f"c{i}", draw.randrange(6)) for i in range(80)],
        "g string, c string, n long",
    )
    rank = F.rank().over(Window.partitionBy("g").orderBy(F.desc("n")))
    for k in (1, 3, 10, 100):
        want = cells.withColumn("r", rank).filter(F.col("r") <= k).drop("r")
        assert rows(shares.top_k(cells, ["g"], k)) == rows(want)


def test_top_k_cuts_before_the_shuffle_and_reads_the_cells_once(spark):
    cells = (
        spark.range(200).selectExpr("id % 3 AS g", "id % 31 AS c").groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"))
    )
    table = shares.top_k(cells, ["g"], 10)
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "ReusedExchange" in plan and plan.count("Range (") == 1


def test_shares_add_up_and_null_groups_have_their_own_total(spark, rows):
    cells = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 3), (None, "x", 2), (None, None, 2)], "g string, c string, n long"
    )
    table = shares.share_within(cells, ["g"])
    assert rows(table) == [("a", "x", 1, 25.0), ("a", "y", 3, 75.0), (None, "x", 2, 50.0), (None, None, 2, 50.0)]
    overall = shares.share_within(cells, [])
    assert rows(overall, "pct") == [(12.5,), (25.0,), (25.0,), (37.5,)]


def test_shares_read_the_cells_once(spark):
    cells = (
        spark.range(100).selectExpr("id % 3 AS g", "id % 7 AS c", "1L AS n").groupBy("g", "c").agg(F.sum("n").alias("n"))
    )
    table = shares.share_within(cells, ["g"])
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_percent_change_and_missing_year(spark, rows):
    table = spark.createDataFrame(
        [("a", 2014, 4.0), ("a", 2020, 9.0), ("a", 2024, 6.0), ("b", 2024, 1.0), ("z", 2014, 0.0), ("z", 2024, 1.0)],
        "m string, y int, v double",
    )
    change = shares.first_to_last(table, ["m"], "y", "v", 2014, 2024)
    assert rows(change) == [("a", 4.0, 6.0, 50.0), ("b", None, 1.0, None), ("z", 0.0, 1.0, None)]


def test_widen(spark, rows):
    table = spark.createDataFrame([("a", "n", 1.0, 2), ("a", "f", 3.0, 4), ("b", "n", 5.0, 6)], "k string, s string, r double, c long")
    wide = shares.widen(table, ["k"], "s", ["n", "f"], {"r": "rate_", "c": "count_"})
    assert wide.columns == ["k", "rate_n", "count_n", "rate_f", "count_f"]
    assert rows(wide) == [("a", 1.0, 2, 3.0, 4), ("b", 5.0, 6, None, None)]


def test_part_of_all_counts_null_codes_as_outside(spark):
    table = spark.createDataFrame([("g", "128", 2), ("g", None, 3), ("g", "001", 5)], "g string, c string, n long")
    row = shares.part_of_all(table, ["g"], F.col("c").isin("128", "129")).first()
    assert tuple(row) == ("g", 10, 2, pytest.approx(20.0))


def test_first_rows_sorts_nulls_last_in_both_directions(spark):
    table = spark.createDataFrame([("b", 2), ("a", 2), (None, 3), ("c", None)], "k string, n long")
    assert [tuple(r) for r in shares.first_rows(table, ["-n", "k"], 3).collect()] == [(None, 3), ("a", 2), ("b", 2)]
    assert [r["k"] for r in shares.first_rows(table, ["k"], 4).collect()] == ["a", "b", "c", None]
