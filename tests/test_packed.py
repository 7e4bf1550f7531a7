import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratecube.operators import packed

RECORDS = [
    (1, "a", "X954 S061 X954 "),
    (2, "a", ""),
    (3, "b", "     X954 "),
    (4, None, "\tA1\r\nX954"),
    (5, "b", None),
    (6, "b", "".join(f"C{i:03d} " for i in range(20))),
]


def table(spark):
    return spark.createDataFrame(RECORDS, "id long, g string, raw string")


def test_unpack_keeps_slot_numbers_and_repeats(spark, rows):
    long = packed.unpack_codes(table(spark), "raw", ["id"])
    got = rows(long)
    assert (1, 1, "X954") in got and (1, 3, "X954") in got
    assert [r for r in got if r[0] == 3] == [(3, 2, "X954")]
    assert [r for r in got if r[0] == 4] == [(4, 1, "A1"), (4, 2, "X954")]
    assert len([r for r in got if r[0] == 6]) == 20
    assert not [r for r in got if r[0] in (2, 5)]


def test_frequency_counts_mentions_over_all_records(spark):
    got = {r["condition_code"]: (r["n"], r["total_records"], r["pct_of_records"]) for r in packed.code_frequency(table(spark), "raw").collect()}
    assert got["X954"] == (4, 6, pytest.approx(4 / 6 * 100))
    assert got["A1"] == (1, 6, pytest.approx(100 / 6))
    assert len(got) == 3 + 20


def test_prevalence_counts_each_record_once(spark):
    got = {
        (r["g"], r["condition_code"]): (r["n"], r["total_records"])
        for r in packed.code_prevalence(table(spark), "raw", ["g"]).collect()
    }
    assert got["a", "X954"] == (1, 2)
    assert got["b", "X954"] == (1, 3)
    assert got[None, "X954"] == (1, 1)
    assert got["b", "C019"] == (1, 3)


def test_prevalence_scans_once(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    result = packed.code_prevalence(spark.read.parquet(str(tmp_path / "t")), "raw", ["g"])
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_long_fields_are_cut_to_their_end(spark):
    text = "".join(f"{i:05d}" for i in range(30_000))
    records = spark.createDataFrame([(1, text)], "id long, raw string")
    long = packed.unpack_codes(records, "raw", ["id"])
    assert long.count() == 30_000
    assert long.filter("condition_slot = 30000").first()["condition_code"] == "29999"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="AZ09é ", max_size=12), min_size=1, max_size=8))
def test_slots_match_plain_slicing(spark, texts):
    records = spark.createDataFrame(list(enumerate(texts)), "id long, raw string")
    got = sorted(tuple(r) for r in packed.unpack_codes(records, "raw", ["id"]).collect())
    want = sorted(
        (i, k // 5 + 1, text[k : k + 5].strip(" \t\r\n"))
        for i, text in enumerate(texts)
        for k in range(0, len(text), 5)
        if text[k : k + 5].strip(" \t\r\n")
    )
    assert got == want
