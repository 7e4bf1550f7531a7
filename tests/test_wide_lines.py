"""Lines of many fields: cut in blocks, and in stages whose code is compiled."""

from ratecube.plans.catalog import catalog
from ratecube.session import COMPILED_BYTES
from ratecube.sources.fixed_width import BLOCK, _blocks, parse_either, parse_fixed_width
from ratecube.sources.layouts import layout_for

OLD, NEW = layout_for(2014), layout_for(2024)


def plain(line, field):
    if line is None:
        return None
    cut = line[field.start - 1 : field.end]
    cut = cut.rstrip(" ") if field.packed else cut.strip(" \t")
    return None if cut in ("", "NA") else cut


def lines():
    whole = "".join(chr(48 + i * 7 % 75) for i in range(817))
    wide = "".join("é𝄞ß中a"[i % 5] for i in range(817))
    return [whole, wide, whole[:100] + "\t NA  \t" + wide[:500], whole[:170], wide[:30], " " * 817, "", "NA", None]


def test_blocks_hold_each_field():
    for layout in (OLD, NEW):
        blocks = _blocks(layout)
        assert all(sum(a <= f.start and f.end <= z for a, z in blocks) == 1 for f in layout)
        assert all(z - a < max(BLOCK, 140) for a, z in blocks)


def test_wide_lines_are_cut_as_text(spark):
    table = spark.createDataFrame(list(enumerate(lines())), "i int, value string")
    for row in parse_fixed_width(table, OLD, ["i"]).collect():
        assert {f.name: row[f.name] for f in OLD} == {f.name: plain(lines()[row.i], f) for f in OLD}
    fields = {f.name for f in (*OLD, *NEW)}
    parsed = parse_either(table, "i % 2 = 0", (OLD, NEW), ["i"])
    assert "__block" in parsed._jdf.queryExecution().analyzed().toString()
    for row in parsed.collect():
        own = {f.name: plain(lines()[row.i], f) for f in (NEW if row.i % 2 else OLD)}
        assert {name: row[name] for name in fields} == {name: own.get(name) for name in fields}


def test_extracts_run_in_compiled_stages(spark, tmp_path):
    """The stage that writes and cuts the lines had one method of 20,000 bytes, which HotSpot leaves to the interpreter."""
    option = "spark.sql.codegen.hugeMethodLimit"
    spark.createDataFrame([(1, 2)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 5L AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, TIMESTAMP_NTZ '1996-03-04' AS o_orderdate, '2-HIGH' AS o_orderpriority").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    line = "SELECT 5L AS l_orderkey, 3L AS l_partkey, 4L AS l_suppkey, {} AS l_linenumber, 9D AS l_quantity, '{}' AS l_returnflag, 'F' AS l_linestatus"
    spark.sql(" UNION ALL ".join(line.format(*x) for x in ((1, "R"), ("CAST(NULL AS INT)", "R"), (2, "N")))).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, n in (("event_extract", 2), ("all_cause_extract", 3), ("all_cause_rows_by_year", 1)):
        spark.conf.unset(option)
        table = catalog()[name](spark, str(tmp_path))
        assert int(spark.conf.get(option)) <= COMPILED_BYTES
        found = table.collect()
        assert len(found) == n
        if name == "event_extract":
            by_line = {r.l_linenumber: r for r in found}
            # A filler without a line number is null, and its digits are blank.
            assert by_line[None].month_of_death is None and by_line[None].cause_recode113 == "128"
            assert by_line[1].month_of_death == "26" and by_line[1].entity_axis_raw == "000000826"
