"""Sources and sinks over the star-schema tables: what is written is read back, and results come off that.

Files go to folders of their own under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecube.functions import codes
from ratecube.operators import lookups, quantiles, rates
from ratecube.plans import publish, reports, star
from ratecube.plans.labels import label_events, label_persons
from ratecube.session import scratch_path
from ratecube.sources import codebook, deaths, fixed_width, persons, tables
from ratecube.sources.layouts import Field, layout_for, narrow

#: Layout of the survey persons that `codebook_persons` writes, weights with two implied decimals; and value labels.
PERSONS = [
    Field("year", 1, 4, type="int"),
    Field("perwt", 5, 14, type="double", scale=2),
    Field("sex", 15, 15, type="int"),
    Field("age", 16, 18, type="int"),
    Field("marst", 19, 19, type="int"),
    Field("race", 20, 20, type="int"),
    Field("bpl", 21, 25, type="int"),
]
LABELS = {"sex": {"1": "Male", "2": "Female", "9": "Missing"}, "marst": {"1": "Married & present", "6": "Never <married>"}}


def codebook_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons written as fixed-width lines with a codebook, and read by that codebook; weights by group, with value labels."""
    lines, book = scratch_path(spark, "persons"), scratch_path(spark, "codebook")
    people = star.persons(spark, sf_dir, with_state=False).withColumn("perwt", F.col("perwt") + 0.25)
    fixed_width.write_fixed_width(people, PERSONS, lines)
    spark.createDataFrame([(codebook.codebook_xml(PERSONS, LABELS),)], "value string").coalesce(1).write.text(book)
    table = persons.read_persons_by_codebook(spark, [lines], book)
    labels = codebook.value_labels(spark, book)
    for name in LABELS:
        table = codebook.labelled(table, labels, name)
    keys = ["year", "sex", "sex_label", "marst", "marst_label", "race"]
    sums = [F.count(F.lit(1)).alias("n"), F.sum("perwt").alias("pop"), F.sum("age").alias("years"), F.count("age").alias("n_age")]
    return table.groupBy(*keys).agg(*sums)


def byte_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of every document line at byte positions, decoded as Latin-1."""
    fields = narrow(layout_for(2014), ["state_occ_fips", "state_res_fips", "detail_age"])
    return fixed_width.parse_fixed_width(star.document_lines(spark, sf_dir), fields, ["doc_id", "line_no"], charset="ISO-8859-1")


def audited_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that the scan itself took while the extract of homicides was written."""
    layouts = layout_for(2014), layout_for(2024)
    parts, audits = [], []
    for lines, layout, year in zip(star.record_lines(spark, sf_dir, *layouts), layouts, (star.FIRST_YEAR, 2021), strict=True):
        part, seen = deaths.observed_homicides(lines.select("value"), layout, f"from{year}")
        parts.append(part)
        audits.append((year, seen))
    tables.write_extract(fixed_width.union_by_name(parts), scratch_path(spark, "extract"))
    return deaths.audit_table(spark, audits)


def _deaths(spark: SparkSession, sf_dir: str, years: tuple[int, int]) -> DataFrame:
    table = star.death_records(spark, sf_dir, homicides_only=False, years=years)
    return table.withColumn("is_homicide", F.col("cause_recode113").isin(*codes.HOMICIDE_CAUSES))


def added_year_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted rates off the cubes of a study to which its last year was added."""
    out, last = scratch_path(spark, "study"), star.LAST_YEAR
    early, late = (star.FIRST_YEAR, last - 1), (last, last)
    publish.study(_deaths(spark, sf_dir, early), star.persons(spark, sf_dir, early), out)
    whole = publish.study(_deaths(spark, sf_dir, late), star.persons(spark, sf_dir, late), out, add=True)
    return reports.adjusted_by_nativity(whole.events, whole.persons)


def rates_off_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted rates off cells stored by year and nativity: the report itself shuffles nothing."""
    keys = ["data_year", "nativity"]
    events, people = label_events(star.death_records(spark, sf_dir)), label_persons(star.persons(spark, sf_dir, with_state=False))
    name = f"rate_cells_{uuid.uuid4().hex}"
    cells = tables.write_bucketed(reports.nativity_age_cells(events, people), name, scratch_path(spark, name), keys)
    return rates.standardise(cells, keys, "events")


def checked_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State-year counts through a CSV to which broken lines were added: the good rows, each with the number of bad lines."""
    path = scratch_path(spark, "counts")
    events = label_events(star.death_records(spark, sf_dir))
    tables.write_result(reports.events_by(events, ["data_year", "state"]), path, ["data_year", "state"])
    broken = spark.createDataFrame([("data_year,state,n",), ("2020,AL",), ("2020,AK,x",), ("2021,AZ,3,4",)], "value string")
    broken.coalesce(1).write.mode("append").text(path)
    good, bad = tables.read_csv_checked(spark, path, "data_year int, state string, n long")
    return good.withColumn("n_bad", F.lit(bad.count()))


def weight_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of the standard population the ages with events stand for, by year and nativity; 1 where it is whole."""
    events = label_events(star.death_records(spark, sf_dir))
    return reports.standard_coverage(events, ["data_year", "nativity"])


def ranges_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by price-like ranges from a table: keys of customers, ten to a range, found by binary search."""
    customers = star.table(spark, sf_dir, "customer")
    ranges = customers.filter("c_custkey % 10 = 0").selectExpr("c_custkey - 4 AS low", "c_custkey + 3 AS high", "c_custkey AS centre")
    orders = star.table(spark, sf_dir, "orders").select("o_custkey")
    found = lookups.label_by_range(orders, "o_custkey", ranges, "low", "high", "centre")
    named = lookups.label_by_code(found, "centre", customers, "c_custkey", "c_nationkey")
    return named.groupBy("centre", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


def wide_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median order key by nation and line number: as many distinct values as orders."""
    lines = star.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_quantity")
    value = lines.withColumn("v", F.col("l_orderkey") * F.lit(1.25) - F.col("l_quantity"))
    halves = [quantiles.exact_quantile(value, ["l_linenumber"], "v", share).withColumn("share", F.lit(share)) for share in (0.5, 0.9)]
    return reduce(DataFrame.unionByName, halves)


ROUND_TRIPS = {
    "codebook_persons": codebook_persons,
    "byte_scan": byte_scan,
    "audited_extract": audited_extract,
    "added_year_rates": added_year_rates,
    "rates_off_buckets": rates_off_buckets,
    "checked_csv": checked_csv,
    "weight_coverage": weight_coverage,
    "ranges_by_table": ranges_by_table,
    "wide_medians": wide_medians,
}
