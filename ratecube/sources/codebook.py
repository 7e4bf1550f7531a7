"""Codebooks of fixed-width microdata, in the XML of the Data Documentation Initiative.

A codebook describes each variable in a `var` element: its name, the characters of a line that hold it, whether
it is numeric, how many decimal places are implied, and labels of its values. The elements are read by Spark's
XML source under an explicit schema, a row each. The layout comes to the driver, some hundred rows that become
expressions; value labels stay a table, as a codebook of occupations or places may have any number of them.
"""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecube.sources.layouts import Field

VARIABLE = (
    "_ID string, _name string, _dcml int, location array<struct<_StartPos: int, _EndPos: int, _width: int>>, labl array<string>, "
    "catgry array<struct<catValu: string, labl: array<string>>>, varFormat struct<_type: string>"
)


def variables(spark: SparkSession, path: str) -> DataFrame:
    """One row for each variable of a codebook, as the XML has it."""
    return spark.read.format("xml").option("rowTag", "var").option("nullValue", "").schema(VARIABLE).load(path)


def described(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, end, type, scale, label) of each variable; names in lower case.

    Numbers with implied decimal places are doubles, others are whole numbers as wide as their field, and beyond
    18 digits decimals. A variable with several places in a line has one row for each, named after its place.
    """
    places = variables(spark, path).select("*", F.posexplode("location").alias("at", "place"))
    width = F.col("place._EndPos") - F.col("place._StartPos") + 1
    numeric = F.coalesce(F.lower("varFormat._type") == "numeric", F.lit(False))
    whole = F.when(width <= 9, "int").when(width <= 18, "bigint").when(width <= 38, "decimal(38,0)").otherwise("string")
    scale = F.coalesce(F.col("_dcml"), F.lit(0))
    name = F.lower(F.coalesce("_name", "_ID"))
    return places.select(
        F.when(F.col("at") > 0, F.concat_ws("_", name, (F.col("at") + 1).cast("string"))).otherwise(name).alias("name"),
        F.col("place._StartPos").alias("start"),
        F.col("place._EndPos").alias("end"),
        F.when(~numeric, "string").when(scale > 0, "double").otherwise(whole).alias("type"),
        F.when(numeric, scale).otherwise(F.lit(0)).alias("scale"),
        F.get("labl", F.lit(0)).alias("label"),
    )


def value_labels(spark: SparkSession, path: str) -> DataFrame:
    """(name, code, label) of every labelled value, the code as the codebook writes it."""
    rows = variables(spark, path).select(F.lower(F.coalesce("_name", "_ID")).alias("name"), F.explode("catgry").alias("c"))
    return rows.select("name", F.col("c.catValu").alias("code"), F.get("c.labl", F.lit(0)).alias("label"))


def read_codebook(spark: SparkSession, path: str, names: list[str] | None = None) -> list[Field]:
    """The layout that a codebook describes, in the order of positions; of the variables in `names`, if given.

    A codebook without a variable, one with a place that makes no sense, and a name that it lacks are errors.
    """
    rows = described(spark, path).orderBy("start", "end").collect()
    if not rows:
        raise ValueError(f"no variable in {path}")
    if bad := [r.name for r in rows if not (r.name and r.start and r.end and 1 <= r.start <= r.end)]:
        raise ValueError(f"variables without a place in {path}: {bad}")
    layout = [Field(r.name, r.start, r.end, type=r.type, scale=r.scale) for r in rows]
    if names is None:
        return layout
    by_name = {field.name: field for field in layout}
    if missing := [n for n in names if n.lower() not in by_name]:
        raise ValueError(f"not in {path}: {missing}")
    return [by_name[n.lower()] for n in names]


def labelled(table: DataFrame, labels: DataFrame, name: str, into: str | None = None) -> DataFrame:
    """`table` with the label of the values of column `name`; null where there is none.

    Codes of numeric variables meet by value, so that "01" labels 1. The labels join as a table of their own:
    Spark broadcasts them if they are small, and shuffles otherwise.
    """
    kind = dict(table.dtypes)[name]
    code = F.col("code") if kind == "string" else F.col("code").try_cast(kind)
    own = labels.filter(F.col("name") == name).select(code.alias("__code"), F.col("label").alias(into or f"{name}_label"))
    own = own.filter(F.col("__code").isNotNull()).dropDuplicates(["__code"])
    return table.join(own, F.col(name) == F.col("__code"), "left").drop("__code")


def codebook_xml(layout: list[Field], labels: dict[str, dict[str, str]] | None = None) -> str:
    """A codebook of a layout, the reverse of `read_codebook`; `labels` has those of values by variable."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<codeBook xmlns="ddi:codebook:2_5" version="2.5">', "<dataDscr>"]
    for f in layout:
        out.append(f'<var ID={quoteattr(f.name.upper())} name={quoteattr(f.name.upper())} dcml="{f.scale}">')
        out.append(f'<location StartPos="{f.start}" EndPos="{f.end}" width="{f.end - f.start + 1}"/>')
        out.append(f"<labl>{escape(f.name)}</labl>")
        for code, label in (labels or {}).get(f.name, {}).items():
            out.append(f"<catgry><catValu>{escape(code)}</catValu><labl>{escape(label)}</labl></catgry>")
        out.append(f'<varFormat type="{"character" if f.type == "string" else "numeric"}"/>')
        out.append("</var>")
    return "\n".join([*out, "</dataDscr>", "</codeBook>"])
