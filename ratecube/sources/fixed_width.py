"""Fixed-width text: lines to columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecube.functions.recodes import is_in, literal
from ratecube.session import compiled_stages
from ratecube.sources.layouts import Field

LINE = "value"
MISSING = ["", "NA"]  # fixed values: field contents read as null
BLANKS = " \t"
#: Two layouts with more fields are cut in two steps, first into blocks of so many characters.
FEW_FIELDS = 6
BLOCK = 64


def trimmed_slice(field: Field, line: str = LINE, charset: str | None = None) -> str:
    """SQL text of a field's part of a line, trimmed. Packed fields keep their leading
    blanks, so that a blank first slot does not shift the others.

    Without a charset, positions count characters. With one they count bytes, as layouts of
    files do, and what is cut is decoded: "UTF-8" (a cut character gives replacement
    characters) or "ISO-8859-1".
    """
    at = f"{field.start}, {field.end - field.start + 1}"
    if charset is None:
        cut = f"substring({line}, {at})"
    elif charset.upper() == "UTF-8":
        cut = f"make_valid_utf8(CAST(substring(CAST({line} AS BINARY), {at}) AS STRING))"
    else:
        cut = f"decode(substring(CAST({line} AS BINARY), {at}), {literal(charset)})"
    return f"rtrim({cut})" if field.packed else f"btrim({cut}, {literal(BLANKS)})"


def _typed(field: Field) -> str:
    value = f"CASE WHEN NOT {is_in(field.name, MISSING)} THEN {field.name} END"
    if field.type == "string":
        return value
    if field.scale:
        return f"CAST(try_cast({value} AS DOUBLE) / {10**field.scale} AS {field.type})"
    return f"try_cast({value} AS {field.type})"


def _blocks(fields: list[Field]) -> list[tuple[int, int]]:
    """First and last places of the parts of a line that hold the fields; each field lies within one part."""
    parts: list[tuple[int, int]] = []
    for f in sorted(fields, key=lambda f: (f.start, f.end)):
        if parts and (f.start <= parts[-1][1] or f.end < parts[-1][0] + BLOCK):
            parts[-1] = parts[-1][0], max(parts[-1][1], f.end)
        else:
            parts.append((f.start, f.end))
    return parts


def _in_blocks(
    lines: DataFrame, fields: list[Field], keep: list[str], line: str, charset: str | None
) -> tuple[DataFrame, Callable[[Field], str]]:
    """The lines in blocks next to `keep`, and the SQL text of a field's trimmed slice there.

    To find a character Spark walks the text from its start, for each field anew; within a block
    the way is short. Bytes are found without a walk, so lines of as many bytes as characters are
    cut into blocks by bytes. With a charset, or a few fields, there are no blocks.
    """
    if charset is not None or len(fields) <= FEW_FIELDS:
        return lines, lambda f: trimmed_slice(f, line, charset)
    compiled_stages(lines.sparkSession)
    blocks = _blocks(fields)
    plain = lines.selectExpr("*", f"octet_length({line}) = length({line}) AS __plain")
    at = [(a, f"{a}, {z - a + 1}") for a, z in blocks]
    either = "CASE WHEN __plain THEN CAST(substring(CAST({0} AS BINARY), {1}) AS STRING) ELSE substring({0}, {1}) END AS __block{2}"
    cut = plain.selectExpr(*keep, *[either.format(line, places, a) for a, places in at])

    def sliced(f: Field) -> str:
        (first,) = [a for a, z in blocks if a <= f.start and f.end <= z]
        return trimmed_slice(f._replace(start=f.start - first + 1, end=f.end - first + 1), f"__block{first}")

    return cut, sliced


def parse_fixed_width(
    lines: DataFrame, layout: list[Field], keep: list[str] | None = None, line: str = LINE, charset: str | None = None
) -> DataFrame:
    """Slice `line` into the fields of `layout`, next to the columns in `keep`; `charset` as in `trimmed_slice`.

    Every field is an independent expression, so fields that are not used
    further on are pruned. Slices are cut in one projection and turned into
    values in the next: each is cut once although its value reads it twice.
    """
    keep = keep or []
    cut = lines.selectExpr(*keep, *[f"{trimmed_slice(f, line, charset)} AS {f.name}" for f in layout])
    return cut.selectExpr(*keep, *[f"{_typed(f)} AS {f.name}" for f in layout])


def either_of(name: str, test: str, layouts: tuple[list[Field], list[Field]], sliced: Callable[[Field], str]) -> str:
    """SQL text of what `sliced` gives for a field of the first layout where `test` holds, else of the second.

    A field that stands at one place in both is cut without looking; one that a layout lacks is null there.
    """
    cuts = ["NULL" if f is None else sliced(f) for f in (next((f for f in x if f.name == name), None) for x in layouts)]
    return cuts[0] if cuts[0] == cuts[1] else f"CASE WHEN {test} THEN {cuts[0]} ELSE {cuts[1]} END"


def either_slice(name: str, test: str, layouts: tuple[list[Field], list[Field]], line: str, charset: str | None = None) -> str:
    """SQL text of a field's part of a line that has the first layout where `test` holds, else the second (see `either_of`)."""
    return either_of(name, test, layouts, lambda f: trimmed_slice(f, line, charset))


def parse_either(
    lines: DataFrame, test: str, layouts: tuple[list[Field], list[Field]], keep: list[str] | None = None, line: str = LINE, charset: str | None = None
) -> DataFrame:
    """`parse_fixed_width` of lines of two layouts in one table, so that one scan serves both; many fields are cut from blocks."""
    keep = keep or []
    fields = list({f.name: f for layout in layouts for f in layout}.values())
    tested = lines.selectExpr("*", f"{test} AS __first")
    places = list({(f.start, f.end): f for layout in layouts for f in layout}.values())
    blocks, sliced = _in_blocks(tested, places, [*keep, "__first"], line, charset)
    cut = blocks.selectExpr(*keep, *[f"{either_of(f.name, '__first', layouts, sliced)} AS {f.name}" for f in fields])
    return cut.selectExpr(*keep, *[f"{_typed(f)} AS {f.name}" for f in fields])


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths)


def scan_fixed_width(spark: SparkSession, paths: list[str], layout: list[Field], charset: str | None = "UTF-8") -> DataFrame:
    """The records of files; positions count bytes, as Spark's text source hands on the bytes of a line as they are."""
    return parse_fixed_width(read_lines(spark, paths), layout, charset=charset)


def fixed_width_lines(table: DataFrame, layout: list[Field]) -> DataFrame:
    """(value): a record line of each row, the reverse of `parse_fixed_width`.

    Text stands left and whole numbers right in their field; implied decimal places are rounded in. A value that is wider
    than its field raises, rather than move what follows. Null is blank.
    """
    parts, at = [], 1
    for f in sorted(layout, key=lambda f: f.start):
        width = f.end - f.start + 1
        text = f"CAST({f.name} AS STRING)" if not f.scale else f"CAST(CAST(round({f.name} * {10**f.scale}) AS BIGINT) AS STRING)"
        pad = "rpad" if f.type == "string" else "lpad"
        fits = f"CASE WHEN length({text}) > {width} THEN raise_error(concat({literal(f.name + ' is wider than its field: ')}, {text})) ELSE {text} END"
        parts += [literal(" " * (f.start - at)), f"{pad}(coalesce({fits}, ''), {width}, ' ')"]
        at = f.end + 1
    return table.selectExpr(f"concat({', '.join(parts)}) AS {LINE}")


def write_fixed_width(table: DataFrame, layout: list[Field], path: str) -> None:
    fixed_width_lines(table, layout).write.mode("overwrite").text(path)


def empty_of(spark: SparkSession, layout: list[Field]) -> DataFrame:
    """No rows, with the columns of a layout."""
    return spark.createDataFrame([], ", ".join(f"{f.name} {f.type}" for f in layout))


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """Stack tables by column name; a field that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def length_profile(lines: DataFrame, keys: list[str], line: str = LINE) -> DataFrame:
    """Number of lines of each length, over all lines rather than the first."""
    return lines.groupBy(*keys, F.length(line).alias("record_length")).agg(
        F.count(F.lit(1)).alias("n")
    )
