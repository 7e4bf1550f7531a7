"""Quality rules: measure once, keep failure bits in a ledger, apply versioned policies to the bits.

Words are runs of characters other than blank, \\t, \\n, \\v, \\f and \\r. Defined cases: a null or
empty text has no words and fails `few_words`; repeated rows and rows without an id are measured each
for itself; an empty table gives an empty ledger; other columns of the input stay as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecube.llm.common import LONG, bounded_batches, free_name, struct_of

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
MEASURE_TYPE = struct_of(**dict.fromkeys(MEASURES, LONG))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    data = (text or "").encode()
    words = data.split()  # splits at just the six blanks
    letters = data.translate(None, BLANKS)
    word_chars = len(text or "") - (len(data) - len(letters))
    lines = [line for line in data.split(b"\n") if line.strip(BLANKS)]
    n, repeats = len(words), 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    if len(found) < len(windows):
        reach = 0  # words before this place are counted
        for i, window in enumerate(windows):
            if found[window] > 1:
                repeats += i + 3 - max(reach, i)
                reach = i + 3
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    return n, word_chars, n_symbols, len(lines), len(lines) - len(set(lines)), repeats


@F.arrow_udf(MEASURE_TYPE)
def measured(texts: pa.Array) -> pa.Array:
    rows = [measure(text.as_py()) for text in texts]
    columns = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


@dataclass(frozen=True)
class Rule:
    """A named test; its place in RULES is its bit. `fails` takes the struct of measurements."""

    name: str
    fails: Callable[[Column], Column]


#: Append only: a bit keeps its meaning in stored ledgers.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
)

#: Rules that a policy enforces, by version.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask(rules: tuple[str, ...]) -> int:
    places = {rule.name: i for i, rule in enumerate(RULES)}
    return sum(1 << places[name] for name in rules)


def ledger(documents: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """The input with a struct of measurements and a bitmask of failed rules, and those columns' names.

    Each text is measured once, and each rule evaluated once, whatever policies follow.
    """
    bounded_batches(documents.sparkSession)
    measures = free_name(documents, "measures")
    table = documents.withColumn(measures, measured(F.col(text)))
    failures = free_name(table, "failures")
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.fails(F.col(measures)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return table.withColumn(failures, bits), measures, failures


def passes(failures: Column, policy: str) -> Column:
    """Whether a row of the ledger passes a policy: none of the policy's bits is set."""
    return failures.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint")) == 0


def kept(documents: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The documents that pass the policy, with the columns they came with."""
    table, _, failures = ledger(documents, text)
    return table.filter(passes(F.col(failures), policy)).select(*[F.col(f"`{c}`") for c in documents.columns])


def ablations(table: DataFrame, failures: str, policy: str) -> DataFrame:
    """(policy, rule, n_failed, n_failed_only, n_kept, n_kept_without): what each rule of a policy does.

    Rows are first summed by their masked bits, of which there are at most 2 to the number of rules;
    the rest reads those few rows.
    """
    whole = mask(POLICIES[policy])
    masked = F.col(failures).bitwiseAND(F.lit(whole).cast("bigint"))
    counts = table.groupBy(masked.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask((name,))).cast("bigint").alias("bit")) for name in POLICIES[policy]])
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    bits, bit = F.col("bits"), F.col("bit")
    return each.groupBy("rule").agg(
        some(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        some(bits == bit).alias("n_failed_only"),
        some(bits == 0).alias("n_kept"),
        some((bits == 0) | (bits == bit)).alias("n_kept_without"),
    ).select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_failed_only", "n_kept", "n_kept_without")
