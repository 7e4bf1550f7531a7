"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items.

Letters A-Z are lower-cased; everything in ASCII but letters and digits separates words. A window is
WINDOW consecutive words of an item; an item of fewer words, but not none, is one window. Texts are
written as words with one blank after each, so that a window is a byte string that begins where a word
begins.

The windows are dealt by hash into groups of a bounded number, however large the benchmark is; each
group becomes one set of tables that is broadcast, and the documents pass all sets in one stage. A
set has one table for each class of lengths. The table holds, for the hash of each block of bytes, how
far the search may move; the scan runs from many places of a batch at once. Where it may not move,
the bucket of the block's hash names the windows to test, a prefix word leaves few, and those are
compared byte by byte.

Defined cases: a null or empty text has no words; a benchmark row without an id or without a word is
left out; rows with one item id are one item; repeated documents are scanned each for itself; an empty
benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecube.llm.common import BINARY, LONG, STRING, bounded_batches, free_name, list_of, stored, struct_of, utf8_buffer

WINDOW = 10
#: At most about so many windows are broadcast in one set of tables.
GROUP_WINDOWS = 200_000
#: A scan runs from every so many bytes.
LANE = 2048
BLOCK = 8
GAP = 1  # byte in front of each text; never part of a window

_TABLE = np.full(256, 32, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _TABLE[_b] = _b
for _b in range(0x41, 0x5B):
    _TABLE[_b] = _b + 32

SCAN_TYPE = struct_of(n_words=LONG, runs=list_of(struct_of(first=LONG, last=LONG)), items=list_of(STRING))


def clean(text: bytes) -> bytes:
    """The words of a text, lower-cased, each followed by a blank."""
    words = _TABLE[np.frombuffer(text, np.uint8)].tobytes().split(b" ")
    return b"".join(w + b" " for w in words if w)


def windows_of(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = clean((text or "").encode()).split(b" ")[:-1]
    if not words:
        return []
    return [b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


def _hash(blocks: np.ndarray, bits: int) -> np.ndarray:
    return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Searcher:
    """Wu-Manber tables for patterns whose shortest is at least half as long as the longest."""

    def __init__(self, patterns: list[tuple[bytes, int]]):
        self.patterns = patterns
        self.m = m = min(len(p) for p, _ in patterns)
        self.block = block = min(BLOCK, m)
        self.mask = np.uint64(2 ** (8 * block) - 1)
        head = np.frombuffer(b"".join(p[:m] for p, _ in patterns), np.uint8).reshape(-1, m)
        self.bits = int(np.clip(int(np.log2(len(patterns) * (m - block + 1))) + 4, 12, 24))
        self.shift = np.full(1 << self.bits, min(255, m - block + 1), np.uint8)
        for end in range(block, m + 1):  # later blocks leave smaller moves
            keys = self._blocks_of(head[:, end - block : end])
            move = min(255, m - end)
            at = _hash(keys, self.bits)
            self.shift[at] = np.minimum(self.shift[at], move)
        last = _hash(self._blocks_of(head[:, m - block :]), self.bits)
        order = np.argsort(last, kind="stable")
        self.bucket, self.member = last[order], order
        self.prefix = self._blocks_of(head[:, : self.block])[order]

    def _blocks_of(self, columns: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(columns), 8), np.uint8)
        wide[:, : columns.shape[1]] = columns
        return np.ascontiguousarray(wide).view("<u8")[:, 0]

    def find(self, raw: bytes, n: int, begins: np.ndarray):
        """(place, pattern) of every occurrence in the first n bytes of raw, which has 8 more."""
        m, block = self.m, self.block
        if n < m:
            return
        at8 = np.ndarray((n,), "<u8", raw, strides=(1,))
        stop_all = n
        lanes = np.arange(m - 1, stop_all, LANE)
        stops = np.minimum(lanes + LANE, stop_all)
        found = []
        while len(lanes):
            move = self.shift[_hash(at8[lanes - (block - 1)] & self.mask, self.bits)]
            still = move == 0
            if still.any():
                found.append(lanes[still] - (m - 1))
            lanes = lanes + np.maximum(move, 1)
            on = lanes < stops
            if not on.all():
                lanes, stops = lanes[on], stops[on]
        if not found:
            return
        places = np.concatenate(found)
        places = places[begins[places]]
        key = _hash(at8[places + (m - block)] & self.mask, self.bits)
        low, high = np.searchsorted(self.bucket, key, "left"), np.searchsorted(self.bucket, key, "right")
        step = 1 << 20  # places are taken in runs whose buckets hold about so many members
        edges = np.searchsorted(np.cumsum(high - low), np.arange(step, int((high - low).sum()) + step, step))
        start = 0
        for edge in [*edges.tolist(), len(places)]:
            edge = min(edge + 1, len(places))
            if edge <= start:
                continue
            lo, many = low[start:edge], (high - low)[start:edge]
            place = np.repeat(places[start:edge], many)
            member = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            good = (at8[place] & self.mask) == self.prefix[member]
            for p, k in zip(place[good].tolist(), self.member[member[good]].tolist(), strict=True):
                pattern, tag = self.patterns[k]
                if raw.startswith(pattern, p) and p + len(pattern) <= n:
                    yield p, tag
            start = edge


class WindowSet:
    """Searchers by length class, with each window's number of words and items."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.n_words = [w.count(b" ") for w, _ in windows]
        self.items = [items for _, items in windows]
        classes = defaultdict(list)
        for tag, (window, _) in enumerate(windows):
            classes[len(window).bit_length()].append((window, tag))
        self.searchers = [Searcher(patterns) for _, patterns in sorted(classes.items())]

    def scan(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its number of words, the runs of hit words, and the items that occur."""
        data, bounds = utf8_buffer(texts)
        raw_in = memoryview(data)
        parts, ends = [], []
        size = 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            parts += (b"\0", raw_in[a:b], b" ")
            ends.append(size)
            size += b - a + 2
        joined = np.frombuffer(b"".join(parts), np.uint8)
        low = _TABLE[joined]
        low[ends] = GAP
        keep = low != 32
        keep[1:] |= low[:-1] > 32
        low = low[keep]
        n = len(low)
        word = low > 32
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        raw = low.tobytes() + bytes(8)
        gaps = np.flatnonzero(low == GAP)
        words = np.flatnonzero(begins)
        first_word = np.searchsorted(words, np.append(gaps, n))
        counts = np.diff(first_word)
        covered: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for searcher in self.searchers:
            hits = list(searcher.find(raw, n, begins))
            if hits:
                places = np.array([p for p, _ in hits])
                texts_at = np.searchsorted(gaps, places, "right") - 1
                firsts = np.searchsorted(words, places) - first_word[texts_at]
                for text, first, (_, tag) in zip(texts_at.tolist(), firsts.tolist(), hits, strict=True):
                    covered[text].append((first, first + self.n_words[tag]))
                    items[text].update(self.items[tag])
        return [(int(counts[i]), joined_runs(covered.get(i, ())), sorted(items.get(i, ()))) for i in range(len(counts))]


def joined_runs(runs) -> list[tuple[int, int]]:
    """Overlapping or touching (first, past) runs made one."""
    out: list[tuple[int, int]] = []
    for first, past in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], past))
        else:
            out.append((first, past))
    return out


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window, items): the distinct windows of all items, with the sorted ids of the items that have them."""

    @F.arrow_udf(list_of(BINARY))
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(windows_of(t.as_py()))) for t in texts], pa.list_(pa.binary()))

    rows = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), cut(F.col(text)).alias("windows"))
    return rows.select("item", F.explode("windows").alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def scanner(windows: list[tuple[bytes, list[str]]], spark):
    shared = spark.sparkContext.broadcast(windows)
    made: list[WindowSet] = []

    @F.arrow_udf(SCAN_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(WindowSet(shared.value))
        rows = made[0].scan(texts)
        runs = [[{"first": a, "last": b - 1} for a, b in r] for _, r, _ in rows]
        return pa.StructArray.from_arrays(
            [
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                pa.array([i for _, _, i in rows], pa.list_(pa.string())),
            ],
            ["n_words", "runs", "items"],
        )

    return scan


@F.arrow_udf(LONG)
def covered_words(runs: pa.Array) -> pa.Array:
    return pa.array([sum(b - a for a, b in joined_runs((r["first"], r["last"] + 1) for r in x.as_py() or [])) for x in runs], pa.int64())


def scan(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with a struct (n_words, runs, items), and that column's name.

    `runs` holds the first and the last of consecutive hit words, counted from 0; `items` the sorted ids.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    windows = stored(benchmark_windows(benchmark), "windows")
    groups = max(1, -(-windows.count() // GROUP_WINDOWS))
    table, found = documents, []
    group = F.pmod(F.xxhash64("window"), F.lit(groups))
    for g in range(groups):
        some = [(bytes(r.window), list(r["items"])) for r in windows.filter(group == g).collect()]
        name = free_name(table, f"found{g}")
        table = table.withColumn(name, scanner(some, spark)(F.col(text)))
        found.append(name)
    all_runs = F.flatten(F.array(*[F.col(f)["runs"] for f in found]))
    all_items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f)["items"] for f in found]))))
    name = free_name(table, "found")
    struct = F.struct(F.col(found[0])["n_words"].alias("n_words"), all_runs.alias("runs"), all_items.alias("items"))
    return table.withColumn(name, struct).drop(*found), name


def report(documents: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, n_words, n_hit, n_items, items_sha256, contaminated) for each row."""
    table, found = scan(documents.select(*dict.fromkeys([*keep, text])), benchmark, text)
    f = F.col(found)
    hit = F.when(F.size(f["runs"]) > 0, covered_words(f["runs"])).otherwise(F.lit(0).cast("bigint"))
    return table.select(
        *keep,
        f["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(f["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        (F.size(f["runs"]) > 0).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a hit word, with the columns they came with."""
    table, found = scan(documents, benchmark, text)
    return table.filter(no_hit(F.col(found))).select(*[F.col(f"`{c}`") for c in documents.columns])


def no_hit(found: Column) -> Column:
    return F.size(found["runs"]) == 0
