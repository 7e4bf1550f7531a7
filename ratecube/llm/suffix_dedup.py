"""Suffix-array dedup: remove bytes covered by a string of SIZE bytes that a smaller doc_id also has.

Strings that are equal have one anchor (see `anchors`). Segments around the anchors that recur are
dealt out by anchor, equal segments once. Distinct segments of one anchor form shards of whole anchors; a
segment that is its anchor's only one shares no string with any other and is in none. Each shard's segments
are concatenated and their suffix array is built by induced sorting: suffixes are classified,
leftmost-smaller substrings are sorted and named, the names' suffixes are sorted recursively, and the
array is induced from them. Permuted common prefixes, cut off at SIZE, then say which strings are equal.
Induction goes over the array in steps of arrays instead of single places: all places of a bucket that
are there are taken together. Names that are too many to end the recursion are split in two digits, so
that every level has few buckets.

Strings are judged on the input. Defined cases: a null text has no bytes; a row without an id is kept
whole and removes nothing elsewhere; rows with one id don't remove from each other; a text of under
SIZE bytes stays whole; any byte may occur in a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecube.llm.anchors import (
    PACKED,
    Sender,
    anchored_runs,
    bucket_count,
    byte_grams,
    dealt,
    distinct_pairs,
    key_bucket,
    owner_bucket,
    planes,
    recurring,
    unplaned,
)
from ratecube.llm.common import BINARY, LONG, STRING, bounded_batches, free_name, freed_shuffles, release_memory, releasing, stored, struct_of, utf8_buffer

SIZE = 50
GRAM = 16
#: Names go to the recursion undivided while there are at most so many.
FEW_NAMES = 512
#: The recursion ends at so many names.
SMALL = 1 << 20
NO_BUCKET = np.uint16(0xFFFF)
#: Text for one bucket of anchors.
BUCKET_BYTES = 8 << 20
#: Segments of one suffix array, in bytes: more only if one anchor has more.
SHARD_BYTES = 1 << 20
#: Places whose prefixes are compared in one go, and segments whose anchors are found in one go.
PLACES = 1 << 16
HEADS = 1 << 10


def doubled(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a short array: ranks of twice as many symbols in each round.

    The first round takes as many symbols as fit in 63 bits. A suffix that differs from all others has its place;
    each further round sorts the rest only. The rank of a suffix is the first place of those equal to it so far.
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    bits = (int(text.max()) + 1).bit_length()
    span = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(min(span, n)):  # none is smallest
        key[: n - k] += (text[k:].astype(np.int64) + 1) << (bits * (span - 1 - k))
    order = np.argsort(key)
    rank, rest, key = np.empty(n, np.int64), np.arange(n), key[order]
    while True:
        new = np.append(True, key[1:] != key[:-1])
        rank[order[rest]] = rest[np.maximum.accumulate(np.where(new, np.arange(len(rest)), 0))]
        rest = rest[~(new & np.append(new[1:], True))]
        if not len(rest):
            return order.astype(np.int32)
        own = order[rest]
        behind = own + span
        key = rank[own] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[rest], key = own[by], key[by]
        span *= 2


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """S-type suffixes: those smaller than the suffix behind them."""
    edges = np.flatnonzero(text[1:] != text[:-1]).astype(np.int32)
    rises = text[edges] < text[edges + 1]
    types = np.repeat(rises, np.diff(edges, prepend=-1))
    return np.append(types, True)


def named(text: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings, in text order, from the order of the substrings; and how many."""
    n = len(text)
    length = np.zeros(n, np.int32)
    length[starts[:-1]] = np.diff(starts)
    a, b = ordered[:-1], ordered[1:]
    differs = length[a] != length[b]
    rest = np.flatnonzero(~differs)
    step = 0
    while len(rest):
        x, y = a[rest], b[rest]
        unequal = text[x + step] != text[y + step]
        differs[rest[unequal]] = True
        rest = rest[~unequal & (step < length[x])]
        step += 1
    names = length  # used again
    names[ordered] = np.append(0, np.cumsum(differs, dtype=np.int32))
    return names[starts], int(differs.sum()) + 1


def suffix_array(text: np.ndarray, kinds: int) -> np.ndarray:
    """Order of all suffixes of an array of symbols 0 to kinds - 1, of which only the last is 0."""
    n = len(text)
    smaller = smaller_than_next(text)
    leftmost = np.zeros(n, bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    starts = np.flatnonzero(leftmost).astype(np.int32)
    counts = np.bincount(text, minlength=kinds)
    tails = np.cumsum(counts)
    heads = tails - counts
    present = np.flatnonzero(counts)
    key = text.astype(np.uint16)  # the largest number stands for no place
    larger_before, smaller_before = np.full(n, NO_BUCKET), np.full(n, NO_BUCKET)
    larger_before[1:] = np.where(smaller[:-1], NO_BUCKET, key[:-1])
    smaller_before[1:] = np.where(smaller[:-1], key[:-1], NO_BUCKET)

    def preceding(found: np.ndarray, wanted: np.ndarray) -> tuple | None:
        """What stands before the found places, if of the wanted type: in bucket order, with ranks and bucket ends."""
        bucket = wanted[found]
        some = bucket != NO_BUCKET
        bucket = bucket[some]
        if not len(bucket):
            return None
        before = found[some]
        before -= 1
        order = bucket.argsort(kind="stable")
        before, bucket = before[order], bucket[order]
        new = np.empty(len(bucket), bool)
        new[0] = True
        np.not_equal(bucket[1:], bucket[:-1], out=new[1:])
        first = new.nonzero()[0]
        many = np.empty_like(first)
        np.subtract(first[1:], first[:-1], out=many[:-1])
        many[-1] = len(bucket) - first[-1]
        rank = np.arange(len(bucket), dtype=np.int32) - first.astype(np.int32).repeat(many)
        return before, bucket, rank, (bucket[first], many)

    def induced(order: np.ndarray) -> np.ndarray:
        array = np.full(n, -1, np.int32)
        bucket = key[order]
        by = np.argsort(bucket, kind="stable")
        seeds, seed_bucket = order[by], bucket[by]
        seed_edges = np.searchsorted(seed_bucket, np.arange(kinds + 1))
        head = heads.copy()
        for c in present.tolist():
            at = int(heads[c])
            while at < head[c]:
                to = int(head[c])
                if (d := preceding(array[at:to], larger_before)) is not None:
                    array[head[d[1]] + d[2]] = d[0]
                    head[d[3][0]] += d[3][1]
                at = to
            if seed_edges[c] < seed_edges[c + 1] and (d := preceding(seeds[seed_edges[c] : seed_edges[c + 1]], larger_before)) is not None:
                array[head[d[1]] + d[2]] = d[0]
                head[d[3][0]] += d[3][1]
        tail = tails.copy()
        array[0] = n - 1
        tail[0] = 0
        for c in present[::-1].tolist():
            at = int(tails[c]) if c else 0
            while at > tail[c]:
                to = int(tail[c])
                if (d := preceding(array[to:at][::-1], smaller_before)) is not None:
                    array[tail[d[1]] - 1 - d[2]] = d[0]
                    tail[d[3][0]] -= d[3][1]
                at = to
            if heads[c] < head[c] and (d := preceding(array[heads[c] : head[c]][::-1], smaller_before)) is not None:
                array[tail[d[1]] - 1 - d[2]] = d[0]
                tail[d[3][0]] -= d[3][1]
        return array

    if len(starts) > 1:
        ordered = induced(starts)
        ordered = ordered[leftmost[ordered]]
        names, n_names = named(text, starts, ordered)
        if n_names < len(starts):
            if len(names) <= SMALL:
                inner = doubled(names)
            elif n_names <= FEW_NAMES:
                inner = suffix_array(names, n_names)
            else:
                base = int(np.ceil(np.sqrt(n_names)))
                digits = np.zeros(2 * len(names) + 1, np.int32)
                digits[:-1:2] = names // base + 1
                digits[1::2] = names % base + 1
                inner = suffix_array(digits, base + 2)
                inner = inner[(inner % 2 == 0) & (inner < 2 * len(starts))] // 2
            ordered = starts[inner]
        starts = ordered
    return induced(starts)


def permuted_common_prefixes(data: bytes, places: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """For places in suffix-array order: bytes in common with the place before, at most `most`.

    Each place's predecessor is written down in text order, the prefixes are compared in that order,
    eight bytes at a time, and read back in the array's order. `data` has `most` + 8 more bytes.
    """
    before = np.full(len(data), -1, np.int32)
    before[array[1:]] = array[:-1]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.zeros(len(data), np.int32)
    for i in range(0, len(places), PLACES):
        here = places[i : i + PLACES]
        here = here[before[here] >= 0]
        there = before[here]
        common = np.zeros(len(here), np.int64)
        rest = np.arange(len(here))
        for step in range(0, most, 8):
            odd = eight[here[rest] + step] ^ eight[there[rest] + step]
            low = odd & (~odd + np.uint64(1))  # lowest bit in which they differ
            same = np.where(odd == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            common[rest] += same
            rest = rest[odd == 0]
        out[here] = np.minimum(common, most)
    return out[array]


def covered_by_smaller(contents: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, first, past): runs of bytes covered by a string of SIZE bytes of a content with a smaller owner."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    joined = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(len(joined) + 1, np.int32)
    symbols[:-1] = joined
    symbols[:-1] += 2
    symbols[ends] = 1
    array = suffix_array(symbols, 258)
    del symbols
    content = np.repeat(np.arange(len(contents), dtype=np.int32), sizes + 1)
    full = np.zeros(len(joined) + 1, bool)
    full[:-1] = np.arange(len(joined), dtype=np.int32) + SIZE <= ends[content]
    array = array[full[array]]
    prefix = permuted_common_prefixes(joined.tobytes() + bytes(SIZE + 8), np.flatnonzero(full), array, SIZE)
    heads = np.flatnonzero(np.append(True, prefix[1:] < SIZE))
    own = owners[content[array]]
    least = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(array))))
    places = np.sort(array[least < own])
    whose = content[places].astype(np.int64)
    first = places - (ends - sizes)[whose]
    return merged_spans(whose, first, first + SIZE)


def first_anchors(contents: list[bytes]) -> np.ndarray:
    """Each content's anchor, from its first window: all windows of a content have one."""
    found = [np.empty(0, np.uint64)]
    for i in range(0, len(contents), HEADS):
        heads = np.frombuffer(b"".join([c[:SIZE] for c in contents[i : i + HEADS]]) + bytes(GRAM - 1), np.uint8)
        found.append(byte_grams(heads).reshape(-1, SIZE)[:, : SIZE - GRAM + 1].min(axis=1))
    return np.concatenate(found)


def shards(contents: list[bytes]) -> Iterator[np.ndarray]:
    """Numbers of contents that may share strings, by shards: all contents of an anchor are in one, unless there is only one."""
    anchor = first_anchors(contents)
    order = np.argsort(anchor, kind="stable")
    _, many = np.unique(anchor, return_counts=True)
    order, many = order[np.repeat(many > 1, many)], many[many > 1]
    if not len(order):
        return
    sizes = np.fromiter((len(contents[i]) for i in order.tolist()), np.int64, len(order))
    heads = np.cumsum(many) - many
    shard = np.repeat((np.cumsum(sizes) - sizes)[heads] // SHARD_BYTES, many)
    yield from np.split(order, np.flatnonzero(shard[1:] != shard[:-1]) + 1)


def covered_in_shards(contents: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`covered_by_smaller` of segments around anchors, with a suffix array for each shard."""
    parts = [(np.empty(0, np.int64),) * 3]
    for some in shards(contents):
        content, first, past = covered_by_smaller([contents[i] for i in some.tolist()], owners[some])
        parts.append((some[content], first, past))
    content, first, past = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(content, kind="stable")
    return content[order], first[order], past[order]


def entries(documents: DataFrame, buckets: int) -> DataFrame:
    """Packed (anchor, doc_id) pairs of (doc_id, text) rows, each pair once a batch."""

    @releasing
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, across=True)
        for batch in batches:
            data, bounds = utf8_buffer(batch.column("text"))
            ids = np.asarray(batch.column("doc_id"))
            for text, _, _, anchor in anchored_runs(data, bounds, byte_grams, GRAM, SIZE):
                yield from sender.add(*distinct_pairs(anchor, ids[text]))
        yield from sender.rest()

    return documents.select("doc_id", "text").mapInArrow(send, PACKED)


SEGMENTS = struct_of(bucket=LONG, content=BINARY, sizes=BINARY, owners=BINARY, rows=BINARY, firsts=BINARY, which=BINARY)


def segments(flagged: DataFrame, buckets: int) -> DataFrame:
    """Segments of (doc_id, row, text, hashes) rows around recurring anchors, packed by bucket.

    In a packed row each content is there once; an occurrence says which content, where, and of whom.
    Occurrences of a content that a smaller id of the batch has too are settled: they go on as spans.
    """

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_buffer(batch.column("text"))
            ids, row = np.asarray(batch.column("doc_id")), np.asarray(batch.column("row"))
            wanted = [np.sort(unplaned(h.as_py(), 6)) for h in batch.column("hashes")]
            parts = []
            for text, first, past, anchor in anchored_runs(data, bounds, byte_grams, GRAM, SIZE):
                anchor = anchor.astype(np.int64)
                again = np.zeros(len(text), bool)
                edges = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(text)], strict=True):
                    own = wanted[text[a]]
                    at = np.searchsorted(own, anchor[a:b])
                    again[a:b] = own[np.minimum(at, len(own) - 1)] == anchor[a:b]
                parts.append((text[again], first[again], past[again], anchor[again]))
            if not parts:
                continue
            text, first, past, anchor = (np.concatenate(p) for p in zip(*parts, strict=True))
            bucket = key_bucket(anchor, buckets)
            order = np.argsort(bucket, kind="stable")
            text, first, past, bucket = text[order], first[order], past[order], bucket[order]
            raw = data.tobytes()
            heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, int)
            out, spans = [], [(np.empty(0, np.int64),) * 3]
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
                known: dict[bytes, int] = {}
                ends = (past[a:b] + SIZE - 1).tolist()
                which = [known.setdefault(raw[f:e], len(known)) for f, e in zip(first[a:b].tolist(), ends, strict=True)]
                which = np.array(which, np.int64)
                own, sizes = text[a:b], np.fromiter(map(len, known), np.int64, len(known))
                place = first[a:b] - bounds[own]
                least = np.full(len(known), np.iinfo(np.int64).max)
                np.minimum.at(least, which, ids[own])
                done = ids[own] > least[which]
                spans.append((row[own[done]], place[done], place[done] + sizes[which[done]]))
                own, place, which = own[~done], place[~done], which[~done]
                out.append((int(bucket[a]), b"".join(known), planes(sizes), planes(ids[own]), planes(row[own]), planes(place), planes(which)))
            out += settled_spans(spans, buckets)
            names = [f.name for f in SEGMENTS]
            kinds = [pa.int64(), *[pa.binary()] * 6]
            for i in range(0, len(out), 64):
                columns = zip(*out[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return flagged.select("doc_id", "row", "text", "hashes").mapInArrow(cut, SEGMENTS)


def settled_spans(spans: list[tuple[np.ndarray, ...]], buckets: int) -> list[tuple]:
    """Spans as packed rows without content, their ends in the place of the sizes."""
    table = packed_spans(*merged_spans(*(np.concatenate(p) for p in zip(*spans, strict=True))), buckets)
    return [(r["bucket"], b"", r["pasts"], b"", r["rows"], r["firsts"], b"") for r in table.to_pylist()]


SPANS = struct_of(bucket=LONG, rows=BINARY, firsts=BINARY, pasts=BINARY)


def merged_spans(rows: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of one row that overlap or touch made one; sorted."""
    if not len(rows):
        return rows, first, past
    order = np.lexsort((first, rows))
    rows, first, past = rows[order], first[order], past[order]
    new = np.append(True, rows[1:] != rows[:-1])
    # The furthest end so far in each row: rows are lifted apart so that one running maximum serves all.
    lift = np.cumsum(new).astype(np.int64) * (int(past.max()) + 1)
    reach = np.maximum.accumulate(past + lift) - lift
    new[1:] |= first[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(rows)) - 1
    return rows[heads], first[heads], reach[tails]


def packed_spans(rows: np.ndarray, first: np.ndarray, past: np.ndarray, buckets: int) -> pa.Table:
    bucket = owner_bucket(rows, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, rows, first, past = bucket[order], rows[order], first[order], past[order]
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, int)
    pieces = list(zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True)) if len(heads) else []
    return pa.table(
        {
            "bucket": pa.array([int(bucket[a]) for a, _ in pieces], pa.int64()),
            "rows": pa.array([planes(rows[a:b]) for a, b in pieces], pa.binary()),
            "firsts": pa.array([planes(first[a:b]) for a, b in pieces], pa.binary()),
            "pasts": pa.array([planes(past[a:b]) for a, b in pieces], pa.binary()),
        }
    )


def unpacked_segments(table: pa.Table) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """(distinct contents; of each occurrence content, owner, row and first; of each settled span row, first and past)."""
    known: dict[bytes, int] = {}
    parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(7)]
    columns = [table.column(c) for c in ("content", "sizes", "owners", "rows", "firsts", "which")]
    for content, sizes, owners, rows, firsts, which in zip(*columns, strict=True):
        raw, numbers = content.as_py(), unplaned(sizes.as_py())
        if not raw:
            for part, values in zip(parts[4:], (unplaned(rows.as_py()), unplaned(firsts.as_py()), numbers), strict=True):
                part.append(values)
            continue
        ends = np.cumsum(numbers).tolist()
        local = [known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        parts[0].append(np.array(local, np.int64)[unplaned(which.as_py())])
        for part, column in zip(parts[1:4], (owners, rows, firsts), strict=True):
            part.append(unplaned(column.as_py()))
    joined = [np.concatenate(p) for p in parts]
    return list(known), joined[:4], joined[4:]


def repeated_spans(packed: DataFrame, buckets: int) -> DataFrame:
    """Packed spans of rows that a string of a smaller doc_id covers."""

    def judged(table: pa.Table) -> pa.Table:
        contents, (which, owner, row, first), settled = unpacked_segments(table)
        del table
        if not len(which):
            return packed_spans(*merged_spans(*settled), buckets)
        least = np.full(len(contents), np.iinfo(np.int64).max)
        np.minimum.at(least, which, owner)
        sizes = np.fromiter(map(len, contents), np.int64, len(contents))
        # A content that a smaller id has too is removed whole; its least owner loses what is in other contents.
        whole = owner > least[which]
        out = [settled, (row[whole], first[whole], first[whole] + sizes[which[whole]])]
        content, begin, past = covered_in_shards(contents, least)
        many = np.bincount(content, minlength=len(contents))
        start = np.cumsum(many) - many
        others = np.flatnonzero(~whole)
        times = many[which[others]]
        at = np.repeat(start[which[others]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        base = np.repeat(first[others], times)
        out.append((np.repeat(row[others], times), begin[at] + base, past[at] + base))
        spans = packed_spans(*merged_spans(*(np.concatenate(p) for p in zip(*out, strict=True))), buckets)
        del contents, out
        release_memory()
        return spans

    return dealt(packed).groupBy("bucket").applyInArrow(judged, SPANS)


def spans_by_row(packed: DataFrame) -> DataFrame:
    """(row, firsts, pasts): the merged spans of each row, as packed integers."""

    def gathered(table: pa.Table) -> pa.Table:
        columns = [np.concatenate([np.empty(0, np.int64), *[unplaned(x.as_py()) for x in table.column(c)]]) for c in ("rows", "firsts", "pasts")]
        rows, first, past = merged_spans(*columns)
        heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.empty(0, int)
        pieces = list(zip(heads.tolist(), [*heads[1:].tolist(), len(rows)], strict=True)) if len(heads) else []
        return pa.table(
            {
                "row": pa.array([int(rows[a]) for a, _ in pieces], pa.int64()),
                "firsts": pa.array([planes(first[a:b]) for a, b in pieces], pa.binary()),
                "pasts": pa.array([planes(past[a:b]) for a, b in pieces], pa.binary()),
            }
        )

    return packed.groupBy("bucket").applyInArrow(gathered, struct_of(row=LONG, firsts=BINARY, pasts=BINARY))


CUT = struct_of(n_bytes=LONG, n_removed=LONG, n_spans=LONG, kept_sha256=STRING, kept=BINARY)


def cutter(with_text: bool):
    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, firsts: pa.Array, pasts: pa.Array) -> pa.Array:
        data, bounds = utf8_buffer(texts)
        raw, rows = data.tobytes(), []
        for a, b, f, p in zip(bounds[:-1].tolist(), bounds[1:].tolist(), firsts, pasts, strict=True):
            text = raw[a:b]
            spans = list(zip(unplaned(f.as_py()).tolist(), unplaned(p.as_py()).tolist(), strict=True)) if f.is_valid else []
            kept, at = [], 0
            for first, past in spans:
                kept.append(text[at:first])
                at = past
            left = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.name for f in CUT])

    return cut


def dedup(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> tuple[DataFrame, str]:
    """The documents with a struct (n_bytes, n_removed, n_spans, kept_sha256, kept), and that column's name.

    `kept` is null unless `with_text`.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    row, hashes, found = (free_name(documents, c) for c in ("row_key", "anchor_hashes", "cut"))
    # Rows that are alike have one key and one result.
    keyed = documents.withColumn(row, F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text)))
    plain = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(
        F.col("doc_id").isNotNull() & (F.octet_length("text") >= SIZE)
    )
    plain = plain.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    buckets = bucket_count(plain, "text", BUCKET_BYTES)
    with freed_shuffles(spark):
        again = stored(recurring(entries(plain, buckets), buckets, across=True), "anchors")
        flagged = plain.withColumn("row", F.xxhash64("doc_id", "text")).join(again, F.col("doc_id") == F.col("owner"))
        spans = stored(spans_by_row(repeated_spans(segments(flagged, buckets), buckets)), "spans")
    spans = spans.withColumnsRenamed({"row": f"{row}_", "firsts": f"{hashes}_f", "pasts": f"{hashes}_p"})
    table = keyed.join(spans, F.col(row) == F.col(f"{row}_"), "left")
    table = table.withColumn(found, cutter(with_text)(F.col(text), F.col(f"{hashes}_f"), F.col(f"{hashes}_p")))
    return table.select(*[F.col(f"`{c}`") for c in documents.columns], found), found


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    table, found = dedup(documents.select(doc_id, text), doc_id, text)
    return table.select(F.col(doc_id), *[F.col(found)[c].alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


@F.arrow_udf(STRING)
def whole_characters(kept: pa.Array) -> pa.Array:
    return pa.array([k.as_py().decode("utf-8", "ignore") for k in kept], pa.string())


def shortened(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with what is left of their texts; those that lose all of their bytes go.

    A character of which only some bytes are left goes whole. A text that loses nothing stays as it is.
    """
    table, found = dedup(documents, doc_id, text, with_text=True)
    cut = F.col(found)
    left = table.filter((cut["n_removed"] < cut["n_bytes"]) | (cut["n_bytes"] == 0))
    own = F.when(cut["n_removed"] > 0, whole_characters(cut["kept"])).otherwise(F.col(text))
    return left.select(*[own.alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns])
