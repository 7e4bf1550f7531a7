"""Anchors: a rule by content that names one place in every window, the same in equal windows.

In each window of `size` symbols the anchor is the gram of `gram` symbols with the least hash (the
leftmost among equals). Windows that are equal have equal anchors at the same distance, so whatever
compares windows only has to bring together those with one anchor. Most anchors occur once; a first
pass over hashes alone finds those that recur, and only the texts around these are moved.

Symbols travel as arrays packed in binary columns, one row for each bucket of hashes and some
thousands of symbols, byte planes apart so that they compress.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecube.llm.common import BINARY, BOOLEAN, LONG, struct_of

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
HASH_BITS = 48
#: Text for which one bucket is made, in bytes: the number of buckets follows the input.
BUCKET_BYTES = 4 << 20
#: Symbols looked at in one go.
CHUNK = 1 << 16
#: Packed entries that a task holds before it sends them on.
HELD = 1 << 18


def mixed(values: np.ndarray) -> np.ndarray:
    v = values * MIX
    v ^= v >> np.uint64(32)
    v *= MIX2
    v ^= v >> np.uint64(29)
    return v


def byte_grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the 16-byte grams of a run of bytes."""
    n = len(data) - 15
    if n <= 0:
        return np.empty(0, np.uint64)
    raw = np.ascontiguousarray(data)
    first = np.ndarray((n,), "<u8", raw.data, 0, (1,))
    second = np.ndarray((n,), "<u8", raw.data, 8, (1,))
    return mixed(first * MIX2 + mixed(second.copy())) >> np.uint64(64 - HASH_BITS)


def word_grams(words: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the grams of `gram` words, from the words' hashes."""
    n = len(words) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(gram):
        total = total * MIX + words[k : k + n]
    return mixed(total) >> np.uint64(64 - HASH_BITS)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the least, the leftmost among equals."""
    value, place, span = values, np.arange(len(values), dtype=np.int32), 1

    def joined(step: int) -> tuple[np.ndarray, np.ndarray]:
        right = value[step:] < value[:-step]
        return np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])

    while 2 * span <= width:
        value, place = joined(span)
        span *= 2
    if span < width:
        value, place = joined(width - span)
    return place


def anchored_runs(symbols: np.ndarray, bounds: np.ndarray, grams, gram: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first, past, hash): consecutive windows of one text with one anchor, windows first to past - 1.

    `symbols` are those of all texts, which begin and end at `bounds`; `grams` hashes a run of symbols.
    """
    n = len(symbols)
    for start in range(0, n, CHUNK):
        stop = min(n, start + CHUNK)
        piece = symbols[start : min(n, stop + size - 1)]
        if len(piece) < size:
            break
        hashes = grams(piece)
        anchor = least_places(hashes, size - gram + 1)
        count = min(stop - start, len(anchor))
        text = np.searchsorted(bounds, np.arange(start, start + count), "right") - 1
        whole = np.arange(start, start + count) + size <= bounds[text + 1]
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        own = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1
        yield text[at[heads]], at[heads] + start, at[tails] + start + 1, hashes[own[heads]]


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """The values' bytes, all lowest first; `width` bytes of each."""
    wide = np.ascontiguousarray(values.astype(np.int64) if values.dtype != np.uint64 else values)
    return wide.view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def unplaned(data: bytes, width: int = 8) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return wide.view(np.int64)[:, 0]


PACKED = struct_of(bucket=LONG, keys=BINARY, owners=BINARY, settled=BOOLEAN)


def packed_by(buckets: np.ndarray, keys: np.ndarray, owners: np.ndarray, settled: bool = False) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: its 48-bit keys and their owners. Settled pairs are known to recur."""
    order = np.argsort(buckets, kind="stable")
    buckets, keys, owners = buckets[order], keys[order], owners[order]
    edges = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets)) if len(buckets) else np.zeros(1, int)
    pieces = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    for i in range(0, len(pieces), 256):
        some = pieces[i : i + 256]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(buckets[a]) for a, _ in some], pa.int64()),
                pa.array([planes(keys[a:b], 6) for a, b in some], pa.binary()),
                pa.array([planes(owners[a:b]) for a, b in some], pa.binary()),
                pa.array([settled] * len(some), pa.bool_()),
            ],
            ["bucket", "keys", "owners", "settled"],
        )


def unpacked(table: pa.Table, settled: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    if settled is not None:
        table = table.filter(pc.equal(table.column("settled"), settled))
    keys = [unplaned(x.as_py(), 6) for x in table.column("keys")]
    owners = [unplaned(x.as_py()) for x in table.column("owners")]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *keys]), np.concatenate([empty, *owners])


def bucket_count(documents: DataFrame, text: str, size: int = BUCKET_BYTES) -> int:
    total = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(12, -(-total // size))


def recurring(entries: DataFrame, buckets: int, across: bool) -> DataFrame:
    """(owner, hashes): for each owner its anchors that recur, as packed 48-bit hashes.

    `entries` are packed (bucket, keys, owners). With `across`, an anchor recurs if two owners have it;
    else if it has two entries, whoever owns them.
    """

    def matched(table: pa.Table) -> pa.Table:
        keys, owners = unpacked(table, settled=False)
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
        sizes = np.diff(np.append(heads, len(keys)))
        tails = heads + sizes - 1
        again = owners[heads] != owners[tails] if across else sizes > 1
        keep = np.repeat(again, sizes)
        keys, owners = keys[keep], owners[keep]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        known = unpacked(table, settled=True)
        keys, owners = np.concatenate([keys[new], known[0]]), np.concatenate([owners[new], known[1]])
        return pa.Table.from_batches(packed_by(owner_bucket(owners, buckets), keys, owners), SCHEMA)

    def gathered(table: pa.Table) -> pa.Table:
        keys, owners = unpacked(table)
        order = np.argsort(owners, kind="stable")
        keys, owners = keys[order], owners[order]
        edges = np.append(np.flatnonzero(np.append(True, owners[1:] != owners[:-1])), len(owners)) if len(owners) else np.zeros(1, int)
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.table(
            {
                "owner": pa.array([int(owners[a]) for a, _ in spans], pa.int64()),
                "hashes": pa.array([planes(keys[a:b], 6) for a, b in spans], pa.binary()),
            }
        )

    found = dealt(entries).groupBy("bucket").applyInArrow(matched, PACKED)
    return found.groupBy("bucket").applyInArrow(gathered, struct_of(owner=LONG, hashes=BINARY))


SCHEMA = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("settled", pa.bool_())])


def owner_bucket(owners: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(owners.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)


def dealt(packed: DataFrame) -> DataFrame:
    """Packed rows by bucket over all partitions of a shuffle: work on a bucket is more than its bytes tell."""
    return packed.repartition(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")


class Sender:
    """Collects (key, owner) entries and gives them out packed by the key's bucket.

    Keys that recur among the entries held are settled here: their pairs go on as settled
    ones, by owner, and one entry stands for them in the key's bucket. So a key that
    everything has, such as a passage in a third of all documents, comes to its bucket once
    for each quarter of a million of entries.
    """

    def __init__(self, buckets: int, across: bool):
        self.buckets, self.across, self.keys, self.owners, self.size = buckets, across, [], [], 0

    def add(self, keys: np.ndarray, owners: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys.astype(np.int64))
        self.owners.append(owners)
        self.size += len(keys)
        if self.size >= HELD:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, owners = np.concatenate(self.keys), np.concatenate(self.owners)
        self.keys, self.owners, self.size = [], [], 0
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(heads, len(keys)))
        again = owners[heads] != owners[heads + sizes - 1] if self.across else sizes > 1
        settled = np.repeat(again, sizes)
        first = np.zeros(len(keys), bool)
        first[heads] = True
        new = first.copy()
        new[1:] |= owners[1:] != owners[:-1]
        open_, done = first, settled & new
        yield from packed_by(key_bucket(keys[open_], self.buckets), keys[open_], owners[open_])
        yield from packed_by(owner_bucket(owners[done], self.buckets), keys[done], owners[done], settled=True)


def distinct_pairs(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (key, owner) once."""
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], owners[new]
