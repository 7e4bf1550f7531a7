"""Repeated phrases: remove words covered by a window of SIZE words that starts anywhere else too.

Anchors (see `anchors`) tell where windows may recur; the segments around recurring anchors are dealt
out by anchor, equal segments once. Each shard confirms which windows recur, counting the places of
equal segments, compiles the confirmed windows in Aho-Corasick automata of a bounded size, one letter
a word, and streams its segments of all documents through them, which gives every occurrence.

Windows are judged on the input. Defined cases: a null text has no words; repeated rows are places of
their own, so a text of SIZE words or more that is there twice goes twice; shorter texts stay; an id
may be null.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecube.llm.anchors import PACKED, Sender, anchored_runs, bucket_count, dealt, key_bucket, planes, recurring, unplaned, word_grams
from ratecube.llm.common import LONG, STRING, bounded_batches, free_name, stored, struct_of, utf8_buffer
from ratecube.llm.suffix_dedup import SEGMENTS, SPANS, merged_spans, packed_spans, settled_spans, spans_by_row, unpacked_segments
from ratecube.llm.words import word_hashes, words_of

SIZE = 35
GRAM = 8
#: An automaton takes anchors until they have so many windows.
SHARD_WINDOWS = 5_000
#: Letters for words: one each below this number of words, else two.
LETTERS = 0x80000


def grams(words: np.ndarray) -> np.ndarray:
    return word_grams(words, GRAM)


def entries(documents: DataFrame, buckets: int) -> DataFrame:
    """Packed (anchor, row) pairs of (row, text) rows, up to two of a kind from a batch."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, across=False)
        for batch in batches:
            data, bounds = utf8_buffer(batch.column("text"))
            rows = np.asarray(batch.column("row"))
            starts, ends, first = words_of(data, bounds)
            for text, _, _, anchor in anchored_runs(word_hashes(data, starts, ends), first, grams, GRAM, SIZE):
                owner = rows[text]
                order = np.lexsort((anchor, owner))
                anchor, owner = anchor[order], owner[order]
                keep = np.ones(len(anchor), bool)  # a third of one kind tells nothing new
                keep[2:] = (anchor[2:] != anchor[:-2]) | (owner[2:] != owner[:-2])
                yield from sender.add(anchor[keep], owner[keep])
        yield from sender.rest()

    return documents.select("row", "text").mapInArrow(send, PACKED)


def segments(flagged: DataFrame, buckets: int) -> DataFrame:
    """Segments of (row, text, hashes) rows around recurring anchors, packed by bucket; words joined by blanks.

    The packed `owners` are the anchors. A content that a batch has twice recurs; what it has
    beyond two occurrences is settled and goes on as spans.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_buffer(batch.column("text"))
            rows = np.asarray(batch.column("row"))
            wanted = [np.sort(unplaned(h.as_py(), 6)) for h in batch.column("hashes")]
            starts, ends, first_word = words_of(data, bounds)
            raw = data.tobytes()
            out: dict[int, list] = {}
            for text, first, past, anchor in anchored_runs(word_hashes(data, starts, ends), first_word, grams, GRAM, SIZE):
                anchor = anchor.astype(np.int64)
                again = np.zeros(len(text), bool)
                edges = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(text)], strict=True):
                    own = wanted[text[a]]
                    at = np.searchsorted(own, anchor[a:b])
                    again[a:b] = own[np.minimum(at, len(own) - 1)] == anchor[a:b]
                bucket = key_bucket(anchor[again], buckets)
                columns = (bucket, anchor[again], text[again], first[again], past[again])
                for k, key, t, f, p in zip(*[c.tolist() for c in columns], strict=True):
                    content = b" ".join(raw[starts[f] : ends[p + SIZE - 2]].split())
                    known, places = out.setdefault(k, ({}, []))
                    places.append((key, rows[t], f - first_word[t], known.setdefault(content, len(known))))
            names, kinds, made = [f.name for f in SEGMENTS], [pa.int64(), *[pa.binary()] * 6], []
            spans = [(np.empty(0, np.int64),) * 3]
            for k, (known, places) in sorted(out.items()):
                key, row, first, which = np.array(places, np.int64).T
                order = np.argsort(which, kind="stable")
                number = np.empty(len(which), np.int64)  # of the occurrence among those of its content
                number[order] = np.arange(len(which)) - np.searchsorted(which[order], which[order])
                done = number > 1
                n_words = np.array([c.count(b" ") + 1 for c in known], np.int64)
                spans.append((row[done], first[done], first[done] + n_words[which[done]]))
                key, row, first, which = key[~done], row[~done], first[~done], which[~done]
                sizes = np.fromiter(map(len, known), np.int64, len(known))
                made.append((k, b"".join(known), planes(sizes), planes(key), planes(row), planes(first), planes(which)))
            made += settled_spans(spans, buckets)
            for i in range(0, len(made), 64):
                columns = zip(*made[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return flagged.select("row", "text", "hashes").mapInArrow(cut, SEGMENTS)


def spelled(contents: list[bytes]) -> tuple[list[str], int]:
    """The contents with a letter for each word, or two if there are many words; and how many."""
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in c.split(b" ")], np.int64) for c in contents]

    def letters(values: np.ndarray) -> np.ndarray:
        return np.where(values < 0xD000, values + 0x100, values + 0x1000)  # past the surrogates

    if len(number) < LETTERS:
        return [letters(i).astype("<u4").tobytes().decode("utf-32-le") for i in ids], 1
    pairs = [np.stack([letters(i // LETTERS) + LETTERS + 0x1000, letters(i % LETTERS)], 1).ravel() for i in ids]
    return [p.astype("<u4").tobytes().decode("utf-32-le") for p in pairs], 2


def occurrences(contents: list[bytes], weights: list[int], anchors: list[int], size: int = SIZE) -> list[list[int]]:
    """For each content the places of its windows that recur; a content is there `weights` times.

    Contents with one anchor share their windows with no others. So whole anchors are taken together
    until they have enough windows for an automaton, which only their contents pass.
    """
    texts, wide = spelled(contents)
    length = size * wide
    found: list[list[int]] = [[] for _ in contents]
    order = sorted(range(len(contents)), key=anchors.__getitem__)
    shard: list[int] = []
    windows = 0
    for at, i in enumerate(order):
        shard.append(i)
        windows += len(texts[i]) // wide - size + 1
        last = at + 1 == len(order)
        if last or (windows >= SHARD_WINDOWS and anchors[order[at + 1]] != anchors[i]):
            counts: Counter = Counter()
            for j in shard:
                text, weight = texts[j], weights[j]
                for k in range(0, len(text) - length + 1, wide):
                    counts[text[k : k + length]] += weight
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for window, n in counts.items():
                if n > 1:
                    automaton.add_word(window)
            if len(automaton):
                automaton.make_automaton()
                for j in shard:
                    found[j] = [(end + 1 - length) // wide for end, _ in automaton.iter(texts[j])]
            shard, windows = [], 0
    return found


def repeated_spans(packed: DataFrame, buckets: int) -> DataFrame:
    """Packed spans of words, by row, that a recurring window covers."""

    def judged(table: pa.Table) -> pa.Table:
        contents, (which, anchor, row, first), settled = unpacked_segments(table)
        del table
        weights = np.bincount(which, minlength=len(contents)).tolist()
        anchors = np.zeros(len(contents), np.int64)
        anchors[which] = anchor
        spans = []
        for places in occurrences(contents, weights, anchors.tolist()):
            p = np.array(places, np.int64)
            spans.append(merged_spans(np.zeros(len(p), np.int64), p, p + SIZE)[1:])
        many = np.array([len(f) for f, _ in spans], np.int64)
        begin = np.cumsum(many) - many
        firsts = np.concatenate([np.empty(0, np.int64), *[f for f, _ in spans]])
        pasts = np.concatenate([np.empty(0, np.int64), *[p for _, p in spans]])
        times = many[which]
        at = np.repeat(begin[which] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        base = np.repeat(first, times)
        found = (np.repeat(row, times), firsts[at] + base, pasts[at] + base)
        return packed_spans(*merged_spans(*(np.concatenate(p) for p in zip(found, settled, strict=True))), buckets)

    return dealt(packed).groupBy("bucket").applyInArrow(judged, SPANS)


CUT = struct_of(n_words=LONG, n_removed=LONG, kept_sha256=STRING, kept=STRING)


def cutter(with_text: bool):
    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, firsts: pa.Array, pasts: pa.Array) -> pa.Array:
        rows = []
        for text, f, p in zip(texts, firsts, pasts, strict=True):
            words = (text.as_py() or "").encode().split()
            left, at = [], 0
            for a, b in zip(unplaned(f.as_py()).tolist(), unplaned(p.as_py()).tolist(), strict=True) if f.is_valid else ():
                left += words[at:a]
                at = b
            left += words[at:]
            kept = b" ".join(left)
            rows.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.name for f in CUT])

    return cut


def dedup(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> tuple[DataFrame, str]:
    """The documents with a struct (n_words, n_removed, kept_sha256, kept), and that column's name.

    `kept`, the words left joined by one blank, is null unless `with_text`.
    """
    bounded_batches(documents.sparkSession)
    row, other, found = (free_name(documents, c) for c in ("row_key", "spans_row_key", "cut"))
    keyed = documents.withColumn(row, F.xxhash64(F.col(doc_id), F.col(text)))
    plain = keyed.select(F.col(row).alias("row"), F.col(text).alias("text")).filter(F.octet_length("text") >= 2 * SIZE - 1)
    buckets = bucket_count(plain, "text")
    again = stored(recurring(entries(plain, buckets), buckets, across=False), "anchors")
    flagged = plain.join(again, F.col("row") == F.col("owner"))
    spans = stored(spans_by_row(repeated_spans(segments(flagged, buckets), buckets)), "spans")
    spans = spans.withColumnsRenamed({"row": other, "firsts": f"{other}_f", "pasts": f"{other}_p"})
    table = keyed.join(spans, F.col(row) == F.col(other), "left")
    table = table.withColumn(found, cutter(with_text)(F.col(text), F.col(f"{other}_f"), F.col(f"{other}_p")))
    return table.select(*[F.col(f"`{c}`") for c in documents.columns], found), found


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""
    table, found = dedup(documents.select(doc_id, text), doc_id, text)
    return table.select(F.col(doc_id), *[F.col(found)[c].alias(c) for c in ("n_words", "n_removed", "kept_sha256")])
