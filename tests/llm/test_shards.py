"""Suffix arrays in shards of whole anchors: what is in them, and that they are induced."""

import numpy as np
import pytest

from ratecube.llm import suffix_dedup
from ratecube.llm.anchors import anchored_runs, byte_grams
from ratecube.llm.common import FREE_SHUFFLES


def segments_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct segments around the anchors of the texts, and the first text that has each."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    known: dict[bytes, int] = {}
    for text, first, past, _ in anchored_runs(data, bounds, byte_grams, suffix_dedup.GRAM, suffix_dedup.SIZE):
        for t, a, b in zip(text.tolist(), first.tolist(), past.tolist(), strict=True):
            known.setdefault(data[a : b + suffix_dedup.SIZE - 1].tobytes(), t)
    return list(known), np.array(list(known.values()), np.int64)


@pytest.fixture
def sorted_texts(monkeypatch):
    """The texts whose suffixes are sorted at the top level."""
    texts, plain = [], suffix_dedup.suffix_array

    def noted(text, kinds):
        if kinds == 258:
            texts.append(text)
        return plain(text, kinds)

    monkeypatch.setattr(suffix_dedup, "suffix_array", noted)
    return texts


def copies_with_edits(n: int) -> list[bytes]:
    rng = np.random.default_rng(n)
    first = rng.integers(97, 123, 20_000).astype(np.uint8)
    texts = [first.tobytes()]
    for _ in range(n):
        copy = first.copy()
        copy[rng.integers(0, len(copy), 60)] = 65
        texts.append(copy.tobytes())
    return texts


@pytest.mark.parametrize("size", [1, 4000, 1 << 20])
def test_shards_find_what_one_array_finds(monkeypatch, sorted_texts, size):
    contents, owners = segments_of(copies_with_edits(6))
    want = suffix_dedup.covered_by_smaller(contents, owners)
    assert len(want[0])
    sorted_texts.clear()
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
    got = suffix_dedup.covered_in_shards(contents, owners)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert len(sorted_texts) > 1 or size == 1 << 20
    assert max(map(len, sorted_texts)) <= size + 4000


def test_segments_alone_with_their_anchor_are_not_sorted(sorted_texts):
    rng = np.random.default_rng(1)
    contents, owners = segments_of([rng.integers(97, 123, 5000).astype(np.uint8).tobytes() for _ in range(3)])
    assert [x.tolist() for x in suffix_dedup.covered_in_shards(contents, owners)] == [[], [], []]
    assert not sorted_texts
    assert [x.tolist() for x in suffix_dedup.covered_in_shards([], np.empty(0, np.int64))] == [[], [], []]


def test_small_arrays_are_induced(monkeypatch):
    sizes, plain = [], suffix_dedup.doubled

    def noted(text):
        sizes.append(len(text))
        return plain(text)

    monkeypatch.setattr(suffix_dedup, "doubled", noted)
    text = np.append(np.random.default_rng(2).integers(1, 4, 999), 0).astype(np.int32)
    assert suffix_dedup.suffix_array(text, 4).tolist() == sorted(range(1000), key=lambda i: text[i:].tolist())
    assert max(sizes, default=0) <= 500


@pytest.mark.parametrize("kinds", [2, 3, 258])
def test_recursion_with_names_in_two_digits(monkeypatch, kinds):
    monkeypatch.setattr(suffix_dedup, "SMALL", 4)
    monkeypatch.setattr(suffix_dedup, "FEW_NAMES", 8)
    rng = np.random.default_rng(kinds)
    for n in (1, 2, 3, 8, 60, 400):
        for text in (rng.integers(1, kinds, n), np.tile(rng.integers(1, kinds, 5), n)[:n], np.ones(n)):
            text = np.append(text, 0).astype(np.int32)
            assert suffix_dedup.suffix_array(text, kinds).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


def test_shuffles_of_stored_steps_are_freed(spark, monkeypatch):
    seen, plain, before = [], suffix_dedup.stored, spark.conf.get(FREE_SHUFFLES, None)

    def noted(table, name):
        seen.append(spark.conf.get(FREE_SHUFFLES))
        return plain(table, name)

    monkeypatch.setattr(suffix_dedup, "stored", noted)
    table = suffix_dedup.report(spark.createDataFrame([(1, "ab" * 40), (2, "ab" * 40)], "doc_id long, text string"))
    assert seen == ["true", "true"] and spark.conf.get(FREE_SHUFFLES, None) == before
    for _ in range(2):
        assert sorted((r.doc_id, r.n_removed) for r in table.collect()) == [(1, 0), (2, 80)]
