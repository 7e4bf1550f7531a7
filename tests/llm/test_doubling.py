"""Rank doubling: the order of all suffixes, and how much is sorted for it."""

import numpy as np
import pytest

from ratecube.llm import suffix_dedup


@pytest.mark.parametrize("kinds", [2, 3, 258, 100_000])
def test_order_of_all_suffixes(kinds):
    rng = np.random.default_rng(kinds)
    for n in (1, 2, 3, 8, 60, 300):
        for text in (np.append(rng.integers(1, kinds, n - 1), 0), np.zeros(n), np.tile(rng.integers(0, kinds, 5), n)[:n]):
            text = text.astype(np.int32)
            assert suffix_dedup.doubled(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_only_equal_suffixes_are_sorted_again(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(2, 258, 20_000).astype(np.int32)
    text[5000:5600] = text[:600]
    sizes, plain = [], np.argsort

    def counted(values, *args, **kwargs):
        sizes.append(len(values))
        return plain(values, *args, **kwargs)

    monkeypatch.setattr(suffix_dedup.np, "argsort", counted)
    order = suffix_dedup.doubled(text)
    assert (np.sort(order) == np.arange(len(text))).all()
    assert sum(sizes) <= 2 * len(text)
