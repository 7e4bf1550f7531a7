"""Words between the six ASCII blanks, as places in a buffer and as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from ratecube.llm.anchors import MIX, mixed

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
#: Random but fixed values of bytes, and the base of the words' polynomials.
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32
#: Bytes hashed in one go.
RUN = 1 << 20


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where words begin, where they end, first word of each text and the number of words)."""
    inside = _INSIDE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words have equal hashes; others almost never."""
    out = np.empty(len(starts), np.uint64)
    powers = np.cumprod(np.full(int((ends - starts).max(initial=1)), _BASE, np.uint64))
    done = 0
    while done < len(starts):
        to = max(done + 1, int(np.searchsorted(ends, starts[done] + RUN, "right")))
        lengths = ends[done:to] - starts[done:to]
        firsts = np.cumsum(lengths) - lengths
        inner = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
        values = _VALUES[data[inner + np.repeat(starts[done:to], lengths)]] * powers[inner]
        out[done:to] = mixed(np.add.reduceat(values, firsts) + lengths.astype(np.uint64) * MIX)
        done = to
    return out
