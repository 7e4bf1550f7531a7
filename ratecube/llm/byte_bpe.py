"""Byte-level BPE encoding and decoding.

Pre-tokens are found without a regular expression: an array of character classes is turned into
elements of the transition monoid of a small automaton, whose products, taken in blocks, give the
automaton's state after every character; states on both sides of a place say whether a pre-token
begins there. The pre-tokens of a batch, as slices of its bytes, go through a cache of merged pieces;
pieces that the cache lacks are merged together, in rounds over arrays.

Defined cases: a null or empty text has no ids, and decodes to no bytes; repeated rows are encoded
each for itself; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecube.llm.common import BINARY, INT, LONG, STRING, bounded_batches, list_of, release_memory, struct_of, utf8_buffer

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The cache of merged pieces holds about so many bytes at most, of pieces of up to TOGETHER bytes.
CACHE_BYTES = 24 << 20
#: What an entry takes beside its bytes.
ENTRY_BYTES = 180
#: Longer pieces are merged one by one, the rest together.
TOGETHER = 48

# Character classes.
SPACE, BLANK, QUOTE, LETTER, NUMBER, OTHER, ONE, R, V, L, E = range(11)
#: Characters with the White_Space property other than the space.
WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# States after a character. Q: a quote that may begin a contraction; QR, QV, QL: and the letter after it.
START, IN_SPACE, IN_BLANK, IN_LETTER, IN_NUMBER, IN_OTHER, Q, QR, QV, QL, DONE = range(11)
STATES = 11


def _step(state: int, kind: int) -> int:
    if kind == SPACE:
        return IN_SPACE
    if kind == BLANK:
        return IN_BLANK
    if kind == NUMBER:
        return IN_NUMBER
    if kind == OTHER:
        return IN_OTHER
    if kind == QUOTE:
        return IN_OTHER if state in (IN_OTHER, IN_SPACE, Q) else Q
    if state == Q:
        return {ONE: DONE, R: QR, V: QV, L: QL}.get(kind, IN_LETTER)
    if (state in (QR, QV) and kind == E) or (state == QL and kind == L):
        return DONE
    return IN_LETTER


@lru_cache(1)
def character_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))[0]
        if category == "L":
            table[point] = LETTER
        elif category == "N":
            table[point] = NUMBER
    table[WHITE] = BLANK
    for characters, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in characters]] = kind
    return table


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(product, element by class, result by element and state). Element 0 changes nothing.

    The second half of the classes is for the first character of a text: it forgets what was before.
    """
    single = [tuple(_step(s, kind) for s in range(STATES)) for kind in range(11)]
    first = [(_step(START, kind),) * STATES for kind in range(11)]
    elements = {tuple(range(STATES)): 0}
    todo = [*elements, *single, *first]
    for f in todo:
        elements.setdefault(f, len(elements))
    done = list(elements)
    for f in done:  # grows until every product with a generator is known
        for g in {*single, *first}:
            h = tuple(g[s] for s in f)
            if h not in elements:
                elements[h] = len(elements)
                done.append(h)
    names = list(elements)
    product = np.array([[elements[tuple(g[s] for s in f)] for g in names] for f in names], np.uint8)
    return product, np.array([elements[f] for f in single + first], np.uint8), np.array(names, np.uint8)


def scanned(kinds: np.ndarray, firsts: np.ndarray, block: int = 64) -> np.ndarray:
    """The automaton's state after each character; texts begin at `firsts`."""
    product, element, result = monoid()
    n = len(kinds)
    chosen = kinds.astype(np.int64)
    chosen[firsts] += 11
    rows = -(-n // block)
    grid = np.zeros((block, rows), np.uint8)  # down a column: one block; the last is filled with element 0
    flat = np.zeros(rows * block, np.uint8)
    flat[:n] = element[chosen]
    grid[:] = flat.reshape(rows, block).T
    for i in range(1, block):  # products within all blocks at once
        grid[i] = product[grid[i - 1], grid[i]]
    whole = grid[-1]
    before = np.zeros(rows, np.uint8)  # state in front of each block
    if rows > 4096:
        before[1:] = scanned_elements(whole[:-1], block)
    else:
        state = START
        for i, e in enumerate(whole.tolist()):
            before[i] = state
            state = int(result[e, state])
    return result[grid, before].T.reshape(-1)[:n]


def scanned_elements(elements: np.ndarray, block: int) -> np.ndarray:
    """States after each of a row of elements, from START."""
    product, _, result = monoid()
    n = len(elements)
    rows = -(-n // block)
    flat = np.zeros(rows * block, np.uint8)
    flat[:n] = elements
    grid = np.ascontiguousarray(flat.reshape(rows, block).T)
    for i in range(1, block):
        grid[i] = product[grid[i - 1], grid[i]]
    before = [START]
    for e in grid[-1, :-1].tolist():
        before.append(int(result[e, before[-1]]))
    return result[grid, np.array(before)].T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; texts (none empty) begin at `firsts`."""
    n = len(points)
    kinds = character_classes()[points]
    state = scanned(kinds, firsts)
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    last = first[1:]  # the character is the last of its text
    prev = np.empty(n, np.uint8)
    prev[1:] = state[:-1]
    prev[firsts] = START
    following = np.empty(n, np.uint8)
    following[:-1] = state[1:]
    following[last] = START
    white = kinds <= BLANK
    white_next = np.empty(n, bool)
    white_next[:-1] = white[1:]
    white_next[last] = True  # white space up to the end of a text is one piece
    after_white = (prev == IN_SPACE) | (prev == IN_BLANK)
    joined = np.zeros((3, STATES), bool)  # the character goes on with what was before
    joined[0, [IN_LETTER, IN_SPACE, QR, QV, QL]] = True
    joined[1, [IN_NUMBER, IN_SPACE]] = True
    joined[2, [IN_OTHER, IN_SPACE, Q]] = True
    row = np.where((kinds == OTHER) | (kinds == QUOTE), 2, np.where(kinds == NUMBER, 1, 0))
    on = joined[row, prev]
    letters = row == 0
    contraction = (prev == Q) & letters & ((state == DONE) | ((state >= QR) & (state <= QL) & (following == DONE)))
    starts = np.where(white, ~after_white | ~white_next, ~(on | contraction))
    starts[firsts] = True
    return starts


class Vocabulary:
    """Ranks by bytes, and the table of pairs of ids whose bytes together have a rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {rank: piece for piece, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                left, right = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.none = np.int64(1 << 40)
        bits = max(4, (4 * len(pairs) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        keys = np.full((1 << bits) + 64, -1, np.int64)
        values = np.full((1 << bits) + 64, self.none, np.int64)
        slots = self._slot(np.fromiter(pairs, np.int64, len(pairs)))
        self.probes = 1
        for slot, (key, rank) in sorted(zip(slots.tolist(), pairs.items(), strict=True)):
            at = slot
            while keys[at] >= 0:
                at += 1
            keys[at], values[at] = key, rank
            self.probes = max(self.probes, at - slot + 1)
        self.keys, self.values = keys, values
        self.cache: dict[bytes, bytes] = {}
        self.cached = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._slot(keys)
        found = np.where(self.keys[at] == keys, self.values[at], self.none)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] += 1
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found

    def merge_one(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first among equals; a heap of pairs, so long pieces stay cheap."""
        import heapq

        ids = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.pairs.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := self.pairs.get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def merge_together(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of one length, as little-endian bytes; each round merges the best pair of every piece."""
        n, width = len(pieces), len(pieces[0])
        ids = np.full((n, width + 1), -1, np.int64)  # the last column stays empty
        ids[:, :width] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8).reshape(n, width)]
        best = np.full((n, width), self.none)  # of each id and the one right of it
        best[:, : width - 1] = self.rank_of(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(n, width - 1)
        live, columns = np.arange(n), np.arange(width)
        now, ranks = ids.copy(), best
        while len(live):
            at = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(live)), at]
            some = rank < self.none
            if not some.all():
                ids[live[~some]] = now[~some]
                live, at, rank, now, ranks = live[some], at[some], rank[some], now[some], ranks[some]
                if not len(live):
                    break
            rows = np.arange(len(live))
            # What is right of the pair moves to the left.
            past = columns[None, :] > at[:, None]
            now[:, :width] = np.where(past, now[:, 1:], now[:, :width])
            ranks[:, : width - 1] = np.where(past[:, : width - 1], ranks[:, 1:], ranks[:, : width - 1])
            now[rows, at] = rank
            right, left = now[rows, at + 1], now[rows, np.maximum(at - 1, 0)]
            new = self.rank_of(np.append(rank, left), np.append(right, rank))
            ranks[rows, at] = np.where(right >= 0, new[: len(rows)], self.none)
            inner = at > 0
            ranks[rows[inner], at[inner] - 1] = new[len(rows) :][inner]
        kept = ids >= 0
        data = ids[kept].astype("<u4").tobytes()
        ends = list(accumulate((kept.sum(axis=1) * 4).tolist()))
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        cache, long = self.cache, {}
        missing = set(pieces).difference(cache)
        together = []
        for piece in missing:
            rank = self.ranks.get(piece)
            if rank is not None:
                cache[piece] = rank.to_bytes(4, "little")
            elif len(piece) <= TOGETHER:
                together.append(piece)
            else:
                long[piece] = np.array(self.merge_one(piece), "<u4").tobytes()
        together.sort(key=len)
        for _, same in groupby(together, len):
            same = list(same)
            for at in range(0, len(same), 8_000):
                some = same[at : at + 8_000]
                cache.update(zip(some, self.merge_together(some), strict=True))
        out = [cache[p] if p in cache else long[p] for p in pieces] if long else [cache[p] for p in pieces]
        self.cached += sum(len(p) + len(cache[p]) + ENTRY_BYTES for p in missing if p in cache)
        if self.cached > CACHE_BYTES:
            self.forget()
        return out

    def forget(self) -> None:
        self.cache, self.cached = {}, 0

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Texts are encoded in runs of about so many bytes.
RUN_BYTES = 1 << 20


def encode_texts(texts: pa.Array, known: Vocabulary):
    """For each text its ids, as bytes, and for each id's pre-token where it begins: (ids, offsets).

    `offsets` are byte positions of the pre-tokens in their text.
    """
    data, bounds = utf8_buffer(texts)
    n, at = len(bounds) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUN_BYTES, "right")) - 1)
        raw = data[bounds[at] : bounds[to]].tobytes()
        local = bounds[at : to + 1] - bounds[at]
        points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        if len(points):
            widths = np.ones(len(points), np.int64)
            for least in (0x80, 0x800, 0x10000):
                widths += points >= least
            places = np.cumsum(widths) - widths
            firsts = np.searchsorted(places, local[:-1][np.diff(local) > 0])
            starts = places[piece_starts(points, firsts)]
        else:
            starts = np.empty(0, np.int64)
        ends = np.append(starts[1:], len(raw)).tolist()
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
        codes = known.encode_pieces(pieces)
        cuts = np.searchsorted(starts, local)
        for i in range(to - at):
            yield b"".join(codes[cuts[i] : cuts[i + 1]]), starts[cuts[i] : cuts[i + 1]] - local[i]
        at = to


DIGEST = struct_of(n_tokens=LONG, n_pieces=LONG, ids_sha256=STRING, decoded_sha256=STRING)
ENCODED = struct_of(ids=list_of(INT), piece_offsets=list_of(LONG))


def digest_udf(path: str):
    def digest_of(texts: pa.Array, known: Vocabulary) -> pa.Array:
        rows = []
        for ids, offsets in encode_texts(texts, known):
            back = known.decode(np.frombuffer(ids, "<u4"))
            rows.append((len(ids) // 4, len(offsets), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
        names = ["n_tokens", "n_pieces", "ids_sha256", "decoded_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    @F.arrow_udf(DIGEST)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocabulary(path)
        for texts in batches:
            yield digest_of(texts, known)
        known.forget()
        release_memory()

    return digest


def default_path() -> str:
    return public_tokenizers.path(RANKS)


def encode(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """(keep, ids, piece_offsets): token ids, and the byte offsets of the pre-tokens they were merged in."""
    path = path or default_path()
    bounded_batches(documents.sparkSession)

    @F.arrow_udf(ENCODED)
    def encoded(texts: pa.Array) -> pa.Array:
        rows = list(encode_texts(texts, vocabulary(path)))
        ids = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in rows], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([ids, pa.array([o for _, o in rows], pa.list_(pa.int64()))], ["ids", "piece_offsets"])

    return documents.select(*keep, encoded(F.col(text)).alias("__bpe")).select(*keep, "__bpe.*")


def decode(tokens: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """(keep, data): the bytes of the ids; null ids give no bytes. An unknown id is an error."""
    path = path or default_path()

    @F.arrow_udf(BINARY)
    def decoded(column: pa.Array) -> pa.Array:
        known = vocabulary(path)
        return pa.array([known.decode(np.array(x.as_py() or [], np.int64)) for x in column], pa.binary())

    return tokens.select(*keep, decoded(F.col(ids)).alias("data"))


def digests(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """(keep, n_tokens, n_pieces, ids_sha256, decoded_sha256) for each row."""
    bounded_batches(documents.sparkSession)
    done = documents.select(*keep, digest_udf(path or default_path())(F.col(text)).alias("__bpe"))
    return done.select(*keep, "__bpe.*")
