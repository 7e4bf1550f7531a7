"""Plain versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
CLEAN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(repeated)


def quality_kept(text):
    n, chars, symbols, lines, same, repeats = measures(text)
    return not (n < 50 or 100 * repeats > 50 * n or 10 * symbols > n or 2 * same > lines or chars < 2 * n or chars > 20 * n)


def benchmark_hits(documents, items, size=10):
    """(n_words, n_hit, sorted ids of items) for each text."""
    windows = defaultdict(set)
    for item, text in items:
        words = CLEAN.findall((text or "").translate(LOWER))
        if item is not None and words:
            for i in range(max(1, len(words) - size + 1)):
                windows[tuple(words[i : i + size])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for text in documents:
        words = CLEAN.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out.append((len(words), len(hit), sorted(found)))
    return out


def strings_removed(rows, size=50):
    """For (doc_id, text) rows the kept bytes and the number of removed runs."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - size + 1):
                s = b[p : p + size]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - size + 1):
                if first[b[p : p + size]] < i:
                    gone[p : p + size] = b"\1" * size
        runs = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((b, bytes(c for c, g in zip(b, gone, strict=True) if not g), runs))
    return out


def phrases_removed(rows, size=35):
    words = [WORD.findall(t or "") for t in rows]
    counts = Counter(tuple(w[p : p + size]) for w in words for p in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for p in range(len(w) - size + 1):
            if counts[tuple(w[p : p + size])] > 1:
                gone.update(range(p, p + size))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def shingles(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def jaccard_components(rows, percent=85, size=4):
    """(number of shingles, smallest id reached) for (doc_id, text) rows."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(len(s), least.get(root(i)) if rows[i][0] is not None else None) for i, s in enumerate(sets)]
