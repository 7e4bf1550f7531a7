"""Ranked search against plain scores, and the bounds of the ball tree."""

import math
import random
import re
from collections import Counter

import numpy as np
from llm import brute

from ratecube.llm import ball_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(brute.LOWER))


def expected(documents, items, top=20):
    own = [(i, Counter(terms(t))) for i, t in documents]
    n, total = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in set(items):
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, query in asked.items():
        found = []
        for i, c in own:
            m = 100 - 25 + 25 * c.total() * n // total if total else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in query.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, None if null else i, -s))
    return sorted(out, key=repr)


def rows(table):
    return sorted((tuple(r) for r in table.collect()), key=repr)


def benchmark(rows_of_text):
    rng = random.Random(3)
    words = [w for t in rows_of_text if t for w in t.split()[:150]]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(25)]
    items += [(30, rows_of_text[9]), (31, None), (32, ""), (33, "nothing-known-here q!"), (None, words[0]), (30, rows_of_text[10]), (34, "A a AND again"), (0, items[0][1])]
    return items


def test_ranks(spark, docs, no_docs, rows_of_text):
    items = benchmark(rows_of_text)
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = expected(own, items)
    assert len(want) > 300
    assert rows(ball_search.rank(docs, table)) == want
    assert ball_search.rank(no_docs, table).collect() == []
    assert ball_search.rank(docs, table.limit(0)).collect() == []


def test_groups_and_ties(spark, monkeypatch):
    """Several groups of items, and far more equal documents than places."""
    monkeypatch.setattr(ball_search, "GROUP_TERMS", 6)
    texts = ["red green blue"] * 70 + ["red green"] * 30 + ["blue sky Ünder 9"] * 3 + [None]
    own = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, "red green blue")] * 2
    items = [(1, "red"), (2, "green blue blue"), (3, "ünder 9"), (4, "Sky RED"), (5, "blue green red sky")]
    got = ball_search.rank(spark.createDataFrame(own, "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == expected(own, items)


def test_long_texts_are_read_in_runs(monkeypatch):
    text = "Ab, c-é " * 50 + "x" * 90 + "! end"
    whole = list(ball_search.terms_of(text))
    monkeypatch.setattr(ball_search, "RUN_BYTES", 7)
    assert list(ball_search.terms_of(text)) == whole == [t.encode() for t in terms(text)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 30, 800)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    # Documents of four kinds, whose terms hardly overlap.
    parts = [np.sort(rng.choice(120, s, replace=False)) + 100 * (d % 4) for d, s in enumerate(sizes)]
    tree = ball_search.Tree(starts, np.concatenate(parts), rng.integers(1, 900_000, starts[-1]))
    weights = np.zeros((500, 40), np.int64)
    for q in range(40):
        weights[rng.choice(120, 12, replace=False) + 100 * (q % 4), q] = rng.integers(1, 9000, 12)
    own = weights[tree.known]
    scores, bounds = tree.scores(np.arange(800), own), tree.bounds(own.astype(float))
    dense = np.zeros((800, 500), np.int64)
    dense[np.repeat(np.arange(800), sizes), np.concatenate(parts)] = tree.values
    assert (scores == dense @ weights).all()
    for node, rows_ in enumerate(tree.rows):
        assert (scores[rows_].max(axis=0) <= bounds[node]).all()
    found = ball_search.Found(np.zeros(40, np.int64))
    ball_search.search(tree, list(range(800)), weights, found)
    for q in range(40):
        order = sorted((-s, d) for d, s in enumerate(scores[:, q].tolist()) if s > 0)[:20]
        assert [(s, i) for s, _, i in found.best[q]] == order
    assert found.visited < 0.75 * 800 * 40
