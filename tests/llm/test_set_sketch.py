"""Near-duplicates by SetSketch: components by brute force, and the properties of the registers."""

import numpy as np
from llm import brute

from ratecube.llm import set_sketch


def rows(table):
    return sorted((tuple(r) for r in table.collect()), key=repr)


def expected(own):
    found = brute.jaccard_components(own, 80, 2)
    return sorted(((i, *m, i is None or i == m[1]) for (i, _), m in zip(own, found, strict=True)), key=repr)


def test_components(docs, no_docs):
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = expected(own)
    assert sum(not w[3] for w in want) >= 5
    assert rows(set_sketch.join(docs)) == want
    assert set_sketch.join(no_docs).collect() == []


def test_nothing_alike(spark):
    table = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, None), (4, "")], "doc_id long, text string")
    assert rows(set_sketch.join(table)) == [(1, 2, 1, True), (2, 1, 2, True), (3, 0, 3, True), (4, 0, 4, True)]


def test_chains_and_groups(spark):
    """Chains whose ends don't link, a large group of near copies of one text, and texts just below the threshold."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[7 * i : 7 * i + 120]) for i in range(12)]
    base = words[1000:1150]
    for k in range(60):
        copy = list(base)
        for at in rng.integers(0, len(copy), k % 5):
            copy[at] = f"x{k}_{at}"
        texts.append(" ".join(copy))
    for k in range(8):  # alike by about 0.7, each by a part of its own
        texts.append(" ".join([*words[2000:2100], *(f"y{k}_{i}" for i in range(20))]))
    own = list(enumerate(texts))
    got = rows(set_sketch.join(spark.createDataFrame(own, "doc_id int, text string")))
    assert got == expected(own)


def test_two_texts_of_one_id(spark):
    own = [(1, "one two three four"), (2, "one two three four"), (2, "some other words"), (5, "some other words"), (5, "")]
    assert rows(set_sketch.join(spark.createDataFrame(own, "doc_id long, text string"))) == expected(own)


def random_pair(rng, n, m, common):
    pool = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64)
    return np.unique(pool[:n]), np.unique(pool[n - common :])


def test_registers_merge_and_depend_on_the_set_alone():
    rng = np.random.default_rng(1)
    for n, m, common in ((1, 1, 0), (5, 300, 3), (4000, 50, 20), (60_000, 3, 3)):
        left, right = random_pair(rng, n, m, common)
        both = set_sketch.sketch(np.union1d(left, right))
        assert (set_sketch.merged(set_sketch.sketch(left), set_sketch.sketch(right)) == both).all()
        assert (set_sketch.sketch(rng.permutation(left)) == set_sketch.sketch(left)).all()
    assert not set_sketch.sketch(np.empty(0, np.uint64)).any()


def test_estimates_and_bands():
    """The estimate is within what its deviation allows; hardly a pair at the threshold shares no band or is ruled out."""
    rng = np.random.default_rng(5)
    for n, m, common in ((90, 90, 80), (100, 80, 80), (900, 900, 800), (500, 500, 100), (30, 200, 10)):
        true = common / (n + m - common)
        pairs = [random_pair(rng, n, m, common) for _ in range(120)]
        left, right = (np.array([set_sketch.sketch(p[side]) for p in pairs]) for side in (0, 1))
        found, gain = set_sketch.estimated(left, right, np.full(120, float(n)), np.full(120, float(m)))
        assert abs(found.mean() - true) < 0.01 and np.abs(found - true).max() < 0.13
        shared = (left.reshape(120, -1, set_sketch.ROWS_OF_BAND) == right.reshape(120, -1, set_sketch.ROWS_OF_BAND)).all(axis=2).any(axis=1)
        if true >= 0.8:
            assert shared.all() and (gain <= set_sketch.UNLIKELY).all()
        elif true < 0.2:
            assert shared.mean() < 0.1 and (gain > set_sketch.UNLIKELY).all()
