"""Copies of one text, each with changes of its own, are compared with that text and not all with all."""

import numpy as np
from llm import brute

from ratecube.llm import set_sketch


def test_pairs_grow_with_the_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(160):
        copy = list(base)
        for at in rng.choice(200, 5 + k % 6, replace=False):
            copy[at] = f"x{k}_{at}"
        texts.append(" ".join(copy))
    texts.insert(100, " ".join(base))
    own = list(enumerate(texts))
    compared, plain = [], set_sketch.links

    def counted(pairs, nodes, sets):
        compared.append(pairs.count())
        return plain(pairs, nodes, sets)

    monkeypatch.setattr(set_sketch, "links", counted)
    found = set_sketch.join(spark.createDataFrame(own, "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect())
    expected = brute.jaccard_components(own, 80, 2)
    assert got == [(i, *m, i == m[1]) for (i, _), m in zip(own, expected, strict=True)]
    assert sum(compared) <= 4 * len(own)
