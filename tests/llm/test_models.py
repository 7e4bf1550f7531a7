"""Held-out accuracy of the fitted operators, and their exact parts against plain versions."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratecube.llm import language_id, toxicity


def labelled_texts(n=240):
    """Texts of common words, of which each third is toxic and has two or three words of a list."""
    rng = random.Random(11)
    common = [f"word{i}" for i in range(60)]
    bad = ["vilest", "rotten", "dumbest", "crude"]
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        words = rng.choices(common, k=40) + (rng.choices(bad, k=rng.randint(2, 3)) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def test_toxicity_of_held_out_texts(spark):
    rows = labelled_texts()
    docs = spark.createDataFrame([*rows, (None, None, None), (900, "", None), (901, "x " * 50_000 + "rotten vilest", None)], "doc_id long, text string, learn int")
    labels = spark.createDataFrame([*((i, t) for i, _, t in rows), (0, None), (1, 0), (1, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels, ~held_out()).collect()}
    truth = {i: t for i, _, t in rows}
    right = [(got[i].score >= toxicity.THRESHOLD) == bool(truth[i]) for i in truth if not got[i].learn]
    assert len(right) > 40 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[None].score == got[900].score < 0.5
    assert all(truth[e.doc_id] == e.toxic and got[e.doc_id].learn for r in got.values() for e in r.evidence)


def test_no_toxic_label_scores_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scores(docs, labels, F.lit(True)).collect()] == [0.0]
    assert toxicity.scores(docs.limit(0), labels, F.lit(True)).count() == 0


@pytest.mark.parametrize("copies", [True, False])
def test_toxic_words_stay_terms_beside_long_texts(spark, copies):
    """Twenty toxic texts of 250 words each, equal or almost, and a word of eight other toxic texts."""
    rng = random.Random(6)
    long = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(250)]
    texts = [(" ".join(long) + (" twin" if copies else f" twin{i}"), 1) for i in range(20)]
    texts += [(f"some plain words {i} vilest", 1) for i in range(8)] + [(f"some plain words {i} here", 0) for i in range(200)]
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(texts)), (500, "plain words vilest")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels, F.col("doc_id") < 500).collect()}
    assert got[500].score >= toxicity.THRESHOLD and all(20 <= e.doc_id < 28 for e in got[500].evidence) and got[500].evidence
    assert bool(got[0].evidence) != copies
    assert got[100].score < 0.5


def test_equal_texts_are_one_example(spark):
    """Each text five times, the first copy with another label: no copy is evidence beside another one."""
    rows = [(i * 5 + c, f"plain words {i} " + ("vilest rotten" if i < 12 else "here"), int(i < 12 and c > 0)) for i in range(40) for c in range(5)]
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), (900, "words vilest")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels, F.col("doc_id") < 900).collect()}
    assert len(got) == len(rows) + 1 and got[900].score >= toxicity.THRESHOLD
    assert all(e.doc_id % 5 == 0 and e.toxic == 1 for r in got.values() for e in r.evidence)
    assert len({e.doc_id for e in got[900].evidence}) == 3
    assert all(got[i].score == got[i - i % 5].score for i, _, _ in rows)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    examples = []
    for i in range(500):
        ids = sorted(rng.choice(40, rng.integers(1, 6), replace=False).tolist())
        examples.append((i, int(rng.integers(0, 2)), ids, rng.integers(1, 5, len(ids)).tolist()))
    idf = rng.uniform(0.5, 4, 40)
    index = toxicity.Index(40, idf, examples)

    def vector(ids, counts):
        w = {t: (1 + math.log(c)) * idf[t] for t, c in zip(ids, counts, strict=True)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    known = {e[0]: vector(e[2], e[3]) for e in examples}
    for _ in range(60):
        ids = sorted(rng.choice(40, rng.integers(1, 8), replace=False).tolist())
        counts = rng.integers(1, 4, len(ids)).tolist()
        query = vector(ids, counts)
        plain = sorted((-round(sum(w * v.get(t, 0) for t, w in query.items()), 12), d) for d, v in known.items())
        plain = [(d, -s) for s, d in plain if s < 0][: toxicity.K]
        near = index.nearest(ids, counts)
        assert [round(c, 9) for _, c in near] == [round(min(1.0, s), 9) for _, s in plain]
        assert [int(index.ids[e]) for e, _ in near] == [d for d, _ in plain] or len({round(s, 9) for _, s in plain}) < len(plain)


def test_forward_backward_is_exact(monkeypatch):
    monkeypatch.setattr(language_id, "SEGMENT", 2)  # several segments in each sequence
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(9, 3)), np.exp(rng.normal(size=(3, 3)))
    first = np.array([0, 3, 3, 4, 9])
    gamma, _ = language_id.posteriors(scores, first, moves)
    for a, b in zip(first, first[1:], strict=False):
        total = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            p = sum(moves[y, path[0]] for y in range(3)) if path else 0
            for k, label in enumerate(path):
                p *= np.exp(scores[a + k, label]) * (moves[path[k - 1], label] if k else 1)
            for k, label in enumerate(path):
                total[k, label] += p
        if b > a:
            assert np.allclose(total / total.sum(axis=1, keepdims=True), gamma[a:b])


def test_sample_takes_distinct_texts_and_long_ones_last(spark):
    long = "1. 2. " * 2000 + "ein langer text " * 1000
    rows = [(i, "copied words", "aa") for i in range(1000)] + [(1000 + i, f"own words {i}", "aa") for i in range(20)]
    rows += [(2000 + i, "1234", "bb") for i in range(300)] + [(3000, "petit texte", "bb"), (3001, "petit texte", "bb"), (4000, long, "cc"), (4001, None, "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(docs, "doc_id", "text", "lang")
    assert sorted(t for t, lang in got if lang == "aa") == sorted(["copied words", *(f"own words {i}" for i in range(20))])
    assert [t for t, lang in got if lang == "bb"] == ["petit texte"]
    (only,) = [t for t, lang in got if lang == "cc"]
    assert long.endswith(only + long[len(only) + 12_000 :]) and only.startswith("ein langer text") and 1000 < len(only) <= language_id.SAMPLE_BYTES


def test_language_of_held_out_and_switched_texts(spark):
    rng = random.Random(2)
    ends = {"aa": ["ung", "heit", "lich"], "bb": ["tion", "ment", "eux"], "cc": ["ado", "ción", "osa"]}

    def text(lang, n):
        return " ".join("".join(rng.choices("bdklmnprst", k=2)) + rng.choice("aeiou") + rng.choice(ends[lang]) for _ in range(n))

    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    odd = [(500, None, "aa"), (501, "", None), (502, "12 34 !", None), (503, "²", None), (None, text("bb", 5), None)]
    odd += [(504, text("aa", 30) + " " + text("bb", 20), None), (505, text("cc", 20_000), None)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string")
    train = docs.filter("doc_id % 4 <> 2")
    got = {r.doc_id: r for r in language_id.label(docs, language_id.labeller(train), ["doc_id"]).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i % 4 == 2)
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und"] * 4
    assert (got[None].lang_pred, got[505].lang_pred) == ("bb", "cc")
    labels = [r.lang for r in got[504].runs for _ in range(r.last - r.first + 1)]
    assert sum(a == b for a, b in zip(labels, ["aa"] * 30 + ["bb"] * 20, strict=True)) >= 46
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.label(docs, language_id.labeller(docs.limit(0)), ["doc_id"])
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_languages_beyond_the_bound_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(i, f"ein wort {i}", "aa") for i in range(6)] + [(10 + i, f"un mot {i}", "bb") for i in range(5)]
    rows += [(20, "una palabra", "cc"), (21, "una palabra", "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.labeller(docs).languages == ["aa", "bb"]
    assert language_id.labeller(docs.filter("doc_id >= 20")).languages == ["cc", "dd"]


def test_sample_ranked_in_parts_equals_one_ranking(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCUMENTS", 7)
    rows = [(i, f"text {i % 90}", "aa" if i % 5 else "bb") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    in_parts = language_id.sample(docs, "doc_id", "text", "lang")
    monkeypatch.setattr(language_id, "SAMPLE_PARTS", 1)
    assert in_parts == language_id.sample(docs, "doc_id", "text", "lang") and len(in_parts) == 14


def test_labels_beside_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "ein wort", "aa", 5, 6), (2, "ein wort", "aa", 5, 6)], "doc_id long, text string, lang string, label int, __label int")
    got = language_id.label(docs, language_id.labeller(docs), ["doc_id", "label", "__label"])
    assert got.columns == ["doc_id", "label", "__label", "lang_pred", "score", "runs"]
    assert [(r.doc_id, r.label, r.lang_pred) for r in got.orderBy("doc_id").collect()] == [(1, 5, "aa"), (2, 5, "aa")]
    assert language_id.label(docs.limit(0), language_id.labeller(docs), ["doc_id"]).count() == 0
