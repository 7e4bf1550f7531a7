"""Operators against plain versions, on texts with all the defined cases."""

import tiktoken
from llm import brute
from pyspark.sql import functions as F

from ratecube.llm import byte_bpe, decontaminate, licenses, ngram_join, phrase_dedup, quality, sharding, suffix_dedup


def rows(table):
    return sorted((tuple(r) for r in table.collect()), key=repr)


def expected(docs, make):
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    return sorted(((i, *m) for (i, _), m in zip(own, make(own), strict=True)), key=repr)


def test_quality_ledger(docs, no_docs):
    table, measures, failures = quality.ledger(docs)
    got = rows(table.select("doc_id", *[F.col(measures)[c] for c in quality.MEASURES], quality.passes(F.col(failures), "v1")))
    want = expected(docs, lambda own: [(*brute.measures(t), brute.quality_kept(t)) for _, t in own])
    assert got == want
    assert quality.kept(docs).columns == docs.columns
    assert quality.kept(docs).count() == sum(w[-1] for w in want)
    assert quality.kept(no_docs).count() == 0


def test_ablations_agree_with_counting(docs):
    table, _, failures = quality.ledger(docs)
    bits = [r[0] for r in table.select(failures).collect()]
    for r in quality.ablations(table, failures, "v1").collect():
        bit, whole = quality.mask((r.rule,)), quality.mask(quality.POLICIES["v1"])
        assert r.n_failed == sum(b & bit != 0 for b in bits)
        assert r.n_failed_only == sum(b & whole == bit for b in bits)
        assert r.n_kept == sum(b & whole == 0 for b in bits)
        assert r.n_kept_without == sum(b & (whole & ~bit) == 0 for b in bits)


def test_licenses_found_and_near_misses(spark):
    texts = [
        "Some words.\nLICENSED under the Apache License, version 2.0!",
        "Released under the MIT License.",
        "Released under the MIT License and a great many other words that say other things",
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.",
        None,
        "",
        "licence",
        "word " * 30_000,
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(table, ["doc_id"]).collect()}
    assert [got[i].licenses for i in range(8)] == ["Apache-2.0", "MIT", "", "CC-BY-4.0,CC-BY-NC-4.0", "", "", "", ""]
    assert got[0].best_license == "Apache-2.0" and got[0].best_dice == 1.0
    assert (got[3].best_license, got[3].n_units) == ("CC-BY-4.0", 3)
    assert (got[4].n_units, got[6].n_units, got[4].best_dice) == (0, 0, None)


def test_licenses_in_runs_of_lines_and_sentences(spark):
    gpl = licenses.BODIES["GPL-3.0"].split()
    texts = [
        "First some words.\nReleased under the\nMIT License.\nAnd then many other words that say other things.",
        "This text is about trees. Licensed under the Apache License, Version 2.0. It goes on about leaves.",
        "Copyright (c) 2020 A. Person\n\n" + licenses.BODIES["MIT"].replace(", ", ",\n") + "\n\n" + "more words " * 300,
        "int main;\n" * 50 + "\n".join("# " + " ".join(gpl[i : i + 9]) for i in range(0, len(gpl), 9)) + "\nimport this\n" * 50,
        licenses.BODIES["ISC"],
        licenses.BODIES["BSD-2-Clause"] + "\n" + "code X here\n" * 40,
        "Released under the old bridge.\nThe MIT is a school.\nA License to drive.",
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(table, ["doc_id"]).collect()}
    assert [got[i].best_license for i in range(7)] == ["MIT", "Apache-2.0", "MIT", "GPL-3.0", "ISC", "BSD-2-Clause", None]
    assert [got[i].licenses for i in (0, 1, 2, 4, 6)] == ["MIT", "Apache-2.0", "MIT", "ISC", ""]
    assert got[0].best_dice == got[1].best_dice == 1.0 and got[0].n_matches == 1


def test_decontamination(spark, docs, no_docs, rows_of_text):
    long = rows_of_text[12].split()
    items = [(1, " ".join(long[3:30])), (2, "one"), (3, "A, B c"), (10, " ".join(long[5:18])), (4, None), (5, ""), (None, long[0]), (2, "ab ab")]
    items.append((6, " ".join(rows_of_text[-4].split()[19_000:19_040]).upper()))
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def make(own):
        hits = brute.benchmark_hits([t for _, t in own], items)
        return [(n, h, len(i), brute.sha(",".join(i).encode()), h > 0) for n, h, i in hits]

    want = expected(docs, make)
    assert sum(w[5] for w in want) >= 3
    assert rows(decontaminate.report(docs, benchmark, ["doc_id"])) == want
    decontaminate.GROUP_WINDOWS, before = 7, decontaminate.GROUP_WINDOWS  # several sets of tables
    try:
        assert rows(decontaminate.report(docs, benchmark, ["doc_id"])) == want
    finally:
        decontaminate.GROUP_WINDOWS = before
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    assert decontaminate.clean_documents(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.report(no_docs, benchmark, ["doc_id"]).count() == 0


def test_suffix_array_dedup(docs, no_docs):
    def make(own):
        return [(len(b), len(b) - len(k), runs, brute.sha(k)) for b, k, runs in brute.strings_removed(own)]

    want = expected(docs, make)
    assert sum(w[2] > 0 for w in want) >= 8
    assert rows(suffix_dedup.report(docs)) == want
    assert suffix_dedup.report(no_docs).count() == 0
    left = suffix_dedup.shortened(docs)
    assert left.columns == docs.columns and left.count() == sum(w[2] < w[1] or w[1] == 0 for w in want)


def test_suffix_array_dedup_takes_int_ids(docs):
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert rows(suffix_dedup.report(ids)) == rows(suffix_dedup.report(docs))


def test_phrases(docs, no_docs):
    want = expected(docs, lambda own: brute.phrases_removed([t for _, t in own]))
    assert sum(w[2] > 0 for w in want) >= 8
    assert rows(phrase_dedup.report(docs)) == want
    assert phrase_dedup.report(no_docs).count() == 0


def test_many_words_take_two_letters(monkeypatch):
    contents = [b"a b c d", b"b c d e", b"x y a b"]
    plain = phrase_dedup.occurrences(contents, [1, 1, 1], [5, 5, 3], 3)
    monkeypatch.setattr(phrase_dedup, "LETTERS", 3)
    assert phrase_dedup.occurrences(contents, [1, 1, 1], [5, 5, 3], 3) == plain == [[1], [0], []]


def test_jaccard_components(docs, no_docs):
    want = expected(docs, brute.jaccard_components)
    assert rows(ngram_join.join(docs)) == want
    assert ngram_join.join(no_docs).count() == 0
    left = ngram_join.deduplicated(docs)
    own = {r.doc_id for r in left.collect()}
    assert own == {w[0] for w in want if w[0] == w[2]} | {None}
    assert left.columns == docs.columns and left.count() == len(own)


def test_texts_of_one_id_are_judged_each_for_itself(spark):
    copy, clean = "some words that two documents have alike", "quite other words that no other document has"
    table = spark.createDataFrame([(1, copy), (2, copy), (2, clean), (2, clean), (3, ""), (3, clean + " at all")], "doc_id int, text string")
    assert rows(ngram_join.deduplicated(table)) == sorted([(1, copy), (2, clean), (3, ""), (3, clean + " at all")], key=repr)


def test_chains_of_near_copies_are_one_component(spark):
    """Each text is near its neighbours only, so that most pairs don't link, and rounds must find the rest."""
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(words[7 * i : 7 * i + 120])) for i in range(12)] + [(50 + i, " ".join(words[i : i + 100])) for i in (300, 305)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(ngram_join.join(table)) == sorted(((i, *m) for (i, _), m in zip(texts, brute.jaccard_components(texts), strict=True)), key=repr)


def test_bpe_round_trip(docs, no_docs, rows_of_text):
    known = byte_bpe.vocabulary(byte_bpe.default_path())
    import public_tokenizers

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})

    def make(own):
        out = []
        for _, text in own:
            ids = encoding.encode_ordinary(text or "")
            data = b"".join(i.to_bytes(4, "little") for i in ids)
            out.append((len(ids), brute.sha(data), brute.sha((text or "").encode())))
        return out

    got = byte_bpe.digests(docs, ["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows(got) == expected(docs, make)
    back = byte_bpe.decode(byte_bpe.encode(docs, ["doc_id"]), ["doc_id"])
    assert rows(back) == expected(docs, lambda own: [((t or "").encode(),) for _, t in own])
    assert byte_bpe.digests(no_docs, ["doc_id"]).count() == 0


def test_sharding(spark, docs, no_docs, rows_of_text):
    hot = docs.unionByName(docs.limit(1).withColumn("text", F.lit("hot text")).crossJoin(spark.range(300)).withColumn("doc_id", F.col("id") + 1000).drop("id"))
    plan = sharding.plan(hot).collect()
    assert len(plan) == hot.count()
    for shard in range(8):
        slots = sorted(r.slot for r in plan if r.shard == shard)
        assert slots == list(range(len(slots)))
    texts = {r.doc_id: r.text for r in hot.collect() if r.doc_id is not None}
    import zlib

    for r in plan:
        if r.doc_id is not None:
            data = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert sharding.plan(no_docs).count() == 0


def test_packing_is_even():
    import numpy as np

    sizes = np.random.default_rng(3).integers(1, 1000, (5000, 3)).astype(float)
    chosen = sharding.pack(sizes, 8)
    sums = np.array([sizes[chosen == s].sum(axis=0) for s in range(8)])
    assert (sums.max(axis=0) / sums.min(axis=0)).max() < 1.02
