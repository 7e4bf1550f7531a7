"""The pipeline against plain stages, on the smallest tables."""

import corpus_pipeline
import public_tokenizers
import tiktoken
from llm import brute

from ratecube.llm import byte_bpe

SF_DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect() if brute.quality_kept(r.text)]
    own = brute.jaccard_components(rows)
    rows = [r for r, (_, least) in zip(rows, own, strict=True) if r[0] == least]
    cut = brute.strings_removed(rows)
    rows = [(i, k.decode("utf-8", "ignore")) for (i, _), (b, k, _) in zip(rows, cut, strict=True) if k or not b]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hits = brute.benchmark_hits([t for _, t in rows], items)
    rows = [r for r, (_, hit, _) in zip(rows, hits, strict=True) if not hit]
    known = byte_bpe.vocabulary(byte_bpe.default_path())
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})
    want = []
    for i, text in rows:
        ids = encoding.encode_ordinary(text)
        want.append((i, len(ids), brute.sha(b"".join(x.to_bytes(4, "little") for x in ids)), brute.sha(text.encode())))
    got = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert 0 < len(want) < table.count()


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.dtypes == spark.read.parquet(f"{SF_DIR}/documents.parquet").dtypes


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
