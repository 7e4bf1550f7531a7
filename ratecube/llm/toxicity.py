"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and their prefixes of three to eight letters. The vocabulary is every term
that goes clearly with the label, by the log odds ratio over all labelled texts, equal texts counted
once; document frequencies count all documents. Vectors have all these terms, the index those that its
examples have. The index holds a bounded sample of EXAMPLES distinct labelled texts that have
a term, in blocks with the largest weight of each term in each block. A query takes blocks in the
order of their bounds and stops where no bound reaches its K-th best cosine, so its neighbours are the
exact ones. Votes weigh 1 / (1.05 - cosine); an isotonic fit on the examples, each judged by the
others, turns the share of toxic votes into a probability. A text without a term gets the smoothed
share of toxic rows among such labelled rows.

Defined cases: a null or empty text has no term; several labels for one id, or for equal texts,
count as the largest; equal texts are one example, under their smallest id; null labels are left out; without a toxic row all scores are 0; ties between examples go to the smaller id;
repeated rows are scored each for itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecube.llm.common import DOUBLE, INT, LONG, STRING, bounded_batches, list_of, stored, struct_of

LEAST_TOXIC = 3
LEAST_LOG_ODDS, LEAST_Z = 1.0, 3.0
#: The bounded sample of labelled rows that the index holds; they are chosen by the hash of their ids.
EXAMPLES = 4096
BLOCK = 64
K = 15
THRESHOLD = 0.7
CACHED_WORDS = 200_000

WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6, 7, 8)


def terms_of(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def counted_terms(texts: pa.Array, labels: pa.Array) -> tuple[Counter, Counter]:
    """For each term the number of texts that have it, among toxic ones and among others."""
    counts = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        words = set(WORD.findall((text.as_py() or "").lower()))
        counts[0 if label.as_py() else 1].update({t for w in words for t in terms_of(w)})
    return counts


COUNTS = struct_of(term=STRING, toxic=LONG, other=LONG)


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, other = counted_terms(batch.column("text"), batch.column("toxic"))
        terms = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())],
            ["term", "toxic", "other"],
        )


def vocabulary(rows: DataFrame, known: DataFrame) -> list[str]:
    """The terms that go with the label, from (doc_id, text) rows and (doc_id, toxic) labels; all texts count, equal ones once."""
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    # One id for each text: only digests meet for that, so that texts are moved once.
    texts = rows.select("doc_id", "digest").join(known, "doc_id").groupBy("digest").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    texts = stored(texts, "labelled")
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    if not total["toxic"]:
        return []
    n_toxic, n_other = float(total["toxic"]), float(total["n"] - total["toxic"])
    labelled = rows.join(texts.hint("merge"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    counts = labelled.select("text", "toxic").mapInArrow(term_counts, COUNTS)
    sums = counts.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).filter(F.col("a") >= LEAST_TOXIC)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (F.lit(n_toxic + 1) - a)) - F.log(b / (F.lit(n_other + 1) - b))
    ranked = sums.select("term", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    chosen = ranked.filter((F.col("odds") > LEAST_LOG_ODDS) & (F.col("z") > LEAST_Z)).select("term")
    return sorted(chosen.toArrow().column("term").to_pylist())


VECTOR = struct_of(ids=list_of(INT), counts=list_of(INT))


def vector_udf(spark: SparkSession, terms: list[str]):
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    cache: dict[str, tuple[int, ...]] = {}

    @F.arrow_udf(VECTOR)
    def vectors(texts: pa.Array) -> pa.Array:
        places = shared.value
        ids, counts = [], []
        for text in texts:
            found: Counter = Counter()
            for word, n in Counter(WORD.findall((text.as_py() or "").lower())).items():
                own = cache.get(word)
                if own is None:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    own = cache[word] = tuple(places[t] for t in terms_of(word) if t in places)
                for i in own:
                    found[i] += n
            order = sorted(found)
            ids.append(order)
            counts.append([found[i] for i in order])
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["ids", "counts"])

    return vectors


class Index:
    """Postings by term and block, the largest weight in each, and the examples' labels."""

    def __init__(self, n_terms: int, idf: np.ndarray, examples: list[tuple[int, int, list[int], list[int]]]):
        """examples: (doc_id, toxic, term ids, counts), none without a term."""
        self.idf = idf
        rows = sorted(examples, key=lambda e: (int(np.argmax(self.weights(e[2], e[3]))) if e[2] else 0, tuple(e[2]), e[0]))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.toxic = np.array([r[1] for r in rows], np.float64)
        self.n_blocks = -(-len(rows) // BLOCK)
        none = np.empty(0, np.int64)
        term = np.concatenate([none, *(np.array(r[2], np.int64) for r in rows)])
        example = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        weight = np.concatenate([np.empty(0), *(self.weights(r[2], r[3]) for r in rows)])
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        # Only terms of examples have cells, and only in blocks where they occur.
        held, term = np.unique(term[order], return_inverse=True)
        self.place = np.full(n_terms, -1, np.int32)
        self.place[held] = np.arange(len(held))
        cells, first = np.unique(term * self.n_blocks + self.example // BLOCK, return_index=True)
        self.first = np.append(first, len(term))
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.block = cells % max(1, self.n_blocks)
        self.cells = np.searchsorted(cells, np.arange(len(held) + 1) * self.n_blocks)
        self.values, self.scores = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.nothing = 0.0

    def weights(self, ids: list[int], counts: list[int]) -> np.ndarray:
        w = (1 + np.log(np.array(counts, float))) * self.idf[ids]
        return w / np.sqrt((w * w).sum())

    def nearest(self, ids: list[int], counts: list[int], k: int = K, but: int = -1) -> list[tuple[int, float]]:
        """(example, cosine) of the k nearest with a cosine over 0; `but` is left out."""
        query = self.weights(ids, counts)
        place = self.place[ids]
        query, place = query[place >= 0], place[place >= 0]
        start, many = self.cells[place], self.cells[place + 1] - self.cells[place]
        cell = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
        query = np.repeat(query, many)
        order = np.argsort(self.block[cell], kind="stable")
        cell, query = cell[order], query[order]
        bound = np.bincount(self.block[cell], query * self.most[cell], self.n_blocks)
        of_block = np.searchsorted(self.block[cell], np.arange(self.n_blocks + 1))
        best: list[tuple[float, int, int]] = []
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or (len(best) >= k and bound[block] < best[k - 1][0] * -1 - 1e-12):
                break
            score = np.zeros(BLOCK)
            own = slice(of_block[block], of_block[block + 1])
            for q, c in zip(query[own].tolist(), cell[own].tolist(), strict=True):
                a, b = self.first[c], self.first[c + 1]
                score[self.example[a:b] - block * BLOCK] += q * self.weight[a:b]
            for i in np.flatnonzero(score > 0).tolist():
                example = block * BLOCK + i
                if example != but:
                    best.append((-round(float(score[i]), 12), int(self.ids[example]), example))
            best.sort()
            del best[k:]
        return [(example, min(1.0, -s)) for s, _, example in best]

    def votes(self, near: list[tuple[int, float]]) -> float:
        w = np.array([1 / (1.05 - c) for _, c in near])
        return float((w * self.toxic[[e for e, _ in near]]).sum() / w.sum())

    def calibrate(self, examples: list[tuple[int, int, list[int], list[int]]], nothing: float) -> None:
        """Isotonic fit of labels on votes, each example judged by the others."""
        place = {int(d): i for i, d in enumerate(self.ids)}
        points = []
        for doc, toxic, ids, counts in examples:
            near = self.nearest(ids, counts, but=place[doc])
            if near:
                points.append((self.votes(near), toxic))
        self.nothing = nothing
        points.sort()
        blocks: list[list[float]] = []  # sum of labels, number, sum of votes
        for vote, toxic in points:
            blocks.append([toxic, 1, vote])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
        if blocks:
            self.values = np.array([b[2] / b[1] for b in blocks])
            self.scores = np.array([b[0] / b[1] for b in blocks])

    def score(self, ids: list[int], counts: list[int]) -> tuple[float, list[dict]]:
        near = self.nearest(ids, counts) if len(ids) and len(self.ids) else []
        if not near:
            return self.nothing, []
        score = float(np.interp(self.votes(near), self.values, self.scores))
        evidence = [{"doc_id": int(self.ids[e]), "cosine": c, "toxic": int(self.toxic[e])} for e, c in near[:3]]
        return min(1.0, max(0.0, score)), evidence


SCORED = struct_of(score=DOUBLE, evidence=list_of(struct_of(doc_id=LONG, cosine=DOUBLE, toxic=INT)))


def scores(documents: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, learn, score, evidence) of each row. Labels count only where `learn`, a test on the id, holds.

    `evidence` names the nearest examples with their cosines and labels.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("learn", F.coalesce(learn, F.lit(False)))
    # Merged at every size: broadcast labels would hide what the join moves once they have grown.
    known = known.hint("merge")
    terms = vocabulary(rows.filter("learn"), known)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    vectors = rows.select("doc_id", "learn", digest, vector_udf(spark, terms)(F.col("text")).alias("v"))
    vectors = stored(vectors.select("doc_id", "learn", "digest", "v.*"), "vectors")
    index = None
    if terms:
        n = vectors.count()
        counts = vectors.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()  # a row for each term
        frequency = np.zeros(len(terms))
        frequency[counts.column("id").to_numpy()] = counts.column("count").to_numpy()
        judged = vectors.filter("learn").join(known, "doc_id")
        bare = judged.filter(F.size("ids") == 0).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
        texts = judged.filter(F.size("ids") > 0).groupBy("digest").agg(
            F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("ids").alias("ids"), F.first("counts").alias("counts")
        )
        chosen = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(EXAMPLES)
        by_id = {r["doc_id"]: (r["doc_id"], r["toxic"], list(r["ids"]), list(r["counts"])) for r in chosen.collect()}
        index = Index(len(terms), np.log(1 + n / np.maximum(1, frequency)), list(by_id.values()))
        index.calibrate(list(by_id.values()), bare["toxic"] / (bare["n"] + 1))
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(SCORED)
    def scored(ids: pa.Array, counts: pa.Array) -> pa.Array:
        own = shared.value
        out = [own.score(i.as_py(), c.as_py()) if own is not None else (0.0, []) for i, c in zip(ids, counts, strict=True)]
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], kind)], ["score", "evidence"])

    return vectors.select("doc_id", "learn", scored("ids", "counts").alias("s")).select("doc_id", "learn", "s.*")
