"""Ranked lexical search by exact inner products: a sparse ball tree, searched best-first, scored in integers.

Terms are the maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. A document is a sparse
vector with one integer component for each term it has, an item one with an integer weight for each of its
terms; the score is their inner product. Only the components of terms that items have can matter.

Items are searched in groups of bounded size. The vectors of a batch of documents become a ball tree: subtrees
are halved between two far vectors until they have `LEAF` documents, and each holds its centroid, its radius and
how far any vector is from the centroid in each component. For an item of length |q| over its terms S, no
document of a subtree scores over <q, centroid> + |q| min(radius, radius within S). Bounds are doubles, rounded up
by more than their error. Each item goes to its subtrees best first and leaves out those whose bound is below the
20th score that it has already; leaves are scored in 64-bit integers, so results are exact.

A first search of one batch in `SCOUTS` gives each item a 20th score to begin with, so that the search of all
documents sends on next to nothing but results. A task sends at most 20 rows for an item.

Defined cases: a null text, and one without terms, has no term; it counts in no statistic and is never found.
Rows that repeat an id or a text are documents of their own, ranked next to each other; a document without an id
comes last among equal scores. Equal rows of items are one, different texts under one item id count together; an
item without an id is left out, and one without a known term has no result. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratecube.llm.common import INT, LONG, bounded_batches, list_of, stored, struct_of

TOP = 20
#: Bounds of a group of items: terms with repeats, and items. A group is what a worker holds at once.
GROUP_TERMS = 8192
GROUP_ITEMS = 512
#: Documents of a leaf, and cells of the dense part of a tree.
LEAF = 24
CELLS = 4 << 20
#: One document in so many is searched beforehand.
SCOUTS = 16
#: Texts are read in runs of about so many bytes.
RUN_BYTES = 1 << 20
#: Bounds are raised by this factor, which is far beyond the rounding errors of some thousand terms.
SAFE = 1 + 1e-9

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_APART = re.compile(rb"[^0-9a-z\x80-\xff]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str | None) -> Iterator[bytes]:
    """All terms, in order; long texts are taken in runs that end between terms."""
    data = (text or "").encode().translate(_LOWER)
    at = 0
    while at < len(data):
        cut = _APART.search(data, at + RUN_BYTES)
        to = cut.start() if cut else len(data)
        yield from _TERM.findall(data, at, to)
        at = to


def items_of(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms, counts) of each item that has a term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(x)) for x in batch.column("text").to_pylist()]
            columns = [[list(c) for c in found], [list(c.values()) for c in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(columns[0], pa.list_(pa.binary())), pa.array(columns[1], pa.list_(pa.int64()))],
                ["item_id", "terms", "counts"],
            )

    own = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter(F.col("item_id").isNotNull()).distinct()
    kind = own.schema["item_id"].dataType.simpleString()
    return own.mapInArrow(counted, f"item_id {kind}, terms array<binary>, counts array<bigint>").filter(F.size("terms") > 0)


def grouped_items(items: DataFrame) -> tuple[DataFrame, int]:
    """Items with the number of their group, and how many groups there are."""
    n, total = items.agg(F.count(F.lit(1)), F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()
    groups = max(1, -(-(total or 0) // GROUP_TERMS), -(-n // GROUP_ITEMS))
    return items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(groups))), groups


VECTOR = struct_of(doc_id=LONG, n=LONG, terms=list_of(INT), counts=list_of(INT))


def vectors_of(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): how many terms a document has, and how often it has those that have a number."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                own = Counter(map(numbers.get, terms_of(text)))
                n.append(own.total())
                own.pop(None, None)
                terms.append(sorted(own))
                counts.append([own[t] for t in terms[-1]])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, VECTOR.names)

    return documents.mapInArrow(counted, VECTOR)


def lengths_of(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The length term of documents of n terms."""
    return np.array([100 - 25 + 25 * x * documents // total for x in n.tolist()], np.int64)


def components_of(m: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Integer components of terms that occur tf times in documents with the length term m."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Tree:
    """Ball tree of a batch of sparse vectors; `dense` has the components of the terms that the batch holds."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.starts, self.terms, self.values = starts, terms, values
        self.known, column = np.unique(terms, return_inverse=True)
        self.column = column
        self.dense = np.zeros((len(starts) - 1, len(self.known)), np.float32)  # components below 2 ** 24 are exact
        self.dense[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), column] = values
        self.centres, self.radii, self.reach, self.rows, self.children = [], [], [], [], []
        self._node(np.arange(len(starts) - 1))
        self.centres, self.reach = np.array(self.centres), np.array(self.reach)
        self.radii = np.array(self.radii)

    def _node(self, rows: np.ndarray) -> int:
        own = self.dense[rows]
        centre = own.mean(axis=0, dtype=np.float64)
        apart = np.abs(own - centre)
        squares = np.einsum("ij,ij->i", apart, apart)
        me = len(self.centres)
        self.centres.append(centre)
        self.reach.append(apart.max(axis=0) ** 2)
        self.radii.append(math.sqrt(squares.max()))
        self.rows.append(rows)
        self.children.append(())
        if len(rows) > LEAF and squares.max() > 0:
            far = own[squares.argmax()]
            gap = ((own - far) ** 2).sum(axis=1)
            axis = own[gap.argmax()] - far
            order = np.argsort(own @ axis, kind="stable")
            half = len(rows) // 2
            self.children[me] = (self._node(rows[order[:half]]), self._node(rows[order[half:]]))
        return me

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        """Nodes by items: what no document of the node can score beyond, for weights of known terms by items."""
        within = np.sqrt(self.reach @ (weights > 0))
        lengths = np.sqrt((weights * weights).sum(axis=0))
        spread = np.minimum(self.radii[:, None], within) * lengths[None, :]
        return (self.centres @ weights + spread) * SAFE + 1

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Documents by items, in 64-bit integers."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        inner = np.arange(int(sizes.sum())) + np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes)
        out = np.zeros((len(rows), weights.shape[1]), np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            products = self.values[inner, None] * weights[self.column[inner]]
            out[full] = np.add.reduceat(products, (np.cumsum(sizes) - sizes)[full], axis=0)
        return out


class Found:
    """The best documents of each item so far: higher scores first, then smaller ids, ids that are null last."""

    def __init__(self, least: np.ndarray):
        self.least = least  # what a document has to score at least
        self.best: dict[int, list[tuple[int, bool, int]]] = defaultdict(list)
        self.visited = 0

    def add(self, item: int, ids: list[int | None], scores: list[int]) -> None:
        own = self.best[item]
        own += [(-s, i is None, i or 0) for i, s in zip(ids, scores, strict=True)]
        own.sort()
        del own[TOP:]
        if len(own) == TOP:
            self.least[item] = max(self.least[item], -own[-1][0])


def search(tree: Tree, ids: list[int | None], weights: np.ndarray, found: Found) -> None:
    """Every item through the tree, best subtree first; items that are at one leaf are scored together."""
    own = weights[tree.known]
    bounds = tree.bounds(own.astype(np.float64))
    heaps: list[list[tuple[float, int]]] = [[(bounds[0, q], 0)] for q in range(own.shape[1])]
    open_ = [q for q in range(own.shape[1]) if bounds[0, q] >= found.least[q] and own[:, q].any()]
    while open_:
        at: dict[int, list[int]] = defaultdict(list)
        for q in open_:
            heap = heaps[q]
            while heap and heap[-1][0] >= found.least[q]:
                _, node = heap.pop()
                if not tree.children[node]:
                    at[node].append(q)
                    break
                heap += [(bounds[c, q], c) for c in tree.children[node]]
                heap.sort()
        for leaf, items in at.items():
            rows = tree.rows[leaf]
            found.visited += len(rows) * len(items)
            scores = tree.scores(rows, own[:, items])
            good = scores >= np.maximum(found.least[items], 1)[None, :]
            for k in np.flatnonzero(good.any(axis=0)).tolist():
                some = np.flatnonzero(good[:, k])
                found.add(items[k], [ids[i] for i in rows[some].tolist()], scores[some, k].tolist())
        open_ = [q for items in at.values() for q in items]


HIT = struct_of(item=INT, doc_id=LONG, score=LONG)


def hits(vectors: DataFrame, weights: np.ndarray, least: np.ndarray, documents: int, total: int) -> DataFrame:
    """(item, doc_id, score): of each task the best documents of each item that score at least `least`."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(least.copy())
        for batch in batches:
            # As many documents at once as the dense part of a tree allows.
            terms = np.asarray(batch.column("terms").flatten()).astype(np.int64)
            step = max(LEAF, CELLS // max(1, len(np.unique(terms))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists, ids = part.column("terms"), part.column("doc_id").to_pylist()
                sizes = np.array([len(x) for x in lists], np.int64)
                starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
                tf = np.asarray(part.column("counts").flatten()).astype(np.int64)
                values = components_of(np.repeat(lengths_of(np.asarray(part.column("n")), documents, total), sizes), tf)
                search(Tree(starts, np.asarray(lists.flatten()).astype(np.int64), values), ids, weights, found)
        rows = [(item, None if null else i, -s) for item, best in found.best.items() for s, null, i in best]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], HIT.names)

    return vectors.filter(F.size("terms") > 0).mapInArrow(searched, HIT)


def ranked(found: DataFrame) -> DataFrame:
    """The best TOP of each item, with their ranks. Spark cuts each task's rows before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def search_group(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score) of one group of items, which has a bounded number of terms."""
    spark, asked = documents.sparkSession, defaultdict(Counter)
    for r in items.select("item_id", "terms", "counts").collect():
        asked[r.item_id].update(dict(zip(map(bytes, r.terms), r.counts, strict=True)))
    own = list(asked)
    numbers = {t: k for k, t in enumerate(sorted(set().union(*asked.values())))}
    vectors = stored(vectors_of(documents, numbers), "vectors")
    held = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
    df = {r.term: r.df for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.zeros((len(numbers), len(own)), np.int64)
    for q, item in enumerate(own):
        for t, count in asked[item].items():
            k = numbers[t]
            weights[k, q] = count * weight(held.documents, df[k]) if k in df else 0
    scale = held.documents, held.total or 0
    nothing = np.zeros(len(own), np.int64)
    scouts = ranked(hits(vectors.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SCOUTS)) == 0), weights, nothing, *scale))
    for r in scouts.filter(F.col("rank") == TOP).collect():
        nothing[r.item] = r.score
    found = ranked(hits(vectors, weights, nothing, *scale))
    kind = items.schema["item_id"].dataType.simpleString()
    # As many rows as the group has items.
    names = F.broadcast(spark.createDataFrame(list(enumerate(own)), f"item int, item_id {kind}"))
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the TOP documents with the highest scores above 0."""
    spark = documents.sparkSession
    bounded_batches(spark)
    own = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    queries, groups = grouped_items(stored(items_of(items, item_id, item_text), "items"))
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for part in range(groups):
        group = queries.filter(F.col("part") == part)
        if not group.isEmpty():
            out = out.union(stored(search_group(own, group), "ranks"))
    return out
