"""N-gram Jaccard join: components of documents whose sets of word shingles are alike.

Words are those between blanks, with A-Z lower-cased; a set has the distinct shingles of SHINGLE
words, or the whole sequence where a text has fewer. Two sets link when 100 * intersection is at least
PERCENT * union. Equal sets are one node, named by a 64-bit digest of the set.

The overlaps are products of rows of the sparse matrix of nodes by shingles. Bounds by size say which
products can matter, and are exact:

* a node with n shingles can only link if ceil(PERCENT n / 100) of them occur in other nodes too. This
  is first tested with a third of all shingles, of which at most the same number may be missing, then
  with all shingles of the nodes that are left;
* with shingles ordered from rare to frequent, two nodes whose overlap has to be o share one of the first
  n - o + 1 shingles of either;
* two sets of n and m shingles have at least PERCENT (n + m) / (100 + PERCENT) of them in common, so either must
  have that many, and have that many that occur in other nodes.

Pairs within a component found so far need no product. So the first round takes each node with one
other for each of its rare shingles, the second neighbours by size, and the last all pairs that are
left between different components. Products are computed in blocks of pairs. No group of one shingle
is ever held in one task.

Defined cases: a null or empty text has an empty set, linked with nothing; rows without an id have no
component; rows that repeat an id and a text are one node; different texts under one id are nodes of
their own, with the smallest id they reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecube.llm.anchors import MIX, PACKED, SCHEMA, Sender, bucket_count, dealt, distinct_pairs, mixed, owner_bucket, packed_by, planes, unpacked, unplaned
from ratecube.llm.common import BINARY, LONG, bounded_batches, free_name, list_of, release_memory, releasing, stored, struct_of, utf8_buffer
from ratecube.llm.words import LOWERED, word_hashes, words_of

SHINGLE = 4
PERCENT = 85
#: One shingle in so many is used for the first test.
TESTED = 3
#: Texts cut into shingles in one go.
AT_ONCE = 250
KEY = np.uint64((1 << 48) - 1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, their texts, first shingle of each text and their number): distinct and sorted in each text."""
    data, bounds = utf8_buffer(texts)
    low = LOWERED[data]
    starts, ends, first = words_of(low, bounds)
    words = word_hashes(low, starts, ends)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    count = np.diff(first)
    total = np.zeros(len(words), np.uint64)
    size = np.minimum(SHINGLE, count)[text] if len(text) else np.empty(0, np.int64)
    place = np.arange(len(words))
    for k in range(SHINGLE):
        at = np.minimum(place + k, len(words) - 1)
        total = np.where(k < size, total * MIX + words[at], total)
    keep = place + size <= first[1:][text] if len(text) else np.empty(0, bool)
    total, text = mixed(total[keep] + size[keep].astype(np.uint64)), text[keep]
    order = np.lexsort((total, text))
    total, text = total[order], text[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    total, text = total[new], text[new]
    return total, text, np.searchsorted(text, np.arange(len(first)))


def tested(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(48)) % np.uint64(TESTED) == 0


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums between the edges, modulo 2 ** 64."""
    running = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return running[edges[1:]] - running[edges[:-1]]


def digests(shingles: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return mixed(sums(mixed(shingles ^ MIX), edges) + np.diff(edges).astype(np.uint64)).view(np.int64)


SET = struct_of(n=LONG, tested=LONG, node=LONG)


def description(texts: pa.Array) -> pa.Array:
    shingles, _, edges = shingle_sets(texts)
    columns = [np.diff(edges), sums(tested(shingles).astype(np.int64), edges), digests(shingles, edges)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "tested", "node"])


@F.arrow_udf(SET)
def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield description(texts)
    release_memory()


def least_overlap(n):
    """What a set of n shingles must have in common with any that it links to."""
    return (PERCENT * n + 99) // 100


def may_miss(n: Column) -> Column:
    return n - F.floor((n * PERCENT + 99) / 100)


def tested_entries(texts: DataFrame, buckets: int) -> DataFrame:
    @releasing
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, across=True)
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            shingles, text, edges = shingle_sets(batch.column("text"))
            node = digests(shingles, edges)
            pick = tested(shingles)
            yield from sender.add(*distinct_pairs((shingles[pick] & KEY).view(np.int64), node[text[pick]]))
        yield from sender.rest()

    return texts.select("text").mapInArrow(send, PACKED)


def shared_counts(entries: DataFrame, buckets: int) -> DataFrame:
    """(owner, shared): how many of a node's keys another node has too; nodes without any are not there.

    A key may count more than once, which only lets more nodes pass.
    """

    def matched(table: pa.Table) -> pa.Table:
        keys, owners = distinct_by_key(*unpacked(table, settled=False))
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
        sizes = np.diff(np.append(heads, len(keys)))
        known = unpacked(table, settled=True)[1]
        owners, counts = np.unique(np.concatenate([owners[np.repeat(sizes > 1, sizes)], known]), return_counts=True)
        return pa.Table.from_batches(packed_by(owner_bucket(owners, buckets), counts, owners), SCHEMA)

    def added(table: pa.Table) -> pa.Table:
        counts, owners = unpacked(table)
        owners, which = np.unique(owners, return_inverse=True)
        return pa.table({"owner": pa.array(owners, pa.int64()), "shared": pa.array(np.bincount(which, counts, len(owners)).astype(np.int64), pa.int64())})

    found = dealt(entries).groupBy("bucket").applyInArrow(matched, PACKED)
    return found.groupBy("bucket").applyInArrow(added, struct_of(owner=LONG, shared=LONG))


def distinct_by_key(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], owners[new]


SETS = struct_of(node=LONG, n=LONG, shingles=BINARY)


def sets_of(texts: DataFrame) -> DataFrame:
    """(node, n, shingles) of the texts whose digest is the wanted `node`."""

    @releasing
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, _, edges = shingle_sets(batch.column("text"))
            own = digests(shingles, edges)
            rows = np.flatnonzero(own == np.asarray(batch.column("node"))).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(own[i]) for i in rows], pa.int64()),
                    pa.array([int(edges[i + 1] - edges[i]) for i in rows], pa.int64()),
                    pa.array([planes(shingles[edges[i] : edges[i + 1]]) for i in rows], pa.binary()),
                ],
                ["node", "n", "shingles"],
            )

    return texts.select("node", "text").mapInArrow(made, SETS).dropDuplicates(["node"])


def keys_udf(column: str) -> Column:
    @F.arrow_udf(list_of(LONG))
    def keys(sets: pa.Array) -> pa.Array:
        return pa.array([unplaned(s.as_py()) for s in sets], pa.list_(pa.int64()))

    return keys(F.col(column))


def prefix_index(nodes: DataFrame) -> DataFrame:
    """(key, node, n, shared, place): for each node that can link, those of its first shingles, rare to frequent, that others have.

    `shared` is how many of its n shingles others have: a bound of every overlap. `place`
    counts from 0 and includes the shingles that no other has, which come first.

    A node's first shingles are those that no other has; they are not in the result.
    """
    long = nodes.select("node", "n", F.explode(keys_udf("shingles")).alias("key"))
    frequent = long.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = long.join(frequent, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    need = F.col("n") - may_miss(F.col("n"))
    first = F.slice("keys", F.lit(1), F.greatest(F.lit(0), (F.size("keys") - need + 1).cast("int")))
    return shared.filter(F.size("keys") >= need).select(
        F.posexplode(first).alias("at", "k"), "node", "n", F.size("keys").cast("bigint").alias("shared")
    ).select("k.key", "node", "n", "shared", (F.col("n") - F.col("shared") + F.col("at")).alias("place"))


def can_link(end: str, other: str) -> Column:
    """Whether two nodes that share a shingle can link, by their sizes, by what each has in
    common with anything, and by the shingle's places: of the needed overlap, all is
    behind the first shingle in common. `end` and `other` end the names of their columns.
    """
    n, shared, place = (F.col(f"{c}{end}") for c in ("n", "shared", "place"))
    n_other, shared_other, place_other = (F.col(f"{c}{other}") for c in ("n", "shared", "place"))
    need = F.ceil((n + n_other) * PERCENT / (100 + PERCENT))
    by_size = need <= F.least(n, n_other, shared, shared_other)
    return by_size & (place <= n - need) & (place_other <= n_other - need)


LINK = struct_of(a=LONG, b=LONG)


def links(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b) pairs that link: products of the pairs' rows, block by block."""

    @releasing
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [unplaned(s.as_py()) for s in batch.column("left")]
            right = [unplaned(s.as_py()) for s in batch.column("right")]
            n, m = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
            column = np.concatenate([np.empty(0, np.int64), *left, *right])
            row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
            order = np.lexsort((column, row))
            column, row = column[order], row[order]
            both = np.flatnonzero((column[1:] == column[:-1]) & (row[1:] == row[:-1]))
            overlap = np.bincount(row[both], minlength=len(n))
            good = np.flatnonzero(100 * overlap >= PERCENT * (n + m - overlap))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good)), batch.column("b").take(pa.array(good))], ["a", "b"])

    second = nodes.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    first = nodes.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    rows = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "left", "right")
    return rows.mapInArrow(products, LINK)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of the edges: the smallest node that they reach.

    Labels spread to neighbours and jump to their labels' labels until none changes.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = stored(lower.join(jump, "next").select("node", "component", F.least("next", "far").alias("next")), "labels")
        if moved.filter("next <> component").isEmpty():
            return labels
        labels = moved.select("node", F.col("next").alias("component"))


def all_links(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of all nodes that link to another."""
    # A hub has the largest part in common with others, as the text has that copies are made of.
    columns = ["node", "n", "shared", "place"]
    hub = F.max(F.struct(F.col("shared") / F.col("n"), *columns)).alias("hub")
    counts = index.groupBy("key").agg(F.count(F.lit(1)).alias("held"), hub)
    index = index.join(counts.filter("held > 1"), "key")
    index = stored(index.select("key", *columns, *[F.col(f"hub.{c}").alias(f"{c}_hub") for c in columns]), "index")
    star = index.filter((F.col("node") != F.col("node_hub")) & can_link("", "_hub"))
    found = stored(links(star.select(F.col("node_hub").alias("a"), F.col("node").alias("b")).distinct(), nodes), "links")
    labels = components(found)
    for last in (False, True):
        own = index.select("key", *columns).join(labels, "node", "left")
        own = own.select("key", *columns, F.coalesce("component", "node").alias("component"))
        # Only shingles in several components can still tell something.
        open_ = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
        own = stored(own.join(open_.select("key"), "key"), "open")
        if last:
            other = own.select("key", *[F.col(c).alias(f"{c}_b") for c in (*columns, "component")])
            pairs = own.join(other, "key").filter((F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b")))
            pairs = pairs.filter(can_link("", "_b")).select(F.col("node").alias("a"), F.col("node_b").alias("b"))
        else:
            by_size = Window.partitionBy("key", F.floor(F.col("n") / 8)).orderBy("n", "node")
            before = F.lag(F.struct(*columns, "component")).over(by_size).alias("before")
            chain = own.select(*columns, "component", before)
            chain = chain.select(*columns, "component", *[F.col(f"before.{c}").alias(f"{c}_b") for c in (*columns, "component")])
            pairs = chain.filter((F.col("component") != F.col("component_b")) & can_link("", "_b"))
            pairs = pairs.select(F.col("node_b").alias("a"), F.col("node").alias("b"))
        more = stored(links(pairs.distinct(), nodes), "links")
        if not more.isEmpty():
            found = found.union(more)
            labels = components(found)
    return labels


def described_sets(documents: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, tested, node) of each row, `key` a hash of its text; and, where there is an id and a set, these with the component."""
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sets = stored(rows.select("doc_id", F.xxhash64("text").alias("key"), described(F.col("text")).alias("s")).select("doc_id", "key", "s.*"), "sets")
    texts = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    buckets = bucket_count(texts, "text")
    shared = stored(shared_counts(tested_entries(texts, buckets), buckets), "shared")
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("tested").alias("tested"))
    able = classes.join(shared, F.col("node") == F.col("owner"), "left")
    able = able.filter(F.col("tested") - F.coalesce("shared", F.lit(0)) <= may_miss(F.col("n"))).select("doc_id", "node")
    nodes = stored(sets_of(texts.join(able, "doc_id")), "nodes")
    # Without the nodes that can't link, others may turn out not to link either.
    able = stored(prefix_index(nodes).select("node").distinct(), "able")
    nodes = stored(nodes.join(able, "node"), "nodes")
    labels = all_links(stored(prefix_index(nodes), "prefixes"), nodes)
    return sets, sets.filter("n > 0 and doc_id is not null").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def join(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    sets, known = described_sets(documents, doc_id, text)
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = known.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sets.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return whole.union(rest)


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id and then node, with the columns it came with; rows without an id stay.

    Where an id has several texts, each is judged by its own component.
    """
    own, key = free_name(documents, "kept_id"), free_name(documents, "kept_key")
    sets, known = described_sets(documents, doc_id, text)
    first = known.groupBy("component").agg(F.min(F.struct("doc_id", "node", "key")).alias("row")).select("row.doc_id", "row.key")
    empty = sets.filter("n = 0 and doc_id is not null").select("doc_id", "key").distinct()
    kept = stored(first.union(empty).select(F.col("doc_id").alias(own), F.col("key").alias(key)), "kept")
    some = documents.join(kept, (F.col(doc_id) == F.col(own)) & (F.xxhash64(text) == F.col(key))).dropDuplicates([doc_id, key]).drop(own, key)
    return some.unionByName(documents.filter(F.col(doc_id).isNull()))
