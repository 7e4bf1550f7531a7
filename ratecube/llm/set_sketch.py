"""Near-duplicates by SetSketch: registers of exponentially spaced truncated minima, banded, estimated, verified.

Words are those between blanks, A-Z lower-cased; a set has the distinct shingles of SHINGLE words, or the whole
sequence where a text has fewer. Two sets link when 100 * intersection is at least PERCENT * union.

Every element of a set draws one exponential value for each of the REGISTERS registers, from its hash alone; a
register keeps the least value of the set on a scale of powers of BASE, cut to 0 ... LEVELS + 1. So registers of
a union are the larger of both (`merged`), and equal registers tell how alike two sets are. The values of an
element come as points of a Poisson process, each in a random register, so only some thousand points of a set
have to be drawn before every register has its least, however many elements there are.

* `BANDS` bands of `ROWS_OF_BAND` registers: two sets of similarity 0.8 miss each other in all bands with a
  probability below 1e-6, whatever their sizes. Equal sets are one node, so copies are no pairs.
* The similarity of a candidate pair is estimated by likelihood from how many registers are larger on the one
  side, on the other, and equal, with the exact sizes. A pair goes if the threshold is less likely than the
  estimate by a factor of e ** 18, which is six standard deviations.
* What is left is verified on the full sets.

Candidates are formed against the most central nodes first (`central`), at most two for each node, then against such a node of
another component. What is still in several components under one band value then meets by rare shingles, under exact bounds of the
overlap (`rest_of_pairs`). No pair within a known component is made, and no band value is gathered in one task.

Defined cases: a null or empty text has an empty set, linked with nothing; rows without an id have no component
and are kept; rows that repeat an id and a text are one node; different texts under one id are nodes of their
own, with the smallest id they reach. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecube.llm.anchors import MIX, MIX2, mixed, planes, unplaned
from ratecube.llm.common import BINARY, LONG, bounded_batches, list_of, stored, struct_of, utf8_buffer
from ratecube.llm.ngram_join import components, keys_udf
from ratecube.llm.words import LOWERED, word_hashes, words_of

SHINGLE = 2
PERCENT = 80
REGISTERS = 288
ROWS_OF_BAND = 6
BANDS = REGISTERS // ROWS_OF_BAND
#: Base and number of the levels, and the rate of the exponential values: levels 1 to LEVELS fit sets of 1 to 10**15 elements.
BASE, LEVELS, RATE = 1.02, 2046, 20.0
#: A pair goes when its likelihood at the threshold is smaller than at its estimate by this factor (natural logarithm).
UNLIKELY = 18.0
#: Texts are cut into shingles in runs of about so many bytes.
RUN_BYTES = 1 << 20
#: Points drawn at once for one set.
POINTS = 1 << 16


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted, as 64-bit hashes."""
    data, bounds = utf8_buffer(texts)
    n, at = len(bounds) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUN_BYTES, "right")) - 1)
        low = LOWERED[data[bounds[at] : bounds[to]]]
        starts, ends, first = words_of(low, bounds[at : to + 1] - bounds[at])
        words = word_hashes(low, starts, ends)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            size = min(shingle, b - a)
            total = np.zeros(max(0, b - a - size + 1) if size else 0, np.uint64)
            for k in range(size):
                total = total * MIX + words[a + k : a + k + len(total)]
            yield np.unique(mixed(total + np.uint64(size)))
        at = to


def drawn(elements: np.ndarray) -> np.ndarray:
    """The least value of each register, on the scale of rate 1; infinite for an empty set."""
    least = np.full(REGISTERS, np.inf)
    n = len(elements)
    if not n:
        return least
    base, next_ = np.zeros(n), np.zeros(n, np.uint64)
    limit = (np.log(REGISTERS) + 2.5) / n
    while True:
        open_ = np.flatnonzero(base <= limit)
        while len(open_):
            # About as many points as it takes to pass the limit.
            width = int(np.clip(1.2 * REGISTERS * (limit - base[open_].min()) + 1, 1, 4096))
            for i in range(0, len(open_), max(1, POINTS // width)):
                own = open_[i : i + max(1, POINTS // width)]
                bits = mixed(elements[own, None] + (next_[own, None] + np.arange(1, width + 1, dtype=np.uint64)) * MIX2)
                steps = -np.log(((bits >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / REGISTERS
                values = base[own, None] + np.cumsum(steps, axis=1)
                register = ((bits & np.uint64(0xFFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(24)
                np.minimum.at(least, register.ravel().astype(np.intp), values.ravel())
                base[own] = values[:, -1]
                next_[own] += np.uint64(width)
            open_ = open_[base[open_] <= limit]
        if least.max() <= limit:
            return least
        limit *= 1.5


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a set, 16 bits each: larger for smaller minima; all 0 for an empty set."""
    level = np.floor(1 - np.log(drawn(elements) / RATE) / np.log(BASE))
    return np.clip(level, 0, LEVELS + 1).astype("<u2")


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def larger(x: np.ndarray) -> np.ndarray:
    """Probability that a register is larger on a side that has the share x of the union for itself."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(similarity, more, less, equal, u, v):
    """Of a similarity, by how many registers are larger left, larger right, and equal; u and v are the shares of the sizes."""
    p, q = larger(np.maximum(u - v * similarity, 1e-12)), larger(np.maximum(v - u * similarity, 1e-12))
    return more * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))


def estimated(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, how much likelier than the threshold) of pairs of sets, from their registers and sizes.

    The likelihood is concave in the similarity, so its slope is halved away.
    """
    more, less = (left > right).sum(axis=1), (left < right).sum(axis=1)
    equal = left.shape[1] - more - less
    u, v = n / (n + m), m / (n + m)
    low, high = np.zeros(len(n)), np.minimum(u / v, v / u)
    for _ in range(40):
        middle = (low + high) / 2
        step = 1e-7
        rising = log_likelihood(middle + step, more, less, equal, u, v) > log_likelihood(middle - step, more, less, equal, u, v)
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    best = (low + high) / 2
    gain = log_likelihood(best, more, less, equal, u, v) - log_likelihood(PERCENT / 100, more, less, equal, u, v)
    return best, np.where(best >= PERCENT / 100, 0.0, gain)


SKETCH = struct_of(n=LONG, high=LONG, low=LONG, registers=BINARY)


def sketch_udf(shingle: int):
    @F.arrow_udf(SKETCH)
    def sketched(texts: pa.Array) -> pa.Array:
        rows = []
        for s in shingle_sets(texts, shingle):
            names = [mixed(s ^ salt).sum(dtype=np.uint64, keepdims=True).view(np.int64) for salt in (MIX, MIX2)]
            rows.append((len(s), *[int(x[0]) for x in names], sketch(s).tobytes() if len(s) else None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.binary()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SKETCH.names)

    return sketched


@F.arrow_udf(list_of(LONG))
def band_keys(registers: pa.Array) -> pa.Array:
    """One hash for each band of each sketch."""
    own = np.frombuffer(b"".join(registers.to_pylist()), "<u2").reshape(-1, BANDS, ROWS_OF_BAND).astype(np.uint64)
    keys = np.broadcast_to(mixed(np.arange(BANDS, dtype=np.uint64)), own.shape[:2])
    for k in range(ROWS_OF_BAND):
        keys = mixed(keys * MIX2 + own[:, :, k])
    flat = pa.array(keys.view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), flat)


PAIR = struct_of(a=LONG, b=LONG)


def sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b) pairs whose sizes and registers allow a link."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("left", "right"))
            n, m = (np.asarray(batch.column(c)).astype(np.float64) for c in ("n", "m"))
            good = pa.array(np.flatnonzero(estimated(left, right, n, m)[1] <= UNLIKELY))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(good), batch.column("b").take(good)], ["a", "b"])

    left = nodes.select(F.col("number").alias("a"), "n", F.col("registers").alias("left"))
    right = nodes.select(F.col("number").alias("b"), F.col("n").alias("m"), F.col("registers").alias("right"))
    rows = pairs.join(right, "b").join(left, "a").filter(sizes_fit(F.col("n"), F.col("m")))
    return rows.select("a", "b", "n", "m", "left", "right").mapInArrow(chosen, PAIR)


SETS = struct_of(number=LONG, shingles=BINARY)


def full_sets(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(number, shingles) of the nodes, from the texts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [planes(s) for s in shingle_sets(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(sets, pa.binary())], SETS.names)

    # One row of each node: that with its key, of equal rows any.
    wanted = nodes.select("number", F.col("doc_id").alias("id"), F.col("key").alias("text_key"))
    rows = texts.join(wanted, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("text_key")))
    return rows.select("number", "text").mapInArrow(made, SETS).dropDuplicates(["number"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs that link, by their full sets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (left, right) in enumerate(zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)):
                both = np.concatenate((unplaned(left), unplaned(right)))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= PERCENT * (len(both) - common):
                    good.append(i)
            rows = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], ["a", "b"])

    left = sets.select(F.col("number").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("number").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(counted, PAIR)


def links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs of candidates that link."""
    return stored(verified(stored(promising(pairs, nodes), "promising"), sets), "links")


def central(entries: DataFrame) -> DataFrame:
    """(key, number, score, hub, hub_score) of the (key, number) band values that several nodes have.

    The score of a node says with how many others it shares band values: of copies of one text with changes of their own, it is
    highest for the text that they were made of. The hub of a band value is its node with the highest score.
    """
    held = entries.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    shared = stored(entries.join(held, "key"), "entries")
    scores = shared.groupBy("number").agg(F.sum("held").alias("score"))
    scored = shared.join(scores, "number").select("key", "number", "score")
    hubs = scored.groupBy("key").agg(F.max(F.struct("score", F.col("number").alias("hub"))).alias("best")).select("key", "best.hub", F.col("best.score").alias("hub_score"))
    return stored(scored.join(hubs, "key"), "bands")


def nearest_hubs(entries: DataFrame, per: list[str]) -> DataFrame:
    """The (a, b) pairs of each (number, hub, hub_score) entry's node with two of its hubs, for each value of `per`: that of most band values in common, and the most central."""
    common = entries.groupBy("number", "hub", *per).agg(F.count(F.lit(1)).alias("common"), F.max("hub_score").alias("hub_score"))
    ranks = [F.max(F.struct(*order, "hub")).alias(name) for name, order in (("near", ["common", "hub_score"]), ("top", ["hub_score", "common"]))]
    best = common.groupBy("number", *per).agg(*ranks).select("number", F.explode(F.array("near.hub", "top.hub")).alias("hub"))
    return best.select(F.least("number", "hub").alias("a"), F.greatest("number", "hub").alias("b")).distinct()


def open_entries(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, number, score, component) of the band values in several components."""
    own = shared.join(labels.withColumnRenamed("node", "number"), "number", "left").select("key", "number", "score", F.coalesce("component", "number").alias("component"))
    ends = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return stored(own.join(ends.select("key"), "key"), "open")


def rest_of_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs of these nodes, of different components, that exact bounds of their sets allow to link.

    Only shingles that occur in several components can be in common. With all others first, then these from rare to
    frequent, two sets that need an overlap of o share one of the first n - o + 1 shingles of either, and have the
    rest of the overlap behind it. So copies with many changes of their own meet no one by what all copies have.
    """
    long = nodes.join(sets, "number").select("number", "component", F.explode(keys_udf("shingles")).alias("s"))
    counts = long.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    crossing = long.join(counts.filter("low <> high").select("s", "df"), "s")
    crossing = crossing.groupBy("number", "component").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("keys"))
    sizes = sets.select("number", (F.length("shingles") / 8).cast("bigint").alias("n"))
    held = crossing.join(sizes, "number").withColumn("held", F.size("keys").cast("bigint"))
    least = F.floor((F.col("n") * PERCENT + 99) / 100)
    first = F.slice("keys", F.lit(1), F.greatest(F.lit(0), (F.col("held") - least + 1).cast("int")))
    index = held.filter(F.col("held") >= least).select("number", "component", "n", "held", F.posexplode(first).alias("at", "k"))
    index = index.select("k.s", "number", "component", "n", "held", (F.col("n") - F.col("held") + F.col("at")).alias("place"))
    # Prefixes of one component only tell nothing.
    both = index.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    index = stored(index.join(both.select("s"), "s"), "prefixes")
    other = index.select("s", *[F.col(c).alias(f"{c}_b") for c in ("number", "component", "n", "held", "place")])
    need = F.ceil((F.col("n") + F.col("n_b")) * PERCENT / (100 + PERCENT))
    pairs = index.join(other, "s").filter((F.col("number") < F.col("number_b")) & (F.col("component") != F.col("component_b")))
    pairs = pairs.filter((need <= F.least("n", "n_b", "held", "held_b")) & (F.col("place") <= F.col("n") - need) & (F.col("place_b") <= F.col("n_b") - need))
    return pairs.select(F.col("number").alias("a"), F.col("number_b").alias("b"))


def node_components(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, component) of the nodes that link to another."""
    shared = central(nodes.select(F.explode(band_keys("registers")).alias("key"), "number"))
    # Only these nodes are ever compared; texts move once.
    nodes = stored(nodes.join(shared.select("number").distinct(), "number"), "candidates")
    sets = stored(full_sets(texts, nodes, shingle), "full-sets")
    star = stored(nearest_hubs(shared.filter("number <> hub"), []), "pairs")
    found = links(star, nodes, sets)
    tested, labels = star, components(found)
    for last in (False, True):
        own = open_entries(shared, labels)
        if last:
            pairs = rest_of_pairs(own.select("number", "component").distinct(), sets)
        else:
            # The most central node of each band value, with nodes of other components.
            hubs = own.groupBy("key").agg(F.max(F.struct("score", "number", "component")).alias("hub"))
            hubs = hubs.select("key", F.col("hub.number").alias("hub"), F.col("hub.score").alias("hub_score"), F.col("hub.component").alias("other"))
            pairs = nearest_hubs(own.join(hubs, "key").filter("component <> other"), ["other"])
        pairs = stored(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = links(pairs, nodes, sets)
        tested = tested.union(pairs)
        if not more.isEmpty():
            found = found.union(more)
            labels = components(found)
    return labels


def join(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; PERCENT is the threshold."""
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketches = rows.select("doc_id", F.xxhash64("text").alias("key"), sketch_udf(shingle)(F.col("text")).alias("s")).select("doc_id", "key", "s.*")
    sketches = stored(sketches, "sketches")
    whole, rest = sketches.filter("n > 0 and doc_id is not null"), sketches.filter("n = 0 or doc_id is null")
    nodes = whole.groupBy("high", "low").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("number"), "high", "low", "first.*", "n", "registers"), "nodes")
    texts = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    labels = node_components(nodes, texts, shingle)
    known = nodes.select("number", "high", "low", "doc_id").join(labels.withColumnRenamed("node", "number"), "number", "left")
    known = stored(known.select("high", "low", "doc_id", F.coalesce("component", "number").alias("component")), "known")
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = known.join(least, "component").select("high", "low", "component_id")
    done = whole.select("doc_id", "n", "high", "low").join(classes, ["high", "low"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rest.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return done.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
