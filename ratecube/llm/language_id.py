"""Language identification of words and documents by a linear-chain conditional random field.

Words are runs of ASCII letters and of characters beyond ASCII. A word's features are the word itself
(lexicon), its prefixes and suffixes, and its byte bi- and trigrams, hashed to fixed tables of
weights; one matrix of weights holds the transitions. Weights come from gradient steps on the
likelihood of label sequences, over a bounded sample of labelled documents whose pieces are dealt out
anew, so that switches between languages occur. Words are labelled by forward-backward; long texts
are cut into segments whose transfer matrices are multiplied, so any length takes the same steps.

Defined cases: a null text, or one without a letter, is `und` with score 0; repeated rows are labelled
each for itself; without a labelled row everything is `und`; ties go to the first language by name; of more than
MAX_LANGUAGES languages those with the most labelled rows are learned, ties by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratecube.llm.common import DOUBLE, INT, STRING, bounded_batches, free_name, list_of, struct_of, utf8_buffer

#: The sample: at most so many distinct texts of each language, of at most so many bytes each; of longer ones a run of words.
SAMPLE_DOCUMENTS = 150
SAMPLE_BYTES = 6000
#: So many languages are learned, those with the most labelled rows.
MAX_LANGUAGES = 100
#: A language's texts are ranked in so many parts first, then the leaders of the parts.
SAMPLE_PARTS = 64
TABLE_BITS = 16
STEPS = 30
RATE = 0.5
#: Segments of words for the forward-backward sweeps.
SEGMENT = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def segmented(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, where words begin, where they end, first word of each text and the number of words)."""
    data, bounds = utf8_buffer(texts)
    low = _LOWER[data]
    latin = np.zeros(len(low), bool)  # second bytes of Latin-1 capitals
    latin[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low[latin] += 32
    inside = _LETTER[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return low, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def _hashed(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int32) + salt * (1 << TABLE_BITS)


#: Feature families, each with a table of its own: lexicon, two prefixes, three suffixes, bi- and trigrams.
FAMILIES = 8


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of words, one column a family; features of positions, two columns; first position of each word).

    Positions are the bytes of the words, without what lies between.
    """
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    word = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(total) - firsts[word] + starts[word]
    b0 = low[at].astype(np.uint64) + np.uint64(1)
    b1, b2 = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    b1[1:] = b0[:-1]
    b2[2:] = b0[:-2]
    b1[firsts] = 0
    b2[firsts] = 0
    b2[firsts[lengths > 1] + 1] = 0
    two = b1 << np.uint64(9) | b0
    three = b2 << np.uint64(18) | two
    grams = np.stack([_hashed(two, 6), _hashed(three, 7)], 1)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), 0x100000001B3, np.uint64))
    whole = np.add.reduceat(b0 * powers[at - starts[word]], firsts) if total else np.empty(0, np.uint64)

    def window(first: np.ndarray, size: int) -> np.ndarray:
        value = np.zeros(len(starts), np.uint64)
        for k in range(size):
            p = first + k
            ok = (p >= starts) & (p < ends)
            value = value << np.uint64(9) | np.where(ok, low[np.clip(p, 0, max(0, len(low) - 1))].astype(np.uint64) + np.uint64(1), np.uint64(0))
        return value

    own = [_hashed(whole, 0), _hashed(window(starts, 2), 1), _hashed(window(starts, 3), 2)]
    own += [_hashed(window(ends - k, k), 1 + k) for k in (2, 3, 4)]
    return np.stack(own, 1), grams, firsts


def emissions(weights: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores of words by language, words taken in runs of about a quarter of a million bytes."""
    out = np.zeros((len(starts), weights.shape[1]), np.float32)
    done = 0
    while done < len(starts):
        to = max(done + 1, int(np.searchsorted(ends, starts[done] + (1 << 18), "right")))
        own, grams, firsts = features(low, starts[done:to], ends[done:to])
        out[done:to] = np.add.reduceat(weights[grams[:, 0]] + weights[grams[:, 1]], firsts, axis=0)
        for column in own.T:
            out[done:to] += weights[column]
        done = to
    return out


def posteriors(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of words, and of the pairs of neighbours in all (summed, labels by labels).

    Sequence i has the words first[i] to first[i + 1].
    """
    n, labels = scores.shape
    weight = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    counts = np.diff(first)
    parts = -(-counts // SEGMENT)
    sequence = np.repeat(np.arange(len(counts)), parts)
    rank = np.arange(len(sequence)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[:-1][sequence] + rank * SEGMENT
    length = np.minimum(SEGMENT, first[1:][sequence] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(SEGMENT + 1)]  # segments longer than t
    m = len(order)
    enter = np.full((m, labels), 1 / labels)
    leave = np.full((m, labels), 1 / labels)
    if len(rank) and rank.max() > 0:
        transfer = np.broadcast_to(np.eye(labels), (m, labels, labels)).copy()
        for t in range(SEGMENT):
            k = live[t]
            step = (transfer[:k].reshape(-1, labels) @ moves).reshape(k, labels, labels) * weight[begin[:k] + t][:, None, :]
            transfer[:k] = step / step.sum(axis=(1, 2), keepdims=True)
        head = np.flatnonzero(rank == 0)
        for r in range(1, int(rank.max()) + 1):
            head = head[parts[sequence[head]] > r]
            a, b = place[head + r - 1], place[head + r]
            v = np.einsum("ij,ijk->ik", enter[a], transfer[a])
            enter[b] = v / v.sum(axis=1, keepdims=True)
        tail = np.cumsum(parts)[parts > 0] - 1
        for r in range(1, int(rank.max()) + 1):
            tail = tail[parts[sequence[tail]] > r]
            a, b = place[tail - r], place[tail - r + 1]
            v = np.einsum("ijk,ik->ij", transfer[b], leave[b])
            leave[a] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((n, labels))
    v = enter
    for t in range(SEGMENT):
        k = live[t]
        if not k:
            break
        v = (v[:k] @ moves) * weight[begin[:k] + t]
        v /= v.sum(axis=1, keepdims=True)
        alpha[begin[:k] + t] = v
    gamma = np.empty((n, labels))
    pairs = np.zeros((labels, labels))
    beta = leave.copy()
    for t in range(SEGMENT - 1, -1, -1):
        k = live[t]
        if not k:
            continue
        at = begin[:k] + t
        g = alpha[at] * beta[:k]
        gamma[at] = g / g.sum(axis=1, keepdims=True)
        back = weight[at] * beta[:k]
        before = alpha[at - 1] if t else enter[:k]
        joint = before[:, :, None] * moves[None] * back[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = back @ moves.T
        beta[:k] = b / b.sum(axis=1, keepdims=True)
    return gamma, pairs


def fit(texts: list[str], labels: list[int], n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights of features, transition weights) from texts of one language each."""
    low, starts, ends, first = segmented(pa.array(texts, pa.string()))
    label = np.repeat(np.array(labels), np.diff(first))
    rng = np.random.default_rng(7)
    # Pieces of 8 to 64 words, in a new order, in sequences of about 256 words.
    cuts, at = [], 0
    while at < len(starts):
        to = min(at + int(rng.integers(8, 65)), int(first[np.searchsorted(first, at, "right")]))
        cuts.append((at, to))
        at = to
    pieces = [np.arange(*cuts[i]) for i in rng.permutation(len(cuts))]
    words = np.concatenate(pieces)
    sequences = np.append(np.arange(0, len(words), 256), len(words))
    spelled = np.array([low[a:b].tobytes() for a, b in zip(starts[words], ends[words], strict=True)], object)
    kinds, kind = np.unique(spelled, return_inverse=True)
    flat = np.frombuffer(b" ".join(kinds.tolist()) + b" ", np.uint8)
    sizes = np.fromiter(map(len, kinds), np.int64, len(kinds))
    kind_ends = np.cumsum(sizes + 1) - 1
    own, grams, firsts = features(flat, kind_ends - sizes, kind_ends)
    columns = [*own.T]
    owner = np.repeat(np.arange(len(kinds)), np.diff(np.append(firsts, len(grams))))
    size = FAMILIES << TABLE_BITS
    weights, sums = np.zeros((size, n_labels), np.float32), np.full((size, n_labels), 1e-3)
    moves, move_sums = np.zeros((n_labels, n_labels)), np.full((n_labels, n_labels), 1e-3)
    wanted = label[words]
    target = np.zeros((len(words), n_labels))
    target[np.arange(len(words)), wanted] = 1
    seen = np.zeros((n_labels, n_labels))
    inner = np.ones(len(words), bool)
    inner[sequences[:-1]] = False
    np.add.at(seen, (wanted[:-1][inner[1:]], wanted[1:][inner[1:]]), 1)
    for _ in range(STEPS):
        scores = np.add.reduceat(weights[grams[:, 0]] + weights[grams[:, 1]], firsts, axis=0)
        for column in columns:
            scores += weights[column]
        gamma, pairs = posteriors(scores[kind], sequences, np.exp(moves))
        error = np.stack([np.bincount(kind, (target - gamma)[:, j], len(kinds)) for j in range(n_labels)], 1)
        slope = np.zeros((size, n_labels))
        for j in range(n_labels):
            for column in columns:
                slope[:, j] += np.bincount(column, error[:, j], size)
            for g in grams.T:
                slope[:, j] += np.bincount(g, error[owner, j], size)
        slope = slope / len(words) - 1e-6 * weights
        sums += slope**2
        weights += (RATE * slope / np.sqrt(sums)).astype(np.float32) * 0.2
        move_slope = (seen - pairs * seen.sum() / max(1.0, pairs.sum())) / len(words) - 1e-6 * moves
        move_sums += move_slope**2
        moves += RATE * move_slope / np.sqrt(move_sums)
    return weights, moves


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


class Labeller:
    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray):
        self.languages, self.weights, self.moves = languages, weights, np.exp(moves)

    def label(self, texts: pa.Array) -> list[tuple[str, float, list[dict]]]:
        """(language, score, runs of words of one language) for each text."""
        low, starts, ends, first = segmented(texts)
        gamma, _ = posteriors(emissions(self.weights, low, starts, ends), first, self.moves)
        best = gamma.argmax(axis=1)
        sums = np.zeros((len(first) - 1, gamma.shape[1]))
        some = np.diff(first) > 0
        if some.any():
            sums[some] = np.add.reduceat(gamma, first[:-1][some], axis=0)
        out = []
        for i in range(len(texts)):
            a, b = first[i], first[i + 1]
            if a == b or not (len(set(low[starts[a] : ends[b - 1]].tolist()) & _ASCII) or has_letter(texts[i].as_py())):
                out.append(("und", 0.0, []))
                continue
            own = best[a:b]
            edges = np.flatnonzero(np.diff(own)) + 1
            heads = [0, *edges.tolist()]
            tails = [*edges.tolist(), len(own)]
            runs = [{"first": h, "last": t - 1, "lang": self.languages[own[h]]} for h, t in zip(heads, tails, strict=True)]
            k = int(sums[i].argmax())
            out.append((self.languages[k], float(min(1.0, sums[i, k] / (b - a))), runs))
        return out


_ASCII = set(range(0x61, 0x7B))
LABELLED = struct_of(lang_pred=STRING, score=DOUBLE, runs=list_of(struct_of(first=INT, last=INT, lang=STRING)))


def leaders(texts: DataFrame, groups: list[str]) -> DataFrame:
    """The first SAMPLE_DOCUMENTS texts of each group, long ones last, by the hash of the id."""
    order = Window.partitionBy(*groups).orderBy("long", F.xxhash64("id"), "id", "digest")
    return texts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_DOCUMENTS).drop("place")


def sample(training: DataFrame, doc_id: str, text: str, lang: str) -> list[tuple[str, str]]:
    """(text, language) of at most SAMPLE_DOCUMENTS distinct texts of each language, chosen by the hash of the id.

    Texts without a letter take no place. Texts over SAMPLE_BYTES come after all others, and of these only whole words at
    the beginning are taken, from the first letter on.
    """
    usable = training.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    usable = usable.select(F.col(doc_id).alias("id"), F.col(lang).alias("l"), F.col(text).alias("t"), F.sha2(text, 256).alias("digest"))
    long = F.octet_length("t") > SAMPLE_BYTES
    texts = usable.groupBy("l", "digest").agg(F.min("id").alias("id"), F.first(long).alias("long"))
    # A language's last ranking sees SAMPLE_PARTS * SAMPLE_DOCUMENTS rows at most, however many it has.
    parts = texts.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(SAMPLE_PARTS)))
    picked = leaders(leaders(parts, ["l", "part"]), ["l"]).select("l", "digest", "id")
    same = [usable[c].eqNullSafe(picked[c]) for c in ("l", "digest", "id")]
    run = F.regexp_replace(F.substring(F.regexp_replace("t", r"^\P{L}+", ""), 1, SAMPLE_BYTES // 4), r"(?<=\s)\S+$", "")
    rows = usable.join(F.broadcast(picked), same, "left_semi").select("l", "digest", F.when(long, run).otherwise(F.col("t")).alias("t"))
    return sorted((r.t, r.l) for r in rows.dropDuplicates(["l", "digest"]).collect())


def labeller(training: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Labeller | None:
    """Fit on a bounded sample; None where no row has a language and a letter."""
    counts = training.filter(F.col(lang).isNotNull()).groupBy(lang).agg(F.count(F.lit(1)).alias("n"))
    most = [r[0] for r in counts.orderBy(F.desc("n"), lang).select(lang).limit(MAX_LANGUAGES).collect()]
    rows = [r for r in sample(training.filter(F.col(lang).isin(most)), doc_id, text, lang) if has_letter(r[0])]
    if not rows:
        return None
    languages = sorted({language for _, language in rows})
    return Labeller(languages, *fit([t for t, _ in rows], [languages.index(x) for _, x in rows], len(languages)))


def label(documents: DataFrame, model: Labeller | None, keep: list, text: str = "text") -> DataFrame:
    """(keep, lang_pred, score, runs): the document's language, its share of the words, and runs of words."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(LABELLED)
    def labelled(texts: pa.Array) -> pa.Array:
        own = shared.value
        rows = own.label(texts) if own is not None else [("und", 0.0, [])] * len(texts)
        kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang_pred", "score", "runs"])

    kept = documents.select(*keep)
    name = free_name(kept, "label")
    return documents.select(*keep, labelled(F.col(text)).alias(name)).select(*kept.columns, f"{name}.*")
