"""Quality classifier by importance resampling: log p_target - log p_raw of hashed n-grams, sampled by Gumbel top-k.

Texts are cut into runs of letters (with other non-ASCII bytes), digits and other marks; single runs and pairs of
neighbours are hashed into ``BUCKETS``. The raw model counts every document; the target model counts documents labelled
good, a bounded sample of them (``MAX_LABELLED``; half of the sample is kept apart to place the threshold). A document's
log weight is the mean of its n-grams' log ratios. Their sum, the likelihood ratio, grows with a document's length, so that
the sample would be the longest documents of the target's side; the mean is a likelihood ratio tempered by the length. Gumbel
noise scaled by ``TEMPERATURE`` is added, and the k documents with the largest sums are the sample. k is a parameter; if
it is not given, it is the number of documents whose weight reaches what good documents have.

A few insults vanish in the mean of a long document. So each single run of marks (a word) also has log odds of toxic
against good labelled documents, by the number of documents that have it, and what a document's ``STRONGEST`` such words
sum to, whatever its length, is taken off its weight where nearly all good documents held apart have less.

Results for odd input: a null or empty text, or one of white space only, has no n-gram and is never kept; repeated rows
have the same noise and are kept or rejected together, as are all rows that tie with the last one kept; a null
``doc_id`` is judged as any other; without labels of both a good document and others in the sample's two halves, the
threshold is 0; without any good label every document with an n-gram is kept; without a toxic label, or a good one held
apart, nothing is taken off. A very long text is hashed whole in one task, in some 60 bytes of memory for each of its own,
and weighs no more than a short one. Only model tables of fixed size, bounded samples of labels and histograms come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mix, pieces

BUCKETS = 1 << 17
#: Labelled documents of each kind (good, other) that are used, at most.
MAX_LABELLED = 20_000
#: The share of good documents held apart that may lie below the threshold.
LOST = 0.005
#: Buckets of single words, and how many of a document's strongest ones count against it.
WORD_BUCKETS = 1 << 20
STRONGEST = 2
#: Labelled documents' worth of prior odds for each word, and the least number of toxic documents that must have it.
PRIOR, SEEN = 4, 2
#: The share of good documents held apart that may have more against them.
LOST_TO_WORDS = 0.0025
#: What the Gumbel noise is scaled by, in mean log ratios (whose deviation among documents is some 0.6).
TEMPERATURE = 0.1
SEED = 4
#: Bytes of texts hashed together: some 50 bytes of memory for each.
CHUNK = 1 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 3
_KIND[128:] = 3
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64))
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of the texts, and the text that each is of."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    kind = _KIND[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    edges = np.cumsum(sizes)[:-1]
    begins[edges[edges < len(data)]] = True
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.minimum(np.arange(len(data)) - np.repeat(starts, lengths), 63)
    hashes = mix(np.add.reduceat(_VALUES[data] * _POWERS[place], starts))
    of = np.repeat(np.arange(len(texts)), sizes)[starts]
    words = kind[starts] != 1
    return hashes[words], of[words]


def ngrams_of(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of runs and of pairs of neighbours, and the text that each is of."""
    pairs = of[1:] == of[:-1]
    both = mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:])[pairs]
    every = np.concatenate([hashes, both])
    return (every % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([of, of[1:][pairs]])


def hashed_ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the texts, and the text that each is of."""
    return ngrams_of(*hashed_words(texts))


def distinct_words(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word buckets of each text, each once, and the text that each is of; by text."""
    every = np.unique(of * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64))
    return every % WORD_BUCKETS, every // WORD_BUCKETS


@dataclass(frozen=True)
class Model:
    #: Log ratio of each bucket; None if there is no target.
    ratio: np.ndarray | None
    #: Log odds of toxic documents for each word bucket, none below 0; None if no word has any.
    odds: np.ndarray | None = None

    def weights(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean log ratio, what the strongest words have against it, and number of n-grams of each text."""
        hashes, whose = hashed_words(texts)
        buckets, of = ngrams_of(hashes, whose)
        n = np.bincount(of, minlength=len(texts))
        if self.ratio is None:
            return np.zeros(len(texts)), np.zeros(len(texts)), n
        return np.bincount(of, weights=self.ratio[buckets], minlength=len(texts)) / np.maximum(n, 1), self.against(hashes, whose, len(texts)), n

    def against(self, hashes: np.ndarray, of: np.ndarray, n_texts: int) -> np.ndarray:
        """The sum of the log odds of each text's ``STRONGEST`` words."""
        if self.odds is None:
            return np.zeros(n_texts)
        there = self.odds[(hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)] > 0
        words, of = distinct_words(hashes[there], of[there])
        odds = self.odds[words]
        order = np.lexsort((-odds, of))
        odds, of = odds[order], of[order]
        counts = np.bincount(of, minlength=n_texts)
        chosen = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) < STRONGEST
        return np.bincount(of[chosen], weights=odds[chosen], minlength=n_texts)


def labelled_sample(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``good`` and ``toxic`` (0 or 1) and ``held`` (for the threshold) of a bounded sample of labels.

    A document is good if no label says otherwise: quality 1 and toxic 0 (or null).
    """
    each = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    each = each.where(F.col("quality").isNotNull())
    each = each.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"), (F.col("toxic") != 0).cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit(SEED)).alias("turn"))
    kinds = [each.where(F.col("good") == g).orderBy("turn", "doc_id").limit(MAX_LABELLED) for g in (0, 1)]
    return kinds[0].unionByName(kinds[1]).select("doc_id", "good", "toxic", (F.pmod("turn", F.lit(2)) == 1).alias("held"))


def word_odds(words: np.ndarray, toxic: np.ndarray, good: np.ndarray, n_toxic: int, n_good: int) -> np.ndarray | None:
    """Log odds of each word bucket, from how many of the labelled documents of both kinds have it."""
    if not (len(words) and n_toxic and n_good):
        return None
    share = n_toxic / (n_toxic + n_good)
    out = np.zeros(WORD_BUCKETS, np.float32)
    out[words] = np.maximum(0, np.log((toxic + PRIOR * share) / n_toxic) - np.log((good + PRIOR * (1 - share)) / n_good))
    return out


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    """The models' log ratios from counts over all documents (raw) and over good ones of the sample (target).

    The same pass counts the sample's toxic and good documents that have a word.
    """
    used = sample.where(((F.col("good") == 1) | (F.col("toxic") == 1)) & ~F.col("held")).select("doc_id", F.col("good").alias("target"))
    marked = docs.select("doc_id", "text").join(F.broadcast(used), "doc_id", "left").select("text", "target")
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        # Of each word bucket, toxic and good documents that have it; in the last place, all of them.
        having = np.zeros((2, WORD_BUCKETS + 1), np.int32)
        for batch, texts in pieces(batches, "text", CHUNK):
            hashes, whose = hashed_words(texts)
            buckets, of = ngrams_of(hashes, whose)
            raw += np.bincount(buckets, minlength=BUCKETS)
            kind = np.array([-1 if x is None else x for x in batch.column(1).to_pylist()])
            chosen = kind == 1
            if chosen.any() and len(buckets):
                target += np.bincount(buckets[chosen[of]], minlength=BUCKETS)
            for k in (0, 1):
                if (kind == k).any():
                    mine = (kind == k)[whose]
                    np.add.at(having[k], distinct_words(hashes[mine], whose[mine])[0], 1)
                    having[k, WORD_BUCKETS] += (kind == k).sum()
        there, words = np.flatnonzero(raw), np.flatnonzero(having.any(axis=0))
        rows = np.append(there, BUCKETS + words), np.append(raw[there], having[0, words]), np.append(target[there], having[1, words])
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    counted = marked.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = counted.where((F.col("bucket") < BUCKETS) | (F.col("raw") >= SEEN) | (F.col("bucket") == BUCKETS + WORD_BUCKETS)).toArrow()  # BUCKETS + WORD_BUCKETS + 1 rows at most
    buckets, raws, targets = (found.column(i).to_numpy() for i in range(3))
    own = buckets < BUCKETS
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[buckets[own]], target[buckets[own]] = raws[own], targets[own]
    if not target.sum():
        return Model(None)
    total, word = buckets == BUCKETS + WORD_BUCKETS, (buckets >= BUCKETS) & (buckets < BUCKETS + WORD_BUCKETS)
    odds = word_odds(buckets[word] - BUCKETS, raws[word], targets[word], int(raws[total].sum()), int(targets[total].sum()))
    return Model(np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)), odds)


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with its ``mean_ratio``, what is ``against`` it, and ``n_grams``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", CHUNK):
            means, against, n = shared.value.weights(texts)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(means), pa.array(against), pa.array(n, pa.int64())], names=["row", "mean_ratio", "against", "n_grams"])

    kind = T.StructType([packed.schema["row"], T.StructField("mean_ratio", T.DoubleType()), T.StructField("against", T.DoubleType()), T.StructField("n_grams", T.LongType())])
    return packed.mapInArrow(run, kind)


def keyed(weighed: DataFrame, doc_id: str, limit: float) -> DataFrame:
    """``log_weight`` and the noisy ``gumbel_key`` beside what ``weigh`` found."""
    weight = F.col("mean_ratio") - F.when(F.col("against") > limit, F.col("against")).otherwise(0.0)
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noise = -F.log(-F.log(uniform)) * TEMPERATURE
    return weighed.withColumn("log_weight", weight).withColumn("gumbel_key", F.col("log_weight") + noise)


def largest(weighed: DataFrame, k: int, bins: int = 1024) -> float:
    """The k-th largest ``gumbel_key``, by histograms of narrowing ranges."""
    low, high = weighed.agg(F.min("gumbel_key"), F.max("gumbel_key")).head()
    wanted = k
    while low < high:
        step = (high - low) / bins
        if not low + step > low:
            break
        inside = weighed.where(F.col("gumbel_key").between(low, high))
        place = F.least(F.floor((F.col("gumbel_key") - low) / step), F.lit(bins - 1))
        counts = inside.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("least"), F.max("gumbel_key").alias("most")).collect()
        for row in sorted(counts, key=lambda r: -r["place"]):
            if row["n"] >= wanted:
                break
            wanted -= row["n"]
        if row["n"] == wanted:
            return row["least"]
        if (row["least"], row["most"]) == (low, high):
            break  # nothing lies between the two
        low, high = row["least"], row["most"]
    return low if low == high else weighed.where(F.col("gumbel_key").between(low, high)).agg(F.min("gumbel_key")).head()[0]


def threshold(held: list[tuple[float, int]]) -> float:
    """Where good documents (1) part from others (0): the best balanced accuracy that loses few good ones."""
    good = np.sort([w for w, g in held if g])
    other = np.sort([w for w, g in held if not g])
    if not len(good) or not len(other):
        return 0.0
    cuts = np.concatenate([good, other])
    gained = np.searchsorted(other, cuts) / len(other) - np.searchsorted(good, cuts) / len(good)
    return float(min(cuts[gained.argmax()], np.quantile(good, LOST)))


def most_against(held: list[tuple[float, int]]) -> float:
    """What may count against a document: all but few of the good ones (1) have no more."""
    good = [a for a, g in held if g]
    return float(np.quantile(good, 1 - LOST_TO_WORDS, method="higher")) if good else float("inf")


@dataclass(frozen=True)
class Selection:
    model: Model
    #: What a document may have against it, taken off its weight if it has more.
    limit: float
    #: The least key that is kept; None if nothing is.
    least: float | None
    #: ``doc_id``, ``log_weight``, ``n_grams``, ``gumbel_key`` of all documents.
    weights: DataFrame


def select(docs: DataFrame, labels: DataFrame, k: int | None = None) -> Selection:
    """Fits the models and places the boundary of a sample of ``k`` documents (all with an n-gram, if fewer)."""
    sample = cut(labelled_sample(labels))
    model = fit(docs, sample)
    weighed = cut(weigh(docs.select("doc_id", "text"), model).select("row.doc_id", "mean_ratio", "against", "n_grams").where("n_grams > 0"))
    held = weighed.join(F.broadcast(sample.where("held")), "doc_id").groupBy("doc_id").agg(F.min("mean_ratio"), F.max("against"), F.first("good")).collect()
    at = threshold([(w, g) for _, w, _, g in held]) if model.ratio is not None else float("-inf")
    limit = most_against([(a, g) for _, _, a, g in held])
    weights = keyed(weighed, "doc_id", limit).select("doc_id", "log_weight", "n_grams", "gumbel_key")
    k = min(k, weights.count()) if k is not None else weights.where(F.col("log_weight") >= at).count()
    return Selection(model, limit, largest(weights, k) if k else None, weights)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The sample: ``doc_id``, ``log_weight``, ``n_grams`` and ``gumbel_key`` of the documents that are kept."""
    chosen = select(docs, labels, k)
    return chosen.weights.where(F.lit(False) if chosen.least is None else F.col("gumbel_key") >= chosen.least)


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that are in the sample, with all their columns; texts are weighed again, not shuffled."""
    chosen = select(docs, labels, k)
    if chosen.least is None:
        return docs.limit(0)
    kept = keyed(weigh(docs, chosen.model), "row.doc_id", chosen.limit).where((F.col("n_grams") > 0) & (F.col("gumbel_key") >= chosen.least))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
