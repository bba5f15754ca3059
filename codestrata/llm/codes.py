"""Vector codes: the nearest entries of small codebooks, found exactly by integer Walsh-Hadamard transforms.

A component x becomes the integer floor(1024 x), and a vector is cut into ``PARTS`` equal consecutive parts, each with a
codebook of at most ``ENTRIES`` entries. Parts and entries are padded with zeros to a power of two and transformed; all
coefficients are integers, and the sum of their squared differences is the squared distance times the padded length.
Coefficients are taken in sequency order, so that those that tell most of smooth vectors come first: an entry goes as soon as
its sum so far exceeds the whole sum of another, and what is left at the end is the nearest, without floating point.

Codebooks begin with the vectors of the smallest ids. A round assigns every part to its nearest entry in one pass over the
vectors, without a shuffle of them; only counts and sums for each entry leave a task, and meet by entry and component. Codebooks (``ENTRIES`` vectors) go through
the driver, which is bounded by the dimension and not by the rows.

Results for odd input: vectors that are null, empty, or hold a null or non-finite component are dropped; a null ``vec_id`` comes after all others
among the first entries; rows of one id are ordered by their vectors, and repeated rows count as often as they come; vectors
are padded with zeros at their end to a dimension that ``PARTS`` divides, and those of one such dimension have codebooks of their own; with
fewer rows than entries, a codebook is that small; extra columns, whatever their names, are left out; an empty table gives no rows.
Components so large that 64 bits might not do (some 15,000 at 64 dimensions, see ``LARGEST``) end the job with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors worked on together, and components of theirs; pairs of vectors and entries whose sums stay in a cache.
BLOCK, BLOCK_COMPONENTS, CACHED = 4096, 1 << 20, 1 << 16
#: Coefficients before the first elimination; pairs are followed one by one when one in so many is left.
FIRST, FEW = 4, 16
#: Largest integer component times the dimension, for which sums of squared coefficients fit 64 bits.
LARGEST = 1 << 30
#: Labels whose errors are broadcast; more are joined by a shuffle.
LABELS = 100_000


@lru_cache(maxsize=16)
def walsh(n: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of ``n`` (a power of two) with its columns in order of their changes of sign."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return np.ascontiguousarray(h[:, np.argsort((h[1:] != h[:-1]).sum(axis=0), kind="stable")])


def transform(x: np.ndarray) -> np.ndarray:
    """Integer coefficients of rows that are padded with zeros to a power of two, in sequency order."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    return x @ walsh(n)[: x.shape[1]]


def nearest(coefficients: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the entry at the least squared distance (ties to the lower index), and that distance times the length.

    Rows come in blocks whose sums stay in a processor's cache.
    """
    step = max(1, CACHED // len(entries))
    found = [_nearest(coefficients[at : at + step], entries) for at in range(0, len(coefficients), step)]
    return np.concatenate([e for e, _ in found]), np.concatenate([d for _, d in found])


def _nearest(coefficients: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums grow by one coefficient for all pairs of rows and entries, until few pairs are left; those are followed one by one.

    After the first coefficients a row's most promising entry is summed up whole, which gives the bound that its others must keep.
    """
    rows, n = coefficients.shape
    sums, term, bound = np.zeros((rows, len(entries)), np.int64), np.empty((rows, len(entries)), np.int64), None
    columns = np.ascontiguousarray(entries.T)
    for j in range(n):
        if j >= FIRST and j % 2 == 0:
            if bound is None:
                bound = ((coefficients - entries[sums.argmin(axis=1)]) ** 2).sum(axis=1)[:, None]
            left = sums <= bound
            if np.count_nonzero(left) * FEW <= left.size:
                row, entry = np.nonzero(left)
                return _follow(coefficients, entries, row, entry, sums[row, entry], bound[:, 0], j)
        np.subtract(coefficients[:, j, None], columns[j], out=term)
        np.multiply(term, term, out=term)
        sums += term
    best = sums.argmin(axis=1)  # the first of the least
    return best, sums[np.arange(rows), best]


def _follow(coefficients: np.ndarray, entries: np.ndarray, row: np.ndarray, entry: np.ndarray, left: np.ndarray, bound: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers from pairs that are summed up to the coefficient ``at``; pairs go as they exceed their row's bound."""
    while at < coefficients.shape[1]:
        stop = min(coefficients.shape[1], 2 * at)
        left = left + ((coefficients[row, at:stop] - entries[entry, at:stop]) ** 2).sum(axis=1)
        keep = left <= bound[row]
        row, entry, left, at = row[keep], entry[keep], left[keep], stop
    # Pairs are in order of rows, then entries: the first of the least is the answer.
    order = np.lexsort((entry, left, row))
    row, entry, left = row[order], entry[order], left[order]
    best = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    return entry[best], left[best]


def integers(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``v``, the integer components padded to a multiple of ``PARTS``, of the usable vectors."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = embeddings.select("vec_id", "label", "embedding").where((F.size("embedding") > 0) & finite)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    fits = F.forall(whole, lambda x: F.abs(x) <= F.lit(LARGEST) / (F.size("embedding") + PARTS))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for exact 64-bit arithmetic")))
    padding = F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size("embedding"), F.lit(PARTS)))
    return used.select("vec_id", "label", F.concat(checked, padding).alias("v"))


#: Codebooks of one dimension: an array for each part, a row for each entry.
Books = dict[int, list[np.ndarray]]


def first_books(vectors: DataFrame) -> Books:
    """Codebooks of the vectors of the smallest ids."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = vectors.select("vec_id", "v", F.size("v").alias("dim")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= ENTRIES)
    rows: dict[int, list] = {}
    for row in sorted(first.collect(), key=lambda r: (r["dim"], r["at"])):
        rows.setdefault(row["dim"], []).append(row["v"])
    return {dim: np.split(np.array(v, np.int64), PARTS, axis=1) for dim, v in rows.items()}


def _assigned(batches: Iterator[pa.RecordBatch], books: Books) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[tuple]]]:
    """Slices of the batches with the place of their vectors of one dimension, codes and errors of those, and the parts themselves."""
    entries = {dim: [transform(b) for b in parts] for dim, parts in books.items()}
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("v"))
        sizes = np.diff(column.offsets.to_numpy())
        for dim in np.unique(sizes).tolist():
            there = np.flatnonzero(sizes == dim)
            step = max(1, min(BLOCK, BLOCK_COMPONENTS // dim))
            for at in range(0, len(there), step):
                some = there[at : at + step]
                v = column.take(pa.array(some)).flatten().to_numpy().reshape(-1, dim)
                parts = np.split(v, PARTS, axis=1)
                found = [nearest(transform(p), e) for p, e in zip(parts, entries[dim], strict=True)]
                length = 1 << max(0, dim // PARTS - 1).bit_length()
                yield batch, some, np.stack([c for c, _ in found], axis=1), np.stack([d // length for _, d in found], axis=1), parts


def sums_of(vectors: DataFrame, books: Books) -> DataFrame:
    """``dim``, ``part``, ``entry``, ``place``, ``count`` and ``total`` of the parts that are assigned to each entry."""
    schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {dim: np.zeros((PARTS, len(b[0])), np.int64) for dim, b in books.items()}
        totals: dict[int, list[np.ndarray]] = {dim: [np.zeros_like(x) for x in b] for dim, b in books.items()}
        for _, _, codes, _, parts in _assigned(batches, books):
            dim = PARTS * parts[0].shape[1]
            for p, part in enumerate(parts):
                np.add.at(totals[dim][p], codes[:, p], part)
                counts[dim][p] += np.bincount(codes[:, p], minlength=counts[dim].shape[1])
        for dim, count in counts.items():
            part, entry = np.nonzero(count)
            if len(part):
                yield batch_of(schema, [np.full(len(part), dim), part, entry, count[part, entry], [totals[dim][p][e] for p, e in zip(part, entry, strict=True)]])

    of_tasks = vectors.select("v").mapInArrow(run, "dim int, part int, entry int, count long, sums array<long>")
    each = of_tasks.select("dim", "part", "entry", "count", F.posexplode("sums").alias("place", "value"))
    return each.groupBy("dim", "part", "entry", "place").agg(F.sum("count").alias("count"), F.sum("value").alias("total"))


def train(vectors: DataFrame, rounds: int = ROUNDS) -> Books:
    """Codebooks after some rounds of assigning all parts and taking the mean of each entry's, rounded down."""
    books = first_books(vectors)
    for _ in range(rounds if books else 0):
        new = {dim: [b.copy() for b in parts] for dim, parts in books.items()}
        for row in sums_of(vectors, books).collect():  # a number for each component of the codebooks
            new[row["dim"]][row["part"]][row["entry"], row["place"]] = row["total"] // row["count"]
        books = new
    return books


def encode(vectors: DataFrame, books: Books) -> DataFrame:
    """``vec_id``, ``label``, ``code`` and ``error`` of all vectors."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some, codes, errors, _ in _assigned(batches, books):
            at = pa.array(some)
            yield batch_of(schema, [batch.column(0).take(at), batch.column(1).take(at), [bytes(c).hex() for c in codes.astype(np.uint8)], errors.sum(axis=1)])

    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "v")
    return typed.mapInArrow(run, "vec_id long, label int, code string, error long")


def decode(encoded: DataFrame, books: Books, dim: int) -> DataFrame:
    """``vec_id`` and ``v``, the integer components that codes of one dimension stand for."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [bytes.fromhex(c) for c in batch.column(1).to_pylist()]
            yield batch_of(schema, [batch.column(0), [np.concatenate([books[dim][p][e] for p, e in enumerate(c)]) for c in codes]])

    return encoded.select("vec_id", "code").mapInArrow(run, "vec_id long, v array<long>")


def books_digest(books: Books) -> str:
    """A digest of all entries' components, by dimension, part, entry and place."""
    return hashlib.sha256(",".join(str(x) for _, parts in sorted(books.items()) for part in parts for x in part.ravel().tolist()).encode()).hexdigest()


def label_errors(encoded: DataFrame) -> DataFrame:
    """Rows of ``encode`` with the errors of all rows of their label, nulls being one label.

    Errors are added up before they meet, so that a frequent label costs one row of each task; then the few labels go to the rows.
    """
    errors = cut(encoded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    told = F.broadcast(errors) if errors.count() <= LABELS else errors
    return encoded.join(told, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def compress(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every usable vector."""
    vectors = integers(embeddings)
    books = train(vectors)
    encoded = cut(encode(vectors, books))
    return label_errors(encoded).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
