"""Exact top-k search by statistics of segments at several resolutions.

Vectors become integers, floor(64 x). A vector is cut into segments; with each one's mean and deviation, the squared
distance of two vectors is at least the sum over segments of L ((mean - mean')^2 + (dev - dev')^2), so that with both
norms known their inner product is at most the sum of L (mean mean' + dev dev'). Bounds are taken coarse to fine, each
only for what the coarser one left, and the survivors' products are computed exactly.

Results for odd input: see ``vectors``; with fewer than ``k`` other vectors all of them are returned; a table without a
usable vector gives no rows. Components must be small enough that a product fits 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vectors import best, best_in_blocks

#: Segments a vector is cut into at each resolution.
RESOLUTIONS = (4, 16, 32)
#: Queries whose bounds are taken together.
STEP = 128
#: Room for rounding in a bound, in proportion to the norms.
SLACK = 1e-9


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each vector its segments' means and deviations, times the root of their lengths."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    lengths = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    spread = np.add.reduceat((x - np.repeat(mean, lengths, axis=1)) ** 2, edges[:-1], axis=1)
    return np.concatenate([mean * np.sqrt(lengths), np.sqrt(spread)], axis=1)


def integer_vectors(x: np.ndarray) -> np.ndarray:
    return np.floor(64 * x.astype(np.float64))


def _products(data: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers, a row for each query."""
    if np.abs(data).max(initial=0) * np.abs(queries).max(initial=0) * data.shape[1] < 2**52:
        return (queries @ data.T).astype(np.int64)
    return queries.astype(np.int64) @ data.astype(np.int64).T


def index_block(k: int):
    def index(ids: np.ndarray, data: np.ndarray):
        data = integer_vectors(data)
        statistics = [_statistics(data, s) for s in RESOLUTIONS]
        longest = np.sqrt((data**2).sum(axis=1).max())

        def ask(query_ids: np.ndarray, queries: np.ndarray):
            queries = integer_vectors(queries)
            found: tuple[list, list, list] = ([], [], [])
            for at in range(0, len(queries), STEP):
                some, some_ids = queries[at : at + STEP], query_ids[at : at + STEP]
                room = SLACK * (1 + longest * np.sqrt((some**2).sum(axis=1)))
                other = ids != some_ids[:, None]
                floor = np.full(len(some), -np.inf)
                left = other
                columns = np.arange(len(ids))
                for number, (of_data, resolution) in enumerate(zip(statistics, RESOLUTIONS, strict=True)):
                    bound = _statistics(some, resolution) @ of_data[columns].T
                    if number == 0 and len(ids) > k + 1:
                        # The exact products of the k most promising set a floor that the k best cannot lie under.
                        first = np.argpartition(np.where(other, -bound, np.inf), k - 1, axis=1)[:, :k]
                        floor = np.einsum("qkd,qd->qk", data[first], some).min(axis=1) - room
                    left = left & (bound >= floor[:, None])
                    alive = left.any(axis=0)
                    left, columns = left[:, alive], columns[alive]
                products = _products(data[columns], some)
                for i, (row, keep) in enumerate(zip(products, left, strict=True)):
                    there = np.flatnonzero(keep)
                    scores = row[there]
                    if len(there) > k:
                        there = there[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
                    top = there[best(row[there], ids[columns[there]], k)]
                    found[0].append(np.full(len(top), at + i))
                    found[1].append(columns[top])
                    found[2].append(row[top])
            return tuple(np.concatenate(f) if f else np.empty(0, np.int64) for f in found)

        return ask

    return index


def exact_topk(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` largest integer inner products of each query with the other rows, ties to smaller ``vec_id``."""
    return best_in_blocks(embeddings, every, k, False, index_block(k), "long")
