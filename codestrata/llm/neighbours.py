"""Approximate nearest neighbours by counting collisions over single-projection sorted arrays.

Largest inner products become nearest points: vectors are scaled by the largest norm M of their block and given one more
component, sqrt(1 - |x|^2 / M^2), and queries are scaled to length one with a zero there. Each of ``PROJECTIONS`` random
directions keeps a block's points sorted by their projection. A query's window on each array is centred on its own
projection. Virtual rehashing widens all windows step by step, on both sides; only what a step adds to a window is
counted. A point inside the windows of at least ``THRESHOLD`` of the arrays is verified by its exact inner product.

Widening ends by a bound on collisions: a point at a distance d lies in a window of half width h with the probability
p = 2 Phi(h / d) - 1. Once the k-th best point verified is so near that its own count would exceed the threshold by
``SURE`` standard deviations, nearer points have been verified already, but for few. So the share of points verified
follows from the data and their dimension, and no number of candidates is fixed. Every row is indexed.

Results for odd input: see ``vectors``; zero vectors take no part; with fewer than ``k`` other vectors all are returned;
components are scaled before norms are taken, so that none overflows, and a score that does is infinite.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame

from .vectors import best, best_in_blocks

PROJECTIONS = 80
#: The share of arrays in whose windows a candidate lies.
THRESHOLD = 0.6
#: Standard deviations of a count by which the k-th best must be certain to be found.
SURE = 1.3
#: Half the width of a block's first windows, and by how much each rehashing widens them.
WIDTH, WIDER = 0.8, 1.05
#: The share of the last query's width that the next one begins with.
BACK = 0.93
SEED = 20


def _reach() -> float:
    """By how much a window's half must exceed the k-th best point's distance."""
    share = min(0.999, THRESHOLD + SURE * (THRESHOLD * (1 - THRESHOLD) / PROJECTIONS) ** 0.5)
    return NormalDist().inv_cdf((1 + share) / 2)


def _widened(order: np.ndarray, low: np.ndarray, high: np.ndarray, new_low: np.ndarray, new_high: np.ndarray) -> np.ndarray:
    """How many windows each point has newly come into, as the windows [low, high) became [new_low, new_high)."""
    left = [a[i:j] for a, i, j in zip(order, new_low.tolist(), low.tolist(), strict=True)]
    right = [a[i:j] for a, i, j in zip(order, high.tolist(), new_high.tolist(), strict=True)]
    return np.bincount(np.concatenate(left + right), minlength=order.shape[1])


def index_block(k: int):
    needed, reach = int(np.ceil(THRESHOLD * PROJECTIONS)), _reach()

    def index(ids: np.ndarray, data: np.ndarray):
        data = data.astype(np.float64)
        n, dim = data.shape
        scaled = data / np.abs(data).max()
        norms = np.sqrt((scaled**2).sum(axis=1))
        scaled /= norms.max()
        directions = np.random.default_rng(SEED).standard_normal((dim + 1, PROJECTIONS))
        shadows = scaled @ directions[:dim] + np.sqrt(np.maximum(0, 1 - (norms / norms.max()) ** 2))[:, None] * directions[dim]
        order = np.argsort(shadows, axis=0).T.copy()
        arrays = np.take_along_axis(shadows.T, order, axis=1)

        def ask(query_ids: np.ndarray, queries: np.ndarray):
            queries = queries.astype(np.float64)
            units = queries / np.abs(queries).max(axis=1, keepdims=True)
            units /= np.sqrt((units**2).sum(axis=1, keepdims=True))
            centres = units @ directions[:dim]
            found: tuple[list, list, list] = ([], [], [])
            half = WIDTH
            for i, (unit, centre) in enumerate(zip(units, centres, strict=True)):
                counts, passed = np.zeros(n, np.int64), ids == query_ids[i]  # its own row is passed over
                candidates, scores = np.empty(0, np.int64), np.empty(0)
                low = high = np.array([a.searchsorted(c) for a, c in zip(arrays, centre, strict=True)])
                while True:
                    new_low = np.array([a.searchsorted(c) for a, c in zip(arrays, centre - half, strict=True)])
                    new_high = np.array([a.searchsorted(c, side="right") for a, c in zip(arrays, centre + half, strict=True)])
                    counts += _widened(order, low, high, new_low, new_high)
                    low, high = new_low, new_high
                    new = np.flatnonzero((counts >= needed) & ~passed)
                    passed[new] = True
                    candidates, scores = np.concatenate([candidates, new]), np.concatenate([scores, scaled[new] @ unit])
                    if len(scores) >= k:
                        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                        if max(0.0, 2 - 2 * kth) ** 0.5 * reach <= half:
                            break
                    if (low == 0).all() and (high == n).all():
                        break
                    half *= WIDER
                half = max(WIDTH, half * BACK)
                if len(scores) > k:  # with room for rounding
                    candidates = candidates[scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-9]
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = (data[candidates] * queries[i]).sum(axis=1)
                top = best(exact, ids[candidates], k)
                found[0].append(np.full(len(top), i))
                found[1].append(candidates[top])
                found[2].append(exact[top])
            return (*(np.concatenate(f) if f else np.empty(0, np.int64) for f in found[:2]), np.concatenate(found[2]) if found[2] else np.empty(0))

        return ask

    return index


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` largest inner products found for each query, nearest first, ties to smaller ``vec_id``."""
    return best_in_blocks(embeddings, every, k, True, index_block(k), "double")
