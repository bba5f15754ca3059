"""Packing and intervals against plain loops."""

import random
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from codestrata.functions.text import est_tokens
from codestrata.operators import folds


def greedy(sizes, budget):
    out, chunk, used, n = [], 0, 0, 0
    for s in sizes:
        if n and used + s > budget:
            chunk, used, n = chunk + 1, 0, 0
        used, n = used + s, n + 1
        out.append(chunk)
    return out


@pytest.mark.parametrize("budget", [1, 7, 60])
def test_transfer_and_chunks_equal_the_loop(budget):
    rng = random.Random(budget)
    for _ in range(300):
        sizes = [rng.choice([0, 0, 1, 2, 5, budget, budget + 9]) for _ in range(rng.randint(1, 40))]
        found, _ = folds.chunks_from(np.array(sizes), budget + 1, budget)
        assert (found - 1).tolist() == greedy(sizes, budget)
        cut = rng.randint(0, len(sizes))
        if 0 < cut < len(sizes):
            before, tokens = folds.chunks_from(np.array(sizes[:cut]), budget + 1, budget)
            opened, after = folds.transfer(np.array(sizes[cut:]), budget)
            whole, last = folds.chunks_from(np.array(sizes), budget + 1, budget)
            assert before[-1] + opened[tokens] == whole[-1] and after[tokens] == last


def chunks(spark, rows, budget, most):
    table = spark.createDataFrame(rows, "key string, at long, text string, extra string").repartition(3)
    return sorted((r.key or "", r.at, r.chunk) for r in folds.chunk_units(table, "key", "at", est_tokens(F.col("text")), budget, most).collect())


@pytest.mark.parametrize("budget", [3, 40])
def test_units_of_hot_and_odd_keys(spark, budget):
    """One key has two thirds of all units and lies in several tasks; others are null, have one unit, or no text."""
    rng = random.Random(budget)
    text = lambda: rng.choice([None, "", "x", "x" * 9, "x" * 4 * budget, "x" * 5 * budget, "x" * 13])
    sizes = {"hot": 4000, "b": 700, "z": 1, "": 1, None: 900, **{f"k{i}": 3 for i in range(100)}}
    rows = [(k, i, text(), "e") for k, n in sizes.items() for i in range(n) if (k, i) != ("", 0)]
    rng.shuffle(rows)
    expected = []
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        expected += [(k or "", r[1], c) for r, c in zip(own, greedy([-(-len(r[2] or "") // 4) for r in own], budget), strict=True)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (0, 500, 800, 10**9):
            assert chunks(spark, rows, budget, most) == sorted(expected)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert chunks(spark, rows[:0], budget, 5) == []


def test_a_key_of_millions_of_units(spark):
    n = 2_000_000
    units = spark.range(n).selectExpr("'one' AS key", "id AS at", "repeat('x', cast(id * id % 97 AS int)) AS text")
    i = np.arange(n, dtype=np.int64)
    whole, _ = folds.chunks_from(-(-(i * i % 97) // 4), 501, 500)
    for most in (n // 2, n):
        found = folds.chunk_units(units, "key", "at", est_tokens(F.col("text")), 500, most).agg(F.max("chunk"), F.count("*")).first()
        assert tuple(found) == (int(whole[-1]) - 1, n)


INTERVALS = "key string, first long, last long, name string, n int"


def nearest(points, intervals):
    out = {}
    for key, p in points:
        around = [(b - a, (name is not None, name), a, b, n) for k, a, b, name, n in intervals if k == key and a is not None and b is not None and a <= p <= b]
        if around:
            best = min(around, key=lambda x: x[:3])
            out[key, p] = (best[1][1], best[2], best[3])
    return out


@pytest.mark.parametrize("window", [3, 1000])
def test_innermost_of_crossing_intervals(spark, window):
    rng = random.Random(window)
    points = [(rng.choice("ab"), rng.randint(-5, 60)) for _ in range(300)] + [(None, 3), ("c", 1), ("a", None)]
    intervals = [(rng.choice("abd"), a := rng.randint(-9, 60), a + rng.randint(-2, 25), rng.choice(["x", "y", None]), 1) for _ in range(80)] + [("a", None, 5, "n", 1), ("a", 1, None, "n", 1), (None, 0, 9, "n", 1)]
    found = folds.innermost(spark.createDataFrame(points, "key string, p long"), spark.createDataFrame(intervals, INTERVALS), "key", "p", ["name"], window).collect()
    assert {(r.key, r.p): (r.name, r["first"], r["last"]) for r in found} == nearest([(k, p) for k, p in points if k and p is not None], intervals)
    assert len(found) == len({(r.key, r.p) for r in found})
    assert found[0].asDict().keys() == {"key", "p", "name", "first", "last"}


def test_deeply_nested_intervals_take_linear_time(spark):
    n = 100_000
    intervals = spark.range(n).selectExpr("'f' AS key", f"id AS first", f"{2 * n} - id AS last", "concat('i', id) AS name", "1 AS n")
    points = spark.range(2 * n + 1).selectExpr("'f' AS key", "id AS p")
    began = time.time()
    found = {r.p: r["first"] for r in folds.innermost(points, intervals, "key", "p", ["name"]).select("p", "first").collect()}
    assert time.time() - began < 60
    assert all(found[p] == min(p, 2 * n - p, n - 1) for p in range(2 * n + 1))
