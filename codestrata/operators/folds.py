"""Operators that read sorted rows once and carry a small state: packing under a budget, and the innermost interval around a point."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codestrata.session import cut

#: Positions of a window, which is what one task sweeps of a key at a time.
WINDOW = 1 << 16
#: Units of a key that one task packs.
HOT = 4_000_000


# ---- Packing --------------------------------------------------------------------------------------------------------------


def _jumps(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Running totals, and for each unit where the chunk after it would begin if one began with it."""
    total = np.append(0, np.cumsum(sizes))
    return total, np.maximum(np.arange(1, len(sizes) + 1), np.searchsorted(total[1:], total[:-1] + budget, "right"))


def _clamped(tokens, budget: int):
    """More than the budget is all the same: the next unit begins a chunk."""
    return np.minimum(tokens, budget + 1)


def transfer(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of tokens (0 to ``budget + 1``) of a chunk that is open before the units: how many chunks begin
    with one of them, and the tokens of the open chunk after them.

    The first unit that does not fit begins a chunk; from there jumps lead to the end. Ways that meet go on together.
    """
    total, jump = _jumps(sizes, budget)
    n = len(sizes)
    begins = np.searchsorted(total[1:], budget - np.arange(budget + 2), "right")
    ends: dict[int, tuple[int, int]] = {n: (0, -1)}
    for start in np.unique(begins).tolist():
        way = []
        while start not in ends:
            way.append(start)
            start = int(jump[start])
        count, last = ends[start]
        for unit in reversed(way):
            count, last = count + 1, unit if last < 0 else last
            ends[unit] = count, last
    opened = np.array([ends[b][0] for b in begins.tolist()], np.int64)
    last = np.array([ends[b][1] for b in begins.tolist()], np.int64)
    after = np.where(last < 0, np.arange(budget + 2) + total[n], total[n] - total[last])
    return opened, _clamped(after, budget)


def chunks_from(sizes: np.ndarray, tokens: int, budget: int) -> tuple[np.ndarray, int]:
    """The chunk of each unit (0 is the one that is open before them, with so many tokens), and the tokens of the last one."""
    total, jump = _jumps(sizes, budget)
    at, n = int(np.searchsorted(total[1:], budget - tokens, "right")), len(sizes)
    begins = []
    while at < n:
        begins.append(at)
        at = int(jump[at])
    chunk = np.zeros(n, np.int64)
    chunk[begins] = 1
    return np.cumsum(chunk), int(_clamped(total[n] - total[begins[-1]] if begins else tokens + total[n], budget))


def _runs(keys: pa.Array) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    values = np.array(keys.to_pylist(), object)
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)) if len(values) else np.zeros(1, int)


def chunk_units(units: DataFrame, key: str, order: str, size: Column, budget: int, most: int = HOT) -> DataFrame:
    """``units`` with the ``chunk`` of each, from 0 for every key, by greedy packing in order under a budget of tokens (``size``, null being none).

    A unit that does not fit begins the next chunk; one over the budget is a chunk of its own. Columns pass through unchanged. The units of a
    key are packed as a stream by one task, which holds no more than a batch; a key of more than ``most`` units is dealt to many tasks, see ``_ranged``.
    """
    sized = units.withColumn("_n", F.coalesce(size, F.lit(0)).cast("long"))
    hot = cut(units.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_many")).where(F.col("_many") > most).select("_hot"))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    if hot.isEmpty():
        return _streamed(sized, units, key, order, budget)
    hot = F.broadcast(hot)  # fewer than all units by ``most``
    rest = _streamed(sized.join(hot, same, "left_anti"), units, key, order, budget)
    return rest.unionByName(_ranged(sized.join(hot, same, "left_semi"), units, key, order, budget))


def _dealer(units: DataFrame, budget: int, entries: dict[int, tuple[int, int]] | None):
    """Packs sorted units as a stream: columns of ``units``, then size, key's hash, and, where parts begin inside keys, the part."""
    inner, names = len(units.columns), units.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            sizes, keys, found = batch.column(inner).to_numpy(), batch.column(inner + 1), np.empty(batch.num_rows, np.int64)
            runs = _runs(keys)
            for a, b in zip(runs, runs[1:], strict=False):
                here = keys[int(a)].as_py()
                if state is None and entries:
                    state = (here, *entries[batch.column(inner + 2)[0].as_py()])
                elif state is None or here != state[0]:
                    state = (here, -1, budget + 1)
                chunks, tokens = chunks_from(sizes[a:b], state[2], budget)
                found[a:b] = state[1] + chunks
                state = (here, int(found[b - 1]), tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns[:inner], pa.array(found)], names=[*names, "chunk"])

    return deal, StructType([*units.schema.fields, StructField("chunk", LongType())])


def _named(sized: DataFrame, key: str) -> DataFrame:
    return sized.withColumn("_key", F.md5(F.to_json(F.struct(key))))


def _streamed(sized: DataFrame, units: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    ordered = sized.repartition(key).sortWithinPartitions(key, order)
    return _named(ordered, key).mapInArrow(*_dealer(units, budget, None))


def _ranged(sized: DataFrame, units: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """Units in ranges of key and order, so that a key of any size is dealt to many tasks.

    Each task first tells what its units make of a chunk that is open before them, for every number of tokens in it, a table of a few steps; these are
    followed from task to task, and then each one packs its units as a stream from where the one before it ends.
    """
    ordered = cut(_named(sized, key).repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("_part", F.spark_partition_id()))
    told = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("least", pa.list_(pa.int64())), ("opened", pa.list_(pa.int64())), ("after", pa.list_(pa.int64())), ("tail", pa.int64()), ("tail_tokens", pa.int64())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        opened, after = np.zeros(budget + 2, np.int64), np.arange(budget + 2)
        tail, tokens = 0, 0
        for batch in batches:
            sizes, keys = batch.column(0).to_numpy(), batch.column(1)
            runs = _runs(keys)
            for a, b in zip(runs, runs[1:], strict=False):
                here = keys[int(a)].as_py()
                part, first = batch.column(2)[0].as_py(), here if first is None else first
                if here == first:
                    more, then = transfer(sizes[a:b], budget)
                    opened, after = opened + more[after], then[after]
                else:
                    found, tokens = chunks_from(sizes[a:b], tokens if here == last else budget + 1, budget)
                    tail = (tail if here == last else -1) + int(found[-1])
                last = here
        if first is not None:
            new = np.flatnonzero(np.append(True, (opened[1:] != opened[:-1]) | (after[1:] != after[:-1])))
            # Entries that differ by their own tokens alone, as no chunk begins, are told by the first: see ``follow``.
            plain = opened == 0
            new = new[~plain[new] | (new == 0)] if plain.any() else new
            yield pa.RecordBatch.from_pydict({"part": [part], "first": [first], "last": [last], "least": [new], "opened": [opened[new]], "after": [after[new]], "tail": [tail], "tail_tokens": [tokens]}, schema=told)

    def follow(row, tokens: int) -> tuple[int, int]:
        at = int(np.searchsorted(row["least"], tokens, "right")) - 1
        opened, after = row["opened"][at], row["after"][at]
        return opened, int(_clamped(after + tokens - row["least"][at], budget)) if opened == 0 else after

    rows = ordered.select("_n", "_key", "_part").mapInArrow(tell, "part int, first string, last string, least array<long>, opened array<long>, after array<long>, tail long, tail_tokens long").orderBy("part").collect()
    entries: dict[int, tuple[int, int]] = {}
    key_, chunk, tokens = None, -1, budget + 1
    for row in rows:  # a few numbers for each task
        entry = (chunk, tokens) if row["first"] == key_ else (-1, budget + 1)
        entries[row["part"]] = entry
        if row["first"] == row["last"]:
            opened, tokens = follow(row, entry[1])
            chunk = entry[0] + opened
        else:
            chunk, tokens = row["tail"], row["tail_tokens"]
        key_ = row["last"]

    return ordered.mapInArrow(*_dealer(units, budget, entries))


# ---- Intervals ------------------------------------------------------------------------------------------------------------


def innermost(points: DataFrame, intervals: DataFrame, key: str, point: str, carried: list[str], window: int = WINDOW) -> DataFrame:
    """For each point the shortest interval (``first`` to ``last``) of the same key around it, ties by what is carried, then by the first.

    A sweep over sorted beginnings and points: open intervals lie in a heap by length, and those that have ended go when they come to its
    top, so that each row costs a logarithm. Keys are cut into windows of positions, so that a key of any size is swept by many
    tasks; an interval is sent to each window that it reaches into, and a task holds the open ones of a window. Points outside all intervals are left out, equal
    points come once, and intervals that end before they begin, or have a null, hold none.
    """
    at = F.col(point).cast("long")
    spans = F.explode(F.sequence(F.floor(F.col("first") / window), F.floor(F.col("last") / window)))
    proper = intervals.where((F.col("first") <= F.col("last")) & F.col(key).isNotNull())
    begun = proper.select(key, spans.alias("_window"), *carried, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    begun = begun.withColumns({"_at": F.greatest("first", F.col("_window") * window), "_kind": F.lit(0)})
    nothing = {c: F.lit(None).cast(begun.schema[c].dataType) for c in (*carried, "first", "last")}
    asked = points.select(key, at.alias("_at")).where(F.col(key).isNotNull() & F.col("_at").isNotNull()).withColumns({"_window": F.floor(F.col("_at") / window), "_kind": F.lit(1), **nothing})
    both = begun.unionByName(asked).repartition(key, "_window").sortWithinPartitions(key, "_window", "_at", "_kind")
    schema = StructType([intervals.schema[key], StructField(point, LongType()), *(begun.schema[c] for c in (*carried, "first", "last"))])
    arrow_names = [key, point, *carried, "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heap, number, told = None, [], 0, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows, where = [], []
            for i, (k, w, a, kind, first, last, *rest) in enumerate(zip(*columns, strict=True)):
                if (k, w) != group:
                    group, heap, told = (k, w), [], None
                if kind == 0:
                    number += 1
                    heapq.heappush(heap, (last - first, tuple((x is not None, x) for x in rest), first, number, last, rest))
                elif a != told:
                    told = a
                    while heap and heap[0][4] < a:
                        heapq.heappop(heap)
                    if heap:
                        rows.append((k, a, *heap[0][5], heap[0][2], heap[0][4]))
                        where.append(i)
            if rows:
                kinds = [batch.column(0).type, pa.int64(), *(batch.column(6 + i).type for i in range(len(carried))), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=arrow_names)

    return both.select(key, "_window", "_at", "_kind", "first", "last", *carried).mapInArrow(run, schema)
