"""Blocks of vectors: a stated set of queries against all rows, whose query blocks stream past a bounded block of rows.

Both searches use these blocks. A row stands for each ``vec_id`` (of several vectors under one id the smallest, so that
repeated rows count once). Vectors of different dimensions are not compared. An empty table gives no rows. A block's size
is bounded in components, so that a task's memory does not follow the length of vectors. A block of rows meets the queries
in stripes of at most ``STRIPE`` query blocks, each of which may be another task, so that a task's length does not follow
the number of queries; inside a stripe the block is indexed once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width

#: Rows in a block, on average, and queries in a block; fewer where vectors are so long that a block would have more components.
DATA_BLOCK, QUERY_BLOCK, COMPONENTS = 32768, 1024, 1 << 21
#: Query blocks that one task streams past a block, on average, and partitions at most.
STRIPE, PARTITIONS = 64, 20_000

#: (ids of the queries, queries) to the best (query position, data position, score).
Ask = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: (ids of the data, data) to what asks an index of them.
Index = Callable[[np.ndarray, np.ndarray], Ask]


def usable(embeddings: DataFrame, nonzero: bool) -> DataFrame:
    """``vec_id`` and ``embedding`` of the vectors that take part: no null, no null or non-finite component, not empty."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    if nonzero:
        kept = kept.where(F.exists("embedding", lambda x: x != 0))
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def in_blocks(vectors: DataFrame, count: int, per_block: int) -> DataFrame:
    """A row for each dimension and block: the ids, and the components one vector after another."""
    n = max(1, math.ceil(count / per_block))
    keyed = vectors.withColumns({"dim": F.size("embedding"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")})
    rows = keyed.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))
    return rows.select("dim", "block", F.col("rows.vec_id").alias("ids"), F.flatten("rows.embedding").alias("values"))


def best_in_blocks(embeddings: DataFrame, every: int, k: int, nonzero: bool, index: Index, score: str) -> DataFrame:
    """The ``k`` best of each query (rows whose ``vec_id`` is divisible by ``every``): query_id, rank, vec_id, score.

    ``index`` finds the best inside a block; the best of all blocks are the best among those.
    """
    vectors = usable(embeddings, nonzero)
    count, asked, longest = vectors.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("embedding"))).head()
    rows, asking = (max(1, min(most, COMPONENTS // (longest or 1))) for most in (DATA_BLOCK, QUERY_BLOCK))
    blocks = max(1, math.ceil(count / rows))
    stripes = max(1, math.ceil(asked / asking / STRIPE))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = in_blocks(vectors, count, rows).select("dim", "block", every_of(stripes).alias("stripe"), F.lit(0).alias("part"), "ids", "values")
    queries = in_blocks(vectors.where(F.col("vec_id") % every == 0), asked, asking)
    queries = queries.select("dim", every_of(blocks).alias("block"), (F.col("block") % stripes).alias("stripe"), F.lit(1).alias("part"), "ids", "values")
    pair = ["dim", "block", "stripe"]
    both = data.unionByName(queries)
    dealt = both.repartition(*pair) if blocks * stripes <= shuffle_width(both.sparkSession) else both.repartition(min(blocks * stripes, PARTITIONS), *pair)
    kind = pa.int64() if score == "long" else pa.float64()
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ask = None, None, None
        for batch in batches:
            pairs = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            for row, (dim, block, stripe, part) in enumerate(pairs):
                ids, values = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (4, 5))
                values = values.reshape(-1, dim)
                if part == 0:  # a block comes before its queries, and is indexed once they come
                    at, held, ask = (dim, block, stripe), (ids.copy(), values.copy()), None
                elif at == (dim, block, stripe):
                    ask = ask or index(*held)
                    q, d, s = ask(ids, values)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(held[0][d]), pa.array(s, kind)], schema=schema)

    found = dealt.sortWithinPartitions(*pair, "part").mapInArrow(run, f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]
