"""Connected components of pairs, by alternating stars: every node ends with the least node that it reaches.

Rounds grow with the logarithm of the longest path; each is a checkpoint. Results for odd input: pairs with a null end are
left out, as are pairs of a node with itself (a node with no other pair is not returned); repeated pairs count once; no
pairs give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _towards_least(pairs: DataFrame, smaller_only: bool) -> DataFrame:
    """Each node's neighbours linked to the least of them, as pairs (a, b) with a > b.

    The least is aggregated before the join back, so that a node with many neighbours is never gathered.
    """
    if smaller_only:
        near = pairs  # (a, b), a > b: the smaller neighbours of a
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        out = near.join(least, "a").select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = near.join(least, "a").where("b > a").select(F.col("b").alias("x"), "m")
    return out.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``component`` of every node in ``pairs`` (columns ``a`` and ``b``, of one type)."""
    clean = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut(clean), None
    while True:
        after = cut(_towards_least(_towards_least(now, False), True))
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before or state[0] == 0:
            break
        now, before = after, state
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
