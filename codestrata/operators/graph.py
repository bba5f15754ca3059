"""The knowledge graph: built from symbols and edges, written as one document, queried and validated."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import relational as R
from codestrata.operators import search
from codestrata.session import cut

VERSION = "1"


def nodes_of(placed: DataFrame, tiers: DataFrame, summarised: DataFrame) -> DataFrame:
    """Tier nodes and fields as graph nodes; ``summarised`` has ``tier``, ``node_id`` and ``summary``."""
    where = placed.select(F.col("symbolId").alias("node_id"), F.col("kind").alias("symbol_kind"), F.col("filePath").alias("path"), "range.startLine", "range.endLine")
    names = F.array(*map(F.lit, ("REPOSITORY", "MODULE", "CONTAINER", "COMPONENT")))
    top = tiers.join(summarised.select("tier", "node_id", "summary"), ["tier", "node_id"], "left").join(where, "node_id", "left")
    high = top.select(F.col("node_id").alias("id"), F.coalesce("symbol_kind", F.get(names, F.col("tier") - 1)).alias("kind"), "name", "tier", F.col("parent_id").alias("parent"), "path", "startLine", "endLine", "summary")
    fields = placed.where(F.col("kind").isin("FIELD", "PROPERTY")).select(F.col("symbolId").alias("id"), "kind", "name", F.lit(6).alias("tier"), F.col("parentSymbolId").alias("parent"), F.col("filePath").alias("path"), "range.startLine", "range.endLine", F.lit(None).cast("string").alias("summary"))
    return high.unionByName(fields)


def write_graph(nodes: DataFrame, edges: DataFrame, repository: str, path: str) -> None:
    """One sorted JSON document, streamed row by row and put in place at the end."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(".part")
    with part.open("w") as out:
        out.write('{"schemaVersion": ' + json.dumps(VERSION) + ', "repository": ' + json.dumps(repository))
        for name, rows, keys in (("nodes", nodes, ("tier", "id")), ("edges", edges, ("src", "dst", "kind", "resolved"))):
            out.write(f', "{name}": [')
            line = rows.orderBy(*keys).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("x"))
            for i, row in enumerate(line.toLocalIterator()):
                out.write(("," if i else "") + "\n" + row["x"])
            out.write("\n]")
        out.write("}\n")
    os.replace(part, target)


def relations(edges: DataFrame, node: str, kind: str | None = None, direction: str = "out") -> DataFrame:
    """A node's edges: ``out``, ``in`` or ``both`` ways, of one kind or all."""
    ways = {"out": F.col("src") == node, "in": F.col("dst") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}
    found = edges.where(ways[direction])
    return found.where(F.col("kind") == kind) if kind else found


def dependencies(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """What a node depends on, and where that is defined."""
    return relations(edges, node).join(nodes.select(F.col("id").alias("dst"), "name", "path", "startLine", "endLine"), "dst", "left").orderBy("kind", "dst")


def dependents(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """What depends on a node: callers, subtypes, users."""
    found = relations(edges, node, direction="in").where("kind <> 'CONTAINS'")
    return found.join(nodes.select(F.col("id").alias("src"), "name", "path", "startLine", "endLine"), "src", "left").orderBy("kind", "src")


def reachable(edges: DataFrame, node: str, max_depth: int, kinds: tuple[str, ...] = ("EXTENDS", "IMPLEMENTS", "COMPOSES", "DEPENDS_ON", "CALLS")) -> DataFrame:
    """``node`` and least ``depth`` of everything that a node leads to in at most ``max_depth`` steps."""
    starts = edges.sparkSession.createDataFrame([(node,)], "node string")
    return R.closure(edges.where(F.col("kind").isin(*kinds)).select("src", "dst").distinct(), starts, max_depth)


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``problem`` and ``id`` of repeated ids, dangling ends of resolved edges, missing parents, cycles of parents (by their least node), and nodes no root is above."""
    nodes = cut(nodes.select("id", "parent"))
    known = nodes.select("id").distinct()
    repeated = R.duplicates(nodes, "id").select(F.lit("repeated id").alias("problem"), "id")
    ends = edges.where("resolved AND kind <> 'IMPORTS'").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    dangling = ends.join(known, "id", "left_anti").select(F.lit("dangling edge").alias("problem"), "id")
    missing = nodes.where("parent IS NOT NULL").join(known.withColumnRenamed("id", "parent"), "parent", "left_anti").select(F.lit("missing parent").alias("problem"), "id")
    above = cut(R.ancestry(nodes))
    cycles = above.where("cycle IS NOT NULL").select(F.lit("cycle").alias("problem"), F.col("cycle").alias("id")).distinct()
    roots = nodes.where("parent IS NULL").select("id").distinct()
    rooted = above.join(roots.withColumnRenamed("id", "top"), "top", "left_semi").select("id").unionByName(roots).distinct()
    adrift = known.join(rooted, "id", "left_anti").join(missing, "id", "left_anti").select(F.lit("no root above").alias("problem"), "id")
    return repeated.unionByName(dangling).unionByName(missing).unionByName(cycles).unionByName(adrift)


def _words(nodes: DataFrame):
    return F.split(F.lower(F.concat_ws(" ", "name", "summary")), r"[^a-z0-9]+")


def node_index(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbers (by tier, then id) of the nodes of the top four tiers, and the blocks of their words."""
    top = nodes.where("tier <= 4").withColumn("key", F.concat_ws("|", "tier", "id")).dropDuplicates(["key"])
    numbers = cut(search.numbered(top, "key"))
    return numbers, search.blocks(search.postings(top.join(numbers, "key"), F.filter(_words(top), lambda w: w != "")))


def retrieve(nodes: DataFrame, terms: list[str], k: int = 5, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Overview first: the ``k`` best nodes of the top four tiers, then what lies directly under them.

    With an ``index`` (of ``node_index``) only the blocks that can reach the k-th score are read for the first step; without one, all nodes are.
    """
    score = F.size(F.array_intersect(_words(nodes), F.array(*(F.lit(t.lower()) for t in terms)))).cast("long")
    if index is None:
        top = nodes.where("tier <= 4").withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "tier", "id").limit(k)
    else:
        best = nodes.sparkSession.createDataFrame(search.top_k(index[1], terms, k).best, "number long, score long")
        keys = index[0].join(F.broadcast(best), "number").select("key", "score")
        top = nodes.where("tier <= 4").withColumn("key", F.concat_ws("|", "tier", "id")).join(F.broadcast(keys), "key").select(*nodes.columns, "score")
    inner = nodes.join(top.select(F.col("id").alias("parent")), "parent", "left_semi").withColumn("score", score)
    return top.unionByName(inner.select(*top.columns)).dropDuplicates(["id"])
