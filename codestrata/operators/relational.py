"""Operators over edges, trees, intervals and ordered units, as compositions of DataFrame operations."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import est_tokens, lines_of, prefixes
from codestrata.operators.folds import chunk_units
from codestrata.session import cut


def directory_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """``dir``, ``depth`` and ``n_files`` of every path prefix."""
    each = paths.select(F.explode(prefixes(F.col(path))).alias("dir"))
    return each.groupBy("dir").agg(F.count("*").alias("n_files")).withColumn("depth", (F.size(F.split("dir", "/")) - 1).cast("long"))


def line_inventory(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each line: key, ``line_no`` from 1, ``line``."""
    return texts.select(key, F.posexplode(lines_of(F.col(text))).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def weigh_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """Distinct edges with how often each occurs."""
    return edges.groupBy(*(keys or ("src", "dst", "kind"))).agg(F.count("*").alias("n"))


def unresolved(references: DataFrame, known: DataFrame, reference: str, name: str) -> DataFrame:
    """References that no known name answers to."""
    return references.join(known.select(F.col(name).alias("__known")), F.col(reference) == F.col("__known"), "left_anti")


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``out_degree`` and ``in_degree``; both sides are counted before they meet."""
    out = edges.groupBy(F.col(src).alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def closure(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``node`` and least ``depth`` of what is reachable from ``starts`` (column ``node``) in at most ``max_depth`` steps, or any.

    A frontier loop: each round joins the newest nodes only, so that dense graphs cost no more than their edges.
    """
    seen = cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def ancestry(parents: DataFrame) -> DataFrame:
    """Where the way up from each ``id`` (with its ``parent``) ends: ``id``, ``top``, ``depth`` and ``cycle``.

    ``top`` is the first node above that has no row of its own, ``depth`` the steps to it. On or below a cycle both are null, and ``cycle``
    is the least node of it. An id with several parents has a row for each of its ends. Pointers double: each round takes every
    one from where it leads to where that leads, so that a chain of n nodes needs log2 n rounds; pointers that have come to an end are neither moved nor
    written again. Where each id has one parent, rounds end soon after the longest way that has an end, however many nodes are on or below a cycle.
    """
    pairs = parents.select("id", "parent").where("id IS NOT NULL AND parent IS NOT NULL").distinct()
    ids = pairs.select(F.col("id").alias("parent")).distinct().withColumn("_on", F.lit(True))
    on, kind = F.col("_on").isNotNull(), pairs.schema["id"].dataType
    first = cut(pairs.join(ids, "parent", "left").select("id", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("depth"), F.when(on, F.col("id")).alias("least"), (~on).alias("done")))
    nodes, steps = first.select("id").distinct().count(), 1
    single, enough = first.count() == nodes, nodes
    done, left = first.where("done"), first.where("NOT done")
    while steps < enough and not left.isEmpty():
        there = done.unionByName(left).select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("depth").alias("_depth"), F.col("least").alias("_least"), F.col("done").alias("_done"))
        least = F.when(~F.col("_done"), F.least("least", "_least")).alias("least")
        # Many pointers can meet in one node: they stream past a table of nodes, which are spread evenly, instead of being sorted in one task.
        moved = left.join(there.hint("shuffle_hash") if single else there, "ptr").select("id", F.col("_ptr").alias("ptr"), (F.col("depth") + F.col("_depth")).alias("depth"), least, F.col("_done").alias("done"))
        moved = cut(moved if single else moved.distinct())
        if single and moved.where("done").isEmpty():
            # No way ends after steps + 1 to 2 * steps, so that none is longer. What is left leads into cycles, and the nodes of these and of the ways
            # to them that are farther than so many steps are all pointed at: with as many steps more, each pointer stands on its cycle and has been around it.
            enough = min(enough, steps + left.select("ptr").distinct().count())
        done, left, steps = done.unionByName(moved.where("done")), moved.where("NOT done"), 2 * steps
    ended = done.select("id", F.col("ptr").alias("top"), "depth", F.lit(None).cast(kind).alias("cycle"))
    # A pointer that has gone so many steps stands on its cycle, and has seen all of it from there on.
    around = left.select(F.col("id").alias("ptr"), F.col("least").alias("cycle")).join(left.select("ptr").distinct(), "ptr", "left_semi").groupBy("ptr").agg(F.min("cycle").alias("cycle"))
    caught = left.join(around, "ptr").select("id", F.lit(None).cast(kind).alias("top"), F.lit(None).cast("long").alias("depth"), "cycle")
    return ended.unionByName(caught if single else caught.distinct())


def resolve(candidates: DataFrame, reference: list[str], rank: str, target: str) -> DataFrame:
    """The target of lowest rank (then least name) for each reference."""
    return candidates.groupBy(*reference).agg(F.min(F.struct(rank, target)).alias("best")).select(*reference, "best.*")


def roll_up(rows: DataFrame, tiers: list[str], *measures: Column) -> DataFrame:
    """Totals at each tier of a hierarchy and over all; ``grouping`` tells which tiers are summed over."""
    return rows.rollup(*tiers).agg(*measures, F.grouping_id().alias("grouping"))


def bottom_up(rows: DataFrame, tiers: list[str], measure: str) -> DataFrame:
    """``tier``, ``node`` and ``total``, each tier added up from the tier below instead of from the rows."""
    levels, below = [], rows
    for depth in range(len(tiers), 0, -1):
        below = below.groupBy(*tiers[:depth]).agg(F.sum(measure).alias(measure))
        levels.append(below.select(F.lit(depth).alias("tier"), F.col(tiers[depth - 1]).cast("string").alias("node"), F.col(measure).alias("total")))
    return reduce(DataFrame.unionByName, levels)


def pack_units(units: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """The chunks of ``folds.chunk_units``: key, ``chunk``, ``n_units`` and ``tokens``."""
    sizes = units.select(key, order, F.coalesce(est_tokens(F.col(text)), F.lit(0)).alias("_size"))
    return chunk_units(sizes, key, order, F.col("_size"), budget).groupBy(key, "chunk").agg(F.count("*").alias("n_units"), F.sum("_size").alias("tokens"))


def retrieve(texts: DataFrame, key: str, text: str, terms: list[str], k: int) -> DataFrame:
    """The ``k`` texts with the most distinct query terms (lower-case words), ties to smaller keys.

    A pattern is tested for each term, so that a text is never split into its words.
    """
    lowered = F.lower(text)
    found = [lowered.rlike(f"(?<![a-z]){t}(?![a-z])").cast("long") for t in dict.fromkeys(terms) if t.isascii() and t.isalpha() and t.islower()]
    score = F.coalesce(reduce(Column.__add__, found, F.lit(0).cast("long")), F.lit(0).cast("long"))
    return texts.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def search_index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``term`` and in how many texts it occurs."""
    terms = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{3,})"), 1))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n_texts"))


def neighbours(rows: DataFrame, parent: str, order: list[str], name: str) -> DataFrame:
    """Rows with the ``previous`` and ``next`` sibling under the same parent."""
    w = Window.partitionBy(parent).orderBy(*order)
    return rows.withColumns({"previous": F.lag(name).over(w), "next": F.lead(name).over(w)})


def outline(rows: DataFrame, parent: str, child: str) -> DataFrame:
    """A parent and its children, in order, as an indented outline."""
    lines = F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat(F.lit("  - "), c))
    return rows.groupBy(parent).agg(F.concat(F.lit("+ "), F.col(parent), F.lit("\n"), F.array_join(lines, "\n")).alias("outline"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
