"""Known names in texts: the longest at each place, from left to right.

Texts and names are cut into identifiers and single other characters. A name of any form (``a.b.Type``, ``Outer.Inner``, ``Type.method(int)``, ``Type``)
matches where its tokens stand one after another; a match may not be part of a longer dotted name. Up to ``MOST_NAMES`` names become a trie of tokens
that goes to all tasks; more are joined with the texts' spans, dealt by whole names and never by a first token, which may be that of all names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Names, and characters of them, up to which they are sent to all tasks.
MOST_NAMES, MOST_CHARACTERS = 100_000, 8 << 20
TOKEN = r"[\w$]+|[^\w$]"
_TOKEN = re.compile(TOKEN, re.ASCII)
_WORD = re.compile(r"[\w$]+", re.ASCII)

#: What begins at a token: (number of tokens, target), the longest first.
Find = Callable[[int], list[tuple[int, str]]]


class Trie:
    """Names as paths of tokens."""

    def __init__(self, names: list[tuple[str, str]]):
        self.root: dict = {}
        for name, target in names:
            node = self.root
            for token in _TOKEN.findall(name):
                node = node.setdefault(token, {})
            node[None] = target

    def from_(self, tokens: list[str], at: int) -> list[tuple[int, str]]:
        node, found = self.root, []
        for n in range(at, len(tokens)):
            node = node.get(tokens[n])
            if node is None:
                break
            if None in node:
                found.append((n + 1 - at, node[None]))
        return found[::-1]


def cut_text(tokens: list[str], find: Find) -> list[tuple[str, str | None]]:
    """A text as pieces with the target of each, null for what is no name."""
    word = lambda i: 0 <= i < len(tokens) and bool(_WORD.fullmatch(tokens[i]))
    dot = lambda i: 0 <= i < len(tokens) and tokens[i] == "."
    out, plain, at = [], [], 0
    while at < len(tokens):
        taken = 0
        if not (dot(at - 1) and word(at - 2)):
            for n, target in find(at):
                end = at + n
                if not (word(end - 1) and dot(end) and word(end + 1)):
                    if plain:
                        out.append(("".join(plain), None))
                        plain = []
                    out.append(("".join(tokens[at:end]), target))
                    taken = n
                    break
        if not taken:
            plain.append(tokens[at])
        at += taken or 1
    return [*out, ("".join(plain), None)] if plain else out


def one_target(names: DataFrame) -> DataFrame:
    """``name`` and ``target`` of the names that mean one thing only."""
    clear = names.where("name IS NOT NULL AND target IS NOT NULL AND name <> ''").groupBy("name").agg(F.min("target").alias("target"), F.max("target").alias("other"))
    return clear.where("target = other").drop("other")


def find_names(rows: DataFrame, key: str, column: str, names: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """``rows`` (one for each ``key``) with ``pieces``: the text of ``column`` as (text, target) structs, null for a null text."""
    clear = one_target(names)
    held = clear.limit(most + 1).collect()
    if len(held) <= most and sum(len(r["name"]) for r in held) <= MOST_CHARACTERS:
        return _with_pieces(rows, column, [(r["name"], r["target"]) for r in held])
    return _with_pieces(_met(rows, key, column, clear), column, None).drop("_met")


def _with_pieces(rows: DataFrame, column: str, names: list[tuple[str, str]] | None) -> DataFrame:
    """Pieces by a trie, or by what ``_met`` has found."""
    pieces = pa.list_(pa.struct([("text", pa.string()), ("target", pa.string())]))
    at = rows.columns.index(column)
    kind = ArrayType(StructType([StructField("text", StringType()), StructField("target", StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(names) if names is not None else None
        for batch in batches:
            met = batch.column(batch.num_columns - 1).to_pylist() if trie is None else [None] * batch.num_rows
            out = []
            for text, there in zip(batch.column(at).to_pylist(), met, strict=True):
                if text is None:
                    out.append(None)
                    continue
                tokens = _TOKEN.findall(text)
                if trie:
                    found = cut_text(tokens, lambda i: trie.from_(tokens, i))  # noqa: B023
                else:
                    spans: dict[int, list] = {}
                    for m in there or []:
                        spans.setdefault(m["at"], []).append((m["n"], m["target"]))
                    found = cut_text(tokens, lambda i: sorted(spans.get(i, []), reverse=True))  # noqa: B023
                out.append([{"text": t, "target": x} for t, x in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pieces)], names=[*batch.schema.names, "pieces"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("pieces", kind)]))


def _met(rows: DataFrame, key: str, column: str, names: DataFrame) -> DataFrame:
    """``rows`` with ``_met``: which names' tokens stand where, by joins on first tokens (for the lengths to look at) and on whole spans."""
    cut = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    sized = names.withColumn("t", cut(F.col("name"))).select("name", "target", F.col("t")[0].alias("first"), F.size("t").alias("n"))
    lengths = sized.select("first", "n").distinct()
    longest = sized.agg(F.max("n")).head()[0] or 0
    tokens = rows.select(key, cut(F.col(column)).alias("t"))
    each = F.transform("t", lambda x, i: F.slice("t", i + 1, F.lit(max(1, longest))))  # a place and what may belong to its name
    windows = tokens.select(key, F.posexplode(each).alias("at", "w")).withColumn("first", F.get("w", F.lit(0)))
    spans = windows.join(lengths, "first").where(F.size("w") >= F.col("n")).select(key, "at", "n", F.array_join(F.slice("w", F.lit(1), F.col("n")), "").alias("name"))
    found = spans.join(sized.select("name", "target"), "name").groupBy(key).agg(F.collect_list(F.struct("at", "n", "target")).alias("_met"))
    return rows.join(found, key, "left").select(*rows.columns, "_met")
