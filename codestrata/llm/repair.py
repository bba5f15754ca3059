"""Repair of conversations by their cheapest edits, found once for each shared suffix of role and fault signatures.

Each row of a conversation becomes one letter: the role's initial and the fault of the row, as far as edits depend on them. A
conversation's signature is the word of its letters, and distinct signatures, few beside the conversations, form an automaton
from their ends: signatures with a common suffix share its nodes. They are sorted by their reversed text, so that each
node is met once, and lies on a stack while the signatures above it pass. For each state of the grammar ``(s?(ua)+)?`` of roles
a node knows the least cost to go, and which edit comes first on the cheapest way, ties to the least letter. As every edit leads
from a state to one other state, the best audit of a node is that letter before the best audit of the next one, and is read off along the stack.
Nodes with the same differences of costs behave alike, so that a step is worked out once for each such class and letter.

Damage, faults and signatures are found by windows over narrow rows (ids, hashes, one letter each, no texts); a conversation
is read as a stream, and a task holds one byte for each of its rows. Texts are shuffled once, to hash the repaired rows.

Results for odd input: a null ``conv_id`` is one conversation of its own; a null role or text is one space, and so is a null in the
key of the damage; a null turn comes first, rows of one turn are ordered by role, the first 32 characters of the text and
its MD5 digest; repeated rows are duplicates; an empty role has no initial, can't be kept, and makes its neighbours illegal; extra
columns, whatever their names, are left out; an empty table gives no rows. Texts of any length are cut and compared by
Spark's functions, one row at a time.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, cut

#: What a row costs to edit (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: White space (fixed values).
SPACE = " \t\n\x0b\x0c\r"

# ---- Damage and faults ----------------------------------------------------------------------------------------------------


def in_full(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` without nulls in the last two."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def damage(turns: DataFrame) -> DataFrame:
    """The rows of ``in_full`` after the damage that each one's conversation and turn stand for; ``gone`` marks dropped rows."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    damaged = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    twice = F.explode(F.array_repeat(F.lit(0), F.col("times")))
    return damaged.select("conv_id", "turn", "role", "text", "gone", twice.alias("copy")).drop("copy")


#: In which order a conversation's rows come.
ORDER = ("turn", "role", "head", "digest")


def ordered_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``ORDER``; Spark sorts nulls first."""
    return rows.withColumns({"head": F.substring("text", 1, 32), "digest": F.md5("text")})


def faults(rows: DataFrame) -> DataFrame:
    """A narrow row for each of ``damage``: its keys, and its first fault (blank, duplicate, truncated or none)."""
    told = F.rtrim(F.col("text"), F.lit(SPACE))
    own = F.when(told == "", "blank").when(~F.substring(told, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none")
    narrow = ordered_keys(rows).select("conv_id", *ORDER, "gone", own.alias("own"), F.substring("role", 1, 1).alias("initial"))
    spread = narrow.repartition("conv_id")
    # Rows of one role and text differ in their turns only; those that are dropped come last and stand for nothing.
    before = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("turn")
    fault = F.when(F.col("own") == "blank", "blank").when(F.row_number().over(before) > 1, "duplicate").otherwise(F.col("own"))
    return spread.withColumn("fault", fault).drop("own")


#: The letter of a row by initial and fault: one that has to go, or one of four kinds of roles, whole or truncated.
MUST_GO = "x"


def letter(initial: Column, fault: Column) -> Column:
    whole = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", F.upper(whole)).otherwise(whole)


SIGNED = pa.schema([("conv_id", pa.int64()), ("signature", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))])
SIGNED_DDL = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def signatures(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``faults``: its signature, gaps between turns, faults, and illegal pairs of roles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv = False, None
        letters, counts, last = bytearray(), {}, ""
        low = high = turns = previous = None

        def done() -> list:
            gaps = high - low + 1 - turns if turns else 0
            return [conv, letters.decode(), gaps, *(counts.get(c, 0) for c in ("blank", "duplicate", "truncated", "illegal"))]

        for batch in batches:
            out = []
            for key, turn, gone, initial, fault, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or key != conv:
                    if begun:
                        out.append(done())
                    begun, conv = True, key
                    letters, counts, last = bytearray(), {}, None
                    low = high = previous = None
                    turns = 0
                if gone:
                    continue
                if turn is not None:
                    low = turn if low is None else low
                    turns += turn != previous
                    high = previous = turn
                if last is not None and last + initial not in ("su", "ua", "au"):
                    counts["illegal"] = counts.get("illegal", 0) + 1
                last = initial
                counts[fault] = counts.get(fault, 0) + 1
                letters += symbol.encode()
            if out:
                yield batch_of(SIGNED, [*zip(*out, strict=True)])
        if begun:
            yield batch_of(SIGNED, [[x] for x in done()])

    narrow = rows.sortWithinPartitions("conv_id", *ORDER).select("conv_id", "turn", "gone", "initial", "fault", letter(F.col("initial"), F.col("fault")).alias("letter"))
    return narrow.mapInArrow(run, SIGNED_DDL)


# ---- The automaton --------------------------------------------------------------------------------------------------------

#: States of the grammar: nothing yet, after s, after u, after a; what may end, and where an inserted or changed role leads.
START, S, U, A = range(4)
ENDS = (START, A)
NEXT = {START: U, S: U, U: A, A: U}
KEPT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
NEVER = 1 << 60

#: For each state: least cost, the letters of the edits up to the row's own (or the end), and the state after it.
Node = tuple[tuple[int, str, int], ...]


def _inserted(best: list[tuple[int, str, int]]) -> Node:
    """The best of each state if rows may be inserted first."""
    for _ in range(3):  # the longest way of insertions that meets no state twice
        best = [min(best[q], (INSERT + best[NEXT[q]][0], "I" + best[NEXT[q]][1], best[NEXT[q]][2])) for q in range(4)]
    return tuple(best)


END = _inserted([(0 if q in ENDS else NEVER, "", q) for q in range(4)])


def _row(costs: tuple[int, ...], symbol: str) -> Node:
    """The node before a row with this letter, where ``costs`` are to go after it."""
    late, role = symbol.isupper() * TRUNCATED, symbol.lower()
    out = []
    for q in range(4):
        ways = [(DELETE + costs[q], "D", q)]
        if symbol != MUST_GO:
            ways.append((REROLE + late + costs[NEXT[q]], "R", NEXT[q]))
            if (to := KEPT.get((q, role))) is not None:
                ways.append((late + costs[to], "K", to))
        out.append(min(ways))
    return _inserted(out)


class Automaton:
    """The nodes of the current signature, from its end, on a stack.

    What a node does depends on the differences of its costs alone, of which there are few, so that nodes are numbers of
    classes; the costs themselves are the class's and an offset.
    """

    def __init__(self):
        self.numbers: dict[tuple[int, ...], int] = {}
        self.costs: list[tuple[int, ...]] = []
        self.steps: dict[tuple[int, str], tuple[int, int, Node]] = {}
        base, number = self._class(tuple(c for c, _, _ in END))
        self.reversed = ""
        self.stack: list[tuple[int, int, Node]] = [(number, base, END)]  # class, offset, ways
        self.made = 0

    def _class(self, costs: tuple[int, ...]) -> tuple[int, int]:
        base = min(costs)
        key = tuple(c - base for c in costs)
        if key not in self.numbers:
            self.numbers[key] = len(self.costs)
            self.costs.append(key)
        return base, self.numbers[key]

    def _step(self, after: int, symbol: str) -> tuple[int, int, Node]:
        found = self.steps.get((after, symbol))
        if not found:
            node = _row(self.costs[after], symbol)
            base, number = self._class(tuple(c for c, _, _ in node))
            found = self.steps[after, symbol] = number, base, node
        return found

    def audit(self, signature: str) -> tuple[int, str]:
        """Cost and letters of the cheapest edits; fastest if signatures come sorted by their reversed text."""
        text = signature[::-1]
        shared = len(os.path.commonprefix((text, self.reversed)))
        del self.stack[shared + 1 :]
        for symbol in text[shared:]:
            number, base, node = self._step(self.stack[-1][0], symbol)
            self.stack.append((number, self.stack[-1][1] + base, node))
            self.made += 1
        self.reversed = text
        number, offset, _ = self.stack[-1]
        state, letters = START, []
        for _, _, node in reversed(self.stack):
            _, way, state = node[state]
            letters.append(way)
        return offset + self.costs[number][START], "".join(letters)


def audits(signed: DataFrame) -> DataFrame:
    """``signature``, ``cost`` and ``audit`` of each distinct signature, the nodes of shared suffixes being worked out once.

    Signatures are dealt in ranges of their last 64 letters read from the end, so that those which share more stay together.
    """
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            found = [automaton.audit(s) for s in batch.column(0).to_pylist()]
            yield batch_of(schema, [batch.column(0), [c for c, _ in found], [a for _, a in found]])

    distinct = cut(signed.select("signature").distinct())
    ranged = distinct.repartitionByRange(F.substring(F.reverse("signature"), 1, 64)).sortWithinPartitions(F.reverse("signature"))
    return ranged.mapInArrow(run, "signature string, cost long, audit string")


# ---- Repaired rows --------------------------------------------------------------------------------------------------------

NAMES = {U: "user", A: "assistant"}


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that the edits leave."""
    state = START
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield NAMES[state], ""
            continue
        role, text = next(rows)
        if edit == "R":
            state = NEXT[state]
            yield NAMES[state], text
        elif edit == "K":
            state = KEPT[state, role[0]]
            yield role, text


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPAIRED = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def digest_repaired(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of ``told`` (``conv_id``, ``COUNTS``, ``audit``) with the digest of the repaired rows of their conversations.

    A row of ``told`` comes before its conversation's rows in one sorted stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row, out = next(stream, None), []
        while row:
            head, row = row, next(stream, None)

            def own() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row and row[0] == head[0] and row[7] is None:  # noqa: B023
                    turn, row = row[8:], next(stream, None)
                    yield turn

            digest, turns, joint = hashlib.sha256(), own(), ""
            for role, text in repaired(turns, head[7]):
                digest.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
            if next(turns, None) is not None:
                raise RuntimeError(f"conversation {head[0]} has more rows than edits")
            out.append((*head[:8], digest.hexdigest()))
            if len(out) == 4096:
                yield batch_of(REPAIRED, [*zip(*out, strict=True)])
                out = []
        if out:
            yield batch_of(REPAIRED, [*zip(*out, strict=True)])

    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    heads = told.select("conv_id", *COUNTS, "audit", *none("long", "turn"), *none("string", "role", "text", "head", "digest"), F.lit(0).alias("kind"))
    body = ordered_keys(rows.where("NOT gone")).select("conv_id", *none("long", *COUNTS), *none("string", "audit"), "turn", "role", "text", "head", "digest", F.lit(1).alias("kind"))
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    ddl = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return both.select("conv_id", *COUNTS, "audit", "role", "text").mapInArrow(run, ddl)


def repair(turns: DataFrame) -> DataFrame:
    """Damages and repairs all conversations: counts of faults, the cost and letters of the cheapest edits, and a digest of what they leave."""
    rows = damage(in_full(turns))
    signed = cut(signatures(faults(rows)))
    return digest_repaired(rows, signed.join(audits(signed), "signature"))
