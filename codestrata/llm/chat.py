"""Chat formatting whose output a deterministic parser reads back to the very turns it came from.

A turn is rendered as ``### Role: text </turn>`` and a line feed. The grammar has one escape, a backslash before a
literal character, and the parser refuses a mark that is not escaped inside a role or a text. A turn is first rendered
as it is, then parsed; where what comes back differs from the source (a mark, a backslash), the conflicting content is
escaped and the check repeated. A turn's rendering parses alone, so a conversation, their concatenation, does too.

Results for odd input: null roles and texts count as empty; turns of one number are ordered by role, then text; a null
turn comes first; a null ``conv_id`` is a conversation of its own. Rendering and its check run where the rows are; only
then are the turns of a conversation brought together, and read as a stream, so that a conversation of any length is
never held in memory. A turn's text, however long, is rendered and parsed in time linear in its length; a repeated row is a
turn as often as it comes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
#: The role whose texts bear loss.
LOSS_ROLE = "assistant"

_MARK = re.compile(r"###|</turn>")
#: Each level escapes more than the one before.
_CONFLICTS = (None, re.compile(r"\\|#{3,}|</turn>"), re.compile(r"[^\w ]|\s|_"))
_ROLE_CONFLICT = re.compile(r"[^\w ]")


class NotInGrammar(ValueError):
    """A text that the parser does not accept."""


def _escape(found: re.Match) -> str:
    return "\\<" + found[0][1:] if found[0] == "</turn>" else "".join("\\" + c for c in found[0])


def render_turn(role: str, text: str) -> str:
    """One turn, escaped just as far as the round trip needs."""
    shown_role = role if not _ROLE_CONFLICT.search(role) else _ROLE_CONFLICT.sub(_escape, role)
    for conflict in _CONFLICTS:
        shown = conflict.sub(_escape, text) if conflict else text
        out = f"{OPEN}{shown_role}{BETWEEN}{shown}{CLOSE}"
        try:
            if [(r, t) for r, t, _, _ in parse(out)] == [(role, text)]:
                return out
        except NotInGrammar:
            continue
    raise AssertionError("the last level escapes every mark")


def _literal(rendered: str, start: int, stop: str) -> tuple[str, int]:
    """The unescaped content from ``start`` up to an unescaped ``stop``, and where that begins."""
    out, at, slash, end = [], start, -1, -1
    while True:
        # Either is looked for again only once it has been passed, so that the time is linear.
        slash = rendered.find("\\", at) if 0 <= slash < at or at == start else slash
        end = rendered.find(stop, at) if end < at else end
        if end < 0:
            raise NotInGrammar(f"no {stop!r} after {start}")
        if slash < 0 or slash >= end:
            out.append((piece := rendered[at:end]))
            if _MARK.search(piece):
                raise NotInGrammar(f"a mark inside a turn at {at}")
            return "".join(out), end
        out.append(piece := rendered[at:slash])
        if _MARK.search(piece) or slash + 1 >= len(rendered):
            raise NotInGrammar(f"a mark inside a turn at {at}")
        out.append(rendered[slash + 1])
        at = slash + 2


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and where the text begins and ends in ``rendered``, of each turn."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise NotInGrammar(f"no turn begins at {at}")
        role, at = _literal(rendered, at + len(OPEN), BETWEEN)
        first = at + len(BETWEEN)
        text, at = _literal(rendered, first, CLOSE)
        out.append((role, text, first, at))
        at += len(CLOSE)
    return out


RENDERED = "conv_id long, turn long, role string, text string, rendered string, loss_start int, loss_stop int"


def render_turns(turns: DataFrame) -> DataFrame:
    """Each turn's rendering, and the span in it that bears loss (both null where none does)."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string()), ("loss_start", pa.int32()), ("loss_stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, roles, texts = (batch.column(i).to_pylist() for i in range(4))
            rendered = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            spans = [parse(x)[0][2:] if r == LOSS_ROLE else (None, None) for x, r in zip(rendered, roles, strict=True)]
            yield batch_of(schema, [conv, turn, roles, texts, rendered, [a for a, _ in spans], [b for _, b in spans]])

    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.mapInArrow(run, RENDERED)


def in_order(rendered: DataFrame) -> DataFrame:
    """Rendered turns with each conversation's together and in order: their concatenation is its text."""
    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_spans long"
_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("loss_spans", pa.int64())]
)


def digest_conversations(ordered: DataFrame) -> DataFrame:
    """What a reader gets back from ``in_order``'s output, in one row for each conversation.

    Only the renderings and the loss spans are read, as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv = False, None
        row, turns, loss = [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()

        def done() -> list:
            return [conv, row[0], turns.hexdigest(), row[1], loss.hexdigest(), row[2], row[3]]

        for batch in batches:
            out = []
            for key, text, first, stop in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not begun or key != conv:
                    if begun:
                        out.append(done())
                    begun, conv = True, key
                    row, turns, loss = [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                for role, content, at, end in parse(text):
                    row[0] += 1
                    turns.update(f"{role}\n{content}\n".encode())
                    if first is not None and (at, end) == (first, stop):
                        row[1] += len(content)
                        row[3] += 1
                        loss.update(content.encode())
                row[2] += len(text)
            if out:
                yield batch_of(_DIGEST, [*zip(*out, strict=True)])
        if begun:
            yield batch_of(_DIGEST, [[x] for x in done()])

    return ordered.select("conv_id", "rendered", "loss_start", "loss_stop").mapInArrow(run, DIGEST)
