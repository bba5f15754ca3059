"""Vector bin packing of documents' tokens into training sequences.

A document's ids, and the end id, are cut into full pieces of the sequence length and one rest. A piece takes up tokens,
one segment, and as many loss-bearing tokens as have a token before them in their document and lie beyond its prompt, where
a column tells how long that is. The dot-product heuristic
fills one sequence after another: of the pieces that fit under all limits at once, it takes the one whose sizes,
weighted by how scarce each limit is, have the largest dot product with what is left.

Pieces that are full are sequences by themselves. The others are dealt in turn to groups of at most about ``GROUP`` pieces
by where they stand in the input, not by any key, so that no hot key can fill a group; groups are packed apart, and only the
last sequence of a group stays ill filled.

On plain documents the limit of tokens binds, that of segments only where pieces are short on average (under 16 tokens for
4096 and 256), and that of loss-bearing tokens, which are nearly all there, only if it is less than that of tokens. On
instruction data, with prompts and a lower limit of loss-bearing tokens, either binds, as the examples fall.

Results for odd input: a null or empty text has the end id alone; repeated rows are packed as often as they come; a null
``doc_id`` is passed on; a null or negative prompt counts as none; an empty table gives no rows; a very long text is
encoded as in ``bpe``, and its pieces are streamed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, word_pattern
from .common import batch_of, cut, pieces

#: Pieces packed together, on average.
GROUP = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, part long, at long"
_PIECES = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def token_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, prompt: str | None = None) -> DataFrame:
    """The pieces of every whole document, with a digest of each one's ids and where the row came from.

    ``prompt`` names a column with the number of tokens at a document's beginning that bear no loss.
    """

    pattern = word_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = encoder(tokenizer, pattern), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch, texts in pieces(batches, "text"):
            rows = []
            for doc_id, numbers, masked in zip(batch.column(0).to_pylist(), own.encode(texts), batch.column(2).to_pylist(), strict=True):
                masked = max(1, masked or 0)  # the first token has none before it
                ids = numbers.astype("<u4").tobytes() + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, max(0, start + len(piece) // 4 - max(start, masked)), part, at))
                    at += 1
            yield batch_of(_PIECES, [*zip(*rows, strict=True)])

    masked = F.col(f"`{prompt}`").cast("long") if prompt else F.lit(0).cast("long")
    return docs.select("doc_id", "text", masked.alias("masked")).mapInArrow(run, PIECES)


def fill(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its turn there, by the dot-product heuristic; each piece must fit alone."""
    share = sizes / limits
    scarce = share.sum(axis=0)
    weighted = share * (scarce / max(scarce.max(), 1e-12))
    order = np.lexsort(-share.T[::-1])  # large pieces first, so that ties take the first of equals
    share, weighted = share[order], weighted[order]
    sequence, turn = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    number = -1
    while len(order):
        number += 1
        left, step, open_ = np.ones(sizes.shape[1]), 0, np.ones(len(order), bool)
        while True:
            fits = open_ & (share <= left + 1e-9).all(axis=1)
            if not fits.any():
                break
            best = int(np.where(fits, weighted @ left, -1.0).argmax())
            sequence[order[best]], turn[order[best]] = number, step
            left, step = left - share[best], step + 1
            open_[best] = False
        share, weighted, order = share[open_], weighted[open_], order[open_]
    return sequence, turn


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(found: DataFrame, groups: int, max_tokens: int, max_segments: int, max_loss: int) -> DataFrame:
    """The sequence of each piece, and its offset there without gaps."""
    limits = np.array([max_tokens, max_segments, max_loss], float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "at"], ignore_index=True)
        sizes = np.stack([pdf["length"], np.ones(len(pdf)), pdf["loss_tokens"]], axis=1).astype(float)
        sequence, turn = fill(sizes, limits)
        pdf["sequence_id"] = int(pdf["grp"].iloc[0]) << 32 | sequence
        pdf["turn"] = turn
        pdf = pdf.sort_values(["sequence_id", "turn"], ignore_index=True)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[[c.split()[0] for c in PACKED.split(", ")]]

    # Stride by a prime, so that parts of few rows do not all begin in the same groups.
    dealt = found.selectExpr("*", f"pmod(part * 7919 + at, {groups}) AS grp")
    return dealt.groupBy("grp").applyInPandas(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, max_segments: int = 256, max_loss: int = 4096, end_id: int = 2, prompt: str | None = None) -> DataFrame:
    """Every id of every document in exactly one piece, and every piece in a sequence.

    A piece of ``max_tokens`` is a sequence by itself and enters no group; the others are counted for the number of groups.
    """
    found = cut(token_pieces(docs, tokenizer, min(max_tokens, max_loss), end_id, prompt))
    full, rest = found.where(F.col("length") == max_tokens), found.where(F.col("length") < max_tokens)
    groups = max(1, -(-rest.count() // GROUP))
    # Numbers beyond those of the groups, one for each part of the input.
    alone = full.withColumn("sequence_id", F.shiftleft(F.col("part") + groups, 32) + F.col("at")).withColumn("offset", F.lit(0).cast("long"))
    return pack(rest, groups, max_tokens, max_segments, max_loss).unionByName(alone.select(*(c.split()[0] for c in PACKED.split(", "))))
