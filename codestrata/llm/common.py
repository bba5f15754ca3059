"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled together inside a task; keeps a task's memory apart from its partition's size.
CHUNK_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's reader (``sf_dir`` may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where that is unset and all runs on
    one machine (tests), a temporary folder is taken instead; on a cluster an error tells to set it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions the session deals shuffled rows to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """The bytes of all texts, from which the number of parts of bounded size follows."""
    return docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0


def raw_bytes(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, chunk: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``chunk`` bytes in ``column``, and that column's bytes."""
    for batch in batches:
        texts = raw_bytes(batch.column(batch.schema.get_field_index(column)))
        start, size = 0, 0
        for i, text in enumerate(texts):
            if start < i and size + len(text) > 2 * chunk:  # a long text comes alone
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
            if size >= chunk or i - start >= 4096:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows with one value of the first column, where those come one after another."""
    value, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != value:
                yield value, held
                held = []
            value = row[0]
            held.append(row)
    if held:
        yield value, held


def bounded(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches in lists of about ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch of plain Python or numpy columns."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers, so that sums of products spread evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive word hashes; empty if there are fewer."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = mix(words[: len(words) - n + 1] + np.uint64(0x9E3779B97F4A7C15))
    for k in range(1, n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k])
    return out


def gather(values: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``values[b : b + n]`` of each pair (b, n), one after another."""
    before = np.cumsum(counts) - counts
    return values[np.repeat(begin - before, counts) + np.arange(int(counts.sum()))]


_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word ``data[start : start + length]``; long words are hashed apart."""
    if not len(starts):
        return np.empty(0, np.uint64)
    head = np.minimum(lengths, len(_POWERS))
    first = np.cumsum(head) - head
    place = np.arange(int(head.sum())) - np.repeat(first, head)
    letters = _VALUES[data[np.repeat(starts, head) + place]] * _POWERS[place]
    out = mix(np.add.reduceat(letters, first) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > len(_POWERS)).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return out


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: where they are, and a hash of each."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = b"".join(texts)
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        space = _SPACE[self.data]
        begins = ~space
        if len(space):
            begins[1:] &= space[:-1]
            edges = np.cumsum(sizes)[:-1]
            edges = edges[edges < len(space)]
            begins[edges] = ~space[edges]
        self.starts = np.flatnonzero(begins)
        stops = ~space
        if len(space):
            stops[:-1] &= space[1:]
            last = np.cumsum(sizes) - 1
            last = last[last >= 0]
            stops[last] = ~space[last]
        self.lengths = np.flatnonzero(stops) + 1 - self.starts
        #: The text of each word, how many words each text has, and the number of its first.
        self.of = np.repeat(np.arange(len(texts)), sizes)[self.starts]
        self.counts = np.bincount(self.of, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts
        self.offsets = np.cumsum(sizes) - sizes
        self.hashes = word_hashes(self.data, self.starts, self.lengths)


def segments(text: bytes, lower: bool = False) -> Iterator[Words]:
    """The words of a long text, some ``CHUNK_BYTES`` at a time."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + CHUNK_BYTES)
        stop = gap.start() if gap else len(text)
        yield Words([text[start:stop]], lower)
        start = stop


def deal(bucket: np.ndarray, columns: dict[str, np.ndarray], sizes: np.ndarray | None = None, flat: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Rows of numbers as one row for each bucket, their columns packed as binary.

    ``flat`` (a row of bytes each) holds ``sizes[i]`` rows for the i-th number.
    """
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edges = np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])), len(sorted_))
    out, names = [pa.array(sorted_[edges[:-1]], pa.int32())], ["bucket"]
    for name, column in columns.items():
        column = column[order]
        out.append(pa.array([column[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()))
        names.append(name)
    if flat is not None:
        begin = (np.cumsum(sizes) - sizes)[order]
        moved = gather(flat, begin, sizes[order])
        stop = np.append(0, np.cumsum(sizes[order]))
        out.append(pa.array([moved[stop[a] : stop[b]].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()))
        names.append("flat")
    return pa.RecordBatch.from_arrays(out, names=names)


def undeal(rows: list[tuple], kinds: dict[str, object], start: int = 1) -> list[np.ndarray]:
    """The packed columns of some rows, from the ``start``-th on, as arrays of the given kinds."""
    return [np.frombuffer(b"".join(row[i] for row in rows), kind) for i, kind in enumerate(kinds.values(), start)]


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, asked on whichever machine runs the task."""
    import public_tokenizers

    return public_tokenizers.path(name)


def empty_safe(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns, whatever their names, never clash."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
