"""Lazy reading: an index of where lines begin, and readers that seek to what is asked.

The index has the byte offset of every ``STEP``-th line of a file. A range of lines is read from the offset before its first line on and no
further than its last, on whichever machine asks, by any store that pyarrow reaches; other bytes of the file, however long it is, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codestrata.sources.files import LANGUAGES, _relative
from codestrata.sources.pages import store_of

#: Lines from one offset to the next, and bytes read at a time.
STEP, CHUNK = 256, 1 << 16
_END = re.compile(rb"\r\n?|\n")


def line_offsets(spark: SparkSession, root: str, max_bytes: int) -> DataFrame:
    """``path``, ``block`` and ``offset``: where line ``block * STEP + 1`` of a source file begins. Lines end with a line feed, a carriage return, or both."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}").load(root).where(F.col("length") <= max_bytes)
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                after = np.append(data[1:], 0)
                begins = np.append(0, np.flatnonzero((data == 10) | ((data == 13) & (after != 10))) + 1)[::STEP]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(begins)), pa.array(np.arange(len(begins))), pa.array(begins)], schema=schema)

    return raw.select(_relative(root).alias("path"), "content").mapInArrow(run, "path string, block long, offset long")


def lines_from(stream, offset: int, skip: int, count: int) -> tuple[list[bytes], int]:
    """``count`` lines after ``skip`` from an offset on, without their ends, and how many bytes were read."""
    stream.seek(offset)
    held, read, out, at = b"", 0, [], 0
    while len(out) < skip + count:
        chunk = stream.read(CHUNK)
        read += len(chunk)
        held = held[at:] + chunk
        at = 0
        for end in _END.finditer(held):
            if chunk and end.end() == len(held) and held.endswith(b"\r"):
                break  # the line feed after it may be in the next chunk
            out.append(held[at : end.start()])
            at = end.end()
            if len(out) == skip + count:
                break
        if not chunk:
            if len(out) < skip + count:
                out.append(held[at:])
            break
    return out[skip:], read


def read_ranges(wanted: DataFrame, offsets: DataFrame, root: str) -> DataFrame:
    """``wanted`` (``path``, ``start_line``, ``end_line`` and more) with ``body``, those lines, and ``bytes_read``; files that are not indexed have no rows.

    Only the places that are asked for meet the index; then each task seeks.
    """
    block = F.floor((F.greatest(F.col("start_line").cast("long"), F.lit(1)) - 1) / STEP)
    last = offsets.groupBy("path").agg(F.max("block").alias("_last"))
    asked = wanted.join(last, "path").withColumn("_block", F.least(block, "_last"))
    found = asked.join(offsets.select("path", F.col("block").alias("_block"), F.col("offset").alias("_offset")), ["path", "_block"]).select(*wanted.columns, "_block", "_offset")
    names = found.columns
    at = {c: names.index(c) for c in ("path", "start_line", "end_line", "_block", "_offset")}
    schema = StructType([*wanted.schema.fields, StructField("body", StringType()), StructField("bytes_read", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        for batch in batches:
            bodies, sizes, streams = [], [], {}
            for path, first, end, place, offset in zip(*(batch.column(i).to_pylist() for i in at.values()), strict=True):
                if path not in streams:
                    if len(streams) > 64:
                        streams.popitem()[1].close()
                    streams[path] = store.open_input_file(f"{base}/{path}")
                first = max(first, 1)
                got, size = lines_from(streams[path], offset, first - 1 - place * STEP, max(0, end - first + 1)) if end >= first else ([], 0)
                text = b"\n".join(got).decode("utf-8", "replace")
                bodies.append(text.removeprefix("﻿") if first == 1 else text)
                sizes.append(size)
            for stream in streams.values():
                stream.close()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 2], pa.array(bodies, pa.string()), pa.array(sizes, pa.int64())], names=[*names[:-2], "body", "bytes_read"])

    return found.mapInArrow(run, schema)
