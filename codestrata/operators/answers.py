"""A model's answers, kept under a hash of model and prompt, so that nothing is ever asked twice.

An answer is written as it comes, in a file of its own under its hash, on storage that driver and executors share (a path or URI of any store that
pyarrow reaches). Before a run the kept answers are joined with the prompts, and only the rest are asked; a task that is repeated finds
what its earlier attempt was told. The budget counts calls that are really made.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.text import cap_words
from codestrata.session import cut
from codestrata.sources.pages import exists, store_of

KEPT = "key string, text string"


def key_of(prompt: Column, model: str) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(model), prompt), 256)


def place_of(folder: str, key: str) -> str:
    return posixpath.join(folder, key[:2], f"{key}.json")


def recall(store, folder: str, key: str) -> str | None:
    """The kept answer, if there is one."""
    path = place_of(folder, key)
    if not exists(store, path):
        return None
    with store.open_input_stream(path) as f:
        return json.loads(f.read())["text"]


def keep(store, folder: str, key: str, text: str) -> None:
    """Writes an answer whole or not at all: under another name first."""
    path = place_of(folder, key)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(json.dumps({"key": key, "text": text}).encode())
    store.move(part, path)


def kept_answers(spark: SparkSession, folder: str) -> DataFrame:
    """``key`` and ``text`` of all answers in a folder; none if there is no folder yet."""
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    return spark.read.schema(KEPT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)


def ask(asked: DataFrame, model, name: str, most: int, words: int, folder: str | None = None, partitions: int = 4) -> DataFrame:
    """``tier``, ``node_id``, ``chunk``, ``text`` and ``called`` of prompts, in order of node and chunk, for at most ``most`` calls of the model.

    A prompt that was answered before, by the model of that ``name``, has its answer from ``folder``; equal prompts are asked once. ``called`` marks the
    row for which a call was made. A call that fails gives null and is not kept. ``partitions`` bounds how many calls run at a time.
    """
    prompts = cut(asked.select("tier", "node_id", "chunk", "prompt").withColumn("key", key_of(F.col("prompt"), name)))
    known = cut(kept_answers(asked.sparkSession, folder).dropDuplicates(["key"])) if folder else asked.sparkSession.createDataFrame([], KEPT)
    first = F.row_number().over(Window.partitionBy("key").orderBy("node_id", "chunk"))
    new = prompts.join(known, "key", "left_anti").withColumn("first", first).where("first = 1").orderBy("node_id", "chunk").limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = store_of(folder) if folder else (None, None)

        def one(key: str, prompt: str) -> str | None:
            if store and (text := recall(store, path, key)) is not None:
                return text
            try:
                text = model(prompt)
            except Exception:  # one description less must not end the run
                return None
            if store and text is not None:
                keep(store, path, key, text)
            return text

        for pdf in batches:
            for row in pdf.itertuples():  # an answer leaves the task as it comes
                yield pd.DataFrame({"tier": [row.tier], "node_id": [row.node_id], "chunk": [row.chunk], "key": [row.key], "text": [one(row.key, row.prompt)]})

    told = cut(new.repartition(partitions).mapInPandas(run, "tier int, node_id string, chunk long, key string, text string"))
    every = known.join(prompts.select("key").distinct(), "key", "left_semi").unionByName(told.select("key", "text"))
    called = told.select("tier", "node_id", "chunk", F.lit(True).alias("called"))
    answered = prompts.drop("prompt").join(every, "key").join(called, ["tier", "node_id", "chunk"], "left")
    return answered.select("tier", "node_id", "chunk", cap_words(F.col("text"), words).alias("text"), F.coalesce("called", F.lit(False)).alias("called"))
