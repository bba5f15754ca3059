"""A training corpus from raw documents: good ones, one of each near-duplicate group, without repeats, packed.

Odd input, by stage. Quality: documents without an n-gram (null, empty, white space) go; a null ``doc_id`` is judged as any
other, repeated rows stay or go together. Near duplicates: rows with a null ``doc_id`` and texts without words link with
nothing and stay; repeated rows stay together. Substring dedup: rows with a null ``doc_id`` stay whole, null texts stay
null. Packing: a null or empty text has the end id alone, repeated rows are packed as often as they come. Extra columns,
whatever their names, pass through all stages but the last; an empty table gives no rows at any stage; a very long text is
worked on whole, by one task at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import jaccard, packing, quality, substrings
from codestrata.llm.common import cut, read_table
from codestrata.llm.queries import TOKENIZER

#: Near duplicates share this share (percent) of their shingles of so many words.
SHINGLE, SIMILARITY = 5, 80
#: Passages of so many words that a smaller document has are taken out.
PASSAGE = 40


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, SHINGLE, SIMILARITY)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(docs, PASSAGE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: The stages fit a model, walk trees and automata and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written before the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
