"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each group of near copies the smallest doc_id stays.
3. decontaminate: documents with too much of a benchmark go.
4. mix: sources are brought to their target weights; a document has a row for each time it is taken.
5. tokens: token ids are written in files and read back; one row per document of the mix.

A stage's result is to be written before the next stage is called: each stage begins by removing what the one before it
has staged for its own use.

All stages but the last return the columns of their input. Null and empty texts: scored like any text, kept by
2 and 3, not taken by 4. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seaplate.llm import decontam, mixing, neardup, quality, tokens
from seaplate.llm.tables import staging_scope
from seaplate.session import remove_path, staging_path
from seaplate.sources.sinks import stage_table

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with staging_scope(spark):
        model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with staging_scope(spark):
        return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with staging_scope(spark):
        return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with staging_scope(spark):
        return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with staging_scope(spark):
        folder = staging_path(spark, "tokens")
        tokens.write_tokens(docs, folder, public_tokenizers.path(TOKENIZER))
        return tokens.read_tokens(spark, folder).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", write_tokens),
]

# The classifier and the tokenizer have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between two stages is removed when the later one has been written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        path = staging_path(spark, name)
        docs = stage_table(step(spark, docs, sf_dir), name, path)
        if last:
            remove_path(spark, last)
        last = path
    result = STAGES[-1][1](spark, docs, sf_dir)  # the files are written by now
    remove_path(spark, last)
    return result
