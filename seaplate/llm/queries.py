"""One query per operator, over its whole table; each derives the agreed columns from its operator's result."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seaplate.llm import collocations, decontam, langid, lines, manifest, mixing, neardup, passages, quality, substrings, tokens, vectors, warc
from seaplate.llm.langid import held_out
from seaplate.llm.tables import small_batches
from seaplate.session import JOB_CONF, staging_path

TOKENIZER = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = langid.learn(docs.filter(~out).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staging_path(spark, "tokens")
    tokens.write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return tokens.read_tokens(spark, folder).drop("ids")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.summary(substrings.remove_repeats(read(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.classify(docs, quality.learn(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.summary(lines.dedup_lines(read(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.summary(decontam.find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a stored copy in which every 97th page's record has one byte changed."""
    folder, second = staging_path(spark, "warc"), staging_path(spark, "warc-copy")
    warc.write_warc(read(spark, sf_dir, "pages"), folder)
    files = warc.read_files(spark, folder)
    original = warc.stage(warc.file_trees(files), "trees")
    warc.write_files(warc.damage(files, lambda page: page is not None and page % 97 == 5), second)
    found = warc.fixity(original, warc.replica_trees(warc.read_files(spark, second), original))
    return found.select("page_id", F.col("length").alias("n_bytes"), F.col("digest").alias("record_sha256"), "damaged")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a third of them, by crc32 of the id, are checked with their text in lower case."""
    docs = read(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest.summary(manifest.manifest(docs, F.when(chosen, manifest.lower_case(F.col("text")))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2000 phrases of all documents."""
    return collocations.top_phrases(collocations.scored_phrases(read(spark, sf_dir, "documents")))


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.summary(passages.remove_passages(read(spark, sf_dir, "documents")))


def _run(query, spark: SparkSession, sf_dir: str) -> DataFrame:
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    small_batches(spark)
    return query(spark, sf_dir)


OPERATORS = (
    op1_language_id, op2_token_planes, op3_source_mix, op4_embedding_neardup, op5_suffix_dedup,
    op6_quality, op7_minhash, op8_line_dedup, op9_decontaminate, op10_warc_audit,
    op11_merkle_manifest, op12_collocations, op13_passage_dedup,
)
QUERIES = {q.__name__: partial(_run, q) for q in (*OPERATORS,)} | {"pipeline": partial(_run, corpus_pipeline.run)}
