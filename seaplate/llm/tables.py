"""Shared steps: groups of whole documents sized by their bytes, packed messages between them, staged tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaplate.session import remove_path, staging_path
from seaplate.sources.sinks import stage_table

GROUP_BYTES = 4 << 20
GROUPS_PER_TASK = 4
BATCH_ROWS = 1000


_scope: list[str] | None = None
_ended: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage in a way that outlives executors."""
    path = staging_path(df.sparkSession, name)
    if _scope is not None:
        _scope.append(path)
    return stage_table(df, name, path)


def text_ids(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id as text, for pandas, which turns whole numbers beside a null into floats and so rounds those above 2**53."""
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *others)


def long_ids(rows: DataFrame) -> DataFrame:
    """doc_id as a number again."""
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of ``BATCH_ROWS`` rows, which bounds what a worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Removes what the scope before it has staged, whose results must have been written by then; tables staged
    outside of scopes stay."""
    global _scope
    small_batches(spark)
    while _ended:
        remove_path(spark, _ended.pop())
    _scope = []
    try:
        yield
    finally:
        _ended.extend(_scope)
        _scope = None


def document_groups(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, bucket), dealt by bucket, and the number of tasks it is dealt to.

    A bucket is a group of whole documents of about ``group_bytes`` in sum. Rows
    are spread by id and text, so repeated ids do not gather.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // group_bytes))
    # Not below the session's own number, else Spark deals the texts again to join them with other rows.
    tasks = max(-(-buckets // GROUPS_PER_TASK), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")
    return docs.select("doc_id", "text", bucket.alias("bucket")).repartition(tasks, "bucket"), tasks


def in_order(table: pa.Table) -> pa.Table:
    """A group's rows by doc_id and text. Each round reads the group anew, and Spark does not promise it the same order of
    rows: blocks of a shuffle arrive as executors deliver them. Rows that tie are alike, so their order does not matter."""
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))


def split_by_shard(records: np.ndarray, hashes: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    """The records as one packed blob per shard; a record's shard is its hash's remainder."""
    if not len(records):
        return []
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    records, shard = records[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    return [(int(shard[a]), records[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True)]


def unpack(blobs, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of the blobs in one array, and the number of records of each blob."""
    blobs = list(blobs)
    sizes = np.array([len(b) // dtype.itemsize for b in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), dtype), sizes


def by_shard(grouped: DataFrame, tasks: int, send: Callable, answer: Callable) -> DataFrame:
    """One round of messages: ``send(pdf, shards)`` packs (shard, bucket, blob) rows per bucket, ``answer(pdf)``
    works on one shard's blobs and returns (bucket, reply) rows."""
    sent = grouped.groupBy("bucket").applyInPandas(lambda pdf: send(pdf, tasks), "shard int, bucket int, blob binary")
    return sent.repartition(tasks, "shard").groupBy("shard").applyInPandas(answer, "bucket int, reply binary")
