"""Connected components and bounded blocks of a group's pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.llm.tables import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id): the smallest node reachable, for every node that has an edge.

    Alternates the large-star and small-star steps: each node links its larger
    neighbours, then its smaller ones, to the smallest it knows. Each step is an
    aggregate that combines before its shuffle and a join on the node. A round's
    edges are staged; the loop ends when a round changes nothing.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = stage(edges.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        now = stage(small, "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and an order-free fingerprint of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def pair_blocks(members: DataFrame, key: str, order: str, block: int) -> DataFrame:
    """Adds (bi, bj): the members of a group of more than ``block`` rows are dealt into blocks, and each row is
    sent to every pair of blocks that holds its own, so that a task gets two blocks at most and each pair of
    members meets exactly once (``own`` is the row's block). The sizes of large groups are staged, so that Spark sees
    how few they are and need not deal the members for a join with them."""
    sizes = members.groupBy(key).count().filter(F.col("count") > block).select(key, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    sizes = stage(sizes, "sizes")
    return deal_blocks(members.join(sizes, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), order)


def deal_blocks(rows: DataFrame, order: str) -> DataFrame:
    """The same for rows that know their group's number of ``blocks`` already."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64(order), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("other", "blocks")


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the given edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after
