"""Merkle dataset manifest with nested-interval labels.

Every row is a leaf: the hex sha256 of its fields, each written as its length in bytes and its value. The leaves of one
``tree`` (here a language) are ranked by id; runs of ``FAN`` consecutive nodes become the next level's nodes, whose
digest is that of their children's digests one after another, until one is left. The trees' roots, in
order of their names, are the leaves of a top tree, whose root stands for the whole dataset.

Labels. A node carries the interval of leaf ranks that it covers, ``lo`` to ``hi``. A node is an ancestor of another if its interval
contains the other's, so ancestors are attached by a containment join: nodes of a level lie in buckets as wide as they are, or, from
``SPAN`` leaves on, in every bucket of ``SPAN`` that they cover. A run meets one node per level there, and no bucket
holds more than ``SPAN / FAN`` runs, however large a tree is. A node's siblings are what is left of its parent's
interval without its own: the parent's children that end before it and those that begin after it.

A proof is the list of a leaf's siblings, left and right of its path, from its run up to the top root; folding a
leaf with it gives the root if and only if the leaf is the one the manifest was made of.

Ranks come from a range partitioning by tree, id and digest, with counts per partition summed before them, so a tree that
holds most rows is spread over many tasks; a level's groups have ``FAN`` rows at most.

Defined cases: a null field is written as ``-``, a null tree comes first; null ids come first in their tree; rows that share
an id are ordered by their digest, and identical rows are leaves of their own; a tree of one leaf has that leaf as its root
and a proof without siblings; an empty table has no leaves and no root. Texts are hashed whole on the JVM, a very long
one in one task. Other columns are left aside, so their names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaplate.llm.tables import stage

FAN = 8
SPAN = FAN**3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMPTY_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A field as its number of bytes, a colon and its value, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest_of(digests: Column) -> Column:
    """The digest of digests one after another, as hex text."""
    return F.sha2(F.array_join(digests, ""), 256)


def tree_name(value: Column) -> Column:
    """A key that sorts as the value does by its UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, id, digest, payload) per row; the payload has the doc_id, and the digest that the row would have
    with ``tampered`` in place of its text, where that is not null."""
    own = [docs[c] for c in FIELDS]
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered.isNotNull(), leaf_digest(*own[:-1], tampered))
    payload = F.struct(docs["doc_id"].cast("long").alias("doc_id"), other.alias("tampered"))
    return docs.select(tree_name(docs["lang"]).alias("tree"), docs["doc_id"].cast("long").alias("id"), leaf_digest(*own).alias("digest"), payload.alias("payload"))


@dataclass
class Forest:
    """The trees over one set of leaves.

    runs: (tree, size, lo, hi, leaves) with the run's ranked leaves; nodes: (tree, level, lo, hi, digest, children) of the levels
    above the first, with the labels and digests of the children; roots: (tree, digest).
    """

    runs: DataFrame
    nodes: DataFrame | None
    roots: DataFrame


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of a row in its tree by id and digest, and ``size``, the tree's number of leaves."""
    rows = stage(rows, "leaves").withColumn("turn", F.monotonically_increasing_id())  # spreads identical rows
    dealt = stage(rows.repartitionByRange("tree", "id", "digest", "turn").withColumn("part", F.spark_partition_id()), "dealt")
    own = Window.partitionBy("part", "tree").orderBy("id", "digest", "turn")
    all_parts = Window.partitionBy("tree")
    earlier = all_parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part", "tree").count()
    parts = parts.select("part", "tree", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"), F.sum("count").over(all_parts).alias("size"))
    numbered = dealt.withColumn("inside", F.row_number().over(own) - 1).join(parts, ["part", "tree"])
    return numbered.select("tree", "size", (F.col("before") + F.col("inside")).alias("rank"), "digest", "payload")


def grow(rows: DataFrame) -> Forest:
    """The trees over (tree, id, digest, payload) rows."""
    run = ranked(rows).groupBy("tree", "size", F.expr(f"rank div {FAN}").alias("run"))
    runs = run.agg(F.sort_array(F.collect_list(F.struct("rank", "digest", "payload"))).alias("leaves"))
    lo, hi = F.col("leaves")[0]["rank"], F.element_at("leaves", -1)["rank"]
    runs = stage(runs.select("tree", "size", lo.alias("lo"), hi.alias("hi"), "leaves"), "runs")
    largest = runs.agg(F.max("size")).first()[0] or 0
    roots = runs.filter("size = 1").select("tree", F.col("leaves")[0]["digest"].alias("digest"))
    below = runs.filter("size > 1").select("tree", "size", "lo", "hi", digest_of(F.col("leaves.digest")).alias("digest"))
    nodes, level = None, 1
    while FAN ** (level - 1) < largest:
        top = below.filter(F.col("size") <= FAN**level).select("tree", "digest")
        roots = roots.union(top)
        level += 1
        group = below.filter(F.col("size") > FAN ** (level - 1)).groupBy("tree", "size", F.expr(f"lo div {FAN**level}").alias("node"))
        up = group.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        up = up.withColumns({"lo": F.col("children")[0]["lo"], "hi": F.element_at("children", -1)["hi"], "level": F.lit(level)})
        if FAN ** (level - 1) < largest:
            below = stage(up.select("tree", "size", "level", "lo", "hi", digest_of(F.col("children.digest")).alias("digest"), "children"), "nodes")
            nodes = below if nodes is None else nodes.union(below)
    return Forest(runs, nodes, stage(roots, "roots"))


def height(size: Column, most: int) -> Column:
    """The number of levels above the leaves of a tree."""
    return sum(((size > FAN**k).cast("int") for k in range(most)), F.lit(0))


def siblings(children: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """What is left of the parent's interval: digests of the children before ``lo`` and of those after ``hi``."""
    side = lambda test: F.array_join(F.transform(F.filter(children, test), lambda c: c["digest"]), "")
    return side(lambda c: c["hi"] < lo), side(lambda c: c["lo"] > hi)


def paths(forest: Forest) -> DataFrame:
    """(tree, lo, path): for each run below other levels, the siblings on its way from level 2 on to the root."""
    most = forest.nodes.agg(F.max("level")).first()[0]
    width = F.least(F.pow(F.lit(FAN), F.col("level")), F.lit(SPAN)).cast("long")
    bucket = lambda c: F.floor(F.col(c) / width)
    below = forest.runs.filter(F.col("size") > FAN).select("tree", "lo", "hi", F.explode(F.sequence(F.lit(2), height(F.col("size"), most))).alias("level"))
    below = below.withColumn("bucket", bucket("lo"))
    above = forest.nodes.select("tree", "level", F.col("lo").alias("from"), F.col("hi").alias("to"), "children")
    above = above.withColumn("bucket", F.explode(F.sequence(bucket("from"), bucket("to"))))
    inside = (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
    left, right = siblings(F.col("children"), F.col("lo"), F.col("hi"))
    met = below.join(above, ["tree", "level", "bucket"]).filter(inside).select("tree", "lo", F.struct("level", left.alias("left"), right.alias("right")).alias("step"))
    steps = met.groupBy("tree", "lo").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    return steps.select("tree", "lo", F.transform("steps", lambda s: F.named_struct(F.lit("left"), s["left"], F.lit("right"), s["right"])).alias("upper"))


def proofs(forest: Forest) -> DataFrame:
    """(tree, digest, payload, path) per leaf; the path has the siblings' digests, joined, left and right at each level."""
    runs = forest.runs
    if forest.nodes is None:
        runs = runs.withColumn("upper", F.lit(None).cast(EMPTY_PATH))
    else:
        runs = runs.join(paths(forest), ["tree", "lo"], "left")
    children = F.transform("leaves", lambda x: F.named_struct(F.lit("lo"), x["rank"], F.lit("hi"), x["rank"], F.lit("digest"), x["digest"]))
    rows = runs.select("tree", "size", "upper", children.alias("children"), F.explode("leaves").alias("leaf"))
    left, right = siblings(F.col("children"), F.col("leaf.rank"), F.col("leaf.rank"))
    none = F.array().cast(EMPTY_PATH)
    first = F.when(F.col("size") > 1, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(none)
    return rows.select("tree", "leaf.digest", "leaf.payload", F.concat(first, F.coalesce("upper", none)).alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, its ``leaf``, the ``subroot`` of its tree, the ``root``, the ``path`` of its proof,
    and ``tampered``, the leaf it would have with the given text."""
    trees = grow(leaves(docs, tampered))
    subroots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest", F.struct(F.col("tree").alias("name")).alias("payload"))
    top = grow(subroots)
    found = top.roots.first()  # one value
    root = F.lit(found["digest"] if found else None).cast("string").alias("root")
    tops = proofs(top).select(F.col("payload.name").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("upper_path"), root)
    tops = stage(tops, "tops")  # a row per tree
    rows = proofs(trees).join(tops, "tree")
    return rows.select(
        "payload.doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "upper_path").alias("path"), "payload.tampered"
    )


def lower_case(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def summary(rows: DataFrame) -> DataFrame:
    """The proof as one digest, and the root folded from the tampered leaf where there is one."""
    joined = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
