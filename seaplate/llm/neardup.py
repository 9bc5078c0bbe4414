"""MinHash near-dedup: one-permutation signatures, banded buckets, star-shaped candidates, exact confirmation.

A document's set holds its distinct ``width``-word shingles as 64-bit hashes. One
hash per shingle fills ``BINS`` bins with the smallest value each; an empty bin
copies the filled bin that its own fixed random order of all bins meets first
(optimal densification). ``ROWS`` bins make a band, and a bucket holds documents
that agree on a band. Sets of 3 to ``SMALL`` shingles have few values to choose from, so they get further buckets:
one for the whole set and, from 4 on, one for each set that leaves out one shingle. Two such sets with a similarity
of 0.75 or more differ by at most one shingle on either side, so they surely share one.

1. Rows with equal sets become one class. Its representative is the row with the smallest doc_id, and of that
   the smallest text hash; classes are numbered, so several texts under one doc_id do not get in each other's way.
2. Each bucket links its class of the smallest number to the others: a star, not all pairs.
   The links are confirmed on the full sets, and components formed.
3. Where a bucket still spans several components, its members meet in blocks of at most ``BLOCK`` sets and about ``VALUES``
   shingles, so that a star's centre hides no link. Whole sets are compared there, whatever their size, and each
   pair of components gives its most similar pair, if any reaches the limit, to be confirmed on the full sets.

At similarity 0.75 a pair of larger sets shares none of the 32 bands with probability 5e-6. Buckets know their sizes from the
aggregate that finds them, so the members of a large one are dealt out without another join on its key.

Defined cases: null, empty and word-free texts have an empty set, stay alone and are
kept; with fewer than ``width`` words the whole sequence is the one shingle; identical rows
share a class; rows that share a doc_id with different texts are documents of their own; rows with a null doc_id are linked with
nothing and have a null component; an empty table gives no rows. A very long text is one task's, which holds its words
several times over; columns beside doc_id and text are only copied, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.llm import kernels as k
from seaplate.llm.graph import components, deal_blocks
from seaplate.llm.tables import long_ids, stage, text_ids

WIDTH = 5
PERCENT = 75
BINS = 128
ROWS = 4
BLOCK = 512
VALUES = 1 << 18
COLUMNS = 4096
SMALL = 7
NOT_WHITE = ~k.WHITE


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for cut in k.slices(texts):
        h, _, counts, _ = k.words(texts[cut], NOT_WHITE)
        grams = k.sequence_hashes(h, width)
        at = 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(grams[at : at + n - width + 1])
            else:
                yield k.sequence_hashes(h[at : at + n], n) if n else np.empty(0, np.uint64)
            at += n


_draws = np.random.default_rng(77).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One smallest value per bin, empty bins densified; None-sized for an empty set."""
    h = k.mix(shingles + np.uint64(0x51ED27))
    bins = (h >> np.uint64(57)).astype(np.int64)
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, bins, h)
    filled = np.zeros(BINS, bool)
    filled[bins] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        out[empty] = out[_draws[empty, filled[_draws[empty]].argmax(1)]]
    return out


def small_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of a small set and of the sets without one of its shingles."""
    if not 3 <= len(shingles) <= SMALL:
        return np.empty(0, np.uint64)
    h = k.mix(shingles + np.uint64(0x2F0B43))
    whole = h.sum(keepdims=True)
    return k.mix(np.concatenate([whole, whole - h] if len(h) > 3 else [whole]))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The buckets of a set that is not empty."""
    sign = signature(shingles)
    bands = np.zeros(BINS // ROWS, np.uint64)
    for i in range(ROWS):
        bands = bands * np.uint64(k.STEP) + sign[i::ROWS]
    return np.concatenate([k.mix(bands + np.arange(len(bands), dtype=np.uint64)), small_keys(shingles)]).view(np.int64)


def _describe(pdf: pd.DataFrame, width: int) -> Iterator[tuple]:
    for doc, tie, own in zip(pdf["doc_id"], pdf["tie"], shingle_sets(pdf["text"].tolist(), width), strict=True):
        if not len(own):
            yield doc, tie, 0, None, None
            continue
        yield doc, tie, len(own), xxhash.xxh3_128_digest(own.tobytes()), band_keys(own)


def describe(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, a hash of the text (``tie``), n_shingles, a digest of the set, and band keys."""

    def task(batches):
        for pdf in batches:
            rows = list(_describe(pdf, width))
            yield pd.DataFrame(rows, columns=["doc_id", "tie", "n_shingles", "digest", "bands"])

    schema = "doc_id string, tie long, n_shingles long, digest binary, bands array<long>"
    return long_ids(text_ids(docs, F.xxhash64("text").alias("tie"), "text").mapInPandas(task, schema))


def sets_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) of the classes, each from its representative row."""

    def task(batches):
        for pdf in batches:
            rows = [own.tobytes() for own in shingle_sets(pdf["text"].tolist(), width)]
            yield pd.DataFrame({"rep": pdf["rep"], "shingles": rows})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    wanted = rows.join(classes.select("rep", "row.doc_id", "row.tie"), ["doc_id", "tie"]).select("rep", "text").dropDuplicates(["rep"])
    return wanted.mapInPandas(task, "rep long, shingles binary")


def _linked(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return linked


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    first = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(first, "a").join(second, "b")
    return stage(both.filter(_linked(percent)("sa", "sb")).select("a", "b"), "links")


def _close(low: str, high: str, percent: int):
    """Sets whose sizes differ by more cannot reach the similarity."""
    return F.least(low, high) * 100 >= F.greatest(low, high) * percent


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(band, rep, n_shingles) of the buckets that hold more than one class, with the smallest class ``c`` of the bucket, its number of
    classes ``size`` and of shingles ``weight``."""
    rows = classes.select(F.explode("bands").alias("band"), "rep", "n_shingles")
    sums = (F.count("*").alias("size"), F.sum("n_shingles").alias("weight"), F.min(F.struct("rep", "n_shingles")).alias("c"))
    return rows.join(rows.groupBy("band").agg(*sums).filter("size > 1"), "band")


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the smallest class of a bucket with each other one, sizes allowing."""
    others = rows.filter((F.col("rep") != F.col("c.rep")) & _close("n_shingles", "c.n_shingles", percent))
    return others.select(F.col("c.rep").alias("a"), F.col("rep").alias("b")).distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values of all pairs of sets, through the values that at least two of them hold."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, value, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    place = np.cumsum(common) - 1
    held = common[value]
    owner, place = owner[held], place[value[held]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(common.sum()), COLUMNS):
        inside = (place >= at) & (place < at + COLUMNS)
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[owner[inside], place[inside] - at] = 1
        both += table @ table.T
    return both.astype(np.int64)


def _meet(block: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """The most similar pair, at the limit or above, of each two components in one block, or in two blocks of one bucket."""
    rep, part, n, own = (block[c].to_numpy() for c in ("rep", "part", "n_shingles", "own"))
    both = _common([np.frombuffer(x, np.uint64) for x in block["shingles"]])
    union = n[:, None] + n[None, :] - both
    a, b = np.nonzero(np.triu(100 * both >= percent * union, 1))
    keep = part[a] != part[b]
    if block["bi"].iloc[0] != block["bj"].iloc[0]:
        keep &= own[a] != own[b]
    a, b = a[keep], b[keep]
    if not len(a):
        return []
    score = both[a, b] / union[a, b]
    low, high = np.minimum(part[a], part[b]), np.maximum(part[a], part[b])
    order = np.lexsort((-score, high, low))
    low, high = low[order], high[order]
    first = order[(np.diff(low, prepend=low[0] - 1) != 0) | (np.diff(high, prepend=high[0] - 1) != 0)]
    a, b = rep[a[first]], rep[b[first]]
    return list(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))


def rest_pairs(rows: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of buckets that span several components, to be confirmed; see step 3 of the module."""
    labelled = rows.drop("c").join(parts, rows["rep"] == parts["node"], "left").withColumn("part", F.coalesce("component_id", "rep"))
    labelled = stage(labelled.select("band", "rep", "n_shingles", "size", "weight", "part"), "bucket-parts")
    mixed = labelled.groupBy("band").agg((F.min("part") != F.max("part")).alias("mixed")).filter("mixed").select("band")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / VALUES)).cast("int")
    members = stage(labelled.join(mixed, "band", "left_semi").select("band", "rep", "n_shingles", "part", blocks.alias("blocks")), "mixed-buckets")
    sent, values = members.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum(F.col("n_shingles") * F.col("blocks")), F.lit(0))).first()
    tasks = sent // (4 * BLOCK) + values // (4 * VALUES) + 1

    def meet(pdf):
        out = [pair for _, block in pdf.groupby(["band", "bi", "bj"], sort=False) for pair in _meet(block, percent)]
        return pd.DataFrame(list(dict.fromkeys(out)), columns=["a", "b"], dtype="int64")

    dealt = deal_blocks(members, "rep").join(sets, "rep")
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("band", "bi", "bj"), F.lit(tasks)).cast("long"))
    return dealt.groupBy("task").applyInPandas(meet, "a long, b long").distinct()


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row: doc_id, ``tie`` (a hash of the text), n_shingles, and ``least``, the smallest (doc_id, tie) of its
    component, which is null for rows with an empty set or a null doc_id."""
    described = stage(describe(docs, width), "signatures")
    whole = described.filter("doc_id is not null and digest is not null")
    classes = whole.groupBy("digest").agg(F.min(F.struct("doc_id", "tie")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = stage(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    rows = stage(shared_buckets(classes), "buckets")
    sets = stage(sets_of(docs, classes.join(rows.select("rep").distinct(), "rep", "left_semi"), width), "shingles")
    links = confirm(star_pairs(rows, percent), sets, percent)
    rest = confirm(rest_pairs(rows, components(links), sets, percent), sets, percent)
    parts = stage(components(links.union(rest)), "parts")
    linked = classes.select("rep", "row").join(parts, F.col("rep") == F.col("node"))
    least = linked.groupBy("component_id").agg(F.min("row").alias("least"))
    found = parts.join(least, "component_id").select(F.col("node").alias("rep"), "least")
    by_class = classes.select("digest", "rep", "row").join(found, "rep", "left").select("digest", F.coalesce("least", "row").alias("least"))
    rows = described.select("doc_id", "tie", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return rows.join(by_class, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    component = F.coalesce("least.doc_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return groups(docs, width, percent).select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, one row for each component: its smallest doc_id, of that the smallest text hash, and of rows that
    agree in both the one with the smallest hash of all columns. Rows with an empty set or a null doc_id all stay."""
    marked = groups(docs, width, percent).filter("least is not null").select("doc_id", "tie", "least")
    keepers = marked.select("least.doc_id", "least.tie").distinct()
    grouped = marked.select("doc_id", "tie").distinct()
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.xxhash64(*plain).alias("order"), F.struct(*docs.columns).alias("row")
    )
    rows = rows.join(grouped, ["doc_id", "tie"], "left_anti").select("row").union(
        rows.join(keepers, ["doc_id", "tie"], "left_semi").groupBy("doc_id", "tie").agg(F.min_by("row", "order").alias("row")).select("row")
    )
    return rows.select("row.*")
