"""Mixing sources to target weights by a low-discrepancy schedule of slots.

1. Sources, ordered by code point with null last, weigh 1, 2, 3 and so on in turn
   and share the total of all sizes; a target stops at ``MAX_EPOCHS`` times its source's
   size and the rest goes to the others by weight.
2. A source's documents are put in a fixed random order and its words cut into blocks of
   equal length: ``BLOCK`` words, or a ``LEAST_BLOCKS``-th of a small source.
3. Slot i of the mix has the point frac(i * golden ratio). The points fall on the
   sources' shares of 0..1, so every stretch of the mix holds the sources in proportion.
   Slots are ranked per source, and the k-th takes the source's k-th block, starting over
   at the end of its blocks, ``MAX_EPOCHS`` times at most.

Only DataFrame functions. Running sums and ranks work in two steps, sums of spans and then
rows within a span, so a source that holds a third of all rows is spread over its
spans. One row per source meets in one task to share out the targets.

Defined cases: null texts have size 0 and are never taken; a null source is a source of its
own; repeated rows, and rows with null ids, are taken as rows of their own; a mix of no words
has no slots, and an empty table no rows. Order, and so the result, depends on the rows' content only. A very long text may fill
many blocks; its words are counted where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaplate.llm.tables import stage

WORD = r"[^\x20\x09-\x0D]+"
WORD_AFTER_SPACE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK = 256
LEAST_BLOCKS = 64
SPAN_DOCS = 1024
SPAN_SLOTS = 1 << 16
# The golden ratio's fraction as a 32-bit multiplier; points repeat after 2**31 slots.
GOLDEN, CYCLE, UNIT = 2654435769, 1 << 31, 1 << 32


def sized(docs: DataFrame) -> DataFrame:
    """Adds the number of words and the value that orders a source's rows."""
    order = F.xxhash64(F.lit(20240601), "doc_id", "text")
    return docs.withColumns({"__size": F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0)), "__order": order})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, block: int = BLOCK) -> DataFrame:
    """Per source: its number ``sid``, size, target, block length, blocks, and its share ``low``..``high`` of the slots."""
    sources = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*map(F.lit, weights))
    sources = sources.withColumn("sid", rank).withColumn("weight", F.element_at(turn, F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1))
    cap = F.col("source_size") * epochs
    everything = Window.partitionBy(F.lit(0))
    by_limit = everything.orderBy(cap / F.col("weight"), "sid")
    full_before = F.coalesce(F.sum(cap).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", (F.sum("source_size").over(everything) - full_before) / open_weight)
    level = F.max(F.when(cap >= F.col("level") * F.col("weight"), F.col("level"))).over(everything)
    sources = sources.withColumn("target", F.least(cap.cast("double"), level * F.col("weight")))
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    sources = sources.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("slots", slots)
    by_sid = everything.orderBy("sid")
    low = F.coalesce(F.sum("slots").over(by_sid.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sources = sources.withColumn("all_slots", F.sum("slots").over(everything)).withColumn("low", F.coalesce(F.try_divide(low, F.col("all_slots")), F.lit(0.0)))
    high = F.lead("low", 1, 1.0).over(by_sid)
    return sources.withColumn("high", high).drop("weight", "level")


def _ranked(rows: DataFrame, key: list[str], span: str, order: list, value: Column | None = None) -> DataFrame:
    """Adds ``before``: the sum of ``value`` (or count) over the earlier rows of the key, and ``pos``, the row's place
    in its span."""
    value = F.lit(1) if value is None else value
    spans = rows.groupBy(*key, span).agg(F.sum(value).alias("inside"))
    earlier = Window.partitionBy(*key).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("until", F.coalesce(F.sum("inside").over(earlier), F.lit(0))).drop("inside")
    own = Window.partitionBy(*key, span).orderBy(*order)
    inside = F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"inside": inside, "pos": F.row_number().over(own)}).join(spans, [*key, span])
    return rows.withColumn("before", F.col("until") + F.col("inside")).drop("until", "inside")


def schedule(sources: DataFrame, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The slots: number, source number, and the source's block that fills it, with its ``epoch``."""
    spark = sources.sparkSession
    total, count = sources.agg(F.coalesce(F.max("all_slots"), F.lit(0.0)), F.count("*")).first()
    cells = 4 * count + 64
    shares = sources.filter("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))))
    point = F.pmod(F.pmod(F.col("id"), F.lit(CYCLE)) * GOLDEN, F.lit(UNIT)) / UNIT
    slots = spark.range(-int(-total // 1)).select(F.col("id").alias("slot"), point.alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * cells)).join(shares, "cell").filter("point >= low and point < high")
    slots = slots.select("slot", "sid", "blocks", "length", F.expr(f"slot div {SPAN_SLOTS}").alias("span"))
    ranked = _ranked(slots, ["sid"], "span", ["slot"]).withColumns(
        {"block": F.expr("before % blocks"), "epoch": F.expr("before div blocks")}
    )
    return ranked.filter(F.col("epoch") < epochs).select("slot", "sid", "block", "epoch")


def placed(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """Adds each row's source values and ``before``, its first word's place in the source's order."""
    spans = max(1, -(-count // SPAN_DOCS))
    span = F.pmod(F.expr("shiftrightunsigned(__order, 1)"), F.lit(spans))
    joined = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    return _ranked(joined.withColumn("__span", span), ["sid"], "__span", ["__order"], F.col("__size"))


def blocks(rows: DataFrame) -> DataFrame:
    """The pieces of rows that make up the blocks: one row per document and block, with its number of words."""
    last = F.col("before") + F.col("__size") - 1
    numbers = F.when(F.col("__size") > 0, F.sequence(F.expr("before div length"), F.expr("(before + __size - 1) div length")))
    pieces = rows.withColumn("block", F.explode_outer(numbers))
    first = F.greatest(F.col("block") * F.col("length"), F.col("before"))
    stop = F.least((F.col("block") + 1) * F.col("length") - 1, last)
    return pieces.withColumns({"from": first - F.col("before"), "words": stop - first + 1})


def prepare(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Staged (doc_id, source, size, order), staged sources, and the number of rows."""
    sizes = stage(sized(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    return sizes, stage(targets(sizes), "sources"), sizes.count()


def mixture(docs: DataFrame) -> DataFrame:
    """The pieces of documents that fill each slot: slot, epoch, doc_id, source, first word and number of words.

    Every document has a row, without a slot where the mix does not take it.
    """
    sizes, sources, count = prepare(docs)
    pieces = blocks(placed(sizes, sources, count))
    return pieces.join(schedule(sources), ["sid", "block"], "left")


def taken(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    words = F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0))
    rows = mixture(docs).groupBy("sid", "__span", "pos", "doc_id", "__size", "source_size", "target").agg(words.alias("taken"))
    return rows.select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns, one row for each epoch that takes a document.

    A source's slots take its blocks in turn, so they cover whole epochs and then the first
    blocks of one more: a document's text stays whole, but for those that the end of a
    source's last block cuts.
    """
    _, sources, count = prepare(docs)
    used = stage(schedule(sources), "slots").groupBy("sid").agg(F.count("*").alias("used"))
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__doc"))  # out of the way of other names
    rows = placed(sized(packed), sources.join(used, "sid", "left").fillna(0, ["used"]), count)
    epochs = F.when(F.col("blocks") > 0, F.expr("used div blocks")).otherwise(0)
    rest = F.when(F.col("blocks") > 0, F.expr("(used % blocks) * length")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("before")))
    copies = F.concat(F.array_repeat(F.col("__size"), epochs.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.filter("__size > 0").withColumn("__words", F.explode(copies))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD_AFTER_SPACE), F.lit(0)), F.lit(1), F.col("__words").cast("int")), "")
    text = F.when(F.col("__words") == F.col("__size"), F.col("text")).otherwise(cut)
    return rows.select(*(text.alias(c) if c == "text" else F.col("__doc")[c].alias(c) for c in docs.columns))
