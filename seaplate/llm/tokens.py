"""Token-id files: documents encoded in id order, ids stored as compressed byte or bit planes with a chunk index.

File format. A folder holds one Parquet file per shard (Spark writes and commits it,
so a lost executor's file is written again and never half read), with a row per
chunk. A chunk is a run of whole documents with at least ``CHUNK_IDS`` ids, apart
from a shard's last. Its ids are cut into blocks of ``BLOCK_IDS``, the last one
padded with zeros. Within a block the ids, as little-endian unsigned 32-bit
integers, are transposed into 4 byte planes or 32 bit planes; each plane of all
blocks of the chunk is compressed by itself with zstandard, and a plane of zeros
only is stored as an empty value. Columns: shard and chunk (order), planes, kind,
n_ids, crc32 of the ids, and the documents' ids and lengths in order. Beside the data,
the folder's ``index`` has a row per chunk without the planes: shard, chunk, first and last
doc_id, documents, ids, and the first id's place in the whole sequence.

Order: ascending doc_id, null first, rows of equal doc_id by text. Null texts count as
empty: only the end id is written. The tokenizer file is a parameter and must exist at the
same path on all executors; the tokenizer is loaded once per task process.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seaplate.llm import kernels as k
from seaplate.llm.tables import long_ids, text_ids

END_ID = 1
BLOCK_IDS = 8192
CHUNK_IDS = 1 << 17
CACHE = 400_000
LEVEL = 3
DATA = "shard int, chunk int, kind string, n_ids long, crc32 long, doc_ids array<long>, lengths array<int>, planes array<binary>"
JOINED = 512
# Fixed values of the tokenizer file: its split pattern over lower-cased text up to U+017F, written out, where all
# characters are composed already and lower-cased one by one, so that the pattern may run here.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
LETTER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f"
NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
BEYOND = re.compile("[^\x00-\u017f]")
WORD_END = "</w>"


class Slots(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Encodes texts, with the ids of each distinct word worked out once.

    The tokenizer composes, lower-cases, splits into words and merges within each
    word, so a word's ids do not depend on its surroundings, and the last of them
    ends a word. Texts with characters beyond U+017F, or with something like a
    special token, go through the tokenizer whole. The cache is emptied when it
    holds ``CACHE`` words.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.slots = Slots()
        self.slots.new = []
        self.ends, self.flat = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        new, self.slots.new = self.slots.new, []
        parts, sizes = [self.flat], []
        groups = [new[i : i + JOINED] for i in range(0, len(new), JOINED)]
        for words, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids) - 1):
                own = [np.array(x, np.uint32) for x in self._ids(words)]
                ids, ends = np.concatenate(own), np.cumsum([len(x) for x in own]) - 1
            parts.append(ids)
            sizes.append(np.diff(ends, prepend=-1))
        if new:
            self.flat = np.concatenate(parts)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, without end ids, and the number of ids of each."""
        if len(self.slots) > CACHE:
            self.clear()
        whole = ["<|" in t or not t.isascii() and BEYOND.search(t) is not None for t in texts]
        slots, counts = [], []
        for text, w in zip(texts, whole, strict=True):
            pieces = [] if w else PIECES.findall(text.lower())
            slots.append(np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces)))
            counts.append(len(pieces))
        if self.slots.new:
            self._learn()
        slot = np.concatenate(slots)
        first, sizes = self.ends[slot], self.ends[slot + 1] - self.ends[slot]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
        cuts = np.cumsum([0, *counts])
        lengths = upto[cuts[1:]] - upto[cuts[:-1]]
        if any(whole):
            rows = np.split(ids, np.cumsum(lengths)[:-1])
            at = [i for i, w in enumerate(whole) if w]
            for i, own in zip(at, self._ids([texts[i] for i in at]), strict=True):
                rows[i] = np.array(own, np.uint32)
            ids, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
        return ids, lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
    return WordEncoder(path)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Transposes blocks of ids into planes and compresses each."""
    blocks = np.zeros(-(-len(ids) // BLOCK_IDS) * BLOCK_IDS, "<u4")
    blocks[: len(ids)] = ids
    cells = blocks.view(np.uint8).reshape(-1, BLOCK_IDS, 4)
    if kind == "bit":
        cells = np.unpackbits(cells, axis=2, bitorder="little")
    planes = np.moveaxis(cells, 2, 0)
    if kind == "bit":
        planes = np.packbits(planes, axis=2, bitorder="little")
    pack = zstandard.ZstdCompressor(level=LEVEL)
    return [pack.compress(p.tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    width = BLOCK_IDS // 8 if kind == "bit" else BLOCK_IDS
    blocks = -(-n // BLOCK_IDS)
    unpack = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unpack.decompress(p), np.uint8) if p else np.zeros(blocks * width, np.uint8) for p in planes]
    cells = np.stack(rows).reshape(len(planes), blocks, width)
    if kind == "bit":
        cells = np.unpackbits(cells, axis=2, bitorder="little")
    cells = np.moveaxis(cells, 0, 2)
    if kind == "bit":
        cells = np.packbits(cells, axis=2, bitorder="little")
    return np.ascontiguousarray(cells).view("<u4").reshape(-1)[:n]


def _chunks(batches: Iterator[pd.DataFrame], path: str, kind: str) -> Iterator[pd.DataFrame]:
    shard, chunk = TaskContext.get().partitionId(), 0
    docs, lengths, held, size = [], [], [], 0

    def row():
        ids = np.concatenate(held)
        values = (shard, chunk, kind, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), docs, lengths, to_planes(ids, kind))
        return pd.DataFrame([values], columns=["shard", "chunk", "kind", "n_ids", "crc32", "doc_ids", "lengths", "planes"])

    for pdf in batches:
        texts = [t or "" for t in pdf["text"]]
        keys = [None if null else int(x) for x, null in zip(pdf["doc_id"], pdf["doc_id"].isna(), strict=True)]
        for cut in k.slices(texts):
            ids, counts = encoder(path).encode(texts[cut])
            ids = np.insert(ids, np.cumsum(counts), END_ID)
            counts = (counts + 1).tolist()
            at = 0
            for key, n in zip(keys[cut], counts, strict=True):
                docs.append(key)
                lengths.append(n)
                held.append(ids[at : at + n])
                at += n
                size += n
                if size >= CHUNK_IDS:
                    yield row()
                    chunk += 1
                    docs, lengths, held, size = [], [], [], 0
    if docs:
        yield row()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte") -> None:
    """Encode every document and write data and index below ``folder``; the end id follows each document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    data = text_ids(rows, "text").mapInPandas(lambda batches: _chunks(batches, tokenizer, kind), DATA)
    data.write.option("compression", "uncompressed").parquet(f"{folder}/data")
    chunks = spark.read.parquet(f"{folder}/data").select(
        "shard", "chunk", "n_ids", F.size("doc_ids").alias("n_docs"),
        F.col("doc_ids")[0].alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"),
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("shard_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))
    chunks.join(shards, "shard").select(*chunks.columns, start.alias("start")).write.parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)
    and their unsigned crc32. A chunk whose ids do not give its crc32 is an error."""

    def task(batches):
        for pdf in batches:
            for chunk in pdf.itertuples(index=False):
                ids = from_planes(list(chunk.planes), int(chunk.n_ids), chunk.kind)
                if zlib.crc32(ids.tobytes()) != chunk.crc32:
                    raise ValueError(f"shard {chunk.shard}, chunk {chunk.chunk}: the ids do not match their crc32")
                lengths = np.asarray(chunk.lengths, np.int64)
                ends = np.cumsum(lengths)
                own = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield pd.DataFrame(
                    {
                        "doc_id": list(chunk.doc_ids),
                        "start": ends - lengths + chunk.start,
                        "n_tokens": lengths,
                        "ids_crc32": [zlib.crc32(x) for x in own],
                        "ids": own,
                    }
                )

    data = spark.read.schema(DATA).parquet(f"{folder}/data").withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))
    index = spark.read.parquet(f"{folder}/index").select("shard", "chunk", "start")
    return long_ids(data.join(index, ["shard", "chunk"]).mapInPandas(task, "doc_id string, start long, n_tokens long, ids_crc32 long, ids binary"))
