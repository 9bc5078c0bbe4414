"""Line dedup: frequent lines are looked up in a sharded minimal perfect hash, not joined.

The hashes of distinct long lines are dealt to shards. A shard builds a minimal
perfect hash of its hashes, level by level: a hash takes the bit it falls on if
no other falls there, the rest go on to the next level, and a hash's place is
the number of taken bits before its own. Compact arrays by place hold a
fingerprint, the number of documents and the largest document id. Groups of
documents send their distinct hashes, each once however often a line occurs, and
are answered with those that reach the limit. Rows of a doc_id that several rows hold may lie in
several groups; their hashes are sent with the id, and a shard counts each id once.

Defined cases: a null or empty text is one empty line; rows of one doc_id are one
document, whatever their texts, each row with lines of its own; rows that share the largest doc_id of a line all keep
it; a null doc_id is smaller than any other, and each row with one a document; a line feed at the end makes
a last empty line; lines shorter than ``min_chars`` always stay; a very long text is one task's; an empty table gives
no rows; only doc_id and text are read, whatever else the table holds. Lines are
identified by 64 bits plus a 32-bit fingerprint of one 128-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.llm import kernels as k
from seaplate.llm.tables import by_shard, document_groups, long_ids, split_by_shard, stage, text_ids, unpack

MIN_CHARS = 40
MIN_DOCS = 5
WHITE = b" \t\n\x0b\x0c\r"
LINE = np.dtype([("h", "<u8"), ("print", "<u4"), ("n", "<u4"), ("last", "<i8")])
REPLY = np.dtype([("h", "<u8"), ("print", "<u4"), ("last", "<i8")])
NO_ID = np.iinfo(np.int64).min
SCHEMA = "doc_id string, n_lines long, n_dropped long, kept string"
SPREAD = 2


@dataclass
class PerfectHash:
    """Per level: its number of bits, the taken bits in words, and taken bits before each word."""

    levels: list[tuple[int, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, before, rest = [], 0, hashes
        while len(rest):
            bits = max(64, -(-SPREAD * len(rest) // 64) * 64)
            at = _bit(rest, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            levels.append((bits, words, before + np.cumsum(ones) - ones))
            before += int(ones.sum())
            rest = rest[~alone[at]]
        return cls(levels)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """0..n-1 for the hashes it was built from; another hash gets some place or -1."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (bits, words, before) in enumerate(self.levels):
            at = _bit(hashes[open_], level, bits)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            taken = (word >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[taken]] = (before[at >> 6] + under)[taken]
            open_ = open_[~taken]
        return out


def _bit(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (k.mix(hashes + np.uint64((level + 1) * k.STEP % (1 << 64))) % np.uint64(bits)).astype(np.int64)


@dataclass
class LineIndex:
    """Fingerprints, document counts and largest ids of one shard's lines, by perfect hash."""

    places: PerfectHash
    prints: np.ndarray
    counts: np.ndarray
    last: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray) -> LineIndex:
        """A row counts for ``n`` documents, or with an ``n`` of 0 for document ``last``, however often that comes."""
        distinct = np.unique(rows["h"])
        places = PerfectHash.build(distinct)
        at = places.place(rows["h"])
        out = cls(places, np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64), np.full(len(distinct), NO_ID))
        out.prints[at] = rows["print"]
        np.add.at(out.counts, at, rows["n"])
        several = np.unique(rows[rows["n"] == 0])
        np.add.at(out.counts, places.place(several["h"]), 1)
        np.maximum.at(out.last, at, rows["last"])
        return out

    def probe(self, rows: np.ndarray, min_docs: int) -> np.ndarray:
        """Of the given lines, those in at least ``min_docs`` documents."""
        at = self.places.place(rows["h"])
        known = at >= 0
        known[known] = (self.prints[at[known]] == rows["print"][known]) & (self.counts[at[known]] >= min_docs)
        out = np.empty(int(known.sum()), REPLY)
        out["h"], out["print"], out["last"] = rows["h"][known], rows["print"][known], self.last[at[known]]
        return out


def line_key(line: str, min_chars: int) -> int | None:
    """The 128-bit hash of a line's key, or None if the key is short."""
    key = line.strip(WHITE.decode())
    return xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None


def _ids(pdf: pd.DataFrame) -> list[int]:
    return [NO_ID if null else int(x) for x, null in zip(pdf["doc_id"], pdf["doc_id"].isna(), strict=True)]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines before dropping, n_dropped, and the kept text."""
    texts = text_ids(docs, "text")
    again = texts.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    again = stage(again.select("doc_id", F.lit(True).alias("again")), "repeated")
    grouped, tasks = document_groups(texts)

    def send(pdf, shards):
        found: dict[tuple[int, int | None], list] = {}
        for doc, text, several in zip(_ids(pdf), pdf["text"], pdf["again"].notna(), strict=True):
            for key in {line_key(x, min_chars) for x in (text or "").split("\n")} - {None}:
                entry = found.setdefault((key, doc if several else None), [0, NO_ID])
                entry[0] += not several
                entry[1] = max(entry[1], doc)
        rows = np.array([(key >> 64, key & 0xFFFFFFFF, n, last) for (key, _), (n, last) in found.items()], LINE)
        sent = split_by_shard(rows, rows["h"], shards)
        return pd.DataFrame({"shard": [s for s, _ in sent], "bucket": pdf["bucket"].iloc[0], "blob": [b for _, b in sent]})

    def answer(pdf):
        rows, sizes = unpack(pdf["blob"], LINE)
        index = LineIndex.build(rows)
        cuts = np.cumsum(sizes)
        replies = [index.probe(rows[b - n : b], min_docs).tobytes() for b, n in zip(cuts, sizes, strict=True)]
        return pd.DataFrame([(b, r) for b, r in zip(pdf["bucket"], replies, strict=True) if r], columns=["bucket", "reply"])

    def drop(texts, replies):
        rows, _ = unpack(replies["reply"], REPLY)
        last = {(h, p): doc for h, p, doc in rows.tolist()}
        out = []
        for doc, text, null in zip(_ids(texts), texts["text"], texts["doc_id"].isna(), strict=True):
            lines = (text or "").split("\n")
            kept = []
            for line in lines:
                key = line_key(line, min_chars)
                if key is None or last.get((key >> 64, key & 0xFFFFFFFF), doc) == doc:
                    kept.append(line)
            out.append((None if null else str(doc), len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(out, columns=["doc_id", "n_lines", "n_dropped", "kept"])

    replies = by_shard(grouped.join(again, "doc_id", "left"), tasks, send, answer).repartition(tasks, "bucket")
    return long_ids(grouped.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInPandas(drop, SCHEMA))


def summary(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
