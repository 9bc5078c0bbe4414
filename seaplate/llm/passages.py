"""Substring dedup over words by relative Lempel-Ziv parsing.

A window is ``WIDTH`` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller id. Documents are parsed against reference blocks: pieces of text that are kept together with an
index of all their windows, by smallest document. At a place whose window the block holds for a smaller
document, the parse takes the longest stretch that both have in common, a factor, and all its windows are
duplicates. It goes on at the first window that crosses the factor's end, since that one may be found
elsewhere; at a place without such a window it moves on by one word. Factors are compared byte by byte.

Which block a piece goes to. Of the runs of ``GRAM`` words within a window, the one with the smallest hash (the first of
equals) is its anchor. Equal windows have equal anchors at equal places, so a stretch of windows with one anchor is a piece, and
the blocks are dealt by anchor: a document meets every block that can hold one of its windows, and no other. Groups of
whole documents exchange packed messages with the blocks, each distinct piece once per group:

1. all anchors: is it held by several documents, and how many distinct pieces hold it?
2. pieces with a shared anchor, with their bytes, are parsed in their blocks. Anchors of more than ``HOT`` pieces, a passage in
   very many contexts, would gather in one block: of those, only the hashes of their windows are sent, spread by hash.
3. such windows as are held by several documents, with their bytes and once per group, are pieces of their own, dealt
   by their hash, and are parsed in the same way.

Hashes only choose what is compared; every duplicate has been compared byte by byte.

Defined cases: null, empty and short texts have no window and lose nothing; a null id counts as smaller than any
other; rows of one id do not take words from each other; identical rows are spread over groups by the input's
partitions; an empty table gives no rows; other columns are left aside. A very long text is handled by one task of each
round, which holds it several times over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.llm import kernels as k
from seaplate.llm.tables import in_order, split_by_shard, unpack

WIDTH = 50
GRAM = 8
REACH = WIDTH - GRAM + 1
HOT = 4096
GROUP_BYTES = 4 << 20
GROUPS_PER_TASK = 4
NO_ID = np.iinfo(np.int64).min
LOW = np.uint64(63)
ANCHOR = np.dtype([("g", "<u8"), ("n", "<u2"), ("many", "u1")])
PIECE = np.dtype([("doc", "<i8"), ("size", "<u4")])
SENT = "shard int, bucket int, kind string, blob binary"
REPLY = "bucket int, shard int, kind string, reply binary"
NOT_WHITE = ~k.WHITE


def document_groups(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text in UTF-8, bucket), dealt by bucket, and the number of tasks. A bucket is a group of whole documents of
    about ``group_bytes``; identical rows of different input partitions come to different groups."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // group_bytes))
    tasks = max(-(-buckets // GROUPS_PER_TASK), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket).repartition(tasks, "bucket"), tasks


def word_buffer(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the rows in order, each followed by one space, in one buffer; the words' starts, with the buffer's
    length at the end; and the number of words of each row."""
    buffer = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])]).astype(np.int64)
    s, e = k.runs(NOT_WHITE[buffer])
    counts = np.diff(np.searchsorted(s, at))
    keep = NOT_WHITE[buffer]
    keep[e] = True
    out = buffer[keep]
    starts = np.concatenate([[0], np.cumsum(e - s + 1)]).astype(np.int64)
    out[starts[1:] - 1] = 32
    return out, starts, counts


class Group:
    """The words of one bucket's documents, cut into pieces: stretches of windows ``low`` to ``high`` with one anchor. The
    blocks answer by position, so the pieces have the same order in every round."""

    def __init__(self, table: pa.Table):
        table = in_order(table)
        self.bucket = table.column("bucket")[0].as_py()
        ids = table.column("doc_id")
        self.ids = ids
        self.doc_ids = ids.fill_null(NO_ID).to_numpy()
        self.buffer, self.starts, self.counts = word_buffer([b"" if x is None else x for x in table.column("text").to_pylist()])
        self.ends = np.cumsum(self.counts)
        self._cut()

    def _cut(self) -> None:
        words = k.run_hashes(self.buffer, self.starts[:-1], self.starts[1:])
        grams = k.sequence_hashes(words, GRAM) & ~LOW
        least, step = grams if len(words) >= WIDTH else grams[:0], 1
        while step * 2 <= REACH:
            least = np.minimum(least[:-step], least[step:] + k.U64(step))
            step *= 2
        rest = REACH - step
        if rest and len(least):
            least = np.minimum(least[:-rest], least[rest:] + k.U64(rest))
        p = np.arange(len(least))
        doc = np.searchsorted(self.ends, p, "right")
        inside = p + WIDTH <= self.ends[np.minimum(doc, len(self.ends) - 1)]
        p, doc = p[inside], doc[inside]
        anchor = p + (least[p] & LOW).astype(np.int64)
        first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        self.low, self.anchor, self.doc = p[first], anchor[first], doc[first]
        self.high = p[np.append(first[1:], len(p)) - 1] if len(p) else p
        self.g = grams[self.anchor]
        self.owner = self.doc_ids[self.doc]

    def bytes_of(self, low: int, high: int) -> bytes:
        """The words of the windows ``low`` to ``high``, without the last space."""
        return self.buffer[self.starts[low] : self.starts[high + WIDTH] - 1].tobytes()

    def distinct(self, low: np.ndarray, high: np.ndarray, owner: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct texts of the given stretches, the text of each stretch, and the smallest owner of each text."""
        found: dict[bytes, int] = {}
        which = np.array([found.setdefault(self.bytes_of(a, b), len(found)) for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.int64)
        least = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(least, which, owner)
        return list(found), which, least

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of the given pieces: their starts, hashes, and owners."""
        n = self.high[rows] - self.low[rows] + 1
        own = np.repeat(rows, n)
        starts = self.low[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hashes = k.run_hashes(self.buffer, self.starts[starts], self.starts[starts + WIDTH]) if len(starts) else np.empty(0, np.uint64)
        return starts, hashes, self.owner[own]


def anchors_of(group: Group) -> np.ndarray:
    """Each anchor once: its number of distinct pieces, and whether several documents hold it."""
    key = k.run_hashes(group.buffer, group.starts[group.low], group.starts[group.high + WIDTH]) if len(group.low) else np.empty(0, np.uint64)
    order = np.lexsort((key, group.g))
    g, key, owner = group.g[order], key[order], group.owner[order]
    first = np.flatnonzero(np.diff(g, prepend=~g[:1])) if len(g) else order
    out = np.empty(len(first), ANCHOR)
    if len(first):
        new = np.ones(len(g), np.int64)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        out["g"] = g[first]
        out["n"] = np.minimum(np.add.reduceat(new, first), 65535)
        out["many"] = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    return out


def shared_windows(starts: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each window hash once, in order; the lowest bit tells whether several documents hold it."""
    order = np.argsort(hashes, kind="stable")
    h, owner = hashes[order] & ~k.U64(1), owner[order]
    if not len(h):
        return h
    first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
    return h[first] | (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)).astype(np.uint64)


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split(" ") for c in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _packed(texts: list[bytes], least: np.ndarray, shard: np.ndarray, bucket: int, kind: str) -> list[tuple]:
    """One compressed blob of pieces per block, in the order of the texts."""
    pack = zstandard.ZstdCompressor(level=1)
    out = []
    for s in np.unique(shard).tolist():
        own = np.flatnonzero(shard == s)
        head = np.empty(len(own), PIECE)
        head["doc"], head["size"] = least[own], [len(texts[i]) for i in own]
        out.append((s, bucket, kind, pack.compress(len(own).to_bytes(8, "little") + head.tobytes() + b"".join(texts[i] for i in own.tolist()))))
    return out


class Replies:
    """What the blocks have answered to one group, by kind and shard."""

    def __init__(self, table: pa.Table):
        columns = (table.column(c).to_pylist() for c in ("kind", "shard", "reply"))
        self.found = {(kind, shard): reply for kind, shard, reply in zip(*columns, strict=True)}

    def spread(self, kind: str, shard: np.ndarray, dtype: str) -> np.ndarray:
        """The answers to messages that were dealt by ``shard``, each shard's in order."""
        out = np.zeros(len(shard), dtype)
        for s in np.unique(shard).tolist():
            reply = np.frombuffer(self.found.get((kind, s), b""), dtype)
            if len(reply):
                out[shard == s] = reply
        return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes % np.uint64(shards)).astype(np.int64)


class State:
    """What is known of a group's pieces after the replies so far."""

    def __init__(self, group: Group, replies: Replies, shards: int):
        self.group, self.replies, self.shards = group, replies, shards
        self.anchors = anchors_of(group)
        shard = shard_of(self.anchors["g"] >> k.U64(6), shards)
        answer = replies.spread("anchors", shard, "u1")
        at = np.searchsorted(self.anchors["g"], group.g)
        known = answer[at] if len(at) else np.empty(0, np.uint8)
        self.cold, self.hot = np.flatnonzero(known == 1), np.flatnonzero(known == 2)

    def pieces(self):
        """Distinct pieces with a shared anchor that is not hot: texts, the text of each piece, smallest owners, blocks."""
        group, rows = self.group, self.cold
        texts, which, least = group.distinct(group.low[rows], group.high[rows], group.owner[rows])
        shard = np.zeros(len(texts), np.int64)
        shard[which] = shard_of(group.g[rows] >> k.U64(6), self.shards)
        return texts, which, least, shard

    def hot_hashes(self):
        """Windows of hot anchors, and their distinct hashes with the mark of several owners."""
        starts, hashes, owner = self.group.windows(self.hot)
        return starts, hashes, owner, shared_windows(starts, hashes, owner)

    def hot_pieces(self):
        """Windows of hot anchors that several documents hold, as pieces: starts, texts, the text of each, owners, blocks."""
        starts, hashes, owner, marked = self.hot_hashes()
        key = marked >> k.U64(1)
        answer = self.replies.spread("windows", shard_of(key, self.shards), "u1") > 0
        some = answer[np.searchsorted(key, hashes >> k.U64(1))] if len(key) else np.zeros(0, bool)
        starts, hashes, owner = starts[some], hashes[some], owner[some]
        texts, which, least = self.group.distinct(starts, starts, owner)
        shard = np.zeros(len(texts), np.int64)
        shard[which] = shard_of(hashes >> k.U64(1), self.shards)
        return starts, texts, which, least, shard, owner


def send_anchors(table: pa.Table, shards: int) -> pa.Table:
    group = Group(table)
    anchors = anchors_of(group)
    return _table([(s, group.bucket, "anchors", blob) for s, blob in split_by_shard(anchors, anchors["g"] >> k.U64(6), shards)], SENT)


def answer_anchors(table: pa.Table) -> list[tuple]:
    """Per anchor 0, 1 if several documents hold it, or 2 if besides it is in very many pieces."""
    rows, sizes = unpack(table.column("blob").to_pylist(), ANCHOR)
    order = np.argsort(rows["g"], kind="stable")
    g = rows["g"][order]
    first = np.flatnonzero(np.diff(g, prepend=~g[:1])) if len(g) else order
    count = np.diff(np.append(first, len(g)))
    shared = (count > 1) | (np.maximum.reduceat(rows["many"][order], first) > 0)
    hot = np.add.reduceat(rows["n"][order].astype(np.int64), first) > HOT
    answer = np.empty(len(g), np.uint8)
    answer[order] = np.repeat(shared.astype(np.uint8) + (shared & hot), count)
    return _answers(table, answer, sizes)


def answer_windows(table: pa.Table) -> list[tuple]:
    """Per window hash whether several documents hold it."""
    rows, sizes = unpack(table.column("blob").to_pylist(), np.dtype("<u8"))
    key = rows >> k.U64(1)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=~key[order][:1])) if len(key) else order
    count = np.diff(np.append(first, len(key)))
    shared = (count > 1) | (np.maximum.reduceat(rows[order] & k.U64(1), first) > 0)
    answer = np.empty(len(key), np.uint8)
    answer[order] = np.repeat(shared, count)
    return _answers(table, answer, sizes)


def _answers(table: pa.Table, answer: np.ndarray, sizes: np.ndarray) -> list[tuple]:
    ends = np.cumsum(sizes)
    columns = (table.column(c).to_pylist() for c in ("bucket", "shard", "kind"))
    return [(b, s, kind, answer[e - n : e].tobytes()) for b, s, kind, e, n in zip(*columns, ends, sizes, strict=True)]


class Block:
    """A reference block: pieces with their owners, and the windows in them by hash and owner."""

    def __init__(self, texts: list[bytes], owner: np.ndarray):
        self.owner = owner
        self.buffer, self.starts, counts = word_buffer(texts)
        self.words = k.run_hashes(self.buffer, self.starts[:-1], self.starts[1:])
        self.end = np.cumsum(counts)
        self.begin = self.end - counts
        n = counts - WIDTH + 1
        self.piece = np.repeat(np.arange(len(counts)), n)
        self.at = self.begin[self.piece] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hashes = k.sequence_hashes(self.words, WIDTH)[self.at]
        order = np.lexsort((owner[self.piece], hashes))
        self.hashes, self.at, self.piece = hashes[order], self.at[order], self.piece[order]
        first = np.flatnonzero(np.diff(self.hashes, prepend=~self.hashes[:1]))
        slot = np.repeat(first, np.diff(np.append(first, len(self.hashes))))
        places = len(self.words)
        self.slot = np.zeros(places, np.int64)  # of the smallest owner of the window at a place
        self.slot[self.at] = slot
        hit = np.full(places + 1, places)
        smaller = self.at[owner[self.piece[slot]] < owner[self.piece]]
        hit[smaller] = smaller
        self.next_hit = np.minimum.accumulate(hit[::-1])[::-1]

    def same(self, a: int, b: int, n: int) -> bool:
        """Whether the n words from a and from b on are the same bytes."""
        s = self.starts
        return self.buffer[s[a] : s[a + n]].tobytes() == self.buffer[s[b] : s[b + n]].tobytes()

    def extend(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The number of words, from ``WIDTH`` on, that are equal from places a and b on, and at most ``most``."""
        length = np.minimum(most, WIDTH)
        while True:
            more = length < most
            more[more] = self.words[a[more] + length[more]] == self.words[b[more] + length[more]]
            if not more.any():
                return length
            length = length + more

    def parse(self) -> np.ndarray:
        """Per piece a mask of its windows that start in a document with a smaller id; all pieces are parsed side by side."""
        masks = np.zeros(len(self.owner), np.uint64)
        own = np.arange(len(self.owner))
        place, last = self.begin.copy(), self.end - WIDTH
        while True:
            place[own] = self.next_hit[place[own]]
            own = own[place[own] <= last[own]]
            if not len(own):
                return masks
            here = place[own]
            low = self.slot[here]
            ref = self.at[low]
            length = self.extend(here, ref, np.minimum(self.end[own] - here, self.end[self.piece[low]] - ref))
            for i, a, b, n, slot in zip(own.tolist(), here.tolist(), ref.tolist(), length.tolist(), low.tolist(), strict=True):
                if not self.same(a, b, n):
                    n = WIDTH if self._elsewhere(i, a, slot) else 0
                windows = max(n - WIDTH + 1, 0)
                masks[i] |= np.uint64(((1 << windows) - 1) << (a - int(self.begin[i])))
                place[i] = a + max(windows, 1)

    def _elsewhere(self, piece: int, a: int, slot: int) -> bool:
        """Whether another window of the same hash, of a smaller document, is the one at a."""
        wanted = self.hashes[slot]
        while slot < len(self.hashes) and self.hashes[slot] == wanted and self.owner[self.piece[slot]] < self.owner[piece]:
            if self.same(a, int(self.at[slot]), WIDTH):
                return True
            slot += 1
        return False


def answer_pieces(table: pa.Table) -> list[tuple]:
    """Per piece the mask of its duplicate windows, from this block."""
    unpacked = zstandard.ZstdDecompressor()
    texts, owners, sizes = [], [], []
    for blob in table.column("blob").to_pylist():
        blob = unpacked.decompress(blob)
        n = int.from_bytes(blob[:8], "little")
        head = np.frombuffer(blob, PIECE, n, 8)
        ends = 8 + n * PIECE.itemsize + np.cumsum(head["size"].astype(np.int64))
        texts += [blob[e - m : e] for e, m in zip(ends.tolist(), head["size"].tolist(), strict=True)]
        owners.append(head["doc"])
        sizes.append(n)
    return _answers(table, Block(texts, np.concatenate(owners)).parse(), np.array(sizes)) if texts else []


ANSWERS = {"anchors": answer_anchors, "windows": answer_windows, "pieces": answer_pieces, "hot": answer_pieces}


def answer(table: pa.Table) -> pa.Table:
    """One block's answers to what the groups have sent."""
    kinds = np.array(table.column("kind").to_pylist())
    out = []
    for kind in np.unique(kinds).tolist():
        out += ANSWERS[kind](table.filter(pa.array(kinds == kind)))
    return _table(out, REPLY)


def send_pieces(table: pa.Table, replies: pa.Table, shards: int) -> pa.Table:
    group = Group(table)
    state = State(group, Replies(replies), shards)
    texts, _, least, shard = state.pieces()
    *_, marked = state.hot_hashes()
    sent = _packed(texts, least, shard, group.bucket, "pieces")
    sent += [(s, group.bucket, "windows", blob) for s, blob in split_by_shard(marked, marked >> k.U64(1), shards)]
    return _table(sent, SENT)


def send_hot(table: pa.Table, replies: pa.Table, shards: int) -> pa.Table:
    group = Group(table)
    _, texts, _, least, shard, _ = State(group, Replies(replies), shards).hot_pieces()
    return _table(_packed(texts, least, shard, group.bucket, "hot"), SENT)


def remove(table: pa.Table, replies: pa.Table, shards: int) -> pa.Table:
    """The documents without the words of duplicate windows."""
    group = Group(table)
    found = Replies(replies)
    state = State(group, found, shards)
    cover = np.zeros(len(group.starts), np.int32)
    _, which, least, shard = state.pieces()
    masks = found.spread("pieces", shard, "<u8")[which]
    masks[group.owner[state.cold] > least[which]] = ~np.uint64(0)  # the whole piece is in a smaller document of the group
    n = (group.high - group.low + 1)[state.cold]
    for offset in range(int(n.max()) if len(n) else 0):
        hit = state.cold[(n > offset) & (masks >> np.uint64(offset) & np.uint64(1) > 0)]
        cover[group.low[hit] + offset] = 1
    starts, _, which, least, shard, owner = state.hot_pieces()
    later = (found.spread("hot", shard, "<u8")[which] > 0) | (owner > least[which])
    cover[starts[later]] = 1
    edges = np.zeros(len(group.starts) + WIDTH, np.int32)
    at = np.flatnonzero(cover)
    edges[at] += 1
    edges[at + WIDTH] -= 1
    gone = np.cumsum(edges)[: len(group.starts) - 1] > 0
    kept_bytes = np.repeat(~gone, np.diff(group.starts))
    out = []
    for end, count in zip(group.ends.tolist(), group.counts.tolist(), strict=True):
        own = gone[end - count : end]
        s, e = k.runs(own)
        part = slice(int(group.starts[end - count]), int(group.starts[end]))
        kept = group.buffer[part][kept_bytes[part]].tobytes()[:-1]
        out.append((count, int(own.sum()), [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)], kept))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), spans, pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.table([group.ids.cast(pa.int64()), *columns], ["doc_id", "n_words", "n_removed", "spans", "kept"])


def remove_passages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, the removed ``spans`` of words, and the ``kept`` words in UTF-8, joined
    by one space."""
    grouped, tasks = document_groups(docs)
    texts = grouped.groupBy("bucket")

    def meet(sent: DataFrame) -> DataFrame:
        return sent.repartition(tasks, "shard").groupBy("shard").applyInArrow(answer, REPLY).repartition(tasks, "bucket")

    def with_replies(step, schema: str) -> DataFrame:
        return texts.cogroup(replies.groupBy("bucket")).applyInArrow(lambda t, r: step(t, r, tasks), schema)

    replies = meet(texts.applyInArrow(lambda t: send_anchors(t, tasks), SENT))
    replies = replies.union(meet(with_replies(send_pieces, SENT)))
    replies = replies.union(meet(with_replies(send_hot, SENT)))
    return with_replies(remove, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def summary(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
