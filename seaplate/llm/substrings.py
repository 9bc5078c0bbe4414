"""Removal of repeated byte strings by a distributed, hash-compared suffix sort.

Texts count as UTF-8 bytes. A byte goes if a string of ``LENGTH`` bytes that covers it also starts
earlier: in a smaller doc_id, or earlier in the same document.

Which suffixes are compared. Among the ``GRAM``-byte strings within a string of ``LENGTH`` bytes, the one with the
smallest hash (the first of equals) is its anchor. Equal strings have equal anchors at equal places, so only
strings with a common anchor need comparing. Neighbouring starts that share an anchor form a segment, and equal segments a
class, of which only the first can be new.

Groups of whole documents exchange packed messages in three rounds, and take their texts up again in each:

1. every anchor, once per group: is it found elsewhere, and in unequal segments?
2. classes with an anchor found elsewhere: which group holds the class's first segment? All later ones are repeats.
3. first segments whose anchor is in unequal ones too, with their bytes: which of their strings start earlier in another?

Round 3 sorts suffixes. The suffixes that may be equal, those with the same anchor and distance from
it, are merge-sorted together; two suffixes are compared by binary search over prefix polynomial hashes
for the length of their common extension, then by the byte after it. Suffixes equal over ``LENGTH`` bytes end up
side by side, are compared byte by byte against hash collisions, and all but the earliest are repeats. Anchors
in more than ``HOT`` unequal segments send hashes of their strings instead, which are combined per group and
spread by hash, so a passage of a third of all documents meets in no single task.

Defined cases: null and empty texts, and texts shorter than ``LENGTH``, lose nothing to others but count as
documents; rows with the same doc_id are ordered by a hash of their text, identical ones arbitrarily, so one
of them is earlier; a null doc_id counts as smaller than any other. A very long text is one task's, hashed in
pieces of ``PIECE`` bytes; an empty table gives no rows; only doc_id and text are read, whatever else the table holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.llm import kernels as k
from seaplate.llm.tables import document_groups, in_order, split_by_shard, unpack

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM + 1
PIECE = 1 << 17
HOT = 4096
NO_ID = np.iinfo(np.int64).min
LOW = np.uint64(127)

ANCHOR = np.dtype([("g", "<u8"), ("key", "<u8"), ("n", "<u2"), ("many", "u1")])
KNOWN = np.dtype([("g", "<u8"), ("mixed", "u1"), ("hot", "u1")])
PLACE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("sub", "<u8"), ("pos", "<u4")])
HEAD = np.dtype([("g", "<u8"), ("key", "<u8"), ("doc", "<i8"), ("sub", "<u8"), ("pos", "<u4"), ("left", "u1"), ("n", "u1")])
MASK = np.dtype([("key", "<u8"), ("bits", "u1", (9,))])
SENT = "shard int, bucket int, kind string, blob binary"
REPLY = "bucket int, kind string, reply binary"


class Group:
    """The documents of one bucket in one buffer, in the same order in every round, with their segments."""

    def __init__(self, table: pa.Table):
        table = in_order(table.select(["doc_id", "text"])).combine_chunks()
        self.table, text = table, table.column("text").chunk(0) if table.num_rows else pa.array([], pa.binary())
        ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.doc_ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        rows = [b"" if v is None else v for v in text.to_pylist()]
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.rows, self.buffer = rows, np.frombuffer(b"".join(rows), np.uint8)
        self.sub = self._subs()
        self._segments()

    def _subs(self) -> np.ndarray:
        """Orders rows of one doc_id: 56 bits of the text's hash, then a running number."""
        seen: dict = {}
        out = np.empty(len(self.rows), np.uint64)
        for i, (doc, row) in enumerate(zip(self.doc_ids.tolist(), self.rows, strict=True)):
            mark = (doc, hash_of(row))
            seen[mark] = n = seen.get(mark, -1) + 1
            out[i] = mark[1] << 8 | min(n, 255)
        return out

    def _segments(self) -> None:
        parts = []
        for start in range(0, max(0, len(self.buffer) - LENGTH + 1), PIECE):
            piece = self.buffer[start : start + PIECE + LENGTH - 1]
            sums = k.prefix(piece)
            down = k.powers(len(piece))[1]
            n = len(piece) - GRAM + 1
            g = k.mix((sums[GRAM:] - sums[:-GRAM]) * down[:n]) & ~LOW
            least, step = g, 1
            while step * 2 <= REACH:
                least = np.minimum(least[:-step], least[step:] + k.U64(step))
                step *= 2
            rest = REACH - step
            least = np.minimum(least[: len(least) - rest], least[rest:] + k.U64(rest))
            p = np.arange(len(least))
            doc = np.searchsorted(self.at, p + start, "right") - 1
            inside = p + start + LENGTH <= self.at[doc + 1]
            p, doc = p[inside], doc[inside]
            if not len(p):
                continue
            anchor = p + (least[p] & LOW).astype(np.int64)
            first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            low, high, anchor = p[first], p[np.append(first[1:], len(p)) - 1], anchor[first]
            whole = (sums[high + LENGTH] - sums[low]) * down[low]
            shape = (anchor - low).astype(np.uint64) * k.U64(k.STEP) + (high - low).astype(np.uint64)
            parts.append((low + start, high + start, anchor + start, g[anchor], k.mix(k.mix(whole) + shape), doc[first]))
        names = ("low", "high", "anchor", "g", "key", "doc")
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64)
        for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            setattr(self, name, np.concatenate([x[i] for x in parts]) if parts else np.empty(0, kind))

    def places(self, key: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.empty(len(key), PLACE)
        out["key"], out["doc"], out["sub"], out["pos"] = key, self.doc_ids[doc], self.sub[doc], at - self.at[doc]
        return out


def hash_of(row: bytes) -> int:
    return xxhash.xxh3_64_intdigest(row) >> 8


def first_of_each(places: np.ndarray) -> np.ndarray:
    """Indexes of each key's earliest place, in order of keys."""
    order = np.lexsort((places["pos"], places["sub"], places["doc"], places["key"]))
    return order[np.flatnonzero(np.diff(places["key"][order], prepend=~places["key"][order[:1]]))] if len(order) else order


def _member(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def _messages(bucket: int, sent: list[tuple[str, np.ndarray, np.ndarray]], shards: int) -> list[tuple]:
    return [(s, bucket, kind, blob) for kind, records, keys in sent for s, blob in split_by_shard(records, keys, shards)]


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _sent(rows: list[tuple]) -> pa.Table:
    return _table(rows, [("shard", pa.int32()), ("bucket", pa.int32()), ("kind", pa.string()), ("blob", pa.binary())])


def _replies(rows: list[tuple]) -> pa.Table:
    rows = [r for r in rows if r[2]]
    return _table(rows, [("bucket", pa.int32()), ("kind", pa.string()), ("reply", pa.binary())])


def _bucket(table: pa.Table) -> int:
    return table.column("bucket")[0].as_py()


class State:
    """What the replies so far say about a group's segments."""

    def __init__(self, group: Group, replies: pa.Table):
        got: dict[str, list[bytes]] = {}
        for kind, reply in zip(replies.column("kind").to_pylist(), replies.column("reply").to_pylist(), strict=True):
            got.setdefault(kind, []).append(reply)
        known = np.sort(unpack(got.get("anchors", []), KNOWN)[0], order="g")
        found, at = _member(group.g, known["g"])
        self.shared = found
        self.mixed = found & (known["mixed"][at] > 0) if len(known) else found
        self.hot = found & (known["hot"][at] > 0) if len(known) else found
        self.first_keys = np.sort(unpack(got.get("classes", []), np.dtype("<u8"))[0])
        self.masks = np.sort(unpack(got.get("masks", []), MASK)[0], order="key")
        self.repeats = np.sort(unpack(got.get("strings", []), np.dtype("<u8"))[0])

    def firsts(self, group: Group) -> np.ndarray:
        """Indexes of the segments that are the first of their class, among those with a shared anchor."""
        own = np.flatnonzero(self.shared)
        places = group.places(group.key[own], group.low[own], group.doc[own])
        first = first_of_each(places)
        return own[first[_member(places["key"][first], self.first_keys)[0]]]


def send_anchors(table: pa.Table, shards: int) -> pa.Table:
    group = Group(table)
    order = np.lexsort((group.key, group.g))
    g, key = group.g[order], group.key[order]
    first = np.flatnonzero(np.diff(g, prepend=~g[:1])) if len(g) else order
    new = np.ones(len(g), np.int64)
    new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
    out = np.empty(len(first), ANCHOR)
    if len(first):
        out["g"], out["key"] = g[first], key[first]  # one key tells: with several in a group, n does
        out["n"] = np.minimum(np.add.reduceat(new, first), 65535)
        out["many"] = np.diff(np.append(first, len(g))) > 1
    return _sent(_messages(_bucket(table), [("anchors", out, out["g"] >> np.uint64(7))], shards))


def answer_anchors(table: pa.Table) -> pa.Table:
    rows, sizes = unpack(table.column("blob").to_pylist(), ANCHOR)
    order = np.argsort(rows["g"], kind="stable")
    g = rows["g"][order]
    first = np.flatnonzero(np.diff(g, prepend=~g[:1]))
    count = np.diff(np.append(first, len(g)))
    per = lambda f, name: f.reduceat(rows[name][order].astype(np.int64), first)
    repeated = (count > 1) | (per(np.maximum, "many") > 0)
    mixed = (per(np.maximum, "n") > 1) | (per(np.maximum, "key") != per(np.minimum, "key"))
    hot = per(np.add, "n") > HOT
    back = np.empty(len(g), np.int64)
    back[order] = np.repeat(np.arange(len(first)), count)
    out, at = [], 0
    for bucket, size in zip(table.column("bucket").to_pylist(), sizes.tolist(), strict=True):
        own = back[at : at + size]
        known = np.empty(size, KNOWN)
        known["g"], known["mixed"], known["hot"] = rows["g"][at : at + size], mixed[own], hot[own]
        out.append((bucket, "anchors", known[repeated[own]].tobytes()))
        at += size
    return _replies(out)


def send_classes(table: pa.Table, replies: pa.Table, shards: int) -> pa.Table:
    group = Group(table)
    own = np.flatnonzero(State(group, replies).shared)
    places = group.places(group.key[own], group.low[own], group.doc[own])
    places = places[first_of_each(places)]
    return _sent(_messages(_bucket(table), [("classes", places, places["key"])], shards))


def _answer_first(table: pa.Table, kind: str, first: bool) -> list[tuple]:
    """The keys whose earliest place a bucket holds, or else those whose earliest place another bucket holds."""
    rows, sizes = unpack(table.column("blob").to_pylist(), PLACE)
    holds = np.zeros(len(rows), bool)
    holds[first_of_each(rows)] = True
    ends = np.cumsum(sizes)
    buckets = table.column("bucket").to_pylist()
    return [(b, kind, rows["key"][e - n : e][holds[e - n : e] == first].tobytes()) for b, e, n in zip(buckets, ends, sizes, strict=True)]


def answer_classes(table: pa.Table) -> pa.Table:
    return _replies(_answer_first(table, "classes", True))


def _strings(group: Group, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All string starts of the given segments, and the segment of each."""
    n = group.high[rows] - group.low[rows] + 1
    owner = np.repeat(rows, n)
    return group.low[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), owner


def string_keys(group: Group, starts: np.ndarray) -> np.ndarray:
    """A hash of the ``LENGTH`` bytes from each start."""
    return k.run_hashes(group.buffer, starts, starts + LENGTH) if len(starts) else np.empty(0, np.uint64)


def send_strings(table: pa.Table, replies: pa.Table, shards: int) -> pa.Table:
    group = Group(table)
    state = State(group, replies)
    firsts = state.firsts(group)
    firsts = firsts[state.mixed[firsts]]
    cold, hot = firsts[~state.hot[firsts]], np.sort(firsts[state.hot[firsts]])
    bucket, sent = _bucket(table), []
    head = np.empty(len(cold), HEAD)
    doc = group.doc[cold]
    for name, values in (
        ("g", group.g[cold]), ("key", group.key[cold]), ("doc", group.doc_ids[doc]), ("sub", group.sub[doc]),
        ("pos", group.low[cold] - group.at[doc]), ("left", group.anchor[cold] - group.low[cold]), ("n", group.high[cold] - group.low[cold] + 1),
    ):
        head[name] = values
    shard = (head["g"] >> np.uint64(7)) % np.uint64(shards)
    for s in np.unique(shard).tolist():
        own = np.flatnonzero(shard == s)
        text = b"".join(group.buffer[a : b + LENGTH].tobytes() for a, b in zip(group.low[cold[own]], group.high[cold[own]], strict=True))
        sent.append((s, bucket, "segments", len(own).to_bytes(8, "little") + head[own].tobytes() + text))
    starts, owner = _strings(group, hot)
    places = group.places(string_keys(group, starts), starts, group.doc[owner])
    places = places[first_of_each(places)]
    return _sent(sent + _messages(bucket, [("strings", places, places["key"])], shards))


def common_extension(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of equal bytes, up to ``LENGTH``, from places a and b on, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = (sums[a + middle] - sums[a]) * down[a] == (sums[b + middle] - sums[b]) * down[b]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def sort_suffixes(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sort within buckets (``bucket`` ascending): the order, and whether each suffix equals the one before it
    over ``LENGTH`` bytes."""
    sums, down = k.prefix(text), k.powers(len(text))[1]
    order = np.arange(len(starts))
    first = np.searchsorted(bucket, bucket)
    stop = np.searchsorted(bucket, bucket, "right")
    spot = np.arange(len(starts)) - first

    def less(a, b):
        """Whether suffix a sorts before b."""
        a, b = starts[a], starts[b]
        n = common_extension(sums, down, a, b)
        return (n < LENGTH) & (text[np.minimum(a + n, len(text) - 1)] < text[np.minimum(b + n, len(text) - 1)])

    width = 1
    while len(starts) and width < int((stop - first).max()):
        busy = np.flatnonzero(stop - first > width)
        run = spot[busy] // width
        other = first[busy] + np.where(run % 2 == 0, run + 1, run - 1) * width
        low = np.minimum(other, stop[busy])
        begin, high = low.copy(), np.minimum(other + width, stop[busy])
        is_left = run % 2 == 0
        while (open_ := low < high).any():
            middle = (low + high) // 2
            mine, theirs = order[busy[open_]], order[middle[open_]]
            left = is_left[open_]
            goes_on = np.where(left, less(theirs, mine), ~less(mine, theirs))
            low[open_] = np.where(goes_on, middle[open_] + 1, low[open_])
            high[open_] = np.where(goes_on, high[open_], middle[open_])
        target = first[busy] + run // 2 * 2 * width + spot[busy] % width + (low - begin)
        moved = order.copy()
        moved[target] = order[busy]
        order = moved
        width *= 2
    same = np.zeros(len(starts), bool)
    near = np.flatnonzero(bucket[1:] == bucket[:-1]) + 1
    for at in range(0, len(near), 1 << 14):
        i = near[at : at + (1 << 14)]
        a, b = starts[order[i - 1]][:, None] + np.arange(LENGTH), starts[order[i]][:, None] + np.arange(LENGTH)
        same[i] = (text[a] == text[b]).all(1)
    return order, same


def answer_strings(table: pa.Table) -> pa.Table:
    kinds = np.array(table.column("kind").to_pylist())
    out = _answer_first(table.filter(pa.array(kinds == "strings")), "strings", False)
    own = table.filter(pa.array(kinds == "segments"))
    heads, texts, sizes = [], [], []
    for blob in own.column("blob").to_pylist():
        n = int.from_bytes(blob[:8], "little")
        heads.append(np.frombuffer(blob, HEAD, n, 8))
        texts.append(blob[8 + n * HEAD.itemsize :])
        sizes.append(n)
    if not heads:
        return _replies(out)
    head, text = np.concatenate(heads), np.frombuffer(b"".join(texts), np.uint8)
    n = head["n"].astype(np.int64)
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    owner = np.repeat(np.arange(len(head)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = begin[owner] + inner
    distance = (head["left"][owner].astype(np.int64) - inner).astype(np.uint64)
    bits = np.zeros((len(head), 72), np.uint8)
    bucket = (head["g"][owner] & ~LOW) | distance
    hashes = k.run_hashes(text, starts, starts + LENGTH)
    mark = k.mix(bucket * k.U64(k.STEP) + hashes)
    order = np.argsort(mark)
    alone = np.ones(len(mark), bool)  # no other string has the hash, so none is equal
    alone[order[1:]] &= mark[order[1:]] != mark[order[:-1]]
    alone[order[:-1]] &= mark[order[1:]] != mark[order[:-1]]
    pick = np.flatnonzero(~alone)
    pick = pick[np.argsort(bucket[pick], kind="stable")]
    order, same = sort_suffixes(text, starts[pick], bucket[pick])
    ranked = pick[order]
    equal = np.cumsum(~same)
    who = owner[ranked]
    early = np.lexsort((head["pos"][who].astype(np.int64) + inner[ranked], head["sub"][who], head["doc"][who], equal))
    later = early[np.flatnonzero(np.diff(equal[early], prepend=-1) == 0)]
    bits[who[later], inner[ranked[later]]] = 1
    packed = np.packbits(bits, axis=1, bitorder="little")
    at = 0
    for b, size in zip(own.column("bucket").to_pylist(), sizes, strict=True):
        masks = np.empty(size, MASK)
        masks["key"], masks["bits"] = head["key"][at : at + size], packed[at : at + size]
        out.append((b, "masks", masks[masks["bits"].any(1)].tobytes()))
        at += size
    return _replies(out)


def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
    """The documents without their repeated bytes."""
    group = Group(table)
    state = State(group, replies)
    cover = np.zeros(len(group.buffer) + 1, np.int32)
    firsts = state.firsts(group)
    later = state.shared.copy()
    later[firsts] = False
    np.add.at(cover, group.low[later], 1)
    np.add.at(cover, group.high[later] + LENGTH, -1)
    firsts = firsts[state.mixed[firsts]]
    cold, hot = firsts[~state.hot[firsts]], np.sort(firsts[state.hot[firsts]])
    found, at = _member(group.key[cold], state.masks["key"])
    if found.any():
        bits = np.unpackbits(state.masks["bits"][at[found]], axis=1, bitorder="little")
        row, offset = np.nonzero(bits)
        starts = group.low[cold[found][row]] + offset
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + LENGTH, -1)
    if len(hot):
        starts, owner = _strings(group, hot)
        places = group.places(string_keys(group, starts), starts, group.doc[owner])
        repeat = np.ones(len(starts), bool)
        first = first_of_each(places)
        repeat[first[~_member(places["key"][first], state.repeats)[0]]] = False
        np.add.at(cover, starts[repeat], 1)
        np.add.at(cover, starts[repeat] + LENGTH, -1)
    gone = np.cumsum(cover)[:-1] > 0
    out = []
    for i, row in enumerate(group.rows):
        own = gone[group.at[i] : group.at[i + 1]]
        s, e = k.runs(own)
        kept = np.frombuffer(row, np.uint8)[~own].tobytes() if len(s) else row
        out.append((len(row), [{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)], kept))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rest = _table(out, [("n_bytes", pa.int64()), ("spans", spans), ("kept", pa.binary())])
    return pa.table([group.table.column("doc_id").cast(pa.int64()), *rest.columns], ["doc_id", *rest.column_names])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, the removed ``spans`` of bytes and the ``kept`` bytes."""
    rows = docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"))
    grouped, tasks = document_groups(rows)
    texts = grouped.groupBy("bucket")

    def meet(sent: DataFrame, answer) -> DataFrame:
        return sent.repartition(tasks, "shard").groupBy("shard").applyInArrow(answer, REPLY).repartition(tasks, "bucket")

    replies = meet(texts.applyInArrow(lambda t: send_anchors(t, tasks), SENT), answer_anchors)
    sent = texts.cogroup(replies.groupBy("bucket")).applyInArrow(lambda t, r: send_classes(t, r, tasks), SENT)
    replies = replies.union(meet(sent, answer_classes))
    sent = texts.cogroup(replies.groupBy("bucket")).applyInArrow(lambda t, r: send_strings(t, r, tasks), SENT)
    replies = replies.union(meet(sent, answer_strings))
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return texts.cogroup(replies.groupBy("bucket")).applyInArrow(remove, schema)


def summary(result: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return result.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
