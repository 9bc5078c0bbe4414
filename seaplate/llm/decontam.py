"""Benchmark decontamination: a Wu-Manber search for many word windows at once.

Texts are taken as words. The windows of a benchmark item are its runs of
``width`` consecutive words, or the whole item where it is shorter. Windows of
one length form one search: a table of two-word blocks says how far the search
may move on, blocks that end a window lead to the windows that end so, the first
word narrows these down, and the words themselves are compared in the end.
Many places of many documents are searched in step, so each move is one array
operation.

The benchmark is taken in pieces of at most ``piece`` windows (or one item's). Each piece is compiled and broadcast
by itself and has a pass over the documents of its own, whose result is staged before the next piece is read, so
neither the driver nor a worker ever holds two. A benchmark of one piece needs one pass and stages nothing.

Defined cases: null or empty texts have no words and no hits; items without
words are never found; a null item id counts as the empty string; repeated items
with the same id count once; a document row is judged by itself, so repeated
rows and null ids need no care; an empty benchmark hits nothing, and an empty table has no rows. A very long text is one
task's; columns beside doc_id and text are only copied, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaplate.llm import kernels as k
from seaplate.llm.tables import stage

MEMBER = np.zeros(256, bool)
MEMBER[48:58] = MEMBER[97:123] = MEMBER[128:] = True
WIDTH = 13
PIECE = 200_000
LANE = 256
FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


@dataclass
class Search:
    """The windows of one length: block hashes with their shifts, and windows sorted by (last block, first word)."""

    length: int
    blocks: np.ndarray
    shifts: np.ndarray
    tails: np.ndarray
    windows: np.ndarray
    words: list[list[bytes]]
    items: list[list[str]]


def item_words(text: str | None) -> list[bytes]:
    low, s, e = k.words([text], MEMBER)[3]
    return [low[a:b].tobytes() for a, b in zip(s, e, strict=True)]


def _block(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return k.mix(left * k.U64(k.STEP) + right)


def compile_searches(windows: dict[tuple[bytes, ...], set[str]]) -> list[Search]:
    """One search per window length."""
    out = []
    for length in sorted({len(w) for w in windows}):
        own = [w for w in windows if len(w) == length]
        flat = [x for w in own for x in w]
        joined = b"\n".join(flat)
        ends = np.cumsum([len(x) + 1 for x in flat])
        hashes = k.run_hashes(np.frombuffer(joined, np.uint8), ends - [len(x) + 1 for x in flat], ends - 1).reshape(-1, length)
        size = min(2, length)
        grid = _block(hashes[:, :-1], hashes[:, 1:]) if size == 2 else hashes
        moves = np.broadcast_to(np.arange(length - size, -1, -1), grid.shape)
        order = np.lexsort((moves.ravel(), grid.ravel()))
        blocks, first = np.unique(grid.ravel()[order], return_index=True)
        tails = _block(grid[:, -1], hashes[:, 0])
        rank = np.argsort(tails, kind="stable")
        out.append(
            Search(length, blocks, moves.ravel()[order][first], tails[rank], hashes[rank], [list(own[i]) for i in rank], [sorted(windows[own[i]]) for i in rank])
        )
    return out


def _found(s: Search, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of last words and the windows found there, for words ``first..last`` of each lane."""
    size = min(2, s.length)
    longest = s.length - size + 1
    at, stop = first + s.length - 1, last
    places = []
    while len(at := at[keep := at < stop]):
        stop = stop[keep]
        block = _block(h[at - 1], h[at]) if size == 2 else h[at]
        slot = np.minimum(np.searchsorted(s.blocks, block), len(s.blocks) - 1)
        move = np.where(s.blocks[slot] == block, s.shifts[slot], longest)
        hit = move == 0
        if hit.any():
            places.append(np.stack([at[hit], block[hit].view(np.int64)]))
        at = at + np.maximum(move, 1)
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, block = np.concatenate(places, axis=1)
    tail = _block(block.view(np.uint64), h[at - s.length + 1])
    low, high = np.searchsorted(s.tails, tail), np.searchsorted(s.tails, tail, "right")
    at, low, n = np.repeat(at, high - low), np.repeat(low, high - low), high - low
    window = low + np.arange(len(low)) - np.repeat(np.cumsum(n) - n, n)
    same = np.ones(len(at), bool)
    for j in range(s.length):
        same &= h[at - s.length + 1 + j] == s.windows[window, j]
    return at[same], window[same]


def search_texts(texts: list[str | None], searches: list[Search], before: list | None = None) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: its number of words, the covered stretches of words, and the ids of the items found, with those of ``before``."""
    h, _, counts, (low, s, e) = k.words(texts, MEMBER)
    ends = np.cumsum(counts)
    begins = ends - counts
    cover = np.zeros(len(h) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for d, found in enumerate(before or ()):
        for span in found["spans"]:
            cover[begins[d] + span["start"]] += 1
            cover[begins[d] + span["end"]] -= 1
        if len(found["items"]):
            items[d] = set(found["items"])
    for search in searches if len(h) else ():
        lanes = np.maximum(1, -(-(counts - search.length + 1) // LANE)) * (counts >= search.length)
        doc = np.repeat(np.arange(len(counts)), lanes)
        first = begins[doc] + LANE * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        last = np.minimum(first + LANE + search.length - 1, ends[doc])
        at, window = _found(search, h, first, last)
        owner = np.searchsorted(ends, at, "right")
        for place, w, d in zip(at.tolist(), window.tolist(), owner.tolist(), strict=True):
            start = place - search.length + 1
            if all(low[s[i] : e[i]].tobytes() == x for i, x in enumerate(search.words[w], start)):
                cover[start] += 1
                cover[place + 1] -= 1
                items.setdefault(d, set()).update(search.items[w])
    s, e = k.runs(np.cumsum(cover)[:-1] > 0)
    spans: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        while a < b:  # a stretch may run on into the next document
            d = int(np.searchsorted(ends, a, "right"))
            stop = min(b, int(ends[d]))
            spans.setdefault(d, []).append((a - int(begins[d]), stop - int(begins[d])))
            a = stop
    return [(int(n), spans.get(i, []), sorted(items.get(i, ()))) for i, n in enumerate(counts)]


def pieces(benchmark: DataFrame, width: int = WIDTH, piece: int = PIECE) -> Iterator[list[Search]]:
    """The compiled searches of one piece of the benchmark after the other; one of nothing for a benchmark without words."""
    windows, any_ = {}, False
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        own = item_words(text)
        for i in range(max(1, len(own) - width + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + width]), set()).add(item)
        if len(windows) >= piece:
            yield compile_searches(windows)
            windows, any_ = {}, True
    if windows or not any_:
        yield compile_searches(windows)


def _searched(shared, text: Column, before: Column | None) -> Column:
    """What one broadcast piece finds in the texts, and ``before``, as a struct of ``FOUND``."""

    def search(texts: list[str | None], earlier: list | None) -> pd.DataFrame:
        rows = []
        for cut in k.slices(texts):
            rows += search_texts(texts[cut], shared.value, earlier and earlier[cut])
        spans = [[{"start": a, "end": b} for a, b in own] for _, own, _ in rows]
        return pd.DataFrame({"n_words": pd.array([n for n, _, _ in rows], "int64"), "spans": spans, "items": [ids for _, _, ids in rows]})

    @F.pandas_udf(FOUND)
    def alone(texts: pd.Series) -> pd.DataFrame:
        return search(texts.tolist(), None)

    @F.pandas_udf(FOUND)
    def and_before(texts: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
        return search(texts.tolist(), found.to_dict("records"))

    return alone(text) if before is None else and_before(text, before)


def _with_found(docs: DataFrame, columns: list[Column], benchmark: DataFrame, width: int, piece: int) -> DataFrame:
    """(row, found): the given columns of ``docs`` as one struct, and what the benchmark hits in the text; a pass for each piece."""
    context = docs.sparkSession.sparkContext
    rows, before, last = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("text")), None, None
    for searches in pieces(benchmark, width, piece):
        if last is not None:  # there is more: write this pass and let go of its piece
            rows, before = stage(rows, "searched"), F.col("found")
            last.destroy()
        last = context.broadcast(searches)
        rows = rows.select("row", "text", _searched(last, F.col("text"), before).alias("found"))
    return rows.select("row", "found")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, n_words, the covered stretches of words (``spans``) and the ids found (``items``)."""
    found = _with_found(docs, [F.col("doc_id").cast("long").alias("doc_id")], benchmark, width, piece)
    return found.select("row.doc_id", "found.*")


def contaminated(n_hit, n_words):
    """At least a twentieth of the words are covered."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _n_hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])


def summary(found: DataFrame) -> DataFrame:
    n_hit = _n_hit("spans")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, piece: int = PIECE) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    found = _with_found(docs, [F.col(f"`{c}`") for c in docs.columns], benchmark, width, piece)
    return found.filter(~contaminated(_n_hit("found.spans"), F.col("found.n_words"))).select("row.*")
