"""Language ID by words first, backing off to ever shorter character n-grams for unseen words.

Learning counts words per language over a sample of labelled rows, and from the
word counts the n-grams of ``ORDERS`` letters within words, whose ends are marked.
Entries are kept if they make up at least ``1 / ENTRIES`` of their language's (and
order's) total, so a language has at most ``ENTRIES`` words and as many n-grams
per order; beyond ``LANGUAGES`` languages each keeps fewer, in proportion, so that the
model's size is bounded and it may be broadcast. A score is the
entry's log frequency per language; an entry unseen in a language gets the log
of half the smallest frequency kept. That least value is the same for all languages and so
left out: the tables are sparse and hold what an entry has above it.

Scoring takes each distinct word of a text once. A known word scores by its own
frequencies; an unseen word by the mean over its n-grams of the longest order of which
any is known, with ``BACKOFF`` per step down. The prediction is the language with the largest
sum, the first by name among equals, and its score the softmax of the sums divided by the square
root of the number of words.

The sample is bounded: of each language about ``SAMPLE`` rows are learned from, chosen by a hash of
the id (all of them where there are fewer). Every labelled language is learned, however rare.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every
text if nothing was learned; a row with a null lang is predicted but not learned from; with a null
id, a row is held out; repeated rows are predicted one by one. Words are
runs of letters with their combining marks, in lower case and whatever their length, in learning and in scoring alike: digits, number
signs and marks without a letter are no words. An empty table has no predictions; only doc_id, text and, for learning, lang
are read. A very long text is one task's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.llm.kernels import slices
from seaplate.llm.tables import long_ids, text_ids

LETTERS = r"\p{L}[\p{L}\p{M}]*"
WORD = regex.compile(LETTERS)
ORDERS = (5, 4, 3, 2, 1)
SAMPLE = 4000
ENTRIES = 50_000
LANGUAGES = 200
BACKOFF = -0.5
CACHE = 4_000_000
VALUES = 1 << 22
LONG = 50_000
UNKNOWN = "und"


def held_out(key, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part``; a null id does."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(True))


class Slots(dict):
    """Numbers words in the order they are first asked for, and lists the new ones."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Rows:
    """Sparse rows: ``columns`` and ``values`` of row i lie from ``ends[i]`` to ``ends[i + 1]``."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int):
        order = np.argsort(row, kind="stable")
        self.columns, self.values = column[order].astype(np.int32), value[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all entries of the given rows: the place in ``rows``, column and value."""
        first, sizes = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        upto = np.cumsum(sizes)
        at = np.repeat(first - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)
        return np.repeat(np.arange(len(rows)), sizes), self.columns[at], self.values[at]

    def extend(self, more: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        """These rows and then those of ``more``, each given by its columns and values."""
        out = Rows.__new__(Rows)
        out.columns = np.concatenate([self.columns, *(c for c, _ in more)])
        out.values = np.concatenate([self.values, *(v for _, v in more)])
        out.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(c) for c, _ in more])])
        return out


class LanguageModel:
    """Log frequencies per language of words and n-grams, above the least one of their order.

    A word's row of scores is worked out once and kept; the rows of unseen words go when there are more than
    ``CACHE`` values.
    """

    def __init__(self, languages: list[str], entries: pd.DataFrame):
        """entries: order (0 for words), gram, lang, share."""
        self.languages = sorted(languages)
        column = {x: i for i, x in enumerate(self.languages)}
        self.tables: list[tuple[dict[str, int], Rows]] = []
        for order in (0, *ORDERS):
            own = entries[entries["order"] == order]
            slots: dict[str, int] = {}
            rows = np.array([slots.setdefault(g, len(slots)) for g in own["gram"]], int)
            share = own["share"].to_numpy(float)
            above = np.log(share) - np.log(share.min() / 2) if len(own) else share
            self.tables.append((slots, Rows(rows, np.array([column[x] for x in own["lang"]], int), above, len(slots))))
        self._forget()

    def _forget(self) -> None:
        known, table = self.tables[0]
        self.slots, self.scores = Slots(known), table
        self.slots.new = []

    def _back_off(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values; a step down costs ``BACKOFF`` in every language, so it tells none from another."""
        marked = f"^{word}$"
        for step, order in enumerate(ORDERS, 1):
            slots, table = self.tables[step]
            rows = [r for i in range(len(marked) - order + 1) if (r := slots.get(marked[i : i + order])) is not None]
            if rows:
                _, columns, values = table.pick(np.array(rows))
                columns, place = np.unique(columns, return_inverse=True)
                return columns, np.bincount(place, values) / len(rows)
        return np.empty(0, np.int32), np.empty(0)

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        if len(self.scores.values) + len(self.slots) > CACHE + len(self.tables[0][1].values) + len(self.tables[0][0]):
            self._forget()
        slots, weights, counts = [], [], []
        for text in texts:
            words = WORD.findall((text or "").lower())
            own = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
            own, times = np.unique(own, return_counts=True) if len(own) > LONG else (own, np.ones(len(own), np.int64))
            slots.append(own)
            weights.append(times)
            counts.append(len(words))
        if self.slots.new:
            self.scores = self.scores.extend([self._back_off(w) for w in self.slots.new])
            self.slots.new = []
        counts = np.array(counts)
        some = np.flatnonzero(counts)
        if len(some):
            n = len(self.languages)
            doc = np.repeat(np.arange(len(some)), [len(slots[i]) for i in some])
            slot, times = np.concatenate(slots), np.concatenate(weights)
            totals = np.zeros(len(some) * n)
            step = max(1, VALUES // n)  # a row has a value per language at most
            for at in range(0, len(slot), step):
                place, columns, values = self.scores.pick(slot[at : at + step])
                low = doc[at]
                found = np.bincount((doc[at : at + step][place] - low) * n + columns, values * times[at : at + step][place])
                totals[low * n : low * n + len(found)] += found
            totals = totals.reshape(-1, n)
            best = totals.argmax(1)
            gaps = (totals - totals[np.arange(len(some)), best][:, None]) / np.sqrt(counts[some])[:, None]
            scores = 1 / np.exp(gaps).sum(1)
            for i, at, score in zip(some.tolist(), best.tolist(), scores.tolist(), strict=True):
                out[i] = (self.languages[at], score)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def learn(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model from (doc_id, text, lang) rows; see the module for the bounds."""
    rows = labelled.filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count()
    languages = [r["lang"] for r in sizes.select("lang").collect()]  # a row per language
    if not languages:
        return LanguageModel([], pd.DataFrame({"order": [], "gram": [], "lang": [], "share": []}))
    entries_each = max(1, ENTRIES * LANGUAGES // max(LANGUAGES, len(languages)))
    unit = F.expr("shiftrightunsigned(xxhash64(doc_id, lang), 11)") / float(1 << 53)
    rates = F.broadcast(sizes.select("lang", F.least(F.lit(1.0), sample / F.col("count")).alias("rate")))
    chosen = rows.join(rates, "lang").filter(unit < F.col("rate"))
    grams = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("gram"))
    words = grams.groupBy("lang", "gram").agg(F.count("*").alias("n"))
    marked = F.concat(F.lit("^"), F.col("gram"), F.lit("$"))
    pieces = [F.struct(F.lit(0).alias("order"), F.col("gram"))]
    lists = [F.array(*pieces)]
    for order in ORDERS:
        starts = F.when(F.length(marked) >= order, F.sequence(F.lit(1), F.length(marked) - order + 1))
        parts = F.transform(starts, lambda i, o=order: F.struct(F.lit(o).alias("order"), marked.substr(i, F.lit(o)).alias("gram")))
        lists.append(F.coalesce(parts, F.array().cast("array<struct<order:int,gram:string>>")))
    entries = words.select("lang", "n", F.explode(F.concat(*lists)).alias("e")).groupBy("lang", "e.order", "e.gram").agg(F.sum("n").alias("n"))
    totals = entries.groupBy("lang", "order").agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all")
    totals = F.broadcast(totals)  # a row per language and order, so six a language
    kept_entries = entries.join(totals, ["lang", "order"]).filter(share * entries_each >= 1).select("order", "gram", "lang", share.alias("share"))
    return LanguageModel(languages, kept_entries.orderBy("order", "gram", "lang").toPandas())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, lang_pred and score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = VALUES // max(4, len(model.languages))

    def task(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            found = [x for cut in slices(texts, limit) for x in shared.value.predict_all(texts[cut])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    return long_ids(text_ids(docs, "text").mapInPandas(task, "doc_id string, lang_pred string, score double"))
