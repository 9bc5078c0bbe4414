"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words are runs of letters, digits, or other marks; letters are lower-cased, and a word in
capitals counts as a second word ``<caps>`` as well. Every word has a fixed sparse
random index vector, drawn from a hash of the word. A word's vector is the sum of the
index vectors of its neighbours within ``WINDOW`` places and its own, over the training texts,
each weighed down by how common it is, at unit length. A document's features are the mean of its words' vectors (words
without one add nothing) and its outer shape: shares of letters, digits and marks among its characters, shares of capitals, marks,
known, distinct, most frequent and immediately repeated words, and the mean word length. A network with one hidden layer of
rectified units is trained in numpy by full-batch Adam; a temperature fitted on a fifth of the
training rows that the network does not see scales its output.

Bounds: the model is learned on about ``SAMPLE`` labelled ids, chosen by a hash of the id (all
where there are fewer), with one whole text each, and of these on a part of about ``SAMPLE_BYTES`` where they are longer in sum,
so that much reaches the driver and no more, however often an id occurs and however long its texts are; and on
at most ``VOCABULARY`` words. It is applied to whole texts of all rows.

Defined cases: null or empty texts have zero features and get a score like any other; several labels of
one id count by their mean, at least half meaning 1, and of its several texts the one with the smallest hash is
learned from; null labels are left out; without rows of both labels every
score is the share of label 1, or 0.5 without rows; rows with a null id are held out; an empty table has no scores. A very long text
is one task's; columns beside doc_id and text are only copied, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaplate.llm.kernels import slices
from seaplate.llm.langid import Slots, held_out
from seaplate.llm.tables import stage

WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SIZE = 64
ONES = 6
WINDOW = 2
HIDDEN = 24
SAMPLE = 6000
SAMPLE_BYTES = 128 << 20
VOCABULARY = 30_000
STEPS = 400
THRESHOLD = 0.3
SUMS = 6
SHAPES = 10
CACHE = 60_000
BATCH = 1 << 18
CAPS = "<caps>"


def index_vector(word: str) -> np.ndarray:
    """A sparse vector of ``ONES`` entries of -1 or 1, drawn from the word's crc32."""
    draw = np.random.default_rng(zlib.crc32(word.encode("utf-8", "surrogatepass")))
    out = np.zeros(SIZE, np.float32)
    out[draw.choice(SIZE, ONES, replace=False)] = draw.integers(0, 2, ONES) * 2 - 1
    return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def is_caps(word: str) -> bool:
    return len(word) > 1 and word.isupper()


class QualityModel:
    """Word vectors and the network; ``score`` maps a text to the probability of label 1."""

    def __init__(self, texts: list[str | None], labels: list[int], seed: int = 7):
        self.constant = float(np.mean(labels)) if labels else 0.5
        self.trained = 0 < sum(labels) < len(labels)
        if not self.trained:
            return
        self._learn_vectors(texts)
        x, y = self.features(texts), np.asarray(labels, float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        order = np.random.default_rng(seed).permutation(len(y))
        aside = order[: max(1, len(y) // 5)] if len(y) >= 10 else order
        seen = order[len(aside) :] if len(y) >= 10 else order
        self._fit((x - self.mean) / self.scale, y, seen, seed)
        self._calibrate(self._logits((x[aside] - self.mean) / self.scale), y[aside])
        self._forget()  # so that a broadcast model holds no cache

    def _learn_vectors(self, texts) -> None:
        lists = lambda: ([x for w in words_of(t) for x in ((w.lower(), CAPS) if is_caps(w) else (w.lower(),))] for t in texts)
        counts = Counter()
        for own in lists():
            counts.update(own)
        common = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:VOCABULARY]
        self.known = {w: i for i, (w, n) in enumerate(common) if n > 1}
        index = np.stack([index_vector(w) for w in self.known] or [np.zeros(SIZE, np.float32)])
        total = sum(counts.values())
        weight = np.array([1 / (1 + 1000 * counts[w] / total) for w in self.known] or [0.0], np.float32)
        pushed = index * weight[:, None]
        vectors = index.copy()
        for own in lists():
            rows = np.array([self.known.get(w, -1) for w in own], int)
            pairs = [(rows[:-step], rows[step:]) for step in range(1, WINDOW + 1)]
            to = np.concatenate([x for a, b in pairs for x in (a, b)])
            by = np.concatenate([x for a, b in pairs for x in (b, a)])
            both = (to >= 0) & (by >= 0)
            to, by = to[both], by[both]
            if len(to):
                order = np.argsort(to, kind="stable")
                first = np.flatnonzero(np.diff(to[order], prepend=-1))
                vectors[to[order][first]] += np.add.reduceat(pushed[by[order]], first)
        self.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.slots, self.rows = Slots(), np.empty((0, SIZE + SUMS), np.float32)
        self.slots.new = []

    def _row(self, word: str) -> np.ndarray:
        """What one word adds to a document's sums: its vector, then its marks."""
        out = np.zeros(SIZE + SUMS, np.float32)
        caps, at = is_caps(word), self.known.get(word.lower())
        if at is not None:
            out[:SIZE] = self.vectors[at]
        if caps and CAPS in self.known:
            out[:SIZE] += self.vectors[self.known[CAPS]]
        kind = 0 if word[0].isalpha() else 1 if word[0].isdigit() else 2
        out[SIZE + kind] = len(word)
        out[SIZE + 3 :] = caps, kind == 2, at is not None
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row per text."""
        out = np.zeros((len(texts), SIZE + SHAPES))
        for cut in slices(list(texts), BATCH):
            self._features(texts[cut], out[cut])
        return out

    def _features(self, texts: list[str | None], out: np.ndarray) -> None:
        if len(self.slots) > CACHE:
            self._forget()
        slots, weights, some = [], [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            own = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
            again = int((own[1:] == own[:-1]).sum())
            own, times = np.unique(own, return_counts=True)
            slots.append(own)
            weights.append(times)
            some.append((i, len(words), len(own), times.max(), len(text), again))
        if not some:
            return
        if self.slots.new:
            self.rows = np.concatenate([self.rows, [self._row(w) for w in self.slots.new]])
            self.slots.new = []
        sizes = np.array([len(x) for x in slots])
        sums = np.add.reduceat(self.rows[np.concatenate(slots)] * np.concatenate(weights)[:, None].astype(np.float32), np.cumsum(sizes) - sizes)
        i, words, distinct, most, length, again = np.array(some).T
        shapes = sums[:, SIZE:].astype(float)
        out[i, :SIZE] = sums[:, :SIZE] / words[:, None]
        out[i, SIZE:] = np.column_stack(
            [shapes[:, :3] / length[:, None], shapes[:, 3:] / words[:, None], distinct / words, most / words, again / words, shapes[:, 0] / words / 10]
        )

    def _fit(self, x: np.ndarray, y: np.ndarray, seen: np.ndarray, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.layers = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        x, y = x[seen], y[seen]
        first = [np.zeros_like(w) for w in self.layers]
        second = [np.zeros_like(w) for w in self.layers]
        for step in range(1, STEPS + 1):
            a, b, c, d = self.layers
            hidden = np.maximum(x @ a + b, 0)
            off = (_sigmoid(hidden @ c + d) - y) / len(y)
            back = np.outer(off, c) * (hidden > 0)
            for i, slope in enumerate((x.T @ back + 1e-4 * a, back.sum(0), hidden.T @ off + 1e-4 * c, off.sum(keepdims=True))):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                self.layers[i] = self.layers[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum(x @ a + b, 0) @ c + d

    def _calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """The temperature, of a grid, with the smallest log loss."""
        grid = np.geomspace(0.25, 16, 61)
        losses = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.constant)
        x = self.features(texts)
        return _sigmoid(self._logits((x - self.mean) / self.scale) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _unit(purpose: str) -> Column:
    """A value of 0 to 1 drawn from the id."""
    return F.expr(f"shiftrightunsigned(xxhash64(doc_id, '{purpose}'), 11)") / float(1 << 53)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> QualityModel:
    """A model from the rows that are not held out and have a label; see the module for the bounds."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    count = known.count()
    chosen = known.filter(_unit("quality") < min(1.0, sample / max(count, 1)))  # about ``sample`` rows, so small enough to broadcast
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("row")
    rows = stage(rows.groupBy("doc_id", "label").agg(one).select("doc_id", "label", "row.text"), "labelled")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rows = rows.filter(_unit("bytes") < min(1.0, most / max(size, 1))).orderBy("doc_id").toPandas()
    return QualityModel(rows["text"].tolist(), rows["label"].astype(int).tolist())


def scorer(model: QualityModel, docs: DataFrame) -> Column:
    """The score as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return score(docs["text"])


def classify(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score and predicted."""
    scored = docs.select(F.col("doc_id").cast("long"), scorer(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    return docs.filter(scorer(model, docs) >= threshold)
