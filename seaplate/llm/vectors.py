"""Embedding near-dedup by randomised-rotation binary codes.

Vectors are scaled to unit length and turned by a fixed random rotation; the signs
of the turned coordinates are a vector's code, and the inner product of the vector with
its code's unit vector, ``alpha``, is stored as its correction factor. For another vector q the
inner product with the code, divided by alpha, estimates the cosine without bias; at a cosine of c the
estimate is off by at most ``sqrt(1 - alpha**2) / alpha * sqrt(1 - c**2)``, and by
``confidence / sqrt(dim - 1)`` of that with a failure probability that falls off as
``exp(-confidence**2 / 2)``. Pairs whose estimate, with that margin, reaches the limit are
recomputed in double precision; no other pair is linked, and with the default, no
confidence given, the full margin holds for certain.

Which pairs meet: a band is a number of signs of one of several more rotations, and vectors that agree on a band
meet in its bucket. The number of signs grows with the logarithm of the number of
vectors, so that buckets hold about ``BUCKET`` of unrelated ones, and the number of bands is such that
a pair at the limit shares none with probability ``MISS``. Large buckets are dealt
into blocks. Only signs travel to the buckets, the code's and all bands': each sign of a pair at the limit differs with
probability ``acos(limit) / pi``, so a bound on the unlike signs, passed with probability ``MISS``, picks the
vectors with a partner in the bucket, and only their components are fetched to work out estimates and
cosines. A pair is counted in the first band it shares only; a block returns a number of links
and a spanning forest, never its pairs.

Defined cases: null and zero vectors, and vectors with null or non-finite components, link with nothing;
vectors of different lengths do not link; equal vectors are one class with a weight; rows with a null vec_id
count as links of others, and have themselves a null component; a repeated vec_id counts as a row; an empty table gives
no rows; only vec_id and embedding are read, whatever else the table holds.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, exp, lgamma, log, log1p, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaplate.llm.graph import components, forest, pair_blocks
from seaplate.llm.tables import stage

LIMIT = 0.95
BUCKET = 192
MISS = 1e-6
BLOCK = 2048
CHUNK = 256


@lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    draw = np.random.default_rng([dim, number, 411]).normal(size=(dim, dim))
    q, r = np.linalg.qr(draw)
    return q * np.sign(np.diag(r))


def plan_bands(count: int, limit: float) -> tuple[int, int]:
    """Signs per band and number of bands for so many vectors."""
    signs = max(1, round(log2(max(count, 2) / BUCKET)))
    agree = (1 - acos(limit) / pi) ** signs
    return signs, ceil(log(MISS) / log(1 - agree)) if agree < 1 else 1


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def most_unlike(count: int, limit: float) -> int:
    """Of so many signs, how many differ at most in a pair at the limit, but for a probability of ``MISS``."""
    p = min(max(acos(limit) / pi, 1e-12), 1 - 1e-12)
    chance = [exp(lgamma(count + 1) - lgamma(k + 1) - lgamma(count - k + 1) + k * log(p) + (count - k) * log1p(-p)) for k in range(count + 1)]
    return int(np.flatnonzero(np.cumsum(chance[::-1])[::-1] > MISS)[-1])


def sign_bits(units: np.ndarray, signs: int, bands: int) -> np.ndarray:
    """Signs of turned coordinates: the code's, and then those of the bands, which take up the rotations one after another."""
    dim = units.shape[1]
    width = min(signs, dim)
    per = dim // width
    parts = [units @ rotation(dim, 0) > 0]
    for first in range(0, bands, per):
        parts.append((units @ rotation(dim, 1 + first // per) > 0)[:, : min(per, bands - first) * width])
    return np.concatenate(parts, axis=1)


def band_keys(bits: np.ndarray, dim: int, bands: int) -> np.ndarray:
    """One key per band."""
    own = bits[:, dim:].reshape(len(bits), bands, -1)
    return own @ (1 << np.arange(own.shape[2], dtype=np.int64))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction factors."""
    turned = units @ rotation(units.shape[1], 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(units.shape[1])


def may_link(codes: np.ndarray, alpha: np.ndarray, units: np.ndarray, limit: float, confidence: float | None) -> np.ndarray:
    """For each code and each vector, whether the estimate with its margin reaches the limit."""
    dim = units.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (units @ rotation(dim, 0)).astype(np.float32)
    estimate = (signs @ turned.T) / (np.sqrt(dim) * alpha[:, None])
    share = 1.0 if confidence is None or dim < 2 else min(1.0, confidence / np.sqrt(dim - 1))
    margin = np.sqrt(np.maximum(0.0, 1 - alpha**2)) / alpha * np.sqrt(1 - limit**2) * share
    return estimate + margin[:, None] + 1e-5 >= limit


def usable(vector: str):
    """Neither null nor zero, and all components finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def index(embeddings: DataFrame, signs: int, bands: int) -> DataFrame:
    """(class, weight, embedding) rows with their length, signs, correction factor and band keys."""

    def task(batches):
        for pdf in batches:
            for dim, same in pdf.groupby(pdf["embedding"].str.len()):
                units = unit(np.stack(same["embedding"].to_list()).astype(np.float64))
                bits = sign_bits(units, signs, bands)
                packed = [b.tobytes() for b in np.packbits(bits, axis=1)]
                yield same.assign(dim=dim, bits=packed, alpha=encode(units)[1], keys=list(band_keys(bits, dim, bands)))

    kind = embeddings.schema["embedding"].dataType.simpleString()
    return embeddings.mapInPandas(task, f"class long, weight long, embedding {kind}, dim int, bits binary, alpha double, keys array<bigint>")


def _signs(pdf: pd.DataFrame, signs: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs and band keys of rows of one length."""
    dim = int(pdf["dim"].iloc[0])
    packed = np.frombuffer(b"".join(pdf["bits"]), np.uint8).reshape(len(pdf), -1)
    bits = np.unpackbits(packed, axis=1, count=dim + bands * min(signs, dim))
    return bits, band_keys(bits, dim, bands)


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of two blocks, or twice those of one, and whether they are two."""
    side = (pdf["own"] == pdf["bi"]).to_numpy()
    if pdf["bi"].iloc[0] == pdf["bj"].iloc[0]:
        return np.arange(len(pdf)), np.arange(len(pdf)), False
    return np.flatnonzero(side), np.flatnonzero(~side), True


def _fresh(keys: np.ndarray, band: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that share no earlier band."""
    for earlier in range(band):
        fresh = keys[a, earlier] != keys[b, earlier]
        a, b = a[fresh], b[fresh]
    return a, b


def _meet(pdf: pd.DataFrame, limit: float, signs: int, bands: int) -> pd.DataFrame:
    """The rows of one block or pair of blocks with a partner there of few enough unlike signs that no earlier band holds."""
    bits, keys = _signs(pdf, signs, bands)
    turned, least = bits.astype(np.float32) * 2 - 1, bits.shape[1] - 2 * most_unlike(bits.shape[1], limit)
    rows, columns, cross = _sides(pdf)
    hit = np.zeros(len(pdf), bool)
    for at in range(0, len(rows), CHUNK):
        own = rows[at : at + CHUNK]
        a, b = np.nonzero(turned[own] @ turned[columns].T >= least)
        a, b = own[a], columns[b]
        if not cross:
            a, b = a[a < b], b[a < b]
        a, b = _fresh(keys, int(pdf["band"].iloc[0]), a, b)
        hit[a] = hit[b] = True
    return pdf.loc[hit, ["bucket", "band", "bi", "bj", "own", "class"]]


def _links(pdf: pd.DataFrame, limit: float, confidence: float | None, signs: int, bands: int) -> pd.DataFrame:
    """Links of one block or pair of blocks: per vector their weighted number, and the smallest vector it hangs on."""
    units = unit(np.stack(pdf["embedding"].to_list()).astype(np.float64))
    bits, keys = _signs(pdf, signs, bands)
    codes, band = np.packbits(bits[:, : units.shape[1]], axis=1), int(pdf["band"].iloc[0])
    alpha, ids, weight = (pdf[c].to_numpy() for c in ("alpha", "class", "weight"))
    rows, columns, cross = _sides(pdf)
    links, label = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
    for at in range(0, len(rows), CHUNK):
        own = rows[at : at + CHUNK]
        a, b = np.nonzero(may_link(codes[own], alpha[own], units[columns], limit, confidence))
        a, b = own[a], columns[b]
        if not cross:
            a, b = a[a < b], b[a < b]
        close = np.einsum("ij,ij->i", units[a], units[b]) >= limit
        a, b = _fresh(keys, band, a[close], b[close])
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        label = forest(len(pdf), np.concatenate([np.arange(len(pdf)), a]), np.concatenate([label, b]))
    some = links > 0
    least = np.full(len(pdf), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return pd.DataFrame({"a": ids[some], "b": least[label[some]], "links": links[some]})


def near_duplicates(embeddings: DataFrame, limit: float = LIMIT, confidence: float | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.when(usable("embedding"), F.col("embedding")).alias("embedding"))
    rows = stage(rows.withColumn("class", F.xxhash64("embedding")), "vectors")
    good = rows.filter("embedding is not null")
    classes = stage(good.groupBy("embedding").agg(F.min("class").alias("class"), F.count("*").alias("weight"), F.min("vec_id").alias("least")), "classes")
    signs, bands = plan_bands(classes.count(), limit)
    coded = stage(index(classes.select("class", "weight", "embedding"), signs, bands), "codes")
    spread = coded.select("class", "dim", "bits", F.posexplode("keys").alias("band", "sign"))
    spread = spread.withColumn("bucket", F.xxhash64("band", "sign", "dim")).drop("sign")
    blocks = pair_blocks(spread, "bucket", "class", BLOCK).groupBy("bucket", "bi", "bj")
    schema = "bucket long, band int, bi int, bj int, own int, class long"
    met = stage(blocks.applyInPandas(lambda pdf: _meet(pdf, limit, signs, bands), schema), "met")
    blocks = met.join(coded.drop("keys"), "class").groupBy("bucket", "bi", "bj")
    schema = "a long, b long, links long"
    found = blocks.applyInPandas(lambda pdf: _links(pdf, limit, confidence, signs, bands), schema)
    found = stage(found.groupBy("a", "b").agg(F.sum("links").alias("links")), "links")
    parts = components(found)
    numbers = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    joined = classes.select("class", "weight", "least").join(numbers, "class", "left").join(parts, F.col("class") == F.col("node"), "left")
    part = stage(joined.select("class", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class").alias("part")), "parts")
    smallest = part.groupBy("part").agg(F.min("least").alias("component"))
    by_class = part.join(smallest, "part").select("class", "n_links", "component")
    linked = rows.filter("embedding is not null").drop("embedding").join(by_class, "class")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    alone = rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.select("vec_id", "n_links", component.alias("component_id")).union(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
