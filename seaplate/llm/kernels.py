"""Byte-level numpy kernels that run inside tasks: word runs and polynomial hashes.

Texts are joined into one byte buffer with a line feed between documents. A run
is a maximal stretch of bytes for which a 256-entry table is true. The hash of
bytes ``s..e`` comes from prefix sums of ``value[b] * BASE**i`` modulo 2**64,
shifted back by ``BASE**-s`` and mixed, so that any stretch is hashed in constant
time. Buffers are worked through in segments, so memory does not grow with a
long text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD6E8FEB86659FD93
U64 = np.uint64

_values = np.random.default_rng(20240601).integers(1, 1 << 63, size=256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SEGMENT + 4096)
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, factor, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix(buffer: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[0] = 0; bytes s..e have the raw hash (P[e] - P[s]) * BASE**-s."""
    up, _ = powers(len(buffer))
    out = np.zeros(len(buffer) + 1, U64)
    np.cumsum(_values[buffer] * up, dtype=U64, out=out[1:])
    return out


def window_hashes(buffer: np.ndarray, width: int) -> np.ndarray:
    """A mixed hash of every stretch of ``width`` bytes, by its start."""
    n = len(buffer) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    sums = prefix(buffer)
    _, down = powers(n)
    return mix((sums[width:] - sums[:-width]) * down)


def join_texts(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer and the documents' starts, with the buffer's length plus one at the end; null counts as empty."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts), np.uint8), starts


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true stretches."""
    edges = np.flatnonzero(np.diff(member.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[0::2], edges[1::2]


def run_hashes(buffer: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A mixed hash of each run, with its length."""
    out = np.empty(len(s), U64)
    at = 0
    while at < len(s):
        stop = max(at + 1, int(np.searchsorted(s, s[at] + SEGMENT)))
        low = int(s[at])
        sums = prefix(buffer[low : int(e[at:stop].max())])
        _, down = powers(int(s[stop - 1]) - low + 1)
        left = s[at:stop] - low
        out[at:stop] = (sums[e[at:stop] - low] - sums[left]) * down[left] + (e[at:stop] - s[at:stop]).astype(U64) * U64(STEP)
        at = stop
    return mix(out)


def words(texts: Iterable[str | None], member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Word hashes with A-Z lower-cased, each word's document, words per document, and (buffer, starts, ends)."""
    buffer, at = join_texts(texts)
    low = LOWER[buffer]
    s, e = runs(member[low])
    counts = np.diff(np.searchsorted(s, at))
    return run_hashes(low, s, e), np.repeat(np.arange(len(at) - 1), counts), counts, (low, s, e)


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A mixed hash of every n consecutive words."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, U64)
    out = np.zeros(count, U64)
    for k in range(n):
        out = out * U64(STEP) + h[k : k + count]
    return mix(out + U64(n))


def slices(texts: list[str | None], limit: int = SEGMENT) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` characters; a longer text is one slice."""
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > limit:
            yield slice(at, i)
            at, size = i, 0
        size += len(text or "") + 1
    if at < len(texts):
        yield slice(at, len(texts))
