"""Plain-Python versions of the operators over lists of rows, and a table of odd documents."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, length int, band int"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def odd_documents(seed: int = 5, copies: int = 12) -> list[tuple]:
    """Random prose with nulls, empty, very long and non-ASCII texts, copies, near copies, shared lines and passages,
    repeated rows, and columns named like the operators' own."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choices(vocabulary, k=n))
    passage, line, base = prose(60), "  Shared LINE " + prose(12) + "\t", prose(120)
    texts = [None, "", " \t ", "one", "two words", "ÀÉÎ œuvre Σας łódź 漢字 " + prose(30), "x" * 300, "ab" * 400, prose(9000), base]
    texts += [base] * copies
    for i in range(copies):
        words = base.split(" ")
        words[draw.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words) + (" tail" if i % 2 else ""))
    for i in range(8):
        texts.append(prose(draw.randint(5, 60)) + "\n" + line + "\n" + prose(8) + "\n" + line.upper() + ("\n" if i % 3 else ""))
        texts.append(prose(40) + " " + passage + " " + prose(draw.randint(1, 50)))
    texts += [prose(draw.randint(1, 200)) for _ in range(20)]
    rows = [(i * 3, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s3", "é"][min(i % 7, 4)], len(t or ""), "b", i, 1) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, prose(30), "en", "s1", 1, "b", 0, 1), (None, None, None, None, None, None, None, None)]
    draw.shuffle(rows)
    return rows


def reach(ids, links):
    """The smallest id reachable from each."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text: str | None) -> frozenset:
    words = SPACE_WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_duplicates(rows):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows."""
    sets = [(d, shingles(t)) for d, t in rows]
    known = [(d, s) for d, s in sets if s and d is not None]
    links = [(a, b) for i, (a, x) in enumerate(known) for b, y in known[:i] if a != b and 100 * len(x & y) >= 75 * len(x | y)]
    part = reach({d for d, _ in sets if d is not None}, links)
    return [(d, len(s), part.get(d), d is None or part[d] == d) for d, s in sets]


def lines(rows):
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text) rows; a null id is smaller than any."""
    small = -(1 << 63)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    documents = lambda ids: len(set(ids) - {small}) + ids.count(small)
    found = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            found[k].append(small if d is None else d)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < 40 or documents(found[key(x)]) < 5 or max(found[key(x)]) == (small if d is None else d)]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def benchmark_hits(rows, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of (doc_id, text) rows."""
    windows = defaultdict(set)
    for item, text in items:
        words = tuple(ITEM_WORD.findall((text or "").translate(UPPER)))
        for i in range(max(1, len(words) - 12) if words else 0):
            windows[words[i : i + 13]].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        words = tuple(ITEM_WORD.findall((t or "").translate(UPPER)))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if words[i : i + n] in windows:
                    hit.update(range(i, i + n))
                    found |= windows[words[i : i + n]]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def repeats(rows, length: int = 100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows in document order."""
    seen, out = set(), []
    for d, t in rows:
        data = (t or "").encode()
        cover = bytearray(len(data))
        for p in range(len(data) - length + 1):
            own = data[p : p + length]
            if own in seen:
                cover[p : p + length] = b"\1" * length
            seen.add(own)
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        out.append((d, len(data), len(data) - len(kept), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


def targets(sizes: dict, epochs: int = 3) -> dict:
    """Targets by resharing the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full: dict = {}
    while True:
        rest = sum(sizes.values()) - sum(full.values())
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > epochs * sizes[s]]
        if not over:
            return full | share
        full |= {s: float(epochs * sizes[s]) for s in over}


def token_rows(rows, tokenizer):
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, text) rows in document order."""
    out, at = [], 0
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def vector_links(rows, limit: float = 0.95):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector) rows."""
    good = []
    for i, (d, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, d, np.array(v, float) / np.linalg.norm(np.array(v, float))))
    links = [(i, j) for i, _, x in good for j, _, y in good if i != j and len(x) == len(y) and x @ y >= limit]
    ids = [d for d, _ in rows]
    part = reach(range(len(rows)), links)
    least = {}
    for i, p in part.items():
        if ids[i] is not None:
            least[p] = min(least.get(p, ids[i]), ids[i])
    count = defaultdict(int)
    for i, _ in links:
        count[i] += 1
    out = []
    for i, d in enumerate(ids):
        c = None if d is None else least[part[i]]
        out.append((d, count[i], c, d is not None and c == d))
    return out


def _digest(*parts) -> str:
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def _climb(nodes: list[str]) -> list[list[str]]:
    """The levels of one tree, its leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def _siblings(levels: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for row in levels[:-1]:
        first = i // 8 * 8
        out.append((row[first:i], row[i + 1 : first + 8]))
        i //= 8
    return out


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, text, lang, source, n_chars) rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _digest(*(field(v) for v in (r[0], r[3], r[2], r[4], text)))
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    levels = {x: _climb([leaf(r, r[1]) for r in trees[x]]) for x in langs}
    top = _climb([levels[x][-1][0] for x in langs])
    out = []
    for j, x in enumerate(langs):
        for i, r in enumerate(trees[x]):
            path = _siblings(levels[x], i) + _siblings(top, j)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            folded = leaf(r, r[1].translate(UPPER) if tampered else r[1])
            for left, right in path:
                folded = _digest(*left, folded, *right)
            proof = _digest(*(d for left, right in path for d in left + right))
            out.append((r[0], leaf(r, r[1]), levels[x][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def phrase_counts(rows, most: int = 4):
    """Counts of all (lang, words) up to ``most`` words, and of all words by language, of (text, lang) rows."""
    counts, totals = defaultdict(int), defaultdict(int)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for n in range(1, min(most, len(words) - i) + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    return counts, totals


def collocations(rows, least: int = 30, top: int = 2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    counts, totals = phrase_counts(rows)
    found = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    longer = defaultdict(int)
    for (lang, g), a in found.items():
        for n in range(2, len(g)):
            for i in range(len(g) - n + 1):
                longer[lang, g[i : i + n]] = max(longer[lang, g[i : i + n]], a)
    lists = defaultdict(list)
    for (lang, g), a in found.items():
        if 100 * longer[lang, g] >= 80 * a:
            continue
        cuts = [(2000000 * a // (counts[lang, g[:k]] + counts[lang, g[k:]]), k, counts[lang, g[:k]], counts[lang, g[k:]]) for k in range(1, len(g))]
        score, _, left, right = min(cuts)
        lists[lang].append((-score, -a, " ".join(g).encode(), left, right))
    out = []
    for lang, own in lists.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def passages(rows, width: int = 50):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows; a null id is smaller than any."""
    small = lambda d: -(1 << 63) if d is None else d
    texts = [(d, SPACE_WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, words in texts:
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            least[key] = min(least.get(key, small(d)), small(d))
    out = []
    for d, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if least[tuple(words[i : i + width])] < small(d):
                gone[i : i + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
