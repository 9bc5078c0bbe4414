"""The manifest, collocations and passage dedup against brute force: odd rows, hot groups, coarse hashes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from brute import DOCS, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from seaplate.llm import collocations, manifest, passages


def same(df, expected):
    assert Counter(map(tuple, df.collect())) == Counter(expected)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tampered(docs):
    return F.when(F.crc32(docs["doc_id"].cast("string")) % 3 == 0, manifest.lower_case(docs["text"]))


def test_manifest(spark, none):
    rows = odd_documents()
    rows += [(1000 + i, f"Text {i}", f"l{i % 11}", "s", 5, "b", 0, 1) for i in range(60)]  # more than one run of trees
    rows += [(5000 + i, "A b", "zz", None, None, "b", 0, 1) for i in range(600)] + [(7, "A b", "zz", None, None, "b", 0, 1)] * 20
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    same(manifest.summary(manifest.manifest(docs, tampered(docs))), brute.manifest(rows))
    assert manifest.manifest(none).count() == 0


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_trees_of_one_language(spark, n):
    rows = [(i, "Á" * i, None, "s", i, "b", 0, 1) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    same(manifest.summary(manifest.manifest(docs, tampered(docs))), brute.manifest(rows))


def test_labels_nest_and_no_bucket_is_hot(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SPAN", 64)
    rows = [(i, str(i), "en", "s", i, "b", 0, 1) for i in range(700)]
    docs = spark.createDataFrame(rows, DOCS)
    forest = manifest.grow(manifest.leaves(docs))
    nodes = [r.asDict() for r in forest.nodes.collect()]
    for r in nodes:
        inner = [(c["lo"], c["hi"]) for c in r["children"]]
        assert inner[0][0] == r["lo"] and inner[-1][1] == r["hi"]
        assert all(a[1] + 1 == b[0] for a, b in zip(inner, inner[1:], strict=False))
    same(manifest.summary(manifest.manifest(docs, tampered(docs))), brute.manifest(rows))


def phrase_rows(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["the", "of", "É", "a\0b", "x-y"]
    weights = [1] * 25 + [60, 40, 5, 3, 3]
    line = lambda n: "".join(w + draw.choice([" "] * 12 + ["\t", ", ", ".", " \r\n"]) for w in draw.choices(words, weights, k=n))
    rows = [(i, line(draw.randint(0, 60)), draw.choice(["en", "en", None, "und", "de\n"]), "s", 1, "b", 0, 1) for i in range(700)]
    rows += [(1, "Same Old passage of the same OLD words", "en", "s", 1, "b", 0, 1)] * 50
    return rows + [(None, None, "en", None, None, None, None, None), (9, "", None, "s", 0, "b", 0, 1), (10, " \t.,;", "en", "s", 0, "b", 0, 1)]


@pytest.mark.parametrize(("group_bytes", "divisor"), [(4 << 20, 16), (2000, 16), (2000, 4000)])
def test_collocations(spark, none, monkeypatch, group_bytes, divisor):
    """With the large divisor most frequent words are hot."""
    monkeypatch.setattr(collocations.document_groups, "__defaults__", (group_bytes,))
    groups = collocations.document_groups
    monkeypatch.setattr(collocations, "document_groups", lambda docs: (*groups(docs)[:2], groups(docs)[2] * 16 // divisor))
    rows = odd_documents() + phrase_rows(3)
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    expected = brute.collocations([(r[1], r[2]) for r in rows])
    assert len(expected) > 100
    scored = collocations.scored_phrases(docs)
    same(collocations.top_phrases(scored), expected)
    same(collocations.top_phrases(scored, top=7), [r for r in expected if r[1] <= 7])
    assert collocations.top_phrases(collocations.scored_phrases(none)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 4)] * 4, st.integers(1, 9)), min_size=1, max_size=200), st.integers(1, 40))
def test_equal_partitions_are_counts(suffixes, least):
    words, weight = np.array([s[:4] for s in suffixes], np.uint32), np.array([s[4] for s in suffixes])
    for d in range(1, 4):  # a suffix ends at its first 0
        words[:, d] = np.where(words[:, d - 1] > 0, words[:, d], 0)
    wanted = Counter()
    for w, n in zip(words.tolist(), weight.tolist(), strict=True):
        for d in range(2, 5):
            if 0 not in w[:d]:
                wanted[tuple(w[:d])] += n
    limits = (collocations.NEVER, least, least, least)
    found = {tuple(words[r, :d].tolist()): n for rows, d, counts in collocations.equal_partitions(words, weight, limits) for r, n in zip(rows, counts, strict=True)}
    assert found == {w: n for w, n in wanted.items() if n >= least}


def test_a_hot_word_goes_to_many_shards():
    hot = int(collocations.HOT) | 5
    same_lead = np.array([[hot, i, 0, 0] for i in range(1, 400)], np.uint32)
    assert len(np.unique(collocations.route(same_lead, 16))) == 16
    assert len(np.unique(collocations.route(same_lead & ~collocations.HOT, 16))) == 1


def passage_rows() -> list[tuple]:
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(draw.choices(words, k=n))
    shared = [prose(n) for n in (50, 51, 49, 75, 120, 300)]
    rows = odd_documents()
    for i in range(60):
        again = f" {shared[0]} {shared[0]}" if i % 7 == 0 else ""
        text = f"{prose(draw.randint(0, 80))} {draw.choice(shared)}\n{prose(draw.randint(0, 30))}\t{draw.choice(shared)}{again}"
        rows.append((10000 + i, text, "en", "s", 1, "b", 0, 1))
    rows += [(10005, shared[5], "en", "s", 1, "b", 0, 1)] * 3 + [(None, shared[4] + " " + shared[3], "en", "s", 1, "b", 0, 1)]
    return rows + [(None, shared[4], "en", "s", 1, "b", 0, 1)]


@pytest.mark.parametrize(("hot", "group_bytes"), [(4096, 4 << 20), (4096, 3000), (0, 3000)])
def test_passages(spark, none, monkeypatch, hot, group_bytes):
    monkeypatch.setattr(passages, "HOT", hot)
    monkeypatch.setattr(passages.document_groups, "__defaults__", (group_bytes,))
    rows = passage_rows()
    result = passages.remove_passages(spark.createDataFrame(rows, DOCS).repartition(5))
    same(passages.summary(result), brute.passages([(r[0], r[1]) for r in rows]))
    assert passages.remove_passages(none).count() == 0


@pytest.mark.parametrize("hot", [4096, 3, 0])
def test_passages_are_compared_whatever_their_hashes(monkeypatch, hot):
    """The blocks' window hashes have 8 bits, so most equal hashes are of different windows."""
    hashes = passages.k.sequence_hashes
    monkeypatch.setattr(passages.k, "sequence_hashes", lambda h, n: hashes(h, n) & np.uint64(0xFF00 if n == passages.WIDTH else (1 << 64) - 1))
    monkeypatch.setattr(passages, "HOT", hot)
    rows, groups, shards = [(r[0], r[1]) for r in passage_rows()], 4, 3
    tables = []
    for b in range(groups):
        ids, texts = zip(*rows[b::groups], strict=True)
        data = [pa.array(ids, pa.int64()), pa.array([None if t is None else t.encode() for t in texts], pa.binary()), pa.array([b] * len(ids), pa.int32())]
        tables.append(pa.table(data, ["doc_id", "text", "bucket"]))
    replies = passages._table([], passages.REPLY)
    own = lambda b: replies.filter(pc.equal(replies["bucket"], b))
    for send in (lambda t, r: passages.send_anchors(t, shards), lambda t, r: passages.send_pieces(t, r, shards), lambda t, r: passages.send_hot(t, r, shards)):
        sent = pa.concat_tables([send(t, own(b)) for b, t in enumerate(tables)])
        asked = sorted(set(sent["shard"].to_pylist()))
        replies = pa.concat_tables([replies, *(passages.answer(sent.filter(pc.equal(sent["shard"], s))) for s in asked)])
    found = [r for b, t in enumerate(tables) for r in passages.remove(t, own(b), shards).to_pylist()]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in found) == Counter(brute.passages(rows))


@pytest.mark.parametrize("hot", [4096, 3, 0])
def test_passages_whatever_the_order_of_a_groups_rows(monkeypatch, hot):
    """Shuffle reads do not keep the order of rows, and blocks answer by the order of a group's pieces."""
    monkeypatch.setattr(passages, "HOT", hot)
    rows, groups, shards, draw = [(r[0], r[1]) for r in passage_rows()], 4, 3, random.Random(6)

    def tables():
        for b in range(groups):
            own = rows[b::groups]
            ids, texts = zip(*draw.sample(own, len(own)), strict=True)
            data = [pa.array(ids, pa.int64()), pa.array([None if t is None else t.encode() for t in texts], pa.binary()), pa.array([b] * len(ids), pa.int32())]
            yield pa.table(data, ["doc_id", "text", "bucket"])

    replies = passages._table([], passages.REPLY)
    own = lambda b: replies.filter(pc.equal(replies["bucket"], b))
    for send in (lambda t, r: passages.send_anchors(t, shards), lambda t, r: passages.send_pieces(t, r, shards), lambda t, r: passages.send_hot(t, r, shards)):
        sent = pa.concat_tables([send(t, own(b)) for b, t in enumerate(tables())])
        sent = sent.take(pa.array(draw.sample(range(sent.num_rows), sent.num_rows), pa.int64()))
        asked = sorted(set(sent["shard"].to_pylist()))
        replies = pa.concat_tables([replies, *(passages.answer(sent.filter(pc.equal(sent["shard"], s))) for s in asked)])
    found = [r for b, t in enumerate(tables()) for r in passages.remove(t, own(b), shards).to_pylist()]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in found) == Counter(brute.passages(rows))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 31, 38, 39, 45, 48, 49, 50, 51, 92, 93, 94])
def test_groups_of_few_words(n):
    """Every stretch of windows has its pieces, down to groups without any."""
    text = " ".join(f"w{i}" for i in range(n)).encode()
    for texts in ([text], [text, None, b"", b" \t", text]):
        table = pa.table([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary()), pa.array([0] * len(texts), pa.int32())], ["doc_id", "text", "bucket"])
        group = passages.Group(table)
        windows = sorted(p for a, b in zip(group.low.tolist(), group.high.tolist(), strict=True) for p in range(a, b + 1))
        assert windows == [at + p for at in ([0] if len(texts) == 1 else [0, n]) for p in range(max(0, n - 49))]


def test_tables_without_words(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "b", 0, 1) for i, t in enumerate([None, "", " ", "\n"])], DOCS)
    assert collocations.top_phrases(collocations.scored_phrases(docs)).count() == 0
    assert {(r["n_words"], r["n_removed"], bytes(r["kept"])) for r in passages.remove_passages(docs).collect()} == {(0, 0, b"")}
