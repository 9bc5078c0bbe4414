"""The operators against brute force, over documents with every odd case and over the given tables."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from brute import DOCS, odd_documents
from compare import connect, differences
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from seaplate.llm import decontam, graph, kernels, langid, lines, mixing, neardup, quality, substrings, tables, tokens, vectors, warc
from seaplate.llm.oracles import ORACLES
from seaplate.llm.queries import QUERIES
from seaplate.session import staging_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return odd_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def same(df, expected):
    assert Counter(map(tuple, df.collect())) == Counter(expected)


def texts_of(rows):
    return [(r[0], r[1]) for r in rows]


def in_order(rows):
    """By doc_id with null first; rows of one id are equal here, or null."""
    return sorted(texts_of(rows), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result_as_sql(spark, folder, name):
    con = connect(folder)
    assert differences(QUERIES[name](spark, folder), con, ORACLES[name]) == []
    con.close()


def test_near_duplicates(docs, rows, none):
    same(neardup.near_duplicates(docs), brute.near_duplicates(texts_of(rows)))
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {d for d, _, _, keep in brute.near_duplicates(texts_of(rows)) if keep and d is not None}
    found = [r["doc_id"] for r in kept.collect()]
    assert Counter(found) == Counter(expected) + Counter({None: sum(r[0] is None for r in rows)})


def test_a_star_whose_centre_hides_a_link(spark):
    """Two texts are linked to each other while each bucket's smallest is linked to one of them at most."""
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:330] + [f"a{i}" for i in range(60)])), (2, " ".join(words[40:330] + [f"a{i}" for i in range(60)]))]
    rows += [(i, " ".join(words[i : i + 200])) for i in range(3, 40)]
    same(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), brute.near_duplicates(rows))


def test_small_sets_share_a_bucket():
    """All pairs of small sets at the limit: one shingle more, or one changed in sets of seven."""
    draw = np.random.default_rng(21)
    for small, large, times in ((3, 4, 6000), (4, 5, 2000), (6, 7, 2000), (7, 7, 2000)):
        for _ in range(times):
            values = np.unique(draw.integers(0, 1 << 63, 8, dtype=np.uint64))
            a, b = values[:large], values[1 : 1 + small] if small == large else values[:small]
            assert len(np.intersect1d(neardup.band_keys(a), neardup.band_keys(b)))


def test_empty_bins_do_not_fall_back_together():
    """Two filled bins are copied about equally often, into all other bins."""
    two = np.array([1, 2], np.uint64)
    counts = np.unique(neardup.signature(two), return_counts=True)[1]
    assert len(counts) == 2 and counts.min() > 48


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Blocks of a few rows, so that a bucket's members are dealt into many."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        own = list(words)
        for j in rng.choice(150, 3, replace=False):
            own[j] = f"e{i}_{j}"
        rows.append((i, " ".join(own)))
    same(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), brute.near_duplicates(rows))


def test_lines(docs, rows, none):
    same(lines.summary(lines.dedup_lines(docs)), brute.lines(texts_of(rows)))
    assert lines.dedup_lines(none).count() == 0


@pytest.mark.parametrize("group_bytes", [100, 4 << 20])
def test_lines_of_repeated_ids(spark, monkeypatch, group_bytes):
    """Rows of one id are one document, in one group or in several."""
    monkeypatch.setattr(lines, "document_groups", partial(tables.document_groups, group_bytes=group_bytes))
    a, b, c, d = ("the same words in many documents, number " + x for x in "abcd")
    rows = [(1, f"{a}\nrow {i}") for i in range(7)] + [(2, a), (2, a)]  # two documents
    rows += [(i % 4, f"{b}\n{i}\n{b}") for i in range(12)]  # four
    rows += [(i % 5, f"{i}\n{c}") for i in range(10)] + [(4, c), (4, c.upper())]  # five
    rows += [(None, d)] * 4 + [(9, d)]  # five
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("again", F.lit(1)).repartition(5)
    found = brute.lines(rows)
    assert sum(n for _, _, n, _ in found) == 8 + 4
    same(lines.summary(lines.dedup_lines(frame)), found)


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    places = lines.PerfectHash.build(keys)
    assert sorted(places.place(keys)) == list(range(len(keys)))
    assert lines.PerfectHash.build(keys[:0]).place(keys[:3]).tolist() == [-1, -1, -1]


def test_decontamination(spark, docs, rows, none):
    words = next(r[1] for r in rows if r[1] and len(r[1]) > 40000).split(" ")
    items = [
        (1, " ".join(words[:20])), (10, "!".join(words[2000:2013]).upper()), (2, " ".join(words[5:9])), (2, " ".join(words[5:9])),
        (3, words[77]), (4, ""), (5, None), (None, " ".join(words[300:316])), (6, "not to be found anywhere"), (7, " ".join(words[300:330])),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.benchmark_hits(texts_of(rows), items)
    same(decontam.summary(decontam.find_benchmark(docs, benchmark)), expected)
    same(decontam.summary(decontam.find_benchmark(docs, benchmark, piece=3)), expected)
    dirty = Counter(d for d, *_, bad in expected if bad)
    clean = decontam.clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in rows) - dirty
    assert decontam.find_benchmark(none, benchmark).count() == 0
    assert decontam.find_benchmark(docs, benchmark.limit(0)).filter("size(spans) > 0 or size(items) > 0").count() == 0


@pytest.mark.parametrize("hot", [substrings.HOT, 0])
def test_repeated_strings(docs, rows, none, monkeypatch, hot):
    """With the limit at 0 every shared anchor takes the way of the hot ones."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "PIECE", 4096)
    result = substrings.remove_repeats(docs)
    same(substrings.summary(result), brute.repeats(in_order(rows)))
    assert substrings.remove_repeats(none).count() == 0


def test_segments_whose_keys_agree_in_their_low_bits(monkeypatch):
    """Each document is a group, and the low 16 bits of all segments' keys are equal."""
    segments = substrings.Group._segments

    def coarse(self):
        segments(self)
        self.key &= ~np.uint64(0xFFFF)

    monkeypatch.setattr(substrings.Group, "_segments", coarse)
    draw = np.random.default_rng(12)
    prose = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    passage = prose(700)
    rows = [(i, prose(300) + passage + prose(300)) for i in range(2)]
    tables = [pa.table({"doc_id": [d], "text": [t.encode()], "bucket": pa.array([d], pa.int32())}) for d, t in rows]
    replies = substrings._replies([])
    own = lambda i: replies.filter(pc.equal(replies["bucket"], i))
    for send, answer in (
        (lambda t, r: substrings.send_anchors(t, 1), substrings.answer_anchors),
        (lambda t, r: substrings.send_classes(t, r, 1), substrings.answer_classes),
        (lambda t, r: substrings.send_strings(t, r, 1), substrings.answer_strings),
    ):
        sent = pa.concat_tables([send(t, own(i)) for i, t in enumerate(tables)])
        replies = pa.concat_tables([replies, answer(sent)])
    found = [substrings.remove(t, own(i)).to_pylist()[0] for i, t in enumerate(tables)]
    assert [r["spans"] for r in found] == [[], [{"start": 300, "end": 1000}]]


def rounds_of_repeats(rows, groups: int, shards: int, draw: random.Random) -> Counter:
    """The rounds without Spark, whose groups and shards get their rows in another order each time."""

    def shuffled(x):
        return draw.sample(x, len(x))

    def tables():
        for b in range(groups):
            ids, texts = zip(*shuffled(rows[b::groups]), strict=True)
            yield pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([(t or "").encode() for t in texts], pa.binary()), "bucket": pa.array([b] * len(ids), pa.int32())})

    def answers(sent, answer):
        for s in sorted(set(sent["shard"].to_pylist())):
            own = sent.filter(pc.equal(sent["shard"], s))
            yield answer(own.take(shuffled(range(own.num_rows))))

    replies = substrings._replies([])
    own = lambda b: replies.filter(pc.equal(replies["bucket"], b))
    for send, answer in (
        (lambda t, r: substrings.send_anchors(t, shards), substrings.answer_anchors),
        (lambda t, r: substrings.send_classes(t, r, shards), substrings.answer_classes),
        (lambda t, r: substrings.send_strings(t, r, shards), substrings.answer_strings),
    ):
        sent = pa.concat_tables([send(t, own(b)) for b, t in enumerate(tables())])
        replies = pa.concat_tables([replies, *answers(sent, answer)])
    found = [r for b, t in enumerate(tables()) for r in substrings.remove(t, own(b)).to_pylist()]
    size = lambda r: sum(s["end"] - s["start"] for s in r["spans"])
    return Counter((r["doc_id"], r["n_bytes"], size(r), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in found)


@pytest.mark.parametrize("hot", [substrings.HOT, 0])
def test_repeated_strings_whatever_the_order_of_a_groups_rows(rows, monkeypatch, hot):
    """Shuffle reads do not keep the order of rows, and a piece of the buffer ends within other texts in each order."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "PIECE", 1024)
    rows = in_order(rows)
    for seed in range(3):
        assert rounds_of_repeats(rows, 3, 4, random.Random(seed)) == Counter(brute.repeats(rows))


def test_repeated_strings_of_texts_under_one_id():
    """Two texts of one id whose hashes agree in 24 bits: what both hold stays in the same one of them."""
    draw = random.Random(4)
    passage = "".join(draw.choices("abcdefghijklmnopqrst", k=3000))
    seen, pair = {}, None
    while pair is None:
        text = f"{len(seen):06d}{passage}"
        other = seen.setdefault(xxhash.xxh3_64_intdigest(text.encode()) & 0xFFFFFF, text)
        pair = None if other is text else [(7, other), (7, text)]
    for seed in range(5):
        found = sorted(r[2] for r in rounds_of_repeats(pair, 2, 8, random.Random(seed)))
        assert found[0] == 0 and found[1] >= 3000


def test_repeated_strings_of_the_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    same(QUERIES["op5_suffix_dedup"](spark, folder), brute.repeats(rows))


def test_common_extension_and_suffix_order():
    text = np.frombuffer(b"abcab" * 60 + b"abcax" * 60 + bytes(200), np.uint8)
    starts = np.arange(0, 500, 7)
    bucket = np.zeros(len(starts), np.uint64)
    order, equal = substrings.sort_suffixes(text, starts, bucket)
    strings = [text[s : s + substrings.LENGTH].tobytes() for s in starts[order]]
    assert strings == sorted(strings)
    assert equal.tolist() == [False, *(a == b for a, b in zip(strings, strings[1:], strict=False))]


def test_mix(spark, docs, rows, none):
    found = [r.asDict() for r in mixing.taken(docs).collect()]
    size = lambda t: len(brute.SPACE_WORD.findall(t or ""))
    sizes, source = defaultdict(int), defaultdict(Counter)
    for r in rows:
        sizes[r[3]] += size(r[1])
        source[r[0], size(r[1])][r[3]] += 1
    wanted = brute.targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], size(r[1])) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    taken = Counter()
    for r in found:
        taken[r["source_size"]] += r["taken"]
        assert any(sizes[s] == r["source_size"] and wanted[s] == pytest.approx(r["target"]) for s in source[r["doc_id"], r["size"]])
    for s in sizes:
        assert taken[sizes[s]] == pytest.approx(wanted[s], rel=0.05, abs=300)
    again = mixing.taken(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(tuple(r.values()) for r in found)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += size(r["text"])
    whole = Counter()
    for r in found:
        whole[r["doc_id"]] += r["taken"]
    assert +words == +whole
    assert mixing.taken(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, "", "a")], "doc_id long, text string, source string")
    assert sorted(r["taken"] for r in mixing.taken(blank).collect()) == [0, 0]


def test_a_block_is_in_one_slot_of_its_source_per_epoch(docs):
    rows = mixing.mixture(docs).filter("slot is not null").groupBy("slot").agg(F.countDistinct("sid", "block", "epoch").alias("n"), F.sum("words").alias("w"), F.max("length").alias("most"))
    assert rows.filter("n != 1 or w > most").count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_tokens(spark, docs, rows, none, kind):
    folder = staging_path(spark, "tokens")
    tokens.write_tokens(docs, folder, TOKENIZER, kind)
    found = tokens.read_tokens(spark, folder)
    expected = brute.token_rows(in_order(rows), Tokenizer.from_file(TOKENIZER))
    named = lambda part: [r for r in part if r[0] is not None]
    assert Counter(named(map(tuple, found.drop("ids").collect()))) == Counter(named(expected))
    assert Counter(r[2:] for r in found.drop("ids").collect()) == Counter(r[2:] for r in expected)
    index = spark.read.parquet(f"{folder}/index")
    assert index.agg(F.sum("n_docs")).first()[0] == len(rows)
    empty = staging_path(spark, "tokens")
    tokens.write_tokens(none, empty, TOKENIZER, kind)
    assert tokens.read_tokens(spark, empty).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["it's 'll'LL don't", "a\x1cb\xa0c\x85d", "İSTANBUL ẞ ǅ", "Σας ΟΔΟΣ", "a<|endoftext|>b", "é é", "½²³ 12", "", "...!!'s 's'"]
    ids, counts = tokens.encoder(TOKENIZER).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    draw = np.random.default_rng(2)
    for n in (0, 1, tokens.BLOCK_IDS, tokens.BLOCK_IDS * 2 + 5):
        ids = draw.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (tokens.from_planes(tokens.to_planes(ids, kind), n, kind) == ids).all()


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    draw = np.random.default_rng(4)
    base = draw.normal(size=16)
    rows = [(i, (base + draw.normal(size=16) * 0.15).tolist()) for i in range(60)]
    rows += [(100 + i, draw.normal(size=16).tolist()) for i in range(80)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (None, rows[1][1]), (301, None), (302, [0.0] * 16), (303, [float("nan")] * 16)]
    rows += [(304, [None] * 16), (305, [float("inf")] + [1.0] * 15), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, []), (309, [1e300, 1e300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("bucket", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    same(vectors.near_duplicates(frame), brute.vector_links(rows))
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_estimates_are_unbiased_and_margins_hold():
    draw = np.random.default_rng(6)
    units = vectors.unit(draw.normal(size=(400, 64)))
    codes, alpha = vectors.encode(units)
    near = vectors.unit(units + draw.normal(size=units.shape) * 0.03)
    assert np.diag(vectors.may_link(codes, alpha, near, 0.95, None)).all()
    assert vectors.may_link(codes, alpha, units, 0.95, None).mean() < 0.01


def test_recall_of_bands():
    signs, bands = vectors.plan_bands(50_000, 0.95)
    assert (1 - (1 - np.arccos(0.95) / np.pi) ** signs) ** bands <= vectors.MISS


@pytest.mark.parametrize("dim", [2, 5, 16, 64, 300])
@pytest.mark.parametrize("count", [300, 50_000, 10_000_000])
def test_planted_pairs_at_the_limit_meet(dim, count):
    """They share a band and pass the bound on unlike signs, while hardly any unrelated pair of longer vectors passes it."""
    draw = np.random.default_rng([dim, count])
    a = vectors.unit(draw.normal(size=(5000, dim)))
    side = draw.normal(size=a.shape)
    side = vectors.unit(side - (side * a).sum(1)[:, None] * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    signs, bands = vectors.plan_bands(count, 0.95)
    x, y = (vectors.sign_bits(v, signs, bands) for v in (a, b))
    assert (vectors.band_keys(x, dim, bands) == vectors.band_keys(y, dim, bands)).any(1).all()
    most = vectors.most_unlike(x.shape[1], 0.95)
    assert ((x != y).sum(1) <= most).all()
    if dim >= 64:
        assert ((x != np.roll(x, 1, axis=0)).sum(1) <= most).mean() < 0.01


def test_language(spark, docs, none):
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    found = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert {lang for _, lang, _ in found} <= {"en", "de", "und"} and all(0 <= s <= 1 for *_, s in found)
    assert {lang for d, lang, _ in found if d in (0, 3, 6)} == {"und"}
    assert langid.predict(none, model).count() == 0
    nothing = langid.learn(none.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_backs_off_to_shorter_grams(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("street streets strong", "en"), ("strasse strassen", "de")] * 4)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("streetwise")[0] == "en" and model.predict("strassenbahn")[0] == "de"
    assert model.predict("123 --")[0] == "und" and model.predict("漢")[1] == pytest.approx(0.5)


def test_a_language_of_a_thousandth_of_the_rows(spark):
    rows = [(i, "the quick street and house", "en") if i % 2 else (i, "die schnelle strasse und haus", "de") for i in range(4995)]
    rows += [(5000 + i, f"talo katu nopea yksi{i}", "fi") for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(frame)
    assert model.languages == ["de", "en", "fi"]
    found = langid.predict(frame, model).join(frame.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang != lang_pred").count() == 0
    assert model.predict("katulla")[0] == "fi"


def test_more_languages_than_share_the_entries(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    monkeypatch.setattr(langid, "VALUES", 16)
    rows = [(i, f"{chr(97 + i % 20) * 4} common", f"x{i % 20:02}") for i in range(60)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [lang for lang, _ in model.predict_all([t for _, t, _ in rows])] == [lang for *_, lang in rows]


def test_language_and_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op1_language_id"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.count() > 100 and found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = QUERIES["op6_quality"](spark, folder).join(labels, "doc_id").filter("held_out")
    assert scored.filter("quality = 1 and predicted = 0").count() <= 1
    assert scored.filter("quality = 0 and predicted = 1").count() <= 2


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i * 3, i % 2) for i in range(40)] + [(3, None), (None, 1), (3, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    scored = quality.classify(docs, model)
    assert scored.count() == docs.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.classify(none, model).count() == 0
    alone = quality.learn(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.classify(docs, alone).collect()} == {1.0}
    assert {r["score"] for r in quality.classify(docs, quality.learn(none, labels)).collect()} == {0.5}


def test_large_ids_beside_a_null(spark):
    big = (1 << 53) + 1
    line = "a line that is long enough to be looked up in the index"
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(None, line, "en"), (big, line, "en"), (big + 2, line, "en"), (big + 4, line, "en"), (big + 6, f"{line}\nmore", "en")]
    rows += [(big + 100, words, "en"), (big + 101, words + " more", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    ids = Counter(r[0] for r in rows)
    of = lambda df: Counter(r["doc_id"] for r in df.collect())
    assert of(langid.predict(docs, langid.learn(docs))) == ids
    same(neardup.near_duplicates(docs), brute.near_duplicates(texts_of(rows)))
    assert of(neardup.keep_one(docs)) == Counter([None, big, big + 100])
    found = lines.dedup_lines(docs)
    same(lines.summary(found), brute.lines(texts_of(rows)))
    benchmark = spark.createDataFrame([(1, words)], "item_id long, text string")
    assert of(decontam.find_benchmark(docs, benchmark)) == ids
    folder = staging_path(spark, "tokens")
    tokens.write_tokens(docs, folder, TOKENIZER)
    assert of(tokens.read_tokens(spark, folder)) == ids


PAGES = "page_id long, url string, html string, file string"


def test_warc_audit(spark):
    rows = [(i, f"http://x/{i}\r\n", "<p>é</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * (i % 5), "f") for i in range(70)]
    rows += [(None, None, None, None), (5, "u", "h", "f"), (5, "u", "h", "f"), (99, "", "y" * 300_000, "f")]
    folder = staging_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(2), folder, records=20)
    files = warc.read_files(spark, folder)
    original = warc.stage(warc.file_trees(files), "trees")
    assert warc.audit(original, warc.replica_trees(files, original)).count() == 0
    copy = warc.damage(files, lambda page: page is None or page % 10 == 5)
    found = warc.fixity(original, warc.replica_trees(copy, original))
    hits = Counter(r["page_id"] for r in found.filter("damaged").collect())
    assert hits == Counter(r[0] for r in rows if r[0] is None or r[0] % 10 == 5)
    text = lambda r: (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if r[0] is None else r[0]}>\r\nWARC-Target-URI: "
        + (r[1] or "").replace("\r", "%0D").replace("\n", "%0A")
        + f"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: {len((r[2] or '').encode())}\r\n\r\n{r[2] or ''}"
    )
    assert Counter(r["digest"] for r in found.collect()) == Counter(hashlib.sha256(text(r).encode()).hexdigest() for r in rows)
    lost = files.orderBy("file").limit(1)
    gone = warc.fixity(original, warc.replica_trees(lost, original)).filter("damaged").count()
    assert gone == len(rows) - original.join(lost, "file", "left_semi").filter("level = 0").count()


def test_damaged_stored_files(spark):
    """Stored bytes of a second replica are changed, cut and appended, and a file is added."""
    rows = [(i, f"http://x/{i}", "<p>text</p>" * (i + 1), "f") for i in range(60)]
    first, second = staging_path(spark, "warc"), staging_path(spark, "warc-copy")
    warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), first, records=20)
    files = warc.read_files(spark, first)
    original = warc.stage(warc.file_trees(files), "trees")
    stored = {r["file"]: r["content"] for r in files.collect()}
    assert sorted(int(x) for c in stored.values() for x in warc.PAGE.findall(gzip.decompress(c))) == list(range(60))
    warc.write_files(files, second)
    assert warc.fixity(original, warc.replica_trees(warc.read_files(spark, second), original)).filter("damaged").count() == 0
    leaf = {r["page_id"]: r for r in original.filter("level = 0").collect()}
    a, b, c = (leaf[i]["file"] for i in (0, 20, 40))
    bad = {name: bytearray(content) for name, content in stored.items()}
    bad[a][leaf[3]["at"] + 4] ^= 255  # in the header of the member
    bad[a][leaf[7]["at"] + leaf[7]["size"] - 1] ^= 1  # between two records
    del bad[b][leaf[37]["at"] + 9 :]
    bad[c] += b"more"
    replica = spark.createDataFrame([(n, bytes(x)) for n, x in [*bad.items(), ("other", bytearray(b"12345"))]], "file string, content binary")
    found = warc.fixity(original, warc.replica_trees(replica, original)).filter("damaged").collect()
    assert Counter(r["page_id"] for r in found if r["digest"]) == Counter([3, 7, 37, 38, 39])
    assert sorted((r["file"], r["offset"], r["length"]) for r in found if not r["digest"]) == sorted([(c, len(stored[c]), 4), ("other", 0, 5)])


def test_large_pages_have_files_of_fewer_records(spark):
    sizes = [0, 1, 99, 100, 101, 150, 200, 201, 399, 400, 401, 900, 5000] * 9
    rows = [(i, "", "x" * n, "f") for i, n in enumerate(sizes)]
    folder = staging_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), folder, records=10, file_bytes=1000)
    files = warc.read_files(spark, folder)
    pages = []
    for r in files.collect():
        own = [int(x) for x in warc.PAGE.findall(b"".join(x for _, _, x in warc.members_of(r["content"])))]
        assert len(own) == 1 or (len(own) <= 10 and sum(sizes[i] for i in own) <= 1000)
        pages += own
    assert sorted(pages) == list(range(len(rows)))
    original = warc.stage(warc.file_trees(files), "trees")
    found = warc.fixity(original, warc.replica_trees(warc.damage(files, lambda page: page % 7 == 3), original))
    assert sorted(r["page_id"] for r in found.filter("damaged").collect()) == list(range(3, len(rows), 7))


def test_warc_of_no_pages(spark):
    folder = staging_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], PAGES), folder)
    original = warc.stage(warc.file_trees(warc.read_files(spark, folder)), "trees")
    assert warc.fixity(original, warc.replica_trees(warc.read_files(spark, folder), original)).count() == 0


def test_components(spark):
    draw = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 480)] + [(500, i) for i in range(501, 540)]
    found = graph.components(spark.createDataFrame(links, "a long, b long"))
    real = [(a, b) for a, b in links if a != b]
    same(found, brute.reach({x for link in real for x in link}, real).items())


def test_hashes_do_not_depend_on_segments(monkeypatch):
    data = np.random.default_rng(8).integers(0, 4, 20_000).astype(np.uint8)
    s, e = kernels.runs(data > 0)
    whole = kernels.run_hashes(data, s, e)
    monkeypatch.setattr(kernels, "SEGMENT", 64)
    assert (kernels.run_hashes(data, s, e) == whole).all()


def test_several_texts_under_one_id(spark):
    """Rows are documents of their own: a row linked to the second text of an id is linked to it, and no text gets lost."""
    words = [f"w{i}" for i in range(130)]
    a, b = " ".join(words[:60]), " ".join(words[60:120])
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b + " z", "x"), (4, " ".join(words[70:130]), "y"), (2, b, "a"), (5, "", "e"), (5, "", "e"), (None, b, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie string")
    found = Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(docs).collect())
    assert found == Counter([(1, 1, 56), (2, 1, 56), (2, 2, 56), (2, 2, 56), (3, 2, 57), (4, 4, 56), (5, 5, 0), (5, 5, 0), (None, None, 56)])
    kept = [Counter(map(tuple, neardup.keep_one(docs.repartition(n)).collect())) for n in (1, 4)]
    assert kept[0] == kept[1]
    texts = Counter((d, t) for d, t, _ in kept[0].elements())
    assert texts == Counter([(1, a), (2, b), (4, rows[4][1]), (5, ""), (5, ""), (None, b)])


@pytest.mark.parametrize("size", [600, 3000])
def test_large_sets_are_compared_whole(spark, monkeypatch, size):
    """Pairs of long texts at the limit and just below it, in one bucket whose centre is linked to none of them."""
    monkeypatch.setattr(neardup, "band_keys", lambda own: np.array([7, int(own[0] >> np.uint64(1))]))
    monkeypatch.setattr(neardup, "VALUES", 2 * size)
    words = [f"w{i}" for i in range(3 * size)]
    rows = [(0, " ".join(f"c{i}" for i in range(size)))]
    for i, shared in enumerate(range(6 * size // 7 - 3, 6 * size // 7 + 4)):
        own = [f"p{i}_{w}" for w in words[:size]]
        rows.append((10 * i + 1, " ".join(own)))
        rows.append((10 * i + 2, " ".join(own[:shared] + [f"x{i}_{j}" for j in range(size - shared)])))
    expected = brute.near_duplicates(rows)
    assert 0 < sum(not keep for *_, keep in expected) < 7
    same(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), expected)


def test_words_are_letters_with_their_marks(spark):
    """Number signs, digits and lone marks are no letters; learning and scoring cut the same words."""
    rows = [(i, "der die das und नमस्ते कि" if i % 2 else "the of and to éa ½", "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert {"नमस्ते", "कि", "éa"} <= set(model.tables[0][0])
    odd = ["½ ²", "①②", "Ⅷ", "12 34", "\u0301\u0301", "_ -", "", None]
    assert model.predict_all(odd) == [("und", 0.0)] * len(odd)
    assert [model.predict(t)[0] for t in ("नमस्ते ½", "x éa 7", "THE")] == ["de", "en", "en"]


def back_off(model, text):
    """The prediction of one text, word by word from the model's tables as dictionaries."""
    tables = []
    for slots, rows in model.tables:
        tables.append({g: dict(zip(rows.columns[rows.ends[i] : rows.ends[i + 1]].tolist(), rows.values[rows.ends[i] : rows.ends[i + 1]].tolist(), strict=True)) for g, i in slots.items()})
    words, totals = langid.WORD.findall((text or "").lower()), [0.0] * len(model.languages)
    if not words:
        return "und", 0.0
    for word in words:
        if word in tables[0]:
            found = [tables[0][word]]
        else:
            marked = f"^{word}$"
            for order, table in zip(langid.ORDERS, tables[1:], strict=True):
                found = [table[g] for i in range(len(marked) - order + 1) if (g := marked[i : i + order]) in table]
                if found:
                    break
        for row in found:
            for column, value in row.items():
                totals[column] += value / len(found)
    best = totals.index(max(totals))
    return model.languages[best], 1 / sum(np.exp((t - totals[best]) / np.sqrt(len(words))) for t in totals)


def test_language_scores_against_a_plain_scorer(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang"))
    texts = [r["text"] for r in docs.orderBy("doc_id").select("text").limit(60).collect()] + ["Xyzzyq quux", "a\u0301", "und zzz", None]
    for cache, long in ((langid.CACHE, langid.LONG), (10, 20)):  # caches reset at each call, long texts taken by distinct words
        monkeypatch.setattr(langid, "CACHE", cache)
        monkeypatch.setattr(langid, "LONG", long)
        for text in texts:
            wanted, found = back_off(model, text), model.predict(text)
            assert found[0] == wanted[0] and found[1] == pytest.approx(wanted[1], rel=1e-6)


def test_one_piece_of_a_benchmark_at_a_time(spark, docs, rows, monkeypatch):
    """Ten pieces: each is destroyed before the next is broadcast, and what they find is put together."""
    words = next(r[1] for r in rows if r[1] and len(r[1]) > 40000).split(" ")
    items = [(i, " ".join(words[30 * i : 30 * i + 16])) for i in range(10)]
    alive, most = [], []
    context = spark.sparkContext
    send = type(context).broadcast

    def broadcast(self, value):
        out = send(self, value)
        if not (isinstance(value, list) and isinstance(value[0], decontam.Search)):
            return out
        alive.append(out)
        most.append(len(alive))
        drop = out.destroy
        out.destroy = lambda *a: (alive.remove(out), drop(*a))
        return out

    monkeypatch.setattr(type(context), "broadcast", broadcast)
    found = decontam.find_benchmark(docs, spark.createDataFrame(items, "item_id long, text string"), piece=4)
    assert len(most) == 10 and max(most) == 1
    same(decontam.summary(found), brute.benchmark_hits(texts_of(rows), items))


def test_an_id_with_many_rows_adds_one_training_row(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(quality, "QualityModel", lambda texts, labels: learned.append((texts, labels)))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"text {i}") for i in ids] + [(ids[0], f"other {j}") for j in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    quality.learn(docs, labels)
    quality.learn(docs.repartition(3), labels)
    assert learned[0] == learned[1] and len(learned[0][0]) == len(ids)
    quality.learn(docs, labels, most=sum(len(t) for t in learned[0][0]) // 4)
    assert 0 < len(learned[2][0]) < len(ids) // 2


def test_scores_against_a_plain_forward_pass(spark, folder):
    """Features and network of single texts, word by word."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    a, b, c, d = model.layers
    for text in [r["text"] for r in docs.orderBy("doc_id").limit(25).collect()] + ["", None, "AB ab 12 !!"]:
        words, x = quality.words_of(text), np.zeros(quality.SIZE + quality.SHAPES)
        for w in words:
            for name in [w.lower()] + ["<caps>"] * quality.is_caps(w):
                if name in model.known:
                    x[: quality.SIZE] += model.vectors[model.known[name]] / len(words)
        if words:
            kinds = [sum(len(w) for w in words if test(w[0])) for test in (str.isalpha, str.isdigit, lambda ch: not ch.isalnum())]
            marks = [sum(quality.is_caps(w) for w in words), sum(not w[0].isalnum() for w in words), sum(w.lower() in model.known for w in words)]
            most = max(Counter(words).values())
            again = sum(p == q for p, q in zip(words, words[1:], strict=False))
            x[quality.SIZE :] = [n / len(text) for n in kinds] + [n / len(words) for n in (*marks, len(set(words)), most, again)] + [kinds[0] / len(words) / 10]
        hidden = np.maximum((x - model.mean) / model.scale @ a + b, 0)
        wanted = 1 / (1 + np.exp(-(hidden @ c + d[0]) / model.temperature))
        assert model.score([text])[0] == pytest.approx(wanted, abs=1e-5)
