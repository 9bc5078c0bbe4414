"""Phrase collocation mining by multikey quicksort of suffix pointers.

Texts are cut into pieces at punctuation and line ends, and pieces into words; everything is counted per language. A
suffix is a place and the words from there to the end of its piece, up to ``DEPTH`` of them, so the phrases that
begin at a place are the suffix's first words, and a phrase's count is the number of suffixes that begin with it.

1. Groups of whole documents send their distinct words, with counts, to shards by the word's hash. A shard numbers the
   words found ``LEAST`` times; no phrase with another word can be as frequent. Words are told apart by their bytes.
2. Groups send their suffixes, as word numbers, each distinct one once with its count, cut before the first word
   that has no number, to shards by their leading word. A word of more than half a shard's share is hot; a suffix with a hot
   leading word goes by its first two words, and so on up to the first that is not hot, so no shard gets
   much more than its share however common a word or a passage is.
3. A shard sorts its suffixes by three-way partitions: around a pivot word into smaller, equal and greater ones, the equal ones
   going on at the next word. The size of an equal partition is the count of its phrase. Partitions
   below ``LEAST`` are abandoned. All open partitions of a shard are split side by side, by array operations. Phrases of hot
   words only, which several shards may hold, are given with any count and summed.
4. A phrase's score is that of its weakest cut into two parts; phrases that a longer one accounts for are left out.

Counts of parts and of longer phrases are looked up by joins on word numbers over the frequent phrases only; the lookup of
words spreads hot words by salt. Sums are 64-bit, scores decimals of 38 digits.

Defined cases: a null language is ``und``, together with a language of that name; null and empty texts have no words; repeated rows
count as often as they occur; equal scores and counts are ordered by the phrase's bytes; an empty table gives no rows; other
columns are left aside. A very long text is handled by one task of each round. Within one group, words are told apart by a
64-bit hash of language and word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaplate.llm import kernels as k
from seaplate.llm.tables import stage

DEPTH = 4
LEAST = 30
PERCENT = 80
SCALE = 2_000_000
TOP = 2000
GROUP_BYTES = 4 << 20
GROUPS_PER_TASK = 4
HOT = np.uint32(1 << 31)
SALTS = 32
NEVER = 1 << 62
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
MEMBER = ~BREAK
MEMBER[[9, 32]] = False
SENT = "shard int, bucket int, blob binary"
WORDS = "bucket int, shard int, reply binary, id long, lang string, word binary, f long"
PHRASE = "a long, b long, n long"


def document_groups(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int, int]:
    """(lang, text in UTF-8, bucket), dealt by bucket; the number of tasks, and of bytes."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.encode("text", "UTF-8").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // group_bytes))
    tasks = max(-(-buckets // GROUPS_PER_TASK), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(buckets)).cast("int")
    return rows.select("lang", "text", bucket.alias("bucket")).repartition(tasks, "bucket"), tasks, total


class Group:
    """The words of one bucket: ``slot`` numbers each place's (language, word) among the distinct ones, which are in order of their
    shard; ``piece`` numbers the places' pieces of text."""

    def __init__(self, table: pa.Table, shards: int):
        self.bucket = table.column("bucket")[0].as_py()
        rows = [b"" if x is None else x for x in table.column("text").to_pylist()]
        langs = [x.encode("utf-8", "surrogatepass") for x in table.column("lang").to_pylist()]
        self.buffer = k.LOWER[np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)]
        s, e = k.runs(MEMBER[self.buffer])
        at = np.cumsum([0, *(len(r) + 1 for r in rows)])
        doc = np.searchsorted(at, s, "right") - 1
        self.piece = np.cumsum(BREAK[self.buffer], dtype=np.int64)[s]
        words = k.run_hashes(self.buffer, s, e)
        names = np.array([xxhash.xxh3_64_intdigest(x) for x in langs], np.uint64)
        _, first, self.slot, self.counts = np.unique(k.mix(words ^ names[doc]), return_index=True, return_inverse=True, return_counts=True)
        shard = (words[first] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.slot, self.counts, self.shard, first = back[self.slot], self.counts[order], shard[order], first[order]
        self.low, self.high = s[first], e[first]
        self.langs = [langs[d] for d in doc[first].tolist()]

    def keys(self, part: slice) -> list[bytes]:
        """Language and word of distinct words; a word holds no line feed."""
        rows = zip(self.langs[part], self.low[part].tolist(), self.high[part].tolist(), strict=True)
        return [lang + b"\n" + self.buffer[a:b].tobytes() for lang, a, b in rows]


def _cuts(shard: np.ndarray) -> list[tuple[int, slice]]:
    """The stretches of an ascending array."""
    if not len(shard):
        return []
    first = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
    return [(int(shard[a]), slice(a, b)) for a, b in zip(first, [*first[1:], len(shard)], strict=True)]


def _columns(blob: bytes, kinds: str) -> tuple[list[np.ndarray], bytes]:
    """The arrays of 32-bit values at the start of a packed blob, and the rest."""
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(blob[:8], "little")
    return [np.frombuffer(blob, kind, n, 8 + 4 * n * i) for i, kind in enumerate(kinds.split(" "))], blob[8 + 4 * n * len(kinds.split(" ")) :]


def _pack(arrays: list[np.ndarray], rest: bytes = b"") -> bytes:
    head = len(arrays[0]).to_bytes(8, "little") + b"".join(a.astype("<u4").tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + rest)


def _sent(rows: list[tuple]) -> pa.Table:
    shard, bucket, blob = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.table({"shard": pa.array(shard, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blob, pa.binary())})


def send_words(table: pa.Table, shards: int) -> pa.Table:
    group = Group(table, shards)
    out = []
    for s, part in _cuts(group.shard):
        keys = group.keys(part)
        out.append((s, group.bucket, _pack([group.counts[part], np.array([len(x) for x in keys])], b"".join(keys))))
    return _sent(out)


def answer_words(table: pa.Table, shards: int, hot: int, least: int) -> pa.Table:
    """To each group the numbers of its words, 0 for a rare one; the numbered words; and the number of all words by language.

    Numbers follow the order of the words' bytes, so a repeated task gives the same ones.
    """
    slots: dict[bytes, int] = {}
    rows, times = [], []
    for blob in table.column("blob").to_pylist():
        (counts, sizes), rest = _columns(blob, "<u4 <u4")
        ends = np.cumsum(sizes.astype(np.int64)).tolist()
        rows.append(np.array([slots.setdefault(rest[e - n : e], len(slots)) for e, n in zip(ends, sizes.tolist(), strict=True)], np.int64))
        times.append(counts.astype(np.int64))
    f = np.zeros(len(slots), np.int64)
    np.add.at(f, np.concatenate(rows), np.concatenate(times))
    shard = table.column("shard")[0].as_py()
    number = np.zeros(len(slots), np.int64)
    frequent, totals = [], {}
    for key, slot in sorted(slots.items()):
        lang, _, word = key.rpartition(b"\n")
        totals[lang] = totals.get(lang, 0) + int(f[slot])
        if f[slot] >= least:
            number[slot] = len(frequent) * shards + shard + 1
            frequent.append((int(number[slot]), lang, word, int(f[slot])))
    if len(frequent) * shards + shard + 1 >= int(HOT):
        raise ValueError("more than 2**31 frequent words")
    number[f >= hot] |= int(HOT)
    out = [(b, shard, number[r].astype("<u4").tobytes(), None, None, None, None) for b, r in zip(table.column("bucket").to_pylist(), rows, strict=True)]
    out += [(None, shard, None, i | (int(HOT) if n >= hot else 0), lang.decode("utf-8", "replace"), word, n) for i, lang, word, n in frequent]
    out += [(None, shard, None, None, lang.decode("utf-8", "replace"), None, n) for lang, n in totals.items()]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.int64())
    names = [c.split(" ")[0] for c in WORDS.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def route(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each suffix: by its leading words up to the first that is not hot."""
    key = words[:, 0].astype(np.uint64)
    hot = words[:, 0] >= HOT
    for d in range(1, words.shape[1]):
        key = np.where(hot, k.mix(key) + words[:, d], key)
        hot = hot & (words[:, d] >= HOT)
    return (k.mix(key) % np.uint64(shards)).astype(np.int64)


def send_suffixes(table: pa.Table, replies: pa.Table, shards: int) -> pa.Table:
    group = Group(table, shards)
    found = dict(zip(replies.column("shard").to_pylist(), replies.column("reply").to_pylist(), strict=True))
    number = np.zeros(len(group.counts), np.uint32)
    for s, part in _cuts(group.shard):
        number[part] = np.frombuffer(found[s], "<u4")
    own = number[group.slot]
    words = np.zeros((len(own), DEPTH), np.uint32)
    words[:, 0] = own
    for d in range(1, DEPTH):
        words[:-d, d] = np.where((words[:-d, d - 1] > 0) & (group.piece[d:] == group.piece[:-d]), own[d:], 0)
    words = words[words[:, 1] > 0]
    words = words[np.lexsort(words.T[::-1])]
    first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(1))) if len(words) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(words)))
    words = words[first]
    shard = route(words, shards)
    order = np.argsort(shard, kind="stable")
    words, counts = words[order], counts[order]
    return _sent([(s, group.bucket, _pack([*words[part].T, counts[part]])) for s, part in _cuts(shard[order])])


def equal_partitions(words: np.ndarray, weight: np.ndarray, least: tuple[int, ...]) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Multikey quicksort of weighted suffixes: (a row of each partition, number of its words, its weight) of the equal
    partitions of d words that weigh ``least[d - 1]`` or more.

    A partition is a stretch of ``order`` whose suffixes share ``depth`` words. Each round splits every open partition
    around a word of its own; partitions below what their deeper levels ask for are abandoned.
    """
    need = [min(least[d:]) for d in range(DEPTH)] + [NEVER]
    draw = np.random.default_rng(12)
    order = np.arange(len(words))
    begin, size, depth = np.zeros(1, np.int64), np.array([len(words)]), np.zeros(1, np.int64)
    out = []
    while len(begin):
        base = np.cumsum(size) - size
        part = np.repeat(np.arange(len(begin)), size)
        at = (begin - base)[part] + np.arange(len(part))
        row = order[at]
        pivot = words[order[begin + (draw.random(len(begin)) * size).astype(np.int64)], depth]
        key, own = words[row, depth[part]], pivot[part]
        side = (key >= own).astype(np.int64) + (key > own)
        code = part * 3 + side
        count = np.bincount(code, minlength=3 * len(begin))
        weighs = np.bincount(code, weight[row], 3 * len(begin)).astype(np.int64).reshape(-1, 3)
        start = np.cumsum(count) - count
        moved = np.empty_like(row)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            held, of = count[s::3], part[mine]
            moved[(start[s::3] - np.cumsum(held) + held)[of] + np.arange(len(mine))] = row[mine]
        order[at] = moved
        count, start = count.reshape(-1, 3), start.reshape(-1, 3) - base[:, None] + begin[:, None]
        for d in np.unique(depth).tolist():
            hit = np.flatnonzero((depth == d) & (pivot > 0) & (weighs[:, 1] >= least[d]))
            if len(hit):
                out.append((order[start[hit, 1]], d + 1, weighs[hit, 1]))
        deeper = depth[:, None] + np.array([0, 1, 0])
        stays = (count > 0) & (weighs >= np.array(need)[deeper])
        stays[:, 1] &= pivot > 0
        begin, size, depth = start[stays], count[stays], deeper[stays]
    return out


def answer_suffixes(table: pa.Table, least: int) -> pa.Table:
    """Counts of the phrases of 2 words or more that begin a shard's suffixes; phrases of hot words only may go on in other shards."""
    parts = [_columns(blob, "<u4 <u4 <u4 <u4 <u4")[0] for blob in table.column("blob").to_pylist()]
    words = np.stack([np.concatenate([p[d] for p in parts]) for d in range(DEPTH)], axis=1)
    weight = np.concatenate([p[DEPTH] for p in parts]).astype(np.int64)
    leading = (np.cumprod(words >= HOT, axis=1)).sum(1)
    found = []
    for hot in np.unique(np.clip(leading, 1, DEPTH - 1)).tolist():
        own = np.flatnonzero(np.clip(leading, 1, DEPTH - 1) == hot)
        limits = tuple(NEVER if d == 1 else 1 if d <= hot else least for d in range(1, DEPTH + 1))
        found += [(own[row], d, n) for row, d, n in equal_partitions(words[own], weight[own], limits)]
    a, b, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for row, d, count in found:
        w = np.where(np.arange(DEPTH) < d, words[row], 0).astype(np.uint64)
        a.append((w[:, 0] << np.uint64(32) | w[:, 1]).view(np.int64))
        b.append((w[:, 2] << np.uint64(32) | w[:, 3]).view(np.int64))
        n.append(count)
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(n)})


def count_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Staged (a, b, n): phrases of 2 to ``DEPTH`` words, packed as word numbers, with their counts; and staged words: (id, lang, word, f),
    with a row per language that has a null id and the number of all its words."""
    grouped, tasks, size = document_groups(docs)
    texts = grouped.groupBy("bucket")
    hot = max(least, size // (16 * tasks))  # a word takes some 6 to 8 bytes, so about half a shard's share
    by_shard = lambda sent: sent.repartition(tasks, "shard").groupBy("shard")
    sent = by_shard(texts.applyInArrow(lambda t: send_words(t, tasks), SENT))
    answers = stage(sent.applyInArrow(lambda t: answer_words(t, tasks, hot, least), WORDS), "words")
    replies = answers.filter("bucket is not null").select("bucket", "shard", "reply").repartition(tasks, "bucket").groupBy("bucket")
    suffixes = texts.cogroup(replies).applyInArrow(lambda t, r: send_suffixes(t, r, tasks), SENT)
    counted = by_shard(suffixes).applyInArrow(lambda t: answer_suffixes(t, least), PHRASE)
    phrases = counted.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return stage(phrases, "phrases"), answers.filter("bucket is null").select("id", "lang", F.decode("word", "UTF-8").alias("word"), "f")


def _word(i: int) -> Column:
    value = F.col("a" if i < 2 else "b")
    return F.shiftrightunsigned(value, 32) if i % 2 == 0 else value.bitwiseAND(F.lit(0xFFFFFFFF))


def _packed(words: list[Column], at: int, size: int) -> list[Column]:
    """The two packed values of a part of a phrase."""
    own = [words[at + i] if i < size else F.lit(0).cast("long") for i in range(DEPTH)]
    return [F.shiftleft(own[i], 32).bitwiseOR(own[i + 1]) for i in (0, 2)]


def _parts(phrases: DataFrame) -> DataFrame:
    """The shorter phrases of 2 words or more inside each phrase: (a, b, n, at, size, pa, pb)."""
    words = [F.col(f"w{i}") for i in range(DEPTH)]
    rows = phrases.select("*", *[_word(i).alias(f"w{i}") for i in range(DEPTH)])
    places = [(at, size) for size in range(2, DEPTH) for at in range(DEPTH - size + 1)]
    one = lambda at, size: F.struct(F.lit(at).alias("at"), F.lit(size).alias("size"), *(c.alias(n) for c, n in zip(_packed(words, at, size), ("pa", "pb"), strict=True)))
    length = sum(((w > 0).cast("int") for w in words[2:]), F.lit(2))
    listed = F.array(*[F.when((length > size) & (length >= at + size), one(at, size)) for at, size in places])
    rows = rows.select("a", "b", "n", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("p"))
    return rows.select("a", "b", "n", "p.*")


def _spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b, lang, phrase, length) with the counts of the first and of the last word."""
    hot = lambda c: c.bitwiseAND(F.lit(int(HOT))) > 0
    places = F.array(*[F.struct(F.lit(i).alias("at"), _word(i).alias("id")) for i in range(DEPTH)])
    asked = phrases.select("a", "b", F.explode(F.filter(places, lambda x: x["id"] > 0)).alias("w")).select("a", "b", "w.*")
    asked = asked.withColumn("salt", F.when(hot(F.col("id")), F.pmod(F.xxhash64("a", "b"), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(hot(F.col("id")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    met = asked.join(words.withColumn("salt", F.explode(salts)), ["id", "salt"])
    rows = met.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("at", "word", "f"))).alias("ws"), F.min("lang").alias("lang"))
    return rows.select(
        "a", "b", "lang", F.array_join("ws.word", " ").alias("phrase"), F.size("ws").alias("length"),
        F.col("ws")[0]["f"].alias("first"), F.element_at("ws", -1)["f"].alias("last"),
    )


def scored_phrases(docs: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """All collocations: lang, phrase, its count ``a``, the counts ``l`` and ``r`` of the parts of its weakest cut, the number ``n``
    of words of the language, and ``score``."""
    phrases, words = count_phrases(docs, least)
    parts = _parts(phrases)
    longer = parts.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.max("n").alias("longer"))
    counts = phrases.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("n").alias("f"))
    of = lambda at, size: F.max(F.when((F.col("at") == at) & (F.col("size") == size), F.col("f"))).alias(f"f{at}{size}")
    inner = parts.join(counts, ["pa", "pb"]).groupBy("a", "b").agg(of(0, 2), of(0, 3), of(1, 2), of(1, 3), of(2, 2))
    rows = phrases.join(_spelled(phrases, words.filter("id is not null")), ["a", "b"]).join(longer, ["a", "b"], "left").join(inner, ["a", "b"], "left")
    rows = rows.filter(f"longer is null or cast(100 as decimal(38, 0)) * longer < cast({percent} as decimal(38, 0)) * n")

    def cut(k: int, left: str, right: str) -> Column:
        score = F.expr(f"cast({SCALE} as decimal(38, 0)) * n div ({left} + {right})")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    by_length = {2: [cut(1, "first", "last")], 3: [cut(1, "first", "f12"), cut(2, "f02", "last")], 4: [cut(1, "first", "f13"), cut(2, "f02", "f22"), cut(3, "f03", "last")]}
    cuts = F.when(F.col("length") == 2, F.array(*by_length[2])).when(F.col("length") == 3, F.array(*by_length[3])).otherwise(F.array(*by_length[4]))
    rows = rows.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    totals = words.filter("id is null").groupBy("lang").agg(F.sum("f").alias("n"))  # a row per language
    return rows.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` collocations of each language with their ``rank``; each of many salts of a language is cut down first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
