"""WARC files and a Merkle fixity audit of their replicas.

``write_warc`` puts pages into WARC files, one ``resource`` record each and each its own gzip member, through Spark's
text writer, so files are committed as any Spark output is: a line holds a member's bytes, and the line
separator is an empty gzip member. Unpacked, a file is a plain sequence of records.

The audit hashes the stored bytes of every record, from its member's first byte to the next member's, into a leaf;
``FAN`` neighbouring nodes of a file make the next node, whose hash covers the range and hashes of its children, up to
the top; a file's root hashes the top and the bytes after the last record; the files' roots, in order of names, make a
tree of their own up to one root per replica. If the
roots of two replicas differ, the audit descends: only children of nodes that differ are compared, level by
level, down to the records. A replica is read at the stored ranges of the original's records and never unpacked, so
any changed byte and a cut or missing file show as records that differ; bytes after the last record and files
that only the replica has show as rows without a record. Only the original has to be readable.

Defined cases: a null page_id or url is an empty value in the header, null html an empty payload; repeated pages
are records of their own; line ends in a url are percent-encoded; an empty table gives no record and equal
roots; other columns than page_id, url and html are left out. A file holds at most ``RECORDS`` records and pages of
about ``FILE_BYTES``, so that one task can hold one file and Spark read it back as one value: larger pages go to files
of their own, by powers of two of their size, with as many fewer to a file. A page of more than ``FILE_BYTES`` has a file
for itself.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from seaplate.llm.tables import stage

FAN = 16
RECORDS = 1000
FILE_BYTES = 1 << 29
CRLF = "\r\n"
CLOSE = CRLF + CRLF
DATE = "1970-01-01T00:00:00Z"
PAGE = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d*)>\r\n")
NODE = "file string, level int, node long, offset long, length long, page_id long, digest string, at long, size long, mark binary"
EMPTY = gzip.compress(b"", mtime=0)
TAIL = -1
CHUNK = 1 << 14


def record_text() -> Column:
    """The record of a page without the line ends that close it."""
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    html = F.coalesce("html", F.lit(""))
    head = (
        "WARC/1.1", "WARC-Type: resource", F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url), f"WARC-Date: {DATE}", "Content-Type: text/html",
        F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")), "",
    )
    lines = [F.lit(x) if isinstance(x, str) else x for x in head]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF), html)


@F.pandas_udf(BinaryType())
def _member(records: pd.Series) -> pd.Series:
    return pd.Series([gzip.compress(r.encode() + CLOSE.encode(), 6, mtime=0) for r in records], dtype=object)


def _write(members: DataFrame, path: str, records: int, by: list[str]) -> None:
    options = {"lineSep": EMPTY.decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": records}
    members.write.options(**options).partitionBy(*by).text(path)


def size_step(room: int) -> Column:
    """0 for pages of up to ``room`` bytes, 1 up to twice as many, 2 up to four times, and so on."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0))
    times = F.floor(F.greatest(F.lit(0), size - 1) / room)
    return F.when(times > 0, F.length(F.bin(times))).otherwise(0)


def write_warc(pages: DataFrame, path: str, records: int = RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """WARC files of gzip members below ``path``, those of larger pages in folders of their own."""
    step = size_step(max(1, file_bytes // records))
    found = {r["step"] for r in pages.select(step.alias("step")).distinct().collect()}  # 32 at most
    for own in sorted(found | {0}):
        members = pages.filter(step == own).select(_member(record_text()).cast("string").alias("value"))
        _write(members, f"{path}/size={own}", max(1, records >> own), [])


def write_files(files: DataFrame, path: str) -> None:
    """Another replica of ``files`` as they are, each in a folder of its name; they end as ``write_warc``'s do."""
    whole = F.expr(f"substring(content, 1, length(content) - {len(EMPTY)})").cast("string")
    _write(files.select("file", whole.alias("value")), path, 0, ["file"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): names and stored bytes of the files below ``path``."""
    files = spark.read.format("binaryFile").load(path)
    folder = F.regexp_extract("path", "/file=([^/]+)/[^/]+$", 1)
    return files.select(F.when(folder != "", folder).otherwise(F.element_at(F.split("path", "/"), -1)).alias("file"), "content")


def members_of(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Place, stored size and unpacked bytes of each gzip member."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, out, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = view[end : end + CHUNK]
            if not len(piece):
                raise EOFError("a member has no end")
            out.append(unpack.decompress(piece))
            end += len(piece)
        end -= len(unpack.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def records_of(content: bytes) -> Iterator[tuple[bytes, int, int | None, int, int]]:
    """Each record without the line ends that close it, its offset in the unpacked file and its page id; place and size
    of its stored bytes, with the separator that follows."""
    last, offset = None, 0
    for at, size, data in members_of(content):
        if not data and last:
            last = (*last[:4], last[4] + size)
        if data:
            if last:
                yield last
            page = PAGE.search(data)
            last = (data[: -len(CLOSE)], offset, int(page[1]) if page[1] else None, at, size)
            offset += len(data)
    if last:
        yield last


def _hash(parts) -> bytes:
    return hashlib.sha256("\n".join(map(str, parts)).encode()).digest()


def _climb(file: str, leaves: list[tuple]) -> Iterator[tuple]:
    """All nodes of one file's tree, the leaves at level 0."""
    level, row = 0, leaves
    while True:
        yield from ((file, level, i, *node) for i, node in enumerate(row))
        if len(row) <= 1:
            return
        groups = [row[i : i + FAN] for i in range(0, len(row), FAN)]
        row = [
            (g[0][0], g[-1][0] + g[-1][1] - g[0][0], None, None, g[0][4], g[-1][4] + g[-1][5] - g[0][4], _hash(x for n in g for x in (n[4], n[5], n[6].hex())))
            for g in groups
        ]
        level += 1


def _nodes(file: str, leaves: list[tuple], content: bytes) -> pd.DataFrame:
    """All nodes of one file, and at level ``TAIL`` the bytes after the last leaf."""
    end = leaves[-1][4] + leaves[-1][5] if leaves else 0
    tail = content[end:]
    rows = [*_climb(file, leaves), (file, TAIL, 0, None, None, None, None, end, len(tail), hashlib.sha256(tail).digest())]
    names = [c.split(" ")[0] for c in NODE.split(", ")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.assign(**{c: pd.array(frame[c].tolist(), dtype="Int64") for c in ("offset", "length", "page_id")})


def file_trees(files: DataFrame) -> DataFrame:
    """The nodes of each file's tree, by its own records; ``digest`` is of the record, ``mark`` of the stored bytes."""

    def task(batches):
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                leaves = [
                    (offset, len(r), page, hashlib.sha256(r).hexdigest(), at, size, hashlib.sha256(content[at : at + size]).digest())
                    for r, offset, page, at, size in records_of(content)
                ]
                yield _nodes(file, leaves, content)

    return files.mapInPandas(task, NODE)


def replica_trees(files: DataFrame, original: DataFrame) -> DataFrame:
    """The nodes of a replica's trees, at the stored ranges of the original's records; a file that the original lacks is
    all tail."""
    fields = ("node", "offset", "length", "page_id", "at", "size")
    held = F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct(*fields))))
    ranges = original.filter("level <= 0").groupBy("file").agg(held.alias("ranges"))

    def task(batches):
        for pdf in batches:
            for file, content, own in zip(pdf["file"], pdf["content"], pdf["ranges"], strict=True):
                content, own = content or b"", [] if own is None else own
                leaves = [
                    (r["offset"], r["length"], r["page_id"], None, r["at"], r["size"], hashlib.sha256(content[r["at"] : r["at"] + r["size"]]).digest())
                    for r in own
                ]
                yield _nodes(file, leaves, content)

    return ranges.join(files, "file", "full").select("file", "content", "ranges").mapInPandas(task, NODE)


def damage(files: DataFrame, hit: Callable[[int | None], bool]) -> DataFrame:
    """A copy of the files in which a stored byte of the records that ``hit`` picks by page id is changed."""

    def task(batches):
        for pdf in batches:
            changed = []
            for content in pdf["content"]:
                copy = bytearray(content)
                for _, _, page, at, size in records_of(content):
                    if hit(page):
                        copy[at + (size - len(EMPTY)) // 2] ^= 1
                changed.append(bytes(copy))
            yield pdf.assign(content=changed)

    return files.mapInPandas(task, "file string, content binary")


def _roots(nodes: DataFrame) -> DataFrame:
    """(file, digest) of each file's root: its top and its tail."""
    tail = F.max(F.when(F.col("level") == TAIL, F.col("mark")))
    return nodes.groupBy("file").agg(F.sha2(F.concat(F.max_by("mark", "level"), tail), 256).alias("digest"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``node``, the place in order of names: the place within a range of names, after the ranges before it."""
    parts = stage(rows.repartitionByRange("file").withColumn("part", F.spark_partition_id()), "ranges")
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    before = parts.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("file")) - 1
    return parts.withColumn("place", place).join(before, "part").withColumn("node", F.col("before") + F.col("place")).drop("part", "place", "before")


def _file_levels(original: DataFrame, replica: DataFrame) -> list[DataFrame]:
    """The trees over both replicas' file roots, level by level: (node, parent, file, mine, theirs)."""
    both = _roots(original).withColumnRenamed("digest", "mine").join(_roots(replica).withColumnRenamed("digest", "theirs"), "file", "full")
    row = stage(_numbered(both), "roots")
    levels = [row]
    while row.count() > 1:
        up = row.withColumn("up", F.expr(f"node div {FAN}")).groupBy("up")
        digest = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", F.coalesce(c, F.lit("")).alias(c)))), lambda x: x[c]), "\n"), 256)
        row = stage(up.agg(digest("mine").alias("mine"), digest("theirs").alias("theirs")).withColumnRenamed("up", "node"), "roots")
        levels.append(row)
    return levels


def _differ(a: str = "mine", b: str = "theirs"):
    return ~F.col(a).eqNullSafe(F.col(b))


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """The records that differ between two replicas' trees: file, node, offset, length and page_id. Bytes that only the
    replica has, after a file's last record or in a file of its own, have a null node; their offset is in the stored file."""
    return _audit(stage(original, "original"), stage(replica, "replica"))


def _audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    bad = None
    for row in reversed(_file_levels(original, replica)):
        below = row.filter(_differ())
        bad = below if bad is None else below.join(bad, F.expr(f"node div {FAN}") == bad["parent"], "left_semi")
        bad = bad.withColumnRenamed("node", "parent")
    files = stage(bad.select("file"), "files")
    tails = replica.filter(F.col("level") == TAIL).join(files, "file", "left_semi")
    own = original.filter(F.col("level") == TAIL).select("file", F.col("mark").alias("mine"))
    tails = tails.join(own, "file", "left").filter(_differ("mine", "mark"))
    none = F.lit(None).cast("long")
    surplus = tails.select("file", none.alias("node"), F.col("at").alias("offset"), F.col("size").alias("length"), none.alias("page_id"))
    original, replica = original.filter("level >= 0"), replica.filter("level >= 0")
    height = original.agg(F.max("level")).first()[0] or 0
    theirs = replica.select("file", "level", "node", F.col("mark").alias("theirs"))
    pairs = original.withColumnRenamed("mark", "mine").join(files, "file", "left_semi").join(theirs, ["file", "level", "node"], "left").filter(_differ())
    bad = None
    tops = original.groupBy("file").agg(F.max("level").alias("top"))
    for level in range(height, -1, -1):
        row = pairs.filter(F.col("level") == level)
        start = row.join(tops, "file").filter(F.col("top") == level).drop("top")
        if bad is not None:
            parents = bad.select("file", F.col("node").alias("parent"))
            start = start.unionByName(row.withColumn("parent", F.expr(f"node div {FAN}")).join(parents, ["file", "parent"], "left_semi").drop("parent"))
        bad = start
    return bad.select("file", "node", "offset", "length", "page_id").unionByName(surplus)


def fixity(original: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of the original with its length, digest, and whether the replica's differs; bytes that only the
    replica has follow as damaged rows without a digest."""
    original = stage(original, "trees")
    found = stage(_audit(original, stage(replica, "replica")), "found")
    leaves = original.filter("level = 0")
    hits = found.select("file", "node", F.lit(True).alias("damaged"))
    rows = leaves.join(hits, ["file", "node"], "left").withColumn("damaged", F.coalesce("damaged", F.lit(False)))
    extra = found.filter("node is null").withColumns({"digest": F.lit(None).cast("string"), "damaged": F.lit(True)})
    names = ("page_id", "file", "offset", "length", "digest", "damaged")
    return rows.select(*names).unionByName(extra.select(*names))
