"""WARC archives with a two-level capture index.

Writing: a page is one WARC/1.1 record. Equal payloads are found by digest; the record with the
smallest id is the response, the others revisit it. Records are built by expressions and written by
Spark's own text writer, whose line separator is the blank line that ends a record, so archives are
plain concatenated records in any file system Spark knows, and a lost executor's files are written
again by the commit protocol. A file ends with the record that brings it to ``file_bytes``, so files are
bounded by that and one record.

Index: archives are read back a file at a time, digests are verified, and each record gives an entry
keyed by its host-reversed URL. Entries are sorted by range partitioning (the id breaks ties, so one hot host spreads over partitions) and packed into
compressed blocks of ``block_entries``; a sparse directory keeps the first key of every block. A lookup
finds the block in the directory and the entry in the block by binary search, and reads the record's byte
range only; captures come one after another, so a key may have any number of them.

Defined results: null html is stored like empty html, and both are equal payloads; a null url gives a
record without a target URI, under the empty key; spaces and control characters of a url are percent-encoded, in
the header as in lookups, and all others stay as they are; rows that repeat an id with an equal payload are all responses if no smaller id has it;
payloads of any length are stored whole; an empty table gives no archives and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BATCH_KEY, materialise, new_path

SEPARATOR = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Characters that a header line can't hold, or that end a URL.
UNSAFE = [chr(i) for i in (*range(0x21), 0x7F)]
BASE32_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from the hexadecimal digest: ten hex digits are eight of base32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32)


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload a smaller id has."""
    keyed = pages.select(F.col(id_col).alias("page_id"), base32_sha1(F.coalesce(F.col(html_col), F.lit("")).cast("binary")).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").select("digest", "refers_to")
    return keyed.join(first, "digest").where("page_id > refers_to").distinct()


def encoded(char: str) -> str:
    return f"%{ord(char):02X}"


def safe_url(url: Column) -> Column:
    """The url with its spaces and control characters percent-encoded, and nothing else."""
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), reduce(lambda u, c: F.replace(u, F.lit(c), F.lit(encoded(c))), UNSAFE, url)).otherwise(url)


def record_column(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """Bytes of a record without the blank line that ends it, as a string."""
    eol, n = F.lit("\r\n"), F.octet_length(payload)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit("\r\n\r\n"))
    revisit = refers_to.isNotNull()
    body = F.when(revisit, http).otherwise(F.concat(http, payload))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), eol,
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), safe_url(url), eol), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), digest, eol,
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body)


def file_numbers(sizes: Column, file_bytes: int) -> Column:
    """Number of the file that each record of a task goes to: a new one begins after ``file_bytes``. Only the sizes go through Python."""

    @F.pandas_udf(T.LongType())
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number = held = 0
        for batch in batches:
            out = []
            for size in batch.tolist():
                out.append(number)
                held += size
                if held >= file_bytes:
                    number, held = number + 1, 0
            yield pd.Series(out, dtype="int64")

    return numbers.asNondeterministic()(sizes)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs within the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = 64 << 20) -> None:
    """Write all pages as WARC files below ``path``.

    Only ids and digests are shuffled to find equal payloads. The html itself is joined with the table of
    revisits, which Spark broadcasts only while that table's size on disk is within its limit. Rows wait for
    their file's number a hundred at a time, and up to 16 files of a task are written without a sort.
    """
    repeated, _ = materialise(revisits(pages, id_col, html_col), "revisits")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    joined = own.join(repeated, ["page_id", "digest"], "left")
    record = record_column(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("refers_to"))
    lines = joined.select(record.alias("value"))
    numbered = lines.withColumn("file_no", file_numbers(F.octet_length("value"), file_bytes))
    with settings(pages.sparkSession, {BATCH_KEY: "100", "spark.sql.maxConcurrentOutputFileWriters": "16"}):
        numbered.write.partitionBy("file_no").option("lineSep", SEPARATOR).text(path)


def url_key(url: str | None) -> str:
    """Host-reversed key of a URL: ``http://www.a.org/b?c`` is ``org,a)/b?c``."""
    if not url:
        return ""
    url = "".join(encoded(c) if c in UNSAFE else c for c in url)
    m = re.match(r"(?:[a-zA-Z][\w+.-]*://)?([^/?#]*)([^#]*)", url)
    host = m[1].rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (m[2] or "/").lower()


def headers(raw: bytes) -> dict:
    return dict(line.split(": ", 1) for line in raw.decode("utf-8").split("\r\n")[1:])


def read_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end (with its blank line) of the record at an offset."""
    cut = data.find(b"\r\n\r\n", at)
    if cut < 0 or not data.startswith(b"WARC/", at):
        raise ValueError(f"no WARC record at {at}")
    head = headers(data[at:cut])
    start, n = cut + 4, int(head["Content-Length"])
    end = start + n
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end at {end}")
    return head, data[start:end], end + 4


def describe(head: dict, block: bytes) -> dict:
    """What an index entry says of a record; a response's digest is checked against its payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have the digest {digest}")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda key: int(v[0]) if key in head and (v := re.findall(r"-?\d+", head[key])) else None
    return {"url": head.get("WARC-Target-URI"), "page_id": number("WARC-Record-ID"), "type": head["WARC-Type"], "digest": digest, "bytes": size, "refers_to": number("WARC-Refers-To")}


ENTRIES = T.StructType(
    [T.StructField(n, t) for n, t in (("key", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("type", T.StringType()), ("digest", T.StringType()), ("bytes", T.LongType()), ("refers_to", T.LongType()), ("file", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()))]
)


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """An entry for every record of the archives below ``path``, read back from their bytes."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, data in zip(files["path"], files["content"], strict=True):
                data, at, out = bytes(data), 0, []
                while at < len(data):
                    head, block, end = read_record(data, at)
                    e = describe(head, block)
                    out.append((url_key(e["url"]), e["page_id"], e["url"], e["type"], e["digest"], e["bytes"], e["refers_to"], name, at, end - at))
                    at = end
                yield pd.DataFrame(out, columns=ENTRIES.names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(scan, ENTRIES)


BLOCKS = T.StructType([T.StructField(n, t) for n, t in (("first_key", T.StringType()), ("first_id", T.LongType()), ("last_key", T.StringType()), ("entries", T.LongType()), ("block", T.StringType()), ("data", T.BinaryType()))])


def build_index(entries: DataFrame, path: str, block_entries: int = 3000) -> None:
    """Sorted, compressed blocks below ``path``/blocks and the sparse directory below ``path``/directory."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def block(rows: list[tuple]) -> tuple:
            data = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode("utf-8"))
            return rows[0][0], rows[0][1], rows[-1][0], len(rows), hashlib.sha1(data).hexdigest(), data

        for batch in batches:
            held += [tuple(None if x is pd.NA or x != x else int(x) if isinstance(x, float) else x for x in r) for r in batch.astype(object).itertuples(index=False)]
            full = len(held) // block_entries * block_entries
            if full:
                yield pd.DataFrame([block(held[i : i + block_entries]) for i in range(0, full, block_entries)], columns=BLOCKS.names)
                held = held[full:]
        if held:
            yield pd.DataFrame([block(held)], columns=BLOCKS.names)

    by_key = [F.col(c) for c in ("key", "page_id", "file", "offset")]
    ordered = entries.repartitionByRange(*by_key).sortWithinPartitions(*by_key)
    ordered.mapInPandas(pack, BLOCKS).write.parquet(f"{path}/blocks")
    spark = entries.sparkSession
    spark.read.schema(BLOCKS).parquet(f"{path}/blocks").drop("data").write.parquet(f"{path}/directory")


def decode_block(data: bytes) -> list[tuple]:
    return [tuple(json.loads(line)) for line in zlib.decompress(data).decode("utf-8").split("\n")]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of an index, from its blocks."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                yield pd.DataFrame(decode_block(bytes(data)), columns=ENTRIES.names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("data").mapInPandas(unpack, ENTRIES)


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """Bytes [offset, offset + length) of a file, in whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(file)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
    finally:
        stream.close()


class CaptureIndex:
    """Lookups in an index: binary search in the directory, then in a block, then a byte range of an archive.

    A directory of up to ``top_rows`` blocks is held by the driver. Of a larger one the driver holds a sample, chosen by a
    hash, and reads the part between two neighbours of the sample when it is asked for a key there.
    """

    def __init__(self, spark: SparkSession, path: str, top_rows: int = 100_000):
        self.spark, self.blocks = spark, spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        self.directory = spark.read.schema(T.StructType([f for f in BLOCKS if f.name != "data"])).parquet(f"{path}/directory").select("first_key", "first_id", "block")
        step = -(-self.directory.count() // top_rows)
        self.whole = step <= 1
        top = self.directory if self.whole else self.directory.where(F.pmod(F.xxhash64("block"), F.lit(step)) == 0)
        self.top = self._sorted(top)

    @staticmethod
    def _sorted(rows: DataFrame) -> list[tuple]:
        return sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))

    def _near(self, key: str) -> list[tuple]:
        """Directory rows, in order, of the blocks that may hold the key: the last that begins before it, and all that begin with it."""
        rows = self.top
        if not self.whole:
            keys = [r[0] for r in rows]
            low, high = bisect_left(keys, key) - 1, bisect_right(keys, key)
            part = self.directory.where(F.col("first_key") >= keys[low]) if low >= 0 else self.directory
            rows = self._sorted(part.where(F.col("first_key") < keys[high]) if high < len(keys) else part)
        keys = [r[0] for r in rows]
        return rows[max(0, bisect_left(keys, key) - 1) : bisect_right(keys, key)]

    def captures(self, url: str | None) -> Iterator[tuple[dict, bytes]]:
        """Headers and block of every capture of a URL, one after another."""
        key = url_key(url)
        for first_key, first_id, block in self._near(key):
            wanted = (F.col("first_key") == first_key) & F.col("first_id").eqNullSafe(F.lit(first_id)) & (F.col("block") == block)
            entries = decode_block(bytes(self.blocks.where(wanted).select("data").first()["data"]))
            keys = [e[0] for e in entries]
            for e in entries[bisect_left(keys, key) : bisect_right(keys, key)]:
                head, body, _ = read_record(read_range(self.spark, e[7], e[8], e[9]), 0)
                yield head, body


def lookup(spark: SparkSession, path: str, url: str | None) -> list[tuple[dict, bytes]]:
    """Headers and block of every capture of a URL."""
    return list(CaptureIndex(spark, path).captures(url))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, str]:
    """Write and index all pages in the shared folder; returns the paths of the archives and of the index."""
    spark = pages.sparkSession
    archives, index = new_path(spark, "warc"), new_path(spark, "capture-index")
    write_archives(pages, archives, id_col, url_col, html_col)
    entries, _ = materialise(scan_archives(spark, archives), "entries")  # range partitioning reads its input twice
    build_index(entries, index)
    return archives, index
