import base64
import hashlib

import pytest

from tidemark.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (5, "http://www.Example.com/a?b=c#d", "<p>same</p>"),
    (3, "https://example.com/z", "<p>same</p>"),
    (9, "https://m.example.com:8080/q", "<p>same</p>\r\n\r\nWARC/1.1\r\n\r\n"),
    (4, None, None),
    (8, "http://x.org/ü b\r\nEvil: 1", ""),
    (7, "no scheme", "é" * 70000),
    (7, "no scheme", "é" * 70000),
    (11, "http://x.org/other", "€"),
    (12, "http://a.org/x y", "ends with a line\r\n"),
    (13, "http://a.org/x\ty\x7f%20z", "\r\n\r\n\r\n"),
    (14, "http://a.org/", "\r\n\r"),
]


@pytest.fixture(scope="module")
def stored(spark):
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "'c' AS digest", "1 AS refers_to", "2 AS payload", "3 AS value")
    return warc.archive(pages)


def test_rows_come_back_from_the_archives(spark, stored):
    got = {(r["page_id"], r["type"], r["digest"], r["bytes"], r["refers_to"]) for r in warc.read_index(spark, stored[1]).collect()}
    want = set()
    for i, _, h in ROWS:
        body = (h or "").encode()
        first = min(j for j, _, x in ROWS if (x or "") == (h or ""))
        want.add((i, "response" if first == i else "revisit", base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body), None if first == i else first))
    assert got == want
    assert warc.read_index(spark, stored[1]).count() == len(ROWS)


def test_index_is_sorted_and_lookups_read_ranges(spark, stored):
    blocks = spark.read.parquet(f"{stored[1]}/blocks").collect()
    for b in blocks:
        keys = [(e[0], e[1]) for e in warc.decode_block(bytes(b["data"]))]
        assert keys == sorted(keys) and keys[0][0] == b["first_key"] and len(keys) == b["entries"]
    (head, block), = warc.lookup(spark, stored[1], "https://EXAMPLE.com/a?b=c")
    assert head["WARC-Type"] == "revisit" and head["WARC-Refers-To"] == "<urn:page:3>"
    (head, block), = warc.lookup(spark, stored[1], "https://example.com/z")
    assert block.endswith(b"\r\n\r\n<p>same</p>")
    assert warc.lookup(spark, stored[1], "http://example.com/none") == []


def test_keys():
    assert warc.url_key("http://www.A.b.org/X?y#z") == "org,b,a)/x?y" and warc.url_key(None) == "" and warc.url_key("https://u@h.net:80") == "net,h)/"


def test_damaged_archives_are_refused(spark, stored):
    files = spark.read.format("binaryFile").load(stored[0]).where("length > 0").select("content").collect()
    data = next(bytes(f["content"]) for f in files if b"WARC-Type: response" in f["content"] and b"same" in f["content"])
    at = data.index(b"WARC/1.1")
    head, block, _ = warc.read_record(data, at)
    with pytest.raises(ValueError):
        warc.read_record(data, at + 1)
    with pytest.raises(ValueError):
        warc.describe({**head, "WARC-Type": "response", "WARC-Payload-Digest": "sha1:" + "A" * 32}, block)


def test_empty_table(spark):
    _, index = warc.archive(spark.createDataFrame([], PAGES))
    assert warc.read_index(spark, index).count() == 0 and warc.lookup(spark, index, "http://a.b/") == []


def test_odd_urls_are_found_and_only_odd_characters_are_encoded(spark, stored):
    for i, url, _ in ROWS:
        if url:
            found = warc.lookup(spark, stored[1], url)
            assert f"<urn:page:{i}>" in {head["WARC-Record-ID"] for head, _ in found}, url
    assert {head.get("WARC-Target-URI") for head, _ in warc.lookup(spark, stored[1], "http://a.org/x y")} == {"http://a.org/x%20y"}
    assert warc.url_key("http://a.org/x y") == "org,a)/x%20y"
    (head, block), = warc.lookup(spark, stored[1], "http://a.org/x\ty\x7f%20z")
    assert head["WARC-Target-URI"] == "http://a.org/x%09y%7F%20z" and block.endswith(b"\r\n\r\n\r\n\r\n\r\n")


def test_many_captures_of_one_key_and_a_thinned_directory(spark, tmp_path):
    rows = [(i, "http://hot.org/", f"v{i}") for i in range(60)] + [(100 + i, f"http://h{i}.org/{i}", f"p{i}") for i in range(40)]
    path = f"file://{tmp_path}"
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(2), f"{path}/a", file_bytes=4000)
    warc.build_index(warc.scan_archives(spark, f"{path}/a"), f"{path}/i", block_entries=5)
    for top_rows in (1000, 4):
        index = warc.CaptureIndex(spark, f"{path}/i", top_rows)
        assert index.whole == (top_rows == 1000)
        assert [int(h["WARC-Record-ID"][10:-1]) for h, _ in index.captures("http://hot.org/")] == list(range(60))
        for i in (0, 17, 39):
            (_, block), = index.captures(f"http://h{i}.org/{i}")
            assert block.endswith(f"p{i}".encode())
        assert list(index.captures("http://zzz.org/")) == [] == list(index.captures("http://0.com/"))


def test_files_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.range(300, numPartitions=1).selectExpr("id AS page_id", "concat('http://a.org/', id) AS url", "repeat(concat('text ', id, ' '), IF(id % 50 = 0, 100000, 100)) AS html")
    path = f"file://{tmp_path}"
    warc.write_archives(pages, f"{path}/a", file_bytes=1 << 20)
    entries = warc.scan_archives(spark, f"{path}/a").collect()
    assert sorted(r["page_id"] for r in entries) == list(range(300))
    sizes, longest = {}, max(r["length"] for r in entries)
    for r in entries:
        sizes[r["file"]] = sizes.get(r["file"], 0) + r["length"]
    assert len(sizes) > 3 and max(sizes.values()) <= (1 << 20) + longest
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
