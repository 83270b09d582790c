import gzip
import hashlib

import pyarrow.fs as fs
import pytest

from pagelode.llm import warc

BIG = "<p>é</p>" * 200
ROWS = [(1, "http://a/", BIG), (2, "http://b/", BIG), (7, None, BIG), (3, "http://c/", "short"), (4, "http://d/", "short"),
        (5, None, None), (None, "http://e/", BIG), (8, "http://f/", ""), (9, "http://g/", "x\r\n\r\ny" * 40000),
        (10, "http://h/ i", "z" * 1000), (11, "http://j/", "z" * 1000), (11, "http://j/", "z" * 1000),
        (None, "http://n/", "n" * 2000), (None, "http://n/", "n" * 2000)]


def expected(rows):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        target = max(same) if len(raw) >= 1000 and same and page_id != max(same) else None
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if target is None else "revisit", target))
    return out


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("file_bytes", [1, 64 << 20])
def test_round_trip(spark, file_bytes):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, offset int")
    index = warc.archive(pages, file_bytes=file_bytes)
    back = warc.read_ranges(index, most=5000).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]
    assert sorted(got, key=key) == sorted(expected(ROWS), key=key)
    whole = {(r.page_id, r.url): r.payload for r in back if r.record_type == "response"}
    assert whole[9, "http://g/"] == ROWS[8][2] and whole[5, None] == ""
    # Some records only: their ranges alone are read.
    some = warc.read_ranges(index.filter("page_id in (3, 9)")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in some) == [(3, 5), (9, 240000)]


def test_files_are_gzip_members(spark):
    index = warc.archive(spark.createDataFrame(ROWS[:4], "page_id long, url string, html string")).collect()
    for r in index:
        store, path = fs.FileSystem.from_uri("file://" + r.file.removeprefix("file:").replace("//", "/", 1))
        raw = store.open_input_file(path).read_at(r.length, r.offset)
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())


def test_empty_table(spark):
    assert warc.read_ranges(warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
