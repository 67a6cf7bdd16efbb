"""WARC archives: what is written is read back, and the files are nothing but gzip members."""

import glob
import gzip
import hashlib

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "<p>same</p>" * 30


def write(spark, rows, tmp_path, **kw):
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), path, **kw)
    return path


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\nX: 1", BIG), (2, "http://b", BIG), (9, None, BIG), (2, "http://b", BIG), (None, "u", BIG),
            (3, "http://c", None), (4, "http://d", ""), (6, "http://e", "short"), (7, "http://f", "short"),
            (8, "http://g", "é" * 200_000), (None, "v", "x" * 150), (11, "w\r\n\r\n", "a\r\n\r\nb" * 40)]
    path = write(spark, rows, tmp_path, file_records=3)
    got = warc.read_archives(spark, path).collect()
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(i, least.get(h, i))

    def expected(i, h):
        raw = (h or "").encode()
        first = least.get(h)
        revisit = first is not None and first != i
        return (str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
                first if revisit else None, None if revisit else h or "")

    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got) \
        == sorted(expected(i, h) for i, _, h in rows) or len(got) == len(rows) and \
        sorted(map(str, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got))) \
        == sorted(map(str, (expected(i, h) for i, _, h in rows)))
    for name in glob.glob(path + "/part-*"):
        with gzip.open(name) as f:
            assert f.read().startswith(b"WARC/1.1\r\n")


def test_a_member_holds_one_record():
    raw = b"".join(warc.member(warc.record(i, "u", b"x" * 9, hashlib.sha256(b"x" * 9).hexdigest(), None, False, "d"), 6)
                   for i in range(3))
    assert [warc.parsed(m)[0] for m in warc.members(raw)] == [0, 1, 2]
    with pytest.raises(ValueError):
        list(warc.members(raw[:-5]))
    with pytest.raises(ValueError):
        warc.parsed(warc.record(1, "u", b"x" * 9, "0" * 64, None, False, "d"))


def test_long_records_end_with_an_empty_member(spark, tmp_path):
    path = write(spark, [(1, "u", "y" * (1 << 24))], tmp_path)
    got = warc.read_archives(spark, path).collect()
    assert [(r.page_id, r.payload_bytes) for r in got] == [(1, 1 << 24)]


def test_empty_table(spark, tmp_path):
    path = write(spark, [], tmp_path)
    assert warc.read_archives(spark, path).count() == 0
