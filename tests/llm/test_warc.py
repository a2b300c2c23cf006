import base64
import hashlib

import pytest
from compare import SF, assert_same

from cloakframe.llm import queries, warc


def test_framing():
    for payload in (b"", b"x", b"a" * 20000, "é\r\n\r\n".encode() * 99):
        assert warc.dechunk(warc.chunked(payload, 7)) == payload
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")


def test_segments_in_any_order():
    assert warc.reassemble([(2, 6, b"def"), (1, None, b"abc")]) == [b"abcdef"]
    assert warc.reassemble([(2, 6, b"def"), (1, None, b"abc")] * 2) == [b"abcdef"] * 2
    for bad in ([(1, 6, b"abc")], [(1, None, b"abc"), (3, 6, b"def")], [(1, None, b"a"), (2, 3, b"b")]):
        with pytest.raises(ValueError):
            warc.reassemble(bad)


def test_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 900
    rows = [(3, "http://a/ x", big), (1, None, "x"), (2, "u", "x"), (5, "u", "x"), (5, "u", "x"), (7, "u", None), (8, "u", ""), (9, "u", big), (10, "u", big + "!"), (1, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' AS key", "1 AS first")
    for k, least in enumerate((0, 5)):
        path = str(tmp_path / f"w{k}")
        warc.write_archives(df, path, least, segment_bytes=1000, chunk_bytes=64, records_per_file=3)
        want = []
        for page, _, html in rows:
            payload = (html or "").encode()
            first = min(p for p, _, h in rows if (h or "") == (html or ""))
            again = len(payload) >= least and page > first
            want.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first if again else None))
        got = [tuple(r) for r in warc.read_archives(spark, path).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_null_ids(spark, tmp_path):
    rows = [(None, "u", "x"), (4, "u", "x"), (None, "u", "alone"), (None, "u", "both"), (None, "u", "both"), (6, None, "y" * 200)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "n"), segment_bytes=100)
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "n")).collect()]
    want = [(None, 1, "revisit", 4), (4, 1, "response", None), (None, 5, "response", None), (None, 4, "response", None), (None, 4, "response", None), (6, 200, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_sql(spark, duck):
    assert_same(queries.op3_warc(spark, SF), duck, queries.OP3_SQL)
