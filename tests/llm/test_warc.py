import pytest
from pyspark.sql import functions as F

from varkit.llm import warc as W
from varkit.llm.common import scratch

PAGES = [(5, "http://a/", "x" * 10), (2, None, "x" * 10), (9, "http://b c/\n", "x" * 10), (1, "u", None), (7, "u", ""), (3, "u", "é漢🙂\r\n\r\nWARC/1.1\r\n" * 4000), (4, "u", "é漢🙂\r\n\r\nWARC/1.1\r\n" * 4000),
         (2, "u", "x" * 10), (None, "u", "y"), (8, "u", "0\r\n\r\n"), (10, "u", "long " * 30_000)]


def _expected(rows, min_bytes=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        first = min(same) if same and len(b) >= min_bytes else i
        kind = "response" if first is None or first == i else "revisit"
        out.append((str(i), len(b), W.sha1_base32(b), kind, first if kind == "revisit" else None))
    return sorted(out, key=str)


def _trip(spark, rows, **kw):
    path = scratch(spark, "test-warc")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "first": F.lit(2), "id": F.lit(3)})
    W.write_archives(df, path, **kw)
    got = W.read_archives(spark, path).collect()
    return path, sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str)


def test_round_trip_with_segments_and_revisits(spark):
    path, got = _trip(spark, PAGES, segment_bytes=1000, records_per_file=7)
    assert got == _expected(PAGES)
    records = W.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() > 100
    whole = {r.page_id: bytes(r.payload) for r in W.reassembled(records).collect()}
    assert whole[3].decode() == PAGES[5][2] and whole[10].decode() == PAGES[10][2]


def test_large_ids_beside_null_are_kept(spark):
    big = 2**53
    rows = [(big + 1, "u", "same"), (big + 11, "u", "same"), (None, "u", "other"), (big + 3, "u", "long " * 900), (big + 5, "u", "single")]
    _, got = _trip(spark, rows, segment_bytes=500)
    assert got == _expected(rows)


def test_short_payloads_may_all_be_responses(spark):
    _, got = _trip(spark, PAGES, min_bytes=11)
    assert got == _expected(PAGES, 11)


def test_missing_segment_and_bad_chunks_raise(spark):
    path, _ = _trip(spark, PAGES[-1:], segment_bytes=1000)
    records = W.read_records(spark, path)
    with pytest.raises(Exception, match="segments of"):
        W.reassembled(records.where("segment_no <> 5")).collect()
    with pytest.raises(ValueError):
        W.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


@pytest.mark.parametrize("n", [0, 1, 7, 8192, 8193, 50_000])
def test_chunked_framing(n):
    data = ("é" * n).encode()
    assert W.dechunked(W.chunked(data)) == data


def test_empty(spark):
    assert _trip(spark, [])[1] == []
