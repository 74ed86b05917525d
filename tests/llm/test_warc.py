import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quoteflow.llm import warc
from quoteflow.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, digest string, row int, payload string, largest int"


def round_trip(spark, pages, **options):
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path, **options)
    return warc.reassemble(warc.read_records(spark, path)).collect()


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def test_chunked_framing():
    rnd = random.Random(1)
    for n in (0, 1, 7, 8, 9, 1000):
        body = rnd.randbytes(n)
        assert warc.dechunked(warc.chunked(body, 8)) == body
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def test_round_trip_with_segments_and_many_archives(spark):
    rnd = random.Random(2)
    traps = ["\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "0\r\n\r\n", "é한😀\r\n", "x"]
    rows = [(i, f"http://h.example/{i}\r\nX: y é", "".join(rnd.choice(traps) for _ in range(rnd.randint(0, 200)))) for i in range(80)]
    rows += [(100 + i, None, rows[i][2]) for i in range(20)] + [(200, "u", None), (201, "u", ""), (None, "u", "nobody's"), (202, "u", "nobody's"), (203, "u", "alone"), (203, "u", "alone")]
    got = round_trip(spark, pages_of(spark, rows), segment=100, archive=5000)
    assert sorted((r.page_id is None, r.page_id, r.payload_bytes) for r in got if r.page_id is not None) == sorted((False, p, len((h or "").encode())) for p, _, h in rows if p is not None)
    largest = {}
    for p, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if p is None else p)
    html = {p: h or "" for p, _, h in rows}
    for r in got:
        body = html[r.page_id].encode()
        assert r.payload_digest == r.declared == base64.b32encode(hashlib.sha1(body).digest()).decode()
        top = largest[html[r.page_id]]
        assert r.record_type == ("response" if r.page_id == top else "revisit")
        assert r.refers_to == (None if r.page_id == top else top)
        assert r.record_type == "revisit" or r.payload == body
    assert sum(r.page_id == 203 and r.record_type == "response" for r in got) == 2


def test_small_payloads_and_empty_table(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = round_trip(spark, pages_of(spark, rows), least=4)
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert round_trip(spark, pages_of(spark, [])) == []


def test_missing_segment_is_an_error(spark):
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages_of(spark, [(1, "u", "y" * 1000)]), path, segment=100)
    records = warc.read_records(spark, path)
    assert records.where("number IS NOT NULL").count() > 5
    for broken in (records.where("coalesce(number, 0) <> 3"), records.where(F.col("total").isNull())):
        with pytest.raises(Exception, match="segments of"):
            warc.reassemble(broken).collect()


@pytest.mark.parametrize("layout", ["a member a record", "files behind one another", "one member", "plain"])
def test_archives_of_others(spark, tmp_path, layout):
    import gzip

    body = "é<p>x</p>".encode() * 50
    records = []
    for k in range(5):
        block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(body + str(k).encode(), 16)
        records.append(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(block)) + block + b"\r\n\r\n")
    data = {
        "a member a record": b"".join(gzip.compress(r) for r in records),
        "files behind one another": gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:])),
        "one member": gzip.compress(b"".join(records)), "plain": b"".join(records),
    }[layout]
    (tmp_path / "other.warc").write_bytes(data)
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, r.payload) for r in got) == [(f"<urn:x:{k}>", body + str(k).encode()) for k in range(5)]
    if layout == "one member":
        with pytest.raises(ValueError, match="cut short"):
            warc.unzipped(data[:-20])


def test_a_payload_of_a_third_of_the_pages_and_one_above_an_archive(spark):
    rows = [(k, "u", "error page") for k in range(300)] + [(1000, "u", "z" * 40_000)]
    got = {r.page_id: r for r in round_trip(spark, pages_of(spark, rows), segment=1000, archive=5000)}
    assert len(got) == 301 and got[1000].payload == b"z" * 40_000
    assert all(got[k].record_type == ("response" if k == 299 else "revisit") for k in range(300))
