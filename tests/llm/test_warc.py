import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from wanderlake.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
ROWS = [
    (1, "http://a.b/x", "<p>é</p>", "q"),
    (2, None, None, None),
    (3, "https://WWW.q.org", "<p>é</p>", None),
    (None, "u\r\nv", "\r\n\r\nWARC/1.1\r\n", None),
    (5, "http://a.b/x?y#z", "", None),
    (6, "http://a.b/x", "<p>é</p>", None),
    (6, "http://a.b/x", "<p>é</p>", None),
    (7, "http://c.d", "long " * 200_000, None),
]


def read_back(spark, rows, **how):
    pages = spark.createDataFrame(rows, SCHEMA)
    path = warc.write_archives(pages, captured=F.timestamp_seconds("page_id"), **how)
    return warc.merge_runs(warc.sorted_runs(warc.read_captures(spark, path)), range_rows=3)


def test_round_trip(spark):
    got = sorted((r.key or "", r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in read_back(spark, ROWS, records_per_file=3).collect())
    newest = {}
    for k, _, html, _ in ROWS:
        if k is not None:
            newest[html or ""] = max(k, newest.get(html or "", k))
    want = []
    for k, _, html, _ in ROWS:
        raw = (html or "").encode()
        again = k is not None and newest[html or ""] != k
        want.append((str(k) if k is not None else "", "revisit" if again else "response", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), str(newest[html or ""]) if again else None))
    assert got == sorted(want)


def test_small_payloads_can_all_be_responses(spark):
    assert {r.record_type for r in read_back(spark, ROWS, least_bytes=10**7).collect()} == {"response"}


def test_global_order(spark):
    rows = [(i, f"http://{'www.' if i % 2 else ''}h{i % 5}.example.org/p{i % 7}", f"page {i % 40}", None) for i in range(300)]
    out = read_back(spark, rows, records_per_file=20, small=0)
    got = [(r.url_key, r.captured, r.key) for r in out.orderBy("range", "position").collect()]
    assert got == sorted(got) and len(got) == 300


def test_empty(spark):
    pages = spark.createDataFrame([], SCHEMA)
    path = warc.write_archives(pages)
    assert warc.merge_runs(warc.sorted_runs(warc.read_captures(spark, path))).count() == 0


def test_records_of_gzip_members():
    def one(n):
        block = b"x" * n
        return f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n".encode() + block + b"\r\n\r\n"

    packed = b"".join(gzip.compress(one(n)) for n in (0, 5, 70_000))
    assert [len(b) for _, _, b in warc.records(packed)] == [0, 5, 70_000]
    whole = gzip.compress(b"".join(one(n) for n in (0, 5, 70_000, 3, 9000)))
    for piece in (1, 7, 64, 5000, 1 << 20):
        got = list(warc.records(whole, piece))
        assert [len(b) for _, _, b in got] == [0, 5, 70_000, 3, 9000]
        raw = gzip.decompress(whole)
        assert all(raw[at : at + 8] == b"WARC/1.1" for at, _, _ in got)
        assert [len(b) for _, _, b in warc.records(packed, piece)] == [0, 5, 70_000]


def test_loser_tree():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
