import gzip
import hashlib
import random
from collections import Counter
from glob import glob

import pytest

from signalmill.llm import scratch, warc


def page_rows():
    rng = random.Random(8)
    body = lambda n: "".join(rng.choice("<p>abcé日 \n") for _ in range(n))
    rows = [(i, f"http://h/{i}", body(rng.randint(0, 4000))) for i in range(60)]
    copy = body(500)
    rows += [(i, f"http://c/{i}", copy) for i in range(100, 130)] + [(i, "http://s", "short") for i in range(140, 150)]
    big = "x" * 3_000_000 + body(1000)
    rows += [(200, None, big), (201, "http://a\r\nWARC-Type: fake", big), (202, "http://n", None), (203, "http://e", ""), (None, "http://nil", copy), (100, "http://c/100", copy), (204, "http://z", "\x1f WARC/1.1\r\n\r\n" * 50)]
    return rows


def want(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and f != i
        out[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None] += 1
    return out


@pytest.mark.parametrize("split", [997, 65536, 1 << 24])
def test_round_trip_at_any_split(spark, split):
    rows = page_rows()
    if split == 997:
        rows = [r for r in rows if r[0] not in (200, 201)]  # many tiny ranges
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as refers_to").repartition(3)
    path = scratch.shared_dir(spark) + "/warc"
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == want(rows)


def test_without_a_broadcast(spark):
    rows = page_rows()
    path = scratch.shared_dir(spark) + "/warc"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, broadcast_rows=0)
    got = warc.read_warc(spark, path, 70000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == want(rows)


def foreign(kind, name, block, *more, content=b"application/http; msgtype=response"):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + name, b"Content-Type: " + content, *more, b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<html>\r\n\r\n two</html>"
    http = b"HTTP/1.1 404 Not Found\r\nServer: x\r\nContent-Length: 24\r\n\r\n"
    members = [
        foreign(b"warcinfo", b"<urn:uuid:1>", b"software: other\r\n", content=b"application/warc-fields"), foreign(b"request", b"<urn:uuid:2>", b"GET / HTTP/1.1\r\n\r\n"),
        foreign(b"response", b"<urn:uuid:3>", http + body, b"WARC-Target-URI: http://a/", b"X-Folded: one", b"  two"), foreign(b"response", b"<urn:page:7>", b"HTTP/1.0 200 OK\n\n" + body),
        foreign(b"revisit", b"<urn:page:8>", http, b"WARC-Refers-To: <urn:uuid:3>", b"WARC-Payload-Digest: sha1:ABC"), foreign(b"response", b"<urn:page:99999999999999999999>", http),
        foreign(b"response", b"<urn:page:9>", body, content=b"text/html"), foreign(b"response", b"<urn:page:10>", http + body, b"WARC-Target-URI: http://" + b"long" * 700_000),
    ]
    (tmp_path / "other.warc.gz").write_bytes(b"".join(members))
    digest = hashlib.sha256(body).hexdigest()
    for split in (100, 1 << 20):
        got = warc.read_warc(spark, str(tmp_path), split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(
            [(None, len(body), digest, "response", None), (7, len(body), digest, "response", None), (8, None, None, "revisit", None), (None, 0, hashlib.sha256().hexdigest(), "response", None), (9, len(body), digest, "response", None), (10, len(body), digest, "response", None)],
            key=str,
        )
        assert max(len(r.url or "") for r in got) == 2_800_007


def test_very_long_urls_come_back(spark):
    path = scratch.shared_dir(spark) + "/warc"
    warc.write_warc(spark.createDataFrame([(1, "http://" + "u" * 3_000_000, "hello")], "page_id long, url string, html string"), path)
    (row,) = warc.read_warc(spark, path, 4096).collect()
    assert (row.page_id, row.payload_bytes, len(row.url)) == (1, 5, 3_000_007)


def test_files_are_plain_gzip(spark):
    path = scratch.shared_dir(spark) + "/warc"
    df = spark.createDataFrame([(1, "http://a", "hello"), (2, "http://b", "world")], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, path)
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob(path.removeprefix("file://") + "/part-*"))
    assert text.count(b"WARC/1.1\r\n") == 2
    assert b"hello" in text


def test_empty(spark):
    path = scratch.shared_dir(spark) + "/warc"
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).collect() == []
