import base64
import hashlib

import pytest

from inkprint.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, sha1 string, bytes int"
ROWS = [(1, "http://a/x", "<p>same</p>"), (9, "http://a/y", "<p>same</p>"), (4, None, "<p>same</p>"), (2, "u\r\nX-Bad: 1", "other é🙂"),
        (3, "http://e", None), (5, "http://e", ""), (6, "http://big", "word " * 50_000), (None, "http://n", "lonely"),
        (None, "http://n", "<p>same</p>"), (7, "http://t", "tie"), (7, "http://t", "tie")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "s", 1) for r in rows], SCHEMA)


def brute(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = (h or "") in best and i != best[h or ""]
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", best[h or ""] if revisit else None))
    return sorted(out, key=str)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/archive"


def test_against_brute_force(spark, folder):
    warc.write(frame(spark, ROWS), folder)
    assert sorted((tuple(r) for r in warc.read_back(spark, folder).collect()), key=str) == brute(ROWS)
    stored = spark.read.parquet(f"{folder}/payloads")
    assert stored.count() == len({h or "" for _, _, h in ROWS})


def test_records_come_back_exactly(spark, folder):
    warc.write(frame(spark, ROWS), folder)
    rows = warc.read_records(spark, folder).collect()
    assert len(rows) == len(ROWS)
    html = {i: (h or "").encode() for i, _, h in ROWS if i is not None}
    for r in rows:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"X-Bad: 1\r\n" not in head.replace(b"%0AX-Bad", b"")
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest == (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n" and len(rest) == length + 4
        if r.page_id is not None:
            assert bytes(r.payload) == html[r.page_id]


def test_urls_come_back_exactly(spark, folder):
    urls = [None, "", " ", "http://a/%0D%0A", "a\r\nb", "%0D\r", "%", "%%25", "%2525", "%250D\n", "%25%0a", "%2\n5", "x%20y", "WARC-Type: x\r\nWARC-Type: y"]
    warc.write(frame(spark, [(i, u, f"page {i}") for i, u in enumerate(urls)]), folder)
    rows = {r.page_id: r for r in warc.read_headers(spark, folder).collect()}
    assert [rows[i].url for i in range(len(urls))] == urls
    assert all(r.record_type == "response" and r.header.count("\r\n\r\n") == 1 for r in rows.values())


def test_small_payloads_are_all_responses(spark, folder):
    warc.write(frame(spark, ROWS), folder, least_bytes=5)
    kinds = {(r.page_id, r.record_type) for r in warc.read_back(spark, folder).collect()}
    assert (3, "response") in kinds and (5, "response") in kinds and (1, "revisit") in kinds


def test_damage_is_found(spark, folder):
    warc.write(frame(spark, ROWS[:3]), folder)
    broken = spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "encode('changed', 'UTF-8') AS payload")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-2/headers")
    broken.write.parquet(f"{folder}-2/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_back(spark, f"{folder}-2").collect()


def test_empty_table(spark, folder):
    warc.write(frame(spark, []), folder)
    assert warc.read_back(spark, folder).count() == 0 and warc.read_records(spark, folder).count() == 0
