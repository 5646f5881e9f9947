import hashlib

from conftest import FOLDER
from oracle import check, duck
from pyspark.sql import functions as F

from lodegraph.llm import queries, warc
from lodegraph.session import scratch_folder


def test_query(spark):
    good, note = check(spark, FOLDER, "op7_warc", queries.op7_warc, queries.CHECKS["op7_warc"], duck(FOLDER))
    assert good, note


def written(spark, rows, **settings):
    df = spark.createDataFrame(rows, "page_id long, url string, html binary, key string")
    path = scratch_folder(spark, "warc-test")
    warc.write(warc.assign_types(df, "page_id", "html"), path, "page_id", "url", "html", **settings)
    return path


def test_payloads_come_back(spark):
    big = bytes(range(256)) * 200
    tricky = b"a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\nWARC/1.1\r\n" * 40
    payloads = [b"", None, b"x", big, tricky, b"WARC/1.1\r\n" * 3000, "é日\U0001f642".encode() * 900, b"0\r\n\r\n"]
    rows = [(i, f"http://e.example/{i}\r\nX: y", p, "k") for i, p in enumerate(payloads)] + [(None, None, b"no id", None)]
    found = warc.read(spark, written(spark, rows, segment=700)).collect()
    assert len(found) == len(rows) and not any(r["error"] for r in found)
    by_key = {r["key"]: r for r in found}
    for i, _, p, _ in rows:
        assert bytes(by_key[i]["payload"]) == (p or b"")
        assert by_key[i]["payload_digest"] == hashlib.sha1(p or b"").hexdigest()


def test_revisits_and_repeated_rows(spark):
    long, short = b"x" * 1000, b"x" * 999
    rows = [(i, "u", p, "k") for i, p in ((1, long), (2, long), (3, long), (3, long), (4, short), (5, short))]
    found = warc.with_referred_lengths(warc.read(spark, written(spark, rows)).drop("payload")).collect()
    assert sorted((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found) == [
        (1, "revisit", 3, 1000), (2, "revisit", 3, 1000), (3, "response", None, 1000), (3, "response", None, 1000),
        (4, "response", None, 999), (5, "response", None, 999),
    ]
    assert warc.read(spark, written(spark, [])).collect() == []


def test_broken_records_are_told(spark):
    found = warc.records(spark, written(spark, [(1, "u", b"y" * 5000, "k"), (2, "u", b"z" * 5000, "k")], segment=600))
    lost = found.where(~((F.col("number") == 3) & F.col("origin").contains("page:1:")))
    errors = {r["record_id"].split(":")[2]: r["error"] for r in warc.reassemble(lost).collect()}
    assert errors == {"1": "segments are missing", "2": None}
    tail = found.where(F.col("total").isNull() | ~F.col("origin").contains("page:2:"))
    errors = {r["record_id"].split(":")[2]: r["error"] for r in warc.reassemble(tail).collect()}
    assert errors == {"1": None, "2": "the last segment is missing"}
    wrong = found.withColumn("total", F.col("total") + 1)
    assert {r["error"] for r in warc.payloads(warc.reassemble(wrong)).collect()} == {"the total length is wrong"}


def test_chunks():
    assert warc.unchunked(b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n") == b"abcde"
    assert warc.unchunked(warc.chunked(b"q" * 9999, 1000)) == b"q" * 9999
    for broken in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"-1\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.unchunked(broken) is None
