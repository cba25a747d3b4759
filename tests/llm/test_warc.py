"""WARC archives: exact round trip, revisits, chunks."""

import base64
import collections
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lexiflow.llm import warc
from lexiflow.llm.common import written

SCHEMA = "page_id long, url string, html string, record_type int, data string"


def expected(rows, revisit_from=0):
    first = {}
    for page, _, html, *_ in rows:
        p = (html or "").encode()
        first.setdefault(p, []).append(page)
    out = collections.Counter()
    for p, pages in first.items():
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        order = sorted(pages, key=lambda x: (x is None, x))
        for k, page in enumerate(order):
            again = k > 0 and len(p) >= revisit_from
            out[(page, len(p), digest, "revisit" if again else "response", order[0] if again else None)] += 1
    return out


@pytest.fixture(scope="module")
def pages():
    same = "<html>\r\n\r\nWARC/1.1\r\n é</html>"
    return [(1, "http://a/x", same, 1, "d"), (2, None, same, 1, "d"), (3, "http://a/\r\nx y", None, 1, "d"),
            (4, "u", "", 1, "d"), (None, "u", "", 1, "d"), (5, "u", "long " * 60_000, 1, "d"), (6, "ü", "\r\n\r\n", 1, "d"),
            (7, "u", "once", 1, "d"), (7, "u", "once", 1, "d"), (0, "u", "long " * 60_000, 1, "d")]


def test_round_trip(spark, pages):
    frame = spark.createDataFrame(pages, SCHEMA).repartition(3)
    for least in (0, 5):
        got = collections.Counter(tuple(r) for r in warc.archive_round_trip(frame, least).collect())
        assert got == expected(pages, least)


def test_sample_pages(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in frame.collect()]
    assert collections.Counter(tuple(r) for r in warc.archive_round_trip(frame).collect()) == expected(rows)


def test_payloads_come_back_in_chunks(spark, pages, tmp_path):
    frame = spark.createDataFrame(pages, SCHEMA).coalesce(1)
    chunks = written(warc.chunk_table(frame, chunk=1000), "chunks")
    assert chunks.selectExpr("max(octet_length(data))").first()[0] == 1000
    files = warc.write_archives(chunks, warc.record_roles(chunks), f"{tmp_path}/w")
    texts = collections.defaultdict(bytes)
    for r in sorted(warc.read_archives(files, chunk=700).collect(), key=lambda r: (r.record_id, r.chunk_no)):
        if r.record_type == "response":
            assert len(r.data) <= 700
            texts[r.page_id] += bytes(r.data)
    want = {r[0]: (r[2] or "").encode() for r in pages if r[0] in (0, 1, 3, 6, 7)}
    assert {k: v for k, v in texts.items() if k != 7} == {k: v for k, v in want.items() if k != 7}
    assert texts[7] == b"once"
    for f in files.collect():  # plain gzip members, records end with two empty lines
        raw = gzip.open(f.path).read()
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        assert raw.count(b"WARC-Record-ID: ") == f.n_records


def test_damage_is_found(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "payload", 1, "d")], SCHEMA)
    chunks = written(warc.chunk_table(frame), "chunks")
    files = warc.write_archives(chunks, warc.record_roles(chunks), f"{tmp_path}/w")
    path = files.first().path
    raw = gzip.open(path).read().replace(b"payload", b"paytoad")
    with gzip.open(path, "wb") as f:
        f.write(raw)
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(files).collect()


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_read_by_many_tasks(spark):
    frame = spark.range(400).selectExpr("id as page_id", "concat('u', id) as url", "concat('page ', id) as html")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = written(warc.chunk_table(frame), "chunks")
        files = warc.write_archives(chunks, warc.record_roles(chunks))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    tasks = warc.read_archives(files).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert files.count() == 4 and len(tasks) >= 3 and sum(r["count"] for r in tasks) == 400
