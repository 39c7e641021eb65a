import base64
import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sysloom.llm.queries import op2_warc
from sysloom.llm.shared import filesystem, shared_dir
from sysloom.llm import warc
from sysloom.llm.warc import archive, archived, member, record, register


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, min_bytes=0):
    """What the archives must say: (page_id, bytes, digest, type, refers_to) of each row."""
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        same = [p for p, h in rows if (h or "").encode() == data and p is not None]
        first = min(same, default=None)
        revisit = len(data) >= min_bytes and first is not None and page_id != first
        out.append((page_id, len(data), digest(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


ROWS = [(5, "a"), (3, "a"), (9, "a"), (1, None), (2, ""), (4, "é😀\r\n\r\nWARC/1.0\r\n"), (None, "a"), (7, "x" * 300_000), (8, "x" * 300_000), (3, "a"), (6, "only")]


def test_pages_and_back(spark):
    pages = spark.createDataFrame([(p, f"http://h/{p}\n x", h, 1) for p, h in ROWS], "page_id long, url string, html string, digest int").repartition(3)
    for least in (0, 1):
        path = shared_dir(spark, "t")
        archive(pages, path, min_bytes=least)
        assert sorted(map(tuple, archived(spark, path).collect()), key=repr) == brute(ROWS, least)
    back = spark.read.format("warc").load(path).filter("record_type = 'response'")
    assert {r.payload for r in back.collect()} == {(h or "").encode() for _, h in ROWS}


def test_empty_table(spark):
    path = shared_dir(spark, "t")
    archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert archived(spark, path).collect() == []


def test_foreign_files_and_pushdown(spark):
    """Plain files and gzip members without sizes; a bad payload is only noticed when it is wanted."""
    path = shared_dir(spark, "t")
    store, at = filesystem(path)
    store.create_dir(at, recursive=True)
    records = [record(k, f"<urn:{i}>", f"http://h/{i}", "2020-01-01T00:00:00Z", digest(b"p%d" % i), 2, None, b"p%d" % i if i != 2 else b"??") for i, k in enumerate(["response", "request", "response", "metadata"])]
    with store.open_output_stream(f"{at}/a.warc.gz", compression=None) as f:
        f.write(b"".join(gzip.compress(r) for r in records[:2]))
    with store.open_output_stream(f"{at}/b.warc") as f:
        f.write(b"".join(records[2:]))
    register(spark)
    full = spark.read.format("warc").load(path)
    assert sorted((r.record_id, r.payload) for r in full.collect()) == [("<urn:0>", b"p0"), ("<urn:1>", b"p1"), ("<urn:2>", b"??"), ("<urn:3>", b"p3")]
    checked = spark.read.format("warc").option("payload", "verify").load(path)
    assert [r.record_id for r in checked.filter("record_type = 'metadata'").collect()] == ["<urn:3>"]
    assert sorted(r.record_id for r in checked.filter("target_uri <> 'http://h/2'").collect()) == ["<urn:0>", "<urn:1>", "<urn:3>"]
    plan = checked.filter("record_type = 'metadata'")._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter")[-1] or "Filter" not in plan
    none = spark.read.format("warc").option("payload", "none").load(path)
    assert none.filter(F.col("payload").isNotNull()).count() == 0 and none.count() == 4


def test_query(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op2_warc(spark, sf).collect()), key=repr) == brute(pages)


def written_file(path, name, data):
    store, at = filesystem(path)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/{name}", compression=None) as f:
        f.write(data)


def test_records_in_any_members(spark):
    """One member for all, several in one, one cut across members, and this writer's; wanted and unwanted payloads in between."""
    payloads = [b"p%d" % i * (1 + i * 30_000) for i in range(6)]
    records = [record("response" if i % 2 else "request", f"<urn:{i}>", None, "2020-01-01T00:00:00Z", digest(p), len(p), None, p) for i, p in enumerate(payloads)]
    joined = b"".join(records)
    files = {
        "one": gzip.compress(joined),
        "pairs": b"".join(gzip.compress(b"".join(records[i : i + 2])) for i in (0, 2, 4)),
        "across": b"".join(gzip.compress(joined[i : i + 1000]) for i in range(0, len(joined), 1000)),
        "sized": b"".join(member(r, 1) for r in records),
        "mixed": member(b"".join(records[:3]), 6) + b"".join(member(r, 1) for r in records[3:]),
    }
    register(spark)
    for name, data in files.items():
        path = shared_dir(spark, "t")
        written_file(path, "a.warc.gz", data)
        read = spark.read.format("warc").load(path)
        assert sorted((r.record_id, r.payload) for r in read.collect()) == [(f"<urn:{i}>", p) for i, p in enumerate(payloads)], name
        assert sorted((r.record_id, r.payload) for r in read.filter("record_type = 'response'").collect()) == [(f"<urn:{i}>", payloads[i]) for i in (1, 3, 5)], name
        none = spark.read.format("warc").option("payload", "none").load(path)
        assert none.count() == 6, name


def test_cut_files_are_errors(spark):
    whole = gzip.compress(record("response", "<urn:1>", None, "2020-01-01T00:00:00Z", None, 9, None, b"x" * 90_000))
    half = zlib.compressobj(6, zlib.DEFLATED, 31)
    register(spark)
    for data, name in ((whole[:-40], "a.warc.gz"), (half.compress(b"WARC/1.0\r\nWARC-Type: response\r\n") + half.flush(), "a.warc.gz"), (b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc", "a.warc")):
        path = shared_dir(spark, "t")
        written_file(path, name, data)
        with pytest.raises(Exception, match="early|within"):
            spark.read.format("warc").load(path).collect()


def test_a_failed_attempt_leaves_no_file(spark):
    from pyspark.sql.functions import udf

    path = shared_dir(spark, "t")
    bad = udf(lambda i: 1 // (i - 5), "int")
    rows = spark.range(10, numPartitions=1).select(F.lit("response").alias("record_type"), F.col("id").cast("string").alias("record_id"), F.lit("u").alias("target_uri"), F.lit("d").alias("payload_digest"), bad("id").cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("refers_to"), F.lit(b"x").alias("payload"))
    register(spark)
    with pytest.raises(Exception):
        rows.write.format("warc").mode("append").save(path)
    store, at = filesystem(path)
    from pyarrow import fs

    assert [x.base_name for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True))] == []


def test_many_groups_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    pages = spark.createDataFrame([(p, "http://h", h) for p, h in ROWS], "page_id long, url string, html string")
    path = shared_dir(spark, "t")
    archive(pages, path)
    assert sorted(map(tuple, archived(spark, path).collect()), key=repr) == brute(ROWS)
