import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from photolith.llm import warc
from photolith.llm._store import new_path

SCHEMA = "page_id long, url string, html string, value string, file string"


def brute(rows):
    first = {}
    for i, _, html, *_ in rows:
        key = html or ""
        if i is not None and (first.get(key) is None or i < first[key]):
            first[key] = i
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        lead = first.get(html or "")
        revisit = lead is not None and i != lead
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in warc.write_and_read(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
NESTED = FAKE + "x" + FAKE + FAKE + "WARC/1.1\r\n" + "WARC/1.1\r\nContent-Length: 99999\r\n\r\n"


def test_edge_rows_and_magic_inside_payloads(spark):
    rows = [
        (1, "http://a/", "x", "v", "f"), (2, None, "x", "v", "f"), (3, "http://b\r\nWARC-Type: no", None, "v", "f"), (4, "u", "", None, None),
        (5, "u", FAKE, "v", "f"), (6, "u", NESTED, "v", "f"), (7, "u", "WARC/1.1\r\n", "v", "f"), (8, "u", "\r\n\r\n" + FAKE + "é漢" * 1000, "v", "f"),
        (9, "u", NESTED, "v", "f"), (10, "u", "y\r\n\r\n", "v", "f"), (10, "u", "y\r\n\r\n", "v", "f"), (None, "u", "x", "v", "f"), (None, "u", "alone", "v", "f"),
        (11, "u", "é" * 300_000, "v", "f"),
    ]
    assert run(spark, rows) == brute(rows)
    assert warc.write_and_read(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_one_file_in_many_splits(spark):
    rows = [(i, f"u{i}", (FAKE if i % 3 else "plain ") * (i % 7) + str(i), None, None) for i in range(120)]
    path = new_path(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert warc.candidates(spark, path).select(F.countDistinct("block")).head()[0] > 5
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_splits_may_change_between_the_call_and_the_action(spark):
    rows = [(i, f"u{i}", (NESTED + "é" * 50) * (i % 4 + 1) + str(i), None, None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for first, then in (("128m", "2k"), ("2k", "128m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            found = warc.write_and_read(df)
            spark.conf.set("spark.sql.files.maxPartitionBytes", then)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
            got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
            assert sorted((tuple(r) for r in got), key=str) == brute(rows)
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_lost_piece_is_an_error(spark, monkeypatch):
    path = new_path(spark, "warc-test")
    warc.write(spark.createDataFrame([(1, "u", "x" + FAKE + FAKE + "y", None, None)], SCHEMA), path)
    whole, scans = warc._scan, []

    def scan(*args):
        scans.append(args)
        return whole(*args).filter(F.lit(len(scans) == 1))

    monkeypatch.setattr(warc, "_scan", scan)
    with pytest.raises(Exception, match="is missing from"):
        warc.read(spark, path).collect()


def test_hot_payload_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", -1)
    rows = [(i, "u", "same" if i % 3 == 0 else f"p{i}", None, None) for i in range(300)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("raw", [b"", b"a", bytes(range(256))])
def test_base32_sha1(spark, raw):
    got = spark.createDataFrame([(bytearray(raw),)], "b binary").select(warc.base32_sha1(F.col("b"))).head()[0]
    assert got == base64.b32encode(hashlib.sha1(raw).digest()).decode()
