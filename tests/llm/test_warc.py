import base64
import gzip
import hashlib
import io
import random
import struct
import zlib

import pytest

from tidemark.llm import warc as W
from tidemark.llm.common import new_path

SCHEMA = "page_id long, url string, html string, payload string, sha string"
ROWS = [(5, "http://a/5", "same", "x", "y"), (2, "http://a/2", "same", "", ""), (9, None, "same", "", None), (1, "http://a/1\r\nX: y", None, "", ""), (3, "u", "", "", ""), (4, "u", "ünï\r\n\r\n" * 3000, "", ""), (7, "u", "", "", ""), (7, "u", "", "", ""), (None, "u", "same", "", ""), (8, "u" * 9000, "long url", "", "")]


def sha(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for p, _, h, *_ in rows:
        if p is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h, *_ in rows:
        f = first.get(h or "") if p is not None else None
        again = f is not None and f != p
        out.append((p, len((h or "").encode()), sha(h), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_pages_read_back(spark, least):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = new_path(spark, "warc")
    W.write_pages(df, path, least, file_bytes=600)
    for split in (64 << 20, 300):
        records = W.read_warc(spark, path, payload=False, split_bytes=split)
        assert sorted(map(tuple, W.page_digests(records).collect()), key=str) == brute(ROWS, least)
    full = {r.record_id: r.payload for r in W.read_warc(spark, path).where("record_type = 'response'").collect()}
    assert bytes(full["urn:page:4"]).decode() == ROWS[5][2] and bytes(full["urn:page:1"]) == b""
    kept = W.read_warc(spark, path).where("record_type = 'revisit' and target_uri like 'http://a/%'")
    assert {r.record_id for r in kept.collect()} == ({"urn:page:5"} if least == 0 else set())


def test_predicates_reach_the_source(spark, capsys):
    path = new_path(spark, "warc")
    W.write_pages(spark.createDataFrame(ROWS, SCHEMA), path)
    W.read_warc(spark, path).where("record_type = 'revisit'").explain("formatted")
    assert "Filter" not in capsys.readouterr().out.split("BatchScan")[0]


def test_empty_table_and_lost_attempts(spark):
    path = new_path(spark, "warc")
    df = spark.createDataFrame(ROWS, SCHEMA)
    W.write_pages(df.limit(0), path)
    assert W.read_warc(spark, path).collect() == []
    store, folder = W._open(path)
    with store.open_output_stream(f"{folder}/part-left.warc.gz", compression=None) as f:
        f.write(b"half a record")
    assert W.read_warc(spark, path).collect() == []


def test_records_are_plain_gzip_and_payloads_are_skipped():
    one = W.member(W.record("urn:page:1", "response", "u", None, "00" * 20, 10000, random.Random(1).randbytes(10000)))
    two = W.member(W.record("urn:page:2", "revisit", "u", "urn:page:1", "00" * 20, 3, b""))
    text = gzip.decompress(one + two)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response") and text.count(b"WARC/1.1\r\n") == 2
    broken = bytearray(one)
    broken[5000:9000] = b"\xff" * 4000  # the payload can't be inflated, the header can
    rows = list(W.read_records(io.BytesIO(bytes(broken) + two), 0, len(broken + two), payload=False))
    assert [(r["record_type"], r["payload_length"], r["refers_to"]) for r in rows] == [("response", 10000, None), ("revisit", 3, "urn:page:1")]


def test_digests_are_those_of_the_payloads_read(spark):
    path = new_path(spark, "warc")
    W.write_pages(spark.createDataFrame(ROWS, SCHEMA), path)
    assert sorted(map(tuple, W.read_digests(spark, path).collect()), key=str) == brute(ROWS)
    path = new_path(spark, "warc")
    W.register(spark)
    rows = [("urn:page:1", "response", "u", None, "00" * 20, 99, b"four"), ("urn:page:2", "revisit", "u", "urn:page:1", "00" * 20, 99, None)]
    store, folder = W._open(path)
    store.create_dir(folder)
    spark.createDataFrame(rows, W.SCHEMA).write.format("warc").mode("append").save(path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in W.read_digests(spark, path).collect()}
    assert got == {1: (4, sha("four")), 2: (None, None)}  # no record holds what the header tells


def standard():
    """Records as other makers write them, and what is to be read."""
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one</p>\r\n\r\nWARC/1.0" + b"z" * 9000
    blocks = [
        ("WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields", b"software: x\r\n"),
        ("WARC-Type: request\r\nWARC-Record-ID: <urn:q>\r\nWARC-Target-URI: http://a/\r\nContent-Type: application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        ("WARC-Type: response\r\nwarc-record-id: <urn:r>\r\nWARC-Target-URI: http://a/\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Type: application/http; msgtype=response", page),
        ("WARC-Type: metadata\r\nContent-Type: application/warc-fields", b""),
        ("WARC-Type: revisit\r\nWARC-Record-ID: <urn:v>\r\nWARC-Refers-To: <urn:r>\r\nContent-Type: application/http", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n"),
    ]
    records = [f"WARC/1.0\r\n{h}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for h, b in blocks]
    body = page.split(b"\r\n\r\n", 1)[1]
    want = [("urn:i", "warcinfo", None, 13, blocks[0][1]), ("urn:q", "request", None, 0, b""), ("urn:r", "response", "ABC", len(body), body), (None, "metadata", None, 0, b""), ("urn:v", "revisit", None, 77, None)]
    return records, want


@pytest.mark.parametrize("kind", ["plain", "members", "whole"])
def test_files_of_other_makers(spark, tmp_path, kind):
    records, want = standard()
    data = b"".join(records) if kind == "plain" else b"".join(map(gzip.compress, records)) if kind == "members" else gzip.compress(b"".join(records))
    (tmp_path / ("a.warc" if kind == "plain" else "a.warc.gz")).write_bytes(data)
    read = lambda split=64 << 20, **o: W.read_warc(spark, str(tmp_path), split_bytes=split, **o)
    for split in (64 << 20, 100):
        got = [(r.record_id, r.record_type, r.payload_digest, r.payload_length, r.payload and bytes(r.payload)) for r in read(split).collect()]
        assert sorted(got, key=str) == sorted([(*w[:4], w[4] or (None if w[1] == "revisit" else w[4])) for w in want], key=str)
    assert [r.target_uri for r in read(payload=False).where("record_type = 'response'").collect()] == ["http://a/"]
    for cut in (len(data) - 12, len(data) // 2, 40):
        f = io.BytesIO(data[:cut])
        with pytest.raises(ValueError):
            list(W.read_any(f, 0, cut))


def test_own_files_cut_off_and_payloads_by_their_bytes(spark):
    path = new_path(spark, "warc")
    W.write_pages(spark.createDataFrame(ROWS, SCHEMA), path)
    for r in W.read_warc(spark, path).where("record_type = 'response'").collect():
        assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest and len(r.payload) == r.payload_length
    data = W.member(W.record("urn:x", "response", "u" * 9000, None, "00" * 20, 5, b"hello" * 2000))
    for cut in (len(data) - 20, 60, 30):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            list(W.read_any(io.BytesIO(data[:cut]), 0, cut))
