"""ARC to WARC: exact round trip, both versions, duplicates."""

import gzip
import hashlib

import pytest

from siteworks.llm.warc import ARC_FIELDS, ARC_VERSIONS, arc_records, archive_pages, warc_records, write_arc, write_warc
from siteworks.session import scratch_path

SCHEMA = "page_id long, url string, html string, digest string"


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in data:
        if len(p) >= 100:
            first[p] = min(i, first.get(p, i))
    seen, out = set(), []
    for i, p in data:
        one = first.get(p, i)
        revisit = len(p) >= 100 and (i != one or p in seen)
        if i == one:
            seen.add(p)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", one if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nfiledesc://x 1 0\n" * 4 + "é汉\x00\x1f end\r\n\r\n"
    rows = [
        (5, "http://a/x y", "é" * 50), (3, "http://a/%20", "é" * 50), (9, None, "é" * 50), (4, "u", "é" * 49 + "a"), (6, "u", "é" * 49 + "a"),
        (7, "ü\nv", None), (8, "", ""), (1, "u", "x" * 2_000_000), (10, "u", "x" * 2_000_000), (11, "u", "\r\n\r\n"), (12, "u", tricky),
        (2, "u", tricky), (13, "u", "same" * 30), (13, "u", "same" * 30), (-4, "u", "minus"),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    got = archive_pages(frame).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_null_id_and_empty_table(spark):
    got = archive_pages(spark.createDataFrame([(None, "u", "y" * 100, ""), (2, "u", "y" * 100, "")], SCHEMA)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("2", "response", None), ("None", "revisit", 2)]
    assert archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_files_are_plain_archives(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 3}</p>" * 20) for i in range(12)]
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(3), arc)
    write_warc(spark, arc, warc)
    read = lambda path: [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    files = read(arc)
    assert {gzip.decompress(f).split(b"\n")[2].decode() for f in files} == set(ARC_FIELDS.values())
    assert sum(len(list(arc_records(f))) for f in files) == 12
    records = [r for f in read(warc) for r in warc_records(f)]
    by_id = {n["WARC-Record-ID"]: (n, b) for n, b in records}
    assert len(by_id) == 12
    for named, block in records:
        payload = block.partition(b"\r\n\r\n")[2]
        if named["WARC-Type"] == "revisit":
            assert payload == b"" and by_id[named["WARC-Refers-To"]][0]["WARC-Payload-Digest"] == named["WARC-Payload-Digest"]
    assert sum(n["WARC-Type"] == "response" for n, _ in records) == 3


def test_broken_archives_are_told():
    block = f"{ARC_VERSIONS[1]}\n{ARC_FIELDS[1]}\n"
    start = f"filedesc://x 0 19960101000000 text/plain {len(block)}\n{block}\n"
    assert len(list(arc_records(gzip.compress(f"{start}u 0 1996 text/html 2\nab\n".encode())))) == 1
    for bad in (f"{start}u 0 1996 text/html 9\nab\n", "u 0 1996 text/html 2\nab\n", start.replace("1 0 E", "7 0 E")):
        with pytest.raises(ValueError):
            list(arc_records(gzip.compress(bad.encode())))
