"""Archives: round trips and salvage of damaged files."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import Row

from tabloom.llm.warc import archived_pages, page_records, read_archives, record, write_archives


def plain(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        head = max(same, default=None)
        revisit = len(data) >= least and head is not None and page != head
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/ b\r\nX: y", None), (4, "", ""), (5, "u", "é" * 50_000),
         (9, "u", "é" * 50_000), (9, "u", "é" * 50_000), (None, "n", "<p>x</p>"), (None, "n", "alone"), (7, "z", "a\r\n\r\nWARC/1.1\r\n\x1f")]


@pytest.mark.parametrize("least", [0, 1, 9])
def test_pages(spark, tmp_path, least):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, payload int").repartition(3)
    got = sorted((tuple(r) for r in archived_pages(pages, str(tmp_path / "w"), least).collect()), key=str)
    assert got == plain(PAGES, least)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert archived_pages(pages).count() == 0


def test_archives_are_cut(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", str(i) * 2000) for i in range(40)], "page_id bigint, url string, html string").coalesce(1)
    manifest = write_archives(page_records(pages), str(tmp_path / "w"), compress=False, archive_bytes=20_000)
    assert manifest.count() > 3 and manifest.groupBy().sum("records").first()[0] == 40
    assert read_archives(spark, manifest).where("kind = 'record'").count() == 40


def rows(n):
    rng = random.Random(1)
    return [{"record_id": f"urn:page:{i}", "target_uri": f"http://x/{i}", "payload": rng.randbytes(rng.randint(0, 900)), "refers_to": None}
            for i in range(n)]


def read(spark, path):
    found = read_archives(spark, spark.createDataFrame([Row(path=str(path))])).collect()
    return sorted(found, key=lambda r: r.offset)


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "drop", "length"])
def test_salvage(spark, tmp_path, compress, damage):
    parts = [record(r, "2020-01-01T00:00:00Z") for r in rows(9)]
    if damage == "length":
        parts[4] = parts[4].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1) if b"HTTP" not in parts[4][:50] else parts[4]
        head, _, rest = parts[4].rpartition(b"application/http;msgtype=response\r\nContent-Length: ")
        parts[4] = head + b"application/http;msgtype=response\r\nContent-Length: 77" + rest
    packed = [gzip.compress(p) if compress else p for p in parts]
    lost = {4}
    if damage == "flip":
        middle = bytearray(packed[4])
        middle[-12 if compress else -20] ^= 255
        packed[4] = bytes(middle)
    elif damage == "cut":
        packed[8], lost = packed[8][:len(packed[8]) // 2], {8}
    elif damage == "junk":
        packed[4:4], lost = [b"\x1f\x8b\x08WARC/1.1\r\nnoise" * 20], set()
    elif damage == "drop":
        packed[4] = packed[4][:5]
    path = tmp_path / ("a.warc.gz" if compress else "a.warc")
    path.write_bytes(b"".join(packed))
    found = read(spark, path)
    assert [r.record_id for r in found if r.kind == "record"] == [f"urn:page:{i}" for i in range(9) if i not in lost]
    assert [bytes(r.payload) for r in found if r.kind == "record"] == [r["payload"] for i, r in enumerate(rows(9)) if i not in lost]
    gaps = [r for r in found if r.kind == "gap"]
    assert len(gaps) == 1 and gaps[0].reason
    # records and gaps cover every byte once
    at = 0
    for r in found:
        assert r.offset == at
        at += r.length
    assert at == path.stat().st_size


def test_only_damage_and_empty_file(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"no archive at all")
    (tmp_path / "y.warc").write_bytes(b"")
    assert [(r.kind, r.offset, r.length) for r in read(spark, tmp_path / "x.warc")] == [("gap", 0, 17)]
    assert read(spark, tmp_path / "y.warc") == []
