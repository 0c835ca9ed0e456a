from __future__ import annotations

import glob
import gzip
import hashlib

from tidemark.llm import warc

SCHEMA = "page_id LONG, url STRING, html STRING, file STRING"
BIG = "<p>é</p>" * 200


def pages():
    return [
        (1, "http://a.test/1", BIG, "x"), (2, "http://a.test/2", BIG, "x"), (3, None, BIG, None), (4, "http://b.test/ü x\r\nEvil: 1", "small", "y"),
        (5, "http://b.test/5", "small", "y"), (6, "http://c.test/", None, "z"), (7, "http://c.test/7", "", "z"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 90, "q"),
        (9, "u", "x" * 3_000_000, "q"), (2, "http://a.test/2", BIG, "x"), (10, "u", "a" * 1000, "q"), (11, "u", "a" * 1000, "q"), (12, "u", "b" * 999, "q"),
        (13, "u", "b" * 999, "q"), (None, "http://n.test/", BIG, "n"),
    ]


def test_round_trip(spark, tmp_path):
    path = f"{tmp_path}/out"
    index = warc.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(3), path)
    records = warc.read_records(index).collect()
    assert len(records) == len(pages())
    newest = {}
    for page_id, _, html, _ in pages():
        body = (html or "").encode()
        if len(body) >= 1000 and page_id is not None:
            newest[body] = max(newest.get(body, page_id), page_id)
    got = sorted((r.page_id or -1, r.payload_bytes, r.digest, r.record_type, r.refers_to, bytes(r.payload or b"")) for r in records)
    want = []
    for page_id, _, html, _ in pages():
        body = (html or "").encode()
        other = newest.get(body)
        revisit = page_id is not None and other is not None and other != page_id
        want.append((
            page_id or -1, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", other if revisit else None,
            b"" if revisit else body,
        ))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3]))
    assert {r.page_id: r.url for r in records}[3] is None
    assert "\r" not in {r.page_id: r.url for r in records}[4]


def test_archives_are_plain_gzip_members(spark, tmp_path):
    path = f"{tmp_path}/out"
    index = warc.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(2), path).collect()
    scanned = 0
    for file in glob.glob(f"{path}/*.warc.gz"):
        data = open(file, "rb").read()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        scanned += len(warc.scan_archive(data))
        own = sorted((r.offset, r.length) for r in index if file.endswith(r.file))
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) == len(data)
    assert scanned == len(index)


def test_selected_records_only(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame(pages(), SCHEMA), f"{tmp_path}/out")
    chosen = warc.read_records(index.filter("page_id IN (4, 9)")).collect()
    assert sorted(r.page_id for r in chosen) == [4, 9]


def test_ranges_merge():
    near, far = warc.GAP_BYTES, warc.GAP_BYTES * 10
    assert warc.merged_ranges([(0, 5), (5, 5), (10 + near, 5), (far, 5)]) == [
        (0, 15 + near, [(0, 5), (5, 5), (10 + near, 5)]), (far, far + 5, [(far, 5)]),
    ]
    assert len(warc.merged_ranges([(0, warc.READ_BYTES), (warc.READ_BYTES, 1)])) == 2


def test_empty_table(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/out")
    assert index.count() == 0 and warc.read_records(index).collect() == []
