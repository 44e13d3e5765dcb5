import base64
import hashlib

from barflow.llm import warc

ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (3, None, None), (4, "http://a b\r\nX: y", "é" * 5), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n" * 3), (7, "u", "z" * 3_000_000),
    (9, "http://a/9", "<p>same</p>"), (None, "u", "lonely"), (None, "u", "<p>same</p>"),
]


def frame(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id bigint, url string, html string, payload string").repartition(3)


def test_round_trip_and_revisits(spark):
    index = warc.write(frame(spark), frame_bytes=1000)
    out = warc.read(index).collect()
    assert len(out) == len(ROWS) == index.count()
    for r in out:
        html = {i: h for i, _, h in ROWS if i is not None}.get(r.page_id, None)
        if r.page_id is not None:
            raw = (html or "").encode()
            assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    kinds = sorted((r.page_id, r.record_type, r.refers_to) for r in out if r.page_id is not None)
    assert [(i, t, f) for i, t, f in kinds if i in (1, 2, 9)] == [(1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (9, "response", None)]
    assert [(i, t, f) for i, t, f in kinds if i in (3, 5)] == [(3, "revisit", 5), (5, "response", None)]
    assert sorted(r.refers_to or 0 for r in out if r.page_id is None) == [0, 9]


def test_random_access(spark):
    for r in warc.write(frame(spark), frame_bytes=1000).collect():
        fields, block = warc.read_record(r.file, r.frame, r.offset, r.length)
        assert fields.get("X-Page-ID") == (None if r.page_id is None else str(r.page_id)) and int(fields["Content-Length"]) == len(block)


def test_smaller_payloads_are_responses(spark):
    assert {r.record_type for r in warc.read(warc.write(frame(spark), min_bytes=1000)).collect()} == {"response"}


def test_empty_table(spark):
    assert warc.read(warc.write(frame(spark).limit(0))).count() == 0
