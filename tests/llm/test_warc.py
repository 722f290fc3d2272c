import base64
import gzip
import hashlib
import http.client
import io
import uuid
import zlib
from collections import Counter

import pytest

from docgrain.llm import warc

PAGES = [(20, "http://a/b%20c?d=%25%C3", "z"), (21, "", "z"), (22, "http://é/\u2028%41", "z"), (5, "http://a/b c", "<p>é</p>"), (2, "http://a/\r\nX", "<p>é</p>"), (9, None, None), (7, "u", ""), (3, "http://z", "x" * 300_000), (2, "http://a/2", "<p>é</p>"), (None, "n", "<p>é</p>"), (11, "v", "\r\n\r\nWARC/1.1\r\n"), (8, "u", "")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, refers_to string, payload int")


def test_round_trip(spark):
    got = warc.round_trip(frame(spark, PAGES), payload=True).collect()
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, url, html in PAGES:
        raw = (html or "").encode()
        to = first[html or ""] if i is not None and i > first[html or ""] else None
        want.append((str(i), str(url), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", str(to), None if to is not None else raw))
    assert sorted(map(repr, want)) == sorted(repr((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), None if r.payload is None else bytes(r.payload))) for r in got)


def test_files(spark, tmp_path):
    out, final = f"file://{tmp_path}/mono", f"file://{tmp_path}/final"
    manifest = warc.write_monolithic(warc.with_revisits(frame(spark, PAGES[3:7]).coalesce(1)), out, file_bytes=600)
    assert manifest.count() > 1
    for row in warc.normalise(manifest, final).collect():
        raw, index = open(row.path[7:], "rb").read(), open(row.index_path[7:]).read().splitlines()
        assert len(index) == row.n_records
        at = 0
        for line in index:
            offset, length, name = line.split(" ", 2)
            assert int(offset) == at
            record = zlib.decompress(raw[at : at + int(length)], 31)
            assert record.startswith(b"WARC/1.1\r\n") and name.encode() in record
            at += int(length)
        assert at == len(raw) and gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type") == row.n_records


def second_parser(raw):
    """Records of a file, member by member, read by other means than the operator's: (headers, body)."""
    out = []
    while raw:
        zipped = zlib.decompressobj(31)
        data = zipped.decompress(raw)
        raw = zipped.unused_data
        assert zipped.eof and data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        stream = io.BytesIO(data[10:])
        headers = http.client.parse_headers(stream)
        body = stream.read()
        assert len(body) == int(headers["Content-Length"]) + 4
        out.append((headers, body[:-4]))
    return out


def test_archives_by_a_second_parser(spark, tmp_path):
    rows = [*PAGES, *[(30, "http://same", "y")] * 3, (31, "http://later", "y"), (None, None, "n"), (None, None, "n")]
    manifest = warc.write_monolithic(warc.with_revisits(frame(spark, rows)), f"file://{tmp_path}/mono")
    found, firsts = [], 0
    for row in warc.normalise(manifest, f"file://{tmp_path}/final").collect():
        records = second_parser(open(row.path[7:], "rb").read())
        firsts += records[0][0]["WARC-Type"] == "warcinfo"
        assert row.n_records == len(records)
        found += records[1:]
    assert firsts == manifest.count() and len(found) == len(rows)
    ids = [h["WARC-Record-ID"] for h, _ in found]
    assert len(set(ids)) == len(ids) and all(str(uuid.UUID(i[10:-1])) == i[10:-1] and i.startswith("<urn:uuid:") for i in ids)
    by_id = {h["WARC-Record-ID"]: (h, b) for h, b in found}
    uris = Counter(h["WARC-Target-URI"] for h, _ in found)
    assert uris["http://a/b%20c?d=%25%C3"] == 1 and uris["http://a/b%20c"] == 1, "a legal URI stands as it is"
    for headers, body in found:
        head, _, payload = body.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK")
        if headers["WARC-Type"] == "response":
            assert headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            assert not payload and headers["WARC-Profile"].endswith("/identical-payload-digest") and headers["WARC-Refers-To-Date"]
            if headers["WARC-Refers-To"]:
                target = by_id[headers["WARC-Refers-To"]][0]
                assert target["WARC-Type"] == "response" and target["WARC-Payload-Digest"] == headers["WARC-Payload-Digest"]
                assert target["X-Page-ID"] == headers["X-Refers-To-Page-ID"] and target["WARC-Target-URI"] == headers["WARC-Refers-To-Target-URI"]
    known = {h["X-Page-ID"]: bool(h["WARC-Refers-To"]) for h, _ in found if h["WARC-Type"] == "revisit"}
    assert known == {"21": True, "22": True, "5": False, "31": False, "8": True, "9": True}, "of several equal records none is named"


def test_streams():
    records = [warc.record(i, "u", bytes([i]) * 5000) for i in range(20)]
    whole = b"".join(records)
    for data in (gzip.compress(whole), b"".join(map(gzip.compress, records))):
        chunks = list(warc.inflated(io.BytesIO(data)))
        assert b"".join(chunks) == whole and list(warc.split_records(iter(chunks))) == records
    assert list(warc.split_records(iter([whole[i : i + 7] for i in range(0, len(whole), 7)]))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([whole[:-5]])))


def test_least_bytes_and_empty(spark):
    kinds = {(r.page_id, r.record_type) for r in warc.round_trip(frame(spark, [(1, "u", "a"), (2, "u", "a"), (3, "u", "bb"), (4, "u", "bb")]), least_bytes=2).collect()}
    assert kinds == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}
    assert warc.round_trip(frame(spark, []).limit(0)).count() == 0
