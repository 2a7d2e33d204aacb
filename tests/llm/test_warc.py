import gzip
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkarch.llm import warc


@given(st.binary(max_size=300), st.integers(1, 40), st.integers(1, 50))
def test_framing_round_trip(payload, chunk, cut):
    message = warc.HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(payload, chunk)
    u = warc.Unchunker()
    assert b"".join(x for i in range(0, len(message), cut) for x in u.feed(message[i : i + cut])) == payload and u.end() is None


@pytest.mark.parametrize(("body", "problem"), [(b"5\r\nabc", "truncated"), (b"zz\r\nabc", "chunk size"), (b"3\r\nabcXX0\r\n\r\n", "chunk end"), (b"3\r\nabc\r\n0\r\n\r\nmore", "bytes after the last chunk")])
def test_broken_framing(body, problem):
    u = warc.Unchunker()
    list(u.feed(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body))
    assert u.end() == problem


@given(st.lists(st.binary(max_size=200), max_size=5), st.sampled_from(["plain", "one", "members"]), st.integers(1, 90))
def test_archives_parse_by_length(blocks, how, step):
    records = [warc.record("response", str(i), [("X", i)], b) for i, b in enumerate(blocks)]
    content = b"".join(records) if how == "plain" else gzip.compress(b"".join(records)) if how == "one" else b"".join(map(gzip.compress, records))
    assert [b for _, b in warc.parse_archive(content, step)] == blocks


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def expected(rows):
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i != first.get(h or "") and (h or "") in first and sum((x[2] or "") == (h or "") for x in rows) > 1
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip_with_every_odd_case(spark, tmp_path):
    r = random.Random(3)
    nasty = "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n" * 9
    rows = [(i, f"http://h/{i}", "".join(r.choice("aé\r\n ") for _ in range(r.randrange(4000))), "d") for i in range(30)]
    rows += [(100 + i, None if i % 2 else "http://x/\r\nEvil: 1", nasty, None) for i in range(40)] + [(200, "u", None, None), (201, "u", "", None), (202, "u", "short", None), (203, "u", "short", None), (None, "u", nasty, None), (100, "u", nasty, None)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, rows), path, segment_bytes=500, chunk_bytes=97, archive_bytes=9000)
    found = warc.read_archives(spark, path).cache()
    assert found.filter("problem is not null").count() == 0
    whole = {(x["page_id"], bytes(x["payload"])) for x in found.filter("record_type = 'response'").collect()}
    assert {(i, (h or "").encode()) for i, _, h, _ in rows if i is not None and i < 100} <= whole
    got = [(x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.resolve_revisits(found).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_missing_repeated_and_false_segments(spark, tmp_path):
    block = warc.HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"x" * 1000, 100)
    recs = list(warc.page_records(1, "u", b"x" * 1000, hashlib.sha256(b"x" * 1000).hexdigest(), None, False, "one", 400, 100))
    assert sum(len(r) for r in recs) > len(block) and len(recs) > 2
    bad = list(warc.page_records(2, "u", b"y" * 1000, "0" * 64, None, False, "two", 400, 100))
    torn = list(warc.page_records(3, "u", b"z" * 1000, hashlib.sha256(b"z" * 1000).hexdigest(), None, False, "three", 400, 100))
    twice = list(warc.page_records(4, "u", b"q" * 1000, hashlib.sha256(b"q" * 1000).hexdigest(), None, False, "four", 400, 100))
    orphan = list(warc.page_records(5, "u", b"o" * 1000, hashlib.sha256(b"o" * 1000).hexdigest(), None, False, "five", 400, 100))[1:]
    (tmp_path / "part-0").write_bytes(b"".join([recs[1], bad[0], torn[0], recs[0], *bad[1:], *torn[2:], *twice, twice[1]]))
    (tmp_path / "part-1").write_bytes(b"".join([*recs[:1:-1], *orphan]))
    found = {(x["page_id"], x["problem"], x["payload_bytes"]) for x in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert (1, None, 1000) in found and (2, "digest", 1000) in found and (3, "missing segment", found and next(n for i, _, n in found if i == 3)) in found
    assert any(i == 4 and p == "repeated segment" for i, p, _ in found) and any(i is None and p == "missing segment" for i, p, _ in found)


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, []), path)
    assert not list(tmp_path.glob("w/part-*")) or warc.read_archives(spark, path).count() == 0
