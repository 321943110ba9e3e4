"""WARC bundles: exact round trips, revisits, frames that open alone, and other readers of the format."""

import base64
import hashlib
import struct
from pathlib import Path

import pytest
import zstandard

from almanac.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, bundle string, first long"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least_bytes=0):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        size, to = len((html or "").encode()), first.get(html or "")
        again = size >= least_bytes and to is not None and to != page_id
        out.append((page_id, size, digest(html), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    """Copies, empty and null pages, missing and repeated ids, line breaks in urls, a page longer than a frame."""
    out = [(i, f"http://h{i % 7}.example/{i}", f"<html>{'word ' * (i % 50)}{i % 90} é</html>\r\n\r\n") for i in range(400)]
    out += [(1000 + i, None, None) for i in range(3)] + [(900, "http://e.example/", ""), (None, "http://n.example/", out[5][2]), (None, None, "only here")]
    out += [(2000, "http://long.example/\r\nX-Header: no", "long é " * 400_000), (2001, "http://long.example/2", "long é " * 400_000)]
    return [*out, out[3], (3, "http://other.example/", out[3][2])]


def read(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 5) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("least_bytes, most, large", [(0, warc.SMALL, warc.LARGE), (0, 0, 2), (25, 0, warc.LARGE)])
def test_round_trip(table, rows, least_bytes, most, large):
    """However shared payloads are joined: by broadcast, by a salted shuffle, by a plain one."""
    index = warc.write_bundles(table, least_bytes=least_bytes, most=most, large=large)
    assert read(warc.read_records(index)) == expected(rows, least_bytes)


def test_payloads_and_urls_come_back(table, rows):
    index = warc.write_bundles(table)
    got = warc.read_records(index, payloads=True).where("record_type = 'response'").collect()
    want = {(p, d) for p, _, d, kind, _ in expected(rows) if kind == "response"}
    assert {(r.page_id, r.payload_digest) for r in got} == want
    text = {digest(h): (h or "").encode() for _, _, h in rows}
    assert all(bytes(r.payload) == text[r.payload_digest] for r in got)
    url = {(p, u and u.replace("\r", "%0D").replace("\n", "%0A")) for p, u, _ in rows}
    assert {(r.page_id, r.url) for r in got} <= url


def test_records_are_found_by_their_identifier(spark, table, rows):
    index = warc.write_bundles(table)
    wanted = spark.createDataFrame([(7,), (2001,), (7,), (123456,)], "page_id long")
    got = warc.find_records(index, wanted).collect()
    assert sorted(r.page_id for r in got) == [7, 2001]
    again = next(r for r in got if r.page_id == 2001)
    assert again.record_type == "revisit" and again.refers_to == 2000 and again.payload is None


def test_every_frame_opens_alone(table):
    """The seek table agrees with the frames, the index with the records inside, and a plain decoder reads the whole file."""
    entries = warc.write_bundles(table).collect()
    for path in {r.bundle for r in entries}:
        raw = Path(path.removeprefix("file://")).read_bytes()
        reader = warc.BundleReader(path)
        count, _, magic = struct.unpack("<IBI", raw[-9:])
        assert magic == warc.SEEKABLE and count == len(reader.sizes)
        whole = b"".join(reader.frame(i) for i in range(count))
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert plain == whole
        own = [r for r in entries if r.bundle == path]
        frames = [reader.frame(i) for i in range(count)]
        assert sum(r.length for r in own) == len(whole)
        for r in own:
            piece = frames[r.frame][r.offset:r.offset + r.length]
            assert warc.parse(piece)["record_id"] == r.record_id
        reader.close()


def test_damage_is_seen(table):
    identifier, raw = warc.record(5, "http://a.example/", b"payload", digest("payload"), None)
    assert warc.parse(raw)["payload"] == b"payload" and identifier == warc.record_id(5, digest("payload"))
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n", b"paxload\r\n"))
    with pytest.raises(ValueError):
        warc.parse(raw[:-3])


def test_empty_table(spark):
    index = warc.write_bundles(spark.createDataFrame([], SCHEMA))
    assert index.count() == 0 and warc.read_records(index).count() == 0
