"""WARC archives as seekable Zstandard bundles, and an index from record identifiers to places inside frames."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.plans.lineage import cut, scratch_path

FRAME = 1 << 20
"""Bytes of records after which a frame ends; a record is never split."""
BUNDLE = 1 << 28
"""Compressed bytes after which a bundle ends."""
READ = 1 << 27
"""Bytes of records that a reading task gets, about."""
LEVEL = 3
SMALL = 1_000_000
LARGE = 20_000
DATE = "1970-01-01T00:00:00Z"
"""The given pages have no time of capture."""

# Fixed values of the seekable format: skippable frame, footer and descriptor.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PLAIN = 0

INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD = ("record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
          "refers_to long")
PREFIX = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    """The identifier of a page with a payload; both can be read from it."""
    return f"{PREFIX}{'' if page_id is None else page_id}:{digest}"


def page_of(identifier: str) -> int | None:
    page = identifier.removeprefix(PREFIX).split(":")[0]
    return int(page) if page else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[str, bytes]:
    """(identifier, bytes) of a response, or of a revisit of the page ``refers_to``, whose block has the HTTP head alone.

    Line breaks in a url are percent-encoded. The HTTP head tells the length of the whole payload.
    """
    identifier = record_id(page_id, digest)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return identifier, "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record. A response whose payload doesn't have its digest and length is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line for line in http.decode().split("\r\n") if line.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    identifier = fields["WARC-Record-ID"].strip("<>")
    kind = fields["WARC-Type"]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"no whole record at {identifier}")
    if kind == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {identifier} doesn't match its digest")
    to = fields.get("WARC-Refers-To")
    return {"record_id": identifier, "page_id": page_of(identifier), "url": fields.get("WARC-Target-URI"), "record_type": kind,
            "payload_digest": digest, "payload_bytes": length, "refers_to": to and page_of(to.strip("<>")),
            "payload": payload if kind == "response" else None}


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it; a path without a scheme is one that all executors mount."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class BundleWriter:
    """One file of independent frames and, behind them, a skippable frame with the sizes of all."""

    def __init__(self, path: str):
        self.path = path
        system, inner = filesystem(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(inner, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.buffer: list[bytes] = []
        self.held = self.written = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset inside the frame) of the record added."""
        place = len(self.frames), self.held
        self.buffer.append(raw)
        self.held += len(raw)
        if self.held >= FRAME:
            self.flush()
        return place

    def flush(self) -> None:
        if self.buffer:
            packed = self.compressor.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.held))
            self.written += len(packed)
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames) + struct.pack("<IBI", len(self.frames), PLAIN, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, found by the seek table at its end."""

    def __init__(self, path: str):
        system, inner = filesystem(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entry = 12 if descriptor & 0x80 else 8
        table = self.file.read_at(count * entry, size - 9 - count * entry)
        self.starts, self.sizes, at = [], [], 0
        for i in range(count):
            packed, raw = struct.unpack_from("<II", table, i * entry)
            self.starts.append(at)
            self.sizes.append((packed, raw))
            at += packed

    def frame(self, number: int) -> bytes:
        packed, raw = self.sizes[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[number]), max_output_size=raw)

    def close(self) -> None:
        self.file.close()


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


INDEX_ARROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()),
                         ("offset", pa.int64()), ("length", pa.int64())])
RECORD_ARROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                          ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])


def _first_pages(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(sha, other, first, n) of payloads that several rows hold; ``other`` is a second hash beside SHA-1."""
    return (rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha", "other")
            .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"))


def _with_first(rows: DataFrame, shared: DataFrame, most: int, large: int) -> DataFrame:
    """``rows`` with the ``first`` page of their payload, null where no other row has it.

    Up to ``most`` shared payloads (40 bytes each) are broadcast, so pages aren't shuffled. More are joined
    by a shuffle; a payload of over ``large`` rows is dealt over tasks by a salt.
    """
    table = cut(shared)
    if table.count() <= most:
        return rows.join(F.broadcast(table.drop("n")), ["sha", "other"], "left")
    salts = F.ceil(F.col("n") / large).cast("int")
    # At most one row for every ``large`` rows of the table.
    wide = table.where(F.col("n") > large).select("sha", "other", salts.alias("salts"))
    wide = F.broadcast(wide) if wide.count() <= SMALL else wide
    salted = rows.join(wide, ["sha", "other"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > large, salts - 1).otherwise(0)))).drop("n")
    return salted.join(copies, ["sha", "other", "salt"], "left").drop("salt")


def write_bundles(pages: DataFrame, path: str | None = None, least_bytes: int = 0, most: int = SMALL, large: int = LARGE) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and give the index of all records.

    The payload is html in UTF-8 (null: empty). Of rows with equal payloads of at least ``least_bytes`` bytes
    those of the smallest page_id are responses (one row, unless rows repeat that page_id) and the
    others revisit it, also those without a page_id; payloads that only such rows have, and smaller
    ones, are responses.

    Every task writes bundles of its own below ``path`` (a new path in the shared folder, if None), named by
    a random id: frames of whole records, each one readable alone, then a seek table. The index,
    (record_id, page_id, bundle, frame, offset inside the decompressed frame, length), is a written
    table and names the bundles of tasks that ended; a bundle left behind by a lost executor is in no row of
    it. An empty table gives an empty index; other columns are ignored.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    hashed = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("other", F.xxhash64("payload"))
    dealt = _with_first(hashed, _first_pages(hashed, least_bytes), most, large)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            out = []
            for page_id, url, body, sha, first in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    bundle = BundleWriter(f"{path}/{uuid.uuid4().hex}.warc.zst")
                identifier, raw = record(page_id, url, body, base32(sha), first)
                frame, offset = bundle.add(raw)
                out.append((identifier, page_id, bundle.path, frame, offset, len(raw)))
                if bundle.written >= BUNDLE:
                    bundle.close()
                    bundle = None
            yield _arrow(out, INDEX_ARROW)
        if bundle is not None:
            bundle.close()

    return cut(dealt.select("page_id", "url", "payload", "sha", F.when(again, F.col("first")).alias("first")).mapInArrow(write, INDEX))


def read_records(index: DataFrame, payloads: bool = False, read: int = READ) -> DataFrame:
    """The records that ``index`` names (all of it, or the rows of some identifiers), read from their bundles.

    Columns: record_id, page_id, url, record_type, payload_digest (bare base32 SHA-1), payload_bytes (of the
    whole payload, for revisits too), refers_to, and with ``payloads`` the payload (null for revisits). Only
    frames with a wanted record are read, each once where its records come together. Responses are checked
    against their digest.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-total // read))
    schema = RECORD_ARROW.append(pa.field("payload", pa.binary())) if payloads else RECORD_ARROW
    spread = index.sparkSession.sparkContext.defaultParallelism
    near = F.floor(F.col("frame") / 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader, number, frame = None, None, None, b""
        for batch in batches:
            out, held = [], 0
            for bundle, wanted, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != at:
                    if reader is not None:
                        reader.close()
                    at, reader, number = bundle, BundleReader(bundle), None
                if wanted != number:
                    number, frame = wanted, reader.frame(wanted)
                found = parse(frame[offset:offset + length])
                out.append(tuple(found[f.name] for f in schema))
                held += length
                if payloads and held >= READ // 8:
                    yield _arrow(out, schema)
                    out, held = [], 0
            yield _arrow(out, schema)
        if reader is not None:
            reader.close()

    return (index.select("bundle", "frame", "offset", "length").repartition(max(parts, spread), "bundle", near)
            .sortWithinPartitions("bundle", "frame", "offset")
            .mapInArrow(run, RECORD + (", payload binary" if payloads else "")))


def find_records(index: DataFrame, pages: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the page_ids in ``pages``, by :func:`read_records`."""
    wanted = pages.select(F.col("page_id").cast("long").alias("page_id")).distinct()
    return read_records(index.join(wanted, "page_id", "left_semi"), payloads)


def sql(least_bytes: int = 0) -> str:
    """The same table in SQL; base32 is taken from the digest's hex digits, ten for eight."""
    return f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
), digits AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 10 * g + 1, 10) AS BIGINT) >> (35 - 5 * d)) & 31 AS INTEGER), 1), '' ORDER BY g, d) AS b32
  FROM (SELECT DISTINCT h FROM p), range(4) a(g), range(8) b(d) GROUP BY h
)
SELECT page_id, payload_bytes, b32 AS payload_digest,
       CASE WHEN payload_bytes >= {least_bytes} AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {least_bytes} AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f JOIN digits USING (h)
"""
