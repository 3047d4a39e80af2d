"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records of
about ``FRAME_BYTES`` together, and a seek table behind them (the public seekable
format: a skippable frame, so that plain Zstandard readers pass over it):

    frame*  5E2A4D18 size  (stored size u32, content size u32, checksum u32)*  frames u32  flags u8  B1EA928F

All numbers are little-endian; a checksum is the low half of the content's XXH64.
The index of a written archive maps each record to (path, frame, offset in the
frame's content, length), so one record costs one frame.

Of records with equal payloads the one with the largest id is the response, and the
others are revisits of it without a payload.  Texts meet by two digests (SHA-256
and SHA-1); only digests, ids and locators are grouped, and an often repeated
payload is aggregated before the shuffle.  Files have a name of their own for each task attempt
and count only if the stored index names them, so a task that runs twice does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf.llm.common import FILE, ROW, binary_values, located, scanned, shared_path, slices, stored
from adperf.llm.token_store import _filesystem

#: Content of a frame, and stored size of a file, beyond which the next record opens another.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format: skippable frame, seek table footer, flag of checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Fixed value: profile of a revisit with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID, REFERS_TO = "Page-ID", "Refers-To-Page-ID"
INDEX = "record_id string, page_id long, path string, frame int, offset long, length long, record_type string, refers_to string"
RECORD = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to_id string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record; fields without a value are left out."""
    lines = [f"{name}: {value}\r\n" for name, value in fields if value is not None]
    return b"".join([b"WARC/1.1\r\n", "".join(lines).encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of the records of a frame's content."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        if head < 0 or not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at {at}")
        lines = content[at:head].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        stop = head + 4 + int(fields["Content-Length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        yield at, stop + 4 - at, fields, content[head + 4 : stop]
        at = stop + 4


def http_parts(block: bytes) -> tuple[int, bytes]:
    """(Content-Length of the HTTP header, body) of a record's block."""
    head = block.index(b"\r\n\r\n") + 4
    return int(re.search(rb"(?mi)^Content-Length: ([0-9]+)\r$", block[:head])[1]), block[head:]


class BundleWriter:
    """Writes one bundle; ``add`` gives a record's (frame, offset in its content)."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.fs, self.path = _filesystem(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.frame_bytes = self.fs.open_output_stream(self.path, compression=None), frame_bytes
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.table: list[bytes] = []
        self.content: list[bytes] = []
        self.held = self.size = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        if self.held and self.held + len(raw) > self.frame_bytes:
            self.flush()
        place = len(self.table), self.held
        self.content.append(raw)
        self.held += len(raw)
        return place

    def flush(self) -> None:
        if self.content:
            content = b"".join(self.content)
            frame = self.pack(content)
            self.out.write(frame)
            self.table.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.size += len(frame)
            self.content, self.held = [], 0

    def close(self) -> None:
        self.flush()
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        table = b"".join(self.table) + footer
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle; ``places`` has (offset, stored size, content size, checksum) of each."""

    def __init__(self, path: str):
        import zstandard

        self.fs, at = _filesystem(path)
        self.file = self.fs.open_input_file(at)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9)) if end >= 17 else (0, 0, 0)
        if magic != SEEKABLE or flags != CHECKSUMS or end < 17 + 12 * n:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 + 12 * n, end - 17 - 12 * n)
        if struct.unpack_from("<II", table) != (SKIPPABLE, 12 * n + 9):
            raise ValueError(f"the seek table of {path} is damaged")
        self.places, offset = [], 0
        for stored_size, size, check in struct.iter_unpack("<III", table[8:]):
            self.places.append((offset, stored_size, size, check))
            offset += stored_size
        self.unpack = zstandard.ZstdDecompressor().decompress

    def frame(self, at: int) -> bytes:
        offset, stored_size, size, check = self.places[at]
        content = self.unpack(self.file.read_at(stored_size, offset), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {at} is damaged")
        return content

    def close(self) -> None:
        self.file.close()


def _record_id(file: str, row: int) -> str:
    """The same id for a row in every run over the same files."""
    return f"<urn:uuid:{uuid.UUID(bytes=xxhash.xxh3_128_digest(f'{file}#{row}'.encode()))}>"


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(locator, first file, first row, first id) of the rows of ``pages`` whose payload an other row stands for.

    Of equal payloads of at least ``least`` bytes the row with the largest id
    stands for the others; null ids come before all, and of rows that share an id
    the last by locator stands.  ``pages`` is a plain scan.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = located(pages).select(F.col(id_col).cast("long").alias("id"), FILE, ROW, payload.alias("p"))
    rows = rows.where(F.octet_length("p") >= least).select("id", FILE, ROW, F.sha2("p", 256).alias("key"), F.sha1("p").alias("other"))
    rows = stored(rows)
    last = F.max(F.struct(F.col("id").isNotNull().alias("x"), "id", F.col(FILE).alias("f"), F.col(ROW).alias("r"))).alias("last")
    many = rows.groupBy("key", "other").agg(last, F.count(F.lit(1)).alias("n")).where("n > 1")
    out = rows.join(many, ["key", "other"]).where((F.col(FILE) != F.col("last.f")) | (F.col(ROW) != F.col("last.r")))
    return out.select(FILE, ROW, F.col("last.f").alias("of_file"), F.col("last.r").alias("of_row"), F.col("last.id").alias("of_id"))


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE,
) -> DataFrame:
    """Write a WARC record for each row into bundles in ``folder``; the stored index of the records (INDEX).

    A null payload is empty; a null id or address leaves its field out; blanks and
    control characters of addresses are percent-encoded.  Equal rows give a record each.
    An empty table gives no bundle and an empty index; other columns are
    not read.  A payload of any length is one record in one frame, and a task holds one frame.
    """
    pages = scanned(pages)
    rows = located(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("payload"), FILE, ROW)
    rows = rows.join(stored(revisits(pages, id_col, payload_col, least)), [FILE, ROW], "left")

    def run(batches):
        writer, path = None, ""
        for b in slices(batches, "payload"):
            got = {c: b.column(c).to_pylist() for c in ("id", "url", FILE, ROW, "of_file", "of_row", "of_id")}
            out = []
            for k, payload in enumerate(binary_values(b.column("payload"))):
                if writer is not None and writer.size > bundle_bytes:
                    writer.close()
                    writer = None
                if writer is None:
                    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(path, frame_bytes)
                of = None if got["of_file"][k] is None else _record_id(got["of_file"][k], got["of_row"][k])
                kind = "response" if of is None else "revisit"
                name, url = _record_id(got[FILE][k], got[ROW][k]), got["url"][k]
                if url is not None:
                    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                raw = record(
                    [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", url),
                     (PAGE_ID, got["id"][k]), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
                     ("WARC-Profile", PROFILE if of else None), ("WARC-Refers-To", of), (REFERS_TO, got["of_id"][k] if of else None),
                     ("Content-Type", "application/http; msgtype=response")],
                    block if of else block + payload,
                )
                frame, offset = writer.add(raw)
                out.append((name, got["id"][k], path, frame, offset, len(raw), kind, of))
            yield _batch(out, INDEX)
        if writer is not None:
            writer.close()

    return stored(rows.mapInArrow(run, INDEX))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def frames(bundles: DataFrame) -> DataFrame:
    """(path, frame, content size) of every frame of the bundles (path), from their seek tables alone."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                reader = BundleReader(path)
                yield _batch([(path, k, place[2]) for k, place in enumerate(reader.places)], "path string, frame int, size long")
                reader.close()

    return _dealt(bundles.select("path").distinct(), "path").mapInArrow(run, "path string, frame int, size long")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_archive(bundles: DataFrame) -> DataFrame:
    """Every record (RECORD) of the bundles (path), read and checked frame by frame.

    A response's payload must have the length and the digest of its header, else
    the read fails; a revisit has the length and the digest of the payload that it
    refers to.  Frames are dealt over all tasks, so a large bundle is no large task.
    """

    def run(batches):
        for b in batches:
            path_of, readers = "", None
            for path, at in zip(b.column("path").to_pylist(), b.column("frame").to_pylist(), strict=True):
                if path != path_of:
                    if readers:
                        readers.close()
                    path_of, readers = path, BundleReader(path)
                yield _batch([_parsed(fields, block) for _, _, fields, block in records(readers.frame(at))], RECORD)
            if readers:
                readers.close()

    return _dealt(frames(bundles), "path", "frame").sortWithinPartitions("path", "frame").mapInArrow(run, RECORD)


def _parsed(fields: dict[str, str], block: bytes) -> tuple:
    size, body = http_parts(block)
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(body) != size or base32_sha1(body) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its header")
    number = lambda name: int(fields[name]) if name in fields else None
    return (fields["WARC-Record-ID"], number(PAGE_ID), fields.get("WARC-Target-URI"), kind, size, digest, fields.get("WARC-Refers-To"), number(REFERS_TO))


def read_payloads(index: DataFrame, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, record_id, payload binary) of the wanted pages; only their frames are decompressed.

    A revisit has the payload of the response that it refers to.  Ids are compared null-safe;
    a wanted id counts once, and gives a row for each of its records.
    """
    asked = wanted.select(F.col(id_col).cast("long").alias("asked")).distinct()
    found = index.join(asked, F.col("page_id").eqNullSafe(F.col("asked"))).select("page_id", "record_id", F.coalesce("refers_to", "record_id").alias("at"))
    needed = found.select("at").distinct()
    places = index.join(needed, F.col("record_id") == F.col("at")).select("at", "path", "frame", "offset", "length")

    def run(batches):
        for b in batches:
            got, key, reader, content, out = b.to_pydict(), None, None, b"", []
            for k in range(b.num_rows):
                now = (got["path"][k], got["frame"][k])
                if key is None or now[0] != key[0]:
                    if reader:
                        reader.close()
                    reader = BundleReader(now[0])
                if now != key:
                    key, content = now, reader.frame(now[1])
                raw = content[got["offset"][k] : got["offset"][k] + got["length"][k]]
                out.append((got["at"][k], http_parts(next(records(raw))[3])[1]))
            yield _batch(out, "at string, payload binary")
            if reader:
                reader.close()

    payloads = _dealt(places, "path", "frame").sortWithinPartitions("path", "frame", "offset").mapInArrow(run, "at string, payload binary")
    return found.join(payloads, "at").select("page_id", "record_id", "payload")


def new_archive(spark: SparkSession) -> str:
    return shared_path(spark, "adperf-warc", uuid.uuid4().hex)
