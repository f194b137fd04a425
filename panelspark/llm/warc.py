"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Tasks write archives through pyarrow.fs into a shared folder, under names of their own, and return them as rows of a
manifest. The manifest is the commit: only archives that Spark's own commit of it lists are read, so what a lost or
repeated attempt left behind is never seen. The reader walks the frames, loads the dictionary, decodes one frame per
record and validates every header, length and digest.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, spread_join, staged

# Fixed values of the Zstandard and WARC formats.
FRAME_MAGIC, DICT_MAGIC, SKIPPABLE_MAGIC = 0xFD2FB528, 0xEC30A437, 0x184D2A5D
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT_BYTES = 100
#: An archive is closed after so many compressed bytes.
ARCHIVE_BYTES = 32 << 20
#: An archive's dictionary is trained on its first records, up to so many bytes; it has at most DICT_BYTES.
SAMPLE_BYTES, DICT_BYTES, LEAST_SAMPLES = 1 << 20, 32 << 10, 32
#: Revisits are joined by broadcast up to so many rows of at most 100 bytes, and by a shuffle beyond.
BROADCAST_ROWS = 100_000
FLUSH_BYTES = 8 << 20


class WarcError(ValueError):
    """An archive that breaks the format, with its place."""


# Frames


def frame_end(data: memoryview, at: int) -> int:
    """Offset after the Zstandard frame (or skippable frame) that starts at `at`."""

    def take(offset: int, n: int) -> int:
        if offset + n > len(data):
            raise WarcError(f"truncated frame at {at}")
        return int.from_bytes(data[offset : offset + n], "little")

    magic = take(at, 4)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + take(at + 4, 4)
        if end > len(data):
            raise WarcError(f"truncated frame at {at}")
        return end
    if magic != FRAME_MAGIC:
        raise WarcError(f"no Zstandard frame at {at}")
    flags = take(at + 4, 1)
    single = flags >> 5 & 1
    size_bytes = (single, 2, 4, 8)[flags >> 6]
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + size_bytes
    last = 0
    while not last:
        block = take(pos, 3)
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise WarcError(f"reserved block at {pos}")
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise WarcError(f"truncated frame at {at}")
    return pos


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame that carries a dictionary, itself compressed."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed


def leading_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive, plain or compressed, and where the records begin."""
    if len(data) < 8 or int.from_bytes(data[:4], "little") != SKIPPABLE_MAGIC:
        return None, 0
    end = frame_end(data, 0)
    body = bytes(data[8:end])
    magic = int.from_bytes(body[:4], "little")
    if magic == FRAME_MAGIC:
        try:
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=64 << 20)
        except zstandard.ZstdError as e:
            raise WarcError(f"dictionary: {e}") from e
    elif magic != DICT_MAGIC:
        raise WarcError("the leading skippable frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body), end


# Records


def header_value(text: str) -> str:
    """text without what would break a header line: control characters and white space are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def page_urn(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"urn:x-page:(-?\d+)", urn or "")
    return int(m[1]) if m else None


def record_bytes(kind: str, record_id: str, date: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """A response with the payload, or a revisit of page `first` with the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Target-URI", header_value(url or "") or page_urn(page_id)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}")]
    if first is None:
        return record_bytes("response", page_urn(page_id), date, http + payload, fields)
    return record_bytes("revisit", page_urn(page_id), date, http, [*fields, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{page_urn(first)}>")])


_FIELD = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*([^\r\n]*)")


def header_fields(lines: list[bytes], where: str) -> dict[str, str]:
    """Names in lower case; a line that is no field, or a field given twice, is an error."""
    out: dict[str, str] = {}
    for line in lines:
        m = _FIELD.fullmatch(line)
        name = m[1].decode().lower() if m else None
        if name is None or name in out:
            raise WarcError(f"{where}: header line {line[:80]!r}")
        out[name] = m[2].rstrip(b" \t").decode("utf-8", "replace")
    return out


def parse_record(record: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the one record that a frame holds."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError(f"{where}: no end of the header")
    version, *lines = record[:end].split(b"\r\n")
    if version not in VERSIONS:
        raise WarcError(f"{where}: version {version[:20]!r}")
    head = header_fields(lines, where)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise WarcError(f"{where}: no {name}")
    if not head["content-length"].isascii() or not head["content-length"].isdigit():
        raise WarcError(f"{where}: content-length {head['content-length']!r}")
    length, start = int(head["content-length"]), end + 4
    if len(record) != start + length + 4 or record[start + length :] != b"\r\n\r\n":
        raise WarcError(f"{where}: content-length {length}, but the record has {len(record) - start - 4} bytes")
    block = record[start : start + length]
    digest = head.get("warc-block-digest")
    if digest is not None and digest != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError(f"{where}: block digest")
    return head, block


def payload_of(head: dict[str, str], block: bytes, where: str) -> tuple[int, str, bytes | None]:
    """Bytes and digest of the full payload, and the payload itself where the record carries it."""
    end = block.find(b"\r\n\r\n")
    if end < 0 or not block.startswith(b"HTTP/"):
        raise WarcError(f"{where}: no HTTP header")
    http = header_fields(block[:end].split(b"\r\n")[1:], where)
    length = http.get("content-length", "")
    digest = head.get("warc-payload-digest", "")
    if not (length.isascii() and length.isdigit()) or not re.fullmatch(r"sha256:[0-9a-f]{64}", digest):
        raise WarcError(f"{where}: payload length {length!r}, digest {digest[:80]!r}")
    body = block[end + 4 :]
    if head["warc-type"] == "revisit":
        if body or "warc-refers-to" not in head or head.get("warc-profile") != IDENTICAL:
            raise WarcError(f"{where}: not a revisit of an identical payload")
        return int(length), digest[7:], None
    if len(body) != int(length) or hashlib.sha256(body).hexdigest() != digest[7:]:
        raise WarcError(f"{where}: the payload does not have its length and digest")
    return len(body), digest[7:], body


def archive_records(data: bytes, name: str) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(place, header fields, block) of every record of an archive."""
    view = memoryview(data)
    dictionary, at = leading_dictionary(view)
    decoder = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {}))
    while at < len(view):
        where, end = f"{name}@{at}", frame_end(view, at)
        if int.from_bytes(view[at : at + 4], "little") == FRAME_MAGIC:  # other skippable frames are passed over
            frame = view[at:end]
            size = zstandard.frame_content_size(frame)
            if size < 0:
                raise WarcError(f"{where}: a frame without its size")
            try:
                record = decoder.decompress(frame) if size else b""
            except zstandard.ZstdError as e:
                raise WarcError(f"{where}: {e}") from e
            yield where, *parse_record(record, where)
        at = end


class ArchiveWriter:
    """Writes records into one archive after another; finished() gives (path, records, bytes) of each."""

    def __init__(self, folder: str, date: str, limit: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.date, self.limit = date, limit
        self.done: list[tuple[str, int, int]] = []
        self._reset()

    def _reset(self) -> None:
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.records = self.bytes = 0
        self.out = self.coder = None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self._open()
            return
        self._put(record)
        if self.bytes >= self.limit:
            self.close()

    def _put(self, record: bytes) -> None:
        frame = self.coder.compress(record)
        self.out.write(frame)
        self.records += 1
        self.bytes += len(frame)

    def _open(self) -> None:
        """Train the dictionary on the records that wait, then write it and them."""
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.store.open_output_stream(self.path, compression=None)  # by default .zst would be compressed again
        dictionary = None
        if len(self.waiting) >= LEAST_SAMPLES:
            try:
                dictionary = zstandard.train_dictionary(min(DICT_BYTES, self.waiting_bytes // 8), [r[:DICT_BYTES] for r in self.waiting], k=256, d=8)
            except zstandard.ZstdError:
                pass  # too little in common: this archive has no dictionary
        if dictionary is not None:
            frame = dictionary_frame(dictionary.as_bytes())
            self.out.write(frame)
            self.bytes += len(frame)
        self.coder = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **({"dict_data": dictionary} if dictionary else {}))
        info = b"software: panelspark\r\nformat: WARC File Format 1.1\r\n"
        self._put(record_bytes("warcinfo", f"urn:uuid:{uuid.uuid4()}", self.date, info, [("Content-Type", "application/warc-fields")]))
        self.records = 0
        waiting, self.waiting = self.waiting, []
        for record in waiting:
            self._put(record)

    def close(self) -> None:
        if self.out is None and self.waiting:
            self._open()
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.bytes))
        self._reset()

    def finished(self) -> list[tuple[str, int, int]]:
        done, self.done = self.done, []
        return done


# Spark jobs


def with_firsts(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html and `first`: the smallest page_id with an equal payload, if that is another page's.

    Only payloads that occur more than once go on from the counting, by digest. Few of them are broadcast; beyond
    broadcast_rows the pages meet their decisions by page_id, so that copies of one payload stay apart.
    """
    digest = F.unhex(F.sha2(F.col("html").cast("binary"), 256))
    rows = pages.withColumn("sha", digest)
    large = rows.where(F.octet_length("html") >= LEAST_REVISIT_BYTES)
    per = large.groupBy("sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("n")).where("n > 1 AND _first IS NOT NULL")
    firsts = staged(per)
    other = ~F.col("page_id").eqNullSafe(F.col("_first"))
    if firsts.count() <= broadcast_rows:
        return rows.join(F.broadcast(firsts.drop("n")), "sha", "left").select("page_id", "url", "html", F.when(other, F.col("_first")).alias("first"))
    narrow = staged(large.select("page_id", "sha"))
    total = narrow.count()
    met = spread_join(narrow, firsts, "sha", total)
    decided = met.where(other).groupBy("page_id", "sha").agg(F.min("_first").alias("first"))
    # A null page_id is spread by its payload; two rows of one page_id may have different payloads.
    salt = F.when(F.col("page_id").isNull(), F.xxhash64("sha", "url")).otherwise(0)
    named = rows.withColumn("salt", salt).join(decided.where("page_id IS NOT NULL").withColumn("salt", F.lit(0).cast("long")), ["page_id", "sha", "salt"], "left").select("page_id", "url", "html", "sha", "first")
    unnamed = named.where("page_id IS NULL").drop("first")
    few = firsts.where(F.col("n") * 1000 > total).drop("n")  # under 1000 rows
    copies = unnamed.join(F.broadcast(few.withColumnRenamed("_first", "_few")), "sha", "left").join(firsts.drop("n"), ["sha"], "left")
    return named.where("page_id IS NOT NULL").select("page_id", "url", "html", "first").unionByName(copies.select("page_id", "url", "html", F.coalesce("_few", "_first").alias("first")))


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of with_firsts() into archives under folder, and return the manifest: path, records, bytes.

    The manifest is lazy; each evaluation writes its own archives, so stage it before reading.
    """
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, date, archive_bytes)
        for batch in batches:
            for page, url, html, first in zip(batch["page_id"], batch["url"], batch["html"], batch["first"], strict=True):
                writer.add(page_record(page.as_py(), url.as_py(), html.as_py(), first.as_py(), date))
        writer.close()
        done = writer.finished()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"), F.col("first").cast("long").alias("first"))
    return rows.mapInArrow(run, "path string, records long, bytes long")


READ_SCHEMA = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per response or revisit record of the archives in manifest (path, records); other types are passed over.

    Raises WarcError for an archive that breaks the format or has another number of records than the manifest says.
    payload is null for revisits, and everywhere without `payloads`; lengths and digests are validated all the same.
    """
    schema = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, wanted in zip(batch["path"].to_pylist(), batch["records"].to_pylist(), strict=True):
                with store.open_input_stream(path, compression=None) as stream:
                    data = stream.read()
                rows, size, found = [], 0, 0
                for where, head, block in archive_records(data, path):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    found += 1
                    n, digest, body = payload_of(head, block, where)
                    body = body if payloads else None
                    rows.append((page_of(head["warc-record-id"][1:-1]), head.get("warc-target-uri"), head["warc-type"], page_of(head.get("warc-refers-to", "")[1:-1]), n, digest, body))
                    size += 256 + len(body or b"")
                    if size >= FLUSH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if wanted is not None and found != wanted:
                    raise WarcError(f"{path}: {found} records, not {wanted}")
                if rows:
                    yield batch_of(rows)

    width = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path", F.col("records").cast("long").alias("records")).repartition(max(width, 4 * width), "path").mapInArrow(run, READ_SCHEMA)


def archive_pages(pages: DataFrame, payloads: bool = False, broadcast_rows: int = BROADCAST_ROWS, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages into archives in the shared checkpoint folder and read them back.

    A null html is an empty payload, and payloads under 100 bytes are always responses. Of equal payloads the record of
    the smallest page_id is the response (all rows that repeat that page_id are); the others revisit it. A page without
    page_id is never referred to: it revisits another page of equal payload, and else is a response. A null or empty url
    becomes the record's own URN. No pages give no archive and no rows; other columns are ignored.
    """
    text: Column = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    base = checkpoint_dir(pages.sparkSession)
    folder = f"{base if '://' in base else base.replace('file:', 'file://', 1) if base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    manifest = staged(write_archives(with_firsts(rows, broadcast_rows), folder, archive_bytes=archive_bytes))
    return read_archives(manifest, folder, payloads)
