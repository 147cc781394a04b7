"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

Writing: records are dealt to tasks, each task writes whole archives under names of its own attempt
and tells what it wrote; the table of finished archives decides what exists, so a repeated task
leaves at most files that nobody reads. Reading: archives are dealt to tasks; a task loads the
dictionary, decodes one frame at a time, and checks the header and every length and digest.

Folders are URIs for Spark and for Arrow's file systems (file, hdfs, s3, gs, ...).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm.frames import checkpointed, scratch

#: The skippable frame that holds the dictionary, the frame and dictionary magics.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
DICTIONARY = 0xEC30A437
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 32 << 20  # of payload in one archive
SAMPLES = 256  # records from the front of an archive that its dictionary is trained on
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if number == "null" else int(number)


def _header_text(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record. ``refers_to``: None for a response, else a tuple with the response's page."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _header_text(url)))
    if refers_to:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to[0]))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or nothing if there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to a file; the dictionary is trained on the first ones."""

    def __init__(self, out):
        self.out, self.waiting, self.compress, self.payload, self.records, self.written = out, [], None, 0, 0, 0

    def add(self, record: bytes) -> None:
        self.payload += len(record)
        self.records += 1
        if self.compress:
            self._put(self.compress(record))
            return
        self.waiting.append(record)
        if len(self.waiting) >= SAMPLES:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _start(self) -> None:
        trained = _dictionary([r[:SAMPLE_BYTES] for r in self.waiting])
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        chosen = zstandard.ZstdCompressionDict(trained) if trained else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=chosen, write_content_size=True, write_checksum=True).compress
        for record in self.waiting:
            self._put(self.compress(record))
        self.waiting = []

    def close(self) -> None:
        if not self.compress:
            self._start()


class BadArchive(ValueError):
    """An archive, frame or record that breaks the format."""


def read_archive(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame each; holds one record and one chunk at a time."""
    data = source.read(8)
    if len(data) < 8:
        raise BadArchive("no leading frame")
    magic, size = struct.unpack("<II", data)
    if magic != DICTIONARY_FRAME:
        raise BadArchive("the first frame is not a dictionary frame")
    packed = source.read(size)
    if len(packed) != size:
        raise BadArchive("dictionary frame cut short")
    if packed[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
        packed = zstandard.ZstdDecompressor().decompressobj().decompress(packed)
    elif packed and packed[:4] != struct.pack("<I", DICTIONARY):
        raise BadArchive("unknown dictionary")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packed) if packed else None)
    data = b""
    while True:
        while len(data) < 8 and (more := source.read(chunk)):
            data += more
        if not data:
            return
        if len(data) >= 8 and struct.unpack("<I", data[:4])[0] in SKIPPABLE:
            skip = 8 + struct.unpack("<I", data[4:8])[0]
            while len(data) < skip and (more := source.read(chunk)):
                data += more
            if len(data) < skip:
                raise BadArchive("skippable frame cut short")
            data = data[skip:]
            continue
        frame, parts = unpacker.decompressobj(), []
        try:
            parts.append(frame.decompress(data))
            while not frame.eof:
                more = source.read(chunk)
                if not more:
                    raise BadArchive("frame cut short")
                parts.append(frame.decompress(more))
        except zstandard.ZstdError as e:
            raise BadArchive(str(e)) from e
        data = frame.unused_data
        yield b"".join(parts)


def parse_record(record: bytes) -> dict[str, str | bytes | int]:
    """Header fields (lower case), block and HTTP lengths of a record whose format was checked."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadArchive("no WARC header")
    fields: dict = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"bad header line: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    if not fields["content-length"].isdigit():
        raise BadArchive("bad Content-Length")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive("Content-Length does not match the record")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise BadArchive("block digest does not match")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not gap or length is None:
        raise BadArchive("no HTTP header")
    if fields["warc-type"] == "response":
        if len(payload) != length or fields.get("warc-payload-digest") != f"sha1:{payload_digest(payload)}":
            raise BadArchive("payload does not match its length or digest")
    elif fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields:
        raise BadArchive("neither a response nor a revisit")
    return fields | {"payload": payload, "payload_bytes": length}


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if urlsplit(folder).scheme else f"file://{folder}")


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses).

    Of payloads that are equal and of ``least`` bytes or more, the smallest id is the response. Rows
    of that id are all responses; a null id is one only if the payload has no other.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "size": F.octet_length("html")})
    first = rows.groupBy("sha1", "size").agg(F.min("page_id").alias("first")).select(F.col("sha1").alias("first_sha1"), F.col("size").alias("first_size"), "first")
    joined = rows.join(first, (F.col("sha1") == F.col("first_sha1")) & (F.col("size") == F.col("first_size")))
    again = (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "sha1", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(classified: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records and return the table of archives: path, records, bytes (stored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        task, done, writer, out, path = TaskContext.get(), [], None, None, ""

        def finish() -> None:
            nonlocal writer
            if writer:
                writer.close()
                out.close()
                done.append((path, writer.records, writer.written))
                writer = None

        for batch in batches:
            for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    path = f"{root}/{task.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.zst"
                    out = files.open_output_stream(path)
                    writer = ArchiveWriter(out)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                writer.add(make_record(page_id, url, html, digest, None if refers_to is None else (refers_to,)))
                if writer.payload >= archive_bytes:
                    finish()
        finish()
        if done:
            paths, records, sizes = zip(*done, strict=True)
            yield pa.record_batch([pa.array(paths), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return checkpointed(classified.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(run, "path string, records bigint, bytes bigint"))


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records of a table of archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Fails on the first record that breaks the format, or if an archive lacks records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, found = [], 0
                with files.open_input_stream(path) as source:
                    for record in read_archive(source):
                        r = parse_record(record)
                        found += 1
                        target = _page_of(r["warc-refers-to"]) if r["warc-type"] == "revisit" else None
                        row = (_page_of(r["warc-record-id"]), r.get("warc-target-uri"), r["payload_bytes"], r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], target)
                        rows.append(row + (r["payload"],) * with_payload)
                        if len(rows) >= 1000:
                            yield table(rows)
                            rows = []
                if found != expected:
                    raise BadArchive(f"{path}: {found} records instead of {expected}")
                if rows:
                    yield table(rows)

    # one archive per task: they are the unit of work
    tasks = max(1, archives.count())
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    return archives.select("path", "records").repartition(min(tasks, 100_000)).mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per page to ``folder`` and read the archives back.

    A null page is an empty payload; a null url reads back as null and white space in a url as single
    spaces; repeated rows are repeated records; an empty table writes nothing; other columns are not
    read. ``id_col`` must be an integer column.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    archives = write_archives(classify(pages, id_col, url_col, html_col, least), folder)
    return read_archives(archives, folder)
