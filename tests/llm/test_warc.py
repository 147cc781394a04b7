import io
import struct

import pytest
import zstandard

from riskledger.llm import registry, warc
from tests_llm_rows import prose

PAGES = [
    (5, "http://a/x y\n z", "<p>same</p>"),
    (3, "http://b", "<p>same</p>"),
    (4, None, "<p>same</p>"),
    (8, "http://c", None),
    (7, "http://d", ""),
    (7, "http://d", ""),
    (None, "http://e", "<p>same</p>"),
    (None, "http://f", "alone \r\n\r\n WARC/1.1"),
    (1, "http://g", "ünï \U0001f600" + prose(1, 40000)),
]


def expected(rows):
    import base64
    import hashlib

    first, out = {}, []
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, url, html in rows:
        data = (html or "").encode()
        f = first.get(html or "")
        again = f is not None and f != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((str(i), str(None if url is None else " ".join(url.split())), len(data), digest, "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def found(frame):
    return sorted(((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str)


def test_query(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert found(registry.QUERIES["op9_warc"](spark, sf)) == expected(rows)


@pytest.mark.parametrize("archive", [1, 10_000, warc.ARCHIVE_BYTES])
def test_edge_rows(spark, tmp_path, archive):
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id bigint, url string, html string, digest string").repartition(2)
    archives = warc.write_archives(warc.classify(pages), str(tmp_path), archive)
    assert sum(r.records for r in archives.collect()) == len(PAGES)
    records = warc.read_archives(archives, str(tmp_path), with_payload=True)
    assert found(records) == expected(PAGES)
    payloads = {r.page_id: bytes(r.payload).decode() for r in records.collect() if r.record_type == "response" and r.page_id is not None}
    assert payloads == {3: "<p>same</p>", 7: "", 1: PAGES[-1][2]}
    assert warc.archive_and_read(pages.where("false")).count() == 0


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    assert {r.record_type for r in warc.archive_and_read(pages, least=1000).collect()} == {"response"}


def archive(records):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.close()
    return out.getvalue()


RECORDS = [warc.make_record(i, f"http://x/{i}", (p := prose(i, 200).encode()), warc.payload_digest(p), None) for i in range(400)]


def test_format():
    data = archive(RECORDS)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    trained = zstandard.decompress(data[8 : 8 + size])
    assert trained[:4] == struct.pack("<I", 0xEC30A437)
    whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    with whole.stream_reader(data[8 + size :], read_across_frames=True) as frames:
        assert frames.read() == b"".join(RECORDS)
    one = whole.decompressobj()
    assert one.decompress(data[8 + size :]) == RECORDS[0] and one.unused_data  # a frame is a record
    for chunk in (1 << 20, 7):
        assert list(warc.read_archive(io.BytesIO(data), chunk)) == RECORDS


def test_dictionaries_and_other_frames():
    plain = zstandard.ZstdCompressor()
    lead = struct.pack("<II", 0x184D2A5D, 0)
    skip = struct.pack("<II", 0x184D2A51, 5) + b"other"
    data = lead + skip + plain.compress(RECORDS[0]) + skip + plain.compress(RECORDS[1])
    assert list(warc.read_archive(io.BytesIO(data), 3)) == RECORDS[:2]
    assert list(warc.read_archive(io.BytesIO(archive([])))) == []
    assert list(warc.read_archive(io.BytesIO(archive(RECORDS[:1])))) == RECORDS[:1]
    trained = zstandard.train_dictionary(4096, [r[:2000] for r in RECORDS])
    own = zstandard.ZstdCompressor(dict_data=trained)
    raw = trained.as_bytes()  # the dictionary itself need not be compressed
    data = struct.pack("<II", 0x184D2A5D, len(raw)) + raw + own.compress(RECORDS[3])
    assert list(warc.read_archive(io.BytesIO(data))) == [RECORDS[3]]


@pytest.mark.parametrize(
    "data",
    [b"", b"\x00" * 20, struct.pack("<II", 0x184D2A5D, 100) + b"short", struct.pack("<II", 0x184D2A5D, 4) + b"what", archive(RECORDS[:3])[:-1], archive(RECORDS[:3]) + b"tail", archive(RECORDS[:3]) + struct.pack("<II", 0x184D2A50, 9) + b"cut"],
)
def test_damaged_archives(data):
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(io.BytesIO(data)))


def test_every_flipped_byte_of_the_frames_is_noticed():
    data = bytearray(archive(RECORDS[:2]))
    start = 8 + struct.unpack("<I", data[4:8])[0]
    for at in range(start, len(data), 17):
        bad = bytes(data[:at]) + bytes([data[at] ^ 0x55]) + bytes(data[at + 1 :])
        with pytest.raises((warc.BadArchive, zstandard.ZstdError)):
            assert [warc.parse_record(r) for r in warc.read_archive(io.BytesIO(bad))] != [warc.parse_record(r) for r in RECORDS[:2]]
            raise warc.BadArchive("read, but not as the same records")


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"\r\n\r\n", b"\r\n"), (b"WARC-Date", b"WARC-Dote"), (b"WARC-Type: response", b"WARC-Type: strange"), (b"sha1:", b"sha1:A"), (b"Content-Type", b"Content Type no colon \r\nX"), (b"the", b"eth")],
)
def test_records_that_break_the_format(old, new):
    assert warc.parse_record(RECORDS[5])["payload"] == prose(5, 200).encode()
    with pytest.raises(warc.BadArchive):
        warc.parse_record(RECORDS[5].replace(old, new, 1))
    with pytest.raises(warc.BadArchive):
        warc.parse_record(RECORDS[5] + b"x")


def test_missing_records_are_noticed(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(1)
    archives = warc.write_archives(warc.classify(pages), str(tmp_path))
    with pytest.raises(Exception, match="records instead of"):
        warc.read_archives(archives.withColumn("records", F.col("records") + 1), str(tmp_path)).collect()
