"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

The writer stores each distinct payload once, as a response; every other record with that payload is
a revisit that names the response. The reader loads the dictionary, decodes frame by frame, and
checks every header and length before it gives a record out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.exact_dedup import MAYBE, cell_bitmaps, filter_bits, with_maybe
from noticelake.llm.shared import pages, salted_join, shared_dir, stored, write_file

# Fixed values of the file formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: A task starts a new archive after this many bytes of payload.
ARCHIVE_BYTES = 32_000_000
DICTIONARY_BYTES, DICTIONARY_SAMPLES = 16_384, 256
#: High half of the record numbers, so that a page id can be read back from its record's name; that of pages without an
#: id, whose low half is random.
ID_SPACE, NO_ID_SPACE = 0x6E6F74696365_4C41 << 64, 0x6E6F74696365_4C4E << 64


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def record_name(page_id: int | None) -> str:
    space, low = (NO_ID_SPACE, uuid.uuid4().int) if page_id is None else (ID_SPACE, page_id)
    return f"<urn:uuid:{uuid.UUID(int=space | (low & (1 << 64) - 1))}>"


def page_of(name: str) -> int | None:
    try:
        number = uuid.UUID(name.removeprefix("<urn:uuid:").removesuffix(">")).int
    except ValueError:
        raise ArchiveError(f"bad record name {name}") from None
    low = number & (1 << 64) - 1
    if number - low == NO_ID_SPACE:
        return None
    if number - low != ID_SPACE:
        raise ArchiveError(f"foreign record name {name}")
    return low - (1 << 64) if low >> 63 else low


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str | None) -> str:
    """A header value: line ends and other control characters are percent-encoded."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "about:blank")


def to_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of one record; with ``refers_to`` it is a revisit and holds no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_name(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def to_archive(records: list[bytes]) -> bytes:
    """A whole archive; the dictionary is trained on its own first records."""
    samples = [r[:DICTIONARY_BYTES] for r in records[:DICTIONARY_SAMPLES]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small samples
        trained = None
    compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    stored_dict = trained.as_bytes() if trained else b""
    return b"".join(
        [struct.pack("<II", DICTIONARY_FRAME, len(stored_dict)), stored_dict, *map(compressor.compress, records)]
    )


def frame_end(data: memoryview, start: int) -> int:
    """Where the frame at ``start`` ends, from its block headers."""
    if len(data) - start < 6 or struct.unpack_from("<I", data, start)[0] != ZSTD_FRAME:
        raise ArchiveError(f"no frame at byte {start}")
    at = start + zstandard.frame_header_size(bytes(data[start : start + 18]))
    checksum = bool(data[start + 4] & 4)
    last = False
    while not last:
        if at + 3 > len(data):
            raise ArchiveError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        if kind == 3:
            raise ArchiveError("a frame has a reserved block type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ArchiveError("a frame is cut off")
    return at


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    data = memoryview(content)
    if len(data) < 8:
        raise ArchiveError("the archive is shorter than its dictionary frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME or 8 + size > len(data):
        raise ArchiveError("the archive does not begin with a dictionary frame")
    raw = bytes(data[8 : 8 + size])
    if raw[:4] == struct.pack("<I", ZSTD_FRAME):  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at = 8 + size
    while at < len(data):
        if data[at : at + 4] == struct.pack("<I", ZSTD_FRAME):
            end = frame_end(data, at)
            yield decompressor.decompressobj().decompress(data[at:end])
        elif int.from_bytes(data[at : at + 4], "little") & 0xFFFFFFF0 == 0x184D2A50 and at + 8 <= len(data):
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            if end > len(data):
                raise ArchiveError("a skippable frame is cut off")
        else:
            raise ArchiveError(f"no frame at byte {at}")
        at = end


def headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name.strip() != name:
            raise ArchiveError(f"bad header line {line!r}")
        if name.lower() in out:
            raise ArchiveError(f"header {name} occurs twice")
        out[name.lower()] = value.strip()
    return out


def whole_number(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise ArchiveError(f"bad length {text!r}")
    return int(text)


def read_record(frame: bytes) -> tuple[int | None, str, str, int | None, int, str, bytes | None]:
    """page_id, url, type, refers_to, payload length, payload digest, payload (None in a revisit)."""
    head, gap, rest = frame.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ArchiveError("a record has no version line or no end of its headers")
    named = headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in named:
            raise ArchiveError(f"a record has no {name}")
    length = whole_number(named["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError("a record is not as long as its Content-Length says")
    block = rest[:length]
    if named.get("warc-block-digest", f"sha1:{digest32(block)}") != f"sha1:{digest32(block)}":
        raise ArchiveError("a block differs from its digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ArchiveError("a block is no HTTP response")
    size = whole_number(headers(http.split(b"\r\n")[1:]).get("content-length", ""))
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    page_id, kind = page_of(named["warc-record-id"]), named["warc-type"]
    url = named.get("warc-target-uri", "")
    if kind == "response":
        if size != len(payload) or digest != digest32(payload):
            raise ArchiveError("a payload differs from its length or digest")
        return page_id, url, kind, None, size, digest, payload
    if kind != "revisit" or payload or named.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in named:
        raise ArchiveError(f"a record of type {kind} is not as it should be")
    return page_id, url, kind, page_of(named["warc-refers-to"]), size, digest, None


def with_reference(rows: DataFrame, min_bytes: int) -> DataFrame:
    """``rows`` with refers_to: the largest page id of an equal payload, null for a row with that id itself.

    Ids and digests alone are grouped. A Bloom filter of the digests that occur more than once lets all other payloads pass where they
    are; only those that may be repeated move, to meet their own row of references, which has each page id and digest once.
    """
    own = F.when(F.octet_length("html") >= min_bytes, F.sha1("html"))
    slim = stored(rows.select("page_id", own.alias("digest")).filter("digest IS NOT NULL"), "page-digests")
    groups = stored(slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "payloads")
    again = salted_join(slim, groups.select("digest", "refers_to"), "digest", groups.select("digest", "n"))
    revisits = again.filter("refers_to IS NOT NULL AND NOT page_id <=> refers_to").distinct()
    revisits = revisits.select(F.col("page_id").alias("__nl_page"), F.col("digest").alias("__nl_digest"), "refers_to")
    bits = filter_bits(groups.count())
    repeated = stored(cell_bitmaps(groups, bits, "digest", 1), "repeated")
    flagged = with_maybe(rows.withColumn("digest", own), repeated, bits, "digest")
    columns = ["page_id", "url", "html", "refers_to"]
    alone = flagged.filter(~F.col(MAYBE)).withColumn("refers_to", F.lit(None).cast("long"))
    same = F.col("page_id").eqNullSafe(F.col("__nl_page")) & (F.col("digest") == F.col("__nl_digest"))
    return alone.select(*columns).unionByName(flagged.filter(MAYBE).join(revisits, same, "left").select(*columns))


def write_archives(
    rows: DataFrame,
    folder: str,
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record for each row of page_id, url, html and returns the list of archives.

    A null html is an empty payload and a null url about:blank. Of equal payloads of at least ``min_bytes``
    bytes, the one with the largest page id is the response; rows that repeat that id are responses too. A null
    page id is smaller than all others: such a row gets a record of its own name, is read back with a null id, and
    revisits a page that has an id; without one it is a response. Rows may repeat an id with other payloads. An
    empty table gives no archives; other columns are not read. A task that is run again writes other names; only those in the list count.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held, size, names = [], 0, []

        def flush() -> None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            write_file(folder, name, to_archive(held))
            names.append((name, len(held)))

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(4))
            for page_id, url, html, refers_to in zip(*columns, strict=True):
                payload = html.encode()
                held.append(to_record(page_id, url, payload, refers_to))
                size += len(payload)
                if size >= archive_bytes:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.int64())],
            ["name", "records"],
        )

    slim = rows.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return stored(with_reference(slim, min_bytes).mapInArrow(run, "name string, records long"), "archive-list")


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """One row per record of the listed archives, in the order of their frames."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for frame in frames(content.as_py()):
                    rows.append(read_record(frame))
                    size += len(frame)
                    if size >= 4_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    raw = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content"
    )
    return (
        raw.join(archives.select("name"), "name", "left_semi")
        .select("content")
        .mapInArrow(
            run,
            "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
            "payload_digest string, payload binary",
        )
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_dir(spark, "archives")
    archives = write_archives(pages(spark, sf_dir), folder)
    if archives.isEmpty():
        return spark.createDataFrame(
            [], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        )
    return read_archives(spark, folder, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
