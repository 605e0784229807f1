"""WARC archives in Zstandard: a dictionary in a leading skippable frame, one frame per record.

Writing: pages are dealt to archives by a hash of the id and sorted by it. Of pages with equal
payloads the one with the smallest id is a response, the others are revisits that name it and
hold HTTP headers only. An archive is written under a name of its own attempt, then renamed, so a
task that runs again replaces what it wrote before with the same bytes.

Reading: the dictionary is taken from the skippable frame (packed or plain, or absent), each
frame is decoded alone, and headers, lengths and digests are checked. A record that fails gives
a row with ``problem``; the frames after it are still read.

Defined results: a null html is an empty payload; a null url is left out; signs that would break
a header line are percent-encoded. Payloads below ``least_bytes`` are all responses. Rows that
share the smallest id of a payload are responses each; a null id never is an original that
others name, and is a response where no row with its payload has an id. An empty table gives no
archives, and reading none gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtrace.llm.textblocks import bounded_batches
from voxtrace.session import stage, staging_path

FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained on at most so many pages of at most so many characters.
SAMPLE_PAGES, SAMPLE_CHARS = 256, 20_000
DICTIONARY_BYTES = 32 << 10
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Pages of an archive, about.
ARCHIVE_PAGES = 4096


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; empty if they are too few to train on."""
    some = pages.where((F.length("html") > 0) & (F.length("html") <= SAMPLE_CHARS))
    some = some.select("html", F.xxhash64("page_id", "html").alias("turn"))
    # their hashes first, so that tasks hand on numbers instead of pages
    turns = [r["turn"] for r in some.select("turn").distinct().orderBy("turn").limit(SAMPLE_PAGES).collect()]
    few = some.where(F.col("turn") <= turns[-1]).dropDuplicates(["turn"]) if turns else some.limit(0)
    samples = [r["html"].encode() for r in few.orderBy("turn").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed if dictionary else b""


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None
) -> bytes:
    """One WARC/1.1 record; ``refers_to`` makes it a revisit."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _line(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "WARC-Profile": PROFILE if revisit else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _local(folder: str) -> str:
    """The folder as the executors' file system names it."""
    parsed = urlparse(folder)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"archives are written to a shared file system, not to {parsed.scheme}:")
    return parsed.path


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder``; one row (archive, records, bytes) for
    each archive. The folder is shared by all executors."""
    where = _local(folder)
    pages = bounded_batches(pages).select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    dictionary = train_dictionary(pages)
    marked = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("bytes"))
    equal = marked.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(
        F.min("page_id").alias("refers_to"), F.count("*").alias("copies")
    )
    revisits = stage(
        marked.join(equal.where("copies > 1"), ["digest", "bytes"])
        .where("page_id <> refers_to or (page_id is null and refers_to is not null)")
        .select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "refers_to")
        .distinct(),
        "warc_revisits",
    )
    archives = max(1, -(-pages.count() // ARCHIVE_PAGES))
    typed = pages.withColumn("digest", F.sha1("html")).join(
        revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left"
    )
    dealt = (
        typed.select("page_id", "url", "html", "digest", "refers_to")
        .repartition(archives, F.xxhash64("page_id", "digest"))
        .sortWithinPartitions("page_id", "digest", "url")
        .withColumn("part", F.spark_partition_id())
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(where, exist_ok=True)
        packer = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True
        )
        done: list[tuple[str, int, int]] = []
        out, temporary, raw, records, part = None, "", 0, 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                size = out.tell()
                out.close()
                name = f"pages-{part:06d}-{len(done):04d}.warc.zst"
                os.replace(temporary, os.path.join(where, name))
                done.append((name, records, size))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is not None and raw >= ARCHIVE_BYTES:
                    close()
                if out is None:
                    part, raw, records = row["part"], 0, 0
                    temporary = os.path.join(where, f"_{uuid.uuid4().hex}.part")
                    out = open(temporary, "wb")  # noqa: SIM115
                    out.write(leading_frame(dictionary))
                payload = row["html"].encode()
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                record = record_bytes(row["page_id"], row["url"], payload, digest, row["refers_to"])
                out.write(packer.compress(record))
                raw, records = raw + len(record), records + 1
        close()
        yield pa.RecordBatch.from_pydict(
            {
                "archive": pa.array([d[0] for d in done], pa.string()),
                "records": pa.array([d[1] for d in done], pa.int64()),
                "bytes": pa.array([d[2] for d in done], pa.int64()),
            }
        )

    return stage(dealt.mapInArrow(write, "archive string, records long, bytes long"), "warc_manifest")


def frames(content: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record bytes, problem) of each frame of an archive."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            yield 0, None, "the dictionary frame is cut off"
            return
        packed = bytes(content[8 : 8 + size])
        if packed[:4] == struct.pack("<I", FRAME):
            packed = zstandard.ZstdDecompressor().decompress(packed)
        dictionary = zstandard.ZstdCompressionDict(packed)
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(content):
        begin = at
        one = reader.decompressobj()
        parts: list[bytes] = []
        try:
            while at < len(content) and not one.eof:
                piece = content[at : at + (256 << 10)]
                parts.append(one.decompress(piece))
                at += len(piece)
        except zstandard.ZstdError as error:
            yield begin, None, f"bad frame: {error}"
            return  # without a frame's length the next one can't be found
        at -= len(one.unused_data)
        if not one.eof:
            yield begin, None, "the last frame is cut off"
            return
        yield begin, b"".join(parts), None


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Headers (names lower-cased), block and the first fault found."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        return {}, b"", "no WARC header"
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            return headers, b"", "a header line without a name"
        headers[name.strip().lower()] = value.strip()
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if n not in headers]
    if missing:
        return headers, b"", f"no {missing[0]}"
    if not headers["content-length"].isdigit():
        return headers, b"", "content-length is no number"
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        return headers, rest[:size], "content-length and block differ"
    return headers, rest[:size], None


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of all archives in ``folder``: archive, frame (offset), page_id, url,
    record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits), problem."""
    schema = (
        "archive string, frame long, page_id long, url string, record_type string, refers_to long, "
        "payload_bytes long, payload_digest string, payload binary, problem string"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def row_of(archive: str, at: int, record: bytes | None, problem: str | None) -> tuple:
        if record is None:
            return (archive, at, *[None] * 7, problem)
        headers, block, problem = parse_record(record)
        kind = headers.get("warc-type")
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        http, gap, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
        size = int(length[1]) if length else None
        if not problem and (not gap or size is None):
            problem = "no HTTP header with a length"
        if not problem and kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
            problem = "payload and its length or digest differ"
        if not problem and kind == "revisit" and (payload or not headers.get("warc-refers-to")):
            problem = "a revisit with a payload, or without its original"
        return (
            archive, at, _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), kind,
            _page(headers.get("warc-refers-to")), size, digest, payload if kind == "response" else None, problem,
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for frame in frames(memoryview(content.as_buffer())):
                    rows.append(row_of(path.as_py().rpartition("/")[2], *frame))
                    held += len(rows[-1][8] or b"")
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = (
        spark.read.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.warc.zst")
        .load(folder)
        .select("path", "content")
    )
    return files.mapInArrow(read, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives to a new folder of the session's shared storage and read them back."""
    spark = pages.sparkSession
    folder = staging_path(spark, "warc")
    written = write_archives(pages, folder, least_bytes)
    if written.isEmpty():
        os.makedirs(_local(folder), exist_ok=True)
    return read_archives(spark, folder)
