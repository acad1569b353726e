"""WARC archives of one Zstandard frame per record, with their dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

#: Magic numbers of a frame, of the skippable frame that holds a dictionary, and of one that holds padding.
FRAME, DICTIONARY, PADDING = 0xFD2FB528, 0x184D2A5D, 0x184D2A50
#: Bytes of records, compressed, after which a new archive begins.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on this many pages, the first by hash of their id, and this much of each.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 8192, 64 << 10
#: Groups of equal payloads up to which their first members are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

SKELETON = (
    "WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\n"
    "{more}WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {length}\r\n\r\n"
)
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
REVISIT = "WARC-Refers-To: {first}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"


def record_id(page_id) -> str:
    return f"<urn:tessera:page:{'null' if page_id is None else page_id}>"


def _page_id(uri: str):
    found = uri.removeprefix("<urn:tessera:page:").removesuffix(">")
    return None if found == "null" else int(found)


def record(page_id, url: str | None, payload: bytes, digest: str, revisits: bool, first) -> bytes:
    """One record. A revisit holds the HTTP head alone, whose Content-Length is that of the full payload."""
    head = HTTP.format(length=len(payload)).encode()
    block = head if revisits else head + payload
    safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    more = REVISIT.format(first=record_id(first)) if revisits else ""
    top = SKELETON.format(kind="revisit" if revisits else "response", record=record_id(page_id), url=safe, more=more, digest=digest, length=len(block))
    return top.encode() + block + b"\r\n\r\n"


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from its headers alone."""
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == PADDING:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic != FRAME:
            raise ValueError(f"no Zstandard frame at byte {at}")
        else:
            flags = data[at + 4]
            single = flags >> 5 & 1
            end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
            last = False
            while not last:
                b = data[end] | data[end + 1] << 8 | data[end + 2] << 16
                last, kind = bool(b & 1), b >> 1 & 3
                if kind == 3:
                    raise ValueError(f"reserved block type at byte {end}")
                end += 3 + (1 if kind == 1 else b >> 3)
            end += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError):
        raise ValueError(f"the frame at byte {at} is cut off") from None
    if end > len(data):
        raise ValueError(f"the frame at byte {at} is cut off")
    return end


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive: its dictionary first, then one frame per record; padding frames are passed over."""
    view = memoryview(data)
    if len(view) < 8 or struct.unpack_from("<I", view)[0] != DICTIONARY:
        raise ValueError("the archive doesn't begin with a dictionary")
    at = frame_end(view, 0)
    words = bytes(view[8:at])
    if len(words) >= 4 and struct.unpack_from("<I", words)[0] == FRAME:
        words = zstandard.ZstdDecompressor().decompress(words)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    while at < len(view):
        end = frame_end(view, at)
        if struct.unpack_from("<I", view, at)[0] == FRAME:
            yield reader.decompress(view[at:end])
        at = end


def _fields(head: bytes, first: str) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith(first):
        raise ValueError(f"a head begins with {lines[0][:40]!r}")
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name.lower() in found:
            raise ValueError(f"a head has the line {line[:80]!r}")
        found[name.lower()] = value
    return found


def parse(raw: bytes) -> dict:
    """The fields of a record; raises ValueError where heads, lengths or the digest do not hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head, "WARC/1.1") if gap else {}
    missing = {"warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "content-length"} - set(warc)
    if missing:
        raise ValueError(f"a record lacks {sorted(missing)}")
    if len(rest) != int(warc["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{warc['warc-record-id']}: Content-Length {warc['content-length']}, but {len(rest) - 4} bytes")
    top, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    size = int(_fields(top, "HTTP/1.1")["content-length"]) if gap else -1
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    kind = warc["warc-type"]
    if kind == "response":
        if len(payload) != size:
            raise ValueError(f"{warc['warc-record-id']}: a payload of {len(payload)} bytes instead of {size}")
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{warc['warc-record-id']}: the payload doesn't match its digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in warc:
        raise ValueError(f"{warc['warc-record-id']}: no valid {kind}")
    return {
        "page_id": _page_id(warc["warc-record-id"]),
        "url": warc["warc-target-uri"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_id(warc["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; where that is too small to train on, sample texts themselves.

    The least hashes of page ids are found first, as numbers alone; then one text of each is read.
    """
    h = F.xxhash64("page_id")
    least = [r.h for r in pages.select(h.alias("h")).orderBy("h").limit(SAMPLE_PAGES).collect()]
    chosen = pages.where(h <= max(least, default=0)).groupBy(h.alias("h")).agg(F.min(F.left("html", F.lit(SAMPLE_CHARS))).alias("html"))
    texts = [r.html.encode("utf-8", "replace") for r in sorted(chosen.collect()) if r.html is not None] if least else []
    texts = [SKELETON.encode() + HTTP.encode() + t for t in texts]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(reversed([SKELETON.encode() + HTTP.encode(), *texts]))[-DICTIONARY_BYTES:]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row of pages (page_id, url, html) as archives in folder, through Spark's own writer.

    A null html is an empty payload. Of equal payloads of at least min_bytes that with the least page_id is a
    response and the others are revisits of it; rows that repeat the least page_id are responses too, a null
    page_id is greater than others. Each archive is a whole file; its last frame is padding whose one byte is the
    line feed with which the text writer ends a row, so the file is sound Zstandard.
    """
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    source = source.withColumn("sha", F.sha1("payload"))
    groups = source.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select(F.col("sha").alias("g"), "first")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    joined = source.join(groups, (F.col("sha") == F.col("g")) & (F.length("payload") >= min_bytes), "left")
    revisits = F.col("g").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = joined.select("page_id", "url", "payload", "sha", revisits.alias("revisits"), "first")
    words = train_dictionary(pages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
        lead = skippable(DICTIONARY, zstandard.ZstdCompressor(level=9).compress(words))
        frames, size = [lead], 0
        for batch in batches:
            for page_id, url, payload, sha, again, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                frames.append(writer.compress(record(page_id, url, payload, digest, again, first)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield whole(frames)
                    frames, size = [lead], 0
        if size:
            yield whole(frames)

    def whole(frames: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(frames) + struct.pack("<II", PADDING, 1)], pa.binary())], names=["archive"])

    archives = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).text(folder, lineSep="\n")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in folder; a file that does not hold fails the job."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                found = []
                try:
                    for raw in read_archive(content.as_py()):
                        found.append(parse(raw))
                        if len(found) >= 256:
                            yield of(found)
                            found = []
                except (ValueError, zstandard.ZstdError) as e:
                    raise ValueError(f"{path.as_py()}: {e}") from e
                if found:
                    yield of(found)

    def of(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(found, schema=kinds)

    kinds = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        + [("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark) + "-warc"
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).drop("payload", "url")
