"""WARC archives of individually compressed records behind a Zstandard dictionary.

An archive is one part that Spark's own committer writes: a skippable frame (magic 0x184D2A5D) with a dictionary
built from records of that archive, then one Zstandard frame for each record. Between two of them stands Spark's line
separator, which is set to an empty skippable frame, so the whole file is a valid Zstandard stream. Equal payloads of
at least ``least`` bytes are stored once, under the smallest page id; the others are revisit records.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, remove, shared_folder

DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
SALTS = 32
#: The dictionary is built from the first records of an archive, this many bytes of them at most.
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
#: Frames of an archive, its dictionary among them, and bytes of it, at most (or one record); then the next file begins.
ARCHIVE_FRAMES = 2048
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; of too few or too small ones their own bytes make the dictionary."""
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-size:] or b"WARC/1.1\r\n"
        return zstandard.ZstdCompressionDict(raw.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _uri(url: str | None) -> str:
    return CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with an HTTP block, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _frames(records: Iterator[bytes], level: int, frames: int, most: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Archive after archive of ``frames`` frames: that of the dictionary, then one for each record. An archive that reaches
    ``most`` bytes is filled up with empty rows, of which the file gets the separator alone."""
    n = 0
    while True:
        own = islice(records, frames - 1)
        first = next(own, None)
        if first is None:
            return
        yield from [b""] * (-n % frames)
        n = 0
        for f in _archive(chain([first], own), level, most):
            yield f
            n += 1


def _archive(records: Iterator[bytes], level: int, most: int) -> Iterator[bytes]:
    """Holds the sample and no more."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    made = build_dictionary(held)
    raw = made.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw), write_checksum=True, write_content_size=True)
    written = len(raw)
    for r in chain(held, records):
        yield (f := press.compress(r))
        written += len(f)
        if written >= most and not held:
            return
        if held and r is held[-1]:
            held.clear()


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    full = raw[:4] == struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


def frame_end(archive: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends: its blocks tell their sizes, so nothing is unpacked to find out."""
    checksum = zstandard.get_frame_parameters(archive[at : at + 18]).has_checksum
    end = at + zstandard.frame_header_size(archive[at : at + 18])
    last = False
    while not last:
        head = int.from_bytes(archive[end : end + 3], "little")
        last, kind = bool(head & 1), head >> 1 & 3
        end += 3 + (1 if kind == 1 else head >> 3)  # a block of one repeated byte holds that byte
    return end + 4 * checksum


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; frames are followed one by one, skippable ones but the dictionary passed over."""
    at, press = 0, None
    while at < len(archive):
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                press = zstandard.ZstdDecompressor(dict_data=_dictionary(archive[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        end = frame_end(archive, at)
        data = (press or zstandard.ZstdDecompressor()).decompress(archive[at:end])
        at = end
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def with_refers(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of the pages that repeat the payload of a page of smaller id.

    The ids of a payload meet in an aggregate; back to the pages they go salted, so a payload that a third of all
    pages share is dealt out over SALTS keys.
    """
    p = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", "url", "digest")
    firsts = p.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")))
    many = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = p.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return p.join(many, ["digest", "salt"]).where("page_id > refers_to").select("page_id", "digest", "refers_to", "refers_url").distinct()


def write(pages: DataFrame, folder: str, least: int = 100, level: int = 3, date: str = "2024-01-01T00:00:00Z", frames: int = ARCHIVE_FRAMES, most: int = ARCHIVE_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html; other columns are not stored) in ``folder``.

    A null html is an empty payload, a null url an empty one. Rows of a null page_id are responses. Rows that repeat a
    page_id are all stored, under one record id; those with the smallest id of their payload are all responses. A page is one
    record and so is held whole; an archive ends at ``frames`` frames or ``most`` bytes. An empty table gives an empty folder.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    refs = with_refers(p, least).select("page_id", F.col("digest").alias("d"), "refers_to", "refers_url")
    # The one shuffle of pages is the join's, by page and not by payload; none if Spark finds the repeats small enough to broadcast.
    both = p.join(refs.withColumnRenamed("page_id", "rid"), (F.col("page_id") == F.col("rid")) & (F.col("digest") == F.col("d")), "left")
    both = both.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to", "refers_url")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record(*[c[i].as_py() for c in b.columns], date) for b in batches for i in range(len(b)))
        held, size = [], 0
        for f in _frames(records, level, frames, most):
            held.append(f)
            size += len(f)
            if size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])

    found = both.mapInArrow(archive, "frame binary")
    found.select(F.col("frame").cast("string").alias("value")).write.mode("errorifexists").option("maxRecordsPerFile", frames).option("lineSep", SEPARATOR.decode("ascii")).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in ``folder``: page_id, url, record_type, payload (null for a revisit), and what the
    header tells of the payload (header_bytes, header_digest) and of the record it repeats (refers_to, refers_url)."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for h, block in parse(content.as_py()):
                    rows.append(_row(h, block))
                    size += len(block)
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("header_bytes", pa.int64()), ("header_digest", pa.string()), ("refers_to", pa.int64()), ("refers_url", pa.string())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(records, "page_id long, url string, record_type string, payload binary, header_bytes long, header_digest string, refers_to long, refers_url string")


def _row(h: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(http.rpartition(b": ")[2])
    number = lambda x: None if x is None or x == _urn(None) else int(x.removeprefix("<urn:x-page:").removesuffix(">"))
    revisit = h["WARC-Type"] == "revisit"
    return {
        "page_id": number(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "payload": None if revisit else payload, "header_bytes": told,
        "header_digest": h["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": number(h.get("WARC-Refers-To")), "refers_url": h.get("WARC-Refers-To-Target-URI"),
    }


def resolved(found: DataFrame) -> DataFrame:
    """Of records read back: page_id, payload_bytes, payload_digest, record_type, refers_to. What a revisit tells of its payload
    is taken from the payload of the response that it names; if there is none with its digest, it is null."""
    slim = cut(found.select("page_id", "record_type", "refers_to", "header_digest", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("d")))
    own = slim.where("record_type = 'response'")
    named = own.select(F.col("page_id").alias("named"), F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest")).distinct()
    again = slim.where("record_type = 'revisit'").join(named, (F.col("refers_to") == F.col("named")) & (F.col("header_digest") == F.col("payload_digest")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to").unionAll(again.select(*columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "pages"), folder)
    out = resolved(read_archives(spark, folder))
    remove(spark, folder)  # all of it has been read
    return out


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND n >= 100
"""
