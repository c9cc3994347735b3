"""WARC archives with a dictionary: every record is a Zstandard frame of its own, compressed with a
dictionary that is trained on records of the file and stands, in a skippable frame, at its start.

Files are written with ``write_blobs``; the separator is an empty skippable frame, so the result is
a plain sequence of Zstandard frames. A record is found and read without the ones before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import read_blobs, write_blobs
from .common import materialize, shared_path, slices, trimmed

DICTIONARY_MAGIC, SKIP_MAGIC = 0x184D2A5D, 0x184D2A50
SEPARATOR = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
DICTIONARY_BYTES, TRAINING_BYTES, LEVEL = 32 << 10, 4 << 20, 6
#: Later copies up to this number (some 80 bytes each) are sent to the payloads; above it these move once.
BROADCAST_REVISITS = 1_000_000
WARC_DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of ``least_bytes`` or more, the smallest page_id is the response; the others refer to it.

    Equality is that of SHA-256 and length, as SHA-1, which the records carry, has known collisions. Digests are pre-aggregated before they meet, and only
    payloads that occur more than once take part in the join. Payloads stay where they are while the
    later copies are few enough to be sent to them. Rows that share a page_id are judged by their own
    payloads; those that share the payload too are alike. A null page_id is written without a number
    and is never referred to.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    digest, size = F.unhex(F.sha2("payload", 256)).alias("digest"), F.length("payload").alias("size")
    keyed = rows.select("page_id", digest, size).filter(F.col("size") >= least_bytes)
    first = keyed.groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).filter("first_id < last_id").drop("last_id")
    later = keyed.join(first, ["digest", "size"]).filter("page_id > first_id").select("page_id", "digest", "size", F.col("first_id").alias("refers_to")).distinct()
    later = materialize(later, "revisits")
    few = later.count() <= BROADCAST_REVISITS
    return rows.select("*", digest, size).join(F.broadcast(later) if few else later, ["page_id", "digest", "size"], "left").drop("digest", "size")


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {WARC_DATE}",
        "WARC-Target-URI: " + re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or f"urn:page:{page_id}"),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = _HTTP
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """Null where the samples are too few or too small to learn from."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples)
    except zstandard.ZstdError:
        return None


def _frames(records, training_bytes: int):
    """The dictionary's frame, if there is one, and then a frame per record."""
    held, size, compressor = [], 0, None

    def begin():
        dictionary = train_dictionary(held)
        if dictionary is not None:
            raw = dictionary.as_bytes()
            yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
        yield made
        yield from (made.compress(r) for r in held)

    for record in records:
        if compressor is None:
            held.append(record)
            size += len(record)
            if size >= training_bytes:
                for x in begin():
                    if isinstance(x, bytes):
                        yield x
                    else:
                        compressor = x
                held = []
        else:
            yield compressor.compress(record)
    if compressor is None and held:
        yield from (x for x in begin() if isinstance(x, bytes))


def write_warc(pages: DataFrame, out: str, least_bytes: int = 0, training_bytes: int = TRAINING_BYTES) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html); null html is an empty payload.

    A task holds at most ``training_bytes`` of records, from which it learns its file's dictionary,
    and one record beyond. A file holds one input partition, so files follow the input's size.
    Repeated rows are written once each. An empty table leaves no records.
    """

    def compress(batches):
        def records():
            for batch in slices(batches, 256):
                for row in batch.to_pylist():
                    yield _record(row["page_id"], row["url"], row["payload"], row["refers_to"])

        chunk, size = [], 0
        for frame in _frames(records(), training_bytes):
            chunk.append(frame)
            size += len(frame)
            if size > 4 << 20:
                yield pa.record_batch([pa.array(chunk, pa.binary())], names=["frame"])
                chunk, size = [], 0
        if chunk:
            yield pa.record_batch([pa.array(chunk, pa.binary())], names=["frame"])

    planned = plan_records(pages, least_bytes).select("page_id", "url", "payload", "refers_to")
    write_blobs(planned.mapInArrow(trimmed(compress), "frame binary"), out, SEPARATOR)


def frame_end(buffer, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, by its block headers."""
    head = bytes(buffer[at : at + 18])
    checksum = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    while True:
        block = int.from_bytes(buffer[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def records_of(content):
    """The records of an archive file, decompressed one by one."""
    view, at, decompressor = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == SKIP_MAGIC:
            if magic == DICTIONARY_MAGIC:
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
        else:
            end = frame_end(view, at)
            yield decompressor.decompress(view[at:end])
            at = end


def parse_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return {"fields": fields, "payload": block[len(_HTTP) :] if fields["WARC-Type"] == "response" else None}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(number) if number else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record, from the archives alone: page_id, payload_bytes, payload_digest, record_type, refers_to. A response's length and digest are computed from its payload; a revisit's are those in its header."""
    names = [f.split()[0] for f in _ROWS.split(", ")]

    def parse(batches):
        for batch in batches:
            for content in batch.column(1).to_pylist():
                rows = []
                for record in records_of(content):
                    r = parse_record(record)
                    f, payload = r["fields"], r["payload"]
                    kind = f["WARC-Type"]
                    n, digest = (int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:")) if payload is None else (len(payload), base32_sha1(payload))
                    rows.append((_page(f["WARC-Record-ID"]), n, digest, kind, _page(f.get("WARC-Refers-To"))))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return read_blobs(spark, path).mapInArrow(trimmed(parse), _ROWS)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    out = shared_path(pages.sparkSession, "warc")
    write_warc(pages, out)
    return read_warc(pages.sparkSession, out)
