"""Token ids in directly addressable codes: any id can be read without decoding a block.

An id is split into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id; a
continuation bitmap says which ids go on, and level k + 1 holds their next chunks in the same order.
A rank directory (ones before every 512th bit) finds an id's place in the next level, so reading id i
takes one step per level. A file is a row of segments, each of whole documents.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blobs import read_blobs, write_blobs
from .common import buckets_for, materialize, shared_path, slices, trimmed
from .tokens import WORD_BPE, encoder, tokenizer_path

MAGIC, RANK_BITS, SEGMENT_TOKENS, END_ID = b"QDAC1", 512, 1 << 20, 2
#: magic, documents, ids, levels, bytes of what follows
_HEAD = struct.Struct("<5sIQBQ")
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def _ranks(bits: np.ndarray) -> np.ndarray:
    blocks = np.add.reduceat(bits, np.arange(0, len(bits), RANK_BITS), dtype=np.uint64) if len(bits) else np.empty(0, np.uint64)
    return np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u8") if len(blocks) else blocks.astype("<u8")


def encode_segment(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """A segment of whole documents. A null doc_id is kept in a bitmap of its own."""
    ids = np.concatenate(documents).astype(np.uint32) if documents else np.empty(0, np.uint32)
    parts = [
        np.asarray([d or 0 for d in doc_ids], "<i8").tobytes(),
        _packed(np.asarray([d is None for d in doc_ids], bool)),
        np.cumsum([len(d) for d in documents], dtype="<u8").tobytes(),
    ]
    rest, levels = ids, 0
    while len(rest) or not levels:
        more = rest > 0xFF
        parts += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), _packed(more), _ranks(more).tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    body = b"".join(parts)
    return _HEAD.pack(MAGIC, len(doc_ids), len(ids), levels, len(body)) + body


class Segment:
    """Reads a segment; ``token(i)`` touches one chunk and one rank entry per level."""

    def __init__(self, buffer, at: int = 0):
        magic, n, self.n_tokens, levels, size = _HEAD.unpack_from(buffer, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        view, self._at = memoryview(buffer), at + _HEAD.size
        self.end = self._at + size

        def take(kind: str, count: int) -> np.ndarray:
            out = np.frombuffer(view, kind, count, self._at)
            self._at += out.nbytes
            return out

        ids, null = take("<i8", n), np.unpackbits(take("u1", -(-n // 8)), count=n, bitorder="little")
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.ends = take("<u8", n)
        self.levels = []
        for _ in range(levels):
            count = int(take("<u8", 1)[0])
            self.levels.append((take("u1", count), take("u1", -(-count // 8)), take("<u8", -(-count // RANK_BITS))))

    def token(self, i: int) -> int:
        """Id number ``i`` of the segment."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for codes, bits, ranks in self.levels:
            value |= int(codes[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            before = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i, shift = int(ranks[block]) + int(before.sum()), shift + 8
        raise ValueError("the last level goes on")

    def tokens(self) -> np.ndarray:
        """All ids, level by level from the last."""
        values = np.empty(0, np.uint32)
        for codes, bits, _ in reversed(self.levels):
            here = codes.astype(np.uint32)
            if len(values):
                here[np.unpackbits(bits, count=len(codes), bitorder="little").astype(bool)] |= values << np.uint32(8)
            values = here
        return values


def segments(content):
    """The segments of a file; one separator byte follows each."""
    at = 0
    while at < len(content):
        yield (s := Segment(content, at))
        at = s.end + 1


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end_id: int | None = END_ID, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every text in ascending doc_id order (nulls first; rows that share a doc_id by a hash of their text), a file per key range; at least as many files as the input has partitions, unless ``files`` says otherwise, so a file stays as small as they. Rows that share a doc_id, or the text too, may lie in several files.

    A null text is an empty document; repeated rows are written once each. An empty table leaves no
    ids. A document longer than a segment gets a segment of its own.
    """
    spark, path = docs.sparkSession, path or tokenizer_path(WORD_BPE)

    def encode(batches):
        enc, end = encoder(path), b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        doc_ids, documents, held = [], [], 0
        for batch in slices(batches):
            chunks = []
            for doc_id, encoded in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                ids = np.frombuffer(encoded + end, "<u4")
                doc_ids.append(doc_id)
                documents.append(ids)
                held += len(ids)
                if held >= SEGMENT_TOKENS:
                    chunks.append(encode_segment(doc_ids, documents))
                    doc_ids, documents, held = [], [], 0
            if chunks:
                yield pa.record_batch([pa.array(chunks, pa.binary())], names=["chunk"])
        if doc_ids:
            yield pa.record_batch([pa.array([encode_segment(doc_ids, documents)], pa.binary())], names=["chunk"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    files = files or max(buckets_for(rows, 1, 1), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(files, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    write_blobs(ordered.mapInArrow(trimmed(encode, holds=True), "chunk binary"), out, "\n")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def decode(batches):
        for batch in batches:
            for file_no, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for s in segments(content):
                    ids, ends = s.tokens().astype("<u4"), s.ends.astype(np.int64)
                    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                    sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    yield pa.record_batch([pa.array([file_no] * len(sums), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(begins + at), pa.array(ends - begins), pa.array(sums, pa.int64())], names=["file_no", "doc_id", "file_start", "n_tokens", "ids_crc32"])
                    at += s.n_tokens

    # files are read once: what a row says of its document is small and written, and the files' totals are taken from that
    rows = materialize(read_blobs(spark, path).mapInArrow(trimmed(decode), "file_no int, doc_id long, file_start long, n_tokens long, ids_crc32 long"), "read")
    totals = rows.groupBy("file_no").agg(F.max(F.col("file_start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # one row per file
    return rows.join(F.broadcast(bases), "file_no").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the documents' ids to the shared folder and reads the files back."""
    out = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, out, path)
    return read_token_files(docs.sparkSession, out)
