"""Concatenate and cut: documents become one long run of ids, cut into fixed windows.

Pass one tokenizes every document once and writes its ids with their offset inside the input
partition. The partitions' totals, summed up in partition order, give each partition's global offset;
pass two cuts every document at the multiples of the window length. A document that crosses a
boundary yields one piece on each side, so no ids move between tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, trimmed
from .tokens import BYTE_BPE, encoder, tokenizer_path

SEQUENCE_TOKENS, END_ID = 2048, 1

_ENCODED = "part int, part_start long, doc_id long, n_tokens long, wide boolean, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_documents(docs: DataFrame, path: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its ids (16 bits each where all fit) and its offset in its partition, as a table in the shared folder."""

    def encode(batches):
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches):
            starts, counts, wides, blobs = [], [], [], []
            for encoded in enc.encode_all(batch.column(1)):
                ids = np.frombuffer(encoded + end, "<u4")
                wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
                starts.append(at)
                counts.append(len(ids))
                wides.append(wide)
                blobs.append(ids.tobytes() if wide else ids.astype("<u2").tobytes())
                at += len(ids)
            n = len(starts)
            yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), batch.column(0), pa.array(counts, pa.int64()), pa.array(wides, pa.bool_()), pa.array(blobs, pa.binary())], names=["part", "part_start", "doc_id", "n_tokens", "wide", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(trimmed(encode, holds=True), _ENCODED), "encoded")


def partition_offsets(encoded: DataFrame) -> DataFrame:
    """(part, base): the ids of all partitions before each. One row per input partition, never per document."""
    totals = encoded.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def _cut(encoded: DataFrame, window: int, with_ids: bool) -> DataFrame:
    names = [f.split()[0] for f in _PIECES.split(", ")] + ["ids"] * with_ids

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, n, wide, blob, begin in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(blob, "<u4" if wide else "<u2").astype("<u4").tobytes()
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, window)
                    length = min(n - at, window - offset)
                    piece = ids[4 * at : 4 * (at + length)]
                    for column, value in zip(out, (doc_id, at, length, zlib.crc32(piece), n, sequence, offset, piece), strict=False):
                        column.append(value)
                    at += length
            yield pa.record_batch([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, out, strict=True)], names=names)

    placed = encoded.join(F.broadcast(partition_offsets(encoded)), "part")  # bounded by the number of input partitions
    rows = placed.select("doc_id", "n_tokens", "wide", "ids", (F.col("base") + F.col("part_start")).alias("begin"))
    return rows.mapInArrow(trimmed(cut), _PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str | None = None, window: int = SEQUENCE_TOKENS, end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; every id lies in exactly one, and sequences are full but for the last.

    Nulls: a null text is an empty document, which holds only the end id; a null doc_id stays null.
    Repeated rows are packed once each. Without an end id an empty document yields no piece. An empty
    table gives no rows. Columns other than doc_id and text are not read.
    """
    return _cut(encode_documents(docs, path or tokenizer_path(BYTE_BPE), end_id), window, with_ids)


def sequences(pieces: DataFrame, window: int = SEQUENCE_TOKENS, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids array<long>) of ``pack(with_ids=True)``. A short sequence is padded to the window unless its length is a power of two. At most ``window`` ids meet in a row."""

    def build(batches):
        for batch in batches:
            rows = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                n = len(ids)
                rows.append(ids.tolist() + [pad_id] * (0 if n & (n - 1) == 0 else window - n))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int64()))], names=["sequence_id", "n_ids", "ids"])

    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_ids"))
    return grouped.mapInArrow(trimmed(build), "sequence_id long, n_ids long, ids array<long>")
