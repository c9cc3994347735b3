"""Compact exchange of (key, document) pairs between tasks, and joins that keep whole texts in place.

Keys are 48-bit hashes. A mapper packs them with the number of the document in its batch into 64-bit
entries and writes one blob per bucket of keys; a reducer unpacks a bucket's blobs, finds what its keys
share, and answers to the batches. Buckets are partitions, so a reducer holds one, and answers are
gathered one batch at a time. A batch is named by what is in it: where a lost task is run again and cuts
its batches otherwise, answers to the old ones and the new ones don't mix.
"""

from __future__ import annotations

import itertools
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, materialize, mix, trimmed

#: Ids up to this number (32 MB) are sent to all executors to filter texts before they move; above it the join shuffles.
BROADCAST_IDS = 2_000_000
KEY_BITS = U64(16)
LOCAL = U64(0xFFFF)
KEY = U64(0xFFFFFFFFFFFF)
#: What tells one row from another; equal rows have equal ones.
ROW = ["doc_id", "row_key"]


def row_key():
    """A 64-bit hash of a (doc_id, text) row, which goes with the doc_id as the row's identity."""
    return F.xxhash64("doc_id", "text")


def held_rows(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, row_key) and the columns ``keep`` of rows with a doc_id; null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    return rows.filter("doc_id IS NOT NULL").withColumn("row_key", row_key())


def later_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, row_key, first_id): rows whose whole text also stands under a smaller doc_id, by SHA-256. Pre-aggregated, so that a text with very many copies is met once per task; the firsts of groups are written, so that Spark sees their size and either broadcasts them or splits a text with very many copies over tasks."""
    keyed = rows.select("row_key", "doc_id", F.sha2("text", 256).alias("sha"))
    first = keyed.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").select("sha", "first_id")
    first = materialize(first, "first-copies")
    return keyed.join(first, "sha").filter("doc_id > first_id").select("doc_id", "row_key", "first_id").distinct()


def keep_rows(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of texts on their identity; ``ids`` is a table, whose size decides whether the texts have to move. Where they do, they are put in order, so that a task that is run again cuts the same batches."""
    if ids.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids.select(*ROW)), ROW, how)
    return rows.join(ids.select(*ROW), ROW, how).sortWithinPartitions(*ROW)


def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Inner join of texts with per-row answers; only texts that have one move where the answers are few."""
    return keep_rows(rows, answers, "left_semi").join(answers, ROW)


@dataclass
class Entries:
    """Entries of many documents: key (48 bits), the place of its document in the table of documents, and how many of that batch's rows it stands for. Of each document: id, row key, size, batch and its number in that."""

    keys: np.ndarray
    who: np.ndarray
    weight: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    size: np.ndarray
    batch: np.ndarray
    place: np.ndarray


#: documents, entries, batch, whether there are sizes and weights
_HEAD = struct.Struct("<IIqII")
#: Rows that a mapper packs together; answers come back a blob per such batch.
BATCH_ROWS = 2000
BATCH_BYTES = 6 << 20


def row_batches(batches, most_bytes: int = BATCH_BYTES):
    """Batches of at most BATCH_ROWS rows, small ones put together up to about ``most_bytes``."""
    held, rows, size = [], 0, 0
    for whole in batches:
        step = max(1, min(BATCH_ROWS, whole.num_rows * most_bytes // max(1, whole.nbytes)))
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            if held and (rows + part.num_rows > BATCH_ROWS or size > most_bytes):
                whole_batch = pa.concat_batches(held)
                held, rows, size = [], 0, 0
                yield whole_batch
                del whole_batch
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
    if held:
        yield pa.concat_batches(held)


def batch_id(row_keys: np.ndarray) -> int:
    """A name for the rows of a batch in their order."""
    place = np.arange(len(row_keys), dtype=U64) * U64(0x9E3779B97F4A7C15)
    return int(mix(row_keys.astype(np.int64).view(U64) ^ mix(place)).sum(dtype=U64).view(np.int64)) if len(row_keys) else 0


def utf8(column, rows: int = 256):
    """The texts of a column as bytes, null as empty, some at a time and without a string in between."""
    for at in range(0, len(column), rows):
        for text in column.slice(at, rows).cast(pa.binary()).to_pylist():
            yield text or b""


def combined(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries, weights, shared, behind): of each key that several documents of a batch have, one entry is sent for all, with their number as weight.

    So a key that a third of all rows have reaches its reducer once per batch. ``shared`` are all entries
    of such keys, ``behind`` those of them that aren't sent. Sorts ``packed`` in place.
    """
    packed.sort()
    key = packed >> KEY_BITS
    head = np.concatenate([[True], key[1:] != key[:-1]])
    starts = np.flatnonzero(head)
    n = np.diff(np.append(starts, len(packed)))
    several = (packed[starts] & LOCAL) != (packed[starts + n - 1] & LOCAL)
    member = np.repeat(several, n)
    sent = head | ~member
    weights = np.ones(len(packed), np.uint16)
    weights[starts[several]] = np.minimum(n[several], 0xFFFF)
    return packed[sent], weights[sent], packed[member], packed[member & ~head]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys * U64(0x9E3779B97F4A7C15) >> U64(33)) % U64(buckets)


def pack_entries(packed: np.ndarray, doc_ids: np.ndarray, row_keys: np.ndarray, buckets: int, batch: int, sizes: np.ndarray | None = None, weights: np.ndarray | None = None):
    """Yields (bucket, blob) of entries ``key << 16 | number in the batch``; without ``weights`` each stands for itself."""
    bucket = bucket_of(packed >> KEY_BITS, buckets)
    order = np.argsort(bucket, kind="stable")
    packed, bucket = packed[order], bucket[order]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(packed)] if len(packed) else [0]
    weights = None if weights is None else weights[order]
    for a, z in zip(cuts, cuts[1:], strict=False):
        part = packed[a:z]
        used, local = np.unique(part & LOCAL, return_inverse=True)
        used = used.astype(np.int64)
        entries = part & ~LOCAL | local.astype(U64)
        columns = [doc_ids[used], row_keys[used], *([] if sizes is None else [sizes[used]]), entries, used.astype(np.uint16), *([] if weights is None else [weights[a:z]])]
        yield int(bucket[a]), b"".join([_HEAD.pack(len(used), len(entries), batch, sizes is not None, weights is not None), *(c.tobytes() for c in columns)])


def unpack_entries(blobs) -> Entries:
    parts: list[tuple] = []
    known = 0
    for blob in blobs:
        d, n, batch, sized, weighted = _HEAD.unpack_from(blob)
        at = _HEAD.size

        def take(kind, count, blob=blob):
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        docs, rows = take(np.int64, d), take(np.int64, d)
        sizes = take(np.int64, d) if sized else np.zeros(d, np.int64)
        entries, place = take(U64, n), take(np.uint16, d)
        weight = take(np.uint16, n) if weighted else np.ones(n, np.uint16)
        parts.append((entries >> KEY_BITS, (entries & LOCAL).astype(np.int32) + np.int32(known), weight, docs, rows, sizes, np.full(d, batch), place))
        known += d
    if not parts:
        return Entries(*(np.empty(0, k) for k in (U64, np.int32, np.uint16, np.int64, np.int64, np.int64, np.int64, np.uint16)))
    columns: list = list(zip(*parts, strict=True))
    del parts
    for i, column in enumerate(columns):
        columns[i] = np.concatenate(column)
    return Entries(*columns)


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``keys``, and where each run of equal keys starts in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]) if len(keys) else np.empty(0, np.int64)


def spread(per_group: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A value per group, repeated for its members."""
    return np.repeat(per_group, np.diff(np.append(starts, n)))


SENT = "bucket int, batch long, blob binary"
ANSWERS = "batch long, blob binary"
#: Marks a blob of rows and keys that wait for the answers that their batch gets for those keys.
WAITS = 1
#: documents, values, columns of a value, whether it waits
_ANSWER = struct.Struct("<IIII")


def answer_blob(doc: np.ndarray, row: np.ndarray, place: np.ndarray, local: np.ndarray, values: np.ndarray, mark: int = 0) -> bytes:
    """``values`` (64 bits wide, in any number of columns) for documents, which ``local`` numbers in the tables before."""
    width = 1 if values.ndim == 1 else values.shape[1]
    return b"".join([_ANSWER.pack(len(doc), len(local), width, mark), doc.tobytes(), row.tobytes(), values.tobytes(), place.astype(np.uint16).tobytes(), local.astype(np.uint16).tobytes()])


def batch_answer(packed_local: np.ndarray, doc_ids: np.ndarray, row_keys: np.ndarray, values: np.ndarray, mark: int = 0) -> bytes:
    """A mapper's own answer to rows of its batch, by their numbers in it."""
    used, local = np.unique(packed_local.astype(np.int64), return_inverse=True)
    return answer_blob(doc_ids[used], row_keys[used], used, local, values, mark)


def sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    """(bucket, batch or null, blob) rows as a record batch of SENT."""
    return pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "batch", "blob"])


def dealt(sent: DataFrame, buckets: int) -> DataFrame:
    """Every bucket as a partition of its own."""
    return sent.repartitionById(buckets, F.col("bucket"))


def passed_on(batches, blobs: list):
    """Gathers a reducer's blobs of entries; what a mapper answered itself, which names its batch, goes on at once as ANSWERS."""
    for b in batches:
        ready = b.filter(b.column(1).is_valid())
        if ready.num_rows:
            yield pa.record_batch([ready.column(1), ready.column(2)], names=["batch", "blob"])
        blobs += b.filter(b.column(1).is_null()).column(2).to_pylist()


def answers(e, who: np.ndarray, values: np.ndarray):
    """Record batches of ANSWERS: a value for each of the documents ``who`` of the table ``e``, a blob per batch of the mapper's rows."""
    order, starts = groups_of(e.batch[who])
    cuts = np.append(starts, len(order)).tolist()
    out: list[tuple] = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        chosen = order[a:z]
        used, local = np.unique(who[chosen], return_inverse=True)
        out.append((int(e.batch[used[0]]), answer_blob(e.doc[used], e.row[used], e.place[used], local, values[chosen])))
    if out:
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["batch", "blob"])


def read_answer(blob):
    """documents, rows, places and values of an answer, the last two per value; whether it waits."""
    d, n, width, mark = _ANSWER.unpack_from(blob)
    at = _ANSWER.size
    doc, row = np.frombuffer(blob, np.int64, d, at), np.frombuffer(blob, np.int64, d, at + 8 * d)
    values = np.frombuffer(blob, U64, n * width, at + 16 * d).reshape(n, width)
    place = np.frombuffer(blob, np.uint16, d, at + 16 * d + values.nbytes)
    local = np.frombuffer(blob, np.uint16, n, at + 18 * d + values.nbytes)
    return doc, row, place, place[local], values, mark


def one_batch(blobs) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of one batch: doc_ids, row keys and joined values of each of its rows that has an answer. Rows that wait for a key take the answer whose low 48 bits are that key."""
    docs, rows, places, at, values, waiting = [], [], [], [], [], []
    for blob in blobs:
        doc, row, place, each, value, waits = read_answer(blob)
        docs.append(doc)
        rows.append(row)
        places.append(place)
        if waits:
            waiting.append((each, value[:, 0]))
        else:
            at.append(each)
            values.append(value)
    if waiting:
        told = np.concatenate(values)[:, 0] if values else np.empty(0, U64)
        told = told[np.argsort(told & KEY, kind="stable")]
        known = told & KEY
        for each, key in waiting:
            found = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            if len(key) and (not len(known) or (known[found] != key).any()):
                raise RuntimeError("a batch waits for an answer that its reducer did not give")
            at.append(each)
            values.append(told[found].reshape(-1, 1))
    doc_of, row_of = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    every = np.concatenate(places)
    doc_of[every], row_of[every] = np.concatenate(docs), np.concatenate(rows)
    at, values = np.concatenate(at), np.concatenate(values)
    order, starts = groups_of(at)
    head = at[order[starts]]
    return doc_of[head], row_of[head], [v.tobytes() for v in np.split(values[order], starts[1:])]


def gathered(answered: DataFrame, parts: int, schema: str, finish=None) -> DataFrame:
    """(doc_id, row_key, values binary): the values of each row, of one batch of its mapper together; ``finish`` may turn record batches of these into others of ``schema``. A row that stands in several batches comes once for each."""
    names = [f.split()[0] for f in schema.split(", ")]

    def gather(batches):
        rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for _, group in itertools.groupby(rows, key=lambda x: x[0]):
            doc, row, values = one_batch([blob for _, blob in group])
            out = pa.record_batch([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "row_key", "values"] if finish else names)
            yield finish(out) if finish else out

    return answered.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(trimmed(gather), schema)
