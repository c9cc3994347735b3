"""Removal of repeated passages by distributed prefix doubling.

A position's rank at length 2k is the pair of its rank and that of the position k further on. Ranks
are hash classes, which tell equal from different strings, and that is all that removal asks. Lengths
up to 24 are doubled inside a document. Then Spark reranks: of every 50-byte window the position with
the least rank at length 24 stands for it (equal windows choose alike), and positions whose rank no
other document has are unique and drop out with all windows they stand for. The windows that are left
are doubled on to 50, paired with their position's rank, and reranked once more: each learns the
smallest document that has it. Windows are equal where 48 bits of their position's rank, its place in
them and 56 bits of their own rank are.

Both rerankings are combined before they move: of the rows that a mapper packs together, a rank or
window that several documents have is sent for one of them only, and the others are answered at once
or by its answer. So what a third of all rows share reaches its reducer once per batch.

``doubled_ranks`` is the same in plain DataFrame steps, with every position sorted at every offset.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, materialize, mix, slices, trimmed
from .exchange import ANSWERS, KEY_BITS, LOCAL, ROW, SENT, answers, batch_answer, batch_id, bucket_of, combined, dealt, gathered, groups_of, held_rows, keep_rows, later_copies, pack_entries, passed_on, row_batches, sent_batch, spread, unpack_entries, utf8, with_answers

THRESHOLD, ANCHOR = 50, 24
#: Entries that a reducer aims to hold, bytes that a mapper ranks at once (a longer text is cut), and bytes of texts and number of windows that it packs together.
BUCKET_ENTRIES, GROUP_BYTES, PIECE_BYTES, PACK_BYTES, PACK_WINDOWS = 600_000, 1 << 18, 1 << 19, 3 << 20, 600_000

_PLACE = U64(0xFFFFFF)
_FIRST = mix(np.arange(1, 257, dtype=U64))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U64(0xD6E8FEB86659FD93)
    x += b
    x ^= x >> U64(29)
    return x


def _ranks(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks at lengths 24 and 50 of every position that has so much after it."""
    r1 = _FIRST[b]
    r2 = _pair(r1[:-1], r1[1:])
    r4 = _pair(r2[:-2], r2[2:])
    r8 = _pair(r4[:-4], r4[4:])
    r16 = _pair(r8[:-8], r8[8:])
    r32 = _pair(r16[:-16], r16[16:])
    r24 = _pair(r16[:-8], r8[16:])
    n = len(b) - THRESHOLD + 1
    r50 = _pair(_pair(r32[:n], r16[32 : 32 + n]), r2[48 : 48 + n])
    return r24, r50


class Runs:
    """Runs of windows of a group of documents that one position stands for."""

    def __init__(self, texts: list[bytes]):
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - [len(t) for t in texts]
        b = np.frombuffer(b"".join(texts), np.uint8)
        r24, self.r50 = _ranks(b)
        value = mix(r24) & ~_PLACE | np.arange(len(r24), dtype=U64)
        for step in (1, 2, 4, 8, 11):
            value = np.minimum(value[:-step], value[step:])
        lengths = np.maximum(ends - begins - THRESHOLD + 1, 0)
        doc = np.repeat(np.arange(len(texts)), lengths)
        window = np.arange(lengths.sum()) + np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        anchor = (value[window] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1])])) if len(anchor) else np.empty(0, np.int64)
        self.anchor, self.window, self.doc = anchor[first], window[first], doc[first]
        self.count = np.diff(np.append(first, len(anchor)))
        self.start = self.window - begins[self.doc]
        self.key = mix(r24[self.anchor] + U64(0x632BE59BD9B4E019)) >> U64(16)


def _groups(texts):
    """(numbers of documents, pieces, offsets) of about GROUP_BYTES; a longer text is cut so that every window lies whole in one piece."""
    numbers, pieces, offsets, held = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - THRESHOLD + 1, 0), PIECE_BYTES):
            piece = text[at : at + PIECE_BYTES + THRESHOLD - 1]
            numbers.append(i)
            pieces.append(piece)
            offsets.append(at)
            held += len(piece)
            if held >= GROUP_BYTES:
                yield np.asarray(numbers), pieces, np.asarray(offsets)
                numbers, pieces, offsets, held = [], [], [], 0
    if pieces:
        yield np.asarray(numbers), pieces, np.asarray(offsets)


def repeated_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, row_key, keys): the ranks at length 24 that a row shares with another row. Ranks that rows of one batch share are told by the mapper itself."""

    def send(batches):
        for batch in row_batches(batches):
            ids, keys = (np.asarray(batch.column(i)) for i in (0, 2))
            name, entries = batch_id(keys), []
            for numbers, pieces, _ in _groups(utf8(batch.column(1))):
                runs = Runs(pieces)
                entries.append(runs.key << KEY_BITS | numbers[runs.doc].astype(U64))
            if entries:
                packed, weights, shared, _ = combined(np.unique(np.concatenate(entries)))
                entries.clear()
                out: list[tuple] = [(k, None, v) for k, v in pack_entries(packed, ids, keys, buckets, name, weights=weights)]
                if len(shared):
                    out.append((name % buckets, name, batch_answer(shared & LOCAL, ids, keys, shared >> KEY_BITS)))
                yield sent_batch(out)

    def rerank(batches):
        blobs: list[bytes] = []
        yield from passed_on(batches, blobs)
        e = unpack_entries(blobs)
        blobs.clear()
        order, starts = groups_of(e.keys)
        if len(starts):
            doc, weight = e.doc[e.who[order]], e.weight[order]
            several = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | (np.maximum.reduceat(weight, starts) > 1)
            chosen = order[spread(several, starts, len(doc)) & (weight == 1)]  # the others know already
            yield from answers(e, e.who[chosen], e.keys[chosen])

    sent = rows.select("doc_id", "text", "row_key").mapInArrow(trimmed(send), SENT)
    found = gathered(dealt(sent, buckets).mapInArrow(trimmed(rerank), ANSWERS), buckets, "doc_id long, row_key long, keys binary")
    return found.groupBy(*ROW).agg(F.collect_list("keys").alias("keys"))


#: documents, runs, windows, batch
_WINDOWS = struct.Struct("<IIIq")


class Held:
    """Windows of a batch on their way to the reducers: per run the position's rank, document (its number in the batch), first start, distance to the position and number of windows; per window its own rank."""

    def __init__(self):
        self.runs, self.n = [], 0

    def add(self, key, doc, start, gap, count, ranks) -> None:
        self.runs.append((key, doc, start, gap, count, ranks))
        self.n += len(ranks)

    def take(self, ids: np.ndarray, row_keys: np.ndarray, buckets: int, name: int) -> list[tuple]:
        """Rows of SENT. Windows that a document with a smaller id has in the same batch are answered; of the rest, every one goes."""
        key, doc, start, gap, count, ranks = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        self.runs, self.n = [], 0
        run = np.repeat(np.arange(len(key)), count)
        step = np.arange(len(ranks)) - np.repeat(np.cumsum(count) - count, count)
        order, starts = _classes(key[run], gap[run] - step, ranks)
        own = ids[doc[run]]
        later = np.empty(len(ranks), bool)
        later[order] = own[order] > spread(np.minimum.reduceat(own[order], starts), starts, len(order))
        out: list[tuple] = []
        if later.any():
            at = np.flatnonzero(later)
            who, first, length = _runs_of(doc[run[at]].astype(np.int64), start[run[at]] + step[at])
            out.append((name % buckets, name, batch_answer(who, ids, row_keys, np.stack([first, length], 1).view(U64))))
        left = np.flatnonzero(~later)
        fresh = np.flatnonzero(np.concatenate([[True], (run[left[1:]] != run[left[:-1]]) | (left[1:] != left[:-1] + 1)])) if len(left) else np.empty(0, np.int64)
        head = left[fresh]
        runs = key[run[head]], doc[run[head]], start[run[head]] + step[head], gap[run[head]] - step[head], np.diff(np.append(fresh, len(left))), ranks[left]
        out += [(b, None, blob) for b, blob in _pack_windows(runs, ids, row_keys, buckets, name)]
        return out


def _classes(key: np.ndarray, place: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, and where each class starts."""
    whole = mix(mix(key << U64(8) | place.astype(U64)) + rank)
    order = np.argsort(whole, kind="stable")
    same = lambda x: x[order[1:]] == x[order[:-1]]
    like, equal = same(whole), same(key) & same(place) & same(rank)
    if (like & ~equal).any():  # two classes by one hash
        order = np.lexsort((place, key, rank))
        equal = same(key) & same(place) & same(rank)
    return order, np.concatenate([[0], np.flatnonzero(~equal) + 1]) if len(order) else np.empty(0, np.int64)


def _runs_of(who: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows of documents: document, first start and number of each run of consecutive ones."""
    order = np.lexsort((start, who))
    who, start = who[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)])) if len(who) else np.empty(0, np.int64)
    return who[first], start[first], np.diff(np.append(first, len(who)))


def _pack_windows(runs: tuple, ids, row_keys, buckets: int, name: int):
    """(bucket, blob) of runs, dealt by their position's rank; a window takes 7 bytes."""
    key, doc, start, gap, count, ranks = runs
    bucket = bucket_of(key, buckets)
    first = np.cumsum(count) - count
    order = np.argsort(bucket, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)] if len(order) else [0]
    for a, z in zip(cuts, cuts[1:], strict=False):
        part = order[a:z]
        used, local = np.unique(doc[part], return_inverse=True)
        used = used.astype(np.int64)
        n = count[part]
        at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        r = ranks[at]
        arrays = (
            ids[used], row_keys[used], key[part] << KEY_BITS | local.astype(U64), start[part].astype(np.uint32), (r >> U64(24)).astype(np.uint32),
            (r >> U64(8)).astype(np.uint16), used.astype(np.uint16), r.astype(np.uint8), gap[part].astype(np.uint8), n.astype(np.uint8),
        )
        yield int(bucket[part[0]]), b"".join([_WINDOWS.pack(len(used), len(part), len(at), name), *(a.tobytes() for a in arrays)])


class Windows:
    """What a reducer holds: per window its position's rank, distance to it, own rank, start and the place of its document in the table of documents."""

    def __init__(self, blobs):
        known, parts = 0, []
        for blob in blobs:
            d, m, n, batch = _WINDOWS.unpack_from(blob)
            at, out = _WINDOWS.size, []
            for kind, size in ((np.int64, d), (np.int64, d), (U64, m), (np.uint32, m), (np.uint32, n), (np.uint16, n), (np.uint16, d), (np.uint8, n), (np.uint8, m), (np.uint8, m)):
                out.append(np.frombuffer(blob, kind, size, at))
                at += out[-1].nbytes
            doc, row, packed, start, high, middle, place, low, gap, count = out
            rank = high.astype(U64) << U64(24) | middle.astype(U64) << U64(8) | low.astype(U64)
            run = np.repeat(np.arange(m), count)
            step = np.arange(n) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count)
            who = (packed & LOCAL).astype(np.int32) + np.int32(known)
            parts.append(((packed >> KEY_BITS)[run], (gap.astype(np.int16)[run] - step).astype(np.int16), rank, start.astype(np.int64)[run] + step, who[run], doc, row, np.full(d, batch), place))
            known += d
        columns: list = list(zip(*parts, strict=True)) if parts else [[np.empty(0, k)] for k in (U64, np.int16, U64, np.int64, np.int32, np.int64, np.int64, np.int64, np.uint16)]
        del parts
        for i, column in enumerate(columns):
            columns[i] = np.concatenate(column)
        self.key, self.gap, self.rank, self.start, self.who, self.doc, self.row, self.batch, self.place = columns


def repeated_windows(rows: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, row_key, runs): per row, (start, number) pairs of 50-byte strings that also start in a document with a smaller doc_id."""

    def send(batches):
        for batch in row_batches(batches, PACK_BYTES):
            wanted = [np.unique(np.frombuffer(b"".join(k), U64)) for k in batch.column(3).to_pylist()]
            ids, keys = (np.asarray(batch.column(i)) for i in (0, 2))
            name, held = batch_id(keys), Held()
            for numbers, pieces, offsets in _groups(utf8(batch.column(1))):
                r = Runs(pieces)
                cuts = np.searchsorted(r.doc, np.arange(len(pieces) + 1))
                hit = np.concatenate([np.isin(r.key[a:b], wanted[i]) for a, b, i in zip(cuts, cuts[1:], numbers, strict=False)]) if len(r.key) else np.empty(0, bool)
                if hit.any():
                    n, w = r.count[hit], r.window[hit]
                    at = np.repeat(w - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    held.add(r.key[hit], numbers[r.doc[hit]], r.start[hit] + offsets[r.doc[hit]], r.anchor[hit] - w, n, mix(r.r50[at]) >> U64(8))
                if held.n >= PACK_WINDOWS:
                    yield sent_batch(held.take(ids, keys, buckets, name))
            if held.n:
                yield sent_batch(held.take(ids, keys, buckets, name))

    def rerank(batches):
        blobs: list[bytes] = []
        yield from passed_on(batches, blobs)
        e = Windows(blobs)
        blobs.clear()
        order, starts = _classes(e.key, e.gap, e.rank)
        e.key = e.gap = e.rank = None
        if len(starts):
            doc = e.doc[e.who[order]]
            chosen = order[spread(np.minimum.reduceat(doc, starts), starts, len(doc)) < doc]
            who, first, length = _runs_of(e.who[chosen], e.start[chosen])
            yield from answers(e, who, np.stack([first, length], 1).view(U64))

    asked = with_answers(rows, anchors).select("doc_id", "text", "row_key", "keys")
    sent = asked.mapInArrow(trimmed(send), SENT)
    found = gathered(dealt(sent, buckets).mapInArrow(trimmed(rerank), ANSWERS), buckets, "doc_id long, row_key long, runs binary")
    return found.groupBy(*ROW).agg(F.collect_list("runs").alias("runs"))


def _spans(runs: list[bytes], n: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of n bytes."""
    pairs = np.frombuffer(b"".join(runs), np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    starts, stops = pairs[:, 0], np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] + THRESHOLD - 1)
    fresh = np.concatenate([[True], starts[1:] > stops[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(stops) - 1)
    return list(zip(starts[fresh].tolist(), stops[last].tolist(), strict=True))


def mark_repeats(docs: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, copies, runs): the rows with a doc_id, those that copy a whole earlier text, and the repeated windows of all others."""
    rows = held_rows(docs, keep)
    copies = materialize(later_copies(rows), "copies")
    firsts = keep_rows(rows.select("doc_id", "text", "row_key"), copies, "left_anti")
    n_bytes = firsts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = materialize(repeated_anchors(firsts, max(12, n_bytes // (13 * BUCKET_ENTRIES) + 1)), "anchors", frees=True)
    held = anchors.agg(F.sum(F.expr("aggregate(keys, 0L, (a, k) -> a + length(k))"))).first()[0] or 0
    runs = materialize(repeated_windows(firsts, anchors, max(12, held * 17 // 8 // BUCKET_ENTRIES + 1)), "runs", frees=True)
    discard(anchors)
    return rows, copies, runs


def doubled_ranks(docs: DataFrame, length: int = THRESHOLD) -> DataFrame:
    """(doc_id, row_key, pos): bytes at which a string of ``length`` bytes starts that also starts in a document with a smaller doc_id.

    Every position's rank and that of the position further on are sorted at each offset and ranked
    anew by the first position that has the pair; positions whose pair is unique drop out. All
    positions move at each of the first offsets, some 50 bytes for a byte of text.
    """
    rows = held_rows(docs).dropDuplicates(ROW)
    pairs_of_digits = F.filter(F.split(F.hex(F.encode("text", "utf-8")), r"(?<=\G..)"), lambda x: x != "")
    held, have = rows.select(*ROW, F.posexplode(pairs_of_digits).alias("pos", "rank")), 1
    state = materialize(held, "positions")
    while have < length:
        step = min(have, length - have)
        ahead = state.select(*ROW, (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = materialize(state.join(ahead, [*ROW, "pos"]), "pairs", frees=True)
        place = F.struct(*ROW, "pos")
        classes = pairs.groupBy("rank", "next").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last")
        new = materialize(pairs.join(classes, ["rank", "next"]).select(*ROW, "pos", F.col("first").alias("rank")), "positions", frees=True)
        discard(state, pairs)
        state, have = new, have + step
    return state.filter("rank.doc_id < doc_id").select(*ROW, "pos")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` also the kept text as ``kept`` (bytes that no longer form a character dropped), and the columns ``keep`` unchanged.

    Each byte that lies in a 50-byte string that also starts in a document with a smaller doc_id
    goes; all strings are judged on the input. Null is the empty text. Rows that share a doc_id are
    not earlier than one another; repeated rows are judged alike. Rows with a null doc_id have no
    place in the order: nothing of them is removed, and they remove nothing. Texts under 50 bytes
    stay whole. An empty table gives no rows. Columns other than those named are not read.
    """
    rows, copies, runs = mark_repeats(docs, keep)
    made = [f.split()[0] for f in _OUT.split(", ")] + ["kept"] * with_text

    def cut(batches):
        for batch in slices(batches):
            out: list[list] = [[] for _ in made]
            for doc_id, text, found in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                spans = _spans(found, len(text))
                parts, at = [], 0
                for a, b in spans:
                    parts.append(text[at:a])
                    at = b
                rest = b"".join([*parts, text[at:]])
                row = (doc_id, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None)
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            columns = [pa.array(c, pa.string() if k in ("kept_sha256", "kept") else pa.int64()) for k, c in zip(made, out, strict=True)]
            yield pa.record_batch([*columns, *(batch.column(i) for i in range(3, batch.num_columns))], names=[*made, *keep])

    size, zero = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    long = size >= THRESHOLD
    whole, nothing = F.sha2("text", 256), F.sha2(F.lit(""), 256)

    def shown(frame: DataFrame, removed, spans, sha, text) -> DataFrame:
        return frame.select("doc_id", size.alias("n_bytes"), removed.alias("n_removed"), spans.cast("long").alias("n_spans"), sha.alias("kept_sha256"), *([text.alias("kept")] if with_text else []), *keep)

    nulls = docs.filter("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    rest = keep_rows(keep_rows(rows, runs, "left_anti"), copies, "left_anti").drop("row_key")
    plain = shown(rest.unionByName(nulls), zero, zero, whole, F.col("text"))
    copied = shown(keep_rows(rows, copies, "left_semi"), F.when(long, size).otherwise(zero), long.cast("int"), F.when(long, nothing).otherwise(whole), F.when(long, "").otherwise(F.col("text")))
    touched = with_answers(rows, runs).select("doc_id", "text", "runs", *keep)
    return touched.mapInArrow(trimmed(cut), plain.schema).unionByName(plain).unionByName(copied)
