"""Exact Jaccard self-join of word n-gram sets with a prefix tree, and its connected components.

Sets are globally ordered. Rows that copy an earlier text take no part. A first pass sends each set's
prefix in hash order, somewhat longer than the join needs, and drops every set that shares too few of
those tokens with anyone. What is left is ordered by document frequency; tokens of one document only
can't be shared and stay behind as a count. Sets that share a token of their rarest-first prefix, under
the length and positional bounds, are candidates. Candidates come together in blocks of a bounded size:
in each the sets form a prefix tree, most frequent token first, which all probing sets of the block
traverse at once. Near copies share long branches, a branch's overlaps are counted once, and a subtree
is left where what remains of it can't make up the overlap of any probe. Tokens are 48-bit hashes; links
that they show are held against the words themselves before they count.

Candidates are met in two rounds. The first compares each set with one hub and contracts what links;
the second compares all candidates that are still in different components. Links inside a component
change nothing, so none between components is lost and no group emits all its pairs. A token that very
many sets of different components share is dealt out in cells of pairs of parts of them.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, materialize, mix, slices, trimmed
from .components import connected_components
from .exchange import ANSWERS, KEY, KEY_BITS, LOCAL, ROW, SENT, WAITS, answers, batch_answer, batch_id, combined, dealt, gathered, groups_of, held_rows, keep_rows, later_copies, pack_entries, passed_on, row_batches, sent_batch, spread, unpack_entries, utf8

WORDS = 5
#: Entries that a reducer aims to hold and a mapper packs together; bytes of texts hashed together, and of the pieces of a longer one.
BUCKET_ENTRIES, PACK_ENTRIES, GROUP_BYTES, PIECE_BYTES = 600_000, 800_000, 1 << 18, 1 << 20
#: Candidate pairs and tokens of a block, and sets of one token that are compared in a cell.
BLOCK_PAIRS, BLOCK_TOKENS, CELL_ROWS = 256, 500_000, 500

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BREAKS = b" \t\n\v\f\r"
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_LONG_WORD = 64
_LOW_BYTES = np.asarray([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U64)
_STEP = U64(0xD6E8FEB86659FD93)


def _long_word(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every run of bytes that aren't white space. Eight bytes at a time are mixed in; a word of more than 64 bytes is hashed by itself."""
    space = np.concatenate([[True], _SPACE[b], [True]])
    starts = np.flatnonzero(space[:-2] & ~space[1:-1])
    ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    folded = np.concatenate([_FOLD[b], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(b) + 1,), "<u8", folded, strides=(1,))
    length = ends - starts
    hashes = mix(length.astype(U64) * _STEP + U64(0x9E3779B97F4A7C15))
    live = np.flatnonzero(length <= _LONG_WORD)
    for i in np.flatnonzero(length > _LONG_WORD).tolist():
        hashes[i] = _long_word(folded[starts[i] : ends[i]].tobytes())
    at = 0
    while len(live):
        left = length[live] - at
        hashes[live] = mix(hashes[live] ^ (eight[starts[live] + at] & _LOW_BYTES[np.minimum(left, 8)]))
        at, live = at + 8, live[left > 8]
    return hashes, starts, ends


def _pieces(text: bytes):
    """(piece, whether it is one long word): a long text cut at white space."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        cut = max(text.rfind(bytes([c]), at, at + PIECE_BYTES) for c in _BREAKS)
        if cut >= at:
            yield text[at:cut], False
            at = cut + 1
        else:
            found = _BREAK.search(text, at + PIECE_BYTES)
            end = found.start() if found else len(text)
            yield text[at:end], True
            at = end
    yield text[at:], False


def _chained(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hash of every run of ``words`` hashes."""
    n = len(hashes) - words + 1
    total = mix(hashes[:n] + U64(words))
    for k in range(1, words):
        total = mix(total * _STEP + hashes[k : k + n])
    return total


def _long_set(text: bytes, words: int) -> np.ndarray:
    parts, carried, n = [], np.empty(0, U64), 0
    for piece, word in _pieces(text):
        new = np.asarray([_long_word(piece.translate(bytes(_FOLD)))], U64) if word else _word_hashes(np.frombuffer(piece, np.uint8))[0]
        n += len(new)
        carried = np.concatenate([carried, new])
        if len(carried) >= words:
            parts.append(np.unique(_chained(carried, words)))
            carried = carried[len(carried) - words + 1 :]
    if n < words:
        return _chained(carried, n) if n else carried
    every = np.concatenate(parts)
    parts.clear()
    every.sort()
    return every[np.concatenate([[True], every[1:] != every[:-1]])]


def shingle_sets(texts, words: int = WORDS):
    """The sorted distinct 64-bit shingle hashes of each text (UTF-8 bytes), in order. A text of fewer words has one shingle, its whole sequence; one without words has none."""

    def together(held: list[bytes]):
        ends = np.cumsum([len(t) + 1 for t in held])
        hashes, starts, _ = _word_hashes(np.frombuffer(b" ".join([*held, b""]), np.uint8))
        cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
        total = _chained(hashes, words) if len(hashes) >= words else None
        for a, z in itertools.pairwise(cuts.tolist()):
            if z - a >= words:
                yield np.unique(total[a : z - words + 1])
            else:
                yield _chained(hashes[a:z], z - a) if z > a else np.empty(0, U64)

    held: list[bytes] = []
    size = 0
    for text in texts:
        if len(text) > PIECE_BYTES:
            yield from together(held)
            held, size = [], 0
            yield _long_set(text, words)
            continue
        held.append(text)
        size += len(text)
        if size >= GROUP_BYTES:
            yield from together(held)
            held, size = [], 0
    yield from together(held)


def least_overlap(a, b):
    """The overlap from which 100 * intersection >= 75 * union, for set sizes a and b."""
    return (3 * (a + b) + 6) // 7


def _kept(n):
    """Three quarters of a set, rounded up: what any partner must share of it."""
    return (3 * n + 3) // 4


def _send_sets(take, buckets: int, tell):
    """A mapper that sends ``take(set)`` of each row of (doc_id, text, row_key), dealt by token. Tokens that several of its rows have are sent once; ``tell`` makes the blob that tells those rows of them."""

    def send(batches):
        for batch in row_batches(batches):
            ids, keys = (np.asarray(batch.column(i)) for i in (0, 2))
            name, packed, held, sizes, seen = batch_id(keys), [], 0, np.zeros(batch.num_rows, np.int64), set()

            def flush(ids=ids, keys=keys, name=name, packed=packed, sizes=sizes):
                entries, weights, shared, behind = combined(np.concatenate(packed))
                packed.clear()
                out: list[tuple] = [(k, None, v) for k, v in pack_entries(entries, ids, keys, buckets, name, sizes, weights)]
                if len(shared):
                    out.append((name % buckets, name, tell(shared, behind, ids, keys, sizes)))
                return sent_batch(out)

            for i, (row, s) in enumerate(zip(zip(ids.tolist(), keys.tolist(), strict=True), shingle_sets(utf8(batch.column(1))), strict=True)):
                sizes[i] = len(s)
                if row not in seen and len(s):  # a repeated row learns what the first does
                    seen.add(row)
                    packed.append(take(s) & ~LOCAL | U64(i))
                    held += len(packed[-1])
                if held >= PACK_ENTRIES:
                    yield flush()
                    held = 0
            if packed:
                yield flush()

    return trimmed(send)


def _prefix(s: np.ndarray) -> np.ndarray:
    """The least hashes: the join's prefix and an eighth of the set more, by which a near copy shares as many tokens."""
    n = len(s)
    return s[: n - _kept(n) + 1 + n // 8] if n else s


def _shared(e):
    """Order and starts of the key groups, and which ordered entries have a key that more than one row has."""
    order, starts = groups_of(e.keys)
    if not len(starts):
        return order, starts, np.empty(0, bool)
    who, weight = e.who[order], e.weight[order]
    doc, row = e.doc[who], e.row[who]
    differ = lambda x: np.minimum.reduceat(x, starts) != np.maximum.reduceat(x, starts)
    return order, starts, spread(differ(row) | differ(doc) | (np.maximum.reduceat(weight, starts) > 1), starts, len(who))


def near_candidates(rows: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, row_key, size): rows whose hash-order prefix shares enough tokens with other rows to have a partner at all."""

    def counted(shared, behind, ids, keys, sizes):
        n = np.bincount((shared & LOCAL).astype(np.int64))
        i = np.flatnonzero(n)
        return batch_answer(i, ids, keys, np.stack([sizes[i], n[i]], 1).view(U64))

    def count(batches):
        blobs: list[bytes] = []
        yield from passed_on(batches, blobs)
        e = unpack_entries(blobs)
        blobs.clear()
        order, _, shared = _shared(e)
        n = np.bincount(e.who[order[shared & (e.weight[order] == 1)]], minlength=len(e.doc))  # the others are counted in their batch
        who = np.flatnonzero(n)
        yield from answers(e, who, np.stack([e.size[who], n[who]], 1).view(U64))

    def enough(batch):
        keep: list[tuple] = []
        for doc, row, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            told = np.frombuffer(blob, np.int64).reshape(-1, 2)
            size = int(told[0, 0])
            if told[:, 1].sum() >= 1 + _kept(size) // 8:
                keep.append((doc, row, size))
        return pa.record_batch([pa.array([x[i] for x in keep], pa.int64()) for i in range(3)], names=[*ROW, "size"])

    sent = rows.select("doc_id", "text", "row_key").mapInArrow(_send_sets(_prefix, buckets, counted), SENT)
    told = dealt(sent, buckets).mapInArrow(trimmed(count), ANSWERS)
    return gathered(told, buckets, "doc_id long, row_key long, size long", enough).distinct()


def ordered_sets(rows: DataFrame, near: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, row_key, size, alone, tokens binary): of each row of ``near`` the tokens that other such rows have too, rarest first; ``alone`` counts the others. Rows that can't reach three quarters of their size go.

    An answer packs a token with its document frequency, which only orders tokens and stops at 65535.
    """

    def waiting(shared, behind, ids, keys, sizes):
        return batch_answer(behind & LOCAL, ids, keys, behind >> KEY_BITS, WAITS)

    def rank(batches):
        blobs: list[bytes] = []
        yield from passed_on(batches, blobs)
        e = unpack_entries(blobs)
        blobs.clear()
        order, starts, shared = _shared(e)
        if not len(starts):
            return
        often = spread(np.add.reduceat(e.weight[order].astype(np.int64), starts), starts, len(order))[shared]
        chosen = order[shared]
        yield from answers(e, e.who[chosen], np.minimum(often, 0xFFFF).astype(U64) << U64(48) | e.keys[chosen])

    def order_tokens(batches):
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, row, size, told in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tokens = np.unique(np.frombuffer(b"".join(told), U64)) & KEY
                if len(tokens) >= _kept(size):
                    out.append((doc, row, size, size - len(tokens), tokens.tobytes()))
            yield pa.record_batch([pa.array([x[i] for x in out], pa.binary() if i == 4 else pa.int64()) for i in range(5)], names=[*ROW, "size", "alone", "tokens"])

    sent = keep_rows(rows, near, "left_semi").select("doc_id", "text", "row_key").mapInArrow(_send_sets(lambda s: s, buckets, waiting), SENT)
    told = gathered(dealt(sent, buckets).mapInArrow(trimmed(rank), ANSWERS), buckets, "doc_id long, row_key long, told binary")
    whole = near.join(told, ROW).groupBy(*ROW, "size").agg(F.collect_list("told").alias("told"))
    return whole.mapInArrow(trimmed(order_tokens), "doc_id long, row_key long, size long, alone long, tokens binary")


def prefix_tokens(sets: DataFrame) -> DataFrame:
    """(token, doc_id, row_key, size, place): the shared part of each set's rarest-first prefix; ``place`` counts what comes before in the whole set."""

    def emit(batches):
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(5)]
            for doc, row, size, alone, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                n = size - _kept(size) + 1 - alone
                if n > 0:
                    tokens = np.frombuffer(blob, U64)[:n].view(np.int64)
                    n = len(tokens)
                    for c, v in zip(columns, (tokens, np.full(n, doc), np.full(n, row), np.full(n, size), alone + np.arange(n)), strict=True):
                        c.append(v)
            if columns[0]:
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["token", *ROW, "size", "place"])

    return sets.select(*ROW, "size", "alone", "tokens").mapInArrow(emit, "token long, doc_id long, row_key long, size long, place long")


class Probes:
    """Sets that traverse a prefix tree together: their tokens in order, each with the places of the sets that have it."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.lengths, self.sizes = np.asarray([len(s) for s in sets]), np.asarray(sizes)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(sets)), self.lengths)[order]

    def overlaps(self, part: np.ndarray) -> np.ndarray:
        """How many tokens of a branch each probe has."""
        low, high = np.searchsorted(self.tokens, part, "left"), np.searchsorted(self.tokens, part, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def tree_matches(probes: Probes, sets: list[np.ndarray], sizes: list[int], asked: list[list[int]], branch: int = 64) -> list[list[int]]:
    """Which of the probes that it is ``asked`` for each of ``sets`` links with. All are rarest first without the tokens of one document only, whose numbers the sizes include.

    The sets form a prefix tree, read from the most frequent token, in branches of ``branch`` tokens:
    a sorted list in which each set shares branches with the one before. The probes' counts at the end
    of a shared branch are reused; a set ends where its remaining length can bring no probe's overlap.
    """
    paths = [s[::-1] for s in sets]
    order = sorted(range(len(sets)), key=lambda i: paths[i].tobytes())
    linked: list[list[int]] = [[] for _ in sets]
    before, counts = np.empty(0, U64), [np.zeros(len(probes.sizes), np.int64)]  # at the ends of the last path's branches
    for i in order:
        path, some = paths[i], np.asarray(asked[i])
        need, length = least_overlap(probes.sizes[some], sizes[i]), probes.lengths[some]
        n = min(len(path), len(before))
        differ = np.flatnonzero(path[:n] != before[:n])
        whole = (int(differ[0]) if len(differ) else n) // branch
        del counts[whole + 1 :]
        whole, total = len(counts) - 1, counts[-1]
        at = whole * branch
        alive = total[some] + np.minimum(len(path) - at, length - total[some]) >= need
        while at < len(path) and alive.any():
            part = path[at : at + branch]
            total = total + probes.overlaps(part)
            at += len(part)
            if len(part) == branch:
                counts.append(total)
            alive = total[some] + np.minimum(len(path) - at, length - total[some]) >= need
        linked[i] = some[alive].tolist() if at == len(path) else []
        before = path[:at]
    return linked


PAIRS = "doc_a long, row_a long, doc_b long, row_b long, size_b long"


def in_blocks(pairs: DataFrame, table: DataFrame, columns: list[str], n_pairs: int) -> DataFrame:
    """(block, side, place, asked, doc_id, row_key and ``columns`` of ``table``): the rows of written ``pairs`` in blocks, in order of block and side.

    Pairs are put in order, so that a block has few a and each comes once, and cut by number and size;
    a row with very many partners is spread over blocks. A b row is ``asked`` for the places of its a.
    """
    names = ["block", "side", "place", "asked", *ROW]

    def cut(batches):
        block = TaskContext.get().partitionId() << 40
        a: dict[tuple, int] = {}
        b: dict[tuple, list[int]] = {}
        n = tokens = 0

        def members():
            rows = [(block, 0, p, None, *r) for r, p in a.items()] + [(block, 1, 0, p, *r) for r, p in b.items()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for doc_a, row_a, doc_b, row_b, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n >= BLOCK_PAIRS or tokens >= BLOCK_TOKENS:
                    yield members()
                    a, b, n, tokens, block = {}, {}, 0, 0, block + 1
                b.setdefault((doc_b, row_b), []).append(a.setdefault((doc_a, row_a), len(a)))
                n, tokens = n + 1, tokens + size
        if n:
            yield members()

    parts = n_pairs // (40 * BLOCK_PAIRS) + 12
    order = ["doc_a", "row_a", "doc_b", "row_b"]
    members = pairs.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, "block long, side int, place int, asked array<int>, doc_id long, row_key long")
    return members.join(table.select(*ROW, *columns), ROW).select(*names, *columns).repartition(parts, "block").sortWithinPartitions("block", "side", "place", *ROW)


def _blocks(batches):
    """The rows of each block in turn: those of side a in order of place, and those of side b."""
    rows = (r for b in slices(batches, 64) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for _, block in itertools.groupby(rows, key=lambda r: r[0]):
        a: list[tuple] = []
        b: list[tuple] = []
        for r in block:
            (b if r[1] else a).append(r)
        yield a, b


def _links(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in range(5)], names=[f.split()[0] for f in PAIRS.split(", ")])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs``, a written table, whose sets link by their tokens. In each block the a sets traverse the prefix tree of the b sets together."""

    def probe(batches):
        for a, b in _blocks(batches):
            probes = Probes([np.frombuffer(r[7], U64) for r in a], [r[6] for r in a])
            hits = tree_matches(probes, [np.frombuffer(r[7], U64) for r in b], [r[6] for r in b], [r[3] for r in b])
            found = [(*a[p][4:6], *r[4:6], r[6]) for r, hit in zip(b, hits, strict=True) for p in hit]
            if found:
                yield _links(found)

    n = pairs.count()
    return in_blocks(pairs, sets, ["size", "tokens"], n).mapInArrow(trimmed(probe), PAIRS)


class Words:
    """The words of a text, and of every distinct shingle the hash and the words of its first occurrence."""

    def __init__(self, text: bytes):
        words = text.translate(bytes(_FOLD)).split()
        self.joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        width = min(WORDS, len(words))
        del words
        hashes = []
        for piece, word in _pieces(self.joined):
            hashes.append(np.asarray([_long_word(piece)], U64) if word else _word_hashes(np.frombuffer(piece, np.uint8))[0])
        self.tokens, first = np.unique(_chained(np.concatenate(hashes), width), return_index=True)
        self.starts, self.ends = starts[first], ends[first + width - 1]

    def overlap(self, other: Words) -> int:
        """How many shingles both have, word by word."""
        _, mine, theirs = np.intersect1d(self.tokens, other.tokens, assume_unique=True, return_indices=True)
        x, y = self.joined, other.joined
        spans = zip(self.starts[mine].tolist(), self.ends[mine].tolist(), other.starts[theirs].tolist(), other.ends[theirs].tolist(), strict=True)
        return sum(x[a:b] == y[c:d] for a, b, c, d in spans)


def confirmed(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v) doc_ids of those of ``links``, a written table, whose texts link word by word. Only texts with a link move, in blocks."""

    def compare(batches):
        for a, b in _blocks(batches):
            known = [Words(r[6].encode()) for r in a]
            found: list[tuple[int, int]] = []
            for r in b:
                mine = Words(r[6].encode())
                for p in r[3]:
                    both = known[p].overlap(mine)
                    if 100 * both >= 75 * (len(known[p].tokens) + len(mine.tokens) - both):
                        found.append((a[p][4], r[4]))
            if found:
                yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    n = links.count()
    side = lambda x: links.select(F.col(f"doc_{x}").alias("doc_id"), F.col(f"row_{x}").alias("row_key"))
    ids = materialize(side("a").unionByName(side("b")).distinct(), "linked")
    texts = keep_rows(rows.select("doc_id", "text", "row_key"), ids, "left_semi").dropDuplicates(ROW)
    return in_blocks(links, texts, ["text"], n).mapInArrow(trimmed(compare), "u long, v long")


def hub_pairs(tokens: DataFrame) -> DataFrame:
    """PAIRS: each row as b with the one hub a that it shares most prefix tokens with. A token's hub is the row of its smallest doc_id."""
    hubs = tokens.groupBy("token").agg(F.min(F.struct(*ROW, "size")).alias("hub"))
    other = "(row_key != hub.row_key OR doc_id != hub.doc_id)"
    met = tokens.join(hubs, "token").filter(f"{other} AND 4 * least(size, hub.size) >= 3 * greatest(size, hub.size)")
    counted = met.groupBy(*ROW, "size", F.col("hub.row_key").alias("row_a"), F.col("hub.doc_id").alias("doc_a")).agg(F.count("*").alias("n"))
    best = counted.groupBy(*ROW, "size").agg(F.max(F.struct(F.col("n"), (-F.col("doc_a")).alias("back"), F.col("row_a"), F.col("doc_a"))).alias("best"))
    return best.select("best.doc_a", "best.row_a", F.col("doc_id").alias("doc_b"), F.col("row_key").alias("row_b"), F.col("size").alias("size_b"))


def _fitting(cell: dict[str, np.ndarray]):
    """(i, j) of the rows of a cell that are in different components, of both its parts where it has two, and meet the length and positional bounds."""
    order = np.lexsort((cell["row_key"], cell["component"]))
    comp, size, place, part = (cell[c][order] for c in ("component", "size", "place", "part"))
    cuts = np.concatenate([[0], np.flatnonzero(comp[1:] != comp[:-1]) + 1, [len(comp)]])
    two = cell["low"][0] != cell["high"][0]
    for begin, d in itertools.pairwise(cuts[:-1].tolist()):
        for c in range(begin, d, 32):  # some rows of a component against all of later ones
            e = min(c + 32, d)
            n, m = size[c:e, None], size[None, d:]
            fits = (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (np.minimum(n - place[c:e, None], m - place[None, d:]) >= least_overlap(n, m))
            if two:
                fits &= part[c:e, None] != part[None, d:]
            i, j = np.nonzero(fits)
            if len(i):
                yield order[c + i], order[d + j]


def open_pairs(tokens: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """PAIRS: rows of different components that share a prefix token and meet the length and positional bounds. Tokens all of whose rows are in one component give nothing.

    The rows of a token are cut in parts of about CELL_ROWS, and every two parts meet in a cell of
    their own, so that a token that very many rows share is compared by as many tasks as it takes.
    """
    names = ["token", "low", "high", "part", *ROW, "size", "place", "component"]

    def emit(batches):
        left = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                table = {c: np.asarray(batch.column(i)) for i, c in enumerate(names)}
                if left is not None:
                    table = {c: np.concatenate([left[c], table[c]]) for c in names}
            elif left is None:
                return
            else:
                table = left
            n = len(table["token"])
            cuts = np.flatnonzero((table["token"][1:] != table["token"][:-1]) | (table["low"][1:] != table["low"][:-1]) | (table["high"][1:] != table["high"][:-1])) + 1
            cuts = [0, *cuts.tolist(), *([n] if batch is None else [])]
            out: list[np.ndarray] = []
            for a, z in itertools.pairwise(cuts):
                cell = {c: v[a:z] for c, v in table.items()}
                for i, j in _fitting(cell) if z - a > 1 else ():
                    doc, row, size = cell["doc_id"], cell["row_key"], cell["size"]
                    swap = (doc[i] > doc[j]) | (doc[i] == doc[j]) & (row[i] > row[j])
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    out.append(np.stack([doc[i], row[i], doc[j], row[j], size[j]]))
            left = {c: v[cuts[-1] :] for c, v in table.items()} if batch is not None else None
            if out:
                yield pa.record_batch([pa.array(c) for c in np.concatenate(out, 1)], names=[f.split()[0] for f in PAIRS.split(", ")])

    labelled = tokens.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = labelled.groupBy("token").agg((F.min("component") != F.max("component")).alias("mixed"), F.count("*").alias("n")).filter("mixed").select("token", F.ceil(F.col("n") / CELL_ROWS).alias("parts"))
    asked = labelled.join(mixed, "token").withColumn("part", F.pmod(F.xxhash64(*ROW), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asked = asked.select("token", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", *ROW, "size", "place", "component")
    cell = ["token", "low", "high"]
    pairs = asked.repartition(buckets, *cell).sortWithinPartitions(*cell, "component").mapInArrow(trimmed(emit), PAIRS)
    return pairs.distinct()


def set_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles) of every row."""

    def count(batches):
        for batch in slices(batches):
            sizes = [len(s) for s in shingle_sets(utf8(batch.column(1)))]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(count), "doc_id long, n_shingles long")


def links_of(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v): the links among candidate pairs, as a written table."""
    pairs = materialize(pairs, "pairs")
    found = materialize(verified(pairs, sets), "found")
    links = materialize(confirmed(found, rows), "links", frees=True)
    discard(pairs, found)
    return links


def link_components(docs: DataFrame) -> DataFrame:
    """(node, component) of all doc_ids that have links."""
    rows = held_rows(docs).filter("text != ''")
    copies = materialize(later_copies(rows), "copies")
    firsts = keep_rows(rows, copies, "left_anti")
    n_bytes = firsts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    near = materialize(near_candidates(firsts, max(12, n_bytes // (14 * BUCKET_ENTRIES) + 1)), "near", frees=True)
    n_tokens = near.agg(F.sum("size")).first()[0] or 0
    sets = materialize(ordered_sets(firsts, near, max(12, n_tokens // BUCKET_ENTRIES + 1)), "sets", frees=True)
    tokens = materialize(prefix_tokens(sets), "prefixes")
    first = links_of(hub_pairs(tokens), sets, rows)
    labels = materialize(connected_components(first), "labels")
    second = links_of(open_pairs(tokens, labels, tokens.count() // BUCKET_ENTRIES + 12), sets, rows)
    discard(near, sets, tokens, labels)
    spaces = rows.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # texts without words link with nothing, copies neither
    same = copies.join(keep_rows(spaces, copies, "left_semi").select(*ROW).distinct(), ROW, "left_semi")
    links = first.unionByName(second).unionByName(same.select(F.col("doc_id").alias("u"), F.col("first_id").alias("v")))
    return connected_components(links)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).

    A-Z are lower-cased, words are runs of other than white space. A document with fewer than five
    words is one shingle; null, empty or blank texts have none and link with nothing. Rows that share
    a doc_id are one node with the links of all of them, and each is reported with its own set size;
    repeated rows alike. A null doc_id links with nothing and has a null component. An empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    labels = materialize(link_components(docs), "labels")
    sizes = set_sizes(docs)
    return sizes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
