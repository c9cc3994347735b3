"""Documents as rows of term numbers and counts, and their scores for a set of queries, found row by row.

A document's score depends on its own terms alone, so nothing of it has to meet in a shuffle: tasks
score blocks of rows against all queries at once, and only what is asked for leaves a task, such as the
best of each query, a histogram of its scores, or the scores of given pairs. The queries are a table of a
stated size (``shared.Sized``); the documents stay a table of any size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..shared import sized, written
from . import quantile

#: Scores, and products that are summed to them, that a step of a task holds; distinct pairs of words that a task counts before it passes them on; words whose terms a task counts at once.
CELLS, HELD, AT_ONCE = 1_000_000, 1_000_000, 4_000_000
#: Rows and bytes of text that a step of a task takes, and cells of a table of counts.
ROWS, BYTES, DENSE = 1024, 8_000_000, 8_000_000
#: Bytes that stand in words: all but Java's white space; or letters, digits, underscores and what isn't ASCII.
UNBLANK = np.array([b not in b"\t\n\x0b\f\r " for b in range(256)])
WORD = np.array([b >= 128 or chr(b).isalnum() or b == ord("_") for b in range(256)])
#: Lower case of ASCII, and of the second byte of U+00C0 to U+00FF.
_LOWER = bytes(range(256)).lower()
_LATIN = np.array([b + 0x20 if 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256)], np.uint8)
#: First bytes, and the second ones with which they are no letter or number: of Latin-1 and of general punctuation.
_SIGNS = [(0xC2, np.array([b not in b"\xaa\xb2\xb3\xb5\xb9\xba\xbc\xbd\xbe" for b in range(256)])), (0xC3, np.array([b in b"\x97\xb7" for b in range(256)])), (0xE2, np.array([b == 0x80 for b in range(256)]))]
_NO_WORD = re.compile(r"[^\x00-\x7F\w]")


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many values each row has, and all values; a null row has none."""
    n = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return n, column.flatten()


def arrays(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def lists(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many terms each row has, their numbers, their counts) of a batch with columns at and n from ``first`` on."""
    sizes, at = _flat(batch.column(first))
    return sizes, np.asarray(at).astype(np.int64), np.asarray(_flat(batch.column(first + 1))[1])


class Vocabulary:
    """Numbers of terms, which are single words or, with ``pairs``, two words with a blank between them. ``words`` are the numbered words, where they are not just those of the terms."""

    def __init__(self, terms: Sequence[str], pairs: bool = False, words: Sequence[str] | None = None):
        self.terms = list(terms)
        split = [t.split(" ") if pairs else [t] for t in self.terms]
        self.words = sorted({w for s in split for w in s}) if words is None else list(words)
        place = {w: i for i, w in enumerate(self.words)}
        self.single = np.full(len(self.words) + 1, -1)  # the last is no word
        codes = []
        for i, s in enumerate(split):
            if len(s) == 1:
                self.single[place[s[0]]] = i
            else:
                codes.append((place[s[0]] * len(self.words) + place[s[1]], i))
        self.codes, self.code_of = (np.array(x, np.int64) for x in (zip(*sorted(codes), strict=True) if codes else ((), ())))
        self.before, self.behind = np.zeros((2, len(self.words) + 1), bool)  # which words stand in a pair, first and second
        if codes:
            self.before[self.codes // len(self.words)] = self.behind[self.codes % len(self.words)] = True


@dataclass
class Cut:
    """How texts are cut into words in their tasks: lower-cased unless ``lower`` is False, then runs of the bytes ``inside``, of ``least`` characters at least.

    Bytes are enough for ASCII, Latin-1 and general punctuation (U+2000 to U+203F); texts with other
    characters are lower-cased and blanked by Python's Unicode tables first. These agree with Spark's but for
    characters that came after Unicode 13, which count as letters here.
    """

    inside: np.ndarray
    least: int = 1
    lower: bool = True

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """How many words each text has, and all words; a null text has none."""
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        data, ends = raw(texts)
        if not len(data):
            return np.zeros(len(texts), np.int64), pa.array([], pa.string())
        letters = self.inside is WORD or bool((self.inside == WORD).all())
        if self.lower or letters:
            odd = np.flatnonzero(data >= 0xC4)
            odd = odd[(data[odd] != 0xE2) | (data[np.minimum(odd + 1, len(data) - 1)] != 0x80)]
            if len(odd):
                data, ends = raw(self._plain(texts, np.unique(np.searchsorted(ends, odd, "right") - 1), letters))
        if self.lower:
            data = np.frombuffer(bytearray(data).translate(_LOWER), np.uint8)
            at = np.flatnonzero(data[:-1] == 0xC3) + 1
            data[at] = _LATIN[data[at]]
        held = np.frombuffer(bytearray(data).translate(self.inside.astype(np.uint8).tobytes()), bool)
        if letters:
            for lead, sign in _SIGNS:
                at = np.flatnonzero(data[:-1] == lead)
                at = at[sign[data[at + 1]]]
                held[at] = held[at + 1] = False
                if lead == 0xE2:
                    held[np.minimum(at + 2, len(data) - 1)] = False
        edge = np.empty(len(data) + 1, bool)  # whether a word may not go on from the byte before
        edge[0] = edge[-1] = True
        np.logical_not(held[:-1], out=edge[1:-1])
        edge[ends] = True
        starts = np.flatnonzero(held & edge[:-1])
        np.logical_not(held, out=edge[:-1])
        edge[ends] = True
        stops = np.flatnonzero(held & edge[1:]) + 1
        if self.least > 1:
            later = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])  # bytes that are not a character's first
            enough = stops - starts - (later[stops] - later[starts]) >= self.least
            gone = np.zeros(len(data) + 1, np.int8)
            gone[starts[~enough]] += 1
            gone[stops[~enough]] -= 1
            held &= np.cumsum(gone[:-1]) == 0
            starts, stops = starts[enough], stops[enough]
        upto = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(upto), pa.py_buffer(np.compress(held, data)))
        return np.diff(np.searchsorted(starts, ends)), words

    def _plain(self, texts: pa.Array, rows: np.ndarray, letters: bool) -> pa.Array:
        """``texts``, of which some ``rows`` have characters of other scripts: these lower-cased, and blanks for what is no letter or digit."""
        held = texts.cast(pa.binary()).to_pylist()
        for i in rows:
            text = held[i].decode(errors="replace")
            text = text.lower() if self.lower else text
            held[i] = (_NO_WORD.sub(" ", text) if letters else text).encode()
        return pa.array(held, pa.binary()).cast(pa.string())


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and where each one begins and the last ends."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's ``round`` of doubles: half up by their shortest decimal digits. Only where a value may be half way are these looked at."""
    scale = 10.0**digits
    y = x * scale
    out = np.rint(y) / scale + 0.0  # no negative zero
    for i in np.flatnonzero(np.abs(np.abs(y - np.trunc(y)) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _type(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _parts(batches: Iterator[pa.RecordBatch], text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows, and where the column ``text`` holds texts, of bounded bytes or one row."""
    for batch in batches:
        texts = None if text is None or not pa.types.is_string(batch.column(text).type) else batch.column(text)
        if texts is None:
            yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))
            continue
        upto, at = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))]), 0
        while at < batch.num_rows:
            last = max(at + 1, min(at + ROWS, int(np.searchsorted(upto, upto[at] + BYTES, "right")) - 1))
            yield batch.slice(at, last - at)
            at = last


def _keep(rows: DataFrame, keys: list[str], more: str) -> StructType:
    return StructType([*[rows.schema[k] for k in keys], *_type(more)])


def word_counts(rows: DataFrame, cut: Cut) -> DataFrame:
    """(term, n): how often each word stands in the texts ``w``. Counted in a task first, so that few rows a word move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, held = [], 0
        for batch in _parts(batches, 0):
            coded = cut(batch.column(0))[1].dictionary_encode()
            n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
            fresh.append(pa.table([coded.dictionary, pa.array(n, pa.int64())], names=["term", "k"]))
            held += len(n)
            if held > HELD:
                fresh = [summed(fresh)]
                held = fresh[0].num_rows
                if held > HELD // 2:
                    yield from fresh[0].to_batches()
                    fresh, held = [], 0
        if fresh:
            yield from summed(fresh).to_batches()

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("term").aggregate([("k", "sum")]).select(["term", "k_sum"]).rename_columns(["term", "k"])

    return rows.select("w").mapInArrow(run, "term string, k bigint").groupBy("term").agg(F.sum("k").alias("n"))


def frequent(rows: DataFrame, cut: Cut, most: int) -> DataFrame:
    """(term, n, bound): the ``most`` words and the ``most`` pairs of neighbouring words at most that stand most often in a share of the texts ``w``, and how often. No other term stands there more than ``bound`` times, which a row without a term tells once a share. A share is what a task holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, held = [], 0
        for batch in _parts(batches, 0):
            cuts.append(cut(batch.column(0)))
            held += len(cuts[-1][1])
            if held >= AT_ONCE:
                yield share(cuts)
                cuts, held = [], 0
        if held:
            yield share(cuts)

    def often(n: np.ndarray) -> tuple[np.ndarray, int]:
        """Which of the counts are the highest, and the highest of the others."""
        bound = int(np.partition(n, len(n) - most - 1)[len(n) - most - 1]) if len(n) > most else 0
        return np.flatnonzero(n > bound), bound

    def share(cuts: list[tuple[np.ndarray, pa.Array]]) -> pa.RecordBatch:
        sizes = np.concatenate([n for n, _ in cuts])
        coded = pa.chunked_array([words for _, words in cuts]).combine_chunks().dictionary_encode()
        index = np.asarray(coded.indices)
        n = np.bincount(index)
        high, bound = often(n)
        words, number = coded.dictionary.take(pa.array(high)), np.full(len(n), -1, np.int64)
        number[high] = np.arange(len(high))
        number = number[index]
        there, size = number >= 0, max(1, len(high))
        pairs, k = tallied(_pairs(np.repeat(np.arange(len(sizes)), sizes), number, size, there, there)[1], size * size)
        best, least = often(k)  # a pair with another word is no more frequent than that word
        both = pc.binary_join_element_wise(words.take(pa.array(pairs[best] // size)), words.take(pa.array(pairs[best] % size)), " ")
        terms = pa.chunked_array([words, both, pa.array([None], pa.string())]).combine_chunks()
        return pa.record_batch([terms, pa.array(np.concatenate([n[high], k[best], [0]])), pa.array(np.full(len(terms), max(bound, least)))], names=["term", "n", "bound"])

    return rows.select("w").mapInArrow(run, "term string, n bigint, bound bigint")


def holders(rows: DataFrame, key: str, asked: list[tuple], cut: Cut, id_type) -> DataFrame:
    """(query_id, key) of texts ``w`` that hold a passage; ``asked`` are (query_id, passage, a word of it), and only texts with this word are searched."""
    fields = [StructField("query_id", id_type), rows.schema[key]]
    words = sorted({a[2] for a in asked})
    place, of = {w: i for i, w in enumerate(words)}, [[] for _ in words]
    for q, passage, w in asked:
        of[place[w]].append((q, passage.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(words, pa.string()), len(words)
        for batch in _parts(batches, 1):
            _, row, number = rowed(batch.column(1), cut, known)
            there = number >= 0
            data, ends = raw(pc.fill_null(batch.column(1), ""))
            found, data = [], data.tobytes()
            for c in np.unique(row[there] * size + number[there]).tolist():
                r, w = divmod(c, size)
                found += [(q, r) for q, passage in of[w] if data.find(passage, ends[r], ends[r + 1]) >= 0]
            yield pa.record_batch([pa.array([f[0] for f in found], to_arrow_type(id_type)), batch.column(0).take(pa.array([f[1] for f in found], pa.int64()))], names=["query_id", key])

    return rows.select(key, "w").mapInArrow(run, StructType(fields))


def _pairs(row: np.ndarray, number: np.ndarray, n: int, before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of words that stand side by side in a row, where ``before`` and ``behind`` (per word) allow the first and the second."""
    near = np.flatnonzero(before[:-1] & behind[1:] & (row[1:] == row[:-1]))
    return row[near], number[near] * n + number[near + 1]


def rowed(texts: pa.Array, cut: Cut, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many words each text has; row, number of all words); -1 for a word that is not ``known``."""
    n, words = cut(texts)
    return n, np.repeat(np.arange(len(n)), n), np.asarray(pc.fill_null(pc.index_in(words, value_set=known), -1)).astype(np.int64)


def tallied(codes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, in order, and how often each occurs: in a table of ``cells``, or sorted where that were large or mostly empty."""
    if cells <= min(DENSE, 4 * len(codes)):
        n = np.bincount(codes, minlength=1)
        every = np.flatnonzero(n)
        return every, n[every]
    codes = np.sort(codes.astype(np.int32) if cells < 2**31 else codes)
    first = np.flatnonzero(np.concatenate([[len(codes) > 0], codes[1:] != codes[:-1]]))
    return codes[first].astype(np.int64), np.diff(first, append=len(codes))


def counted(rows: DataFrame, keys: list[str], vocabulary: Vocabulary, cut: Cut, length: str | None = None) -> DataFrame:
    """(keys, at, n): the numbers of a row's terms, in order, and how often each stands in its text ``w``; ``length`` names a column for the number of its words, null for no text. Every row has one."""
    names = [*keys, *([length] if length else []), "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.words, pa.string())
        size = max(1, len(vocabulary.terms))
        for batch in _parts(batches, len(keys)):
            texts = batch.column(len(keys))
            lengths, row, number = rowed(texts, cut, known)
            at = vocabulary.single[number]
            found = [(row[at >= 0], at[at >= 0])]
            if len(vocabulary.codes):
                r, code = _pairs(row, number, len(vocabulary.words), vocabulary.before[number], vocabulary.behind[number])
                i = np.minimum(np.searchsorted(vocabulary.codes, code), len(vocabulary.codes) - 1)
                there = vocabulary.codes[i] == code
                found.append((r[there], vocabulary.code_of[i[there]]))
            every, n = tallied(np.concatenate([r * size + t for r, t in found]), batch.num_rows * size)
            sizes = np.bincount(every // size, minlength=batch.num_rows)
            more = [pa.array(lengths, pa.int64(), mask=np.asarray(texts.is_null()))] if length else []
            yield pa.record_batch([*batch.columns[: len(keys)], *more, arrays(sizes, pa.array(every % size, pa.int32())), arrays(sizes, pa.array(n, pa.int64()))], names=names)

    return rows.select(*keys, "w").mapInArrow(run, _keep(rows, keys, (f"{length} bigint, " if length else "") + "at array<int>, n array<bigint>"))


def rows_with(rows: DataFrame, words: list[str], cut: Cut) -> DataFrame:
    """(at, n): the numbers of ``words``, and how many texts ``w`` have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size, n = pa.array(words, pa.string()), len(words), np.zeros(len(words), np.int64)
        for batch in _parts(batches, 0):
            _, row, number = rowed(batch.column(0), cut, known)
            there = number >= 0
            n += np.bincount(np.unique(row[there] * size + number[there]) % size, minlength=size)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], names=["at", "k"])

    return rows.select("w").mapInArrow(run, "at bigint, k bigint").groupBy("at").agg(F.sum("k").alias("n"))


def held_by(rows: DataFrame, n_terms: int) -> np.ndarray:
    """How many of the counted rows (at, n) have each term."""
    return totals(rows, n_terms)[0]


def totals(rows: DataFrame, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the counted rows (at, n) have each term, and how often it stands in them; counted in a task first, so that a row per term moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stands = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        for batch in batches:
            _, at, n = lists(batch, 0)
            held += np.bincount(at, minlength=n_terms)
            stands += np.bincount(at, n, n_terms).astype(np.int64)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at), pa.array(held[at]), pa.array(stands[at])], names=["at", "k", "n"])

    out = np.zeros((2, n_terms), np.int64)
    for r in rows.select("at", "n").mapInArrow(run, "at bigint, k bigint, n bigint").groupBy("at").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).collect():  # one per term
        out[:, r["at"]] = r["k"], r["n"]
    return out[0], out[1]


def terms_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(term, keys, tf): the distinct words of each row's array ``w``, with how often each stands there. Rows are counted where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            n, flat = _flat(batch.column(len(keys)))
            coded = flat.dictionary_encode()
            size = max(1, len(coded.dictionary))
            every, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + np.asarray(coded.indices), return_counts=True)
            row = pa.array(every // size)
            yield pa.record_batch([coded.dictionary.take(pa.array(every % size)), *[c.take(row) for c in batch.columns[: len(keys)]], pa.array(tf, pa.int64())], names=["term", *keys, "tf"])

    return rows.select(*keys, "w").mapInArrow(run, StructType([*_type("term string"), *[rows.schema[k] for k in keys], *_type("tf bigint")]))


def word_pairs(rows: DataFrame, words: list[str], cut: Cut) -> DataFrame:
    """(term, n) of pairs of ``words`` that stand side by side in the texts ``w``; counted in a task first, so that few rows a pair move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(words, pa.string()), max(1, len(words))
        send = lambda codes, counts: pa.record_batch([pa.array(codes), pa.array(counts)], names=["pair", "k"])
        codes, counts, fresh, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        for batch in _parts(batches, 0):
            _, row, number = rowed(batch.column(0), cut, known)
            there = number >= 0
            fresh.append(_pairs(row, number, size, there, there)[1])
            held += len(fresh[-1])
            if held > 4 * HELD:
                codes, counts = _added(codes, counts, *tallied(np.concatenate(fresh), size * size))
                fresh, held = [], 0
                if len(codes) > HELD:
                    yield send(codes, counts)
                    codes, counts = codes[:0], counts[:0]
        if fresh:
            codes, counts = _added(codes, counts, *tallied(np.concatenate(fresh), size * size))
        yield send(codes, counts)

    n = rows.select("w").mapInArrow(run, "pair bigint, k bigint").groupBy("pair").agg(F.sum("k").alias("n"))
    names = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"i": pa.array(range(len(words)), pa.int64()), "word": pa.array(words, pa.string())})))  # as many as are counted
    of = n.select(F.expr(f"pair div {max(1, len(words))}").alias("a"), (F.col("pair") % max(1, len(words))).alias("b"), "n")
    return of.join(names.select(F.col("i").alias("a"), F.col("word").alias("x")), "a").join(names.select(F.col("i").alias("b"), F.col("word").alias("y")), "b").select(F.concat_ws(" ", "x", "y").alias("term"), "n")


def _added(codes: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tallies, each in order, as one."""
    if not len(codes):
        return more, n
    both = np.concatenate([codes, more])
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[first], np.add.reduceat(np.concatenate([counts, n])[order], first)


def shared_keys(docs: DataFrame, keys: list[str]) -> bool:
    """Whether several rows have one key."""
    return not docs.groupBy(*keys).agg(F.count("*").alias("k")).filter("k > 1").isEmpty()


def merged(rows: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """Counted rows (keys, at, n) that share ``keys`` and ``by``, as one."""
    each = rows.select(*keys, *by, F.explode(F.arrays_zip("at", "n")).alias("t")).groupBy(*keys, *by, "t.at").agg(F.sum("t.n").alias("n"))
    return _collected(each, [*keys, *by])


def _collected(each: DataFrame, keys: list[str]) -> DataFrame:
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("t")).select(*keys, "t.at", "t.n")


def valued(rows: DataFrame, keys: list[str], value: Callable) -> DataFrame:
    """(keys, at, n): for n, the sum of ``value`` over the rows of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            names = batch.schema.names
            sizes, at, n = lists(batch, names.index("at"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.record_batch([*[batch.column(names.index(k)).take(pa.array(row)) for k in keys], pa.array(at), pa.array(value(at, n, row, batch))], names=[*keys, "at", "v"])

    each = rows.mapInArrow(run, _keep(rows, keys, "at bigint, v double"))
    return _collected(each.groupBy(*keys, "at").agg(F.sum("v").alias("n")), keys)


class Scores:
    """Scores of rows (keys, at, n and what ``value`` needs) for queries (query_id, term number, weight).

    ``value`` gives a term's weight in its row from arrays (term number, count, row, the batch). A row
    scores for a query where it has one of its terms, as all weights are positive. Scores are rounded
    to nine decimals, and then to ``digits``.
    """

    def __init__(self, rows: DataFrame, keys: list[str], asked: list[tuple], n_terms: int, value: Callable, digits: int = 9, id_type=None):
        self.rows, self.keys, self.value, self.digits = rows, keys, value, digits
        self.ids = sorted({a[0] for a in asked}, key=lambda q: (q is not None, q))
        self.id_type = id_type or LongType()
        place = {q: i for i, q in enumerate(self.ids)}
        of = sorted((t, place[q], w) for q, t, w in asked)
        self.query, self.weight = np.array([o[1] for o in of], np.int64), np.array([o[2] for o in of], np.float64)
        self.start = np.searchsorted(np.array([o[0] for o in of], np.int64), np.arange(n_terms + 1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rows"}  # tasks get their rows from Spark

    def _blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores of a block of rows for all queries); 0 where a row has none of a query's terms."""
        names = batch.schema.names
        sizes, at, n = lists(batch, names.index("at"))
        row = np.repeat(np.arange(len(sizes)), sizes)
        value = self.value(at, n, row, batch)
        many = self.start[at + 1] - self.start[at]
        upto = np.concatenate([[0], np.cumsum(np.bincount(row, many, len(sizes)))])
        ends, first, width = np.concatenate([[0], np.cumsum(sizes)]), 0, len(self.ids)
        while first < len(sizes):
            last = min(max(first + 1, np.searchsorted(upto, upto[first] + CELLS, "right") - 1), first + max(1, CELLS // width))
            here = slice(ends[first], ends[last])
            m, total = many[here], int(many[here].sum())
            i = np.repeat(self.start[at[here]] - np.cumsum(m) + m, m) + np.arange(total)
            flat = np.repeat((row[here] - first) * width, m) + self.query[i]
            score = np.bincount(flat, np.repeat(value[here], m) * self.weight[i], (last - first) * width).reshape(-1, width)
            there = score > 0
            score = np.round(np.round(score, 9), self.digits)
            yield first, np.where(there, score, np.nan)
            first = last

    def _run(self, rows: DataFrame, f: Callable, ddl: str, keyed: bool = True) -> DataFrame:
        fields = [StructField("query_id", self.id_type), *([rows.schema[k] for k in self.keys] if keyed else []), *_type(ddl)]
        return rows.mapInArrow(f, StructType(fields))

    def _found(self, batch: pa.RecordBatch, first: int, row: np.ndarray, query: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        take = pa.array(first + row)
        keys = [batch.column(batch.schema.names.index(k)).take(take) for k in self.keys]
        return pa.record_batch([self._ids().take(pa.array(query)), *keys, pa.array(score)], names=["query_id", *self.keys, "score"])

    def _ids(self) -> pa.Array:
        return pa.array(self.ids, to_arrow_type(self.id_type))

    def pairs(self, of: Callable[[np.ndarray, np.ndarray], np.ndarray] = lambda score, query: score) -> DataFrame:
        """(query_id, keys, score) of all rows that score; ``of`` makes what is returned from arrays of scores and places of their queries."""

        def run(batches):
            for batch in batches:
                for first, score in self._blocks(batch):
                    row, query = np.nonzero(~np.isnan(score))
                    yield self._found(batch, first, row, query, of(score[row, query], query))

        return self._run(self.rows, run, "score double") if self.ids else self._none()

    def shares(self, p: float, digits: int) -> DataFrame:
        """(query_id, keys, score): as ``pairs``, as shares of the percentile ``p`` of the query's positive scores, clipped to 0 and 1; as they are where there is none."""
        place, most = {q: i for i, q in enumerate(self.ids)}, np.full(len(self.ids), np.nan)
        for r in self.percentile(p).collect():  # one per query
            most[place[r["query_id"]]] = r["percentile"]

        def of(score: np.ndarray, query: np.ndarray) -> np.ndarray:
            by = most[query]
            return rounded(np.where(np.isnan(by), score, np.clip(score / by, 0.0, 1.0)), digits)

        return self.pairs(of)

    def _none(self) -> DataFrame:
        fields = [StructField("query_id", self.id_type), *[self.rows.schema[k] for k in self.keys], StructField("score", DoubleType())]
        return self.rows.sparkSession.createDataFrame([], StructType(fields))

    def top(self, k: int) -> DataFrame:
        """(query_id, keys, score, rank): the ``k`` best rows of each query; ties go to the smaller key. A task passes on what can be among them."""

        def run(batches):
            best = np.full((k, len(self.ids)), -np.inf)  # of what the task has met
            for batch in batches:
                place = None
                for first, score in self._blocks(batch):
                    score = np.nan_to_num(score, nan=-np.inf)
                    near = (score >= best.min(0)) & (score > -np.inf)
                    best = np.partition(np.concatenate([best, score[near.any(1)]]), -k, axis=0)[-k:]
                    row, query = np.nonzero(near & (score >= best.min(0)))
                    if len(row) > k * len(self.ids):  # many ties
                        if place is None:
                            order = pc.sort_indices(pa.table([batch.column(batch.schema.names.index(c)) for c in self.keys], names=self.keys), sort_keys=[(c, "ascending") for c in self.keys], null_placement="at_start")
                            place = np.argsort(np.asarray(order))
                        order = np.lexsort((place[first + row], -score[row, query], query))
                        among = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                        row, query = row[order][among < k], query[order][among < k]
                    if len(row):
                        yield self._found(batch, first, row, query, score[row, query])

        found = self._run(self.rows, run, "score double") if self.ids else self._none()
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *self.keys))
        return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)

    def of(self, wanted: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(query_id, keys, score) of the pairs in ``wanted`` (query_id, keys) that score; ``side`` makes a small table a side of a join."""
        place = {q: i for i, q in enumerate(self.ids)}
        asked = wanted.groupBy(*self.keys).agg(F.collect_set("query_id").alias("queries"))
        rows = self.rows.join(side(asked), self.keys)

        def run(batches):
            for batch in batches:
                n, queries = _flat(batch.column(batch.schema.names.index("queries")))
                row, query = np.repeat(np.arange(len(n)), n), np.array([place.get(q, -1) for q in queries.to_pylist()], np.int64)
                for first, score in self._blocks(batch):
                    here = (row >= first) & (row < first + len(score)) & (query >= 0)
                    r, q = row[here] - first, query[here]
                    there = ~np.isnan(score[r, q])
                    yield self._found(batch, first, r[there], q[there], score[r, q][there])

        return self._run(rows, run, "score double") if self.ids else self._none()

    def percentile(self, p: float) -> DataFrame:
        """(query_id, n, percentile) of each query's positive scores, as ``quantile.percentile``; the scores are found anew for each narrowing and never stored."""
        if not self.ids:
            return quantile.percentile(self._none(), "query_id", "score", p)
        state = sized(quantile.wanted(self._bounds(), "query_id", p), "ranks")
        while not state.table.filter((F.col("inside") > quantile.SORTED) & (F.col("low") < F.col("high"))).isEmpty():
            bins = self._bins(state.table.collect())  # two ranks a query
            state = sized(quantile.held(bins, "query_id"), "ranks")
        open_ = state.table.filter("low < high")
        values = self._inside(open_.collect()) if not open_.isEmpty() else self._none()
        rows = written(values.select("query_id", "score"), "values")
        return quantile.ended(rows, "query_id", "score", state, open_)

    def _bounds(self) -> DataFrame:
        def run(batches):
            n, low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), np.inf), np.full(len(self.ids), -np.inf)
            for batch in batches:
                for _, score in self._blocks(batch):
                    there = score > 0
                    n += there.sum(0)
                    low, high = np.minimum(low, np.where(there, score, np.inf).min(0)), np.maximum(high, np.where(there, score, -np.inf).max(0))
            q = np.flatnonzero(n)
            yield pa.record_batch([self._ids().take(pa.array(q)), pa.array(n[q]), pa.array(low[q]), pa.array(high[q])], names=["query_id", "n", "low", "high"])

        return self._run(self.rows, run, "n bigint, low double, high double", keyed=False).groupBy("query_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    def _ranges(self, state: list) -> list[tuple]:
        """(place of the query, its row of the state), the ranges of ranks."""
        place = {q: i for i, q in enumerate(self.ids)}
        return [(place[s["query_id"]], s) for s in state]

    def _bins(self, state: list) -> DataFrame:
        """The histograms of the ranges in ``state``, as ``quantile.held`` takes them."""
        ranges, several = self._ranges(state), {}
        of = [several.setdefault((q, s["low"], s["high"]), len(several)) for q, s in ranges]  # two ranks of a query often share a range
        at = np.array([q for q, _, _ in several], np.int64)
        low, high = np.array([x[1:] for x in several], np.float64).T
        width, size = np.where(high > low, high - low, 1.0), quantile.BINS

        def run(batches):
            n = np.zeros(len(at) * size, np.int64)
            least, most = np.full(len(at) * size, np.inf), np.full(len(at) * size, -np.inf)
            for batch in batches:
                for _, score in self._blocks(batch):
                    s = score[:, at]
                    row, r = np.nonzero((s > 0) & (s >= low) & (s <= high))
                    v = s[row, r]
                    b = r * size + np.minimum((v - low[r]) / width[r] * size, size - 1).astype(np.int64)
                    n += np.bincount(b, minlength=len(n))
                    np.minimum.at(least, b, v)
                    np.maximum.at(most, b, v)
            b = np.flatnonzero(n)
            yield pa.record_batch([pa.array(b // size), pa.array(b % size), pa.array(n[b]), pa.array(least[b]), pa.array(most[b])], names=["range", "bin", "inside", "low", "high"])

        kinds = {"query_id": to_arrow_type(self.id_type), "n": pa.int64(), "position": pa.float64(), "rank": pa.int64(), "below": pa.int64()}
        named = pa.table({"range": pa.array(of, pa.int64())} | {c: pa.array([s[c] for _, s in ranges], kind) for c, kind in kinds.items()})
        of = F.broadcast(self.rows.sparkSession.createDataFrame(named))
        bins = self.rows.mapInArrow(run, "range bigint, bin bigint, inside bigint, low double, high double").groupBy("range", "bin").agg(F.sum("inside").alias("inside"), F.min("low").alias("low"), F.max("high").alias("high"))
        return bins.join(of, "range").drop("range")

    def _inside(self, state: list) -> DataFrame:
        """(query_id, score) of the scores in one of a query's ranges, once each; ranges hold few."""
        ranges = self._ranges(state)
        low, high = np.full((2, len(self.ids)), np.inf), np.full((2, len(self.ids)), -np.inf)
        used = np.zeros(len(self.ids), np.int64)
        for q, s in ranges:
            low[used[q], q], high[used[q], q] = s["low"], s["high"]
            used[q] += 1

        def run(batches):
            for batch in batches:
                for _, score in self._blocks(batch):
                    row, q = np.nonzero((score > 0) & (((score >= low[0]) & (score <= high[0])) | ((score >= low[1]) & (score <= high[1]))))
                    yield pa.record_batch([self._ids().take(pa.array(q)), pa.array(score[row, q])], names=["query_id", "score"])

        return self._run(self.rows, run, "score double", keyed=False)
