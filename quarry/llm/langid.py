"""Language ID by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier per bit predicts on which side of the
codeword table a text lies. Decoding sums each codeword's losses, weighted by how well each
classifier did on that language, and takes the nearest; a small lead over the next one is flagged as
ambiguous. Texts are read whole; the classifiers are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, trimmed

UNDETERMINED = "und"
FEATURES = 4096
#: Labelled rows to fit on, shared evenly between the languages, and rows of each language at least: every language is learned.
SAMPLE_ROWS, LEAST_ROWS = 3200, 2
#: A lead below this share of the nearest codeword's loss counts as ambiguous.
AMBIGUOUS_LEAD = 0.05
#: Of held-out labelled texts that the decoder names rightly, the share that may lie beyond the distance that ``unlike_bound`` starts from; and the bins in which distances from 0 to 1 are counted.
BEYOND, BINS = 1e-5, 1000
#: The distance of texts of fewer letters isn't told.
LEAST_LETTERS = 100

_ROWS = "lang_pred string, score double, ambiguous boolean"


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    letter = np.zeros(256, bool)
    letter[ord("a") : ord("z") + 1] = letter[128:] = True
    table[~letter] = 32
    return table


_TABLE = _byte_table()


def features(text: str, size: int = FEATURES) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples of the lower-cased whole text; digits and ASCII signs count as spaces."""
    b = _TABLE[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    pairs = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - size.bit_length() + 1)
    counts = np.bincount(pairs >> shift, minlength=size) + np.bincount(triples >> shift, minlength=size)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def letters(text: str) -> int:
    """Bytes of the lower-cased text that ``features`` doesn't count as spaces."""
    return int((_TABLE[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)] != 32).sum())


def code_table(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of ±1, a row per language: all splits for up to 7, else the best of some random tables by least distance."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        bits = [[1 if i == 0 or not (j >> (i - 1)) & 1 else -1 for j in range(1, 1 << (n - 1))] for i in range(n)]
        return np.asarray(bits, np.float32)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    # where there are very many languages, fewer tables are tried and their distances taken in slices
    tables = (t for t in (rng.choice([-1.0, 1.0], (n, width)) for _ in range(50 if n <= 400 else 3)) if (np.abs(t.sum(0)) < n).all())

    def least(t: np.ndarray) -> float:
        nearest = -np.inf
        for at in range(0, n, 1024):
            likeness = t[at : at + 1024] @ t.T
            likeness[np.arange(len(likeness)), np.arange(at, at + len(likeness))] = -np.inf
            nearest = max(nearest, likeness.max())
        return (width - nearest) / 2

    return max(tables, key=least).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of every text to every codeword."""
        margins = x @ self.weights + self.bias
        return np.stack([np.logaddexp(0, -margins * code) @ trust for code, trust in zip(self.codes, self.trust, strict=True)], 1)

    def decide(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0 to 1 and ambiguity of every row."""
        losses = self.losses(x)
        if losses.shape[1] == 1:
            return [self.languages[0]] * len(x), np.ones(len(x)), np.zeros(len(x), bool)
        order = np.argsort(losses, 1, kind="stable")
        best, second = (np.take_along_axis(losses, order[:, i : i + 1], 1)[:, 0] for i in (0, 1))
        likely = np.exp(losses.min(1, keepdims=True) - losses)
        return [self.languages[i] for i in order[:, 0]], 1 / likely.sum(1), second - best < AMBIGUOUS_LEAD * np.maximum(best, 1e-9)

    def distance(self, x: np.ndarray) -> np.ndarray:
        """The nearest codeword's loss as a share of the mean loss, 0 to 1: near 1, all codewords are about as far. Between two languages an even mix is so, too, so fewer than three tell nothing and give 0."""
        losses = self.losses(x)
        return losses.min(1) / np.maximum(losses.mean(1), 1e-30) if losses.shape[1] > 2 else np.zeros(len(x))


def fit(x: np.ndarray, labels: list[str], rounds: int = 150, step: float = 40.0, decay: float = 1e-5) -> Model:
    """Logistic classifiers for all bits at once, by accelerated gradient steps; each language has the same total weight."""
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    codes = code_table(len(languages))
    targets = codes[y]
    share = (1 / np.bincount(y, minlength=len(languages)) / len(languages))[y].astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], codes.shape[1]), np.float32)
    bias, last, last_bias = np.zeros(codes.shape[1], np.float32), w, np.zeros(codes.shape[1], np.float32)
    for k in range(rounds if len(languages) > 1 else 0):
        ahead = k / (k + 3)
        v, vb = w + ahead * (w - last), bias + ahead * (bias - last_bias)
        pull = -targets * share / (1 + np.exp(np.clip(targets * (x @ v + vb), -30, 30)))
        last, last_bias = w, bias
        w, bias = v - step * (x.T @ pull + decay * v), vb - 0.1 * step * pull.sum(0)
    right = (np.sign(x @ w + bias) == targets).astype(np.float64)
    trust = np.stack([right[y == i].mean(0) for i in range(len(languages))]) + 1e-3
    return Model(languages, codes, w, bias, trust / trust.sum(1, keepdims=True))


def fold_of(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def sample_cuts(rows: DataFrame, sample_rows: int) -> DataFrame | None:
    """(lang, cut): of each language in ``rows`` (lang, h) the hash up to which its rows are learned from; None without rows.

    Each language has the same number of distinct hashes, or all it has. Rows far above the expected
    cut are dropped where they are, so a language with very many rows sends few of them to be ranked;
    a language that has too few below is ranked whole.
    """
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # as many rows as the model has codewords
    languages = counts.count()
    if not languages:
        return None
    most = max(LEAST_ROWS, sample_rows // languages)
    share = (most + 8 * np.sqrt(most) + 16) / F.col("n")
    low = rows.join(F.broadcast(counts), "lang").filter(F.col("h") / 2.0**64 + 0.5 <= share).select("lang", "h").distinct()

    def cuts(hashes: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        return hashes.withColumn("rank", rank).filter(F.col("rank") <= most).groupBy("lang").agg(F.max("h").alias("cut"), F.count("*").alias("found"))

    found = materialize(cuts(low), "cuts")
    short = counts.join(found, "lang", "left").filter((F.coalesce("found", F.lit(0)) < most) & (F.coalesce("found", F.lit(0)) < F.col("n"))).select("lang")
    if short.isEmpty():
        return found.select("lang", "cut")
    rest = cuts(rows.join(F.broadcast(short), "lang", "left_semi").distinct())
    return found.join(F.broadcast(short), "lang", "left_anti").unionByName(rest).select("lang", "cut")


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on rows outside fold 0 that have text and language: of each language the same number of distinct (id, text), those that hash lowest. None where there are no such rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), fold_of(id_col).alias("fold")).filter("fold != 0 AND lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    cuts = sample_cuts(rows.select("lang", "h"), sample_rows)
    if cuts is None:
        return None

    def vectors(batches):
        for batch in slices(batches, 256):
            blobs = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(blobs, pa.binary())], names=["lang", "x"])

    chosen = rows.join(F.broadcast(cuts), "lang").filter("h <= cut").dropDuplicates(["lang", "h"]).select("lang", "text")
    got = chosen.mapInArrow(trimmed(vectors), "lang string, x binary").collect()  # at most sample_rows rows, or LEAST_ROWS of each language
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    return fit(np.stack([np.frombuffer(r.x, np.float32) for r in got]), [r.lang for r in got])


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", with_distance: bool = False) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and ambiguous. A null text, or one without a letter, is ``und`` with score 0; so is every text where there is no model. ``with_distance``: also its distance from the learned languages, null for texts without a letter and 0 where it can't be told (no model, fewer than three languages, few letters)."""
    sent = docs.select(*keep, *([] if text_col in keep else [text_col])).withColumn(text_col, F.col(text_col).cast("string"))
    at_text, fields = sent.columns.index(text_col), sent.schema.fields[: len(keep)]
    out = docs.sparkSession.createDataFrame([], _ROWS + ", distance double" * with_distance).schema

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in slices(batches):
            texts = batch.column(at_text).to_pylist()
            lettered = [i for i, t in enumerate(texts) if t and letter.search(t)]
            real = lettered if model is not None else []
            far: list[float | None] = [None] * len(texts)
            for i in lettered:
                far[i] = 0.0
            names, scores, flags = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for at in range(0, len(real), 256):
                some = real[at : at + 256]
                x = np.stack([features(texts[i]) for i in some])
                for i, n, s, a in zip(some, *model.decide(x), strict=True):
                    names[i], scores[i], flags[i] = n, float(s), bool(a)
                for i, d in zip(some, model.distance(x) if with_distance else (), strict=with_distance):
                    far[i] = float(d) if letters(texts[i]) >= LEAST_LETTERS else 0.0
            columns = [batch.column(i) for i in range(len(keep))]
            told = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_()), pa.array(far, pa.float64())]
            yield pa.record_batch([*columns, *told[: len(out)]], names=[*keep, *out.names])

    from pyspark.sql.types import StructType

    return sent.mapInArrow(trimmed(run), StructType(fields + out.fields))


def unlike_bound(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The distance above which a text is unlike the learned languages, from labelled rows of ``docs`` that the model wasn't fitted on (fold 0).

    Half way between 1, where no codeword is nearer than another, and the distance that a share of at
    most ``BEYOND`` of the rightly named held-out texts exceeds. Rows named wrongly say nothing about
    their language. Distances are counted in ``BINS`` equal bins, so no more than these reach the
    driver. Where no held-out row can be told, 1: then no text is unlike.
    """
    if model is None or len(model.languages) < 3:
        return 1.0
    held = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), fold_of(id_col).alias("fold")).filter("fold = 0 AND lang IS NOT NULL AND text IS NOT NULL")
    told = predict(held, model, ["lang"], with_distance=True).filter("lang = lang_pred AND distance > 0")
    bins = told.groupBy(F.least(F.ceil(F.col("distance") * BINS), F.lit(BINS)).alias("bin")).agg(F.count("*").alias("n")).collect()
    beyond, allowed = 0, BEYOND * sum(r.n for r in bins)
    for row in sorted(bins, key=lambda r: -r.bin):
        beyond += row.n
        if beyond > allowed:
            return (1 + row.bin / BINS) / 2
    return 1.0


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous.

    Language, source and id are never inputs of a prediction. Repeated rows are predicted once each
    and alike; a null doc_id is never held out nor learned from. Without labelled rows every text is
    ``und``. An empty table gives no rows; columns other than doc_id, text and lang are not read.
    """
    model = train(docs, sample_rows)
    rows = docs.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
