"""The pipeline against a composition of plain versions of its stages."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quarry.llm import langid, packing, tokens

SF = "/root/testdata/sf0.001"


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _languages(rows, model, bound):
    """By the definition of the decoder, a text at a time."""
    for i, text in rows:
        if not text or not regex.search(r"\p{L}", text):
            continue
        x = langid.features(text)
        margins = x @ model.weights + model.bias
        losses = [float(np.sum(t * np.log1p(np.exp(-margins * c)))) for c, t in zip(model.codes, model.trust, strict=True)]
        if langid.letters(text) < langid.LEAST_LETTERS or min(losses) <= bound * sum(losses) / len(losses):
            yield i, text


def _near(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [(i, t) for i, t in rows if find(i) == i]


def _repeats(rows):
    first = {}
    for i, text in sorted(rows):
        b = text.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, text in rows:
        b = text.encode()
        mask = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                mask[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m).decode("utf-8", "ignore")
        if kept:
            yield i, kept


def _contaminated(rows, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))

    windows = defaultdict(set)
    for item in items:
        w = words(item)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[len(w[k : k + 10])].add(tuple(w[k : k + 10]))
    for i, text in rows:
        w = words(text)
        if not any(tuple(w[k : k + n]) in known for n, known in windows.items() for k in range(len(w) - n + 1)):
            yield i, text


@pytest.mark.parametrize("planted", [False, True])
def test_pipeline_by_brute_force(spark, tmp_path, planted):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    if planted:  # what each stage has to take out, and rows it must leave, in a table with a clashing column more
        some = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
        item = bench.orderBy("item_id").first().text
        texts = [*some[:5], *(t + " one word more" for t in some[5:10]), some[11][:400] + " and then something of its own", f"before it {item} after it", "Широкая электрификация южных губерний даст мощный толчок. " * 5, "123 ... 456", "", None, "ein kurzer Text", "é" * 60 + some[12][:200]]
        more = spark.createDataFrame([(10_000 + i, t, None, "planted", 0) for i, t in enumerate(texts)], docs.select(*corpus_pipeline.COLUMNS).schema)
        docs = docs.select(*corpus_pipeline.COLUMNS).union(more)
    docs = docs.withColumn("distance", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = list(_languages(rows, model, langid.unlike_bound(docs, model)))
    rows = _near(rows)
    rows = list(_contaminated(_repeats(rows), [r.text for r in bench.collect()]))
    tokenizer = tokens.SegmentEncoder(tokens.tokenizer_path(tokens.BYTE_BPE)).tokenizer
    ids = {i: np.asarray([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4") for i, t in rows}
    got, filled = defaultdict(int), defaultdict(int)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        piece = ids[p.doc_id][p.start : p.start + p.length]
        assert (len(piece), zlib.crc32(piece.tobytes()), p.doc_tokens) == (p.length, p.ids_crc32, len(ids[p.doc_id]))
        got[p.doc_id] += p.length
        filled[p.sequence_id] += p.length
    assert got == {i: len(x) for i, x in ids.items()}
    short = [n for s, n in filled.items() if n != packing.SEQUENCE_TOKENS]
    assert max(filled.values()) <= packing.SEQUENCE_TOKENS and len(short) <= 1
