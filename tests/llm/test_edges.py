"""Brute-force versions of the queries, and the cases that tables hold: nulls, ties, repeats, clashes, long texts, and sizes above each switch."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import BASE, ROWS

import corpus_pipeline
from quarry.llm import decontam, exchange, fingerprint, langid, licenses, ngram_join, packing, suffix_dedup, token_counts, token_output, tokens, warc
from quarry.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every kind, with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", 0, "clash", -1, "x", "y") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key string, start long, h string, block string")


def _all(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_warc_judges_rows_by_their_own_payload(spark):
    rows = [(1, "A"), (2, "B"), (5, "A"), (5, "B"), (6, "A"), (6, "unique"), (6, "A"), (7, None), (8, ""), (None, "A"), (9, "é"), (9, "é")]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h, "clash", "clash") for i, h in rows], "page_id long, url string, html string, digest string, refers_to string")
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, h in rows:
        h = h or ""
        later = i is not None and i > first[h]
        want.append((i, len(h.encode()), warc.base32_sha1(h.encode()), "revisit" if later else "response", first[h] if later else None))
    for most in (warc.BROADCAST_REVISITS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(warc, "BROADCAST_REVISITS", most)
            assert _all(warc.warc_round_trip(pages)) == sorted(want, key=str)


def test_packing_holds_the_library_ids(odd):
    enc = tokens.SegmentEncoder(tokens.tokenizer_path(tokens.BYTE_BPE))
    whole = {}
    for r in packing.pack(odd, window=64, with_ids=True).collect():
        whole.setdefault((r.doc_id, r.doc_tokens, r.sequence_id * 64 + r.offset - r.start), []).append((r.start, bytes(r.ids)))
    got = sorted((str(k[0]), b"".join(x for _, x in sorted(v))) for k, v in whole.items())
    assert got == sorted((str(i), np.asarray([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in ROWS)


def test_token_files_hold_the_library_ids(odd):
    enc = tokens.SegmentEncoder(tokens.tokenizer_path(tokens.WORD_BPE))
    want = []
    for i, t in ROWS:
        ids = np.asarray([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    got = token_output.token_round_trip(odd).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_one_id_with_most_rows_lies_in_many_files(spark, tmp_path):
    long = "".join(f"word{i % 977} and\n" for i in range(150_000))
    rows = [*[(5, "twin")] * 1500, *[(5, f"text {i}") for i in range(500)], *[(None, None)] * 1000, (1, "first"), (9, "last"), (9, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    token_output.write_token_files(docs, str(tmp_path / "t"), files=8)
    enc = tokens.SegmentEncoder(tokens.tokenizer_path(tokens.WORD_BPE)).tokenizer
    want = []
    for i, t in rows:
        ids = np.asarray([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(token_output.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    files = token_output.read_blobs(spark, str(tmp_path / "t")).collect()
    holders = [f.file_no for f in files if any(5 in s.doc_ids for s in token_output.segments(f.content))]
    assert len(holders) > 3


def test_long_texts(spark):
    """op2, op3, op4, op6 and op9: a text of many megabytes among short ones, repeated and empty ones."""
    long = "".join(f"the word {i % 977} and the house of {i % 91}\n" for i in range(100_000))
    rows = [(1, long), (2, long), (3, "the cat"), (4, ""), (5, None), (6, "le chat"), (7, long[:-1]), *[(10 + i, f"the house {i} and the words") for i in range(30)]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    texts = {i: t or "" for i, t in rows}
    got = {r.page_id: r for r in warc.warc_round_trip(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))).collect()}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {i: (len(t), warc.base32_sha1(t.encode())) for i, t in texts.items()}
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {2, 5} and (got[2].refers_to, got[5].refers_to) == (1, 4)
    ids = {i: np.asarray([*tokens.SegmentEncoder(tokens.tokenizer_path(tokens.BYTE_BPE)).tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    pieces = packing.pack(docs).collect()
    assert all(zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()} == {i: "en" if t else "und" for i, t in texts.items()}
    prints = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    for i, text, edited, after in _edits(list(texts.items())):
        r = prints[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(_canonical(text) == _canonical(edited)), float(_canonical(text) == _canonical(after)))
    licensed = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit("\nReleased under the MIT License."))).otherwise(F.col("text")))
    found = {r.doc_id: r.license for r in licenses.scan_licenses(licenses.document_paths(licensed.withColumn("source", F.col("doc_id").cast("string")))).collect()}
    assert found[1] == "MIT" and found[3] is None


def test_fingerprints_of_repeated_and_null_ids(odd):
    """Rows that share a doc_id have the same next document, whose smallest text is taken; those without one have an empty next."""
    ids = sorted({i for i, _ in ROWS if i is not None})
    head = {i: min((t or "") for j, t in ROWS if j == i) for i in ids}
    follow = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    want = []
    for i, t in ROWS:
        text, after = t or "", head[follow[i]] if i is not None else ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), float(_canonical(text) == _canonical(edited))))
    got = fingerprint.edited_fingerprints(odd).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited) for r in got), key=str) == sorted(want, key=str)


def test_token_counts_of_the_query(documents):
    enc = tokens.SegmentEncoder(tokens.tokenizer_path(tokens.BYTE_BPE), True)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in token_counts.count_under_edits(documents).collect():
        text = edited = texts[r.doc_id] or ""
        for start, stop, new in token_counts.standard_edits(text):
            edited = edited[: max(0, start)] + new + edited[max(start, stop) :]
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited) == (len(enc.whole(text)) // 4, len(enc.whole(edited)) // 4, len(edited))


def test_token_counts_of_long_texts(spark):
    enc = tokens.SegmentEncoder(tokens.tokenizer_path(tokens.BYTE_BPE), True)
    long, solid = "".join(f"word{i % 977} and\n" for i in range(150_000)), "xyÄ9" * 5_000  # with and without blanks
    given = [(1, long), (2, solid), (2, solid), (None, "x y"), (None, None), (3, ""), *[(10 + i, "few words") for i in range(1500)]]
    rows = spark.createDataFrame([(i, t, -1, "e") for i, t in given], "doc_id long, text string, n_tokens long, rows string").coalesce(1)
    got = token_counts.count_under_edits(rows).collect()
    want = []
    for i, text in given:
        text = edited = text or ""
        for start, stop, new in token_counts.standard_edits(text):
            edited = edited[: max(0, start)] + new + edited[max(start, stop) :]
        want.append((i, len(enc.whole(text)) // 4, len(enc.whole(edited)) // 4, len(edited)))
    assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_chars_edited) for r in got), key=str) == sorted(want, key=str)
    assert next(r.n_chars_reencoded for r in got if r.doc_id == 1) < len(long) // 5


def _canonical(text):
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def _edits(rows):
    """(doc_id, text, edited text, next text) of rows with distinct ids."""
    rows = sorted(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        yield i, t, t[: len(t) - n] + after[:n], after


@pytest.mark.parametrize("most", [None, 0])
def test_fingerprints_by_brute_force(documents, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(fingerprint, "BROADCAST_DIGESTS", most)
        monkeypatch.setattr(fingerprint, "BROADCAST_LINKS", most)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(documents).collect()}
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    seen: dict = {}
    for i, text, edited, after in _edits(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(_canonical(text) == _canonical(edited)), float(_canonical(text) == _canonical(after)))
        seen.setdefault(r.fingerprint, set()).add(_canonical(text))
        seen.setdefault(r.edited_fingerprint, set()).add(_canonical(edited))
    assert all(len(x) == 1 for x in seen.values()) and len(seen) == len(set().union(*seen.values()))


@pytest.mark.parametrize("ids", [exchange.BROADCAST_IDS, 0])
def test_joins_above_the_switch(spark, odd, documents, monkeypatch, ids):
    """op5, op8 and the pipeline give the same where ids are sent to the texts and where both move."""
    monkeypatch.setattr(exchange, "BROADCAST_IDS", ids)
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", ids)
    monkeypatch.setattr(licenses, "BROADCAST_DIRECTORIES", ids)
    found = [_all(ngram_join.jaccard_components(t)) for t in (odd, documents)] + [_all(suffix_dedup.remove_repeats(t)) for t in (odd, documents)]
    found.append(_all(licenses.scan_licenses(licenses.document_paths(documents))))
    stages, docs = [], documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name.replace(" ", "-"))
        stages.append(_all(docs))
    found.append(stages)
    digest = hashlib.sha256(repr(found).encode()).hexdigest()
    assert _KNOWN.setdefault("switch", digest) == digest


_KNOWN: dict = {}


def test_words_that_agree_in_a_polynomial_are_told_apart(spark):
    a = ["a"]
    for _ in range(10):
        a = [*a, *("b" if c == "a" else "a" for c in a)]
    word = "".join(a)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} {word[::-1]}"), (2, f"{other} {other[::-1]}"), (3, word), (4, other), (5, word.upper())]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_links_are_held_against_the_words(spark, monkeypatch):
    """With a hash that takes all words for one, only real links are left."""
    monkeypatch.setattr(ngram_join.Words, "overlap", lambda self, other: 0)
    one, two = ngram_join.Words(b"a b c d e f"), ngram_join.Words(b"a b c d e f g")
    assert one.overlap(two) == 0
    monkeypatch.undo()
    assert one.overlap(two) == 2 and len(two.tokens) == 3
    two.tokens[:2], two.starts[:2] = one.tokens, two.starts[2]
    assert one.overlap(two) < 2


def test_long_texts_in_pieces(monkeypatch):
    random.seed(3)
    words = [random.choice(["a", "bb", "Ccc", "x" * 65, "y" * 400, "é" * 9, "z" * 64]) for _ in range(3000)]
    text = "".join(w + random.choice([" ", "\n", "  ", "\t\r"]) for w in words).encode()
    whole = next(ngram_join.shingle_sets([text]))
    assert len(ngram_join.Words(text).tokens) == len(whole) and set(ngram_join.Words(text).tokens.tolist()) == set(whole.tolist())
    for size in (100, 333, 5000):
        monkeypatch.setattr(ngram_join, "PIECE_BYTES", size)
        pieces = list(ngram_join.shingle_sets([b"one two", text, b"", b"y" * 900, b" " * 700]))
        assert np.array_equal(pieces[1], whole) and [len(p) for p in pieces] == [1, len(whole), 0, 1, 0]
    monkeypatch.undo()
    assert np.array_equal(next(ngram_join.shingle_sets([b"y" * 900])), pieces[3])


def test_a_text_of_many_megabytes(spark):
    random.seed(4)
    long = " ".join(f"w{random.randrange(10**6)}" for _ in range(700_000))
    rows = [(1, long), (2, long.replace("w1", "v1", 20)), (3, "short one of six words here"), (4, long[: len(long) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[4].n_removed == got[4].n_bytes and got[1].n_removed == got[3].n_removed == 0 and 0 < got[2].n_bytes - got[2].n_removed < 5000


@pytest.mark.parametrize("cell", [2, 7])
def test_tokens_in_cells(spark, monkeypatch, cell):
    """A token's rows in parts of some rows give the pairs that all of them together give."""
    monkeypatch.setattr(ngram_join, "CELL_ROWS", cell)
    random.seed(6)
    rows = [(t, d, d * 7, random.randint(4, 9), random.randint(0, 3)) for t in (1, 2, 3) for d in random.sample(range(40), 20)]
    sizes: dict = {}
    rows = [(t, d, k, sizes.setdefault(d, n), p) for t, d, k, n, p in rows]
    toks = spark.createDataFrame(rows, "token long, doc_id long, row_key long, size long, place long")
    labels = spark.createDataFrame([(d, d // 10) for d in range(0, 40, 3)], "node long, component long")
    comp = {d: d // 10 if d % 3 == 0 else d for d in range(40)}
    want = set()
    for t, d, k, n, p in rows:
        for u, e, m, o, q in rows:
            if t == u and d < e and comp[d] != comp[e] and 4 * min(n, o) >= 3 * max(n, o) and min(n - p, o - q) >= ngram_join.least_overlap(n, o):
                want.add((d, k, e, m, o))
    assert {tuple(r) for r in ngram_join.open_pairs(toks, labels, 3).collect()} == want


@pytest.mark.parametrize("block", [(1, 10**9), (5, 10**9), (256, 300)])
def test_blocks_lose_no_pair(spark, documents, monkeypatch, block):
    want = _all(ngram_join.jaccard_components(documents))
    monkeypatch.setattr(ngram_join, "BLOCK_PAIRS", block[0])
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block[1])
    assert _all(ngram_join.jaccard_components(documents)) == want


def test_plain_doubling_agrees(spark, documents, odd):
    for table in (odd, documents.filter("length(text) < 3000")):
        sizes = {}
        for r in suffix_dedup.doubled_ranks(table).collect():
            sizes.setdefault((r.doc_id, r.row_key), set()).update(range(r.pos, r.pos + suffix_dedup.THRESHOLD))
        got = suffix_dedup.remove_repeats(table).filter("n_removed > 0").collect()
        assert len(got) > 0 and sorted((i, len(x)) for (i, _), x in sizes.items()) == sorted((r.doc_id, r.n_removed) for r in got)


def test_windows_that_one_hash_takes_for_equal(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x * np.uint64(0))
    key, place, rank = np.asarray([1, 2, 1, 1, 2], np.uint64), np.asarray([0, 0, 0, 1, 0]), np.asarray([5, 5, 5, 5, 5], np.uint64)
    order, starts = suffix_dedup._classes(key, place, rank)
    groups = {frozenset(g.tolist()) for g in np.split(order, starts[1:])}
    assert groups == {frozenset({0, 2}), frozenset({1, 4}), frozenset({3})}


def test_few_pieces_a_flush(spark, documents, monkeypatch):
    want = _all(suffix_dedup.remove_repeats(documents))
    monkeypatch.setattr(suffix_dedup, "PACK_WINDOWS", 500)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 900)
    assert _all(suffix_dedup.remove_repeats(documents)) == want


def test_language_sample_is_bounded(spark):
    rows = [(7, f"the house number {i}", "en") for i in range(500)] + [(8, "das haus", "de")] * 300 + [(i, f"la maison {i}", "fr") for i in range(100, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter("crc32(cast(doc_id as string)) % 5 != 0")
    hashed = docs.select("lang", F.xxhash64("doc_id", "text").alias("h"))
    cuts = {r.lang: r.cut for r in langid.sample_cuts(hashed, 30).collect()}
    found: dict = {}
    for r in hashed.distinct().collect():
        found.setdefault(r.lang, []).append(r.h)
    assert cuts == {k: sorted(v)[:10][-1] for k, v in found.items()}
    assert len(langid.train(docs, 30).languages) == len(found)


def test_language_accuracy_and_plain_decoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    told = [r for r in langid.identify(docs).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(told) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in told) / len(told) > 0.97
    model = langid.train(docs)
    x = np.stack([langid.features(r.text) for r in docs.select("text").limit(50).collect()])
    for i, row in enumerate(x):  # by the definition: bits are predicted, and losses summed one by one
        margins = [float(row @ model.weights[:, b] + model.bias[b]) for b in range(model.codes.shape[1])]
        losses = [sum(t * np.log1p(np.exp(-m * c)) for m, c, t in zip(margins, code, trust, strict=True)) for code, trust in zip(model.codes, model.trust, strict=True)]
        name, score, _ = (v[i] for v in model.decide(x))
        assert name == model.languages[int(np.argmin(losses))] and score == pytest.approx(1 / sum(np.exp(min(losses) - v) for v in losses), rel=1e-3)


def test_bound_for_unlike_texts_comes_from_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    far = []
    for r in docs.filter("crc32(cast(doc_id as string)) % 5 = 0 AND lang IS NOT NULL AND text IS NOT NULL").collect():
        x = langid.features(r.text)[None]
        losses = model.losses(x)[0]
        if langid.letters(r.text) >= langid.LEAST_LETTERS and model.decide(x)[0] == [r.lang]:
            far.append(losses.min() / losses.mean())
    bound = langid.unlike_bound(docs, model)
    assert bound == pytest.approx((1 + max(far)) / 2, abs=1 / langid.BINS)
    # labels that the decoder doesn't confirm, unlabelled rows and rows of other folds move nothing
    noise = [(i, "qwzx kjvv pbgh xxq wqz " * 20, "en" if i % 2 else None) for i in range(-300, 0)]
    more = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([r for r in noise if model.decide(langid.features(r[1])[None])[0] != [r[2]]], "doc_id long, text string, lang string"))
    assert langid.unlike_bound(more, model) == bound
    assert langid.unlike_bound(docs.filter("false"), model) == langid.unlike_bound(docs.withColumn("lang", F.lit(None)), model) == langid.unlike_bound(docs, None) == 1.0


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_clean_documents_pass_the_language_stage(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, table).count() == docs.filter(r"text RLIKE '\\p{L}'").count()


def test_clashing_columns_change_nothing(spark, odd):
    plain = odd.select("doc_id", "text", "lang")
    assert _all(langid.identify(odd)) == _all(langid.identify(plain))
    more = licenses.document_paths(odd).withColumns({c: F.lit("clash") for c in ("license", "score", "words", "n_words", "of", "dir", "b")})
    assert _all(licenses.scan_licenses(more)) == _all(licenses.scan_licenses(licenses.document_paths(odd)))


def test_pipeline_judges_rows(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = "this text of its own has nothing to do with the others and stays"
    rows = [(None, f"x {item} y"), (None, clean), (5, f"{item} z"), (5, clean), (6, None), (7, ""), (8, clean), (8, clean)]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(None, clean), (5, clean), (6, None), (7, ""), (8, clean), (8, clean)], key=str)
    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in near), key=str) == sorted([(None, f"x {item} y"), (None, clean), (5, f"{item} z"), (5, clean), (6, None), (7, "")], key=str)
    cut = corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in cut), key=str) == sorted([(None, f"x {item} y"), (None, clean), (5, f"{item} z"), (5, clean)], key=str)
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_fills_in_the_language(spark):
    rows = [(i, (f"le chat et la maison du roi {i} " if i % 2 else f"the cat and the house of a king {i} ") * 6, None if i < 20 else "fr" if i % 2 else "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, SF).collect()
    assert len(kept) == 300 and all(r.lang == ("fr" if r.doc_id % 2 else "en") for r in kept)


def test_queries_have_the_columns_of_their_contract(spark):
    want = {
        "op1_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2_warc": "page_id payload_bytes payload_digest record_type refers_to",
        "op3_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4_language": "doc_id held_out lang_pred score", "op5_jaccard": "doc_id n_shingles component_id",
        "op6_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op8_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op10_token_files": "doc_id start n_tokens ids_crc32",
    }
    for name, columns in want.items():
        assert llm.queries()[name](spark, SF).columns[: len(columns.split())] == columns.split()


def test_contaminated_rows_agree(spark, odd):
    bench = spark.createDataFrame([(1, BASE), (2, "twin"), (None, "word")], "item_id long, text string")
    rows = decontam.contaminated_rows(odd, bench).count()
    assert rows == decontam.decontaminate(odd, bench).filter("contaminated").distinct().count() > 0
