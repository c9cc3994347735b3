"""Scores that are found row by row: odd rows, ties, percentiles by narrowing, and what moves between tasks."""

import math
import random
import re
import tracemalloc
import types
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from jobs import evaluate
from quarry.operators import lexical, passages, quantile, sparse, tfidf
from quarry.plans import registry

DOCS = "doc_id long, text string"
ASKED = "item_id long, text string"


def _words(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 12))) for _ in range(n)]


def _plain(rows, asked):
    """BM25 over rows, where the rows of a document that have one length are one."""
    tf, dl = defaultdict(Counter), []
    for d, t in rows:
        if t is not None:
            dl.append(len(t.lower().split()))
            tf[d, dl[-1]].update(t.lower().split())
    df, avg = Counter(w for c in tf.values() for w in c), sum(dl) / len(dl)
    out = defaultdict(float)
    for q, text in asked:
        for w, qn in Counter(text.lower().split()).items():
            for (d, n), c in tf.items():
                if c[w]:
                    out[q, d] += qn * math.log((len(rows) - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * n / avg))
    return {k: round(v, 6) for k, v in out.items()}


def test_bm25_of_odd_rows(spark):
    rows = [*enumerate(_words(60, 1)), (3, "a b c"), (3, "a b c"), (4, "h " * 30), (None, "a h"), (7, None), (8, "")]
    asked = [(i, t) for i, t in enumerate(_words(9, 2))] + [(100, "zzz"), (101, "A a a")]
    docs, questions = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(asked, ASKED)
    fit, want = lexical.Bm25(docs).fit(questions, digits=6), _plain(rows, asked)
    assert {(r.query_id, r.doc_id): r.bm25 for r in fit.pairs().collect()} == want
    best = sorted(want.items(), key=lambda x: (x[0][0], -x[1], x[0][1] is not None, x[0][1] or 0))
    first = [k for i, (k, _) in enumerate(best) if i < 2 or best[i - 2][0][0] != k[0]]
    assert sorted((r.query_id, str(r.doc_id)) for r in fit.top(2).collect()) == sorted((q, str(d)) for q, d in first)


def test_percentiles_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SORTED", 5)
    monkeypatch.setattr(quantile, "BINS", 4)
    rows, asked = [*enumerate(_words(300, 3))], [(i, t) for i, t in enumerate(_words(5, 4))]
    fit, held = lexical.Bm25(spark.createDataFrame(rows, DOCS)).fit(spark.createDataFrame(asked, ASKED)), defaultdict(list)
    for r in fit.pairs().collect():
        held[r.query_id].append(r.bm25)
    assert {r.query_id: round(r.p95, 9) for r in fit.p95().collect()} == {q: round(float(np.percentile(v, 95)), 9) for q, v in held.items()}


def test_vocabulary_is_that_of_all_pairs(spark):
    rows = [*enumerate(_words(200, 5)), (1, "a b a b"), (300, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for features in (3, 20, 40, 1000):  # without ties that matter, with them, and with all terms
        every = Counter(t for _, x in rows if x for w in [x.split()] for t in [*w, *map(" ".join, zip(w, w[1:], strict=False))])
        want = sorted(every, key=lambda t: (-every[t], t))[:features]
        found = tfidf.fitted(docs, features)
        assert found.terms == want
        norms = [r[0] for r in found.weights().groupBy("doc_id").agg({"w": "count"}).select("doc_id").collect()]
        assert len(norms) == len(set(norms))


def test_scores_of_all_pairs_do_not_move(spark):
    """4000 documents and 100 questions have 400,000 scores, which were rows of a shuffle before."""
    docs = spark.createDataFrame([(i, t + " a") for i, t in enumerate(_words(4000, 6))], DOCS)
    asked = spark.createDataFrame([(i, t + " a") for i, t in enumerate(_words(100, 7))], ASKED)
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    assert evaluate.ranked("bm25", docs, asked, 3).count() == 300
    assert moved() - before < 1_000_000


def test_postings_are_counted_in_their_rows(spark):
    docs = spark.createDataFrame([*enumerate(_words(50, 8)), (99, None), (98, "A a")], DOCS)
    found, names = lexical.row_postings(docs), ["term", "doc_id", "tf", "dl"]
    assert sorted(found.select(names).collect()) == sorted(lexical.postings(docs).select(names).collect())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_as_by_their_pattern():
    r = random.Random(9)
    signs = "abB_9éÉÀ×÷ªß²°«—’ \t\n.-,"
    for t in range(200):
        letters = signs + ("中Σσ≠\u0300ŒКк\U0001f600\U00010400" if t % 2 else "")
        texts = [None if r.random() < 0.1 else "".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 9))]
        column = pa.array(["x y", *texts, "q"], pa.string()).slice(1, len(texts))
        for inside, pattern in ((sparse.UNBLANK, r"[^\t\n\x0b\f\r ]+"), (sparse.WORD, r"\w+")):
            for least, lower in ((1, True), (2, True), (1, False)):
                n, words = sparse.Cut(inside, least, lower)(column)
                want = [[w for w in re.findall(pattern, ((x or "").lower() if lower else x or "")) if len(w) >= least] for x in texts]
                assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]


def test_passages_are_searched_where_their_rarest_word_stands(spark):
    rows = [(i, f"{t} x{i % 7} marked passage y{i % 7} {t}") for i, t in enumerate(_words(4000, 10))] + [(None, "x1 marked passage y1"), (5000, None)]
    asked = [(1, "x1 marked passage y1"), (2, "x2 marked passage y3"), (3, "marked passage"), (4, None), (5, "passage y1 "), (6, "p")]
    docs = spark.createDataFrame(rows, DOCS)
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    found = passages.holding(docs, spark.createDataFrame(asked[:2] + asked[3:4], ASKED))
    assert sorted(map(tuple, found.collect())) == sorted((1, d) for d, t in rows if d is not None and t and asked[0][1] in t)
    assert moved() - before < 30_000
    found = passages.holding(docs.filter("doc_id < 300"), spark.createDataFrame(asked, ASKED))
    assert sorted(map(tuple, found.collect())) == sorted((q, d) for q, p in asked if p for d, t in rows[:300] if p in t)


def test_codes_are_counted_without_an_empty_table():
    """Few codes of many cells: a batch of short texts against the words of many questions."""
    codes = np.array([7_999_999, 5, 5, 0])
    tracemalloc.start()
    every, n = sparse.tallied(codes, 8_000_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert every.tolist() == [0, 5, 7_999_999] and n.tolist() == [1, 2, 1] and most < 1_000_000
    r = np.random.default_rng(1)
    for size, cells in ((0, 5), (1, 5), (900, 50), (900, 10**6), (900, 2**40)):
        codes = r.integers(0, cells, size)
        found, want = sparse.tallied(codes, cells), np.unique(codes, return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip(found, want, strict=True))


def test_two_ranks_of_a_query_share_a_histogram(spark):
    """A percentile lies between two ranks; scores are put in bins once for both."""
    rows, asked = [*enumerate(_words(300, 3))], [(i, t) for i, t in enumerate(_words(5, 4)) if t]
    scores = lexical.Bm25(spark.createDataFrame(rows, DOCS)).fit(spark.createDataFrame(asked, ASKED)).scores
    state = quantile.wanted(scores._bounds(), "query_id", 0.95).collect()
    batches, taken = scores.rows.toArrow().to_batches(), []
    scores.rows = types.SimpleNamespace(sparkSession=spark, mapInArrow=lambda f, _: taken.append(f) or spark.createDataFrame([], "range bigint, bin bigint, inside bigint, low double, high double"))
    scores._bins(state)
    ranges = {r for b in taken[0](iter(batches)) for r in b.column(0).to_pylist()}
    assert len(ranges) == len({s.query_id for s in state}) < len(state)


def test_texts_stay_where_they_are(spark):
    """The few best documents meet the texts; a join by sorted keys would move every text."""
    d, name = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        for q in (registry.best_excerpt_ui, registry.best_excerpt_cli, registry.result_table):
            plan = q(spark, d)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set(name, held)


def _most_frequent(rows, features):
    every = Counter(t for _, x in rows if x for w in [x.split()] for t in [*w, *map(" ".join, zip(w, w[1:], strict=False))])
    return sorted(every, key=lambda t: (-every[t], t))[:features]


def test_vocabulary_is_found_without_moving_rare_words(spark):
    """200,000 words that stand once were rows of a shuffle before; now a share of the texts tells its most frequent terms."""
    rows = [(i, f"{t} a b " + " ".join(f"x{i}y{k}" for k in range(50))) for i, t in enumerate(_words(4000, 11))]
    docs = spark.createDataFrame(rows, DOCS)
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before, want = moved(), _most_frequent(rows, 20)
    found = tfidf.fitted(docs, 20, unique=True)
    assert found.terms == want and moved() - before < 600_000
    kept = found.weights().collect()
    assert {r.term for r in kept} == set(want) and all(abs(sum(r.w**2 for r in kept if r.doc_id == d) - 1) < 1e-9 for d in (0, 7))


def test_vocabulary_of_unlike_shares(spark, monkeypatch):
    """Each share has words of its own; with few told terms a proof is not found and all words are counted."""
    for told, at_once in ((5, 10**6), (5, 40), (1, 40)):
        monkeypatch.setattr(tfidf, "TIED", told)
        monkeypatch.setattr(sparse, "AT_ONCE", at_once)
        for seed in range(3):
            rows = [(i, t.replace("a", f"a{i // 100}").replace("b", f"b{i % 9}")) for i, t in enumerate(_words(400, seed))]
            docs = spark.createDataFrame(rows, DOCS).coalesce(3)
            for features in (4, 30):
                assert tfidf.fitted(docs, features, unique=True).terms == _most_frequent(rows, features)


def test_weights_are_rounded_as_by_spark(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.random(5000), [0.0078125, 0.0000005, 0.1234565, 0.1234575, -0.0000005, 1.0, 0.9999995, -1e-9, 2.5e-7], r.integers(0, 10**6, 2000) / 10**6 + 5e-7])
    want = [v[0] for v in spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("round(x, 6)").collect()]
    assert sparse.rounded(x, 6).tolist() == want


def test_shares_of_a_percentile_are_found_in_their_tasks(spark):
    """Each pair met its query's percentile in a join before, and was rounded there."""
    rows = [*enumerate(_words(300, 3)), (300, "once a"), (None, "a h"), (302, None)]
    asked = [*enumerate(_words(9, 4)), (100, "zzz"), (101, "once"), (102, "a a")]
    fit = lexical.Bm25(spark.createDataFrame(rows, DOCS)).fit(spark.createDataFrame(asked, ASKED), digits=6)
    want = fit.normalised().selectExpr("query_id", "doc_id", "round(bm25n, 6) AS bm25n").collect()
    assert sorted(map(repr, fit.shares(6).collect())) == sorted(map(repr, want)) and len(want) > 1000
    plan = registry.bm25_norm(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "round(" not in plan
