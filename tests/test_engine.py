import functools
import json
import os
import re
import threading
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import text as T
from quarry import session, shared
from quarry.__main__ import Service, main, serve
from quarry.operators import chunk, encode, evaluate, expand, lexical, ranking, vector
from quarry.plans import registry
from quarry.session import Engine, QueryCache, evaluate_engine
from quarry.sources import loaders

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _norm(v):
    return "NULL" if v is None or v != v else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    theirs = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in theirs.description].index(c) for c in cols]
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(_norm(r[i]) for i in at) for r in theirs.fetchall())


def _one(spark, f, s):
    return spark.createDataFrame([(s,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("step", "given", "want"),
    [("hyphenation", "applica-\ntion", "application"), ("broken_values", "50-55\n°C", "50-55°C"), ("broken_values", "10000U/\ng", "10000U/g"), ("broken_values", "< 15\n%", "< 15\n%"), ("units", "< 15\n%", "<15%"), ("broken_values", "2\ngum", "2gum"), ("repeated_headers", "H\na\nH\nb\nH", "a\nb"), ("isolated_lines", "x\n\n12\n\ny", "x\n\n\ny")],
)
def test_cleaning(spark, step, given, want):
    assert _one(spark, T.STEPS[step], given) == want


def test_chunk_rules(spark):
    texts = ["A b c.", None, "", " ".join(["W " + "w " * 48 + "w."] * 5), "W " + "w " * 299 + "w."]
    rows = chunk.chunk(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {3, 4} and all(r.word_count >= 30 for r in rows)
    long = sorted((r.chunk_ord, r.start_pos) for r in rows if r.doc_id == 3)
    assert [o for o, _ in long] == list(range(len(long))) and [x for _, x in long] == sorted({x for _, x in long})
    assert [r.word_count for r in rows if r.doc_id == 4] == [301]


def test_percentile_normalisation(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.5, 2.0, 10.0, 0.1, 3.0])], "query_id long, doc_id long, bm25 double")
    got = {r.bm25: r.bm25n for r in lexical.normalised(rows).collect()}
    assert got[10.0] == 1.0 and got[2.0] == pytest.approx(2 / 8.6)
    alone = spark.createDataFrame([(1, 1, 4.0)], "query_id long, doc_id long, bm25 double")
    assert lexical.normalised(alone).first().bm25n == 1.0


def test_expansion(spark, tmp_path):
    def run(query, rules, most):
        return expand.expand(spark.createDataFrame([(query,)], "text string"), rules, most).first().expanded

    assert run("staff price", [(0, "af", ["fungal amylase", "price list"])], 3) == "staff price fungal amylase"
    assert run("x", [(0, "x", ["a", "b", "c", "d"])], 2) == "x a b"
    assert run("y", [(0, "x", ["a"])], 2) == run("y", [], 2) == "y"
    (tmp_path / "rules.json").write_text('{"pattern": "b", "terms": ["two"]}\n{"pattern": "a", "terms": ["one"], "rule_ord": -1, "group": "units"}\n')
    rules = expand.load_rules(spark, str(tmp_path / "rules.json"))
    assert rules == [(-1, "a", ["one"]), (0, "b", ["two"])] and run("a b", rules, 3) == "a b one two"
    assert expand.expansion_terms(spark.createDataFrame([("a",), (None,)], "text string"), rules).collect()[0].terms == ["one"]


def test_literals_of_rules():
    given = {r"\bflour\b": "flour", r"ing\b": "ing", r"\bdos(age|ing)\b": "dos", r"a|b": "", r"colou?r": "colo", r"[abc]def{2}g": "de", r"x*": "", r"(?:abc)": "", r"fungal\s+amylase": "amylase", r"ab+c": "ab", r"[]x]yz": "yz", "": ""}
    assert {p: expand.required(p) for p in given} == given


def test_a_hundred_rules(spark):
    """Generated rules of every form give what each pattern by itself gives."""
    words = ["flour", "dough", "wheat", "amylase", "dose", "ppm", "acid", "water", "heat", "salt"]
    rules = [(i, [rf"\b{w}\b", rf"{w}s?\b", rf"({w}|x{i})", rf"\d+\s*{w}", rf"^{w}", rf"{w[:3]}\w*", rf"[{w[0]}]{w[1:]}", rf"{w}.*{words[i % 7]}", rf"(?:{w})+", rf"{w}{{1,2}}"][i // 10], [f"term{i}", f"{w} more"]) for i, w in enumerate(words * 10)]
    texts = ["Flour and dough", "10 ppm of amylase", "wheats", "x31 nothing", "acid water heat salt flour", "", None, "AMYLASE dose Dose", "doughs flo wheatx"]
    got = {r.item_id: r.rule_ord for r in expand.matches(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"), rules).groupBy("item_id").agg(F.sort_array(F.collect_list("rule_ord")).alias("rule_ord")).collect()}
    want = {i: [o for o, p, _ in rules if re.search(p, (t or "").lower())] for i, t in enumerate(texts) if t is not None}
    assert got == {i: o for i, o in want.items() if o}
    terms = expand.expansion_terms(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"), rules, 4).collect()
    for r in terms:
        if r.text is None:
            assert r.terms is None
            continue
        seen, added = r.text.lower().split(), []
        for o in want[r.item_id]:
            for t in rules[o][2]:
                if len(added) < 4 and not set(t.split()) & set(seen):
                    seen, added = seen + t.split(), [*added, t]
        assert r.terms == added
    none = spark.createDataFrame([(1, "flour")], "item_id long, text string")
    assert expand.matches(none, []).count() == 0 and expand.explain(none, []).first().explanation == expand.MESSAGE


def test_weight_grid_has_70_triples():
    assert len(evaluate.weight_grid()) == 70


def test_mmr_prefers_other_documents():
    v = np.array([[1, 0], [1, 0.01], [0, 1.0]])
    assert ranking.mmr_pick(np.array([0.9, 0.89, 0.5]), v, None, 2, 0.5) == [0, 2]
    assert ranking.mmr_pick(np.array([0.9, 0.8]), v[:2], None, 3, 0.5) == [0, 1]


def _found(df, key="vec_id"):
    return {(r.query_id, r[key]) for r in df.collect()}


def test_ivf_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = rows.filter("vec_id % 20 = 0")
    exact = _found(vector.cosine_topk(q, rows, 10))
    assert len(exact & _found(vector.ivf_topk(q, rows, 10))) / len(exact) >= 0.9
    index = vector.build_index(rows)
    assert index.report() == {"index_type": "ivf", "nlist": 22, "nprobe": 10} and vector.build_index(rows, kind="flat").kind == "flat"
    assert _found(index.search(q, 10, 22)) == exact == _found(vector.build_index(rows, kind="flat").search(q, 10))
    assert vector.cells(100) == 1 and vector.cells(10**8) == 10**4


def test_kept_cells_of_a_table_with_structure(spark, tmp_path):
    """Recall of 0.9 and more from under 40 % of the rows, and only the folders of probed cells are read."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    points = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, 7, [float(x) for x in v]) for i, v in enumerate(points)], "vec_id long, part long, embedding array<float>")
    q = rows.filter("vec_id % 20 = 0")
    exact = _found(vector.cosine_topk(q, rows, 10, ["vec_id", "part"]))
    brute = np.argsort(-np.round(points.astype(np.float32).astype(float)[::20] @ points.astype(np.float32).astype(float).T, 9), 1, kind="stable")[:, :10]
    assert exact == {(20 * i, int(j)) for i, r in enumerate(brute) for j in r}
    index = vector.kept_index(rows, ["vec_id", "part"], path=str(tmp_path), recall=0.95)
    assert len(exact & _found(index.search(q, 10))) / len(exact) >= 0.9 and index.read_share(q) < 0.4
    plan = index._in_cells(index._probed(q.filter("vec_id = 0"), 1, None))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(cell#", plan) and len({r.cell for r in index._in_cells(index._probed(q.filter("vec_id = 0"), 1, None)).select("cell").distinct().collect()}) == 1
    again = vector.open_index(spark, str(tmp_path), index.assigned.schema, index.n_cells, ["vec_id", "part"], "embedding", index.probes)
    assert _found(again.search(q, 10)) == _found(index.search(q, 10))


@pytest.mark.parametrize("limits", [(13, 5, 4), (64, 7, 1000)])
def test_vector_search_in_blocks_and_empty(spark, monkeypatch, limits):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = rows.unionByName(rows.filter("vec_id < 30").withColumn("vec_id", F.col("vec_id") + 100_000))  # ties
    q = rows.filter("vec_id % 5 = 0")
    found = lambda: sorted((r.query_id, r["rank"], r.vec_id, round(r.cosine, 9)) for r in vector.cosine_topk(q, rows, 4).collect())
    ids, v = zip(*sorted((r.vec_id, r.embedding) for r in rows.collect()), strict=True)
    m = np.asarray(v, np.float64)
    want = []
    for i, a in zip(ids, m, strict=True):
        if i % 5 == 0:
            score = np.round(m @ a, 9)
            want += [(i, k + 1, ids[j], score[j]) for k, j in enumerate(np.argsort(-score, kind="stable")[:4])]
    assert [r[:3] for r in found()] == [r[:3] for r in want]
    for name, value in zip(("ROW_BLOCK", "QUERY_BLOCK", "HELD"), limits, strict=True):
        monkeypatch.setattr(vector, name, value)
    assert [r[:3] for r in found()] == [r[:3] for r in want]
    monkeypatch.setattr(vector, "MOST_BYTES", 0)
    assert [r[:3] for r in found()] == [r[:3] for r in want]
    assert vector.cosine_topk(q.filter("false"), rows, 4).count() == vector.cosine_topk(q, rows.filter("false"), 4).count() == 0
    nulls = rows.unionByName(spark.createDataFrame([(None, None, 1), (5, None, 1)], rows.schema))
    assert vector.cosine_topk(nulls, nulls, 2).count() == 2 * rows.count()
    assert vector.kept_index(rows.filter("false")).search(q, 3).count() == 0


def test_cache_keys_hold_all_parameters():
    c = QueryCache(2)
    assert c.key("A ", k=1) == c.key("a", k=1) != c.key("a", k=10)
    for k in "abc":
        c.set(k, k)
    assert c.get("a") is None and c.get("c") == "c"


def test_engine_index_and_ask(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "index")
    built = Engine.build(docs, path)
    engine = Engine.load(docs, path)
    got = engine.ask("the and that of", k=2)
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) == 2
    assert engine.ask("the and that of", k=2) is got and engine.response("the and that of", 2)["from_cache"] and not engine.response("the and that", 2)["from_cache"]
    assert len(engine.ask("zzzz", k=0)) == 3  # a question that matches nothing is answered all the same
    with pytest.raises(ValueError):
        engine.ask("  ")
    for other, settings in ((docs.limit(3), {}), (docs, {"contextual": False}), (docs.withColumn("source", F.lit("x")), {})):
        with pytest.raises(ValueError):
            Engine.load(other, path, **settings)
    stats = built.stats()
    assert stats["n_chunks"] == built.chunks().count() and stats["mean_norm"] == 1.0 and stats["index_type"] == "inverted"
    again = Engine.open(docs, str(tmp_path / "many"))
    assert Engine.open(docs, str(tmp_path / "many")).path == again.path != Engine.open(docs, str(tmp_path / "many"), reindex=True).path
    asked = spark.createDataFrame([(1, "the and that of"), (2, "la maison de la")], "item_id long, text string")
    one = sorted(map(tuple, built.search(asked).collect()))
    plain = Engine.build(docs, contextual=False)
    assert len(one) == 6 and len(plain.search(asked, 2, use_mmr=False, use_expansion=False).collect()) == 4
    found = evaluate_engine(built, spark.createDataFrame([(1, "the and that of", [got[0].doc_id]), (2, "nothing of it", [])], "id long, query string, expected array<long>"))
    assert (found["n_positive"], found["n_negative"], found["n"]) == (1, 1, 2) and found["avg_time_ms"] > 0


def test_folders_of_postings_change_nothing(spark, monkeypatch):
    docs, asked = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, Engine.build(docs).search(asked).collect()))
    monkeypatch.setattr(session, "FOLDER_CHUNKS", 100)
    many = Engine.build(docs)
    assert many.config["folders"] > 3 and sorted(map(tuple, many.search(asked).collect())) == want


def test_a_search_of_a_batch_writes_less_than_three_times_its_documents(spark, tmp_path, monkeypatch):
    """All that search_full writes into the shared folder, against the table that it reads; and the rows that an index with all tables gives."""
    d = SF.replace("sf0.001", "sf0.01")
    docs, asked = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    with monkeypatch.context() as m:
        m.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
        got = sorted(map(tuple, registry.queries()["search_full"](spark, d).collect()))
    size = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path) for f in files)
    assert size < 3 * os.path.getsize(f"{d}/documents.parquet")
    full = Engine.build(docs)
    assert sorted(map(tuple, full.search(asked).collect())) == got
    batch = Engine.build(docs, inverted=False)
    assert batch.ask("the and that of") == full.ask("the and that of") and batch.verify() is batch  # a single question


def test_windows_of_many_short_sentences(spark, monkeypatch):
    """Windows that go on behind the first sentences that are tried, and prefixes of texts with blanks before and behind their words."""
    rows = [(i, "s", " ".join(f"{'Word ' * (i % 3)}End{j}." for j in range(10 * i))) for i in range(12)] + [(20, "t", "\n a  b "), (21, "", " ".join("abcdefgh" * 5)), (22, "u", " " + "w " * 34 + "x y"), (23, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = chunk.chunk(docs).orderBy("doc_id", "chunk_ord").collect()
    assert max(r.end_pos - r.start_pos for r in got) > 3 * chunk.NEAR
    monkeypatch.setattr(chunk, "NEAR", chunk.MAX_WORDS)
    assert chunk.chunk(docs).orderBy("doc_id", "chunk_ord").collect() == got
    prefixes = {r.doc_id: r.p for r in docs.select("doc_id", chunk.prefix().alias("p")).collect()}
    assert prefixes == {i: ". ".join([*([s] if s else []), " ".join(t.split()[:35])]) for i, s, t in rows}


def _maker(shift, dims=26):
    """An encoder by letters, local, so that it travels to the workers by value."""

    class Letters:
        dimensions = dims

        def encode(self, texts):
            import numpy as np

            return np.asarray([[t.lower().count(chr(97 + (i + shift) % 26)) for i in range(dims)] for t in texts], float)

    Letters.identity = f"letters-{shift}-{dims}"
    return Letters


def test_engine_with_an_encoder(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    make = _maker(0)
    engine = Engine.build(docs, encoder=make)
    asked = spark.createDataFrame([(1, "the and that of"), (2, "la maison de la")], "item_id long, text string")
    got, exact = engine.search(asked).collect(), engine.search(asked, exact=True).collect()
    stats = engine.stats()
    assert len(got) == len(exact) == 6 and stats["embedding_dim"] == 26 and stats["mean_norm"] == pytest.approx(1, abs=1e-4)
    assert (stats["index_type"], stats["nlist"]) == ("ivf", vector.cells(stats["n_chunks"])) and 1 <= stats["nprobe"] <= stats["nlist"]
    near, all_ = (set(map(tuple, engine._nearest(asked, 30, e).select("query_id", "chunk_id").collect())) for e in (False, True))
    assert len(near & all_) >= 0.9 * len(all_) == 54
    assert encode.encode_single(make(), "aab").tolist() == pytest.approx([2 / 5**0.5, 1 / 5**0.5, *[0] * 24])
    for other in (None, _maker(1)):
        with pytest.raises(ValueError):
            Engine(spark, engine.path, other)


def test_another_encoder_gets_another_index(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    made = [Engine.open(docs, str(tmp_path), encoder=m) for m in (_maker(0), _maker(1), _maker(0, 5), _maker(0), None)]
    assert made[0].path == made[3].path and len({e.path for e in made}) == 4
    assert encode.identity(None) is None and encode.identity(functools.partial(_maker, 1)) != encode.identity(functools.partial(_maker, 2))


@pytest.mark.parametrize("last", ["chunks", "heads", "postings", "idf", "vocabulary", "weights", "forward"])
def test_a_build_that_ends_early_is_never_read(spark, tmp_path, monkeypatch, last):
    """Killed after any table, it is followed by a build that succeeds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)

    def until(write):
        def run(*args, **settings):
            out = write(*args, **settings)
            if str(args[-1] if isinstance(args[-1], str) else args[2]).endswith(f"/{last}") or (len(args) > 2 and str(args[2]).endswith(f"/{last}")):
                raise KeyboardInterrupt
            return out

        return run

    with monkeypatch.context() as m:
        m.setattr(session, "dealt", until(session.dealt))
        m.setattr(DataFrameWriter, "parquet", until(DataFrameWriter.parquet))
        with pytest.raises(KeyboardInterrupt):
            Engine.open(docs, str(tmp_path))
    engine = Engine.open(docs, str(tmp_path))
    assert len(engine.ask("the house of it")) == 3 and Engine.open(docs, str(tmp_path)).path == engine.path
    assert len([p for p in os.listdir(os.path.dirname(engine.path)) if not p.startswith(".")]) == 2


def test_a_damaged_index_is_built_anew(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    first = Engine.open(docs, str(tmp_path))
    folder = first.path.removeprefix("file:")
    victim = next(os.path.join(d, f) for d, _, files in os.walk(f"{folder}/postings") for f in files if f.endswith(".parquet"))
    os.remove(victim)
    second = Engine.open(docs, str(tmp_path))
    assert second.path != first.path and Engine.open(docs, str(tmp_path)).path == second.path
    with open(f"{second.path.removeprefix('file:')}/config/part-torn.txt", "w") as f:
        f.write("{")
    assert len(Engine.open(docs, str(tmp_path)).ask("the house")) == 3


def test_repeated_ids_and_empty_corpora(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    long = docs.orderBy(F.desc(F.length("text"))).limit(2)
    a, b = (r.text for r in long.collect())
    once = Engine.build(spark.createDataFrame([(1, "s", a)], docs.schema)).stats()["n_chunks"]
    both = Engine.build(spark.createDataFrame([(1, "s", a), (2, "s", b)], docs.schema)).stats()["n_chunks"]
    many = Engine.build(spark.createDataFrame([(1, "s", a)] * 3 + [(1, "s", b), (None, "s", a), (2, "s", None)], docs.schema))
    assert many.stats()["n_chunks"] == both > once > 1 and many.stats()["n_docs"] == 1
    assert many.chunks().select("chunk_id").distinct().count() == both and [r[0] for r in many.chunks().select("chunk_ord").orderBy("chunk_ord").collect()] == list(range(both))
    asked = spark.createDataFrame([(1, "the and of"), (1, "the and of"), (1, "zzz"), (2, None)], "item_id long, text string")
    for mmr in (True, False):
        got = many.search(asked, 2, use_mmr=mmr).collect()
        assert sorted((r.query_id, r["rank"]) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)] and len({(r.query_id, r.chunk_id) for r in got}) == 4
    for make in (None, _maker(0)):
        none = Engine.build(docs.filter("false"), encoder=make)
        assert none.search(asked).count() == 0 and none.ask("the house") == [] and none.stats()["n_chunks"] == 0 and none.verify() is none


def test_every_table_of_the_index_is_read_by_folder(spark, monkeypatch):
    """Plans of what a search reads have a partition filter on each dealt table."""
    monkeypatch.setattr(session, "FOLDER_CHUNKS", 20)
    engine = Engine.build(spark.read.parquet(f"{SF}/documents.parquet"))
    assert engine.config["folders"] > 20
    seen = {}

    def spy(table, column, wanted, most):
        out = in_folders(table, column, wanted, most)
        plan = out._jdf.queryExecution().executedPlan().toString()
        seen[re.search(r"/(\w+)/folder=", out.inputFiles()[0]).group(1)] = bool(re.search(r"PartitionFilters: \[[^\]]*folder#\d+ IN|PartitionFilters: \[[^\]]*folder#\d+ = ", plan))
        return out

    from quarry.shared import in_folders

    monkeypatch.setattr(session, "in_folders", spy)
    assert len(engine.ask("the and that of the river")) == 3
    assert seen == dict.fromkeys(("weights", "postings", "idf", "chunks", "forward"), True)


def test_equal_questions_at_once_share_a_search():
    cache, made, gate = QueryCache(), [], threading.Event()

    def make():
        made.append(1)
        gate.wait(20)
        return ["found"]

    def fails():
        raise OSError("gone")

    with ThreadPoolExecutor(16) as pool:
        flights = [pool.submit(cache.once, "k", make) for _ in range(16)]
        gate.set()
        assert sorted(f.result()[1] for f in flights) == [False] + [True] * 15 and len(made) == 1
        for _ in range(2):  # a failure isn't kept
            with pytest.raises(OSError):
                cache.once("other", fails)
        list(pool.map(lambda i: (cache.set(str(i), i), cache.get(str(i - 1))), range(2000)))
    assert len(cache.held) == cache.size


def test_fronts(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    for i in range(4):
        (tmp_path / "docs" / f"d{i}.txt").write_text(f"Document {i} speaks of {'wheat flour and dough' if i % 2 else 'river water and stones'}. " * 12)
    (tmp_path / "docs" / "x.bin").write_text("x")
    index = str(tmp_path / "index")
    assert main(["--data", str(tmp_path / "docs"), "--index", index], ["wheat flour dough", ":stats", ":clear", ":help", "", "x" * 600, ":quit", "never"]) == 0
    said = capsys.readouterr().out
    assert "'n_skipped': 1" in said and "#1 d" in said and "n_docs: 4" in said and "cache cleared" in said and "error" in said and "never" not in said
    assert main(["--data", str(tmp_path / "no"), "--index", index], []) == 1
    assert Service().answer("GET", "/health")[0] == 503
    loaded = loaders.load_folder(spark, str(tmp_path / "docs")).filter("id IS NOT NULL").select(F.xxhash64("id").alias("doc_id"), "title", F.col("content").alias("text"))
    service = Service(Engine.open(loaded, index, title="title"), 1.5)
    status, body = service.answer("POST", "/search", b'{"query": " wheat flour ", "top_k": 2}')
    assert status == 200 and body["query"] == "wheat flour" and [r["rank"] for r in body["results"]] == [1, 2] and not body["from_cache"]
    assert service.answer("POST", "/search", b'{"query": "wheat flour", "top_k": 2}')[1]["from_cache"]
    assert [service.answer("POST", "/search", b)[0] for b in (b"", b"{", b'{"query": " "}', b'{"query": "x", "top_k": 11}', b'{"query": "x", "top_k": true}')] == [422] * 5
    assert service.answer("GET", "/health") == (200, {"status": "ok", "n_chunks": 4, "n_docs": 4, "model": "TF-IDF", "startup_time_s": 1.5})
    assert service.answer("GET", "/stats")[1]["diversification"] == "MMR" and service.answer("GET", "/")[0] == 200 and service.answer("GET", "/x")[0] == 404
    starting, gate = Service(), threading.Event()
    server = serve(starting, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    place = f"http://127.0.0.1:{server.server_address[1]}"
    building = starting.start(lambda: gate.wait(60) and service.engine)
    with pytest.raises(urllib.error.HTTPError, match="503"):
        urllib.request.urlopen(f"{place}/health", timeout=60)
    gate.set()
    building.join(60)
    asked, searched = service.engine._found, []
    service.engine._found = lambda *a: (searched.append(a), asked(*a))[1]

    def post(i):
        with urllib.request.urlopen(urllib.request.Request(f"{place}/search", b'{"query": "river stones"}'), timeout=120) as r:
            return r.status, [x["doc_title"] for x in json.load(r)["results"]]

    with ThreadPoolExecutor(16) as pool:
        answers = list(pool.map(post, range(16)))
    assert len(searched) == 1 and answers == [answers[0]] * 16 and answers[0][0] == 200
    with urllib.request.urlopen(f"{place}/health", timeout=60) as r:
        assert json.load(r)["startup_time_s"] == starting.startup_s > 0
    server.shutdown()
    broken = Service()
    broken.start(lambda: 1 // 0).join(60)
    assert broken.answer("GET", "/health")[0] == 503 and "ZeroDivisionError" in broken.answer("GET", "/health")[1]["detail"]
    server.server_close()


def test_metric_deltas_and_repeated_documents(spark):
    assert evaluate.deltas({"mrr": 0.5, "hit1": 0.3, "avg_time_ms": 10.0}, {"mrr": 0.5004, "hit1": 0.2, "avg_time_ms": 20.0}) == {"mrr": (-0.0004, "equal"), "hit1": (0.1, "better"), "time_ratio": 2.0}
    found = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 7, 3)], "query_id long, doc_id long, rank long")
    relevant, asked = spark.createDataFrame([(1, 7)], "query_id long, doc_id long"), spark.createDataFrame([(1,)], "query_id long")
    assert [evaluate.graded(found, relevant, asked, once=o).select(evaluate.ndcg()).first()[0] for o in (False, True)] == pytest.approx([2.1309, 1.0], abs=1e-4)


def test_json_truthiness(spark):
    given = ['{"title": 0, "name": "N", "content": [], "body": "B"}', '{"title": "0", "text": false, "texte": 7, "id": 5}', "[1]", None, '{"name": null, "titre": true, "content": {}}']
    got = loaders.json_documents(spark.createDataFrame([(i, g) for i, g in enumerate(given)], "k int, json string"), stem="My File").orderBy("k").collect()
    assert [(r.id, r.title, r.content) for r in got] == [("my_file", "N", "B"), ("5", "0", "7"), ("my_file", "My File", ""), ("my_file", "My File", ""), ("my_file", "True", "")]


def test_json_items_are_numbered(spark):
    rows = spark.createDataFrame([(0, '{"text": "T"}'), (1, '{"id": 5, "name": "N"}'), (2, "{}")], "k int, json string")
    got = loaders.json_documents(rows, stem="My File", index="k").orderBy("k").collect()
    assert [(r.id, r.title) for r in got] == [("my_file_0", "My File_0"), ("5", "N"), ("my_file_2", "My File_2")]


def test_repeated_ids_of_files(spark, tmp_path):
    for name in ("a.txt", "A.txt", "a_2.txt", "a.json"):
        (tmp_path / name).write_text('{"id": "a", "text": "x"}' if name.endswith("json") else name)
    assert {r.file: r.id for r in loaders.load_folder(spark, str(tmp_path)).collect()} == {"A.txt": "a", "a.json": "a__2", "a.txt": "a__3", "a_2.txt": "a_2"}


def test_ids_of_files_are_unique_at_once_and_again(spark):
    # "a" is repeated, and what its second row would be called is another's own id, twice
    given = [("f1", 0, "a"), ("f2", 0, "a"), ("f3", 0, "a__2"), ("f4", 0, "a__2"), ("f5", 0, "b"), ("f6", 0, None), ("f7", 0, None), *[("g", i, "hot") for i in range(400)]]
    docs = spark.createDataFrame(given, "file string, item_index int, id string").repartition(7)
    got = {(r.file, r.item_index): r.id for r in loaders.unique_ids(docs).collect()}
    ids = [v for v in got.values() if v is not None]
    assert len(got) == len(given) and len(ids) == len(set(ids)) == len(given) - 2
    assert (got["f1", 0], got["f5", 0], got["f6", 0], got["f7", 0]) == ("a", "b", None, None)
    assert [got["g", i] for i in range(400)] == ["hot", *[f"hot__{i}" for i in range(2, 401)]]
    once = spark.createDataFrame([("f", 0, "x")], "file string, item_index int, id string")
    assert loaders.unique_ids(once) is once


JSON_TEXTS = [
    '[{"id": 7, "name": "N", "text": "T"}, 3, null, [1], {"title": "", "body": "B"}, {}]', ' \n{"titre": "R", "texte": true}\t', "[]", "5", '"x"', "null", "", "[", '{"a": 1}, {"b": 2}', "[1] x",
    '[{"id": "é", "content": {"a": [1]}}]', '[{"id": 0, "title": false, "content": "c"}]', "\ufeff{}", "[[{}]]", '{"text": "%s"}' % ("long " * 300_000), None,
]


def brute_items(text, stem):
    """json_items of one text, by Python's parser."""
    if text is None:
        return []
    try:
        root = json.loads(text)
    except ValueError:
        return [(None, None, None, None, True)]
    out = []
    for i, item in enumerate(root if isinstance(root, list) else [root]):
        if isinstance(item, dict):
            said = lambda v: json.dumps(v, separators=(",", ":")) if isinstance(v, dict | list) else str(v)
            pick = lambda *keys: next((said(item[k]) for k in keys if item.get(k)), None)  # noqa: B023, E731
            slug = "_".join(w for w in re.split("[^a-z0-9]+", stem.lower()) if w)
            out.append((i, pick("id") or f"{slug}_{i}", pick("title", "name", "titre") or f"{stem}_{i}", pick("content", "text", "texte", "body") or "", False))
    return out


def test_json_items_against_python(spark):
    # columns of the same names as the results' are replaced, others come along
    rows = spark.createDataFrame([(i, t, f"My File {i}", "mine") for i, t in enumerate(JSON_TEXTS)], "k int, json string, stem string, title string")
    found = loaders.json_items(rows)
    assert found.columns == ["k", "stem", "item_index", "id", "title", "content", "error"] and "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    got = sorted(((r.k, r.item_index, r.id, r.title, r.content, r.error is not None) for r in found.collect()), key=str)
    assert got == sorted(((i, *r) for i, t in enumerate(JSON_TEXTS) for r in brute_items(t, f"My File {i}")), key=str)
    assert loaders.json_items(rows.limit(0)).count() == 0
    repeated = spark.createDataFrame([('[{"a": 1, "a": 2}]', "s")], "json string, stem string")
    assert loaders.json_items(repeated).first().error


def test_folder_without_python(spark, tmp_path, monkeypatch):
    (tmp_path / "a.TXT").write_text("\u2003 a text \x1f\n", newline="")
    (tmp_path / "b.json").write_text("\n".join(["[", ",".join(json.dumps({"id": f"i{i % 3}", "text": f"t{i}"}) for i in range(6)), "]"]))
    (tmp_path / "c.json").write_text("[1, 2]")
    (tmp_path / "d.txt").write_text(" ")
    (tmp_path / "lang=de").mkdir()
    (tmp_path / "lang=de" / "e.txt").write_text("not right in the folder")
    (tmp_path / "other").write_text("x" * 1000)
    monkeypatch.setattr(loaders, "LARGEST_FILE", 500)
    (tmp_path / "big.txt").write_text("x" * (loaders.LARGEST_FILE + 1))
    loaded = loaders.load_folder(spark, str(tmp_path), ordered=False)
    got = {(r.file, r.item_index): (r.id, r.content, r.error) for r in loaded.collect()}
    ids = ["i0", "i1", "i2", "i0__2", "i1__2", "i2__2"]
    assert got == {("a.TXT", 0): ("a", "a text", None), ("d.txt", 0): ("d", "", None), ("other", 0): (None, None, None), ("big.txt", 0): (None, None, f"ValueError: file of {loaders.LARGEST_FILE + 1} bytes"), **{("b.json", i): (k, f"t{i}", None) for i, k in enumerate(ids)}}
    plan = loaded._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan
    counts = loaders.folder_summary(loaded).first()
    assert (counts.n_docs, counts.n_skipped, counts.n_errors) == (8, 1, 1)
    (tmp_path / "none").mkdir()
    assert loaders.load_folder(spark, str(tmp_path / "none")).count() == 0


def test_more_letterheads(spark):
    given = spark.createDataFrame([("ACME GmbH\nPage 1 of 2\nbody",)], "t string")
    assert given.select(T.boilerplate(F.col("t"), [r"(?m)^ACME.*$"])).first()[0].strip() == "body"


def test_folder(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b" hello \xff ")
    (tmp_path / "a.json").write_text('[{"name": "N", "text": "T"}, 3, {"title": "", "body": "B"}]')
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.bin").write_bytes(b"x")
    got = {(r.file, r.id): r for r in loaders.load_folder(spark, str(tmp_path)).collect()}
    assert got[("b.txt", "b")].content == "hello �"
    assert (got[("a.json", "a_0")].title, got[("a.json", "a_2")].content) == ("N", "B")
    assert got[("c.json", None)].error and got[("d.pdf", None)].error and len(got) == 6
    loaded = loaders.load_folder(spark, str(tmp_path), lambda raw: "Page 1 of 2\nThe text • of it")
    assert [r.file for r in loaded.collect()] == sorted(r.file for r in loaded.collect())
    said = loaders.folder_summary(loaded).first()
    assert (said.n_docs, said.n_skipped, said.n_errors, [e[:6] for e in said.errors]) == (4, 1, 1, ["c.json"])
    assert loaded.filter("file = 'd.pdf'").first().content == "The text - of it"
    loaders.export_text(loaded, str(tmp_path / "out"))
    assert "The text - of it" in {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    with pytest.raises(FileNotFoundError):
        loaders.load_folder(spark, str(tmp_path / "none"))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rank" in df.columns
