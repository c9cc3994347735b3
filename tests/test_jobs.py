"""The jobs: two runs over growing input, reruns, failures in between, odd rows, and their command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import common, evaluate, ingest, queries
from quarry.functions import text as T
from quarry.operators import chunk, lexical, sparse

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]
LONG = "The first sentence of it has quite a few words in it. " * 8


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def _deliver(spark, rows, place):
    """A file of documents that appears in a folder."""
    spark.createDataFrame(rows, "doc_id long, text string, source string, batch string").coalesce(1).write.mode("append").parquet(f"{place}/in")



def _config(place):
    return {"documents": f"{place}/in", "output": f"{place}/out", "checkpoint": f"{place}/checkpoint"}


def _expected(spark, rows):
    """What a run over exactly these (doc_id, text, source) gives."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clean = docs.select("doc_id", "source", T.clean(docs.text).alias("text"))
    return _rows(clean, "doc_id", "source", "text"), _rows(chunk.chunk(clean, keep=("source",)), "doc_id", "source", "chunk_ord", "text")


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    place = str(tmp_path)
    first = [(1, LONG, "a", "x"), (2, "short one", None, "x"), (3, None, "", "x"), (None, LONG + "Other.", "A b", "x"), (4, "Page 1 of 2\n" + LONG, "a", "x"), (4, "Page 1 of 2\n" + LONG, "a", "x")]
    _deliver(spark, first, place)
    said = ingest.run(spark, _config(place))
    assert (said["read"], said["repeated"], said["unchanged"], said["documents"], said["batches"]) == (6, 1, 0, 5, 1)
    once = [r[:3] for r in first[:5]]
    docs, chunks = _expected(spark, once)
    stored = lambda name: ingest.stored(spark, f"{place}/out", name)
    assert _rows(stored("documents"), "doc_id", "title", "text") == docs and _rows(stored("chunks"), "doc_id", "title", "chunk_ord", "text") == chunks
    assert ingest.run(spark, _config(place))["batches"] == 0  # nothing is new
    second = [(1, LONG, "a", "x"), (2, LONG, None, "x"), (5, LONG + "Of five.", "a", "x"), (3, "", "", "x")]  # unchanged, changed, new, and the empty text as before
    _deliver(spark, second, place)
    said = ingest.run(spark, _config(place))
    assert (said["read"], said["unchanged"], said["documents"]) == (4, 2, 2)
    assert _rows(stored("documents"), "doc_id", "title", "text") == sorted([*docs, *_expected(spark, [(2, LONG, None), (5, LONG + "Of five.", "a")])[0]], key=str)
    latest = [(1, LONG, "a"), (2, LONG, None), (3, None, ""), (None, LONG + "Other.", "A b"), (4, "Page 1 of 2\n" + LONG, "a"), (5, LONG + "Of five.", "a")]
    assert _rows(ingest.current(spark, f"{place}/out"), "doc_id", "title", "chunk_ord", "text") == _expected(spark, latest)[1]
    assert _rows(ingest.current(spark, f"{place}/out", "documents"), "doc_id", "title", "text") == _expected(spark, latest)[0]
    assert {r.part for r in stored("documents").collect()} == {"a", "a_b", "none"}


def test_ingest_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    place = str(tmp_path)
    _deliver(spark, [(1, LONG, "a", "x")], place)
    ingest.run(spark, _config(place))
    _deliver(spark, [(2, LONG + "Two.", "b", "x"), (1, LONG + "One.", "a", "x")], place)

    def fails(*args, **settings):
        raise OSError("no space")

    with monkeypatch.context() as m:  # after the batch's documents are written
        m.setattr(ingest.chunk, "chunk", fails)
        with pytest.raises(Exception, match="no space"):
            ingest.run(spark, _config(place))
    assert ingest.run(spark, _config(place))["documents"] == 2
    want = [(1, LONG, "a"), (1, LONG + "One.", "a"), (2, LONG + "Two.", "b")]
    docs, chunks = _expected(spark, want)
    assert _rows(ingest.stored(spark, f"{place}/out", "documents"), "doc_id", "title", "text") == docs
    assert _rows(ingest.stored(spark, f"{place}/out", "chunks"), "doc_id", "title", "chunk_ord", "text") == chunks
    assert ingest.run(spark, _config(place))["batches"] == 0


def test_ingest_in_several_batches(spark, tmp_path):
    """As many files at a time as are asked for; a text that comes again in the same run is known."""
    place = str(tmp_path)
    for i in range(3):
        _deliver(spark, [(i, f"{LONG} Number {i}.", "s", "x"), (9, LONG, "s", "x")], place)
    said = ingest.run(spark, _config(place) | {"max_files_per_batch": 1, "min_words": 5})
    assert (said["batches"], said["documents"], said["unchanged"]) == (3, 4, 2)
    assert ingest.current(spark, f"{place}/out").filter("doc_id = 9").count() == ingest.stored(spark, f"{place}/out", "chunks").filter("doc_id = 9").count() > 0


def test_ingest_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/in")
    said = ingest.run(spark, _config(str(tmp_path)))
    assert said["documents"] == said["chunks"] == 0 and ingest.current(spark, f"{tmp_path}/out").count() == 0


def test_evaluate_replaces_only_what_it_measures(spark, tmp_path):
    place = str(tmp_path)
    docs = [(i, f"{w} river water and stones number {i} near the hill", "s") for i, w in enumerate(["wheat", "flour", "dough", "bread", "salt"])] + [(9, None, "s"), (2, "dough river water and stones number 2 near the hill", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{place}/docs")
    asked = [(1, "flour river water"), (2, "nothing of this kind"), (3, None), (None, "salt"), (4, "dough river water and stones number 2 near the hill")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{place}/asked")
    config = {"documents": f"{place}/docs", "questions": f"{place}/asked", "output": f"{place}/out"}
    said = evaluate.run(spark, config)
    assert said["relevant"] == 2 and said["bm25"]["n"] == 4 and said["bm25"]["hit1"] == 0.5
    every = {t: _rows(evaluate.stored(spark, config["output"], t), *[c.split()[0] for c in s.split(", ")]) for t, s in evaluate.SCHEMAS.items()}
    assert {r[-1] for r in every["metrics"]} == set(evaluate.PIPELINES) and len(every["questions"]) == 12
    files = lambda name: sorted(os.listdir(f"{place}/out/results/pipeline={name}"))
    before = {n: files(n) for n in evaluate.PIPELINES}
    evaluate.run(spark, config | {"pipelines": ["bm25"]})
    assert files("hybrid") == before["hybrid"] and files("baseline") == before["baseline"] and files("bm25") != before["bm25"]
    assert every == {t: _rows(evaluate.stored(spark, config["output"], t), *[c.split()[0] for c in s.split(", ")]) for t, s in evaluate.SCHEMAS.items()}
    with pytest.raises(ValueError, match="none of"):
        evaluate.run(spark, config | {"pipelines": ["other"]})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_job_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    before = dict(spark.sparkContext.getConf().getAll())
    modes = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert set(columns) == set(got.columns) and _rows(got, *columns) == sorted(want.fetchall(), key=str)
    assert modes == {k: spark.conf.get(k) for k in modes} and before == dict(spark.sparkContext.getConf().getAll())


def test_configuration_and_command_line(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"title": "source", "output": "held"}))
    assert common.configured(spark, str(tmp_path / "c.json"), {"output": "given", "documents": None}) == {"title": "source", "output": "given"}
    _deliver(spark, [(1, LONG, "a", "x")], str(tmp_path))
    command = [sys.executable, "-m", "jobs.ingest", "--config", "jobs/ingest.json", "--documents", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/checkpoint"]
    done = subprocess.run(command, cwd=REPO, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0 and "'documents': 1" in done.stderr, done.stderr[-2000:]
    assert ingest.stored(spark, f"{tmp_path}/out", "documents").count() == 1


def test_pipelines_of_a_run_share_their_steps(spark, tmp_path, monkeypatch):
    """Each pipeline counted the words and scored the documents anew before."""
    calls = []
    for owner, name in ((sparse, "word_counts"), (lexical.Bm25, "fit")):
        monkeypatch.setattr(owner, name, lambda *a, f=getattr(owner, name), n=name, **k: (calls.append(n), f(*a, **k))[1])
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma a b{i}") for i in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta1 gamma"), (2, "b7")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/d")
    asked.write.parquet(f"{tmp_path}/q")
    evaluate.run(spark, {"documents": f"{tmp_path}/d", "questions": f"{tmp_path}/q", "output": f"{tmp_path}/out"})
    assert sorted(calls) == ["fit", "word_counts"]
    rows = _rows(evaluate.stored(spark, f"{tmp_path}/out").filter("pipeline = 'bm25'"), "query_id", "rank", "doc_id", "score")
    assert rows == _rows(evaluate.ranked("bm25", docs, asked, 3), "query_id", "rank", "doc_id", "score")
