"""The jobs as registered queries: each runs twice into one new folder, and what it wrote is read back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import oracle as O
from quarry.shared import shared_path

from . import evaluate, ingest


def _together(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of a job's tables, with the table's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("kind", F.lit(n)) for n, t in tables.items()])


def job1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = shared_path(spark, "job1")
    config = {"documents": f"{sf_dir}/documents.parquet", "output": f"{place}/out", "checkpoint": f"{place}/checkpoint"}
    for _ in range(2):
        ingest.run(spark, config)
    return _together({n: ingest.stored(spark, config["output"], n) for n in ("documents", "chunks")})


def job2_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"documents": f"{sf_dir}/documents.parquet", "questions": f"{sf_dir}/benchmark.parquet", "output": shared_path(spark, "job2")}
    for _ in range(2):
        evaluate.run(spark, config)
    return _together({n: evaluate.stored(spark, config["output"], n) for n in evaluate.SCHEMAS})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_ingest, job2_evaluate)}


def _columns(rows: list[str], types: dict[str, str]) -> str:
    """The rows of several SELECTs, each with the columns that it has: of the others null."""
    every = lambda names: ", ".join(n if n in names else f"CAST(NULL AS {t}) AS {n}" for n, t in types.items())
    return " UNION ALL ".join(f"SELECT {every(names.split())} FROM {source}" for names, source in rows)


_CLEAN, _CLEANED = O._chain(list(T.STEPS), "documents")
_SLUG = "regexp_replace(regexp_replace(lower(CASE WHEN coalesce(source, '') = '' THEN 'none' ELSE source END), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
JOB1_SQL = f"""WITH RECURSIVE {_CLEAN}, {O._CHUNKS.replace("AS ls FROM documents)", f"AS ls FROM {_CLEANED})", 1)},
raw AS (SELECT doc_id, source AS title, sha256(coalesce(text, '')) AS digest, CAST(length(coalesce(text, '')) AS BIGINT) AS raw_chars, CAST(0 AS BIGINT) AS batch, coalesce(nullif({_SLUG}, ''), 'other') AS part FROM documents),
dd AS (SELECT raw.*, 'documents' AS kind, text FROM raw JOIN {_CLEANED} USING (doc_id)),
cc AS (SELECT raw.*, 'chunks' AS kind, chunk_ord, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos, CAST(word_count AS BIGINT) AS word_count, quality_score, text FROM raw JOIN ck USING (doc_id))
""" + _columns(
    [("kind doc_id title digest raw_chars text batch part", "dd"), ("kind doc_id title digest chunk_ord start_pos end_pos word_count quality_score text batch part", "cc")],
    {"kind": "VARCHAR", "doc_id": "BIGINT", "title": "VARCHAR", "digest": "VARCHAR", "raw_chars": "BIGINT", "text": "VARCHAR", "batch": "BIGINT", "part": "VARCHAR", "chunk_ord": "BIGINT", "start_pos": "BIGINT", "end_pos": "BIGINT", "word_count": "BIGINT", "quality_score": "DOUBLE"},
)

_GRADES = f"""
nr AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY query_id),
ht AS (SELECT query_id, pipeline, min(rank) AS first, sum(1 / log2(rank + {O._D.format(1)})) AS gain FROM re WHERE relevant GROUP BY query_id, pipeline),
gr AS (SELECT item_id AS query_id, pl.pipeline, coalesce(n_relevant, 0) AS n_relevant, first, gain FROM benchmark CROSS JOIN (SELECT unnest(['baseline', 'bm25', 'hybrid']) AS pipeline) pl LEFT JOIN nr ON nr.query_id = item_id LEFT JOIN ht ON ht.query_id = item_id AND ht.pipeline = pl.pipeline),
me AS (SELECT *, round({O._D.format(0.5)} * mrr + {O._D.format(0.3)} * hit1 + {O._D.format(0.2)} * hit3, 4) AS composite FROM (SELECT pipeline, {O._MET} FROM gr GROUP BY pipeline))"""
JOB2_SQL = f"""WITH {O._HY}, {O._tfidf(5000, 2, "z")}{O._REL},
tb AS (SELECT query_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm),
ra AS (SELECT 'baseline' AS pipeline, query_id, doc_id, rank, cosine AS score FROM zpool UNION ALL SELECT 'bm25', query_id, doc_id, rank, score FROM tb UNION ALL SELECT 'hybrid', query_id, doc_id, rank, final FROM hy),
re AS (SELECT pipeline, query_id, doc_id, rank, round(score, 4) AS score, rel.doc_id IS NOT NULL AS relevant FROM (SELECT * FROM ra WHERE rank <= 3) LEFT JOIN rel USING (query_id, doc_id)),{_GRADES},
rs AS (SELECT 'results' AS kind, * FROM re), qs AS (SELECT 'questions' AS kind, pipeline, query_id, n_relevant, first, round({O._NDCG}, 4) AS ndcg FROM gr), ms AS (SELECT 'metrics' AS kind, * FROM me)
""" + _columns(
    [("kind pipeline query_id rank doc_id score relevant", "rs"), ("kind pipeline query_id n_relevant first ndcg", "qs"), ("kind pipeline n hit1 hit3 mrr ndcg3 composite", "ms")],
    {"kind": "VARCHAR", "pipeline": "VARCHAR", "query_id": "BIGINT", "rank": "BIGINT", "doc_id": "BIGINT", "score": "DOUBLE", "relevant": "BOOLEAN", "n_relevant": "BIGINT", "first": "BIGINT", "ndcg": "DOUBLE", "n": "BIGINT", "hit1": "DOUBLE", "hit3": "DOUBLE", "mrr": "DOUBLE", "ndcg3": "DOUBLE", "composite": "DOUBLE"},
)


def oracle_sql() -> dict[str, str]:
    return {"job1_ingest": JOB1_SQL, "job2_evaluate": JOB2_SQL}
