"""All registered queries of the retrieval engine; ``oracle`` holds the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, evaluate, expand, lexical, passages, ranking, tfidf, vector
from ..shared import sized, spread, written
from ..sources import loaders
from . import oracle

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return spread(table(spark, d, "documents"))


def _cleanable(spark, d):
    """Documents and literal rows that exercise every step."""
    extra = spark.createDataFrame(list(enumerate(oracle.FIXTURES)), "k long, text string").select((-1 - F.col("k")).alias("doc_id"), "text")
    return _docs(spark, d).select("doc_id", "text").unionByName(extra)


def _register_cleaning():
    def make(name, step):
        def run(spark, d):
            out = _cleanable(spark, d).select("doc_id", step(F.col("text")).alias("out"))
            return out.select("doc_id", F.length("out").cast("long").alias("n"), F.md5(F.col("out").cast("binary")).alias("digest"))

        run.__name__ = f"clean_{name}"
        _QUERIES[run.__name__] = run

    for name, step in T.STEPS.items():
        make(name, step)
    make("full", T.clean)


_register_cleaning()


@query
def clean_report(spark, d):
    out = _docs(spark, d).select("doc_id", "text", T.clean(F.col("text")).alias("out"))
    n = lambda c: F.size(T.words(F.col(c))).cast("long")
    return out.select("doc_id", F.length("text").cast("long").alias("raw_chars"), F.length("out").cast("long").alias("clean_chars"), n("text").alias("raw_words"), n("out").alias("clean_words"))


@query
def scan_documents(spark, d):
    return _docs(spark, d).select("doc_id", "source", F.length("text").cast("long").alias("n"))


@query
def json_coalesce(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, F.col("role")).alias("title"), F.col("role").alias("name"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("content"), F.col("text").alias("body"))).alias("json"))
    out = loaders.json_documents(rows)
    return out.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "title", "content")


@query
def json_items(spark, d):
    """The lines of every document as objects of one JSON array, by turns with and without an id, a title and a text."""
    line = lambda x, i: F.struct(F.when(i % 3 == 0, F.concat(F.lit("line "), i.cast("string"))).alias("id"), F.when(i % 2 == 0, F.lit("")).alias("title"), F.when(i % 2 == 0, F.lit("even")).alias("name"), x.alias("text"), F.lit("empty").alias("body"))
    rows = _docs(spark, d).select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("stem"), F.to_json(F.transform(F.split("text", "\n"), line)).alias("json"))
    return loaders.json_items(rows).select("doc_id", F.col("item_index").cast("long").alias("item_index"), "id", "title", F.md5("content").alias("digest"))


@query
def unique_ids(spark, d):
    """Documents under the name of their source, numbered by doc_id: few names, one of them with a large share of the rows."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("id"))
    return loaders.unique_ids(docs, ["doc_id"])


@query
def load_summary(spark, d):
    return loaders.load_summary(_docs(spark, d))


@query
def corpus_fingerprint(spark, d):
    return loaders.corpus_fingerprint(_docs(spark, d))


@query
def nonempty_docs(spark, d):
    return _docs(spark, d).filter(F.trim("text") != "").select("doc_id")


@query
def slugify(spark, d):
    return table(spark, d, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


@query
def query_cache_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(F.trim(F.lower("text")).cast("binary")).alias("cache_key"))


@query
def sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.md5(F.array_join(T.sentences(F.col("text")), "|").cast("binary")).alias("digest"))


@query
def quality_score(spark, d):
    return _docs(spark, d).select("doc_id", T.quality(F.col("text")).alias("quality"))


@query
def chunks(spark, d):
    return chunk.chunk(_docs(spark, d)).select("doc_id", "chunk_ord", "start_pos", "end_pos", "word_count", "quality_score", F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def contextual_text(spark, d):
    return chunk.contextual(_docs(spark, d)).select("doc_id", "chunk_ord", F.md5(F.col("context").cast("binary")).alias("digest"))


@query
def index_stats(spark, d):
    c = chunk.chunk(_docs(spark, d))
    return c.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg("quality_score"), 6).alias("avg_quality"), F.round(F.avg("word_count"), 6).alias("avg_words"))


@query
def running_words(spark, d):
    s = _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("doc_id", F.col("i").cast("long").alias("i"), F.sum(F.size(T.words(F.col("s")))).over(w).cast("long").alias("words_so_far"))


def _lines(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("line", T.strip(F.col("line")))


def _repeated(lines):
    return lines.filter((F.col("line") != "") & (F.length("line") < T.HEADER_CHARS)).groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= T.HEADER_REPEATS)


@query
def repeated_lines(spark, d):
    return _repeated(_lines(spark, d))


@query
def non_repeated_lines_anti(spark, d):
    lines = _lines(spark, d)
    return lines.join(_repeated(lines), ["doc_id", "line"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query
def neighbour_lines(spark, d):
    w = Window.partitionBy("doc_id").orderBy("i")
    blank = F.col("line") == ""
    return _lines(spark, d).select("doc_id", F.col("i").cast("long").alias("i"), F.coalesce(F.lag(blank).over(w), F.lit(True)).alias("prev_blank"), F.coalesce(F.lead(blank).over(w), F.lit(True)).alias("next_blank"))


@query
def tokens(spark, d):
    return lexical.tokens(_docs(spark, d)).groupBy("term").agg(F.count("*").alias("n"))


@query
def term_freq(spark, d):
    return lexical.term_freq(lexical.tokens(_docs(spark, d)))


@query
def doc_freq(spark, d):
    return lexical.doc_freq(lexical.term_freq(lexical.tokens(_docs(spark, d))))


@query
def doc_len(spark, d):
    return lexical.doc_len(_docs(spark, d))


@query
def corpus_stats(spark, d):
    docs = _docs(spark, d)
    s = lexical.corpus_stats(lexical.doc_len(docs))
    return s.select("n", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_idf(spark, d):
    docs = _docs(spark, d)
    return lexical.idf(lexical.doc_freq(lexical.term_freq(lexical.tokens(docs))), lexical.corpus_stats(lexical.doc_len(docs))).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark, d):
    return lexical.Bm25(_docs(spark, d)).fit(table(spark, d, "benchmark"), digits=6)


@query
def bm25_topk(spark, d):
    return _bm25(spark, d).top(3)


@query
def bm25_all(spark, d):
    s = _bm25(spark, d).pairs()
    every = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    n = _docs(spark, d).agg(F.count("*").alias("n"))
    return s.groupBy("query_id").agg(F.count("*").alias("n_matched"), F.round(F.sum("bm25"), 3).alias("total")).join(every, "query_id", "right").crossJoin(F.broadcast(n)).select("query_id", F.coalesce("n_matched", F.lit(0)).alias("n_matched"), (F.col("n") - F.coalesce("n_matched", F.lit(0))).alias("n_zero"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query
def p95_scores(spark, d):
    return _bm25(spark, d).p95().select("query_id", F.round("p95", 6).alias("p95"))


@query
def bm25_norm(spark, d):
    return _bm25(spark, d).shares(6)


@query
def candidate_scores_left(spark, d):
    pool = sized(_pool(spark, d).select("query_id", "doc_id"), "pool")
    return pool.table.join(_bm25(spark, d).of(pool), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def _pool(spark, d, features=tfidf.FEATURES, least=1):
    docs, asked = _docs(spark, d), table(spark, d, "benchmark")
    c = tfidf.nearest(docs, asked, ranking.pool_size(3), features, least, digits=6)
    return tfidf.pool(c, asked, docs, ranking.pool_size(3))


@query
def tfidf_weights(spark, d):
    return tfidf.fitted(_docs(spark, d)).weights(6)


@query
def baseline_tfidf(spark, d):
    return tfidf.fitted(_docs(spark, d), tfidf.BASELINE_FEATURES, least_chars=2).weights(6)


@query
def baseline_topk(spark, d):
    best = sized(_pool(spark, d, tfidf.BASELINE_FEATURES, 2).filter("rank <= 3"), "best")
    return _docs(spark, d).select("doc_id", "text").join(best.side(), "doc_id").select("query_id", "rank", "doc_id", F.round("cosine", 4).alias("score"), F.trim(F.replace(F.left("text", F.lit(300)), F.lit("\n"), F.lit(" "))).alias("text"))


@query
def random_projection(spark, d):
    return tfidf.fitted(_docs(spark, d)).projected()


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _vector_queries(spark, d):
    return _vectors(spark, d).filter("vec_id % 20 = 0")


@query
def l2_normalize(spark, d):
    v = _vectors(spark, d).withColumn("v", T.let(F.transform("embedding", lambda x: x * 3), vector.l2_normalize))
    return v.select("vec_id", F.round(vector.dot(F.col("v"), F.col("v")), 5).alias("norm2"), F.round(F.get("v", F.lit(0)), 5).alias("first"))


@query
def cosine_topk(spark, d):
    return vector.cosine_topk(_vector_queries(spark, d), _vectors(spark, d), 10).select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"), "rank")


@query
def cosine_unit(spark, d):
    return vector.cosine_topk(_vector_queries(spark, d), _vectors(spark, d), 10).select("query_id", "vec_id", F.round((F.col("cosine") + 1) / 2, 5).alias("score"))


@query
def pairwise_cosine(spark, d):
    c = vector.cosine_topk(_vector_queries(spark, d), _vectors(spark, d), 10).select("query_id", "vec_id", "rank")
    v = c.join(_vectors(spark, d), "vec_id").select("query_id", "vec_id", "embedding")
    a, b = v.alias("a"), v.alias("b")  # ten rows a query
    return a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.vec_id") < F.col("b.vec_id"))).select(F.col("a.query_id").alias("query_id"), F.col("a.vec_id").alias("vec_a"), F.col("b.vec_id").alias("vec_b"), F.round(vector.dot(F.col("a.embedding"), F.col("b.embedding")), 5).alias("cosine"))


@query
def ivf_assign(spark, d):
    return vector.ivf_assign(_vectors(spark, d))[0].select("vec_id", F.col("cell").cast("long").alias("cell"))


@query
def ivf_topk(spark, d):
    return vector.ivf_topk(_vector_queries(spark, d), _vectors(spark, d), 10)


def _mmr(spark, d, doc):
    v = _vectors(spark, d)
    pool = vector.cosine_topk(_vector_queries(spark, d), v, 30).join(v.select("vec_id", "label", F.col("embedding").alias("vector")), "vec_id")
    return ranking.mmr(pool.select("query_id", "vec_id", F.col("cosine").alias("score"), "rank", "vector", "label", F.lit(0.7).alias("lambda")), 3, doc=doc)


@query
def mmr_rerank(spark, d):
    return _mmr(spark, d, "label")


@query
def mmr_classic(spark, d):
    return _mmr(spark, d, None)


def _asked(spark, d):
    return table(spark, d, "benchmark").unionByName(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000).cast("long").alias("item_id"), "text"))


@query
def query_weights(spark, d):
    return ranking.query_weights(_asked(spark, d), oracle.PRODUCTS).select("item_id", "w_cosine", "w_bm25", "w_quality")


@query
def query_lambda(spark, d):
    return _asked(spark, d).select("item_id", ranking.query_lambda(F.col("text"), oracle.PRODUCTS).alias("mmr_lambda"))


@query
def candidate_pool(spark, d):
    return _pool(spark, d)


def _hybrid(spark, d, weights=None):
    return ranking.hybrid(_docs(spark, d), table(spark, d, "benchmark"), weights=weights)


@query
def hybrid_search(spark, d):
    return _hybrid(spark, d).filter("rank <= 3").select("query_id", "doc_id", F.round("final", 4).alias("final"))


@query
def search_explain(spark, d):
    return _hybrid(spark, d).filter("rank <= 3").select("query_id", "rank", F.format_string("cosine=%.3f bm25=%.3f quality=%.3f final=%.3f", "cosine", "bm25n", "quality", "final").alias("explanation"))


@query
def score_bands(spark, d):
    return _hybrid(spark, d).groupBy(evaluate.score_band(F.col("final")).alias("band")).agg(F.count("*").alias("n"))


@query
def result_table(spark, d):
    best = sized(_hybrid(spark, d).filter("rank <= 3"), "best")
    r = _docs(spark, d).select("doc_id", "source", "text").join(best.side(), "doc_id").withColumn("Mots", F.size(T.words(F.col("text"))).cast("long"))
    return r.select(F.col("query_id"), F.col("rank").alias("Rang"), F.left("source", F.lit(30)).alias("Document"), F.round("cosine", 3).alias("Cosine"), F.round("bm25n", 3).alias("BM25"), F.round("final", 3).alias("Final"), F.round("quality", 3).alias("Qualite"), "Mots")


@query
def search_full(spark, d):
    from ..session import Engine

    return Engine.build(_docs(spark, d), inverted=False).search(table(spark, d, "benchmark"))


@query
def expand_query(spark, d):
    return expand.expand(table(spark, d, "benchmark")).select("item_id", "expanded")


@query
def expansion_terms(spark, d):
    out = expand.expansion_terms(table(spark, d, "benchmark"), most=8)
    return out.select("item_id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


@query
def query_rule_matches(spark, d):
    return expand.matches(_asked(spark, d))


@query
def explain_expansion(spark, d):
    return expand.explain(table(spark, d, "benchmark"))


def _relevant(spark, d):
    return passages.holding(_docs(spark, d), table(spark, d, "benchmark"))


def _graded(spark, d, results):
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return evaluate.graded(results, _relevant(spark, d), questions)


@query
def relevant_hits_semi(spark, d):
    return _bm25(spark, d).top(3).join(_relevant(spark, d), ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "rank")


@query
def ir_metrics(spark, d):
    return evaluate.metrics(_graded(spark, d, _bm25(spark, d).top(3)))


@query
def ndcg(spark, d):
    g = _graded(spark, d, _bm25(spark, d).top(3))
    return g.select("query_id", F.round(evaluate.ndcg(), 4).alias("ndcg"))


@query
def first_relevant_rank(spark, d):
    return _graded(spark, d, _bm25(spark, d).top(3)).select("query_id", "first")


@query
def metric_deltas(spark, d):
    a = evaluate.metrics(_graded(spark, d, _bm25(spark, d).top(3)))
    b = evaluate.metrics(_graded(spark, d, _pool(spark, d).filter("rank <= 3")))
    names = ["hit1", "hit3", "mrr", "ndcg3"]
    both = a.select(*[F.col(n).alias(f"a_{n}") for n in names]).crossJoin(b.select(*[F.col(n).alias(f"b_{n}") for n in names]))  # one row each
    return both.select(*[F.round(F.col(f"a_{n}") - F.col(f"b_{n}"), 6).alias(f"d_{n}") for n in names])


def _grid(spark):
    return spark.createDataFrame(evaluate.weight_grid(), "w_cosine double, w_bm25 double, w_quality double")


@query
def weight_grid(spark, d):
    """Every triple of the grid, and how many questions have these weights of their own."""
    own = ranking.query_weights(table(spark, d, "benchmark")).groupBy("w_cosine", "w_bm25", "w_quality").agg(F.count("*").alias("n_questions"))
    return _grid(spark).join(own, ["w_cosine", "w_bm25", "w_quality"], "left").fillna({"n_questions": 0})


@query
def grid_cross(spark, d):
    g = _grid(spark)
    return table(spark, d, "benchmark").crossJoin(F.broadcast(g)).groupBy("item_id").agg(F.count("*").alias("n"))


@query
def grid_search(spark, d):
    """Candidates are scored once; each weight triple only ranks them anew."""
    base = written(_hybrid(spark, d).select("query_id", "doc_id", "cosine", "bm25n", "quality"), "candidates")
    g = F.broadcast(_grid(spark))  # 70 rows
    final = F.round(F.col("w_cosine") * F.col("cosine") + F.col("w_bm25") * F.col("bm25n") + F.col("w_quality") * F.col("quality"), 6)
    names = ["w_cosine", "w_bm25", "w_quality"]
    rank = F.row_number().over(Window.partitionBy("query_id", *names).orderBy(F.desc("final"), "doc_id"))
    ranked = base.crossJoin(g).withColumn("final", final).withColumn("rank", rank.cast("long")).filter("rank <= 3")
    relevant = _relevant(spark, d)
    hits = ranked.join(relevant, ["query_id", "doc_id"]).groupBy("query_id", *names).agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    every = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).crossJoin(g).join(sizes, "query_id", "left").join(hits, ["query_id", *names], "left").fillna({"n_relevant": 0})
    return evaluate.metrics(every, names).withColumn("score", evaluate.composite())


@query
def composite_leaderboard(spark, d):
    return grid_search(spark, d).orderBy(F.desc("score"), "w_cosine", "w_bm25").limit(20).select("w_cosine", "w_bm25", "w_quality", "score")


def _with_excerpt(spark, d, column):
    best = sized(_bm25(spark, d).top(3).select("query_id", "doc_id"), "best")
    q = sized(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "queries")
    held = _docs(spark, d).select("doc_id", "text").join(best.side(), "doc_id")  # the texts stay where they are
    return held.join(q.side(), "query_id").select("query_id", "doc_id", column.alias("excerpt"))


@query
def best_excerpt_cli(spark, d):
    return _with_excerpt(spark, d, evaluate.excerpt(F.col("text"), F.col("query"), 20, False, 200, "…", at_word=True))


@query
def best_excerpt_ui(spark, d):
    return _with_excerpt(spark, d, evaluate.excerpt(F.col("text"), F.col("query"), 0, True, 300, "..."))


@query
def term_maps(spark, d):
    """Of each document's map from term to count: its size, a look-up with a default, and its largest value."""
    tf = lexical.term_freq(lexical.tokens(_docs(spark, d)))
    maps = tf.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("m"))
    held = _docs(spark, d).select("doc_id").join(maps, "doc_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,bigint>")))
    return held.select("doc_id", F.size("m").cast("long").alias("n_terms"), F.coalesce(F.try_element_at("m", F.lit("the")), F.lit(0)).cast("long").alias("n_the"), F.coalesce(F.array_max(F.map_values("m")), F.lit(0)).cast("long").alias("most"))


@query
def ndcg_once(spark, d):
    """Gains of results that name the same document (here: label) again and again, each counted and only the first."""
    v = _vectors(spark, d).select("vec_id", F.col("label").alias("doc"))
    found = vector.cosine_topk(_vector_queries(spark, d), _vectors(spark, d), 3).join(v, "vec_id").select("query_id", F.col("doc").cast("long").alias("doc_id"), "rank")
    relevant = v.select(F.col("vec_id").alias("query_id"), F.col("doc").cast("long").alias("doc_id"))
    asked = _vector_queries(spark, d).select(F.col("vec_id").alias("query_id"))
    gains = [evaluate.graded(found, relevant, asked, once=o).select("query_id", F.round(F.coalesce("gain", F.lit(0.0)), 4).alias(n)) for n, o in (("every_result", False), ("first_only", True))]
    return gains[0].join(gains[1], "query_id")


@query
def query_history(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    first = c.groupBy("text").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    return first.orderBy(F.desc("at.conv_id"), F.desc("at.turn")).limit(10).select("text")


@query
def index_metrics(spark, d):
    """What building an index says of it."""
    from ..session import Engine

    engine = Engine.build(_docs(spark, d))
    return engine.chunks().agg(F.count("*").alias("n_chunks"), F.round(F.avg("quality_score"), 6).alias("avg_quality"), F.lit(engine.config["n_docs_loaded"]).cast("long").alias("n_docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in _QUERIES}
