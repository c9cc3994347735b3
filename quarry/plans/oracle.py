"""DuckDB SQL for the registered queries. Character classes are written out, as the two engines differ in theirs."""

from __future__ import annotations

from ..functions import text as T
from ..operators import evaluate, expand, ranking

#: Stand-ins for a deployment's product names.
PRODUCTS = ("anan", "edou", "wherer")
#: Literal rows that the tables lack.
FIXTURES = [
    "applica-\ntion of gluco-\nse", "50-55\n°C and 10000U/\ng", "< 15\n%", "2\ngum", "a\fb", "It’s “x” – 3×4 ≤ 5 µ • é", "‣ one ● two",
    "TECHNICAL  DATA SHEET no 7\nbody\n FOOD SAFTY DATA \nPage 3 of 9\n- 4 -\n=====\nend", "H\na\nH\nb\n H \nc", "x\n\n12\n\ny\n\n\n\nz\n---\nw", "50 - 55 ° C, 10 U / g, < 15 %\n/ z", "  a \t b   c\n   \n\n\n\nd  ", "", "§2\n\n***",
]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FIX = " UNION ALL ".join(f"SELECT CAST({-1 - i} AS BIGINT), " + " || chr(10) || ".join(" || chr(12) || ".join(lit(y) for y in x.split("\f")) for x in s.split("\n")) for i, s in enumerate(FIXTURES))
_SRC = f"src AS (SELECT doc_id, text FROM documents UNION ALL {_FIX})"
_S = r"[\s\x0B\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^{_S}+', ''), '{_S}+\z', '')"


def _re(c: str, rules) -> str:
    for p, r in rules:
        c = f"regexp_replace({c}, {lit(p)}, {lit(r)}, 'g')"
    return c


def _encoding(c: str) -> str:
    for a, b in T.LITERALS:
        c = f"replace({c}, {lit(a)}, {lit(b)})"
    return f"nfc_normalize({c})"


_W = r"[\p{L}\p{N}_]"
#: The rules of the cleaning steps once more, in the other engine's syntax.
_BOILER = [
    (rf"(?i)TECH{_W}*\s*(?:ICAL\s+)?DATA\s+SHEET[^\n]{{0,30}}", ""), (r"(?im)^\s*FOOD\s+SAF(?:E)?TY\s+DATA\s*$", ""),
    (r"(?im)^\s*(?:Page\s+\d+\s+of\s+\d+|-\s*\d+\s*-)\s*$", ""), (r"(?m)^\s*[-=_]{4,}\s*$", ""),
]
_HYPHEN = [(rf"({_W})-\n([a-zà-öø-ÿ])", r"\1\2")]
_BROKEN = [(r"(\d[ \t]*)\n[ \t]*\n?[ \t]*([%°μmgkLlUupmMCFHNJVWKΩcm/]+\b)", r"\1\2"), (r"([A-Za-zΩμ°0-9])/\n[ \t]*\n?[ \t]*([a-zA-Zμg])", r"\1/\2")]
_UNITS = [(r"°\s+([CFKc])", r"°\1"), (r"(\d)\s+-\s+(\d)", r"\1-\2"), (r"(\d)\s+%", r"\1%"), (r"\s*/\s*", "/"), (r"([<>])\s+(\d)", r"\1\2")]
_SPACE = [("\t", " "), (" {2,}", " "), (r"(?m)^\s+$", ""), (r"\n{3,}", "\n\n")]

_STEPS = {
    "page_breaks": lambda c: f"replace({c}, chr(12), chr(10) || chr(10))",
    "encoding": _encoding,
    "bullets": lambda c: f"regexp_replace({c}, {lit(T.BULLETS)}, '-', 'g')",
    "boilerplate": lambda c: _re(c, _BOILER),
    "repeated_headers": None,
    "hyphenation": lambda c: _re(c, _HYPHEN),
    "broken_values": lambda c: _re(c, _BROKEN),
    "isolated_lines": None,
    "units": lambda c: _re(c, _UNITS),
    "whitespace": lambda c: _strip(_re(c, _SPACE)),
}


def _lines(source: str, name: str) -> str:
    return f"{name} AS (SELECT doc_id, i, line, {_strip('line')} AS s FROM (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source})))"


def _headers(source: str, out: str) -> str:
    return (
        _lines(source, f"{out}_l") + f", {out}_r AS (SELECT doc_id, s FROM {out}_l WHERE s <> '' AND length(s) < {T.HEADER_CHARS} GROUP BY ALL HAVING count(*) >= {T.HEADER_REPEATS}), "
        f"{out} AS (SELECT d.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i), '') AS text FROM {source} d LEFT JOIN (SELECT * FROM {out}_l ANTI JOIN {out}_r USING (doc_id, s)) l USING (doc_id) GROUP BY d.doc_id)"
    )


def _isolated(source: str, out: str) -> str:
    return (
        _lines(source, f"{out}_l") + f", {out}_k AS (SELECT *, coalesce(lag(s) OVER w, '') = '' AS p, coalesce(lead(s) OVER w, '') = '' AS n, sum(CASE WHEN s = '' THEN 1 ELSE 0 END) OVER w AS blanks FROM {out}_l WINDOW w AS (PARTITION BY doc_id ORDER BY i)), "
        f"{out} AS (SELECT d.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i), '') AS text FROM {source} d LEFT JOIN (SELECT * FROM {out}_k WHERE CASE WHEN regexp_matches(s, '[A-Za-zÀ-ÖØ-öø-ÿ]') THEN true WHEN s = '' THEN blanks <= 2 ELSE NOT (p AND n AND regexp_matches(s, '^[\\s\\d\\-–—=_.•·*#|/\\\\()]*$')) END) l USING (doc_id) GROUP BY d.doc_id)"
    )


_SPECIAL = {"repeated_headers": _headers, "isolated_lines": _isolated}


def _chain(names, source="src"):
    """CTEs that apply the steps in turn; the name of the last."""
    out = []
    for k, n in enumerate(names):
        new = f"st{k}"
        out.append(_SPECIAL[n](source, new) if n in _SPECIAL else f"{new} AS (SELECT doc_id, {_STEPS[n]('text')} AS text FROM {source})")
        source = new
    return ", ".join(out), source


SQL: dict[str, str] = {}
for _n in [*T.STEPS, "full"]:
    _c, _last = _chain(list(T.STEPS) if _n == "full" else [_n])
    SQL[f"clean_{_n}"] = f"WITH {_SRC}, {_c} SELECT doc_id, CAST(length(text) AS BIGINT) AS n, md5(text) AS digest FROM {_last}"


def _words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


_c, _last = _chain(list(T.STEPS), "documents")
SQL["clean_report"] = f"WITH {_c} SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS raw_chars, CAST(length(c.text) AS BIGINT) AS clean_chars, CAST(len({_words('d.text')}) AS BIGINT) AS raw_words, CAST(len({_words('c.text')}) AS BIGINT) AS clean_words FROM documents d JOIN {_last} c USING (doc_id)"
SQL["scan_documents"] = "SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n FROM documents"
SQL["json_coalesce"] = "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, nullif(role, '') AS title, coalesce(text, '') AS content FROM conversations"
SQL["json_items"] = "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(i AS BIGINT) AS item_index, CASE WHEN i % 3 = 0 THEN 'line ' || i ELSE 'doc_' || doc_id || '_' || i END AS id, CASE WHEN i % 2 = 0 THEN 'even' ELSE 'Doc ' || doc_id || '_' || i END AS title, md5(coalesce(nullif(x, ''), 'empty')) AS digest FROM (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"
SQL["unique_ids"] = "SELECT CAST(doc_id AS BIGINT) AS doc_id, source || CASE WHEN n > 1 THEN '__' || n ELSE '' END AS id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)"
SQL["load_summary"] = f"SELECT count(*) AS n_docs, CAST(sum(len({_words('text')})) AS BIGINT) AS n_words, CAST(sum(len({_words('text')})) // greatest(count(*), 1) AS BIGINT) AS words_per_doc FROM documents"
_part = lambda at: f"CAST(coalesce(sum(CAST(('0x' || substr(h, {at}, 15)) AS BIGINT)::HUGEINT), 0) AS VARCHAR)"
SQL["corpus_fingerprint"] = f"SELECT left(sha256(concat_ws('|', {_part(1)}, {_part(16)}, {_part(31)}, '{{}}')), 12) AS fingerprint FROM (SELECT sha256(concat_ws('|', CAST(doc_id AS VARCHAR), text)) AS h FROM documents)"
SQL["nonempty_docs"] = "SELECT doc_id FROM documents WHERE trim(text) <> ''"
SQL["slugify"] = "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages"
SQL["query_cache_key"] = "SELECT item_id, md5(trim(lower(text))) AS cache_key FROM benchmark"

_SENT = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-ZÀ-Ö])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"
SQL["sentences"] = f"SELECT doc_id, CAST(len({_SENT}) AS BIGINT) AS n_sentences, md5(array_to_string({_SENT}, '|')) AS digest FROM documents"


def _quality(words: str, text: str) -> str:
    n, u = f"CAST(len({words}) AS DOUBLE)", f"CAST(len(list_distinct(list_transform({words}, lambda x: lower(x)))) AS DOUBLE)"
    score = f"CAST(0.6 AS DOUBLE) * least(2 * ({u} / {n}), CAST(1 AS DOUBLE)) + CAST(0.3 AS DOUBLE) * (CASE WHEN regexp_matches({text}, '[0-9]') THEN CAST(1 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END) + CAST(0.1 AS DOUBLE) * least({n} / 100, CAST(1 AS DOUBLE))"
    return f"CASE WHEN {n} < 10 THEN CAST(0.4 AS DOUBLE) WHEN {n} > 400 THEN CAST(0.7 AS DOUBLE) ELSE floor(({score}) * 1000 + CAST(0.5 AS DOUBLE)) / 1000 END"


SQL["quality_score"] = f"SELECT doc_id, {_quality('w', 'text')} AS quality FROM (SELECT doc_id, text, {_words('text')} AS w FROM documents)"
_CHUNKS = f"""ss AS (SELECT doc_id, {_SENT} AS ls FROM documents),
sn AS (SELECT doc_id, i, s, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, i, s, len({_words('s')}) AS n FROM (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS s FROM ss))),
wn AS (SELECT a.doc_id, a.i, greatest(a.i + 1, coalesce(max(b.i) + 1, 0)) AS j FROM sn a LEFT JOIN sn b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i <= a.i + 120 AND b.e - (a.e - a.n) <= 120 GROUP BY a.doc_id, a.i),
wt AS (SELECT doc_id, i, j, t, {_words('t')} AS w FROM (SELECT wn.doc_id, wn.i, wn.j, array_to_string(ls[wn.i + 1 : wn.j], ' ') AS t FROM wn JOIN ss USING (doc_id))),
wq AS (SELECT doc_id, i, j, t, len(w) AS n, {_quality('w', 't')} AS q FROM wt),
wx AS (SELECT *, greatest(1, CAST(floor((j - i) * CAST(0.15 AS DOUBLE) * q) AS BIGINT)) AS back FROM wq),
ws AS (SELECT *, CASE WHEN j - back > i THEN j - back ELSE j END AS nx FROM wx),
RECURSIVE_walk AS (SELECT 1)"""
_CHUNKS = _CHUNKS.replace(",\nRECURSIVE_walk AS (SELECT 1)", ",\nwalk AS (SELECT * FROM ws WHERE i = 0 UNION ALL SELECT ws.* FROM walk JOIN ws ON ws.doc_id = walk.doc_id AND ws.i = walk.nx),\nck AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_ord, i AS start_pos, j - 1 AS end_pos, n AS word_count, q AS quality_score, t AS text FROM walk WHERE n >= 30)")
_CH = f"WITH RECURSIVE {_CHUNKS} "
SQL["chunks"] = _CH + "SELECT doc_id, chunk_ord, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos, CAST(word_count AS BIGINT) AS word_count, quality_score, md5(text) AS digest FROM ck"
SQL["contextual_text"] = _CH + f"SELECT ck.doc_id, chunk_ord, md5(concat_ws(' | ', concat_ws('. ', nullif(d.source, ''), array_to_string({_words('d.text')}[1:35], ' ')), ck.text)) AS digest FROM ck JOIN documents d USING (doc_id)"
SQL["index_stats"] = _CH + "SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, round(avg(quality_score), 6) AS avg_quality, round(avg(word_count), 6) AS avg_words FROM ck"
SQL["index_metrics"] = _CH + "SELECT count(*) AS n_chunks, round(avg(quality_score), 6) AS avg_quality, (SELECT count(*) FROM documents) AS n_docs FROM ck"
SQL["running_words"] = f"SELECT doc_id, CAST(i AS BIGINT) AS i, CAST(sum(len({_words('s')})) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS words_so_far FROM (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS s FROM (SELECT doc_id, {_SENT} AS ls FROM documents))"
_L = "WITH " + _lines("documents", "l")
_R = f", r AS (SELECT doc_id, s, count(*) AS n FROM l WHERE s <> '' AND length(s) < {T.HEADER_CHARS} GROUP BY ALL HAVING count(*) >= {T.HEADER_REPEATS}) "
SQL["repeated_lines"] = _L + _R + "SELECT doc_id, s AS line, n FROM r"
SQL["non_repeated_lines_anti"] = _L + _R + "SELECT doc_id, count(*) AS n_lines FROM l ANTI JOIN r USING (doc_id, s) GROUP BY doc_id"
SQL["neighbour_lines"] = _L + " SELECT doc_id, CAST(i AS BIGINT) AS i, coalesce(lag(s = '') OVER w, true) AS prev_blank, coalesce(lead(s = '') OVER w, true) AS next_blank FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)"

_TOK = f"tok AS (SELECT doc_id, unnest({_words('lower(text)')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), dl AS (SELECT doc_id, len({_words('lower(text)')}) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), idf AS (SELECT term, df, ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1) AS idf FROM df, st)"
_BM = _TOK + f", qt AS (SELECT item_id AS query_id, term, count(*) AS qn FROM (SELECT item_id, unnest({_words('lower(text)')}) AS term FROM benchmark) GROUP BY ALL), bm AS (SELECT query_id, doc_id, round(round(sum(qn * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 9), 6) AS bm25 FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"
_TOP = ", top AS (SELECT * FROM (SELECT query_id, doc_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM bm) WHERE rank <= 3)"
_P95 = ", p95 AS (SELECT query_id, quantile_cont(bm25, 0.95) AS p95 FROM bm WHERE bm25 > 0 GROUP BY query_id)"
SQL["tokens"] = f"WITH {_TOK} SELECT term, count(*) AS n FROM tok GROUP BY term"
SQL["term_freq"] = f"WITH {_TOK} SELECT doc_id, term, tf FROM tf"
SQL["doc_freq"] = f"WITH {_TOK} SELECT term, df FROM df"
SQL["doc_len"] = f"WITH {_TOK} SELECT doc_id, CAST(dl AS BIGINT) AS dl FROM dl"
SQL["corpus_stats"] = f"WITH {_TOK} SELECT n, round(avgdl, 6) AS avgdl FROM st"
SQL["bm25_idf"] = f"WITH {_TOK} SELECT term, df, round(idf, 6) AS idf FROM idf"
SQL["bm25_topk"] = f"WITH {_BM}{_TOP} SELECT query_id, doc_id, bm25, rank FROM top"
SQL["bm25_all"] = f"WITH {_BM}, m AS (SELECT query_id, count(*) AS k, round(sum(bm25), 3) AS t FROM bm GROUP BY 1) SELECT item_id AS query_id, coalesce(k, 0) AS n_matched, n - coalesce(k, 0) AS n_zero, coalesce(t, CAST(0 AS DOUBLE)) AS total FROM benchmark LEFT JOIN m ON item_id = query_id, st"
SQL["p95_scores"] = f"WITH {_BM}{_P95} SELECT query_id, round(p95, 6) AS p95 FROM p95"
SQL["bm25_norm"] = f"WITH {_BM}{_P95} SELECT query_id, doc_id, round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), bm25 / p95)), 6) AS bm25n FROM bm JOIN p95 USING (query_id)"


def _tfidf(features: int, least: int, p: str = "t", docs: str = "documents", key: str = "doc_id", asked: str = "benchmark", digits: int = 6) -> str:
    g = lambda t, k: f"(SELECT k, term, count(*) AS tf FROM (SELECT k, w[i] AS term FROM x UNION ALL SELECT k, w[i] || ' ' || w[i + 1] FROM x WHERE i < len(w)) GROUP BY ALL)".replace("FROM x", f"FROM (SELECT {k} AS k, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT {k}, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda z: length(z) >= {least}) AS w FROM {t})) y")
    unit = lambda name, src: f"{name}0 AS (SELECT k, g.term, (1 + ln(tf)) * idf AS raw FROM {src} g JOIN {p}v USING (term)), {name} AS (SELECT k, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY k)) AS w FROM {name}0)"
    zeros = f"SELECT item_id, {key}, CAST(0 AS DOUBLE) FROM {asked}, (SELECT {key} FROM {docs} ORDER BY {key} LIMIT 30)"
    return f"{p}g AS {g(docs, key)}, {p}v AS (SELECT term, ln((CAST(1 AS DOUBLE) + (SELECT count(*) FROM {docs})) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS n, count(*) AS df FROM {p}g GROUP BY term ORDER BY n DESC, term LIMIT {features})), {p}h AS {g(asked, 'item_id')}, {unit(p + 'd', p + 'g')}, {unit(p + 'q', p + 'h')}, {p}cos AS (SELECT q.k AS query_id, d.k AS {key}, round(sum(q.w * d.w), {digits}) AS cosine FROM {p}q q JOIN {p}d d USING (term) GROUP BY ALL), {p}all AS (SELECT query_id, {key}, max(cosine) AS cosine FROM (SELECT * FROM {p}cos UNION ALL {zeros}) GROUP BY ALL), {p}pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, {key}) AS rank FROM {p}all) WHERE rank <= 30)"


_TF, _BASE = _tfidf(2000, 1), _tfidf(5000, 2)
SQL["tfidf_weights"] = f"WITH {_TF} SELECT k AS doc_id, term, round(w, 6) AS w FROM td"
SQL["baseline_tfidf"] = f"WITH {_BASE} SELECT k AS doc_id, term, round(w, 6) AS w FROM td"
SQL["candidate_pool"] = f"WITH {_TF} SELECT query_id, doc_id, cosine, rank FROM tpool"
SQL["baseline_topk"] = f"WITH {_BASE} SELECT query_id, rank, doc_id, round(cosine, 4) AS score, trim(replace(left(text, 300), chr(10), ' ')) AS text FROM tpool JOIN documents USING (doc_id) WHERE rank <= 3"
SQL["candidate_scores_left"] = f"WITH {_BM}, {_TF} SELECT query_id, doc_id, coalesce(bm25, CAST(0 AS DOUBLE)) AS bm25 FROM tpool LEFT JOIN bm USING (query_id, doc_id)"

_dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
SQL["l2_normalize"] = f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 5) AS norm2, round(v[1], 5) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS e FROM embeddings))"
_NN = f"nn AS (SELECT * FROM (SELECT q.vec_id AS query_id, r.vec_id, cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(cosine, 9) DESC, r.vec_id) AS rank FROM (SELECT a.vec_id AS qv, b.vec_id AS rv, {_dot('a.embedding', 'b.embedding')} AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) c JOIN embeddings q ON q.vec_id = qv JOIN embeddings r ON r.vec_id = rv) WHERE rank <= 30)"
SQL["cosine_topk"] = f"WITH {_NN} SELECT query_id, vec_id, round(cosine, 5) AS cosine, rank FROM nn WHERE rank <= 10"
SQL["cosine_unit"] = f"WITH {_NN} SELECT query_id, vec_id, round((cosine + 1) / 2, 5) AS score FROM nn WHERE rank <= 10"
SQL["pairwise_cosine"] = f"WITH {_NN} SELECT a.query_id, a.vec_id AS vec_a, b.vec_id AS vec_b, round({_dot('x.embedding', 'y.embedding')}, 5) AS cosine FROM nn a JOIN nn b ON a.query_id = b.query_id AND a.vec_id < b.vec_id AND a.rank <= 10 AND b.rank <= 10 JOIN embeddings x ON x.vec_id = a.vec_id JOIN embeddings y ON y.vec_id = b.vec_id"


def _mmr(same: str, other: str) -> str:
    w = f"CAST(CASE WHEN a.label = b.label THEN {same} ELSE {other} END AS DOUBLE)"
    step = lambda k: f"v{k} AS (SELECT n.query_id, n.vec_id, n.rank, round(CAST(0.7 AS DOUBLE) * n.cosine - CAST(0.3 AS DOUBLE) * max(s.sim), 9) AS v FROM nn n JOIN sim s ON s.query_id = n.query_id AND s.x = n.vec_id JOIN pk{k - 1} p ON p.query_id = n.query_id AND p.vec_id = s.y WHERE (n.query_id, n.vec_id) NOT IN (SELECT query_id, vec_id FROM pk{k - 1}) GROUP BY n.query_id, n.vec_id, n.rank, n.cosine), pk{k} AS (SELECT * FROM pk{k - 1} UNION ALL SELECT query_id, vec_id, {k} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, rank) AS r FROM v{k}) WHERE r = 1)"
    return f"WITH {_NN}, sim AS (SELECT m.query_id, a.vec_id AS x, b.vec_id AS y, {w} * {_dot('a.embedding', 'b.embedding')} AS sim FROM nn m JOIN nn o ON m.query_id = o.query_id JOIN embeddings a ON a.vec_id = m.vec_id JOIN embeddings b ON b.vec_id = o.vec_id), pk1 AS (SELECT query_id, vec_id, 1 AS k FROM nn WHERE rank = 1), {step(2)}, {step(3)} SELECT query_id, vec_id, CAST(k AS BIGINT) AS rank FROM pk3"


SQL["mmr_rerank"], SQL["mmr_classic"] = _mmr("1.0", "0.4"), _mmr("1.0", "1.0")

_ASKED = "asked AS (SELECT item_id, text FROM benchmark UNION ALL SELECT CAST(conv_id * 1000 + turn + 1000000 AS BIGINT), text FROM conversations)"
_any = lambda terms: "(" + " OR ".join(f"contains(lower(text), {lit(t)})" for t in terms) + ")" if terms else "false"
_n = f"len({_words('lower(text)')})"
_kind = lambda products: f"CASE WHEN {_any(products)} THEN 'product' WHEN regexp_matches(lower(text), {lit(ranking.QUANTITY)}) THEN 'numeric' WHEN {_n} <= 3 THEN 'product' WHEN {_n} > 8 THEN 'long' ELSE 'plain' END"
_pick = lambda i: "CAST(CASE kind " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in ranking.WEIGHTS.items()) + " END AS DOUBLE)"
SQL["query_weights"] = f"WITH {_ASKED} SELECT item_id, {_pick(0)} AS w_cosine, {_pick(1)} AS w_bm25, {_pick(2)} AS w_quality FROM (SELECT item_id, {_kind(PRODUCTS)} AS kind FROM asked)"
_conn = "[" + ", ".join(map(lit, ranking.CONNECTIVES)) + "]"
_lambda = lambda products: f"CAST(CASE WHEN {_any(products)} OR {_n} <= 3 THEN 0.9 WHEN list_has_any({_words('lower(text)')}, {_conn}) THEN 0.55 WHEN {_n} > 8 THEN 0.6 ELSE 0.7 END AS DOUBLE)"
SQL["query_lambda"] = f"WITH {_ASKED} SELECT item_id, {_lambda(PRODUCTS)} AS mmr_lambda FROM asked"

_D = "CAST({} AS DOUBLE)"
_HY = f"""{_BM.replace("round(round(sum(qn", "round(sum(qn").replace("), 9), 6) AS bm25", "), 9) AS bm25")}{_P95}, {_tfidf(2000, 1, digits=9)},
qw AS (SELECT item_id AS query_id, {_pick(0)} AS wc, {_pick(1)} AS wb, {_pick(2)} AS wq FROM (SELECT item_id, {_kind(())} AS kind FROM benchmark)),
ql AS (SELECT doc_id, {_quality('w', 'text')} AS quality FROM (SELECT doc_id, text, {_words('text')} AS w FROM documents)),
hy0 AS (SELECT query_id, doc_id, (cosine + 1) / 2 AS cosine, greatest({_D.format(0)}, least({_D.format(1)}, coalesce(bm25 / p95, {_D.format(0)}))) AS bm25n, quality FROM tpool LEFT JOIN bm USING (query_id, doc_id) LEFT JOIN p95 USING (query_id) JOIN ql USING (doc_id)),
hy1 AS (SELECT *, round(wc * cosine + wb * bm25n + wq * quality, 6) AS final FROM hy0 JOIN qw USING (query_id)),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, round(cosine, 9) DESC, doc_id) AS rank FROM hy1)"""
SQL["hybrid_search"] = f"WITH {_HY} SELECT query_id, doc_id, round(final, 4) AS final FROM hy WHERE rank <= 3"
SQL["score_bands"] = f"WITH {_HY} SELECT CASE WHEN final >= 0.7 THEN 'green' WHEN final >= 0.5 THEN 'yellow' ELSE 'red' END AS band, count(*) AS n FROM hy GROUP BY 1"
SQL["search_explain"] = f"WITH {_HY} SELECT query_id, rank, printf('cosine=%.3f bm25=%.3f quality=%.3f final=%.3f', cosine, bm25n, quality, final) AS explanation FROM hy WHERE rank <= 3"
SQL["result_table"] = f"WITH {_HY} SELECT query_id, rank AS \"Rang\", left(source, 30) AS \"Document\", round(cosine, 3) AS \"Cosine\", round(bm25n, 3) AS \"BM25\", round(final, 3) AS \"Final\", round(quality, 3) AS \"Qualite\", CAST(len({_words('text')}) AS BIGINT) AS \"Mots\" FROM hy JOIN documents USING (doc_id) WHERE rank <= 3"

_RULES = " UNION ALL ".join(f"SELECT item_id, CAST({o} AS BIGINT) AS rule_ord, {lit(' '.join(t[:3]))} AS terms FROM asked WHERE regexp_matches(lower(text), {lit('(?i)' + p)})" for o, p, t in expand.RULES)
SQL["query_rule_matches"] = f"WITH {_ASKED} {_RULES}"
SQL["explain_expansion"] = f"WITH asked AS (SELECT item_id, text FROM benchmark), m AS ({_RULES}) SELECT item_id, coalesce(string_agg(terms, '; ' ORDER BY rule_ord), {lit(expand.MESSAGE)}) AS explanation FROM asked LEFT JOIN m USING (item_id) GROUP BY item_id"


def _expanded(most: int, name: str) -> str:
    """CTEs that add the rules' terms one by one; the last is (item_id, text, added)."""
    steps = [(p, t) for _, p, terms in sorted(expand.RULES) for t in terms]
    out, last = [f"{name}0 AS (SELECT item_id, text, {_words('lower(text)')} AS seen, CAST([] AS VARCHAR[]) AS added FROM benchmark)"], f"{name}0"
    for i, (p, t) in enumerate(steps, 1):
        own = "[" + ", ".join(map(lit, t.lower().split())) + "]"
        fits = f"regexp_matches(lower(text), {lit('(?i)' + p)}) AND len(added) < {most} AND NOT list_has_any(seen, {own})"
        out.append(f"{name}{i} AS MATERIALIZED (SELECT item_id, text, CASE WHEN {fits} THEN list_concat(seen, {own}) ELSE seen END AS seen, CASE WHEN {fits} THEN list_append(added, {lit(t)}) ELSE added END AS added FROM {last})")
        last = f"{name}{i}"
    return ", ".join([*out, f"{name} AS (SELECT item_id, concat_ws(' ', text, nullif(array_to_string(added, ' '), '')) AS text, added FROM {last})"])


SQL["expand_query"] = f"WITH {_expanded(3, 'xp')} SELECT item_id, text AS expanded FROM xp"
SQL["expansion_terms"] = f"WITH {_expanded(8, 'xp')} SELECT item_id, CAST(len(added) AS BIGINT) AS n_terms, array_to_string(added, '|') AS terms FROM xp"

_REL = ", rel AS (SELECT b.item_id AS query_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def _graded(top: str) -> str:
    return f"{_REL}, ht AS (SELECT query_id, min(rank) AS first, sum(1 / log2(rank + {_D.format(1)})) AS gain FROM {top} JOIN rel USING (query_id, doc_id) WHERE rank <= 3 GROUP BY query_id), nr AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY query_id), gr AS (SELECT item_id AS query_id, coalesce(n_relevant, 0) AS n_relevant, first, gain FROM benchmark LEFT JOIN nr ON nr.query_id = item_id LEFT JOIN ht ON ht.query_id = item_id)"


_IDEAL = " + ".join(f"CASE WHEN n_relevant > {i} THEN 1 / log2({_D.format(i + 2)}) ELSE {_D.format(0)} END" for i in range(3))
_NDCG = f"CASE WHEN n_relevant = 0 THEN {_D.format(1)} ELSE coalesce(gain, {_D.format(0)}) / ({_IDEAL}) END"
_MET = f"count(*) AS n, round(avg(CASE WHEN first <= 1 THEN {_D.format(1)} ELSE {_D.format(0)} END), 6) AS hit1, round(avg(CASE WHEN first <= 3 THEN {_D.format(1)} ELSE {_D.format(0)} END), 6) AS hit3, round(avg(coalesce({_D.format(1)} / first, {_D.format(0)})), 6) AS mrr, round(avg(CASE WHEN n_relevant > 0 THEN {_NDCG} END), 6) AS ndcg3"
SQL["relevant_hits_semi"] = f"WITH {_BM}{_TOP}{_REL} SELECT query_id, doc_id, rank FROM top SEMI JOIN rel USING (query_id, doc_id)"
SQL["ir_metrics"] = f"WITH {_BM}{_TOP}{_graded('top')} SELECT {_MET} FROM gr"
SQL["ndcg"] = f"WITH {_BM}{_TOP}{_graded('top')} SELECT query_id, round({_NDCG}, 4) AS ndcg FROM gr"
SQL["first_relevant_rank"] = f"WITH {_BM}{_TOP}{_graded('top')} SELECT query_id, first FROM gr"
SQL["metric_deltas"] = f"SELECT round(a.hit1 - b.hit1, 6) AS d_hit1, round(a.hit3 - b.hit3, 6) AS d_hit3, round(a.mrr - b.mrr, 6) AS d_mrr, round(a.ndcg3 - b.ndcg3, 6) AS d_ndcg3 FROM (WITH {_BM}{_TOP}{_graded('top')} SELECT {_MET} FROM gr) a, (WITH {_TF}{_graded('tpool')} SELECT {_MET} FROM gr) b"
_GRID = "grid AS (" + " UNION ALL ".join(f"SELECT CAST({a} AS DOUBLE) AS w_cosine, CAST({b} AS DOUBLE) AS w_bm25, CAST({q} AS DOUBLE) AS w_quality" for a, b, q in evaluate.weight_grid()) + ")"
SQL["weight_grid"] = f"WITH g AS (SELECT CAST(c / 100.0 AS DOUBLE) AS w_cosine, CAST(b / 100.0 AS DOUBLE) AS w_bm25, CAST((100 - c - b) / 100.0 AS DOUBLE) AS w_quality FROM range(40, 101, 5) x(c), range(0, 61, 5) y(b) WHERE 100 - c - b BETWEEN 0 AND 30), o AS (SELECT {_pick(0)} AS w_cosine, {_pick(1)} AS w_bm25, {_pick(2)} AS w_quality FROM (SELECT {_kind(())} AS kind FROM benchmark)) SELECT g.*, (SELECT count(*) FROM o WHERE o.w_cosine = g.w_cosine AND o.w_bm25 = g.w_bm25 AND o.w_quality = g.w_quality) AS n_questions FROM g"
SQL["grid_cross"] = f"WITH {_GRID} SELECT item_id, count(*) AS n FROM benchmark, grid GROUP BY item_id"
_GS = f"WITH {_HY}, {_GRID}, gf AS (SELECT hy0.query_id, doc_id, w_cosine, w_bm25, w_quality, round(w_cosine * cosine + w_bm25 * bm25n + w_quality * quality, 6) AS final FROM hy0, grid), gk AS (SELECT *, row_number() OVER (PARTITION BY query_id, w_cosine, w_bm25, w_quality ORDER BY final DESC, doc_id) AS rank FROM gf){_REL}, nr AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY query_id), ht AS (SELECT query_id, w_cosine, w_bm25, w_quality, min(rank) AS first, sum(1 / log2(rank + {_D.format(1)})) AS gain FROM gk JOIN rel USING (query_id, doc_id) WHERE rank <= 3 GROUP BY ALL), gr AS (SELECT item_id AS query_id, g.*, coalesce(n_relevant, 0) AS n_relevant, first, gain FROM benchmark CROSS JOIN grid g LEFT JOIN nr ON nr.query_id = item_id LEFT JOIN ht ON ht.query_id = item_id AND ht.w_cosine = g.w_cosine AND ht.w_bm25 = g.w_bm25 AND ht.w_quality = g.w_quality), gs AS (SELECT w_cosine, w_bm25, w_quality, {_MET} FROM gr GROUP BY ALL), gz AS (SELECT *, round({_D.format(0.5)} * mrr + {_D.format(0.3)} * hit1 + {_D.format(0.2)} * hit3, 4) AS score FROM gs) "
SQL["grid_search"] = _GS + "SELECT * FROM gz"
SQL["composite_leaderboard"] = _GS + "SELECT w_cosine, w_bm25, w_quality, score FROM gz ORDER BY score DESC, w_cosine, w_bm25 LIMIT 20"


def _excerpt(least: int, score: str, most: int, end: str, cut: str) -> str:
    return f"""WITH {_BM}{_TOP}, p AS (SELECT query_id, doc_id, replace(d.text, chr(10), ' ') AS t, list_distinct({_words('lower(b.text)')}) AS w FROM top JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id),
sx AS (SELECT query_id, doc_id, i, s FROM (SELECT query_id, doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS s FROM (SELECT query_id, doc_id, list_filter(list_transform(string_split(t, '.'), lambda x: trim(x)), lambda x: length(x) > {least}) AS ls FROM p))),
sc AS (SELECT sx.*, {score} AS n FROM sx JOIN p USING (query_id, doc_id)),
bs AS (SELECT query_id, doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY n DESC, i) AS r FROM sc) WHERE r = 1),
ex AS (SELECT p.query_id, p.doc_id, coalesce(s, trim(t)) AS s FROM p LEFT JOIN bs USING (query_id, doc_id))
SELECT query_id, doc_id, CASE WHEN length(s) > {most} THEN {cut} || '{end}' ELSE s END AS excerpt FROM (SELECT *, left(s, {most}) AS l FROM ex)"""


SQL["best_excerpt_cli"] = _excerpt(20, "len(list_filter(w, lambda x: contains(lower(s), x)))", 200, "…", "CASE WHEN contains(l, ' ') THEN left(l, 200 - strpos(reverse(l), ' ')) ELSE l END")
SQL["best_excerpt_ui"] = _excerpt(0, "len(list_filter(string_split_regex(lower(s), '\\s+'), lambda x: list_contains(w, x)))", 300, "...", "l")
SQL["query_history"] = "SELECT text FROM (SELECT text, min((conv_id, turn)) AS asked_at FROM conversations WHERE role = 'user' GROUP BY text) ORDER BY asked_at DESC LIMIT 10"

SQL["term_maps"] = f"WITH {_TOK} SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_terms, CAST(coalesce(a, 0) AS BIGINT) AS n_the, CAST(coalesce(m, 0) AS BIGINT) AS most FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(CASE WHEN term = 'the' THEN tf END) AS a, max(tf) AS m FROM tf GROUP BY doc_id) USING (doc_id)"
_LB = f"{_NN}, hit AS (SELECT n.query_id, n.rank, v.label = q.label AS ok FROM nn n JOIN embeddings v ON v.vec_id = n.vec_id JOIN embeddings q ON q.vec_id = n.query_id WHERE n.rank <= 3)"
SQL["ndcg_once"] = f"WITH {_LB} SELECT query_id, round(coalesce(sum(CASE WHEN ok THEN 1 / log2(rank + {_D.format(1)}) END), {_D.format(0)}), 4) AS every_result, round(coalesce(1 / log2(min(CASE WHEN ok THEN rank END) + {_D.format(1)}), {_D.format(0)}), 4) AS first_only FROM hit GROUP BY query_id"

_CTX = f"cx AS (SELECT row_number() OVER (ORDER BY ck.doc_id, chunk_ord) AS cid, ck.doc_id, chunk_ord, ck.quality_score AS quality, ck.text AS raw, concat_ws(' | ', concat_ws('. ', nullif(d.source, ''), array_to_string({_words('d.text')}[1:35], ' ')), ck.text) AS text FROM ck JOIN documents d USING (doc_id))"
_CBM = f"""ctf AS (SELECT cid, term, count(*) AS tf FROM (SELECT cid, unnest({_words('lower(raw)')}) AS term FROM cx) GROUP BY ALL), cdl AS (SELECT cid, len({_words('lower(raw)')}) AS dl FROM cx), cst AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM cdl),
cidf AS (SELECT term, ln((n - df + {_D.format(0.5)}) / (df + {_D.format(0.5)}) + 1) AS idf FROM (SELECT term, count(*) AS df FROM ctf GROUP BY term), cst),
cq AS (SELECT item_id AS query_id, term, count(*) AS qn FROM (SELECT item_id, unnest({_words('lower(text)')}) AS term FROM nr) GROUP BY ALL),
cbm AS (SELECT query_id, cid, round(sum(qn * idf * tf * {_D.format(2.5)} / (tf + {_D.format(1.5)} * ({_D.format(0.25)} + {_D.format(0.75)} * dl / avgdl))), 9) AS bm25 FROM cq JOIN ctf USING (term) JOIN cidf USING (term) JOIN cdl USING (cid), cst GROUP BY ALL),
cp95 AS (SELECT query_id, quantile_cont(bm25, 0.95) AS p95 FROM cbm WHERE bm25 > 0 GROUP BY query_id)"""


def _search() -> str:
    w = f"CAST(CASE WHEN a.doc_id = b.doc_id THEN {ranking.SAME_DOCUMENT} ELSE {ranking.OTHER_DOCUMENT} END AS DOUBLE)"
    step = lambda k: f"sv{k} AS (SELECT n.query_id, n.cid, n.rank, round(n.lam * n.score - (1 - n.lam) * max(s.sim), 9) AS v FROM sr n JOIN sm s ON s.query_id = n.query_id AND s.x = n.cid JOIN sp{k - 1} p ON p.query_id = n.query_id AND p.cid = s.y WHERE (n.query_id, n.cid) NOT IN (SELECT query_id, cid FROM sp{k - 1}) GROUP BY ALL), sp{k} AS (SELECT * FROM sp{k - 1} UNION ALL SELECT query_id, cid, {k} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, rank) AS r FROM sv{k}) WHERE r = 1)".replace("n.lam *", "n.lam *").replace("GROUP BY ALL)", "GROUP BY n.query_id, n.cid, n.rank, n.lam, n.score)", 1)
    return f"""WITH RECURSIVE {_CHUNKS}, {_CTX}, {_expanded(3, 'fr')}, {_expanded(8, 'nr')}, {_tfidf(2000, 1, 's', 'cx', 'cid', 'fr', 9)}, {_CBM},
sw AS (SELECT item_id AS query_id, {_pick(0)} AS wc, {_pick(1)} AS wb, {_pick(2)} AS wq, lam FROM (SELECT item_id, {_kind(())} AS kind, {_lambda(())} AS lam FROM benchmark)),
ss0 AS (SELECT p.query_id, p.cid, doc_id, chunk_ord, quality, lam, wc, wb, wq, (cosine + 1) / 2 AS cosine, greatest({_D.format(0)}, least({_D.format(1)}, coalesce(bm25 / p95, {_D.format(0)}))) AS bm25n FROM spool p JOIN cx USING (cid) JOIN sw USING (query_id) LEFT JOIN cbm USING (query_id, cid) LEFT JOIN cp95 USING (query_id)),
ss1 AS (SELECT *, round(wc * cosine + wb * bm25n + wq * quality, 6) AS score FROM ss0),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round(cosine, 9) DESC, cid) AS rank FROM ss1),
dots AS (SELECT x, y, sum(a.w * b.w) AS dot FROM (SELECT DISTINCT m.cid AS x, o.cid AS y FROM sr m JOIN sr o USING (query_id)) JOIN sd a ON a.k = x JOIN sd b ON b.k = y AND b.term = a.term GROUP BY x, y),
sm AS (SELECT a.query_id, a.cid AS x, b.cid AS y, {w} * coalesce(dot, {_D.format(0)}) AS sim FROM sr a JOIN sr b USING (query_id) LEFT JOIN dots ON x = a.cid AND y = b.cid),
sp1 AS (SELECT query_id, cid, 1 AS k FROM sr WHERE rank = 1), {step(2)}, {step(3)}
SELECT query_id, CAST(k AS BIGINT) AS rank, doc_id, CAST(doc_id AS VARCHAR) || '_chunk' || CAST(chunk_ord AS VARCHAR) AS chunk_id, round(cosine, 4) AS cosine, round(bm25n, 4) AS bm25, quality, round(score + 1e-9, 4) AS score, printf('cosine=%.3f bm25=%.3f quality=%.3f', cosine, bm25n, quality) AS explanation FROM sp3 JOIN sr USING (query_id, cid)"""


SQL["search_full"] = _search()
