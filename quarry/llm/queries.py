"""The thin registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, filter_audit, fingerprint, langid, licenses, ngram_join, packing, secrets, suffix_dedup, token_counts, token_output, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_under_edits(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(licenses.document_paths(_table(spark, sf_dir, "documents")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_round_trip(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_warc, op3_pack, op4_language, op5_jaccard, op6_fingerprints, op7_token_counts, op8_suffix_dedup, op9_licenses, op10_token_files, op11_filter_audit, op12_secrets)}


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(w, i, i + 9) AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ln AS (SELECT DISTINCT len(win) AS k FROM bw),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ln WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: Base32 digits of the SHA-1, eight for each ten hex digits.
OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(1 + 10 * (j // 8) AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (j % 8))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM q
"""

_SHINGLES = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: Words hold no blank, so that a shingle is its words with blanks between.
OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLES} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
m AS (SELECT u, min(v) AS least_id FROM r GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.u = d.doc_id
"""

#: Bytes as pairs of hex digits. Texts are cut into overlapping parts first, as a substring is looked for from the start.
OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, k, substr(h, 2 * k + 1, 2 * 1049) AS t FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0), 1000)) AS k FROM d)),
w AS (SELECT doc_id, k + i AS pos, substr(t, 2 * i + 1, 100) AS s FROM (SELECT doc_id, k, t, unnest(range(0, len(t) // 2 - 49)) AS i FROM part)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) != max(doc_id)),
hit AS (SELECT doc_id, pos FROM w JOIN f USING (s) WHERE f.first < doc_id),
mark AS (SELECT doc_id, pos, coalesce(CAST(pos > lag(pos) OVER o + 50 AS INT), 1) AS fresh FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
run AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM mark),
span AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM run GROUP BY doc_id, number),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS behind FROM span),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * behind + 1, 2 * (a - behind)), '' ORDER BY a) AS kept FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

#: Every order and step by its definition: documents are counted by the set that they fail, and a filter removes those that fail it and none before.
OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, part, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
f AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::INT
             + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS m FROM w),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
a AS (SELECT unnest(range(0, 5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM a, a b, a c, a d, a e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT p, step, CAST(1 << p[step] AS INT) AS own, CAST(coalesce(list_sum(list_transform(p[1:step - 1], lambda i: 1 << i)), 0) AS INT) AS before FROM (SELECT p, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, p, step, own, sum(CASE WHEN m & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & own > 0 AND m & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN m & own > 0 AND m & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = own THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN m & own > 0 AND m & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & own > 0 AND m & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, p, step, own)
SELECT part, array_to_string(list_transform(p, lambda i: 'ABCDE'[CAST(i + 1 AS INT)]), '') AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

_EITHER = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = _EITHER + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, number: int, pattern: str, kept: str) -> str:
    """Places of a pattern's matches: each begins after the pieces between matches and the matches before it."""
    return (
        f"SELECT doc_id, {number} AS k, '{kind}' AS kind, a, a + len(m) AS z FROM (SELECT doc_id, ms[i] AS m, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS a "
        f"FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(x, '{pattern}') AS ms, string_split_regex(x, '{pattern}') AS ps FROM t))) WHERE {kept}"
    )


_CRC = "list_reduce(list_transform(range(0, 240), lambda j: CASE WHEN j % 8 = 0 THEN CAST(ascii(m[CAST(5 + j // 8 AS INT)]) AS BIGINT) ELSE 0 END), lambda c, x: (xor(c, x) >> 1) # (CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295)"
_CRC = _CRC.replace("(xor(c, x) >> 1) # (", "xor(xor(c, x) >> 1, ").replace(" ELSE 0 END), 4294967295", " ELSE 0 END), 4294967295")
_SUM = "list_reduce(list_transform(range(35, 41), lambda j: CAST(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', m[CAST(j AS INT)]) - 1 AS BIGINT)), lambda a, x: a * 62 + x)"
_HOLDS = f"len(m) = 40 AND xor({_CRC}, 4294967295) = {_SUM}"

OP12_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS x FROM documents),
s AS ({" UNION ALL ".join([_matches("assign", 0, _ASSIGN, f"len(regexp_extract(m, '{_ASSIGN}', 1)) >= 6"), _matches("access", 1, "AKIA[A-Z0-9]+", "len(m) >= 20"), _matches("hex", 2, "[0-9a-f]+", "len(m) >= 24"), _matches("github", 3, "gh[pousr]_[0-9A-Za-z]+", _HOLDS), _matches("npm", 4, "npm_[0-9A-Za-z]+", _HOLDS)])}),
g AS (SELECT doc_id AS row, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, count(*) FILTER (k > 2) AS d,
             string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, k) AS every FROM s GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, CAST(coalesce(d, 0) AS BIGINT) AS n_checked
FROM t LEFT JOIN g USING (row)
""".replace("SELECT doc_id, regexp_extract_all", "SELECT row AS doc_id, regexp_extract_all")


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op2_warc": OP2_SQL, "op5_jaccard": OP5_SQL, "op8_suffix_dedup": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_secrets": OP12_SQL}
