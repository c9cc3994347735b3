"""Filter audit and secret scans against brute force, over odd rows and the given tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F
from test_ops import BASE, ROWS

from quarry.llm import filter_audit, queries, secrets

SF = "/root/testdata/sf0.001"


def _fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text))]


def _audit(docs, labels):
    """By the definition: every order is applied to every row."""
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    rows, out = [], {}
    for i, t, s in docs:
        rows.append((s or "", [*_fails(t or ""), i is not None and i > first[t or ""]], i is not None and i in good, i is not None and i in toxic))
    parts = {r[0] for r in rows}
    for order in map("".join, permutations("ABCDE")):
        left = rows
        for step, x in enumerate(order, 1):
            k, stays = "ABCDE".index(x), [r for r in left if not r[1]["ABCDE".index(x)]]
            for p in parts:
                mine, gone = [r for r in rows if r[0] == p], [r for r in left if r[0] == p and r[1][k]]
                out[p, order, step] = (sum(r[0] == p for r in stays), len(gone), sum(r[1][k] for r in mine) - len(gone), sum(r[1][k] and sum(r[1]) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
            left = stays
    values = Counter()
    for (p, order, step), v in out.items():
        values[p, order[step - 1]] += v[1]
    return sorted((p, o, s, *v, values[p, o[s - 1]]) for (p, o, s), v in out.items())


@pytest.fixture(scope="module")
def corpus():
    random.seed(8)
    words = ["alpha", "Beta", "GAMMA", "d#lta", "eps", "été", "x" * 9, "|", "one", "two", "three"]
    docs = [(i, t, "s") for i, t in ROWS] + [(i, " ".join(random.choice(words) for _ in range(random.choice([0, 3, 49, 50, 80]))), random.choice(["a", "b", None, ""])) for i in range(100, 160)]
    docs += [(i, docs[random.randrange(len(docs))][1], random.choice(["a", "b", None])) for i in [*range(200, 230), None, None, 100, 100]]
    docs += [(400, " ".join(str(k % 9000) for k in range(400_000)), "b"), (401, "\x0b\x0c\x1c\x85  a b", "b")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, 1])) for i in [*range(0, 230, 2), None, 100, 100, 999]]
    return docs, labels


def test_audit_by_brute_force(spark, corpus):
    docs, labels = corpus
    table = spark.createDataFrame([(*r, "m", "p", 0, "x") for r in docs], "doc_id long, text string, source string, mask string, part string, n int, digest string")
    marks = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert sorted(map(tuple, filter_audit.audit(table, marks).collect())) == _audit(docs, labels)
    assert filter_audit.audit(table.filter("false"), marks).count() == 0
    none = filter_audit.audit(table, marks.filter("false"))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0) and none.count() == 600 * len({r[2] or "" for r in docs})


def test_interactions_add_up(spark, corpus):
    docs, labels = corpus
    table, marks = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    failed = filter_audit.failures(table)
    exact = {(r.part, r.mask): r.docs for r in filter_audit.contingency(failed, marks).collect()}
    got = filter_audit.interactions(filter_audit.joint_failures(filter_audit.contingency(failed, marks))).collect()
    for r in got:
        mask = sum(1 << "ABCDE".index(x) for x in r.failed)
        assert r.exactly == exact.get((r.part, mask), 0)
        assert r.joint == sum(n for (p, m), n in exact.items() if p == r.part and m & mask == mask)
    for part in {r.part for r in got}:  # dividends of all sets sum to what all filters remove
        assert sum(r.dividend for r in got if r.part == part) == sum(n for (p, m), n in exact.items() if p == part and m)


def _token(body, prefix="ghp_", broken=False):
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, k = divmod(value, 62)
        digits = secrets.DIGITS[k] + digits
    return prefix + body + (digits[:-1] + ("0" if digits[-1] != "0" else "1") if broken else digits)


def _plain(text):
    """All patterns over the whole text."""
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    for k, kind, prefix in ((3, "github", "gh[pousr]_"), (4, "npm", "npm_")):
        for m in re.finditer(prefix + "([0-9A-Za-z]+)", text):
            if len(m.group(1)) == 36 and _token(m.group(1)[:30], "") == m.group(1):
                found.append((m.start(), k, kind, m.end()))
    return sorted(found)


def _texts():
    rng = random.Random(9)
    body = "".join(rng.choice(secrets.DIGITS) for _ in range(30))
    pieces = [
        "password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "api__key", "ſecret", "toKen", "=", ":", " = ", '"', "'", "abcdef", "abcde", "AKIA", "AKIA" + "Z9" * 8, "AKIAabc", "0a" * 11, "0123456789abcdef" * 2, "f" * 23, "f" * 24, "deadbeef", " ", "\n", "é", "😀", "x", ".", "-",
        _token(body), _token(body, broken=True), _token(body, "npm_"), _token(body) + "Z", "ghp_", "npm_",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]
    return [*texts, "token=" * 9 + "value1", "secret:" + " " * 50_000 + "abcdefg", "password" + " " * 50_000, None, "", "e" * 200_000, "token token=abcdefgh " * 20_000 + "AKIA" * 10]


def test_spans_by_brute_force():
    seen = Counter()
    for t in _texts():
        got = secrets.spans(t or "")
        assert [(a, secrets.KINDS.index(k), k, z) for a, k, z in got] == _plain(t or ""), t[:300]
        seen.update(k for _, k, _ in got)
    assert set(seen) == set(secrets.KINDS) and min(seen.values()) > 20


def test_hex_at_every_offset():
    for before in range(9):
        for n in range(20, 60):
            for after in ("", "g", "gh 0 1 2"):
                text = "z" * before + "a" * n + after
                assert secrets.hex_runs(text) == ([(before, before + n)] if n >= 24 else [])


def test_secret_rows_and_sql(spark):
    texts = [t for t in _texts() if t is None or len(t) < 5000][:400]
    rows = [(i if i % 7 else None if i % 2 else 5, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, spans string, kind string")
    got = sorted(map(tuple, secrets.scan(table).collect()), key=str)

    def row(i, t):
        found = _plain(t or "")
        said = [f"{k}:{a}:{z}" for a, n, k, z in found]
        base = ",".join(s for s, f in zip(said, found, strict=True) if f[1] < 3)
        return (i, *[sum(f[1] == k for f in found) for k in range(3)], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), sum(f[1] > 2 for f in found))

    assert got == sorted((row(i, t) for i, t in rows), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(queries.OP12_SQL).fetchall(), key=str) == got
    assert secrets.scan(table.filter("false")).count() == 0


def test_no_text_is_passed_over(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    want = {r.doc_id: ",".join(f"{k}:{a}:{z}" for a, _, k, z in _plain(r.text or "")) for r in docs.collect()}
    assert got == want and sum(map(bool, want.values())) > 5


def test_long_base_text(spark):
    rows = [(1, (BASE + "token = 'abcdef123' ") * 40_000)]
    r = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert r.n_assign == 40_000 and r.n_hex == 0
