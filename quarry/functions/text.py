"""Text cleaning as column functions; composed in order they are ``clean``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literal replacements, in this order.
LITERALS = [
    ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("•", "-"),
    ("µ", "μ"), ("×", "x"), ("≤", "<="), ("≥", ">="), ("", "-"), ("", "-"), ("", "-"), ("", "-"),
    ("â\u0080\u0099", "'"), ("Ã©", "é"), ("Ã¨", "è"), ("Ãª", "ê"), ("Ã ", "à"), ("Ã´", "ô"), ("Ã¼", "ü"),
]
#: Characters that become a dash.
BULLETS = "[‣⁃⁌⁍∙▪●◦⮚-⮝]"
#: Title lines, page numbers and rules. Letterheads are the caller's, as further patterns.
BOILERPLATE = [
    r"(?iUd)TECH\w*[\s\n]*(?:ICAL\s+)?DATA\s+SHEET[^\n]{0,30}",
    r"(?imUd)^\s*FOOD\s+SAF(?:E)?TY\s+DATA\s*$",
    r"(?imUd)^\s*(?:Page\s+\d+\s+of\s+\d+|-\s*\d+\s*-)\s*$",
    r"(?mUd)^\s*[-=_]{4,}\s*$",
]
#: Broken quantities and unit spacing, pattern and replacement.
BROKEN = [
    (r"(?U)(\d[ \t]*)\n[ \t]*\n?[ \t]*([%°μmgkLlUupmMCFHNJVWKΩcm/]+\b)", "$1$2"),
    (r"([A-Za-zΩμ°0-9])/\n[ \t]*\n?[ \t]*([a-zA-Zμg])", "$1/$2"),
]
UNITS = [(r"(?U)°\s+([CFKc])", "°$1"), (r"(?U)(\d)\s+-\s+(\d)", "$1-$2"), (r"(?U)(\d)\s+%", "$1%"), (r"(?U)\s*/\s*", "/"), (r"(?U)([<>])\s+(\d)", "$1$2")]
HEADER_CHARS, HEADER_REPEATS = 80, 3
#: Letters that a hyphen may part, and lines that say nothing.
_LETTER, _JUNK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"(?U)^[\s\d\-–—=_.•·*#|/\\()]*$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _all(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def only(c: Column, needed, step) -> Column:
    """``step`` of texts that have what it needs at least, a cheap test; of others it would change nothing."""
    return let(c, lambda x: F.when(needed(x), step(x)).otherwise(x))


def _has(*parts: str):
    return lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in parts])


def _foreign(x: Column) -> Column:
    return F.octet_length(x) != F.length(x)


def _each(c: Column, rules: list[tuple[str, str]], needed: list[tuple]) -> Column:
    """As ``_all``; each rule runs on texts with one of its literals."""
    step = lambda x, rule, parts: only(x, _has(*parts), lambda y: F.regexp_replace(y, rule[0], rule[1]))
    return reduce(lambda x, r: step(x, *r), zip(rules, needed, strict=True), c)


#: What a text must have for each of BOILERPLATE.
_BOILERPLATE = [
    lambda x: F.contains(F.upper(x), F.lit("TECH")), lambda x: F.contains(F.upper(x), F.lit("FOOD")),
    lambda x: F.contains(x, F.lit("-")) | F.contains(F.upper(x), F.lit("PAGE")), lambda x: x.rlike("[-=_]{4}"),
]


def page_breaks(c: Column) -> Column:
    return F.replace(c, F.lit("\f"), F.lit("\n\n"))


def encoding(c: Column) -> Column:
    """Literal repairs, then NFC by the ICU library that Spark brings along. Null becomes empty."""
    fixed = lambda c: reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), LITERALS, c)
    return only(F.coalesce(c, F.lit("")), _foreign, lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), fixed(x), F.lit(False)))


def bullets(c: Column) -> Column:
    return only(c, _foreign, lambda x: F.regexp_replace(x, BULLETS, "-"))


def boilerplate(c: Column, more: list[str] | None = None) -> Column:
    return reduce(lambda x, r: only(x, r[1], lambda y: F.regexp_replace(y, r[0], "")), zip(BOILERPLATE, _BOILERPLATE, strict=True), _all(c, [(p, "") for p in more or []]))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_headers(c: Column, repeats: int = HEADER_REPEATS) -> Column:
    """Drops every line under 80 characters that occurs ``repeats`` times or more. Counted by sorting, so a text of many lines stays near linear."""
    short = lambda v: F.array_sort(F.filter(v, lambda x: (x != "") & (F.length(x) < HEADER_CHARS)))
    often = lambda z: F.array_distinct(F.transform(F.filter(F.arrays_zip(z.alias("a"), F.slice(z, repeats, F.greatest(F.size(z), F.lit(1))).alias("b")), lambda p: p["a"] == p["b"]), lambda p: p["a"]))
    drop = lambda v, o: F.when(F.size(o) == 0, F.array_join(v["lines"], "\n")).otherwise(F.array_join(F.filter(v["lines"], lambda x: ~F.array_contains(o, strip(x))), "\n"))
    return let(F.struct(F.split(c, "\n", -1).alias("lines")), lambda v: let(short(F.transform(v["lines"], strip)), lambda z: let(often(z), lambda o: drop(v, o))))


def hyphenation(c: Column) -> Column:
    return only(c, _has("-\n"), lambda x: F.regexp_replace(x, "(?U)(\\w)-\n([a-zà-öø-ÿ])", "$1$2"))


def broken_values(c: Column) -> Column:
    return _each(c, BROKEN, [("\n",), ("/\n",)])


def isolated_lines(c: Column) -> Column:
    """Keeps lines with a letter, the first two blank lines of the text, and other lines unless they are letterless junk between blanks."""

    def join(v: Column) -> Column:
        n = F.size(v["s"])
        before = F.concat(F.array(F.lit("")), F.slice(v["s"], 1, F.greatest(n - 1, F.lit(0))))
        after = F.concat(F.slice(v["s"], 2, n), F.array(F.lit("")))
        last = let(F.array_position(v["s"], ""), lambda p: p + F.array_position(F.slice(v["s"], p.cast("int") + 1, n), ""))
        rows = F.transform(F.arrays_zip(v["lines"], v["s"], before, after), lambda r, i: F.struct(r["lines"].alias("x"), r["s"].alias("s"), ((r["2"] == "") & (r["3"] == "")).alias("alone"), i.alias("i")))
        return let(F.struct(rows.alias("rows"), last.alias("last"), F.array_position(v["s"], "").alias("first")), keep)

    def keep(w: Column) -> Column:
        blank = lambda r: (r["i"] + 1 == w["first"]) | (r["i"] + 1 == w["last"])
        chosen = F.filter(w["rows"], lambda r: F.when(r["s"].rlike(_LETTER), True).when(r["s"] == "", blank(r)).otherwise(~(r["alone"] & r["s"].rlike(_JUNK))))
        return F.array_join(F.transform(chosen, lambda r: r["x"]), "\n")

    return let(F.split(c, "\n", -1), lambda lines: join_of(lines, join))


def join_of(lines: Column, join) -> Column:
    return let(F.struct(lines.alias("lines"), F.transform(lines, strip).alias("s")), join)


def units(c: Column) -> Column:
    return _each(c, UNITS, [("°",), ("-",), ("%",), ("/",), ("<", ">")])


def whitespace(c: Column) -> Column:
    return strip(_each(F.replace(c, F.lit("\t"), F.lit(" ")), [(" {2,}", " "), (r"(?mUd)^\s+$", ""), ("\n{3,}", "\n\n")], [("  ",), ("\n",), ("\n\n\n",)]))


STEPS = {
    "page_breaks": page_breaks, "encoding": encoding, "bullets": bullets, "boilerplate": boilerplate, "repeated_headers": repeated_headers,
    "hyphenation": hyphenation, "broken_values": broken_values, "isolated_lines": isolated_lines, "units": units, "whitespace": whitespace,
}


def clean(c: Column) -> Column:
    return reduce(lambda x, f: f(x), STEPS.values(), c)


def words(c: Column) -> Column:
    """White-space words; empties dropped."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def sentences(c: Column) -> Column:
    cut = F.split(c, r"(?<=[.!?])\s+(?=[A-ZÀ-Ö])")
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def quality(c: Column) -> Column:
    """0.4 under 10 words, 0.7 above 400, else by distinct words, digits and length; three decimals."""
    return quality_of(c, words(c))


def quality_of(c: Column, w: Column) -> Column:
    """As ``quality``, of a text and its words: inside of lambdas nothing is computed once for several places, so there they are cut before."""
    n = F.size(w).cast("double")
    u = F.size(F.array_distinct(F.transform(w, F.lower))).cast("double") / n
    score = 0.6 * F.least(2 * u, F.lit(1.0)) + 0.3 * F.when(c.rlike(r"\d"), 1.0).otherwise(0.8) + 0.1 * F.least(n / 100, F.lit(1.0))
    return F.when(n < 10, 0.4).when(n > 400, 0.7).otherwise(F.floor(score * 1000 + 0.5) / 1000)
