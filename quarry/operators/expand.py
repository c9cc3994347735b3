"""Rule-based query expansion. Rules are data, a table that a deployment loads: (order, pattern, terms)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: A small general set of this repository's own, to show the form; a deployment passes its own table of terminology, units and conditions.
RULES = [
    (0, r"\bdos(age|ing)\b", ["dose", "quantity", "ppm"]),
    (1, r"\btemp(erature)?\b", ["celsius", "heat"]),
    (2, r"\bflour\b", ["wheat", "milling"]),
    (3, r"\b(the|that)\b", ["this", "which"]),
    (4, r"ing\b", ["process", "action"]),
]
_STATE = "struct<seen: array<string>, added: array<string>>"
MESSAGE = "no rule applies"

Rules = Sequence[tuple[int, str, list[str]]]


def load_rules(spark: SparkSession, path: str) -> Rules:
    """Rules from JSON lines with ``pattern`` and ``terms``, and optionally ``rule_ord`` (else their order) and ``group``, from any store that Spark reads. Rules are a fixed list, which every plan holds."""
    rows = [json.loads(r.value) for r in spark.read.text(path).collect() if r.value.strip()]
    return sorted((int(r.get("rule_ord", i)), str(r["pattern"]), [str(t) for t in r["terms"]]) for i, r in enumerate(rows))


def required(pattern: str) -> str:
    """A literal that every match of a pattern holds: its longest run of letters, digits and blanks outside of groups, classes and alternatives, without the character that a quantifier follows. Empty where there is none for certain."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|" and not depth:
            return ""
        after = pattern[i + 1 : i + 2]
        if not depth and (c.isalnum() or c == " ") and after not in ("?", "*", "{"):
            run += c
        else:
            runs, run = [*runs, run], ""
        if c == "[":
            end = pattern.find("]", i + 2)
            i = len(pattern) if end < 0 else end
        depth += (c == "(") - (c == ")")
        i += 2 if c == "\\" else 1
    return max([*runs, run], key=len).lower()


def applies(text: Column, pattern: str) -> Column:
    """Whether a rule's pattern matches a text in either case. The pattern is a constant, so it is compiled once in a task, and a text without its literal never meets it."""
    literal, found = required(pattern), F.lower(text).rlike(f"(?iU){pattern}")
    return F.contains(F.lower(text), F.lit(literal)) & found if literal.isascii() and literal else found


def added_terms(text: Column, rules: Rules = RULES, most: int = 3) -> Column:
    """The terms that rules add, in the rules' order: those none of whose words is there already, ``most`` at most. None where nothing matches; null for null."""
    if not rules:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    hits = F.filter(F.array(*[F.when(applies(text, p), F.array(*map(F.lit, t)).cast("array<string>")) for _, p, t in sorted(rules)]), lambda t: t.isNotNull())

    def take(state: Column, term: Column) -> Column:
        own = T.words(F.lower(term))
        grown = F.struct(F.concat(state["seen"], own).alias("seen"), F.concat(state["added"], F.array(term)).alias("added")).cast(_STATE)
        return F.when((F.size(state["added"]) >= most) | F.arrays_overlap(own, state["seen"]), state).otherwise(grown)

    begin = F.struct(T.words(F.lower(text)).alias("seen"), F.array().alias("added")).cast(_STATE)
    return F.when(text.isNotNull(), F.aggregate(F.flatten(hits), begin, take, lambda s: s["added"]))


def expand(queries: DataFrame, rules: Rules = RULES, most: int = 3, text: str = "text") -> DataFrame:
    """Adds ``expanded``: the query and the added terms; the query as it is where there are none."""
    return queries.withColumn("expanded", F.concat_ws(" ", F.col(text), added_terms(F.col(text), rules, most)))


def expansion_terms(queries: DataFrame, rules: Rules = RULES, most: int = 3, text: str = "text") -> DataFrame:
    """Adds ``terms``, the added terms as an array."""
    return queries.withColumn("terms", added_terms(F.col(text), rules, most))


def matches(queries: DataFrame, rules: Rules = RULES, text: str = "text", key: str = "item_id") -> DataFrame:
    """(key, rule_ord, terms): each query with every rule that it matches, and the rule's first three terms. Rules are a fixed list, so each is one predicate and nothing is joined."""
    one = "struct<rule_ord: bigint, terms: string>"
    hits = [F.when(applies(F.col(text), p), F.struct(F.lit(o).cast("long").alias("rule_ord"), F.lit(" ".join(t[:3])).alias("terms"))) for o, p, t in rules]
    return queries.select(key, F.explode(F.filter(F.array(*hits).cast(f"array<{one}>"), lambda h: h.isNotNull())).alias("h")).select(key, "h.*")


def explain(queries: DataFrame, rules: Rules = RULES, text: str = "text", key: str = "item_id") -> DataFrame:
    """(key, explanation) of every query: the terms of its rules in order, or a message."""
    said = matches(queries, rules, text, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_ord", "terms"))), lambda r: r["terms"]), "; ").alias("explanation"))
    return queries.select(key).join(said, key, "left").withColumn("explanation", F.coalesce("explanation", F.lit(MESSAGE)))
