"""How filters interact: joint failures of every set of filters, and what any order of them does, by inclusion and exclusion.

Per part of a corpus, the joint-failure count J(S) of each of the 32 sets S of five filters is a sum
of products of failure flags. All the rest follows from these 32 numbers, without another pass over
documents (signs are (-1)^|S|):

* survivors of the filters T: the sum of (-1)^|S| J(S) over S in T (Möbius inversion on the subsets);
* what a filter removes in an order: survivors before it less survivors after it;
* documents that fail one filter only: the sum of (-1)^|S| J(S + f) over the sets S without f;
* a filter's Shapley value in the game "documents removed by T", whose Harsanyi dividend of S is
  (-1)^(|S|+1) J(S): its share 1/|S| of every dividend that it is in.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The five filters' letters and limits, and the characters that the fourth looks for.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
_BLANKS, _CAPITALS = "\t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is counted of the documents of a set: all, those of good quality, and toxic ones.
COUNTED = ("docs", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D: few words, few distinct words, many capitals, a symbol."""
    words = F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]


def bits(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): how many rows of a document fail which set of the five filters, a bit each.

    E, a copy: the smallest doc_id of each text is found first, and a row is no copy where it is that
    one. Rows meet it by text and doc_id together, so that a text with very many copies is spread
    over all tasks; in the step before, copies are combined in the task that reads them. Texts
    compare by SHA-256 and go no further than the scan.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scanned = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits(text_failures(text)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialize(scanned, "audited")
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    counted = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    judged = counted.join(firsts, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0))
    return judged.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def contingency(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by exactly the set of filters that they fail; a row per part and set that occurs."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("doc_id IS NOT NULL AND (good OR toxic)")
    marks = marks.groupBy("doc_id").agg(F.max(F.coalesce("good", F.lit(False))).alias("is_good"), F.max(F.coalesce("toxic", F.lit(False))).alias("is_toxic"))
    both = failed.join(marks, "doc_id", "left")
    counted = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("docs"), counted("is_good").alias("good"), counted("is_toxic").alias("toxic"))


def joint_failures(table: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """(part, docs, good, toxic), arrays of 2^filters counts: at place S, the documents that fail all of S, a sum of products of flags."""
    flags = [(F.col("mask").bitwiseAND(1 << i) != 0).cast("long") for i in range(filters)]
    product = lambda s: reduce(lambda a, b: a * b, [f for i, f in enumerate(flags) if s >> i & 1], F.lit(1))
    return table.groupBy("part").agg(*[F.array(*[F.sum(F.col(c) * product(s)) for s in range(1 << filters)]).alias(c) for c in COUNTED])


def subsets(mask: int) -> list[int]:
    return [s for s in range(mask + 1) if s & mask == s]


def signed(counts: Column, terms: list[tuple[int, int]]) -> Column:
    """The sum of weight times the count at place S, over (S, weight)."""
    return reduce(lambda a, b: a + b, [F.get(counts, F.lit(s)) * w for s, w in terms])


def _sign(s: int) -> int:
    return -1 if s.bit_count() % 2 else 1


def interactions(joint: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, failed, joint, exactly, dividend) for each set of filters: documents that fail all of them, those that fail these and no other, and the set's Harsanyi dividend in the game of removed documents."""
    everything = (1 << len(letters)) - 1
    rows = [
        F.struct(
            F.lit("".join(x for i, x in enumerate(letters) if s >> i & 1)).alias("failed"), F.get("docs", F.lit(s)).alias("joint"),
            signed(F.col("docs"), [(s | t, _sign(t)) for t in subsets(everything & ~s)]).alias("exactly"), (F.get("docs", F.lit(s)) * (-_sign(s) if s else 0)).alias("dividend"),
        )
        for s in range(everything + 1)
    ]
    return joint.select("part", F.explode(F.array(*rows)).alias("r")).select("part", "r.*")


def orders(joint: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters and every step of it.

    ``shapley`` is the filter's value times the number of orders: the documents that it removes, summed over all of them.
    """
    n, every = len(letters), (1 << len(letters)) - 1
    kept = [F.array(*[signed(F.col(c), [(s, _sign(s)) for s in subsets(t)]) for t in range(every + 1)]).alias(f"kept_{c}") for c in COUNTED]
    alone = [signed(F.col("docs"), [(s | 1 << i, _sign(s)) for s in subsets(every & ~(1 << i))]) for i in range(n)]
    shares = [signed(F.col("docs"), [(s, -_sign(s) * (math.factorial(n) // s.bit_count())) for s in range(1, every + 1) if s >> i & 1]) for i in range(n)]
    known = joint.select("part", F.array(*[F.get("docs", F.lit(1 << i)) for i in range(n)]).alias("fails"), F.array(*alone).alias("alone"), F.array(*shares).alias("shares"), *kept)
    steps = known.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    mask = lambda upto: reduce(lambda a, b: a + b, [F.when(F.instr(F.substring("filter_order", F.lit(1), upto), x) > 0, 1 << i).otherwise(0) for i, x in enumerate(letters)])
    steps = steps.withColumns({"at": place, "before": mask(F.col("step") - 1), "after": mask(F.col("step"))})
    lost = lambda c: F.get(f"kept_{c}", "before") - F.get(f"kept_{c}", "after")
    out = {
        "kept": F.get("kept_docs", "after"), "removed": lost("docs"), "redundant": F.get("fails", "at") - lost("docs"), "unique_fails": F.get("alone", "at"),
        "good_lost": lost("good"), "toxic_lost": lost("toxic"), "shapley": F.get("shares", "at"),
    }
    return steps.select("part", "filter_order", "step", *[v.cast("long").alias(k) for k, v in out.items()])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``orders`` of the five filters over whole ``docs`` (doc_id, text, source), and ``labels`` (doc_id, quality, toxic).

    A null text is the empty one (it has few words and passes the other text filters), a null source
    the part ''. Rows with a null doc_id count, are no copies, and have no label. Repeated rows count
    each; rows that share a doc_id are no copies of one another. A document is good (toxic) where any
    row of ``labels`` says so. No documents give no rows.
    """
    return orders(joint_failures(contingency(failures(docs), labels)))
