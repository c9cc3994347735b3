"""Token counts that follow edits: a segment tree over each document's pre-token runs.

A leaf holds a run of whole pre-tokens and its token count; inner nodes hold sums of characters and
tokens. A leaf other than the first starts with a space and another character, which is a pre-token
boundary whatever stands before it. An edit re-encodes the leaves that it touches, with the leaf
before them where it reaches into a leaf's first two characters, and updates the sums above them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed
from .tokens import BYTE_BPE, SegmentEncoder, encoder, tokenizer_path

LEAF_CHARS = 256
_START = re.compile(r" (?=\S)")


def cut_leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Runs of about ``size`` characters; a boundary is a space before another character."""
    leaves, at = [], 0
    while len(text) - at > size:
        found = _START.search(text, at + size)
        if not found:
            break
        leaves.append(text[at : found.start()])
        at = found.start()
    return [*leaves, text[at:]]


class CountTree:
    """Token count of one document under edits."""

    def __init__(self, text: str, enc: SegmentEncoder, leaf_chars: int = LEAF_CHARS):
        self.enc, self.leaf_chars, self.reencoded = enc, leaf_chars, 0
        self._build(cut_leaves(text, leaf_chars))

    def _counts(self, leaves: list[str]) -> list[int]:
        self.reencoded += sum(map(len, leaves))
        return [len(b) // 4 for b in self.enc.encode_group(leaves)]

    def _build(self, leaves: list[str], counts: list[int] | None = None) -> None:
        self.base = 1 << max(0, (len(leaves) - 1).bit_length())
        self.leaves = leaves + [""] * (self.base - len(leaves))
        counts = counts if counts is not None else self._counts(leaves)
        self.chars = [0] * self.base + [len(x) for x in self.leaves]
        self.tokens = [0] * self.base + counts + [0] * (self.base - len(counts))
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf and offset of character ``at``; the end belongs to the last leaf with text."""
        i = 1
        while i < self.base:
            i *= 2
            if at >= self.chars[i] and (self.chars[i + 1] or at > self.chars[i]):
                at -= self.chars[i]
                i += 1
        return i - self.base, at

    def _before(self, leaf: int) -> int:
        while leaf and not self.leaves[leaf - 1]:
            leaf -= 1
        return leaf - 1

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters start to stop (clipped to the text)."""
        start = max(0, min(start, self.n_chars))
        stop = max(start, min(stop, self.n_chars))
        first, offset = self._find(start)
        last, end = self._find(stop)
        if offset < 2 and first and (previous := self._before(first)) >= 0:
            offset += sum(map(len, self.leaves[previous:first]))
            first = previous
        region = "".join(self.leaves[first : last + 1])
        end += sum(map(len, self.leaves[first:last]))
        pieces = cut_leaves(region[:offset] + new + region[end:], self.leaf_chars)
        room = last - first + 1
        counts = self._counts(pieces)
        if len(pieces) > room:  # the tree grows: the other leaves keep their counts
            known = self.tokens[self.base :]
            kept = [(x, k) for x, k in zip(self.leaves[:first], known[:first], strict=True) if x]
            after = [(x, k) for x, k in zip(self.leaves[last + 1 :], known[last + 1 :], strict=True) if x]
            every = [*kept, *zip(pieces, counts, strict=True), *after]
            self._build([x for x, _ in every], [k for _, k in every])
            return
        self.leaves[first : last + 1] = pieces + [""] * (room - len(pieces))
        above = set()
        for k in range(first, last + 1):
            self.chars[self.base + k] = len(self.leaves[k])
            self.tokens[self.base + k] = counts[k - first] if k - first < len(counts) else 0
            above.add((self.base + k) // 2)
        while above and max(above):
            for i in above:
                self._sum(i)
            above = {i // 2 for i in above if i > 1}


_OUT = "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_reencoded long"


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    """Three edits: the middle tenth is replaced by the first tenth, a word is put in front, the last tenth goes. Positions are those after the edits before."""
    n = len(text)
    tenth = n // 10
    return [(n // 2, n // 2 + tenth, text[:tenth]), (0, 0, "Draft "), (n + 6 - tenth, n + 6, "")]


def count_under_edits(docs: DataFrame, edits=standard_edits, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Per row: doc_id, n_tokens of the whole text, n_tokens_edited after ``edits(text)`` (start, stop, new), n_chars_edited, n_chars_reencoded by the edits.

    Special tokens' strings are ordinary text. Null is the empty text; a null doc_id stays null;
    repeated rows are counted once each. An empty table gives no rows; other columns are never read.
    Texts are read whole, one at a time. A leaf ends where a pre-token does, so a very long text without
    blanks is one leaf, which each edit encodes again.
    """
    path = path or tokenizer_path(BYTE_BPE)

    def count(batches):
        enc = encoder(path, True)
        for batch in slices(batches):
            rows: list[tuple] = []
            for value in batch.column(1):  # one text and its tree at a time
                text = value.as_py() or ""
                tree = CountTree(text, enc, leaf_chars)
                before, tree.reencoded = tree.n_tokens, 0
                for start, stop, new in edits(text):
                    tree.edit(start, stop, new)
                rows.append((before, tree.n_tokens, tree.n_chars, tree.reencoded))
            yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], names=[f.split()[0] for f in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(count), _OUT)
