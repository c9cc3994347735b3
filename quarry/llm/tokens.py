"""Exact cached encoding with a public tokenizer file.

Both supported pre-tokenizers cut at white space, and between letters and the ASCII signs ``.,;:!?``;
so a text's ids are the joined ids of such segments. What stands between blanks repeats, so each worker
keeps its ids, which come from those of its segments. New plain words are one pre-token each and go to
the library's model at once; whatever isn't a plain word is encoded by itself. Texts that hold a
special token's string, or characters that the two regex engines class differently, are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array

import numpy as np

from .common import RELEASES

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Entries of a worker's cache, some 200 bytes each.
CACHE_ENTRIES = 600_000
GROUP_TEXTS = 64

_SPACED = re.compile(r" ?[^\W\d_]+(?=[.,;:!?\s]|\Z)| ?\S+|\s+(?!\S)|\s+")
_DROPPED = re.compile(r"[^\W\d_]+(?=[.,;:!?\s]|\Z)|\S+")
#: Separators that only Python counts as white space, the letter that is lower-cased by what follows, and the one that gains a mark.
_ODD = re.compile("[\x1c-\x1fΣİ]")
#: White space that the byte-level rule doesn't take one by one: other than blanks and line ends, three together, or two at the end.
_UNEVEN = re.compile(r"[^\S \n]|\s\s(?:\s|\Z)")
#: Blanks and line ends can't be uneven where none of these is; other white space isn't printable.
_EVEN = ("  ", " \n", "\n ", "\n\n")
_SIGNS = tuple(".,;:!?")

#: The public byte-level rule: bytes without a visible character of their own stand at 256 and on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_BLANK = chr(_VISIBLE[32])


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the files are never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Known(dict):
    """What ``make`` says of a key, kept while there is room. A full one is emptied when it has missed three times as often as it has room, as the texts have changed then."""

    def __init__(self, make, most: int):
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        else:
            self.missed += 1
            if self.missed > 3 * self.most:
                self.clear()
                self.missed = 0
        return value


class SegmentEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, ordinary: bool = False):
        """ordinary: special tokens' strings in a text are ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = self.tokenizer.normalizer is not None
        self.split = (_DROPPED if self.drops_space else _SPACED).findall
        self.tokenizer.encode_special_tokens = ordinary
        self.special = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.segments = Known(self.segment, CACHE_ENTRIES // 12)
        self.heads = Known(self.joined, CACHE_ENTRIES // 12)
        self.runs = Known(self.run, CACHE_ENTRIES)
        self.line_end = b"" if self.drops_space else self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes | None:
        """A plain word (at the byte level with the blank before it), which is one pre-token for certain, straight through the library's model; None for anything else."""
        if not word.isalpha():
            return None
        if self.drops_space:
            form = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
            if not form.isalpha():
                return None
        else:
            form = " " + word
        if not word.isascii():
            form = form.encode("utf-8").decode("latin-1").translate(_VISIBLE)
        elif not self.drops_space:
            form = _BLANK + word
        return array("I", [t.id for t in self.tokenize(form)]).tobytes()

    def segment(self, segment: str) -> bytes:
        found = self.word(segment if self.drops_space else segment[1:]) if self.drops_space or segment[0] == " " else None
        return self.whole(segment) if found is None else found

    def joined(self, text: str) -> bytes:
        """The ids of a text's segments."""
        return b"".join(map(self.segments.__getitem__, self.split(text)))

    def run(self, run: str) -> bytes:
        """What stands between blanks; at the byte level the blank before it is part of it."""
        found = self.word(run)
        if found is None and run[-1:] in _SIGNS and run[:-1].isalpha():
            found = self.runs[run[:-1]] + self.segments[run[-1]]
        return self.joined(run if self.drops_space else " " + run) if found is None else found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or _ODD.search(text) or self.drops_space and not unicodedata.is_normalized("NFC", text):
            return self.whole(text)
        if self.drops_space:
            return b"".join(map(self.runs.__getitem__, text.split()))
        if any(x in text for x in _EVEN) and _UNEVEN.search(text):
            return self.joined(text)
        lines = []
        for line in text.split("\n"):
            if not line.isprintable() and _UNEVEN.search(text):
                return self.joined(text)
            head, *runs = line.split(" ")
            ids = b"".join(map(self.runs.__getitem__, runs))
            lines.append(self.heads[head] + ids if head else ids)
        return self.line_end.join(lines)

    def encode_group(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def encode_all(self, column) -> list[bytes]:
        """ids of every text of an Arrow column, a group at a time."""
        return [ids for at in range(0, len(column), GROUP_TEXTS) for ids in self.encode_group(column.slice(at, GROUP_TEXTS).to_pylist())]


@functools.lru_cache(maxsize=4)
def encoder(path: str, ordinary: bool = False) -> SegmentEncoder:
    """One encoder per worker process and file."""
    return SegmentEncoder(path, ordinary)


RELEASES.append(encoder.cache_clear)
