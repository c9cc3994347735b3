"""Licence scans: notices, headers and licence texts against templates by sparse TF-IDF cosine, then inheritance from directories.

Compared are each line, each block of lines (between lines without a word, and as far as consecutive
lines consist of a template's words, so that wrapped notices are whole) and the whole file. Whether a
comparison can reach the least cosine is told from the templates' own words: by Cauchy-Schwarz, the
shared ones hold at least the least cosine's square of the template's squared norm. A file takes its
best comparison's licence. A file most of whose words lie in matched lines (of a matched block, those
that consist of the template's words) counts as its directory's licence file, and so does one with a licence file's name. Files without a notice of their
own inherit from the nearest directory above them that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, slices, trimmed

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {lesser}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {lesser}General Public License for more details. You should have received a copy of the GNU {lesser}General Public License along with this program. If not, see https://www.gnu.org/licenses/."

#: Notices, headers and texts of public licences, by SPDX identifier. Every form is a template of its own; a licence's best one counts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((f"{lesser[:1]}GPL-{version}.0", _GNU.format(lesser=lesser, version=version)) for lesser, version in (("", 3), ("", 2), ("Lesser ", 3))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((name, (files(__package__) / "license_texts" / f"{name}.txt").read_text("utf-8")) for name in ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MIT", "MPL-2.0")),
]

LEAST_COSINE, FILE_SHARE = 0.5, 0.5
#: Lines of which this share of the squared norm lies in a template's words consist of them.
LINE_SHARE = 0.5
#: Says nothing beside a licence, so any other that is found counts before it.
RESERVED = "Proprietary"
#: One word is no notice: a line "Mit." is German prose.
LEAST_SHARED = 2
BROADCAST_DIRECTORIES = 500_000
_LICENCE_FILE = r"(?i)(^|/)(licen[cs]es?|copying|notice|unlicense)(\.[a-z]+)?$"
_WORD = re.compile(r"[^\W_]+(?:\.+[^\W_]+)*")
_ROWS = "license string, score double, words long, n_words long"


def terms(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, also with dots inside."""
    return _WORD.findall(text.lower())


class Matcher:
    """The templates' unit vectors of (1 + ln tf) * idf. Document frequencies count the templates, so a score depends on nothing but what is compared; terms that no template has get the largest idf."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        counts = [Counter(terms(text)) for _, text in templates]
        df = Counter(t for c in counts for t in c)
        self.index = {t: i for i, t in enumerate(sorted(df))}
        self.rarest = math.log(1 + len(templates)) + 1
        self.idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
        self.vectors = np.zeros((len(self.index), len(templates)))
        for k, c in enumerate(counts):
            for t, n in c.items():
                self.vectors[self.index[t], k] = (1 + math.log(n)) * self.idf[t]
        self.vectors /= np.sqrt((self.vectors**2).sum(0))
        self.squares = self.vectors**2

    def reach(self, found) -> np.ndarray:
        """Templates that a unit with the terms ``found``, or a part of it, can match; the margin is for rounding."""
        at = [self.index[t] for t in found if t in self.index]
        return np.flatnonzero(self.squares[at].sum(0) >= LEAST_COSINE**2 - 1e-9)

    def weigh(self, counts: Counter) -> tuple[np.ndarray, np.ndarray, float]:
        """Places and weights of the terms that templates have, and the squared norm over all."""
        weights = {t: (1 + math.log(n)) * self.idf.get(t, self.rarest) for t, n in counts.items()}
        at = [t for t in weights if t in self.index]
        return np.array([self.index[t] for t in at], np.intp), np.array([weights[t] for t in at]), math.fsum(w * w for w in weights.values())

    def scan(self, text: str | None) -> tuple[str | None, float | None, int, int]:
        """Licence, score, words in matched lines, words."""
        lowered = text.lower() if text else ""
        words = _WORD.findall(lowered)
        possible = self.reach(set(words))
        if not len(possible):
            return None, None, 0, len(words)
        lines = [Counter(_WORD.findall(line)) for line in lowered.split("\n")]
        best, matched, weighed = None, set(), [self.weigh(c) for c in lines]

        def consists(i: int, k: int) -> bool:
            """Whether line i consists of template k's words."""
            at, weights, square = weighed[i]
            return len(at) > 0 and bool((weights**2)[self.vectors[at, k] > 0].sum() >= LINE_SHARE * square)

        def compare(start: int, end: int, templates: np.ndarray, counts: Counter) -> None:
            nonlocal best
            at, weights, square = self.weigh(counts)
            scores = weights @ self.vectors[np.ix_(at, templates)] / math.sqrt(square)
            for k, score in zip(templates, scores.round(6), strict=True):
                if score >= LEAST_COSINE and np.count_nonzero(self.vectors[at, k]) >= LEAST_SHARED:
                    matched.update(i for i in range(start, end) if end - start == 1 or consists(i, k))
                    found = (self.names[k] == RESERVED, -float(score), self.names[k])
                    best = found if best is None else min(best, found)

        def blocks(goes_on: list[bool], bridged: bool):
            """Runs of two lines or more that go on; where ``bridged``, lines without a word don't end one."""
            run = []
            for i, on in enumerate([*goes_on, False]):
                if on:
                    run.append(i)
                elif i == len(lines) or lines[i] or not bridged:
                    if len(run) > 1:
                        yield run[0], run[-1] + 1
                    run = []

        def compare_blocks(goes_on: list[bool], bridged: bool, templates: np.ndarray) -> None:
            for start, end in blocks(goes_on, bridged):
                counts = Counter()
                for c in lines[start:end]:
                    counts.update(c)
                if len(some := np.intersect1d(templates, self.reach(counts))):
                    compare(start, end, some, counts)

        for i, counts in enumerate(lines):
            if counts and len(some := self.reach(counts)):
                compare(i, i + 1, some, counts)
        if sum(map(bool, lines)) > 1:
            compare(0, len(lines), possible, Counter(words))
            compare_blocks([bool(c) for c in lines], False, possible)
            for k in possible:
                compare_blocks([consists(i, k) for i in range(len(lines))], True, np.array([k]))
        if best is None:
            return None, None, 0, len(words)
        return best[2], -best[1], sum(lines[i].total() for i in matched), len(words)


def scan_licenses(table: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Per file: doc_id, path, license, score, origin (own, inherited or none), inherited_from (a directory).

    Texts are read once and whole, and stay where they are. Null or empty texts have no notice of their own; a null path has no directory and inherits
    nothing. Where a directory has several licence files, the best score and then the first
    identifier count. Repeated rows are reported once each; rows that share an id are one file. An
    empty table gives no rows; other columns are not read.
    """
    rows = table.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    matcher = Matcher(TEMPLATES)

    def run(batches):
        for batch in slices(batches):
            found = zip(*(matcher.scan(t) for t in batch.column(2).to_pylist()), strict=True) if batch.num_rows else [()] * 4
            columns = [pa.array(x, kind) for x, kind in zip(found, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["doc_id", "path", "license", "score", "words", "n_words"])

    schema = StructType(rows.schema.fields[:2] + rows.sparkSession.createDataFrame([], _ROWS).schema.fields)
    scanned = materialize(rows.mapInArrow(trimmed(run), schema), "licenses")
    order = F.struct((F.col("license") == RESERVED).alias("reserved"), (-F.col("score")).alias("s"), "license")
    own = scanned.groupBy("doc_id").agg(F.min(F.when(F.col("license").isNotNull(), order)).alias("b"), F.sum("words").alias("words"), F.sum("n_words").alias("n_words")).filter("b IS NOT NULL")
    # a row without an id is a file of its own
    joined = scanned.alias("r").join(own.alias("o"), "doc_id", "left").select("doc_id", "path", *(F.coalesce(f"o.{c}", f"r.{c}").alias(c) for c in ("n_words", "words")), F.coalesce("b.license", "license").alias("license"), F.coalesce(-F.col("b.s"), "score").alias("score"))
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    holds = joined.filter(F.col("license").isNotNull() & F.col("path").isNotNull() & ((F.col("words") >= FILE_SHARE * F.col("n_words")) | F.col("path").rlike(_LICENCE_FILE)))
    found = holds.groupBy(directory.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    found = found.select("dir", F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    # nearest ancestors are found once per directory, not per file
    dirs = joined.filter("license IS NULL AND path IS NOT NULL").select(directory.alias("of")).distinct()
    parts = F.split("of", "/")
    above = dirs.select("of", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))).alias("dir")).distinct()
    nearest = above.join(found, "dir").groupBy("of").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "dir_license", "dir_score")).alias("near"))
    few = nearest.count() <= BROADCAST_DIRECTORIES
    placed = joined.withColumn("of", F.when(F.col("license").isNull(), directory)).join(F.broadcast(nearest) if few else nearest, "of", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return placed.select("doc_id", "path", F.coalesce("license", "near.dir_license").alias("license"), F.coalesce("score", "near.dir_score").alias("score"), origin.alias("origin"), F.col("near.dir").alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files: source/language/id.txt."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")
