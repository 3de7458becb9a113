"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import broadcast, cut, in_arrow, lookup, texts_of, whole_text

#: Where a template counts: in any unit, or in licence files only, as titles and whole licence texts do.
ANYWHERE, FILES = "any", "file"

# Notices by which files name their licence, the usual file headers, short licences and titles.
TEMPLATES = [
    ("MIT", "Released under the MIT License.", ANYWHERE),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ANYWHERE),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ANYWHERE,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ANYWHERE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", ANYWHERE),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ANYWHERE,
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ANYWHERE),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ANYWHERE),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ANYWHERE),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ANYWHERE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ANYWHERE),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        http://mozilla.org/MPL/2.0/.""",
        ANYWHERE,
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        ANYWHERE,
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of
        its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
        ANYWHERE,
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.""",
        ANYWHERE,
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ANYWHERE,
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ANYWHERE),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ANYWHERE),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ANYWHERE),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ANYWHERE),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ANYWHERE),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", ANYWHERE),
    ("GPL-2.0", "Licensed under the GPL version 2 only.", ANYWHERE),
    ("GPL-3.0", "Licensed under the GPL version 3 only.", ANYWHERE),
    (
        "EPL-2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/""",
        ANYWHERE,
    ),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0.", ANYWHERE),
    ("MIT", "MIT License", FILES),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", FILES),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", FILES),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", FILES),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", FILES),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", FILES),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", FILES),
    ("MPL-2.0", "Mozilla Public License Version 2.0", FILES),
    ("BSD-2-Clause", "BSD 2-Clause License", FILES),
    ("BSD-3-Clause", "BSD 3-Clause License", FILES),
    ("ISC", "ISC License", FILES),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", FILES),
]
# The family's header, its licences and their names.
_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software Foundation, either version {1}
of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} License for more details. You should have received a copy of the GNU {0} License along with this program."""
_GNU = [("GPL-2.0", "General Public", "2"), ("GPL-3.0", "General Public", "3"), ("LGPL-2.1", "Lesser General Public", "2.1"), ("LGPL-3.0", "Lesser General Public", "3"), ("AGPL-3.0", "Affero General Public", "3")]
TEMPLATES += [(name, text, ANYWHERE) for name, words, version in _GNU for text in (_GNU_HEADER.format(words, version), _GNU_HEADER.format(words, version).split(" This program is dist")[0])]
# The disclaimer that ends the licences of one family.
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES += [(name, f"{text} {_BSD_END}", ANYWHERE) for name, text, _ in TEMPLATES if name in ("BSD-2-Clause", "BSD-3-Clause") and len(text) > 100]
# Identifiers that a file may state in one line.
IDENTIFIERS = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib",
]
TEMPLATES += [(x.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {x}", ANYWHERE) for x in IDENTIFIERS]
#: File names, without extension, that hold the licence of their directory.
LICENSE_FILES = ["license", "licence", "copying", "unlicense"]
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_IDENTIFIER = re.compile(r"spdx-license-identifier:[ \t(]*([a-z0-9.+\-]+)[^\n]*")
#: Lines without a core word that a run of lines may bridge.
GAP = 2
#: Words that tell licences of one family apart: a unit and its template have the same of them.
DECISIVE = {"affero", "endorse", "lesser", "nc", "nd", "sa"}
#: Words that turn a notice into its contrary, if it has at most NOTICE words and the template lacks them.
DENYING, NOTICE = {"no", "not", "never", "neither", "isn", "unlike", "without"}, 40
_VERSION = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")


def agrees(unit: dict[str, int], template: dict[str, int]) -> bool:
    """Whether a unit near a template doesn't differ from it in what decides: the words of DECISIVE, version numbers of
    the template, and denials."""
    if DECISIVE.intersection(template) != DECISIVE.intersection(unit):
        return False
    if any(_VERSION.fullmatch(t) and t not in unit for t in template):
        return False
    return len(unit) > NOTICE or not DENYING.intersection(unit) - DENYING.intersection(template)


def terms(text: str) -> list[str]:
    """Words of letters and digits; a stated identifier is one word, the first of an expression."""
    low = text.lower()
    if "spdx-license-identifier:" not in low:
        return _WORD.findall(low)
    return _WORD.findall(_IDENTIFIER.sub(" ", low)) + [f"spdx:{x}" for x in _IDENTIFIER.findall(low)]


def read_templates(texts: dict[str, str]) -> list[tuple[str, str, str]]:
    """Whole licence texts by name, on the driver, as further templates for licence files."""
    return [(name, text, FILES) for name, text in texts.items()]


class Scorer:
    """Cosine between a text unit and each template. A word outside the templates weighs as one that no unit has."""

    def __init__(self, templates: list[tuple[str, str, str]], n: int, frequency: dict[str, int]):
        self.names = [x[0] for x in templates]
        self.files = np.array([x[2] == FILES for x in templates], bool)
        self.idf = {t: math.log((n + 1) / (frequency.get(t, 0) + 1)) + 1 for x in templates for t in set(terms(x[1]))}
        self.foreign = math.log(n + 1) + 1
        self.counts = [Counter(terms(x[1])) for x in templates]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, x in enumerate(templates):
            counts = Counter(terms(x[1]))
            weights = {t: (1 + math.log(c)) * self.idf[t] for t, c in counts.items()}
            norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
            for t, w in weights.items():
                self.postings.setdefault(t, []).append((i, w / norm))
        self.cores: dict[tuple[float, bool], set[str]] = {}

    def core(self, least: float, file: bool = False) -> set[str]:
        """Words of which a unit has one if its cosine to any template that counts is at least `least`.

        A cosine is at most the norm of the template's weights for the shared words (Cauchy-Schwarz); so each template
        gives its heaviest words until the norm of its others is below `least`.
        """
        if (least, file) not in self.cores:
            weights: list[list[tuple[float, str]]] = [[] for _ in self.names]
            for t, found in self.postings.items():
                for i, y in found:
                    if file or not self.files[i]:
                        weights[i].append((y, t))
            core: set[str] = set()
            for own in weights:
                own.sort()
                rest = 0.0
                for k, (y, _) in enumerate(own):
                    rest += y * y
                    if math.sqrt(rest) >= least - 1e-9:
                        core.update(t for _, t in own[k:])
                        break
            self.cores[least, file] = core
        return self.cores[least, file]

    def best(self, counts: dict[str, int], least: float, file: bool = False) -> tuple[str | None, float]:
        """Of the templates that count the nearest to a unit of these words, if its cosine is `least` or more."""
        dots, norm = [0.0] * len(self.names), 0.0
        for w, c in counts.items():
            x = (1 + math.log(c)) * self.idf.get(w, self.foreign)
            norm += x * x
            for i, y in self.postings.get(w, ()):
                dots[i] += x * y
        if not norm:
            return None, 0.0
        found = np.array(dots) if file else np.where(self.files, 0.0, dots)
        size = math.sqrt(norm)
        for i in np.argsort(-found, kind="stable"):
            score = min(found[i] / size, 1.0)
            if score < least:
                break
            if agrees(counts, self.counts[i]):
                return self.names[i], score
        return None, float(min(found.max() / size, 1.0))

    def of_text(self, text: str, least: float, file: bool) -> tuple[str | None, float]:
        """The best of the text's units, earlier units first among ties; of a licence file the whole text, if that is near
        enough to a template."""
        if self.core(least, file).isdisjoint(terms(text)):  # no unit can reach least
            return None, 0.0
        if file:
            name, score = self.best(Counter(terms(text)), least, True)
            if name:
                return name, score
        name, score = None, 0.0
        for unit in units(text, self.core(least, file), file):
            found, s = self.best(unit, least, file)
            if found and s > score:
                name, score = found, s
        return name, score


def units(text: str, core: set[str], file: bool) -> Iterator[dict[str, int]]:
    """Word counts of each unit that has a core word: lines; runs of lines from one with a core word to another, with at
    most GAP lines without between any two; blocks, parted by lines without words; runs of blocks that all have core
    words, as a licence of several paragraphs; and of a licence file the whole text. A notice wrapped over lines is a
    run, whatever stands around it."""
    whole: Counter = Counter()
    block: list[Counter] = []
    seeds: list[int] = []
    run: list[Counter] = []  # blocks with core words, one after another

    def joined(parts: list[Counter]) -> Iterator[Counter]:
        if len(parts) > 1:
            total: Counter = Counter()
            for p in parts:
                total.update(p)
            yield total

    def end() -> Iterator[Counter]:
        begin = 0
        for k in range(len(seeds)):
            if k + 1 == len(seeds) or seeds[k + 1] - seeds[k] > GAP + 1:
                if seeds[k] + 1 - seeds[begin] < len(block):
                    yield from joined(block[seeds[begin] : seeds[k] + 1])
                begin = k + 1
        if seeds:
            yield from joined(block)
            total: Counter = Counter()
            for p in block[seeds[0] : seeds[-1] + 1]:
                total.update(p)
            run.append(total)
        elif block:
            yield from joined(run)
            run.clear()
        seeds.clear()
        block.clear()

    for line in text.split("\n"):
        counts = Counter(terms(line))
        if file:
            whole.update(counts)
        if not counts:
            yield from end()
            continue
        if not core.isdisjoint(counts):
            seeds.append(len(block))
            yield counts
        block.append(counts)
    yield from end()
    yield from joined(run)
    if file and not core.isdisjoint(whole):
        yield whole


def is_license_file(path: str | None) -> bool:
    return re.split(r"[.\-]", (path or "").rsplit("/", 1)[-1].lower(), maxsplit=1)[0] in LICENSE_FILES


def scan(files: DataFrame, templates: list[tuple[str, str, str]] | None = None, least: float = 0.7, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Per file: path, license (of its best unit of at least that cosine, else null), score.

    The whole text is read; see units(). Templates are (name, text, ANYWHERE or FILES). How many lines have each template
    word is counted over all files, combined on the map side. Ties go to the earlier unit and template; null and empty
    texts have no licence, a null path is no licence file. Repeated rows come back repeated; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    spark, vocabulary = files.sparkSession, sorted({t for x in templates for t in terms(x[1])})
    position = {t: i for i, t in enumerate(vocabulary)}
    source = files.select(F.col(path_col).cast("string").alias("path"), whole_text(text_col).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(vocabulary) + 1, np.int64)
        known = set(vocabulary)
        for b in batches:
            for text in texts_of(b.column(0)):
                for line in text.split("\n"):
                    found[-1] += 1
                    for w in known.intersection(terms(line)):
                        found[position[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], names=["i", "n"])

    rows = {r.i: r.n for r in source.select("t").transform(in_arrow, count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    frequency = {t: rows.get(i, 0) for t, i in position.items()}
    scorer = broadcast(spark, Scorer(templates, rows.get(len(vocabulary), 0), frequency), "the templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scorer.value.of_text(text, least, is_license_file(path)) for path, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["path", "license", "score"])

    return source.transform(in_arrow, run, "path string, license string, score double")


def inherit(scanned: DataFrame) -> DataFrame:
    """Per file: path, license, score, origin (own, inherited or null), licensed_by (the file that says so).

    A file without its own licence takes that of the licence file in its nearest ancestor directory, found by joining
    the ancestors of each directory that has such a file to the directories that have one; then files meet their own
    directory. Directories with many rows, such as the root, go through no task by themselves. Of several licence files
    in a directory the first by name counts. A null path has no directory, so it inherits nothing; repeated rows come
    back repeated, each with the same answer; an empty table gives no rows. scanned is computed once.
    """
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    stem = F.regexp_extract(name, r"^([^.\-]*)", 1)
    scanned = cut(scanned.select("path", "license", "score", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir")))
    files = scanned.where(F.col("license").isNotNull() & stem.isin(LICENSE_FILES))
    by = files.groupBy("dir").agg(F.min(F.struct("path", "license", "score")).alias("by"))
    bare = cut(scanned.where("license is null and path is not null").groupBy("dir").agg(F.count(F.lit(1)).alias("n_files")))
    parts = F.split("dir", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = bare.select(F.col("dir").alias("home"), F.explode(F.array_distinct(steps)).alias("dir"))
    totals = bare.agg(F.coalesce(F.sum(F.size(F.array_distinct(steps))), F.lit(0)), F.coalesce(F.sum("n_files"), F.lit(0))).first()
    licensed = above.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).join(by, "dir")
    met = lookup(above, licensed, ["dir"], "n", totals[0], F.xxhash64("home"))
    nearest = met.groupBy("home").agg(F.max_by("by", F.length("dir")).alias("by")).withColumnRenamed("home", "dir").join(bare, "dir")
    own = F.col("license").isNotNull()
    sought = scanned.withColumn("dir", F.when(own, None).otherwise(F.col("dir")))
    joined = lookup(sought, nearest.select("dir", "by", "n_files"), ["dir"], "n_files", totals[1], F.xxhash64("path"), "left")
    return joined.select(
        "path", F.coalesce("license", "by.license").alias("license"), F.when(own, F.col("score")).otherwise(F.col("by.score")).alias("score"),
        F.when(own, F.lit("own")).when(F.col("by").isNotNull(), F.lit("inherited")).alias("origin"), F.when(own, F.col("path")).otherwise(F.col("by.path")).alias("licensed_by"),
    )
