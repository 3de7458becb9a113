import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillage.llm import common, licenses as L

SCHEMA = "path string, text string"


def brute(rows, least=0.7, templates=None):
    """Cosines from whole vectors, of every line, block, run and licence file, without any bound."""
    templates = templates or L.TEMPLATES
    lines = [set(L.terms(u)) for _, t in rows for u in (t or "").split("\n")]
    n, df = len(lines), Counter(w for u in lines for w in u)
    own = {w for x in templates for w in L.terms(x[1])}
    scorer = L.Scorer(templates, n, {w: df[w] for w in own})

    def vector(counts):
        return {w: (1 + math.log(c)) * (math.log((n + 1) / ((df[w] if w in own else 0) + 1)) + 1) for w, c in counts.items()}

    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(x[0], vector(Counter(L.terms(x[1]))), x[2]) for x in templates]
    out = {}
    for path, text in rows:
        file, best = L.is_license_file(path), (None, 0.0)
        core = scorer.core(least, file)
        parts = [L.terms(u) for u in (text or "").split("\n")]
        found = [(i, i + 1) for i, p in enumerate(parts) if p]
        edges = [i for i in range(len(parts) + 1) if (i < len(parts) and bool(parts[i])) != (i > 0 and bool(parts[i - 1]))]
        runs = [[]]
        for x, y in zip(edges[::2], edges[1::2]):
            found.append((x, y))
            marks = "".join(" *"[not core.isdisjoint(p)] for p in parts[x:y])
            found += [(x + m.start(), x + m.end()) for m in re.finditer(r"\*( {0,%d}\*)*" % L.GAP, marks)]
            runs[-1].append((x + marks.index("*"), x + marks.rindex("*") + 1)) if "*" in marks else runs.append([])
        bags = [Counter(w for p in parts[a:b] for w in p) for a, b in found]
        bags += [Counter(w for a, b in run for p in parts[a:b] for w in p) for run in runs if len(run) > 1]
        whole = Counter(w for p in parts for w in p)
        for k, bag in enumerate(([whole] if file else []) + bags):
            v = vector(bag)
            for (name, w, scope), x in zip(vectors, templates):
                s = sum(x * w.get(k, 0) for k, x in v.items()) / (norm(v) * norm(w)) if v and (file or scope == L.ANYWHERE) else 0
                if s >= least and s > best[1] + 1e-9 and L.agrees(bag, Counter(L.terms(x[1]))):
                    best = (name, s)
            if file and k == 0 and best[0]:
                break
        out[path] = best[0], pytest.approx(best[1], abs=1e-6) if best[0] else 0.0
    return out


def scanned(spark, rows, **more):
    return {r.path: (r.license, r.score if r.license else 0.0) for r in L.scan(spark.createDataFrame(rows, SCHEMA).withColumn("license", F.lit("clash")), **more).collect()}


ROWS = [
    ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code here\nmore"), ("a/b/c/y.py", ""), ("a/b/COPYING.txt", "intro\nLicensed under the Apache License, Version 2.0"),
    ("a/b/z.py", "licensed under CC BY-NC 4.0.\nbody"), ("d/w.py", "the license of the version"), ("LICENSE", None), ("a/bb/v.py", "text"), (None, "Released under the MIT License"), ("ab/q", "none"),
]


def test_scan_and_inheritance(spark, monkeypatch):
    rows = ROWS + [(f"z/{i}", f"filler line {i}\nof the text") for i in range(60)] + [("long/f", "filler words of a text " * 100_000)]
    assert scanned(spark, rows) == brute(rows)
    df = spark.createDataFrame([*rows, *rows[:2]], SCHEMA)
    for hot in (1, 4, 1 << 20):
        monkeypatch.setattr(common, "HOT", hot)
        found = L.inherit(L.scan(df).withColumn("dir", F.lit("clash")).withColumn("by", F.lit(1))).collect()
        got = {r.path: (r.license, r.origin, r.licensed_by) for r in found}
        assert len(found) == len(rows) + 2
        assert got["a/LICENSE"] == ("MIT", "own", "a/LICENSE") and got["a/x.py"] == ("MIT", "inherited", "a/LICENSE") == got["a/bb/v.py"]
        assert got["a/b/c/y.py"] == ("Apache-2.0", "inherited", "a/b/COPYING.txt") and got["a/b/z.py"][:2] == ("CC-BY-NC-4.0", "own")
        assert got["d/w.py"] == got["ab/q"] == got["LICENSE"] == got["z/1"] == (None, None, None) and got[None][0] == "MIT"
    assert L.inherit(L.scan(df.limit(0))).count() == 0


def test_root_license_and_depth(spark):
    rows = [("LICENSE", "Released under the MIT License."), ("x", "a"), ("p/q/r/s/t", "b"), ("p/q/COPYING", "Licensed under CC BY 4.0."), ("p/u", "c"), ("/abs/v", "d"), (None, None)]
    got = {r.path: (r.license, r.licensed_by) for r in L.inherit(L.scan(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got["x"] == ("MIT", "LICENSE") == got["p/u"] == got["/abs/v"] and got["p/q/r/s/t"] == ("CC-BY-4.0", "p/q/COPYING") and got[None] == (None, None)


def test_common_notices_are_scored(spark):
    """A notice whose words are on most lines, one on a tenth of them, and a single file of one line."""
    apache = [(f"f/{i}", "Licensed under the Apache License, Version 2.0.\n" + "\n".join(f"line {i} {k}" for k in range(9))) for i in range(100)]
    hot = [(f"h/{i}", "Released under the MIT License.") for i in range(30)] + [(f"z/{i}", f"filler line {i}") for i in range(60)]
    for rows in (apache, hot, hot[:1]):
        got = scanned(spark, rows)
        assert got == brute(rows) and all(got[p][0] == {"f": "Apache-2.0", "h": "MIT", "z": None}[p[0]] for p, _ in rows)


def test_wrapped_headers_titles_and_identifiers(spark):
    """The usual headers as comments, wrapped over lines, with a copyright line above and code below."""
    wrap = lambda text, k: "\n".join("# " + " ".join(text.split()[i : i + k]) for i in range(0, len(text.split()), k))
    rows, want = [], {}
    for i, (name, text, scope) in enumerate(L.TEMPLATES):
        if scope == L.ANYWHERE and len(text.split()) > 30 and "any later version." not in text[-30:]:
            for k in (6, 11):
                path = f"src/{i}-{k}.py"
                rows.append((path, f"#!/bin/sh\n# Copyright 2020 The Makers\n{wrap(text, k)}\nimport os\nx = 1"))
                want[path] = name
        if scope == L.FILES:
            rows.append((f"t{i}/LICENSE", text + "\n\n" + "Terms and conditions follow here at some length. " * 20))
            rows.append((f"t{i}/notes.txt", text.split(",")[0] if len(text.split()) < 4 else "nothing"))
            want[f"t{i}/LICENSE"], want[f"t{i}/notes.txt"] = name, None
    rows += [("s1", "// SPDX-License-Identifier: GPL-3.0-or-later\ncode"), ("s2", "SPDX-License-Identifier: (MIT OR Apache-2.0)"), ("s3", "SPDX-License-Identifier: Own-1.0")]
    want |= {"s1": "GPL-3.0", "s2": "MIT", "s3": None}
    rows += [(f"z/{i}", f"other prose number {i}\nand more of the same") for i in range(200)]
    got = scanned(spark, rows)
    assert {k: got[k][0] for k in want} == want and got == brute(rows)


BSD = """Copyright (c) 2019, The Makers
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Copyright 2020 A Maker

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OF THIS SOFTWARE.
"""


def test_published_layouts_get_their_own_names(spark):
    """Licences as they are published, as files and as comments above code; near relatives and denials are told apart."""
    texts = {"BSD-2-Clause": BSD.format(third=""), "BSD-3-Clause": BSD.format(third=THIRD), "ISC": ISC}
    rows, want = [], {}
    for name, text in texts.items():
        comment = "\n".join(f" * {line}".rstrip() for line in text.split("\n"))
        for path, content in ((f"{name}/LICENSE", text), (f"{name}-titled/LICENSE.txt", f"{name.replace('-Clause', ' Clause License')}\n\n{text}"), (f"{name}-src/a.c", f"/*\n{comment}\n */\nint main() {{}}")):
            rows.append((path, content))
            want[path] = name
    said = {
        "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY 3.0.": None, "It is not released under the MIT License.": None, "Released under the MIT License.": "MIT", "Licensed under the GPL version 2 only.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0", "Licensed under the Apache License, Version 1.1.": None,
        "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/": "EPL-2.0",
    }
    for k, (text, name) in enumerate(said.items()):
        rows.append((f"n/{k}.txt", f"a first line\n{text}\nand a last one"))
        want[f"n/{k}.txt"] = name
    rows += [(f"z/{i}", f"other prose number {i}\nand more of the same") for i in range(200)]
    got = scanned(spark, rows)
    assert {k: got[k][0] for k in want} == want and got == brute(rows)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_whole_license_files(spark):
    names = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}
    texts = {i: open(f"/usr/share/common-licenses/{f}").read() for f, i in names.items()}
    rows = [(f"{i}/COPYING", "Our copy of the licence\n" + t.replace("\n\n", "\n")) for i, t in texts.items()] + [(f"{i}/own", f"some words {i}") for i in texts]
    got = scanned(spark, rows, templates=L.TEMPLATES + L.read_templates(texts))
    assert all(got[f"{i}/COPYING"][0] == i and got[f"{i}/own"][0] is None for i in texts)


def test_no_unit_is_passed_over_that_reaches_the_threshold():
    rng = random.Random(6)
    words = sorted({w for x in L.TEMPLATES for w in L.terms(x[1])})
    scorer = L.Scorer(L.TEMPLATES, 1000, {w: rng.choice([0, 5, 300, 900]) for w in words})
    for least in (0.3, 0.7, 0.95):
        for _ in range(3000):
            x = rng.choice(L.TEMPLATES)
            unit = Counter(w for w in L.terms(x[1]) if rng.random() < 0.6)
            if scorer.core(least, True).isdisjoint(unit):
                assert scorer.best(unit, least, True)[0] is None
