import math
import re
from collections import Counter

import pytest

from corpusloom.llm.licence_templates import texts
from corpusloom.llm.licenses import TEMPLATES, document_files, line_licences, scan

FILES = [
    ("a/LICENSE", "x\nReleased under the MIT License.\nmore"), ("a/b/c/file.txt", "plain"), ("a/b/own.txt", "Licensed under the Apache License, Version 2.0."),
    ("a/d/COPYING.md", "This work is licensed under the GNU General Public License, version 3."), ("a/d/e/f.txt", None), ("top.txt", ""),
    ("z/q.txt", "no word of it"), ("z/licence", "the licensee pays for any license of any kind to anyone who asks in writing before noon"),
    (None, "Licensed under CC BY-NC 4.0."), ("a/b/c/file.txt", "plain"), ("a/NOTICE", "Licensed under the Apache License, Version 2.0"),
]


def test_inheritance(spark):
    files = spark.createDataFrame([(*f, 1) for f in FILES], "path string, text string, licence int")
    rows = scan(files).collect()
    assert len(rows) == len(FILES)
    got = {r.path: (r.licence, r.origin) for r in rows}
    assert got["a/LICENSE"] == ("MIT", "own") and got["a/b/own.txt"] == ("Apache-2.0", "own")
    assert got["a/d/e/f.txt"] == ("GPL-3.0", "a/d")
    assert got["a/b/c/file.txt"][1] == "a" and got["a/b/c/file.txt"][0] in ("MIT", "Apache-2.0")
    assert got["top.txt"] == got["z/q.txt"] == got["z/licence"] == (None, None)
    assert got[""] == ("CC-BY-NC-4.0", "own")


def test_scores_match_brute_force(spark):
    lines = [line for _, text in FILES for line in (text or "").split("\n") if re.search("(?i)licen[sc]", line)] * 2
    terms = lambda t: re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", t.lower())
    df = Counter(t for line in lines for t in set(terms(line)))
    idf = lambda t: math.log((len(lines) + 1) / (df[t] + 1)) + 1

    def vector(text):
        return {t: n * idf(t) for t, n in Counter(terms(text)).items()}

    def cosine(a, b):
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(t, 0) for t, x in a.items()) / (norm(a) * norm(b))

    got = {r.line: (r.licence, r.score) for r in line_licences(spark.createDataFrame([(x,) for x in lines], "line string"), threshold=0.0).collect()}
    for line in set(lines):
        best = min((-round(cosine(vector(line), vector(text)), 9), name) for name, text in TEMPLATES)
        assert got[line] == (best[1], pytest.approx(-best[0]))


def test_headers_spdx_forms_and_whole_licence_files(spark):
    gnu = dict(re.findall(r"(?s)(\S+)\n(.*?)\n--\n", """GPL
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version %s of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; see the GNU General Public License for more details.
--
"""))["GPL"]
    whole = dict((name, text) for name, text in texts() if len(text) > 5000)
    cases = [
        (f"spdx/{k}.c", f"// SPDX-License-Identifier: {x}\nint main() {{ return {k}; }}", want) for k, (x, want) in enumerate(
            [("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-or-later", "GPL-3.0"), ("GPL-2.0-only", "GPL-2.0"), ("Strange-Own-7", None)]
        )
    ]
    cases += [(f"gnu/{v}.py", f"{gnu % v}\n\nimport os\nprint(os.name)", f"GPL-{v}.0") for v in "23"]
    cases += [("v/2", "GNU General Public License, version 2", "GPL-2.0"), ("v/a", "GNU Affero General Public License, version 3", "AGPL-3.0"),
              ("v/bsd.go", "// Copyright 2009 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n"
               "// license that can be found in the LICENSE file.\n\npackage main", "BSD-3-Clause")]
    cases += [(f"w/{name}/LICENSE", text, name) for name, text in whole.items()]
    cases += [(f"w/{name}/sub/x.txt", "plain", name) for name in whole]
    rows = scan(spark.createDataFrame([c[:2] for c in cases], "path string, text string")).collect()
    assert len(whole) == 7 and {r.path: r.licence for r in rows} == {path: want for path, _, want in cases}


def test_awkward_and_empty(awkward, nothing):
    assert scan(document_files(awkward).select("path", "text")).count() == awkward.count()
    assert scan(document_files(nothing).select("path", "text")).count() == 0
