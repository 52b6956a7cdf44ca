import re

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.llm import licenses
from brindle.llm.licenses import RULES, SENTENCES


def brute(text):
    known = {" ".join(re.sub(r"[\W_]+", " ", s.lower()).split()): k for k, s in SENTENCES.items()}

    def name(s):
        return known.get(" ".join(re.sub(r"[\W_]+", " ", s.lower()).split()))

    found = []
    for s in re.sub(r"([.!?])\s+|\n\s*\n", lambda m: (m[1] or "") + "\x1e", text or "").split("\x1e"):
        found += [name(s)] if name(s) or "\n" not in s else [name(line) for line in s.split("\n")]
    found = [f for f in found if f]
    total, out = len(found), []
    for rule, license_, parts in RULES:
        n = i = 0
        while i + len(parts) <= len(found):
            if tuple(found[i : i + len(parts)]) == parts:
                found[i : i + len(parts)] = [None]
                n += 1
            i += 1
        if n:
            out.append((license_, rule, n, total))
    return sorted(out)


def text_of(*names):
    return " ".join(SENTENCES[n] for n in names)


TEXTS = [
    None, "", "  ", "Prose without any licence. And more.", SENTENCES["mit-reference"], "Prose.\n" + SENTENCES["cc-by-nc-4-reference"] + "\nMore",
    text_of("mit-grant") + "\n\n" + text_of("mit-notice", "as-is", "no-liability"), text_of("mit-notice", "mit-grant"),
    text_of("apache2-grant") + "\n" + SENTENCES["apache2-copy"] + "\n\n" + text_of("apache2-basis", "apache2-see"),
    text_of("bsd-redistribution") + "\n\n" + text_of("bsd-source", "bsd-binary", "bsd-endorsement", "apache2-reference", "apache2-reference"),
    "unfinished line\nReleased under the  MIT license.\nnext", SENTENCES["gpl3-reference"].upper().replace(" ", "\n"),
    "word " * 50_000 + ". " + text_of("gpl3-or-later", "gpl-hope", "gpl-see"),
]


def test_rules_like_brute_force(docs_of):
    pairs = [*enumerate(TEXTS), (None, SENTENCES["mit-reference"]), (4, SENTENCES["mit-reference"])]
    got = sorted(map(tuple, licenses.scan(docs_of(pairs)).collect()), key=str)
    assert got == sorted(((i, *m) for i, t in pairs for m in brute(t)), key=str) and len(got) >= 10


def test_empty_table_clashing_columns_and_plan(frame, docs_of):
    assert licenses.scan(docs_of([])).count() == 0
    out = licenses.scan(frame([(1, SENTENCES["cc-by-4-long"], "x", 3)], "doc_id long, text string, license string, n_known int"))
    assert [tuple(r) for r in out.collect()] == [(1, "CC-BY-4.0", "cc-by-4-long", 1, 1)]
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow"))


def test_query_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = sorted(map(tuple, entry.queries()["op4_license_rules"](spark, folder).select("doc_id", "license", "rule", "n_matches", "n_known").collect()))
    want = con.execute(f"SELECT doc_id, license, rule, n_matches, n_known FROM ({entry.oracle_sql()['op4_license_rules']})").fetchall()
    assert got == sorted(want) and got


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright 2019, Some Body
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
APACHE = """Copyright 2015 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."


def commented(text, first, prefix, last):
    return first + "\n".join((prefix + line).rstrip() for line in text.split("\n")) + last


COMMENTS = [("", "", ""), ("", "# ", ""), ("/*\n", " * ", "\n */"), ("", "// ", ""), ("", "-- ", ""), ("<!--\n", "", "\n-->"), ("", "dnl ", ""),
            ("", "REM ", ""), ("# -*- coding: utf-8 -*-\n", "# ", ""), ("", "C     ", ""), ("#!/bin/sh\n", "#  ", "\n\nset -e\n")]


def test_licence_texts_as_they_stand_in_source_files(docs_of):
    wanted = {"MIT": (MIT, "mit-text"), "BSD-3-Clause": (BSD, "bsd3-text"), "Apache-2.0": (APACHE, "apache2-header-url"), "GPL-3.0-or-later": (GPL, "gpl3-grant")}
    texts = [(license_, rule, commented(text, *c)) for license_, (text, rule) in wanted.items() for c in COMMENTS]
    texts += [("MIT", "mit-text", commented("\n".join(x for x in MIT.split("\n") if x), "", "# ", ""))]
    texts += [("Apache-2.0", "apache2-header-url", APACHE.replace("\n\n    http", "\n https"))]
    got = {r.doc_id: (r.license, r.rule, r.n_matches) for r in licenses.scan(docs_of([(i, t) for i, (*_, t) in enumerate(texts)])).filter(
        "rule <> 'mit-title'").collect()}
    assert got == {i: (license_, rule, 1) for i, (license_, rule, _) in enumerate(texts)}


def test_spdx_identifiers(docs_of):
    lines = {"// SPDX-License-Identifier: MIT\n// Copyright": "MIT", "/* SPDX-License-Identifier: GPL-2.0+ */\nint x;": "GPL-2.0-or-later",
             "# SPDX-License-Identifier: GPL-2.0\nimport x": "GPL-2.0-only", "x\n# SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0 OR MIT",
             "SPDX-License-Identifier: Unheard-Of-1.0": None}
    got = {r.doc_id: r.license for r in licenses.scan(docs_of(list(enumerate(lines)))).collect()}
    assert got == {i: x for i, x in enumerate(lines.values()) if x}


def test_every_sentence_has_its_own_sign_and_rule(docs_of):
    assert len(licenses.known_plain()) == len(SENTENCES)
    singles = {parts[0]: license_ for _, license_, parts in RULES if len(parts) == 1}
    pairs = list(enumerate(singles))
    got = {r.doc_id: r.license for r in licenses.scan(docs_of([(i, "Words before.\n" + SENTENCES[s] + "\n\nWords after.") for i, s in pairs])).collect()}
    assert got == {i: singles[s] for i, s in pairs}


def test_numbers_and_colons_inside_sentences_are_no_ends(docs_of):
    texts = ["Words\n" + SENTENCES["gpl3-reference"] + "\nwords", "Words\n" + SENTENCES["gpl3-or-later"], "Words\n" + SENTENCES["apache2-copy"] + "\n" + APACHE,
             "List: 1. one\n" + SENTENCES["gpl3-reference"]]
    got = {(r.doc_id, r.rule) for r in licenses.scan(docs_of(list(enumerate(texts)))).collect()}
    assert got == {(0, "gpl3-reference"), (1, "gpl3-grant"), (2, "apache2-header-url"), (3, "gpl3-reference")}


@pytest.mark.parametrize("holder", ["the University", "Google Inc.", "the copyright holder", "Jane Doe & Sons, Ltd."])
@pytest.mark.parametrize("comment", ["", " * "])
def test_bsd3_with_a_named_holder_is_not_bsd2(frame, holder, comment):
    parts = [licenses.SENTENCES[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary")]
    parts.append(licenses.SENTENCES["bsd-endorsement"].replace("the copyright holder", holder))
    text = "\n".join(comment + p for p in parts)
    rows = licenses.scan(frame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.license, r.rule) for r in rows] == [("BSD-3-Clause", "bsd3-text")]


@pytest.mark.parametrize("text", ["This project is licensed under the terms of the MIT license.", "Distributed under the MIT License.", "This project is licensed under the MIT License."])
def test_common_references_to_mit(frame, text):
    assert [r.license for r in licenses.scan(frame([(1, text)], "doc_id long, text string")).collect()] == ["MIT"]
