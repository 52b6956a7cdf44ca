"""Licence scans by sentence rules.

A text is cut into sentences, every sentence that is known becomes an identifier, and the sequence of
identifiers is matched against ordered rules. Everything happens inside the row: no shuffle, no join.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of licences and licence references, by identifier.
SENTENCES = {
    "apache2-reference": "Licensed under the Apache License, Version 2.0.",
    "apache2-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-reference": "Released under the MIT License.",
    "mit-reference-2": "Licensed under the MIT License.",
    "mit-reference-3": "This project is licensed under the terms of the MIT license.",
    "mit-reference-4": "Distributed under the MIT License.",
    "mit-reference-5": "This project is licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "no-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-reference": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "cc-by-nc-4-reference": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-reference": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-reference": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-reference": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "apache2-copy-at": "You may obtain a copy of the License at",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "mit-notice-next": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-reference": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "unlicense-text": "This is free and unencumbered software released into the public domain.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "epl2-reference": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-or-later-2": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-sa-4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-4-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nd-4-reference": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4-reference": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4-reference": "Licensed under CC BY-NC-ND 4.0.",
}
# Identifiers in "SPDX-License-Identifier:" lines, and the licence where an old identifier stands for another.
SPDX = {i: i for i in (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "PostgreSQL", "PSF-2.0", "Unlicense", "WTFPL", "Zlib",
    "Apache-2.0 OR MIT", "MIT OR Apache-2.0", "Apache-2.0 WITH LLVM-exception", "GPL-2.0-only WITH Linux-syscall-note",
)} | {
    "AGPL-3.0": "AGPL-3.0-only", "GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only",
    "GPL-2.0 WITH Linux-syscall-note": "GPL-2.0-only WITH Linux-syscall-note",
}
SENTENCES |= {f"spdx-{i}": f"SPDX-License-Identifier: {i}" for i in SPDX}

# Fixed values: (rule, licence, sentences in order). Longer rules come before rules whose sentences they hold.
RULES = (
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("apache2-header", "Apache-2.0", ("apache2-grant", "apache2-copy", "apache2-basis", "apache2-see")),
    ("apache2-header-url", "Apache-2.0", ("apache2-grant", "apache2-copy-at", "apache2-basis", "apache2-see")),
    ("mit-text-next", "MIT", ("mit-grant", "mit-notice-next", "as-is", "no-liability")),
    ("bsd3-text", "BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement")),
    ("bsd2-text", "BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("gpl3-header", "GPL-3.0-or-later", ("gpl3-or-later", "gpl-hope", "gpl-see")),
    ("gpl2-header", "GPL-2.0-or-later", ("gpl2-or-later", "gpl-hope", "gpl-see")),
    ("mit-titled", "MIT", ("mit-title", "mit-grant")),
    ("mit-grant", "MIT", ("mit-grant", "mit-notice")),
    ("apache2-grant", "Apache-2.0", ("apache2-grant",)),
    ("gpl3-grant", "GPL-3.0-or-later", ("gpl3-or-later",)),
    ("gpl2-grant", "GPL-2.0-or-later", ("gpl2-or-later",)),
    ("apache2-reference", "Apache-2.0", ("apache2-reference",)),
    ("mit-reference", "MIT", ("mit-reference",)),
    ("mit-reference-2", "MIT", ("mit-reference-2",)),
    ("mit-reference-3", "MIT", ("mit-reference-3",)),
    ("mit-reference-4", "MIT", ("mit-reference-4",)),
    ("mit-reference-5", "MIT", ("mit-reference-5",)),
    ("gpl3-reference", "GPL-3.0-only", ("gpl3-reference",)),
    ("cc-by-nc-4-reference", "CC-BY-NC-4.0", ("cc-by-nc-4-reference",)),
    ("cc-by-4-reference", "CC-BY-4.0", ("cc-by-4-reference",)),
    ("cc-by-sa-4-reference", "CC-BY-SA-4.0", ("cc-by-sa-4-reference",)),
    ("cc-by-4-long", "CC-BY-4.0", ("cc-by-4-long",)),
    ("cc-by-nc-4-long", "CC-BY-NC-4.0", ("cc-by-nc-4-long",)),
    ("cc0-reference", "CC0-1.0", ("cc0-reference",)),
    ("mit-grant-only", "MIT", ("mit-grant",)),
    ("apache2-title", "Apache-2.0", ("apache2-title",)),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("isc-grant-2", "ISC", ("isc-grant-2",)),
    ("0bsd-grant", "0BSD", ("0bsd-grant",)),
    ("zlib-grant", "Zlib", ("zlib-grant",)),
    ("bsl-reference", "BSL-1.0", ("bsl-reference",)),
    ("bsl-title", "BSL-1.0", ("bsl-title",)),
    ("mpl2-header", "MPL-2.0", ("mpl2-header",)),
    ("unlicense-text", "Unlicense", ("unlicense-text",)),
    ("wtfpl-title", "WTFPL", ("wtfpl-title",)),
    ("epl2-reference", "EPL-2.0", ("epl2-reference",)),
    ("gpl3-title", "GPL-3.0", ("gpl3-title",)),
    ("gpl2-title", "GPL-2.0", ("gpl2-title",)),
    ("lgpl3-title", "LGPL-3.0", ("lgpl3-title",)),
    ("lgpl21-title", "LGPL-2.1", ("lgpl21-title",)),
    ("agpl3-title", "AGPL-3.0", ("agpl3-title",)),
    ("gpl2-only", "GPL-2.0-only", ("gpl2-only",)),
    ("lgpl21-grant", "LGPL-2.1-or-later", ("lgpl21-or-later",)),
    ("lgpl3-grant", "LGPL-3.0-or-later", ("lgpl3-or-later",)),
    ("lgpl3-grant-2", "LGPL-3.0-or-later", ("lgpl3-or-later-2",)),
    ("agpl3-grant", "AGPL-3.0-or-later", ("agpl3-or-later",)),
    ("cc-by-sa-4-long", "CC-BY-SA-4.0", ("cc-by-sa-4-long",)),
    ("cc-by-nd-4-long", "CC-BY-ND-4.0", ("cc-by-nd-4-long",)),
    ("cc-by-nc-sa-4-long", "CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-long",)),
    ("cc-by-nc-nd-4-long", "CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-long",)),
    ("cc-by-nd-4-reference", "CC-BY-ND-4.0", ("cc-by-nd-4-reference",)),
    ("cc-by-nc-sa-4-reference", "CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-reference",)),
    ("cc-by-nc-nd-4-reference", "CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-reference",)),
    *((f"spdx-{i}", license_, (f"spdx-{i}",)) for i, license_ in SPDX.items()),
)

# Each identifier is one private character in a sequence; used-up sentences leave a mark that no rule holds.
FIRST_SIGN, USED, BREAK = 0xE000, "|", "\x1e"
NOT_WORD = r"[^\p{L}\p{N}]+"
# Marks of comment lines that are words; all others vanish with what is no letter or digit. "2.0+" is an old "2.0-or-later".
COMMENT_WORDS = r"(?m)^[ \t]*(?:dnl|@?rem|REM|[cC](?=[ \t]{2}|\r?$))(?=\s|$)"
OR_LATER = r"(SPDX-License-Identifier:[ \t]*[A-Z]+-[0-9.]+)\+"
# Sentences end at . ! or ? before white space, after copyright, coding and #! lines, and at lines without a letter or digit.
ENDS = r"([.!?])\s+|((?i:copyright)[ \t]+(?:\([cC]\)|©|[0-9]{4})[^\n]*+|-\*-[ \t]*|^#![^\n]*+)\n|\n[^\p{L}\p{N}\n]*+\n"
# Where a sentence that is not known may yet end: at a colon, and at the number of a list that follows it or starts a line.
NUMBER = r"\(?(?:[0-9]{1,2}|[a-zA-Z])[.)](?=\s|$)"
COLON = r"(?<!Identifier)(?<!free software):(?=\s|$)"
PARTS = rf"{COLON}[^\p{{L}}\p{{N}}]*+{NUMBER}|{COLON}\s*|(?:^|\n)[^\p{{L}}\p{{N}}\n]*?{NUMBER}"
ADDRESS = r"\s+https?://\S+\s*$"
# Holders stand by name in the endorsement clause; in normalised form any name counts as the holder.
HOLDER = r"^neither the name of .{1,200} nor the names of (its|his|her|their|the) contributors may be used"
# A holder's name may end in a point, which ends no sentence there.
HOLDER_POINT = r"\.(\s+nor\s+the\s+names\s+of)"
ANY_HOLDER = "neither the name of the copyright holder nor the names of its contributors may be used"


def normalised(sentence: Column) -> Column:
    """Lower case, letters and digits only, one space between; a named holder is the holder."""
    plain = F.btrim(F.regexp_replace(F.lower(sentence), NOT_WORD, " "))
    return F.when(F.startswith(plain, F.lit("neither the name of ")), F.regexp_replace(plain, HOLDER, ANY_HOLDER)).otherwise(plain)


def sentences(text: Column) -> Column:
    """Sentences of a text, be it a comment block or not; a line end alone does not end one."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.contains(text, F.lit("the names")), F.regexp_replace(text, HOLDER_POINT, "$1")).otherwise(text)
    plain = F.regexp_replace(F.regexp_replace(text, COMMENT_WORDS, ""), OR_LATER, "$1-or-later")
    return F.split(F.regexp_replace(plain, ENDS, f"$1$2{BREAK}"), BREAK)


def known_plain() -> dict[str, str]:
    """Normalised sentence to its sign."""
    import re

    plain = (" ".join(re.sub(r"[\W_]+", " ", s.lower()).split()) for s in SENTENCES.values())
    return {s: chr(FIRST_SIGN + i) for i, s in enumerate(plain)}


def sign_sequence(text: Column) -> Column:
    """Signs of the known sentences in order. Where a sentence is unknown it is tried without an address
    at its end, then its parts, and the lines of unknown parts."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(known_plain().items())])

    def sign(sentence: Column, otherwise: Column) -> Column:
        without = F.try_element_at(known, normalised(F.regexp_replace(sentence, ADDRESS, "")))
        return F.coalesce(F.try_element_at(known, normalised(sentence)), F.when(F.contains(sentence, F.lit("://")), without), otherwise)

    def lines(part: Column) -> Column:
        alone = F.array_join(F.transform(F.split(part, "\n"), lambda line: sign(line, F.lit(""))), "")
        return F.when(F.contains(part, F.lit("\n")), alone).otherwise("")

    def parts(sentence: Column) -> Column:
        each = F.array_join(F.transform(F.split(sentence, PARTS), lambda part: sign(part, lines(part))), "")
        return F.when(F.rlike(sentence, F.lit(PARTS)), each).otherwise(lines(sentence))

    return F.array_join(F.transform(sentences(text), lambda sentence: sign(sentence, parts(sentence))), "")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, rule, n_matches, n_known), one row per row of ``docs`` and rule that matches.

    Rules are tried in their order on the sequence of known sentences, unknown ones left out; what a rule has matched is no longer
    there for later ones. ``n_known`` counts the known sentences of the text. Texts that are NULL or empty match nothing;
    ids may be NULL; repeated rows are answered each; other columns are not read.
    """
    sign = dict(zip(SENTENCES, known_plain().values()))
    rows = docs.select(F.col(doc_id).alias("doc_id"), sign_sequence(F.col(text)).alias("left")).filter("left <> ''")
    rows = rows.withColumn("n_known", F.char_length("left").cast("bigint"))
    rules = F.array(*[F.struct(F.lit(license_).alias("license"), F.lit(rule).alias("rule"), F.lit("".join(sign[p] for p in parts)).alias("sequence"))
                      for rule, license_, parts in RULES])

    def apply(state: Column, rule: Column) -> Column:
        left, sequence = state["left"], rule["sequence"]
        n = ((F.char_length(left) - F.char_length(F.replace(left, sequence, F.lit("")))) / F.char_length(sequence)).cast("bigint")
        hit = F.struct(rule["license"].alias("license"), rule["rule"].alias("rule"), n.alias("n_matches"))
        held = F.contains(left, sequence)
        return F.struct(F.when(held, F.replace(left, sequence, F.lit(USED))).otherwise(left).alias("left"),
                        F.when(held, F.array_append(state["hits"], hit)).otherwise(state["hits"]).alias("hits"))

    none = F.array().cast("array<struct<license:string,rule:string,n_matches:bigint>>")
    hits = F.aggregate(rules, F.struct(F.col("left"), none.alias("hits")), apply, lambda state: state["hits"])
    found = rows.select("doc_id", "n_known", F.explode(hits).alias("m"))
    return found.select("doc_id", "m.license", "m.rule", "m.n_matches", "n_known")
