"""Licence scans: known sentences in the order that a licence's rule asks for.

A text's words are cut at line ends and at the stops of sentences. A known
sentence is recognised where its words, in lower case, stand in a row from one
cut to another, over however many lines, comment signs and blank lines; it then
counts as its identifier. A rule is an ordered list of identifiers; it holds
where the text's identifiers, in order and with at most ``GAP`` unknown
sentences between two of them, are the rule's. Of rules that begin at one
sentence the longest counts, and no sentence serves two rules.

The rule base has titles, usual notices, file headers, short licences' whole
texts and SPDX tags of common licences; of long licences it knows the heading,
not the body, and of SPDX expressions single identifiers, not combinations.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, token_files

#: Unknown sentences allowed between two sentences of a rule.
GAP = 2
#: Sentences of public licences and of their usual notices.
SENTENCES = {
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-notice-3": "This project is licensed under the MIT License",
    "mit-name": "The MIT License",
    "mit-name-2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is-caps": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-long": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-except": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-notice-2": "Licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-either": "either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "mit-terms": "This project is licensed under the terms of the MIT license",
    "apache-title": "Apache License",
    "apache-date": "Version 2.0, January 2004",
    "apache-project": "This project is licensed under the Apache License 2.0",
    "apache-short": "Licensed under the Apache License 2.0",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gpl2-date": "Version 2, June 1991",
    "lgpl2-date": "Version 2.1, February 1999",
    "gpl3-date": "Version 3, 29 June 2007",
    "agpl3-date": "Version 3, 19 November 2007",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "lgpl-free": "This library is free software",
    "lgpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl2-either": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-waiver": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "epl-title": "Eclipse Public License - v 2.0",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
}
#: Identifiers that a tag names, as ``SPDX-License-Identifier: MIT``.
TAGS = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "MPL-2.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
)
SENTENCES |= {f"spdx-{tag}": f"SPDX-License-Identifier: {tag}" for tag in TAGS}
#: Fixed values: (licence, identifiers in order).
RULES = (
    ("MIT", ("mit-notice",)), ("MIT", ("mit-notice-2",)), ("MIT", ("mit-notice-3",)), ("MIT", ("mit-name",)), ("MIT", ("mit-name-2",)),
    ("MIT", ("mit-grant", "mit-condition", "as-is-caps")), ("MIT", ("mit-grant", "mit-condition", "as-is-caps", "mit-liability")),
    ("MIT", ("mit-name", "mit-grant", "mit-condition", "as-is-caps", "mit-liability")), ("MIT", ("mit-name-2", "mit-grant", "mit-condition", "as-is-caps", "mit-liability")),
    ("Apache-2.0", ("apache-notice",)), ("Apache-2.0", ("apache-notice-long",)),
    ("Apache-2.0", ("apache-notice-long", "apache-except", "apache-copy", "apache-as-is", "apache-see")),
    ("GPL-3.0-only", ("gpl3-notice",)), ("GPL-3.0-only", ("gpl3-notice-2",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")), ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl2-either")), ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl2-either", "gpl-hope", "gpl-implied", "gpl-see")),
    ("CC-BY-NC-4.0", ("cc-by-nc",)), ("CC-BY-4.0", ("cc-by",)), ("CC-BY-4.0", ("cc-by-long",)), ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("ISC", ("isc-grant",)), ("ISC", ("isc-grant", "isc-as-is", "isc-liability")), ("MPL-2.0", ("mpl-notice",)), ("MPL-2.0", ("mpl-notice", "mpl-copy")), ("MPL-2.0", ("mpl-title",)),
    ("Unlicense", ("unlicense",)), ("Unlicense", ("unlicense", "unlicense-free")), ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")), ("EPL-2.0", ("epl-title",)), ("EPL-2.0", ("epl-terms",)),
    ("BSL-1.0", ("bsl-title",)), ("BSL-1.0", ("bsl-notice",)), ("CC0-1.0", ("cc0-title",)), ("CC0-1.0", ("cc0-waiver",)), ("CC-BY-SA-4.0", ("cc-by-sa-long",)), ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("MIT", ("mit-terms",)), ("Apache-2.0", ("apache-title", "apache-date")), ("Apache-2.0", ("apache-project",)), ("Apache-2.0", ("apache-short",)),
    ("GPL-2.0-only", ("gpl-title", "gpl2-date")), ("GPL-3.0-only", ("gpl-title", "gpl3-date")), ("LGPL-2.1-only", ("lgpl-title", "lgpl2-date")), ("LGPL-3.0-only", ("lgpl-title", "gpl3-date")), ("AGPL-3.0-only", ("agpl-title", "agpl3-date")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only")), ("GPL-2.0-only", ("gpl-free", "gpl2-only", "gpl-hope", "gpl-implied", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied", "gpl-see", "gpl-received")), ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl2-either", "gpl-hope", "gpl-implied", "gpl-see", "gpl-received")),
    *((name, (free, "lgpl2-terms", "lgpl2-either", *rest)) for name in ("LGPL-2.1-or-later",) for free in ("gpl-free", "lgpl-free") for rest in ((), ("lgpl-hope", "gpl-implied", "lgpl-see"), ("gpl-hope", "gpl-implied", "lgpl-see"))),
    *((name, (free, "lgpl3-terms", *rest)) for name in ("LGPL-3.0-or-later",) for free in ("gpl-free", "lgpl-free") for rest in ((), ("lgpl-hope", "gpl-implied", "lgpl-see"), ("gpl-hope", "gpl-implied", "lgpl-see"))),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms")), ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms", "gpl-hope", "gpl-implied", "agpl-see")),
    *((tag, (f"spdx-{tag}",)) for tag in TAGS),
)
#: Each known sentence has one of these words (single ones, as a line may end after any); texts without any are not cut up.
ANCHORS = r"(?i)licen[sc]e|permi|warrant|liab|redistribut|software|copyright|copying|version|domain|cc0|mpl|program|commercial"
SCHEMA = "doc_id long, licences string, n_sentences long, spans string"

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_STOP = re.compile(r"[.!?;:](?=\s|$)")
_CUT = re.compile(r"\n|[.!?;:](?=\s|$)")


def normal(sentence: str) -> str:
    """Lower-case words (version numbers stay whole) with a space between."""
    return " ".join(_WORD.findall(sentence.lower()))


#: Known sentences by their last word, and rules by their first sentence, the longest first.
_BY_LAST: dict[str, list[tuple[list[str], str]]] = {}
for _id, _said in SENTENCES.items():
    _BY_LAST.setdefault(normal(_said).split()[-1], []).append((normal(_said).split(), _id))
_BY_FIRST: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _licence, _rule in sorted(RULES, key=lambda r: -len(r[1])):
    _BY_FIRST.setdefault(_rule[0], []).append((_licence, _rule))


def known_sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of each known sentence from one cut to another, in order."""
    places, words = [], []
    for m in _WORD.finditer(text):
        places.append(m.start())
        words.append(m[0].lower())
    ends: dict[int, int] = {}
    for at in (*(m.end() for m in _CUT.finditer(text)), len(text)):
        ends.setdefault(bisect_left(places, at), at)  # words before the cut, and where it is
    out = []
    for j, end in ends.items():
        for said, name in _BY_LAST.get(words[j - 1], ()) if j else ():
            i = j - len(said)
            if (i == 0 or i in ends) and i >= 0 and words[i:j] == said:
                out.append((places[i], end, name))
    return sorted(out)


def scan(text: str | None) -> list[tuple[str, int, int, int]]:
    """(licence, start, end, number of sentences) of each rule that holds, in order."""
    text = text or ""
    # of sentences that overlap, the longest is meant
    kept: list[tuple[int, int, str]] = []
    for k in sorted(known_sentences(text), key=lambda k: (k[0], -k[1])):
        if not kept or k[0] >= kept[-1][1]:
            kept.append(k)
    out, at = [], 0
    while at < len(kept):
        for licence, rule in _BY_FIRST.get(kept[at][2], ()):
            part = kept[at : at + len(rule)]
            if tuple(k[2] for k in part) == rule and all(_unknown(text[x[1] : y[0]]) <= GAP for x, y in zip(part, part[1:])):
                out.append((licence, part[0][0], part[-1][1], len(rule)))
                at += len(rule)
                break
        else:
            at += 1
    return out


def _unknown(between: str) -> int:
    """Sentences with any word in what lies between two known ones."""
    return sum(bool(_WORD.search(p)) for p in _STOP.split(between))


def scan_documents(docs: DataFrame) -> DataFrame:
    """Licences of every ``docs(doc_id, text)``: (doc_id, licences, n_sentences, spans).

    ``licences`` names each rule that holds, by place, comma-joined; ``spans``
    says licence:start:end likewise, in code points. Null and empty texts, and
    texts without a known sentence, get empty strings and 0; repeated rows are
    scanned each; an empty table gives no row. Texts without any word that all
    known sentences need aren't sent to Python. No shuffle.
    """
    common.ship(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(ANCHORS), F.col("text").cast("string")).alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column(1)
            for i, j in common.slices(len(texts), token_files._lengths(texts)):
                found = [scan(t) if t else [] for t in texts.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([",".join(x[0] for x in f) for f in found]), pa.array([sum(x[3] for x in f) for f in found], pa.int64()), pa.array([",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in f) for f in found])],
                    ["doc_id", "licences", "n_sentences", "spans"],
                )

    return given.mapInArrow(run, SCHEMA)
