"""License scans by patience alignment of documents with license statements.

Words unique to both sides are anchors; the longest increasing subsequence of anchors is kept, and
each gap between them is aligned in the same way. Where a gap has no anchor, equal words next to its
ends are matched. Coverage is the share of the statement's words that are matched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tribospark.llm.text import text_values

# Names that licenses go by in a sentence, by their identifiers.
TITLES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU Affero General Public License v3", "GNU AGPL v3", "AGPL v3", "AGPLv3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause", "2-clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause", "3-clause BSD License", "New BSD License", "Modified BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 License", "Creative Commons Zero v1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL v2", "GNU GPL version 2", "GPL v2", "GPLv2", "GPL version 2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL v3", "GNU GPL version 3", "GPL v3", "GPLv3", "GPL version 3", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License v3", "GNU LGPL v3", "LGPL v3", "LGPLv3", "LGPL-3.0"],
    "MIT": ["MIT License", "MIT"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 License", "MIT-0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
# What such a sentence says before the name, and identifiers of the one-line form.
LEADS = ("licensed under", "released under", "distributed under", "available under", "published under", "provided under", "under the terms of")
ARTICLES = ("", "the", "a", "an")
IDENTIFIERS = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib",
)
# The parts of Creative Commons licenses, and the words that stand for them.
COMMONS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
COMMONS_KINDS = ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")
COMMONS_VERSIONS = ("2.0", "3.0", "4.0")
# Sentences and notices as they are published. A word in {braces} must be found there; it tells the text from its siblings.
NOTICES = {
    "All-rights-reserved": "All rights reserved.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-header": "Licensed under the {Apache} License, Version {2}.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, {sublicense}, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, {sublicense}, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND {NONINFRINGEMENT}. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without {fee} is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must {reproduce} the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must {reproduce} the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. {Neither} the name of the copyright holder nor the names of its contributors may be used to {endorse} or promote products derived from this software without specific prior written permission.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2}.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {General} Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {General} Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {Lesser} General Public License as published by the Free Software Foundation; either version {2}.{1} of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU {Lesser} General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {Affero} General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version.",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the {public} domain worldwide. This software is distributed without any warranty.",
    "Unlicense-text": "This is free and {unencumbered} software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Notices that share most of their words: where several are found in one place, the one with the most matched words stands.
FAMILIES = (("MIT-notice", "MIT-text"), ("BSD-2-Clause-text", "BSD-3-Clause-text"),
            ("GPL-2.0-notice", "GPL-3.0-notice", "LGPL-2.1-notice", "LGPL-3.0-notice", "AGPL-3.0-notice"))
#: Statements of fewer words must be found whole and in one piece.
SHORT = 15
#: Share of a longer statement's words that must be found.
COVERAGE = 0.8
#: A longer statement may lie in this many times as many words as it has, and a few more.
STRETCH, SLACK = 1.5, 2
TOKEN = re.compile(r"\w+")


def catalogue() -> list[tuple[str, str]]:
    """(name, statement) of all statements: the notices, every title after every lead, and the one-line identifiers."""
    titles = [(name, title) for name, all_ in TITLES.items() for title in all_]
    for kind in COMMONS_KINDS:
        parts = "-".join(COMMONS[part] for part in kind.split("-"))
        for version in COMMONS_VERSIONS:
            name = f"CC-{kind}-{version}"
            titles += [(name, f"CC {kind} {version}"), (name, f"CC-{kind}-{version}"), (name, f"Creative Commons {kind} {version}")]
            titles += [(name, f"Creative Commons {parts} {version}{more}") for more in ("", " License", " International License", " International", " Unported License")]
    leads = [" ".join(filter(None, (lead, article))) for lead in LEADS for article in ARTICLES]
    said = [(name, f"{lead} {title}") for name, title in titles for lead in leads]
    commons = [f"CC-{kind}-{version}" for kind in COMMONS_KINDS for version in COMMONS_VERSIONS]
    lines = [(name, f"SPDX-License-Identifier: {name}") for name in (*IDENTIFIERS, *commons)]
    return [*NOTICES.items(), *said, *lines]


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first number, that also rises in the second (patience piles)."""
    tops: list[int] = []
    chain: list[tuple[int, int]] = []  # (position in pairs, its predecessor)
    piles: list[int] = []
    for at, (_, second) in enumerate(pairs):
        pile = bisect_left(tops, second)
        chain.append((at, piles[pile - 1] if pile else -1))
        if pile == len(tops):
            tops.append(second)
            piles.append(at)
        else:
            tops[pile], piles[pile] = second, at
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(pairs[at])
        at = chain[at][1]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text, template) positions, both increasing. Gaps wait on a stack, so depth is no limit."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        where = {text[i]: i for i in range(a, b) if here[text[i]] == 1}
        anchors = [(where[template[j]], j) for j in range(c, d) if there[template[j]] == 1 and template[j] in where]
        kept = increasing(sorted(anchors))
        found += kept
        before = (a - 1, c - 1)
        for x, y in [*kept, (b, d)] if kept else []:
            gaps.append((before[0] + 1, x, before[1] + 1, y))
            before = (x, y)
    return sorted(found)


class Statement:
    def __init__(self, name: str, text: str, coverage: float = COVERAGE):
        self.name, self.words = name, words_of(text)
        marked = re.sub(r"\{(\w+)\}", r"must_\1", text)
        self.must = {i for i, word in enumerate(words_of(marked)) if word.startswith("must_")}
        self.counts = Counter(self.words)
        self.short = len(self.words) < SHORT
        self.need = len(self.words) if self.short else max(1, -int(-coverage * len(self.words) // 1))
        self.width = len(self.words) if self.short else int(STRETCH * len(self.words)) + SLACK

    def at(self, text: list[str], start: int) -> tuple[int, int] | None:
        """(last word + 1, matched words) of the statement if it starts at this word."""
        matched = align(text[start : start + self.width], self.words)
        if len(matched) < self.need or matched[0][0] > 0 or not self.must <= {place for _, place in matched}:
            return None
        return start + matched[-1][0] + 1, len(matched)

    def spans(self, text: list[str], known: set[str]) -> Iterator[tuple[int, int, int]]:
        """(first word, last word + 1, matched words) of each place with enough coverage, left to right.

        A place needs as many of the statement's words within its width, so the others are passed over.
        """
        if sum(n for word, n in self.counts.items() if word in known) < self.need:
            return
        hits = [i for i, word in enumerate(text) if word in self.counts]
        k = 0
        while k + self.need <= len(hits):
            start = hits[k]
            found = self.at(text, start) if hits[k + self.need - 1] - start < self.width else None
            if found is None:
                k += 1
                continue
            yield start, *found
            k = bisect_left(hits, found[0])


class Catalogue:
    """Statements by the word that the fewest of them have, so that a text meets few."""

    def __init__(self, statements: list[tuple[str, str]], coverage: float = COVERAGE):
        made = {(s.name, tuple(s.words)): s for s in (Statement(name, text, coverage) for name, text in statements)}
        shared = Counter(word for s in made.values() for word in s.counts)
        self.by_word: dict[str, list[Statement]] = {}
        for s in made.values():
            # a long statement may lack any one word, but not all those that must be there
            sure = [s.words[i] for i in s.must] if s.must else s.words if s.short else None
            self.by_word.setdefault(min(sure, key=lambda w: (shared[w], w)) if sure else "", []).append(s)
        self.always = self.by_word.pop("", [])
        self.family = {name: number for number, names in enumerate(FAMILIES) for name in names}

    def find(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(first, last + 1, name, coverage) by place. Of short statements one inside another is left out, of a
        family of notices those that overlap one with more matched words."""
        known = set(words)
        open_ = [s for word in known & self.by_word.keys() for s in self.by_word[word]] + self.always
        found = [(a, b, s, n) for s in open_ for a, b, n in s.spans(words, known)]
        found.sort(key=lambda f: (-f[3], f[0], f[2].name, f[1]))
        reach = max((s.width for _, _, s, _ in found), default=1)  # kept ones that may touch a place begin in one of three stretches
        kept: dict[int, list[tuple[int, int, Statement]]] = {}
        out = []
        for a, b, s, n in found:
            kin, near = self.family.get(s.name), a // reach
            hidden = any(
                (s.short and other.short and x <= a and b <= y) or (kin is not None and kin == self.family.get(other.name) and x < b and a < y)
                for stretch in (near - 1, near, near + 1) for x, y, other in kept.get(stretch, ()))
            if not hidden:
                kept.setdefault(near, []).append((a, b, s))
                out.append((a, b, s.name, n / len(s.words)))
        return sorted(out)


def scan_licenses(documents: DataFrame, statements: list[tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_words, licenses array<struct(name, first, last, coverage)>): one row for each document.

    Every place of the whole text that covers enough of a statement is listed, by place and name; a short statement inside a
    notice is listed too. A null or empty text has no words and no licenses. Other columns are ignored.
    """
    known = Catalogue(statements or catalogue(), coverage)
    kind = pa.list_(pa.struct([("name", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("coverage", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in text_values(batch.column("text")):
                words = words_of(text)
                sizes.append(len(words))
                found.append([{"name": n, "first": a, "last": b - 1, "coverage": c} for a, b, n, c in known.find(words)])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "licenses"])

    id_kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, n_words bigint, licenses array<struct<name:string,first:int,last:int,coverage:double>>"
    return documents.select("doc_id", "text").mapInArrow(scan, schema)
