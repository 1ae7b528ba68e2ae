"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms.

Templates and texts are sequences of lower-cased words.  A template's word trigrams are
winnowed (the smallest hash of every ``WINDOW`` neighbours is kept) and put in an inverted
index from hash to (template, place).  Any run of ``GRAM + WINDOW - 1`` words that a text
shares with a template holds one of its fingerprints.  Edits can break all such runs, so
single words that no finding can do without are indexed too: a name of the template, or, for
one without names, one place more than may be missed.  A text's hits are gathered by
template along their diagonals (place in the text less place in the template); each
cluster of diagonals is a candidate, which is aligned inside a band around the diagonals,
with both ends of the text free.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW = 3, 2
COVERAGE, LEAST_WORDS = 0.8, 5
#: Characters that are indexed at once; longer texts are read in overlapping slices.
CHUNK = 1 << 20
WORD = re.compile(r"[^\W_]+")
FOUND = "struct<license:string,template:string,coverage:double,matched:int,words:int,first_char:long,last_char:long>"


@dataclass(frozen=True)
class Template:
    """A license text or notice.

    The words of ``names`` have to be matched for a finding, and none of ``refused`` may stand
    between its words: they are what tells the license from its relatives.
    """

    name: str
    license: str
    names: tuple[str, ...]
    text: str
    refused: tuple[str, ...] = ()


# Wordings that licenses and their notices are known by, and words that tell relatives apart.
GNU_KINDS, CC_KINDS = ("lesser", "library", "affero"), ("noncommercial", "noderivatives", "noderivs", "sharealike", "nc", "nd", "sa")
AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
TEMPLATES = (
    Template("apache-line", "Apache-2.0", ("apache", "2"), "Licensed under the Apache License, Version 2.0."),
    Template(
        "apache-notice", "Apache-2.0", ("apache", "2"),
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    Template("mit-line", "MIT", ("mit",), "Released under the MIT License."),
    Template(
        "mit-grant", "MIT", ("charge", "sublicense"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    Template(
        "mit-text", "MIT", ("charge", "sublicense", "noninfringement"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    *[
        Template(f"gpl{v}-line", f"GPL-{v}.0", ("gnu", "general", v), f"This work is licensed under the GNU General Public License, version {v}.", GNU_KINDS)
        for v in ("2", "3")
    ],
    *[
        Template(
            f"gpl{v}-notice", f"GPL-{v}.0", ("gnu", "general", v),
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            f"as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.", GNU_KINDS,
        )
        for v in ("2", "3")
    ],
    *[
        Template(f"{name.lower()}-name", name, ("gnu", *kind.lower().split(), "general", v[0]), f"GNU {kind} General Public License, version {v}", refused)
        for name, kind, v, refused in (
            ("GPL-2.0", "", "2", GNU_KINDS), ("GPL-3.0", "", "3", GNU_KINDS), ("LGPL-2.1", "Lesser", "2.1", ()), ("LGPL-3.0", "Lesser", "3", ()), ("AGPL-3.0", "Affero", "3", ()),
        )
    ],
    Template("lgpl21-line", "LGPL-2.1", ("lesser", "2"), "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    Template("lgpl3-line", "LGPL-3.0", ("lesser", "3"), "This work is licensed under the GNU Lesser General Public License, version 3."),
    *[
        Template(
            f"lgpl{v[0]}-notice", f"LGPL-{v}", ("lesser", v[0]),
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
            f"as published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version.",
        )
        for v, n in (("2.1", "2.1"), ("3.0", "3"))
    ],
    Template("agpl3-line", "AGPL-3.0", ("affero", "3"), "This work is licensed under the GNU Affero General Public License, version 3."),
    Template(
        "agpl3-notice", "AGPL-3.0", ("affero", "3"),
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    *[
        Template(f"cc-{kind.lower()}-short", f"CC-{kind}-4.0", ("cc", *short, "4"), f"Licensed under CC {kind} 4.0.", tuple(x for x in ("nc", "nd", "sa") if x not in short))
        for kind, short in (("BY-NC", ("nc",)), ("BY-SA", ("sa",)), ("BY-ND", ("nd",)), ("BY-NC-SA", ("nc", "sa")), ("BY-NC-ND", ("nc", "nd")))
    ],
    *[
        Template(
            f"cc-{kind.lower()}-{v}-line", f"CC-{kind}-{v}.0", ("commons", "attribution", *long.lower().split("-")[1:], v),
            f"This work is licensed under a Creative Commons {long} {v}.0 {scope} License.",
            tuple(x for x in CC_KINDS if x not in long.lower().split("-")),
        )
        for v, scope in (("4", "International"), ("3", "Unported"))
        for kind, long in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    ],
    Template(
        "bsd-grant", "BSD", ("redistribution", "binary"),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    Template("bsd2-text", "BSD-2-Clause", ("redistributions", "binary", "disclaimer"), REDISTRIBUTION + AS_IS, ("endorse",)),
    Template(
        "bsd3-text", "BSD-3-Clause", ("redistributions", "binary", "endorse"),
        REDISTRIBUTION + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. " + AS_IS,
    ),
    Template("bsd-line", "BSD", ("bsd",), "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    Template(
        "isc-grant", "ISC", ("purpose", "fee"),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "0bsd-grant", "0BSD", ("purpose", "fee"),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ("provided",),
    ),
    Template(
        "zlib-text", "Zlib", ("misrepresented",),
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    Template("bsl-line", "BSL-1.0", ("boost", "1"), "Distributed under the Boost Software License, Version 1.0."),
    Template(
        "mpl2-notice", "MPL-2.0", ("mozilla", "2"),
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    Template("epl2-line", "EPL-2.0", ("eclipse", "2"), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    Template("cc0-line", "CC0-1.0", ("cc0",), "To the extent possible under law, this work is released under the CC0 1.0 Universal Public Domain Dedication."),
    Template("unlicense", "Unlicense", ("unencumbered",), "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of every run of letters and digits, lower-cased."""
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the smallest hash (the rightmost of equal ones) of every ``window`` neighbours."""
    if not hashes:
        return []
    spans = range(max(1, len(hashes) - window + 1))
    return sorted({min(range(i, min(i + window, len(hashes))), key=lambda j: (hashes[j], -j)) for i in spans})


def _hash(grams: tuple[str, ...]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(grams).encode("utf-8", "replace"), 42)


def band(words: int) -> int:
    """How far the diagonals of one occurrence may drift; less than a template's length, so repeats stay apart."""
    return words // 4 + 1


class Index:
    """The inverted index of the templates' winnowed fingerprints and indispensable words."""

    def __init__(self, templates: tuple[Template, ...], coverage: float = COVERAGE) -> None:
        self.templates = templates
        self.words = [[w for w, _, _ in words_of(t.text)] for t in templates]
        self.places: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            if len(words) < LEAST_WORDS:
                raise ValueError(f"template {templates[t].name} has fewer than {LEAST_WORDS} words")
            grams = list(zip(*(words[i:] for i in range(GRAM)), strict=False))
            for i in winnow([_hash(g) for g in grams], WINDOW):
                self.places.setdefault(grams[i], []).append((t, i))
            for i in self._indispensable(words, templates[t].names, coverage):
                self.anchors.setdefault(words[i], []).append((t, i))
        self.leads = {g[0] for g in self.places} | set(self.anchors)
        # one alternation of the fingerprints' first words: texts without any are passed over fast
        self.probe = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, self.leads))) + r")(?![^\W_])", re.IGNORECASE)

    @staticmethod
    def _indispensable(words: list[str], names: tuple[str, ...], coverage: float) -> list[int]:
        """Places of which every finding matches one."""
        if names:
            name = min(names, key=lambda x: (words.count(x), -len(x), x))
            return [i for i, word in enumerate(words) if word == name]
        needed = next(m for m in range(len(words) + 1) if m >= coverage * len(words))
        return sorted(range(len(words)), key=lambda i: (words.count(words[i]), -len(words[i]), i))[: len(words) - needed + 1]

    def candidates(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(template, lowest, highest diagonal) of each cluster of hits."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for at, word in enumerate(words):
            if word in self.leads:
                for t, i in self.places.get(tuple(words[at : at + GRAM]), ()):
                    hits.setdefault(t, []).append((at - i, at))
                for t, i in self.anchors.get(word, ()):
                    hits.setdefault(t, []).append((at - i, at))
        for t, found in hits.items():
            found.sort()
            group = [found[0]]
            for hit in found[1:]:
                if hit[0] - group[-1][0] > band(len(self.words[t])):
                    yield t, group[0][0], group[-1][0]
                    group = []
                group.append(hit)
            yield t, group[0][0], group[-1][0]


def align(template: list[str], text: list[str], low: int, high: int) -> tuple[int, list[int]]:
    """(matched, places): most template words matched in order on diagonals low..high.

    Ties prefer fewer text words inside the match.  ``places`` gives the text place of each
    template word, -1 where it is not matched.
    """
    # best[d] = (matched, -skipped text words) of alignments that end on diagonal d
    width = high - low + 1
    worst = (-1, 0)
    best = [(0, 0)] * width
    steps: list[list[int]] = []
    for i, word in enumerate(template):
        now, step = [worst] * width, [0] * width
        for d in range(width):
            j = low + d + i
            # 1: this word is matched at j; 0: it is left out, so the next diagonal is one lower
            if 0 <= j < len(text) and text[j] == word and best[d] != worst:
                now[d], step[d] = (best[d][0] + 1, best[d][1]), 1
            if d + 1 < width and best[d + 1] > now[d]:
                now[d], step[d] = best[d + 1], 2
            if best[d] != worst and (best[d][0], best[d][1]) > now[d]:  # replaced by another word
                now[d], step[d] = best[d], 3
        for d in range(1, width):  # text words between matches move to a higher diagonal
            skipped = (now[d - 1][0], now[d - 1][1] - (now[d - 1][0] > 0))
            if now[d - 1] != worst and skipped > now[d]:
                now[d], step[d] = skipped, 4
        best = now
        steps.append(step)
    d = max(range(width), key=lambda x: best[x])
    matched, places = best[d][0], [-1] * len(template)
    for i in range(len(template) - 1, -1, -1):
        while steps[i][d] == 4:
            d -= 1
        if steps[i][d] == 1:
            places[i] = low + d + i
        elif steps[i][d] == 2:
            d += 1
    return matched, places


def _confirmed(index: Index, tokens: list[tuple[str, int, int]], coverage: float) -> Iterator[dict]:
    """The confirmed templates of one slice of a text."""
    words = [w for w, _, _ in tokens]
    for t, low, high in index.candidates(words):
        template, pattern = index.templates[t], index.words[t]
        spread = band(len(pattern))
        for at in range(low, high + 1, spread):  # long clusters are aligned band by band
            near = set(words[max(0, at - spread) : max(0, min(high, at + spread) + spread + len(pattern))])
            if sum(x in near for x in pattern) < coverage * len(pattern):
                continue
            matched, places = align(pattern, words, at - spread, min(high, at + spread) + spread)
            used = [p for p in places if p >= 0]
            if matched < coverage * len(pattern) or not used:
                continue
            if not set(template.names) <= {words[p] for p in used} or not set(template.refused).isdisjoint(words[used[0] : used[-1] + 1]):
                continue
            yield {
                "license": template.license, "template": template.name, "coverage": matched / len(pattern), "matched": matched,
                "words": len(pattern), "first_char": tokens[used[0]][1], "last_char": tokens[used[-1]][2] - 1,
            }


def scan(text: str | None, index: Index, coverage: float = COVERAGE) -> list[dict]:
    """The findings in one text, without overlaps."""
    if not text:
        return []
    found: dict[tuple, dict] = {}
    longest = max(len(t.text) for t in index.templates)
    overlap = min(CHUNK // 2, 4 * longest)
    at = 0
    while True:
        part = text[at : at + CHUNK]
        if index.probe.search(part):
            for x in _confirmed(index, words_of(part), coverage):
                x |= {"first_char": x["first_char"] + at, "last_char": x["last_char"] + at}
                found[x["template"], x["first_char"], x["last_char"]] = x
        if at + CHUNK >= len(text):
            break
        at += CHUNK - overlap
    return clear_of_each_other(list(found.values()))


def clear_of_each_other(found: list[dict]) -> list[dict]:
    """The findings without overlaps that match the most words together, then those of the best coverage and the first names."""
    found = sorted(found, key=lambda x: (x["last_char"], x["first_char"], x["template"]))
    ends = [x["last_char"] for x in found]
    # best[k]: the best choice among the first k findings, and the place of its last one
    best: list[tuple[int, float]] = [(0, 0.0)]
    taken: list[tuple[bool, int]] = []
    for k, x in enumerate(found):
        before = bisect.bisect_left(ends, x["first_char"], 0, k)
        words, coverage = best[before]
        own = (words + x["matched"], round(coverage + x["coverage"], 9))
        taken.append((own > best[k], before))
        best.append(max(own, best[k]))
    kept, k = [], len(found)
    while k:
        take, before = taken[k - 1]
        if take:
            kept.append(found[k - 1])
        k = before if take else k - 1
    return kept[::-1]


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE
) -> DataFrame:
    """Rows (id, license, template, coverage, matched, words, first_char, last_char).

    A template is found where at least ``coverage`` of its words, its names among them, are
    matched in order and no refused word stands between; spans are in characters from 0, both
    ends included.  Of overlapping spans those stay that match the most words together.  Whole texts are scanned.  Null
    and empty texts hold nothing; repeated rows are reported as often as they were given and
    null ids are passed on.  An empty table gives an empty result; other columns are ignored.
    """
    import pandas as pd

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(templates, coverage)
        for texts in batches:
            yield pd.Series([scan(x, index, coverage) for x in texts.tolist()])

    column = F.pandas_udf(scanned, f"array<{FOUND}>", F.PandasUDFType.SCALAR_ITER)
    return docs.select(F.col(id_col).alias("id"), column(F.col(text_col).cast("string")).alias("held")).select("id", F.inline("held"))
