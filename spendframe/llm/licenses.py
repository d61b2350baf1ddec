"""License texts and notices in documents, found by winnowed fingerprints and confirmed by banded alignment.

Template fingerprints form an inverted index. A document's own fingerprints look up candidates: templates, and the
diagonals on which they would lie. Short templates are indexed by every single word, and enough of their words close
together make a candidate. Each candidate is aligned word by word within a band around its diagonal,
which gives the share of the template that is matched and the span in the document. The words that tell licenses apart
must be those of the template.
"""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import annotate, encoded, flat, grams, winnow

GRAM, WINDOW = 3, 2
#: Templates of fewer words are short.
SHORT = 20
#: Share of a template's words that must be matched.
COVERAGE = 0.8
MATCH, MISS, GAP = 2, -1, -1

#: Words that tell licenses apart, besides numbers.
NAMES = frozenset("""mit apache bsd isc mozilla mpl gnu gpl lgpl agpl lesser library affero cc cc0 nc sa nd creative commons
    noncommercial sharealike noderivatives noderivs unlicense eclipse boost""".split())

#: Public license notices and statements, by identifier.
TEMPLATES = {
    "Apache-2.0/notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "Apache-2.0/statement": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause/conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "CC-BY-4.0/statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/statement": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "GPL-3.0/statement": "This work is licensed under the GNU General Public License, version 3.",
    "ISC/permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT/permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."),
    "MIT/statement": "Released under the MIT License.",
    "MPL-2.0/notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense/release": "This is free and unencumbered software released into the public domain.",
}
_GPL, _LGPL = TEMPLATES["GPL-3.0/notice"], TEMPLATES["GPL-3.0/notice"].replace("GNU General", "GNU Lesser General")
_CC = TEMPLATES["CC-BY-4.0/statement"]
TEMPLATES |= {
    "AGPL-3.0/notice": _GPL.replace("GNU General", "GNU Affero General"),
    "AGPL-3.0/statement": TEMPLATES["GPL-3.0/statement"].replace("GNU General", "GNU Affero General"),
    "BSD-3-Clause/conditions": TEMPLATES["BSD-2-Clause/conditions"] + (
        " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."),
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/long": _CC.replace("Attribution", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0/long": _CC.replace("Attribution", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-ND-4.0/statement": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0/long": _CC.replace("Attribution", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-SA-4.0/statement": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0/long": _CC.replace("Attribution", "Attribution-NoDerivatives"),
    "CC-BY-ND-4.0/statement": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0/long": _CC.replace("Attribution", "Attribution-ShareAlike"),
    "GPL-2.0/notice": _GPL.replace("version 3", "version 2"),
    "GPL-2.0/statement": TEMPLATES["GPL-3.0/statement"].replace("version 3", "version 2"),
    "LGPL-2.1/notice": _LGPL.replace("version 3", "version 2.1"),
    "LGPL-2.1/statement": TEMPLATES["GPL-3.0/statement"].replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "LGPL-3.0/notice": _LGPL,
    "LGPL-3.0/statement": TEMPLATES["GPL-3.0/statement"].replace("GNU General", "GNU Lesser General"),
}

FIELDS = "n_spans bigint, licenses string, best_coverage double, spans string"

_WORD_BYTES = re.compile(rb"[0-9a-z]+")
_WORD = re.compile(r"[0-9A-Za-z]+")


def words(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased runs of ASCII letters and digits."""
    found = _WORD_BYTES.findall(encoded(text).lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) that winnowing keeps; fewer words than a gram are one gram."""
    own = grams(hashes, min(GRAM, len(hashes))) if len(hashes) else hashes
    at = winnow(own, WINDOW)
    return at, own[at]


def marks(tokens: list[str]) -> list[str]:
    """The words and numbers that tell licenses apart, in order; 2.0 is 2."""
    return [t for t in tokens if t in NAMES or t.isdigit() and t != "0"]


def same_license(template: list[str], found: list[str], short: bool) -> bool:
    """Whether the marks of a span are the template's; between those of a long template other numbers may stand."""
    if short:
        return template == found
    rest = iter(found)
    return all(t in rest for t in template) and [t for t in template if t in NAMES] == [t for t in found if t in NAMES]


class Index:
    """The inverted index: each fingerprint's templates and positions, in order of the hash."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [words(templates[n]) for n in self.names]
        self.marks = [marks([x.lower() for x in _WORD.findall(templates[n])]) for n in self.names]
        self.short = [t for t, w in enumerate(self.words) if 0 < len(w) < SHORT]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *[self.words[t] for t in self.short]]))
        self.has = {t: np.isin(self.vocabulary, self.words[t]) for t in self.short}
        rows = [(h, t, p) for t, w in enumerate(self.words) if len(w) >= SHORT for p, h in zip(*[x.tolist() for x in fingerprints(w)])]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.where = np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)

    def candidates(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, lowest diagonal, highest diagonal) of each group of hits that lie within a band of each other."""
        at, own = fingerprints(hashes)
        low, high = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
        hit = np.flatnonzero(high > low)
        pairs = {(int(t), int(at[i]) - int(p)) for i in hit for t, p in self.where[low[i]:high[i]]}
        out: list[tuple[int, int, int]] = []
        for t, diagonal in sorted(pairs):
            if out and out[-1][0] == t and diagonal - out[-1][2] <= self.band(t) and diagonal - out[-1][1] <= 2 * self.band(t):
                out[-1] = (t, out[-1][1], diagonal)
            else:
                out.append((t, diagonal, diagonal))
        return out

    def places(self, hashes: np.ndarray, least: float) -> list[tuple[int, int]]:
        """(short template, place) where one of its words begins a stretch that holds enough of them."""
        if not len(self.vocabulary):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == hashes)
        out = []
        for t in self.short:
            own, n = hit[self.has[t][at[hit]]], len(self.words[t])
            need = max(1, math.ceil(least * n - 1e-9))
            if len(own) >= need:
                out += [(t, p) for p in own[:len(own) - need + 1][own[need - 1:] - own[:len(own) - need + 1] < n + 2 * self.band(t)].tolist()]
        return out

    def band(self, template: int) -> int:
        return max(2, len(self.words[template]) // 8)


def align(template: list[int], document: list[int], low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment on the diagonals low to high (document minus template)."""
    best, nothing = (0, 0, 0, 0), (0, -1, 0)
    row = {}
    for i, word in enumerate(template):
        above, row = row, {}
        for j in range(max(0, i + low), min(len(document), i + high + 1)):
            score, start, matched = above.get(j - 1, nothing)
            start = j if start < 0 else start
            same = document[j] == word
            cell = (score + (MATCH if same else MISS), start, matched + same)
            for other in (above.get(j, nothing), row.get(j - 1, nothing)):
                if other[0] + GAP > cell[0]:
                    cell = (other[0] + GAP, other[1], other[2])
            if cell[0] <= 0:
                continue
            row[j] = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[2], cell[1], j + 1)
    return best[1:]


def matches(text: str | None, index: Index, least: float = COVERAGE) -> list[tuple[str, int, int, float]]:
    """(identifier, start, end, coverage) in code points, in order. Of spans that overlap, the one with more words stays."""
    hashes = words(text)
    found = index.candidates(hashes) if len(hashes) else []
    short = index.places(hashes, least) if len(hashes) else []
    if not found and not short:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    # (template, first and end of the words to look at, lowest and highest diagonal in them)
    tried = [(t, p, p + len(index.words[t]) + 2 * index.band(t), 1 - len(index.words[t]), len(index.words[t]) + 2 * index.band(t)) for t, p in short]
    for t, low, high in found:
        band = index.band(t)
        first = max(0, low - band)
        tried.append((t, first, high + len(index.words[t]) + band, low - band - first, high + band - first))
    out = []
    for t, first, stop, low, high in tried:
        template = index.words[t].tolist()
        matched, start, end = align(template, hashes[first:stop].tolist(), low, high)
        if matched < least * len(template) or not matched:
            continue
        own = marks([text[a:b].lower() for a, b in places[first + start:first + end]])
        end_at = places[first + end - 1][1]
        # A version that goes on behind the span is another one, unless it goes on with .0.
        longer = len(template) < SHORT and text[end_at - 1].isdigit() and re.match(r"\.(?!0+(?![0-9]))[0-9]", text[end_at:end_at + 9])
        if same_license(index.marks[t], own, len(template) < SHORT) and not longer:
            out.append((matched, index.names[t], places[first + start][0], end_at, matched / len(template)))
    kept: list[tuple[str, int, int, float]] = []
    for _, *m in sorted(set(out), key=lambda m: (-m[0], -m[4], m[2], m[1])):
        at = bisect.bisect(kept, m[1], key=lambda k: k[1])
        if (at == 0 or kept[at - 1][2] <= m[1]) and (at == len(kept) or kept[at][1] >= m[2]):
            kept.insert(at, tuple(m))
    return kept


def find(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, least: float = COVERAGE, name: str = "found") -> DataFrame:
    """All of `docs` with a struct `name`: number of spans, identifiers, best coverage, and spans as text.

    Whole texts, one pass, no shuffle; the templates are a list in the caller's hands and go to the tasks with the code. A
    null, empty or wordless text has no spans, coverage 0. Repeated rows get equal results, other columns pass.
    """
    made: dict[str, Index] = {}
    chosen = TEMPLATES if templates is None else templates

    def compute(texts):
        if not made:
            made["it"] = Index(chosen)
        for body in texts:
            found = matches(body, made["it"], least)
            yield (len(found), ",".join(sorted({m[0] for m in found})), max((m[3] for m in found), default=0.0),
                   ",".join(f"{n}:{s}:{e}:{c:.3f}" for n, s, e, c in found))

    return annotate(docs, [text], compute, FIELDS, name)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_spans, licenses, best_coverage, spans."""
    return flat(find(docs.select("doc_id", "text")), "found", "doc_id")
