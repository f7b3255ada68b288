"""License scans by patience alignment.

A text and a license template are compared as words. Where a copy lies is found from anchors, the words that occur once
in the template: every place of an anchor word in the text is a (place, offset) pair, and chains of pairs that rise in
both are scored, a chain word counting for the words of the template that it stands for and each text word passed
costing a share of one. The best chain bounds one copy, however many the text holds. Inside it text and template are
aligned: words that occur once in both are anchors, the longest run of anchors in the same order in both is kept, and the
gaps between them are aligned in the same way, after equal words at their ends; a gap without anchors is aligned by its
longest common subsequence. Words before the first and after the last anchor join as long as each aligned word pays for
two passed ones. The coverage is the share of the template's words that are aligned.

Two rounds look for copies: one in which passed words cost much, so that neighbouring copies which each lack some words
are not mixed, and for what is left one in which they cost little, so that words inserted in a copy do not break it.
A finding of a short notice spans ``SPREAD`` times its words at most; others are bounded by their alignment alone. What is left beside a finding is looked at again, until
no rest has enough of the template's words. Of overlapping findings the one with the most aligned words stays.

Templates are the notices below, and any further texts of a folder (``more_templates``), such as whole licenses.

Defined results: a null text is the empty text, which has no findings; findings are ordered by start, then license;
repeated rows are each answered; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm._common import prepare, table, text_or_empty

COVERAGE = 0.8
#: What passing a word of the text costs a chain, in words of the template: in the first round and in the second.
COSTS = (0.25, 0.1)
#: What passing one costs beyond the ends of a chain.
END_COST = 0.5
#: A notice of fewer than ``SHORT`` words spans at most ``SPREAD`` times as many: a few common words that stand further apart are no notice.
SHORT, SPREAD = 20, 3

# Published license notices and texts.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Frequent English words, which choose no stretch.
COMMON = frozenset("a all an and any are as at be but by can for from has have if in into is it its not of on one or out that the their this to use was will with you your".split())
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return [m.group().lower() for m in WORD.finditer(text)]


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k:
            back[i] = ends[k - 1]
        tops[k : k + 1] = [v]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(text: list[str], a: int, b: int, template: list[str], c: int, d: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two ranges, as the longest increasing run of all their equal pairs."""
    at: dict[str, list[int]] = {}
    for j in range(d - 1, c - 1, -1):
        at.setdefault(template[j], []).append(j)
    pairs = [(i, j) for i in range(a, b) for j in at.get(text[i], ())]
    return [pairs[k] for k in _increasing([p[1] for p in pairs])]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions, ascending in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(text[a:b], a) if ours[w] == 1 and theirs[w] == 1}
        pairs = [(at[w], j) for j, w in enumerate(template[c:d], c) if w in at]
        anchors = [pairs[i] for i in _increasing([p[0] for p in pairs])]
        if not anchors:
            found += _common(text, a, b, template, c, d)
            continue
        found += anchors
        i, j = a, c
        for x, y in anchors:
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        todo.append((i, b, j, d))
    return sorted(found)


@dataclass
class Template:
    license: str
    words: list[str]
    counts: Counter = field(init=False)
    #: Words of which a text must have one to reach the coverage.
    rare: set[str] = field(init=False)
    #: Offset of each word that occurs once, and the words of the template that each stands for.
    anchors: dict[str, int] = field(init=False)
    worth: float = field(init=False)

    def __post_init__(self) -> None:
        self.counts = Counter(self.words)
        self.anchors = {w: i for i, w in enumerate(self.words) if self.counts[w] == 1}
        self.worth = len(self.words) / max(1, len(self.anchors))
        self.rare, weight = set(), 0
        for w in sorted(self.counts, key=lambda w: (w in COMMON, -len(w), w)):
            if weight > (1 - COVERAGE) * len(self.words) + 1e-9:
                break
            self.rare.add(w)
            weight += self.counts[w]


def more_templates(folder: str) -> list[tuple[str, str]]:
    """(name, text) of every text file of a folder, for ``scan_documents``: whole licenses, whose texts are not copied here."""
    return [(p.stem, p.read_text(encoding="utf-8", errors="replace")) for p in sorted(Path(folder).iterdir()) if p.is_file()]


@lru_cache(maxsize=4)
def _templates(given: tuple[tuple[str, str], ...]) -> tuple[list[Template], list[str], frozenset[str]]:
    made = [Template(name, words_of(text)) for name, text in given]
    made = [t for t in made if t.words]
    return made, sorted(set().union(*(t.rare for t in made)), key=len), frozenset().union(*(t.counts for t in made))


class _Text:
    """Words of a text, and the places of those that some template has."""

    def __init__(self, words: list[str], known: frozenset[str]):
        self.words = words
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in known:
                self.places.setdefault(w, []).append(i)

    def reaches(self, t: Template, a: int, b: int) -> bool:
        """Whether a range has enough of the template's words, in any order."""
        have = 0
        for w, k in t.counts.items():
            p = self.places.get(w)
            if p:
                have += min(k, bisect_left(p, b) - bisect_left(p, a))
        return have >= COVERAGE * len(t.words) - 1e-9

    def pairs(self, t: Template, a: int, b: int) -> list[tuple[int, int]]:
        """(place, offset) of the template's anchors in a range, by place."""
        found = []
        for w, j in t.anchors.items():
            p = self.places.get(w)
            if p:
                found += [(i, j) for i in p[bisect_left(p, a) : bisect_left(p, b)]]
        return sorted(found)


def _chains(pairs: list[tuple[int, int]], worth: float, cost: float) -> Iterator[list[tuple[int, int]]]:
    """Chains of (place, offset) pairs that rise in both, best first, of which no two overlap in the text.

    Each pair adds ``worth``, each place passed costs ``cost``. A tree of running maxima over offsets gives the best
    chain to go on from, so n pairs take n log n steps.
    """
    size = max(j for _, j in pairs) + 2
    tree: list[tuple[float, int]] = [(-math.inf, -1)] * size
    best, back, begin = [], [], []
    for n, (i, j) in enumerate(pairs):
        got, k = (-math.inf, -1), j
        while k > 0:  # offsets below j
            got = max(got, tree[k])
            k -= k & -k
        through, at = got[0] - cost * (i - 1), got[1]
        if through <= 0:
            through, at = 0.0, -1
        best.append(through + worth)
        back.append(at)
        begin.append(i if at < 0 else begin[at])
        mine, k = (best[n] + cost * i, n), j + 1
        while k < size:
            if mine[0] > tree[k][0]:
                tree[k] = mine
            k += k & -k
    used: list[tuple[int, int]] = []  # ranges of the chains given, ascending
    for n in sorted(range(len(pairs)), key=lambda n: (-best[n], n)):
        first, last = begin[n], pairs[n][0]
        at = bisect_left(used, (first, -1))
        if (at and used[at - 1][1] >= first) or (at < len(used) and used[at][0] <= last):
            continue
        used.insert(at, (first, last))
        out = []
        while n >= 0:
            out.append(pairs[n])
            n = back[n]
        yield out[::-1]


def _tail(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of what follows a chain: words join while one aligned pays for two passed ones.

    No aligned word lies further away than twice the template's rest, where even all of it would not pay.
    """
    at: dict[str, list[int]] = {}
    for j, w in enumerate(template):
        at.setdefault(w, []).append(j)
    pairs = [(i, j) for i, w in enumerate(text[: 2 * len(template) + 1]) for j in reversed(at.get(w, ()))]
    # By the offset after the last word: the best score and its pairs, as if read from the text's begin.
    ahead: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])] + [(-math.inf, [])] * len(template)
    best: tuple[float, list[tuple[int, int]]] = (0.0, [])
    for i, j in pairs:
        score, own = max(ahead[: j + 1], key=lambda x: x[0])
        score, own = score - END_COST * i + 1, [*own, (i, j)]
        if score > best[0]:
            best = (score, own)
        if score + END_COST * (i + 1) > ahead[j + 1][0]:
            ahead[j + 1] = (score + END_COST * (i + 1), own)
    return best[1]


def _aligned(x: _Text, chain: list[tuple[int, int]], t: Template, a: int, b: int) -> list[tuple[int, int]]:
    """Aligned positions of the copy that a chain bounds, in the range from a to b, or nothing under the coverage or over the spread."""
    (i, j), (k, m) = chain[0], chain[-1]
    found = [(i + p, j + q) for p, q in align(x.words[i : k + 1], t.words[j : m + 1])]
    reach = 2 * len(t.words) + 1
    left = _tail(x.words[max(a, i - reach) : i][::-1], t.words[:j][::-1])
    right = _tail(x.words[k + 1 : min(b, k + 1 + reach)], t.words[m + 1 :])
    found += [(i - 1 - p, j - 1 - q) for p, q in left] + [(k + 1 + p, m + 1 + q) for p, q in right]
    found.sort()
    near = len(t.words) >= SHORT or found[-1][0] - found[0][0] < SPREAD * len(t.words)
    good = near and len(found) >= COVERAGE * len(t.words) - 1e-9
    return found if good else []


def _copies(x: _Text, t: Template) -> Iterator[tuple[int, int, int]]:
    """(aligned words, first, last) of every copy of the template in a text, none of which overlap."""
    taken: list[tuple[int, int]] = []
    reach = 2 * len(t.words) + 1
    for cost in COSTS:
        todo = _between(taken, 0, len(x.words))
        while todo:
            a, b = todo.pop()
            pairs = x.pairs(t, a, b) if x.reaches(t, a, b) else []
            made: list[tuple[int, int]] = []
            for chain in _chains(pairs, t.worth, cost) if pairs else ():
                left, right = max(a, chain[0][0] - reach), min(b, chain[-1][0] + 1 + reach)
                for first, last in made:  # copies do not overlap
                    left, right = (max(left, last + 1) if first <= chain[0][0] else left), (min(right, first) if last >= chain[-1][0] else right)
                if left <= chain[0][0] and chain[-1][0] < right and x.reaches(t, left, right) and (found := _aligned(x, chain, t, left, right)):
                    made.append((found[0][0], found[-1][0]))
                    yield len(found), *made[-1]
            taken += made
            todo += _between(made, a, b) if made else []


def _between(copies: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """What copies leave of a range."""
    ends = sorted(copies)
    return list(zip([a, *(last + 1 for _, last in ends)], [*(first for first, _ in ends), b], strict=True))


def scan(text: str, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)) -> list[tuple[str, int, int, float]]:
    """(license, start, end, coverage) in code points."""
    known, rare, every = _templates(templates)
    low = text.lower()
    if not any(w in low for w in rare):
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    x = _Text([text[a:b].lower() for a, b in spans], every)
    found = []
    for t in known:
        if not t.rare.isdisjoint(x.places):
            found += [(n, n / len(t.words), t.license, spans[i][0], spans[j][1]) for n, i, j in _copies(x, t)]
    kept: list[tuple[str, int, int, float]] = []
    for _, cover, name, start, end in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        if all(end <= k[1] or start >= k[2] for k in kept):
            kept.append((name, start, end, cover))
    return sorted(kept, key=lambda f: (f[1], f[0]))


FINDING = "array<struct<license:string,start:int,end:int,coverage:double>>"


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, findings) of every row."""
    given = tuple(TEMPLATES if templates is None else templates)
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ("license", "start", "end", "coverage")
    shape = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(names, f, strict=True)) for f in scan(t.as_py(), given)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape)], names=["id", "findings"])

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text")).mapInArrow(run, f"id {kind}, findings {FINDING}")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"))
    shown = F.transform("findings", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], F.format_number(x["coverage"], 3)))
    best = F.coalesce(F.array_max(F.transform("findings", lambda x: x["coverage"])), F.lit(0.0))
    return found.select(F.col("id").alias("doc_id"), F.size("findings").cast("long").alias("n_findings"), best.alias("best_coverage"), F.array_join(shown, ",").alias("findings"))
