"""License scans by patience alignment.

A text is aligned with a license template on the words that occur exactly once in either: of those anchors the longest
increasing subsequence is kept, and the gaps between them are aligned in the same way, down to gaps without anchors,
which are compared word by word. Coverage is the share of the template's words that found their place.

A text that lacks too many of a template's telling words to reach the coverage is passed over: the bound is exact, as a
word that is nowhere in the text can't be matched. Only the stretches of a text in which telling words lie close
together are aligned, each by itself, so a license may occur anywhere and several times, and very long texts cost
no more than their length.

Defined cases: a null or empty text has no matches; repeated rows give repeated matches; null ids are carried along; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

COVERAGE = 0.8

# License notices as their licenses word them. The whole texts are in the folder texts.
NOTICES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
        " either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed"
        " in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
        " PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed"
        " in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
        " PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public"
        " License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
        " published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is"
        " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or"
        " FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is"
        " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or"
        " FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def _whole_texts() -> dict[str, str]:
    folder = resources.files(__package__) / "texts"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


TEMPLATES = NOTICES | _whole_texts()
#: Words too common to tell a license from prose.
COMMON = frozenset("a above all and any are as at be by for following in is it may not of on or other see that the this to use with without you".split())

_WORD = re.compile(r"[^\W_]+(?:[-.'/][^\W_]+)*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word in lower case, start, end) for the words of a text."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by the first number, whose second numbers increase."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        place = bisect_left(tails, b)
        before.append(at[place - 1] if place else -1)
        tails[place : place + 1] = [b]
        at[place : place + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _plain(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, by bit rows: bit j of row i is unset where the subsequence of a[: i + 1] and b gets
    longer at b[j]. The rows are kept, a bit for each pair of words, and followed back."""
    where: dict[str, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    rows = []
    for w in a:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        anchors = _increasing([(i, once[w]) for i, w in enumerate(a[a0:a1], a0) if w in once])
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _plain(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, x, j + 1, y) for (i, j), (x, y) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float) -> None:
        self.name, self.coverage = name, coverage
        self.words = [w for w, _, _ in words_of(text)]
        #: Words that tell a license from prose, the longest first, as those are most likely missing.
        self.telling = Counter({w: n for w, n in sorted(Counter(self.words).items(), key=lambda x: (-len(x[0]), x[0])) if w not in COMMON})
        #: So many words, repeats counted, may be missing.
        self.spare = int(len(self.words) * (1 - coverage) + 1e-9)
        #: Of the longest telling words so many that more than the spare ones are missing when none is there.
        self.keys: dict[str, int] = {}
        for w, n in self.telling.items():
            if sum(self.keys.values()) > self.spare:
                break
            self.keys[w] = n
        #: A text that has the others, with something between them, has so many characters at least.
        self.least = sum(sorted(map(len, self.words))[: len(self.words) - self.spare]) + len(self.words) - self.spare - 1

    def possible(self, low: str, present: set[str]) -> bool:
        """Whether a text in lower case may reach the coverage; present: which keys of all templates it has."""
        spare = self.spare
        if len(low) < self.least or sum(n for w, n in self.keys.items() if w not in present) > spare:
            return False
        for w, n in self.telling.items():
            if w not in low:
                spare -= n
                if spare < 0:
                    return False
        return True

    def stretches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Where telling words lie close together; a new stretch begins where a word comes once too often."""
        n, seen, begin, last = len(self.words), Counter(), None, 0
        for i, w in enumerate(words):
            if w in self.telling:
                if begin is not None and (i - last > n or seen[w] >= self.telling[w]):
                    yield max(0, begin - n), min(len(words), last + n)
                    begin = None
                if begin is None:
                    begin, seen = i, Counter()
                seen[w] += 1
                last = i
        if begin is not None:
            yield max(0, begin - n), min(len(words), last + n)

    def matches(self, found: list[tuple[str, int, int]]) -> list[tuple[float, int, int, int]]:
        """(coverage, words matched, start, end), no two overlapping, the best first among those that do."""
        words, all_of_them, free = [w for w, _, _ in found], [], 0
        for a, b in self.stretches(words):
            a = max(a, free)  # a word belongs to one place only
            if sum((self.telling & Counter(words[a:b])).values()) < sum(self.telling.values()) - self.spare:
                continue
            pairs = self._tight(patience(words[a:b], self.words))
            if len(pairs) >= len(self.words) - self.spare:
                free = a + pairs[-1][0] + 1
                all_of_them.append((len(pairs) / len(self.words), len(pairs), found[a + pairs[0][0]][1], found[a + pairs[-1][0]][2]))
        out: list[tuple[float, int, int, int]] = []
        for m in sorted(all_of_them, key=lambda m: (-m[0], m[3] - m[2], m[2])):
            if all(m[3] <= o[2] or m[2] >= o[3] for o in out):
                out.append(m)
        return sorted(out, key=lambda m: m[2])

    def _tight(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Pairs without those at either end that lie further off than the template allows."""
        slack = 2 + self.spare
        while len(pairs) > 1 and pairs[1][0] - pairs[0][0] > pairs[1][1] - pairs[0][1] + slack:
            pairs = pairs[1:]
        while len(pairs) > 1 and pairs[-1][0] - pairs[-2][0] > pairs[-1][1] - pairs[-2][1] + slack:
            pairs = pairs[:-1]
        return pairs


class Scanner:
    """Templates, and one automaton that tells which of their keys a text has."""

    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.templates = [Template(n, t, coverage) for n, t in templates.items()]
        self._automaton = ahocorasick.Automaton()
        for t in self.templates:
            for w in t.keys:
                self._automaton.add_word(w, w)
        self._automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        low = text.lower()
        present = {w for _, w in self._automaton.iter(low)} if len(self._automaton) else set()
        able = [t for t in self.templates if t.possible(low, present)]
        if not able:
            return []
        found = words_of(text)
        return [(t.name, *m) for t in able for m in t.matches(found)]


def matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, words, start, end): the licenses found in docs, a row for each place (code points,
    the end exclusive)."""
    given = dict(TEMPLATES if templates is None else templates)
    schema = "doc_id long, license string, coverage double, words int, start int, end int"
    types = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(given, coverage).scan
        for batch in batches:
            rows = [(batch.column(0)[i].as_py(), *m) for i in range(batch.num_rows) for m in scan(batch.column(1)[i].as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], schema=types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(work, schema)
