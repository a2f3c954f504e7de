"""License scans: matching statistics against a generalised suffix automaton of licence tokens.

The automaton holds every word sequence that occurs in some template. A text's words are streamed through it once:
after each word, the state and length describe the longest suffix of what was read that occurs in a template
(the matching statistics). Phrases are templates too: an occurrence ends where the state, or a suffix of it, is the
phrase's. Runs of long matches are chained, in order in text and template, into covered template spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import ship, slices

#: Words of lower-cased UTF-8: ASCII letters and digits and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases and their labels (fixed values of the query's contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Publicly known licence grants, headers and notices, by label (fixed values).
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License",
        "Licensed under the MIT License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "all-rights-reserved": ["All rights reserved"],
}


def words(text: str | bytes) -> list[bytes]:
    return WORD.findall((text.encode() if isinstance(text, str) else text).lower())


@dataclass
class Automaton:
    """Generalised suffix automaton over word ids, with the places of each state's words in the templates."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[set] = field(default_factory=lambda: [set()])
    templates: list[tuple[str, int]] = field(default_factory=list)

    def _state(self, size: int, step: dict, link: int) -> int:
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the words that reach it through p only."""
        copy = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return new

    def add(self, label: str, text: str) -> int:
        """Adds a template; returns its number."""
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
        k, last, self_states = len(self.templates), 0, []
        self.templates.append((label, len(ids)))
        for c in ids:
            last = self._extend(last, c)
            self_states.append(last)
        self._pending = getattr(self, "_pending", [])
        self._pending.append((k, ids))
        return k

    def finish(self) -> None:
        """Gives each state all (template, end) places of its words."""
        for k, ids in self._pending:
            v = 0
            for e, c in enumerate(ids, 1):
                v = self.step[v][c]
                u = v
                while u > 0 and (k, e) not in self.ends[u]:
                    self.ends[u].add((k, e))
                    u = self.link[u]
        self._pending = []


class Scanner:
    """Scans texts for phrases and for spans of templates.

    least: words of the shortest long match; gap: words that may lie between two chained matches in text or template;
    coverage: share of a template that has to be covered for its label.
    """

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], least: int = 3, gap: int = 8, coverage: float = 0.8):
        self.least, self.gap, self.coverage = least, gap, coverage
        self.automaton = a = Automaton()
        self.phrase_of = {}
        for text, label in phrases.items():
            self.phrase_of[a.add(label, text)] = (label, len(words(text)))
        for label, texts in templates.items():
            for t in texts:
                a.add(label, t)
        a.finish()
        self.found = [()] * len(a.size)  # phrases that are suffixes of a state's words, with their lengths
        for v in sorted(range(1, len(a.size)), key=a.size.__getitem__):
            own = [(label, n) for k, (label, n) in self.phrase_of.items() if (k, n) in a.ends[v] and a.size[a.link[v]] < n <= a.size[v]]
            self.found[v] = (*self.found[a.link[v]], *own)

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[str, int, int, float]]]:
        """Phrase places (start, words, label) and covered spans (label, first word, last word, coverage)."""
        a = self.automaton
        step, link, size, found = a.step, a.link, a.size, self.found
        ids = list(map(a.vocabulary.get, tokens))
        places, long = [], []
        i, n = 0, len(ids)
        while i < n:
            if ids[i] is None:
                i += 1
                continue
            v = length = 0
            while True:  # one run of licence words
                c = ids[i] if i < n else None
                if c not in step[v]:  # the match that ends before word i cannot be prolonged
                    if length >= self.least:
                        long.append((i - length, i, v))
                    while v > 0 and c not in step[v]:
                        v = link[v]
                        length = size[v]
                    if c is None or c not in step[v]:
                        break
                v = step[v][c]
                length += 1
                i += 1
                for label, m in found[v]:
                    if m <= length:
                        places.append((i - m, m, label))
            i += 1
        return places, self._chain(long)

    def _chain(self, long: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains long matches for each template in both orders; spans of chains that cover enough, the best first.

        A chain is a span unless it overlaps one of the same template that covers more.
        """
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for s, e, v in long:
            for k, end in self.automaton.ends[v]:
                if k not in self.phrase_of:
                    by.setdefault(k, []).append((s, e, end - (e - s), end))
        out = []
        for k, found in by.items():
            label, n = self.automaton.templates[k]
            chains: list[list[int]] = []  # text start, text end, template end, covered words
            for s, e, ts, te in sorted(found):
                best = None
                for c in reversed(chains):
                    if s - c[1] > self.gap:  # matches are longest ones, so those before ended no later
                        break
                    if s >= c[1] and -1 < ts - c[2] <= self.gap and (best is None or c[3] >= best[3]):
                        best = c
                chains.append([best[0] if best else s, e, te, (best[3] if best else 0) + e - s])
            kept: list[tuple[int, int]] = []  # places of this template, which don't overlap
            for s, e, _, covered in sorted(chains, key=lambda c: (-c[3], c[1] - c[0], c[0])):
                if covered < self.coverage * n:
                    break
                at = bisect_left(kept, (e, e))
                if at and kept[at - 1][1] > s:
                    continue
                kept.insert(at, (s, e))
                out.append((label, s, e - 1, min(1.0, covered / n)))
        return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))


SPAN = "array<struct<label string, first_word long, last_word long, coverage double>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}"


def scan(spark: SparkSession, docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, **options) -> DataFrame:
    """Licences in each row's whole text; every row gives one row, repeated rows too.

    n_base counts all places of phrases; first_word and last_word are the smallest and largest start (null: none).
    labels are the phrases' and those of covered templates; spans are the covered template spans; score is the largest
    coverage, 1 where a phrase stands. A null or empty text has no words, labels "" and score 0. Only doc_id and text
    are read. The templates are few and fixed, so the automaton travels with the tasks.
    """
    ship(spark)

    def run(batches):
        scanner = Scanner(phrases, templates, **options)
        for batch in (x for whole in batches for x in slices(whole, "text")):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words(text.as_py() or b"")
                places, spans = scanner.scan(tokens)
                starts = [p[0] for p in places]
                base = {p[2] for p in places}
                rows.append(
                    {
                        "doc_id": doc,
                        "n_words": len(tokens),
                        "n_base": len(places),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {s[0] for s in spans})),
                        "score": 1.0 if places else max((s[3] for s in spans), default=0.0),
                        "spans": [dict(zip(("label", "first_word", "last_word", "coverage"), s)) for s in spans],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ARROW = to_arrow_schema(_parse_datatype_string(SCHEMA))
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
