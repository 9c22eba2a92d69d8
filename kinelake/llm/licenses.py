"""Licence scans by a generalised suffix automaton over licence words.

The automaton holds every run of words of all templates, and each state all places where its runs end in them. A text is
streamed through it; the matching statistics give, by the state's suffix links, the longest run of every template that
ends at each word. Runs that cannot be longer are maximal matches, which are chained in order by template. A template
whose chained words cover ``COVERED`` of it labels the text, also if it is part of a longer template; the score is the
largest cover. Phrases are templates that count only whole. Runs under three words can neither make a phrase nor a
match, so only words inside a known three-word run enter the automaton. The collection is a parameter.

Defined cases: null and empty texts have no words, no labels ('') and score 0; invalid UTF-8 is bytes like others; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T

#: fixed values: phrases and labels of the base rule
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: fixed values: public licence texts, their notices and opening passages, and labels
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
    without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
    KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
    ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
    OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
    software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
    IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
    copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
    LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
    ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone
    to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
    misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
    source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""", "zlib"),
    ("""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce,
    display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""", "bsl-1"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
    binary, for any purpose, commercial or non-commercial, and by any means.""", "unlicense"),
)
LEAST, GAP, COVERED = 4, 12, 0.6
_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        heads: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(sequences):
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, w)
                heads[last].append((t, k))
        #: for each state, where its runs end, by sequence: ends of a run are ends of its suffixes
        self.ends: list[dict[int, list[int]]] = [{} for _ in self.size]
        #: for each state, the state of the longest suffix that each sequence has
        self.reach: list[dict[int, int]] = [{} for _ in self.size]
        by_size = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for v in reversed(by_size):
            for t, k in heads.get(v, ()):
                self.ends[v].setdefault(t, []).append(k)
            if self.size[self.link[v]] >= LEAST:
                for t, places in self.ends[v].items():
                    self.ends[self.link[v]].setdefault(t, []).extend(places)
        for v in by_size:
            self.reach[v] = self.reach[self.link[v]] | dict.fromkeys(self.ends[v], v)

    def _state(self, size: int, copy: int | None = None) -> int:
        self.next.append(dict(self.next[copy]) if copy is not None else {})
        self.link.append(self.link[copy] if copy is not None else 0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the run that ends p's longest run with w, cut off from a longer one if need be."""
        q = self.next[p][w]
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = self._state(self.size[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, w)
        return new

    def walk(self, words: list[int]) -> int:
        v = 0
        for w in words:
            v = self.next[v][w]
        return v

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest run ending at each word."""
        v = n = 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.size[v]
            if w in self.next[v]:
                v, n = self.next[v][w], n + 1
            yield v, n

    def runs(self, v: int, n: int) -> dict[int, tuple[int, int]]:
        """For each sequence, the state and length of its longest run that ends here, from ``LEAST`` words on."""
        found = {t: (u, n if u == v else self.size[u]) for t, u in self.reach[v].items()}
        return {t: x for t, x in found.items() if x[1] >= LEAST}


def _words(text: str) -> list[bytes]:
    words = T.Words(pa.array([text]), T.ALNUM_WORDS, hashes=False)
    return [words.word(i) for i in range(len(words.starts))]


@lru_cache(maxsize=4)
def scanner(phrases=PHRASES, templates=TEMPLATES) -> Scanner:
    """Built once for each Python process."""
    return Scanner(phrases, templates)


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases, self.templates = [(_words(p), label) for p, label in phrases], [(_words(t), label) for t, label in templates]
        every = [w for w, _ in self.templates + self.phrases]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for x in every for w in x}))}
        coded = [[self.vocabulary[w] for w in x] for x in every]
        self.automaton = a = Automaton(coded)
        self.ends = defaultdict(list)
        for k, (words, _) in enumerate(self.phrases):
            self.ends[a.walk([self.vocabulary[w] for w in words])].append((k, len(words)))
        for v in sorted(range(1, len(a.size)), key=a.size.__getitem__):
            self.ends[v] = self.ends.get(v, []) + [x for x in self.ends.get(a.link[v], []) if x not in self.ends.get(v, [])]
        self.known = np.unique(np.array([T.sequence_hash(x[i : i + 3]) for x in every for i in range(len(x) - 2)], T._U))

    def scan(self, column):
        """For each text: words, (phrase, start) places, {label: cover}, covered (label, start, end)."""
        words = T.Words(column, T.ALNUM_WORDS)
        at, h = T.ngrams(words, 3)
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        at = at[self.known[k] == h]
        cuts = np.flatnonzero((np.diff(at, prepend=-9) > 1) | (words.doc[at] != words.doc[np.maximum(at - 1, 0)])) if len(at) else []
        places, matches = defaultdict(list), defaultdict(list)
        for c, d in zip(cuts, [*cuts, len(at)][1:], strict=True):
            begin, end = int(at[c]), int(at[d - 1]) + 3
            doc = int(words.doc[begin])
            run = [self.vocabulary.get(words.word(j), -1) for j in range(begin, end)]
            base = begin - int(words.first[doc])
            before: dict[int, tuple[int, int]] = {}
            for i, (v, n) in enumerate([*self.automaton.statistics(run), (0, 0)]):
                for phrase, size in self.ends.get(v, ()):
                    if size <= n:
                        places[doc].append((phrase, base + i + 1 - size))
                now = self.automaton.runs(v, n)
                for t, (u, size) in before.items():
                    if t < len(self.templates) and now.get(t, (0, 0))[1] <= size:  # ended at the word before
                        matches[doc] += [(t, base + i - size, end + 1 - size, size) for end in self.automaton.ends[u][t]]
                before = now
        for d, n in enumerate(words.counts):
            covers, spans = self.chain(matches.get(d, []))
            yield int(n), places.get(d, []), covers, spans

    def chain(self, matches):
        """Best chain of collinear matches for each template: label -> cover, and the spans of those that label."""
        covers: dict[str, float] = {}
        spans = []
        for t in sorted({m[0] for m in matches}):
            own = sorted(m[1:] for m in matches if m[0] == t)
            best: list[tuple[int, int]] = []
            total = len(self.templates[t][0])
            for j, (x, y, n) in enumerate(own):
                score, start = n, x
                for i in range(j - 1, -1, -1):
                    px, py, pn = own[i]
                    if px < x - total - GAP:  # a match is no longer than the template: all others end too early
                        break
                    lap = max(0, px + pn - x, py + pn - y)
                    if px < x and py < y and lap < n and x - px - pn <= GAP and best[i][0] + n - lap > score:
                        score, start = best[i][0] + n - lap, best[i][1]
                best.append((score, start))
                cover = min(1.0, score / total)
                label = self.templates[t][1]
                covers[label] = max(covers.get(label, 0.0), cover)
                if cover >= COVERED:
                    spans.append((label, start, x + n))
        return covers, spans


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Base places, labels, score and covered spans (label:first word:word after the last) for each row."""
    phrases, templates = tuple(phrases), tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scanner(phrases, templates)
        for batch in batches:
            for piece in T.pieces(batch):
                rows = []
                for n, places, covers, spans in known.scan(piece.column(1)):
                    base = sorted({known.phrases[p][1] for p, _ in places})
                    starts = [s for _, s in places]
                    labels = sorted({*base, *(label for label, c in covers.items() if c >= COVERED)})
                    score = 1.0 if base else max(covers.values(), default=0.0)
                    rows.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, ",".join(f"{a}:{b}:{c}" for a, b, c in sorted(set(spans)))))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)
