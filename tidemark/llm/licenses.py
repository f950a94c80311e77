"""Operator 3: licence scans by matching statistics over a generalised suffix automaton.

The automaton holds all factors of all template word sequences. A document is streamed
through it word by word; the state and its length are the matching statistics: at every
word the longest suffix read so far that occurs in any template. Occurrences of whole
short templates (phrases) are read off the automaton's suffix links; long matches are
chained in template order, over gaps, into spans, and a template is reported where the
chain covers enough of it. Memory: the automaton (at most twice the template words) and
one slice of text. There is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, slices, string_hash, utf8_text, word_bounds

# Base phrases and their labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Opening passages of public licence notices, as lower-case words.
TEMPLATES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-sa-notice": "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0",
    "cc-by-nc-notice": "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means",
}

# Whole texts of short public licences, and the notices that longer ones ask for.
TEXTS = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
        OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-3-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
        ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
        this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
        benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
        act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "boost-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
        the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
        whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor.""",
    "apache-2-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "gpl-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
        of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "lgpl-text": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
        You should have received a copy of the GNU Lesser General Public License along with this library.""",
    "agpl-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
        You should have received a copy of the GNU Affero General Public License along with this program.""",
    "mpl-2-text": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "epl-2-text": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "cc0-text": """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or
        neighboring rights to this work.""",
}
TEMPLATES |= {name: " ".join(re.findall(r"[0-9a-z]+", text.lower())) for name, text in TEXTS.items()}

#: Words of a match that takes part in a chain; words between chained matches; share of a template covered.
LEAST_MATCH, LEAST_SHARE, MOST_GAP = 6, 0.3, 12
#: Share of a whole text (those of ``TEXTS``) that is covered.
TEXT_SHARE = 0.4
COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = True
WORD[0x61:0x7B] = True
WORD[0x80:] = True


class Automaton:
    """Generalised suffix automaton of word-number sequences.

    ``occurs[state]``: (sequence, end) of the state's words; ``whole[state]``: the phrase
    sequences that are suffixes of the state's longest string."""

    def __init__(self, sequences: list[list[int]], n_phrases: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.occurs: list[set[tuple[int, int]]] = [set()]
        ends = []
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.occurs[last].add((k, i + 1))
            ends.append(last)
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.occurs[self.link[s]] |= self.occurs[s]
        own: dict[int, list[int]] = {}
        for k in range(n_phrases):
            s, n = ends[k], len(sequences[k])
            while self.length[self.link[s]] >= n:
                s = self.link[s]
            own.setdefault(s, []).append(k)
        self.whole: list[tuple[int, ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.whole[s] = self.whole[self.link[s]] + tuple(own.get(s, ()))

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.occurs.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state reached from p by w, with no string longer than p's plus w."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # already a factor of an earlier sequence
            return self._split(last, self.next[last][w], w)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            self.link[cur] = self._split(p, self.next[p][w], w)
        return cur


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.labels = [*phrases, *templates]
        texts = [t.split() for t in [*phrases.values(), *templates.values()]]
        self.sizes = [len(t) for t in texts]
        self.least_share = [TEXT_SHARE if x in TEXTS else LEAST_SHARE for x in self.labels]
        self.n_phrases = len(phrases)
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        data = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
        size = np.array([len(w.encode()) for w in vocabulary])
        start = np.cumsum(size + 1) - size - 1
        hashes = string_hash(data, start, start + size)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.automaton = Automaton([[number[w] for w in t] for t in texts], self.n_phrases)
        self.least = min([LEAST_MATCH, *self.sizes])

    def word_numbers(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], -1)

    def stream(self, words: list[int], at: int, base: list[tuple[int, int]], found: list[tuple[int, int, int, int]]) -> None:
        """Adds (start, phrase) of whole phrases and (template, template end, text end,
        length) of maximal long matches in a run of template words."""
        a = self.automaton
        nxt, link, length, whole, n_phrases = a.next, a.link, a.length, a.whole, self.n_phrases
        state = size = 0
        for i, w in enumerate(words, at + 1):
            if size >= LEAST_MATCH and w not in nxt[state]:
                found += [(k, e, i - 1, size) for k, e in a.occurs[state] if k >= n_phrases]
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
                for k in whole[state]:
                    if self.sizes[k] <= size:
                        base.append((i - self.sizes[k], k))
        if size >= LEAST_MATCH:
            found += [(k, e, at + len(words), size) for k, e in a.occurs[state] if k >= n_phrases]

    def chain(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, covered share) of the chains that cover enough."""
        out = []
        open_: dict[int, list[int]] = {}  # template: start, text end, template end, covered

        def close(k: int) -> None:
            start, end, _, covered = open_.pop(k)
            if covered / self.sizes[k] >= self.least_share[k]:
                out.append((k, start, end, covered / self.sizes[k]))

        for k, e, i, n in sorted(found, key=lambda x: (x[2], x[1])):
            c = open_.get(k)
            if c and e > c[2] and i > c[1] and i - n - c[1] <= MOST_GAP:
                new = min(n, e - c[2], i - c[1])
                open_[k] = [c[0], i, e, c[3] + new]
            elif not c or n > c[3] or i - n - c[1] > MOST_GAP:
                if c:
                    close(k)
                open_[k] = [i - n, i, e, n]
        for k in list(open_):
            close(k)
        return out

    def scan(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batch):
            low = lower_ascii(data)
            s, e, row = word_bounds(WORD[low], offs)
            n = rows.num_rows
            first = np.searchsorted(row, np.arange(n + 1), "left")
            number = self.word_numbers(string_hash(low, s, e)) if len(s) else np.zeros(0, np.int64)
            known = number >= 0
            cut = np.ones(len(number) + 1, bool)
            cut[1:-1] = (row[1:] != row[:-1]) | (known[1:] != known[:-1])
            at = np.flatnonzero(cut)
            long = np.flatnonzero((at[1:] - at[:-1] >= self.least) & known[at[:-1]]) if len(number) else []
            base: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
            for r in long:
                i, j = int(at[r]), int(at[r + 1])
                d = int(row[i])
                self.stream(number[i:j].tolist(), i - int(first[d]), base[d], found[d])
            cols: list[list] = [[] for _ in range(7)]
            for b, f in zip(base, found, strict=True):
                spans = [(x[1], x[2], x[0], x[3]) for x in self.chain(f)] if f else []
                spans += [(x, x + self.sizes[k], k, 1.0) for x, k in b]
                starts = [x for x, _ in b]
                own = {self.labels[k] for _, k in b}
                for c, v in zip(cols, (len(b), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {self.labels[x[2]] for x in spans})), max((min(1.0, x[3]) for x in spans), default=0.0), ",".join(f"{self.labels[k]}:{i}:{j}" for i, j, k, _ in sorted(spans))), strict=True):
                    c.append(v)
            longs, strings = pa.int64(), pa.string()
            yield pa.record_batch(
                [rows.column(0), pa.array(first[1:] - first[:-1]), pa.array(cols[0], longs), pa.array(cols[1], longs), pa.array(cols[2], longs), pa.array(cols[3], strings), pa.array(cols[4], strings), pa.array(cols[5], pa.float64()), pa.array(cols[6], strings)],
                names=[c.split()[0] for c in COLUMNS.split(", ")],
            )


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: number of words, places of the phrases
    (all of them; smallest and largest start, words from 0, null if none), labels of the
    phrases and of all that was found (distinct, sorted, comma-joined), ``score`` (largest
    covered share of a template; 1 for a whole phrase, 0 for nothing) and ``spans``
    (label:start:end in words).

    Words are runs of digits, a-z (after lower-casing A-Z) and all beyond ASCII. Null and
    empty texts have no words and empty labels; repeated rows are reported once per row;
    other columns are not read. Words are compared by a 64-bit hash."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    made: list[Scanner] = []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Scanner(phrases, templates))
        for batch in batches:
            yield from made[0].scan(batch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8_text()).mapInArrow(scan, COLUMNS)
