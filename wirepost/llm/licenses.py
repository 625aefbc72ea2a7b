"""License scans: a generalised suffix automaton of template tokens, matching statistics of each text, chained template spans."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, byte_values, doc_id, keyed

#: Phrases whose mere mention labels a text.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Paragraphs of public licences and their usual notices, by the label that each gives. MIT, BSD, ISC, zlib and
#: Boost stand whole, of the Unlicense there is the grant, of the longer ones the notices that files carry.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Licensed under the GNU General Public License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Licensed under the MIT License",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "proprietary": [
        "All rights reserved. No part of this work may be reproduced without permission",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
}
#: Separators become spaces, A-Z lower case; all other bytes stay, so words hold ASCII letters, digits and non-ASCII bytes.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton of token sequences: one pass over a text gives, at each word, the longest template substring that ends there."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        texts = [(label, words_of(t.encode())) for label, ts in sorted(templates.items()) for t in ts]
        base = [(label, words_of(p.encode())) for p, label in sorted(phrases.items())]
        self.labels = [label for label, _ in texts]
        self.lengths = [len(ws) for _, ws in texts]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (template, position of the last word)
        for t, (_, ws) in enumerate(texts + base):
            last = 0
            for p, w in enumerate(ws):
                last = self.extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                self.ends[last].add((t, p))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.phrases = [(label, len(ws)) for label, ws in base]
        first = len(texts)
        self.said: list[list[int]] = [[] for _ in self.link]  # phrases that end where a match in this state does, if it is long enough
        for i, (_, ws) in enumerate(base):
            at = 0
            for w in ws:
                at = self.next[at][self.vocabulary[w]]
            self.said[at].append(i)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.said[s] = self.said[s] + self.said[self.link[s]]
        self.ends = [{x for x in e if x[0] < first} for e in self.ends]
        self.tokens = [[self.vocabulary[w] for w in ws] for _, ws in texts]
        #: (template, place of the last word, longest length) of all matches that end where one in this state does.
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in self.link]
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            shorter = self.link[s]
            self.found[s] = [(*x, self.length[s]) for x in sorted(self.ends[s])] + [x for x in self.found[shorter] if x[:2] not in self.ends[s]]

    def extend(self, last: int, c: int) -> int:
        """Append word c after state `last`, also where other templates share it."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self.split(last, q, c)
        made = self.state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p < 0:
            self.link[made] = 0
        else:
            q = self.next[p][c]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self.split(p, q, c)
        return made

    def state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def split(self, p: int, q: int, c: int) -> int:
        copy = self.state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each word."""
        at, n = 0, 0
        for c in tokens:
            while at and c not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if c in self.next[at]:
                at, n = self.next[at][c], n + 1
            yield at, n


class Scanner:
    def __init__(self, least: int, gap: int, share: float) -> None:
        self.a, self.least, self.gap, self.share = Automaton(TEMPLATES, BASE_PHRASES), least, gap, share

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first, last, base labels, labels, score, spans (label, start, end, covered share)."""
        a = self.a
        words = words_of(text)
        ids = np.fromiter(map(a.vocabulary.get, words, _unknown), np.int32, len(words))
        known = np.flatnonzero(ids >= 0)
        base, pieces = [], {}
        if len(known):
            for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):  # an unknown word takes the automaton back to its start
                if len(run) < 2:
                    continue
                seen = list(a.statistics(ids[run].tolist()))
                for i, (state, n) in enumerate(seen):
                    at = int(run[0]) + i
                    base += [(at - a.phrases[p][1] + 1, p) for p in a.said[state] if n >= a.phrases[p][1]]
                    if n < self.least:
                        continue
                    after = int(ids[run[i + 1]]) if i + 1 < len(seen) else -1
                    for t, p, most in a.found[state]:  # each template's longest match that ends here, unless it goes on
                        size = min(n, most)
                        if size >= self.least and (p + 1 == a.lengths[t] or a.tokens[t][p + 1] != after):
                            pieces.setdefault(t, []).append((at - size + 1, at + 1, p - size + 1, p + 1))
        spans = [s[:4] for s in best_of(s for t, ps in sorted(pieces.items()) for s in self.spans(t, ps))]
        base_labels = sorted({a.phrases[p][0] for _, p in base})
        starts = [s for s, _ in base]
        labels = sorted({*base_labels, *(s[0] for s in spans)})
        score = max([s[3] for s in spans], default=0.0)
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), max(score, 1.0 if base else 0.0), spans

    def spans(self, t: int, pieces: list[tuple[int, int, int, int]]) -> list[tuple]:
        """All spans of template t (label, start, end, share, fit): one for each stretch of text that goes through it once. fit is the
        share of covered words in the longer one of template and stretch, so a word that the template doesn't have counts against it.

        A stretch ends where matches are more than `gap` words apart, and where one begins after a chain that is good enough
        and goes back in the template.
        """
        out, chain = [], Chain(self.gap, self.a.lengths[t])
        for piece in sorted(set(pieces), key=lambda x: (x[1], x[0])):
            s, _, ts, _ = piece
            covered, start, end, tend = chain.best
            apart = chain.end > 0 and s - chain.end > self.gap
            back = covered >= self.share * self.a.lengths[t] and s >= end and ts < tend
            if apart or back:
                out.append(chain.best)
                chain = Chain(self.gap, self.a.lengths[t])
            chain.add(piece)
        out.append(chain.best)
        length = self.a.lengths[t]
        return [(self.a.labels[t], start, end, min(1.0, covered / length), min(1.0, covered / max(length, end - start))) for covered, start, end, _ in out if covered >= self.share * length]


def best_of(spans: Iterator[tuple]) -> list[tuple]:
    """The spans (label, start, end, share, fit) less those that share half of themselves or more with a better one of another
    label: one that fits better, or as well over more words. Of licences that differ in a word, the one that has it stays."""
    kept: list[tuple] = []  # by start
    longest = 0
    for s in sorted(spans, key=lambda s: (-s[4], s[1] - s[2], s[1], s[0])):
        worse = False
        for k in kept[bisect_left(kept, (s[1] - longest,)) :]:
            start, end, label, fit = k[0], k[1], k[2], k[3]
            if start >= s[2]:
                break
            better = (fit, end - start) > (s[4], s[2] - s[1])
            worse = worse or (better and label != s[0] and 2 * (min(end, s[2]) - max(start, s[1])) >= min(end - start, s[2] - s[1]))
        if not worse:
            insort(kept, (s[1], s[2], s[0], s[4], s[3]))
            longest = max(longest, s[2] - s[1])
    return [(label, start, end, share, fit) for start, end, label, fit, share in kept]


class Chain:
    """The best chain of matches that go forward in both text and template, at most `gap` words of text apart; grows by one match at a time, by end.

    Of the open chains only those stay that another one with the same place in the template can't replace: a chain that
    ends d words earlier in the text is worth keeping if it covers less by under d words. So there are few, and no cap.
    """

    def __init__(self, gap: int, longest: int) -> None:
        self.gap, self.longest = gap, longest
        self.best: tuple[int, int, int, int] = (0, 0, 0, 0)  # covered words, text start, text end, template end
        self.end = 0
        self.open: dict[int, list[tuple[int, int, int, int]]] = {}

    def add(self, piece: tuple[int, int, int, int]) -> None:
        s, e, ts, te = piece
        if e > self.end:
            self.prune(e)
        tail = (te - ts, s, e, te)
        for covered, start, end, tend in (x for chains in self.open.values() for x in chains):
            cut = max(0, end - s, tend - ts)
            if s - end <= self.gap and cut < e - s and end < e and tend < te:
                tail = max(tail, (covered + te - ts - cut, start, e, te))
        self.open.setdefault(te, []).append(tail)
        self.end = max(self.end, e)
        self.best = max(self.best, tail, key=lambda x: (x[0], -x[1], x[2]))

    def prune(self, e: int) -> None:
        """Forget chains that no match which ends at e or later can go on from, and those that others replace."""
        for place, chains in list(self.open.items()):
            kept: list[tuple[int, int, int, int]] = []
            for x in sorted(chains, key=lambda x: (-x[2], -x[0])):
                if e - self.longest - x[2] <= self.gap and all(x[0] > y[0] - (y[2] - x[2]) for y in kept):
                    kept.append(x)
            self.open[place] = kept
            if not kept:
                del self.open[place]


class _Unknown:
    def __iter__(self):
        return self

    def __next__(self):
        return -1


_unknown = _Unknown()
_scanners: dict[tuple, Scanner] = {}

COLUMNS = "dk long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,share:double>>"


def scan_licenses(docs: DataFrame, least: int = 3, gap: int = 20, share: float = 0.8, block: int = 4_000_000) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of ASCII letters, digits and non-ASCII characters after A-Z are lower-cased. n_base counts all places of
    BASE_PHRASES; first_word and last_word are the smallest and largest start, else null. A template gives its label if a
    chain of matches of at least `least` words, at most `gap` words apart, covers at least `share` of its words; spans lists
    these, each copy of a template its own; of spans that share half of themselves or more the one that fits best stays. score is 1 if there is a base phrase, else the largest covered share of a listed span (0 if none). Null and empty
    texts have no words; labels are then empty strings. Repeated rows and null ids each give a row. One narrow pass.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (least, gap, share) not in _scanners:
            _scanners[least, gap, share] = Scanner(least, gap, share)
        scanner = _scanners[least, gap, share]
        for batch in blocks(batches, "text", block):
            rows = [scanner.scan(t) for t in byte_values(batch.column("text"))]
            cols = list(zip(*rows, strict=True))
            spans = [[{"label": s[0], "start": s[1], "end": s[2], "share": s[3]} for s in x] for x in cols[7]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("dk"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), pa.array(spans, span)], [c.split()[0] for c in COLUMNS.split(", ")])

    out = keyed(docs).mapInArrow(mapped, COLUMNS)
    return out.select(doc_id(), *(F.col(c) for c in out.columns[1:]))
