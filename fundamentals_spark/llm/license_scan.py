"""Licence scan: a generalised suffix automaton over the word sequences of licence templates.

A document streams through the automaton, which gives at every word the longest template substring that ends there
(matching statistics). Long matches are chained, template by template, into covered spans; of templates that share the
words of a span the best covered one gives its label.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm import bytehash

#: Phrases whose words, standing consecutively, give a label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# The texts of short public licences, and the notices that files carry for longer ones, by label.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software
to the public domain."""
#: GNU notices differ in what is licensed, the licence's name and its version.
_GNU = (
    ("gpl-2", "program", "GNU General Public License", "2"), ("gpl-3", "program", "GNU General Public License", "3"), ("lgpl-2.1", "library", "GNU Lesser General Public License", "2.1"),
    ("lgpl-3", "library", "GNU Lesser General Public License", "3"), ("agpl-3", "program", "GNU Affero General Public License", "3"),
)
#: Creative Commons licences by their elements.
_CC = (
    ("cc-by", "Attribution"), ("cc-by-sa", "Attribution-ShareAlike"), ("cc-by-nd", "Attribution-NoDerivatives"), ("cc-by-nc", "Attribution-NonCommercial"), ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
)
TEMPLATES = (
    ("mit", _MIT), ("mit", "Released under the MIT License."), ("bsd-2", f"{_BSD_TOP} {_BSD_END}"), ("bsd-3", f"{_BSD_TOP} {_BSD_NAMES} {_BSD_END}"), ("isc", _ISC), ("apache-2", _APACHE), ("apache-2", "Licensed under the Apache License, Version 2.0."), ("mpl-2", _MPL),
    *(
        (label, f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. "
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.")
        for label, what, name, v in _GNU
    ),
    *((label, f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.") for label, what, name, v in _GNU),
    *((label, f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; version {v} of the License.") for label, what, name, v in _GNU),
    *((label, f"This work is licensed under the {name}, version {v}.") for label, _, name, v in _GNU),
    *((label, f"This work is licensed under a Creative Commons {name} {v} License.") for label, name in _CC for v in ("2.0 Generic", "2.5 Generic", "3.0 Unported", "4.0 International")),
    ("zlib", _ZLIB), ("unlicense", _UNLICENSE),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)
#: Shortest match that takes part in a chain, the gap a chain may step over, and what a chain must cover for a label: this
#: share of its template and this many words (or the whole of a shorter template).
MIN_MATCH, MAX_GAP, MIN_SHARE, MIN_COVER = 5, 6, 0.6, 12
CHUNK = 1 << 20


def _word_bytes() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[65:91] = t[97:123] = True
    t[128:] = True
    return t


_WORD, _LOWER = _word_bytes(), bytehash.lower_table()


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z as a-z, and its row."""
    starts, ends, rows = bytehash.word_spans(buf, offsets, _WORD)
    return bytehash.mix(bytehash.substring_hash(bytehash.prefix_hash(buf, _LOWER), starts, ends)), rows


def _hash_text(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


class SuffixAutomaton:
    """All substrings of several sequences; every state knows where its substrings end, as (sequence, index)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for s, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c, ends)
                ends[last].add((s, i))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                ends[self.link[v]] |= ends[v]
        self.ends = [sorted(e) for e in ends]

    def _state(self, length: int, ends) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int, ends) -> int:
        clone = self._state(self.length[p] + 1, ends)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, ends) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier sequence has this substring
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c, ends)
        new = self._state(self.length[last] + 1, ends)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, ends)
        return new

    def matches(self, words: list[int], least: int):
        """(end index in words, length, state) of maximal matches of at least ``least`` words, streaming once."""
        v, n, out = 0, 0, []
        for i, c in enumerate(words):
            before = (i - 1, n, v)
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            else:
                v = n = 0
            if before[1] >= least and n <= before[1]:
                out.append(before)
        if n >= least:
            out.append((len(words) - 1, n, v))
        return out


def chains(found: list[tuple[int, int, int]], least: int, max_gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """(words covered, first word, end) of chains that cover at least ``least`` words, none over another, the best first.

    A chain is a row of matches (last word in text, length, last word in template) in order in both, with small gaps. Matches
    that neither overlap nor follow one another in a chain, directly or through others, are searched apart.
    """
    rest = sorted(set(found))
    root = list(range(len(rest)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for j, (e, n, t) in enumerate(rest):
        for i in range(j - 1, -1, -1):
            e0, _, t0 = rest[i]
            if e - n - e0 > max_gap:
                break
            if e0 > e - n or (t0 < t and t - n - t0 <= max_gap):
                root[top(i)] = top(j)
    parts = defaultdict(list)
    for j, match in enumerate(rest):
        parts[top(j)].append(match)
    return sorted((c for part in parts.values() for c in _chains(part, least, max_gap)), key=lambda c: (-c[0], c[2]))


def _chains(rest: list[tuple[int, int, int]], least: int, max_gap: int) -> list[tuple[int, int, int]]:
    out = []
    while rest:
        best: list[tuple[int, int]] = []  # covered, and minus the first word: of equal covers the latest start
        for j, (e, n, t) in enumerate(rest):
            b = (n, e - n + 1)
            for i in range(j - 1, -1, -1):
                e0, _, t0 = rest[i]
                if e - n - e0 > max_gap:
                    break  # earlier ones end further back still
                over = max(0, e0 - (e - n), t0 - (t - n))
                if e0 < e and t0 < t and over < n and t - n - t0 <= max_gap:
                    b = max(b, (best[i][0] + n - over, best[i][1]))
            best.append(b)
        j = max(range(len(rest)), key=lambda k: (best[k][0], -rest[k][0]))
        cover, first = best[j]
        if cover < least:
            break
        out.append((cover, first, rest[j][0] + 1))
        rest = [(e, n, t) for e, n, t in rest if e < first or e - n + 1 >= out[-1][2]]
    return out


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))


class Scanner:
    def __init__(self, templates, phrases, min_match: int, min_share: float, min_cover: int):
        self.min_match = min_match
        self.labels = [label for label, _ in templates]
        hashed = [_hash_text(text) for _, text in templates]
        self.vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, dtype=np.uint64)
        self.lengths = [len(h) for h in hashed]
        self.needed = [max(int(np.ceil(min_share * n)), min(n, min_cover)) for n in self.lengths]
        self.automaton = SuffixAutomaton([np.searchsorted(self.vocabulary, h).tolist() for h in hashed])
        self.phrases = [(_hash_text(p), label) for p, label in phrases]

    def known(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def scan(self, buf: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
        h, rows = word_hashes(buf, offsets)
        n = len(offsets) - 1
        first_word = np.searchsorted(rows, np.arange(n + 1))
        n_base = np.zeros(n, dtype=np.int64)
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: list[set[str]] = [set() for _ in range(n)]
        own: list[list[dict]] = [[] for _ in range(n)]
        cover = np.zeros(n)
        for words, label in self.phrases:
            k = len(words)
            if len(h) < k:
                continue
            hit = rows[: len(h) - k + 1] == rows[k - 1 :]
            for i, w in enumerate(words):
                hit &= h[i : len(h) - k + 1 + i] == w
            at = np.flatnonzero(hit)
            r = rows[at]
            np.add.at(n_base, r, 1)
            np.minimum.at(first, r, at - first_word[r])
            np.maximum.at(last, r, at - first_word[r])
            for x in np.unique(r):
                labels[x].add(label)
        # matches lie in runs of template words, so only runs that are long enough stream through the automaton
        ids = self.known(h) if len(self.vocabulary) else np.full(len(h), -1)
        if len(ids):
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | ((ids[1:] < 0) != (ids[:-1] < 0))]))
            stop = np.append(new[1:], len(ids))
            found = defaultdict(list)
            for a, b in zip(new[(ids[new] >= 0) & (stop - new >= self.min_match)], stop[(ids[new] >= 0) & (stop - new >= self.min_match)], strict=True):
                for end, length, state in self.automaton.matches(ids[a:b].tolist(), self.min_match):
                    for t, e in self.automaton.ends[state]:
                        found[(int(rows[a]), t)].append((int(a) + end, length, e))
            spans = defaultdict(list)
            for (r, t), each in found.items():
                for covered, lo, hi in chains(each, self.needed[t]):
                    spans[r].append((-covered, -covered / self.lengths[t], self.labels[t], lo, hi))
            for r, each in spans.items():
                for covered, share, label, lo, hi in sorted(each):  # of templates that claim the same words the best covered one stands
                    lo, hi = lo - int(first_word[r]), hi - int(first_word[r])
                    at = bisect_left(own[r], hi, key=lambda x: x["start"])  # spans lie apart, so only the one before can reach in
                    if at == 0 or own[r][at - 1]["end"] <= lo:
                        own[r].insert(at, {"label": label, "start": lo, "end": hi, "words": -covered})
                        cover[r] = max(cover[r], min(1.0, -share))
        some = n_base > 0
        return {
            "n_words": pa.array(np.diff(first_word)), "n_base": pa.array(n_base), "first_word": pa.array(first, mask=~some), "last_word": pa.array(last, mask=~some),
            "base_labels": pa.array([",".join(sorted(x)) for x in labels], type=pa.string()), "labels": pa.array([",".join(sorted(x | {s["label"] for s in y})) for x, y in zip(labels, own, strict=True)], type=pa.string()),
            "score": pa.array(np.maximum(cover, some.astype(float))), "cover": pa.array(cover), "spans": pa.array(own, type=_SPANS),
        }


_scanners: dict[str, Scanner] = {}


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, min_share: float = MIN_SHARE, min_cover: int = MIN_COVER) -> DataFrame:
    """Per row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, cover, spans.

    n_base counts the places of phrases; first_word and last_word are their smallest and largest start, null without any.
    spans are the parts of the text that chains of matches with a template cover (label, start and end in words, words
    covered): a chain must cover ``min_share`` of its template and ``min_cover`` words or the whole of a shorter template; of
    spans that overlap the best covered one stands. ``labels`` adds their labels. cover is the largest covered share of a
    template among the spans, ``score`` the same, or 1 with a phrase. ``templates`` may be any (label, text) pairs, whole
    licences too. A null text counts as empty; rows are treated alone; an empty table gives an empty one.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = hashlib.sha256(repr((templates, phrases, min_match, min_share, min_cover)).encode()).hexdigest()

    def run(batches):
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner(templates, phrases, min_match, min_share, min_cover)
        scanner = _scanners[key]
        for batch in batches:
            buf, offsets = bytehash.text_buffer(batch.column("text"))
            for i, j in bytehash.row_chunks(offsets, CHUNK):
                cols = {"doc_id": batch.column("doc_id").slice(i, j - i)} | scanner.scan(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, cover double, spans array<struct<label: string, start: long, end: long, words: long>>"
    return source.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
