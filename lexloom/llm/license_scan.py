"""License scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of every template. A text is streamed through it, which gives for each
word the length of the longest run ending there that some template holds (matching statistics). Maximal
runs of at least ``LEAST_RUN`` words are chained per template while they go forward in both text and template; a
chain that covers enough of a template is a covered span and labels the document. Of spans that overlap, those that lie inside
a longer one of another label are dropped, so a text of three clauses is not also one of two.

Most runs of ordinary text occur in no template, so a vectorised look-up of ``LEAST_RUN`` consecutive words finds
the stretches in which a run can lie, and only those are streamed. Short phrases (the base labels)
are places where their words stand consecutively.

Words: A-Z lower-cased, then runs without ASCII characters other than letters and digits.

Defined results: null or empty text has no words, no labels, score 0 and null first and last places; rows are
scanned one by one, whatever their doc_id; a text without white space is one word, however long; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Phrases with their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Public licence texts, the notices their stewards ask for, and their common names, with labels.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""
_CC0 = """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."""
_TEXTS = (
    ("mit", _MIT),
    ("bsd-2-clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("bsd-3-clause", f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_TAIL}"),
    ("isc", _ISC),
    ("apache", _APACHE),
    ("gpl", _GPL.format(3)),
    ("gpl", _GPL.format(2)),
    ("lgpl", _LGPL),
    ("agpl", _AGPL),
    ("mpl", _MPL),
    ("epl", _EPL),
    ("unlicense", _UNLICENSE),
    ("zlib", _ZLIB),
    ("boost", _BOOST),
    ("cc0", _CC0),
)
#: Names that stand alone; at least as many words as a run that counts.
_NAMES = (
    ("mit", "under the MIT License"),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("isc", "under the ISC License"),
    ("apache", "Apache License, Version 2.0"),
    ("apache", "Apache License 2.0"),
    ("gpl", "GNU General Public License, version 3"),
    ("gpl", "GNU General Public License, version 2"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl", "Mozilla Public License, version 2.0"),
    ("epl", "Eclipse Public License 2.0"),
    ("boost", "Boost Software License 1.0"),
    ("cc0", "CC0 1.0 Universal"),
)
#: SPDX identifiers by label, and the terms of Creative Commons licences with their long names.
_SPDX = (("mit", "MIT"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("isc", "ISC"), ("apache", "Apache-2.0"), ("gpl", "GPL-2.0"), ("gpl", "GPL-3.0"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3.0"), ("agpl", "AGPL-3.0"), ("mpl", "MPL-2.0"), ("epl", "EPL-2.0"), ("unlicense", "Unlicense"), ("zlib", "Zlib"), ("boost", "BSL-1.0"), ("cc0", "CC0-1.0"))
_TERMS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))


def _templates() -> tuple[tuple[str, str], ...]:
    """Texts, names, and by rule the identifiers and the Creative Commons names."""
    out = [*_TEXTS, *_NAMES, *((label, f"SPDX-License-Identifier: {x}") for label, x in _SPDX)]
    for short, long in _TERMS:
        label = f"cc-{short.lower()}"
        out += [(label, f"CC {short} 4.0"), (label, f"SPDX-License-Identifier: CC-{short}-4.0"), (label, f"Creative Commons {long} 4.0 International License")]
    return tuple(out)


TEMPLATES = _templates()

#: Words of a run that counts, share of a template that a chain must cover, words that a chain may skip in the text.
#: Templates of up to ``SHORT`` words must be covered whole: in names and identifiers each word tells licences apart.
LEAST_RUN, COVER, SKIP, SHORT = 4, 0.7, 12, 10

_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[48:58] = _WORDLIKE[97:123] = True
_WORDLIKE[128:] = True


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, first word of each text; ``buf`` is lower-cased already."""
    blank = np.where(_WORDLIKE[buf], np.uint8(97), np.uint8(32))
    return C.word_spans(blank, offsets)


def words_of(text: str) -> list[bytes]:
    buf = np.frombuffer(text.encode().translate(C.LOWER_AZ), np.uint8)
    s, e, _ = spans(buf, np.array([0, len(buf)]))
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


class Automaton:
    """Generalised suffix automaton over word numbers. Each state knows one template and end place of its runs."""

    def __init__(self, templates: list[list[int]]):
        self.go, self.link, self.length, self.ends = [{}], [-1], [0], [[]]
        for number, words in enumerate(templates):
            last = 0
            for place, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].append((number, place))
        # a state's runs also end where those of the states that link to it end
        for v in sorted(range(1, len(self.go)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] = sorted({*self.ends[self.link[v]], *self.ends[v]})

    def _new(self, length: int, link: int, go: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.go.append(go)
        self.ends.append([])
        return len(self.go) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the shorter runs that reach it from p and above."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = copy
        while p != -1 and self.go[p].get(w) == q:
            self.go[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if (q := self.go[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.go[p]:
            self.go[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.go[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word: (state, length of the longest known run that ends there)."""
        v, n = 0, 0
        for w in words:
            while v and w not in self.go[v]:
                v = self.link[v]
                n = self.length[v]
            if w in self.go[v]:
                v, n = self.go[v][w], n + 1
            yield v, n


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least_run: int = LEAST_RUN, cover: float = COVER):
        self.labels = [x for x, _ in templates]
        self.least, self.cover = least_run, cover
        texts = [words_of(t) for _, t in templates]
        self.phrases = [(words_of(p), label) for p, label in phrases]
        # what a phrase alone shows: its share of the shortest template of its label
        self.shown = {label: min(1.0, len(p) / max(len(p), min([len(t) for t, name in zip(texts, self.labels, strict=True) if name == label], default=len(p)))) for p, label in self.phrases}
        vocabulary = sorted({w for t in texts for w in t} | {w for p, _ in self.phrases for w in p})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        raw = b" ".join(vocabulary)
        buf = np.frombuffer(raw, np.uint8)
        s, e, _ = spans(buf, np.array([0, len(buf)]))
        hashes = C.span_hashes(buf, s, e)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], (np.arange(len(vocabulary)) + 1)[order].astype(np.int32)
        self.templates = [[number[w] for w in t] for t in texts]
        self.phrases = [(np.array([number[w] for w in p]), label) for p, label in self.phrases]
        self.automaton = Automaton(self.templates)
        self.grams = np.unique(np.concatenate([self._grams(np.array(t, np.int64)) for t in self.templates]))

    def _grams(self, words: np.ndarray) -> np.ndarray:
        """A number for each ``least`` consecutive words."""
        n = max(0, len(words) - self.least + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.least):
                out = out * np.uint64(len(self.numbers) + 1) + words[j : j + n].astype(np.uint64)
        return out

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known words, 0 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)

    def base(self, words: np.ndarray) -> list[tuple[int, str]]:
        """(start, label) of every place of a phrase."""
        out = []
        for p, label in self.phrases:
            m = len(words) - len(p) + 1
            if m > 0:
                hit = np.ones(m, bool)
                for j, w in enumerate(p):
                    hit &= words[j : j + m] == w
                out += [(int(i), label) for i in np.flatnonzero(hit)]
        return sorted(out)

    def runs(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Maximal known runs: (text start, length, template, template start)."""
        codes, out = self._grams(words), []
        known = self.grams[np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)] == codes
        edges = np.flatnonzero(np.diff(known, prepend=False, append=False)).reshape(-1, 2)
        for a, b in edges.tolist():
            b += self.least - 1
            stats = [*self.automaton.statistics(words[a:b].tolist())]
            for i, (v, n) in enumerate(stats):
                if n >= self.least and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                    out += [(a + i - n + 1, n, t, place - n + 1) for t, place in self.automaton.ends[v]]
        return out

    def covered(self, words: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, share of the template) of each chain that covers enough."""
        by: dict[int, list] = {}
        for start, n, t, place in self.runs(words):
            by.setdefault(t, []).append((start, n, place))
        out = []
        for t, runs in by.items():
            runs.sort()
            chain, done, end = None, 0, 0
            whole = len(self.templates[t])
            for start, n, place in [*runs, (1 << 60, 0, 0)]:
                if chain and start - chain[1] <= SKIP and start + n > chain[1] and place + n > end:
                    fresh = min(n, start + n - chain[1], place + n - end)
                    chain, done, end = (chain[0], start + n), done + fresh, place + n
                    continue
                if chain and done >= (whole if whole <= SHORT else self.cover * whole):
                    out.append((self.labels[t], chain[0], chain[1], min(1.0, done / whole)))
                chain, done, end = (start, start + n), n, place + n
        inside = lambda x, y: x[0] != y[0] and y[1] <= x[1] and x[2] <= y[2] and ((y[1], y[2]) != (x[1], x[2]) or y[3] > x[3])
        return sorted(x for x in out if not any(inside(x, y) for y in out))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])))])
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double>>"


def _scan(templates, phrases, least_run, cover):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, least_run, cover)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for first, _end, data, offsets in C.text_groups(batch):
                buf = np.frombuffer(data.translate(C.LOWER_AZ), np.uint8)
                starts, ends, at = spans(buf, offsets)
                words = scanner.numbered(C.span_hashes(buf, starts, ends))
                for i in range(len(at) - 1):
                    own = words[at[i] : at[i + 1]]
                    base, found = scanner.base(own), scanner.covered(own)
                    names = sorted({x for _, x in base})
                    every = sorted({*names, *(x[0] for x in found)})
                    score = max([0.0, *(x[3] for x in found), *(scanner.shown[x] for x in names)])
                    out.append((ids[first + i], len(own), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(names), ",".join(every), score, [dict(zip(("label", "start", "end", "cover"), x, strict=True)) for x in found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    return rows


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, least_run: int = LEAST_RUN, cover: float = COVER) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): words, base places, labels, score and covered spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(templates, phrases, least_run, cover), RESULT)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(C.table(spark, sf_dir, "documents")).drop("spans")
