"""License scan: winnowed fingerprints of the templates in an inverted index pick
candidates, a banded alignment of template and text reports matched coverage and spans.

The templates and their index are a fixed small table that every task holds; documents
are only read, so nothing is shuffled. Words are compared in lower case without the
punctuation around them. Long templates are fingerprinted sparsely, short ones by every
run; of a document every run of `k` words is looked up, so a verbatim template of any
length is met.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import slices
from gaugeworks.llm.words import hash_spans, mix, words_of

K, WINDOW, BAND, COVERAGE = 3, 4, 8, 0.8

_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_NAMES = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_VERSIONS = [("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")]
_CC_NAMES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_LINE_NAMES = {"MIT": "MIT", "ISC": "ISC", "BSD-2-Clause": "BSD 2-Clause", "BSD-3-Clause": "BSD 3-Clause", "Apache-2.0": "Apache 2.0"}
_IDS = ["MIT", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "MPL-2.0", "EPL-2.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", *(f"{f}-{v}-{x}" for f, v in _GNU_VERSIONS for x in ("only", "or-later")), *(f"CC-{x}-4.0" for x in _CC_NAMES)]

#: Grants, warranties, file headers and notices of the common licences, as their publishers
#: word them.
TEMPLATES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": _CONDITIONS,
    "BSD-3-Clause": f"{_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Proprietary": "All rights reserved.",
}
for _f, _v in _GNU_VERSIONS:
    TEMPLATES[f"{_f}-{_v}"] = _GNU.format(_GNU_NAMES[_f], _v.removesuffix(".0"))
    TEMPLATES[f"{_f}-{_v}-line"] = f"This work is licensed under the {_GNU_NAMES[_f]}, version {_v.removesuffix('.0')}."
for _x, _name in _CC_NAMES.items():
    TEMPLATES[f"CC-{_x}-4.0"] = f"Licensed under CC {_x} 4.0."
    TEMPLATES[f"CC-{_x}-4.0-line"] = f"This work is licensed under a Creative Commons {_name} 4.0 International License."
for _id, _name in _LINE_NAMES.items():
    TEMPLATES[f"{_id}-line-released"] = f"Released under the {_name} License."
    TEMPLATES[f"{_id}-line-licensed"] = f"Licensed under the {_name} License."
TEMPLATES["MIT-line"] = TEMPLATES.pop("MIT-line-released")
TEMPLATES |= {f"SPDX-{x}": f"SPDX-License-Identifier: {x}" for x in _IDS}

#: Words that name the licence: a match has all of those that its template has.
NAMING = "MIT ISC BSD 2-Clause 3-Clause Apache MPL Mozilla Eclipse Boost GNU Lesser Affero Creative CC 1 2 2.1 3 1.0 2.0 4.0 " + " ".join([*_CC_NAMES, *_CC_NAMES.values()])
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def bare_words(texts: pa.Array) -> tuple:
    """Words with their outer punctuation taken off (those of nothing else left out): the
    words' places, hashes and rows."""
    w = words_of(texts, lower=True, hashed=False)
    starts, ends = w.starts.copy(), w.ends.copy()
    for edge, step, look in ((starts, 1, 0), (ends, -1, -1)):
        at = np.arange(len(starts))
        while len(at):
            at = at[(starts[at] < ends[at])]
            at = at[_MARK[w.data[edge[at] + look]]]
            edge[at] += step
    some = starts < ends
    starts, ends, doc = starts[some], ends[some], w.doc[some]
    return w, starts, ends, doc, hash_spans(w.data, starts, ends)


class Index:
    """Templates as word hashes, and for each length of run the runs' keys with their
    [(template, place)]. Runs have k words, or all of a shorter template's. Of a template of
    four windows or less every run is in, of a longer one the winnowed runs."""

    def __init__(self, templates: dict[str, str], k: int = K, window: int = WINDOW, naming: str = NAMING):
        self.names = list(templates)
        self.words = [bare_words(pa.array([templates[n]]))[4] for n in self.names]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *self.words]))
        names = bare_words(pa.array([naming]))[4]
        self.named = [set(np.flatnonzero(np.isin(words, names)).tolist()) for words in self.words]
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, words in enumerate(self.words):
            size = min(k, len(words))
            if not size:
                continue
            runs = run_hashes(words, size)
            places = set(range(len(runs))) if len(runs) <= 4 * window else set()
            for i in range(len(runs) - window + 1 if not places else 0):
                places.add(i + window - 1 - int(np.argmin(runs[i : i + window][::-1])))
            for p in sorted(places):
                found[size][int(runs[p])].append((t, p))
        self.keys = {size: np.array(sorted(own), np.uint64) for size, own in found.items()}
        self.places = {size: [own[key] for key in sorted(own)] for size, own in found.items()}


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return h


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Pairs (template place, text place) of the longest common subsequence of words whose
    places differ from `diagonal` by at most `band`; of equally long ones the leftmost."""
    width = 2 * band + 1
    same = []
    for i in range(len(template)):
        j = i + diagonal - band
        own = np.zeros(width, bool)
        low, high = max(0, -j), min(width, len(text) - j)
        if high > low:
            own[low:high] = text[j + low : j + high] == template[i]
        same.append(own.tolist())
    best = [[0] * (width + 1)]  # column d stands for text place i + diagonal - band + d
    for row in same:
        last, now = best[-1], [0] * (width + 1)
        for d in range(width):
            up = last[d + 1]
            left = now[d - 1] if d else 0
            most = max(up, left, last[d])
            if row[d] and last[d] + 1 > most:
                most = last[d] + 1
            now[d] = most
        best.append(now)
    i, d, pairs = len(template), max(range(width), key=lambda d: (best[-1][d], -d)), []
    while i > 0 and d >= 0 and best[i][d]:
        if d and best[i][d] == best[i][d - 1]:
            d -= 1
        elif best[i][d] == best[i - 1][d + 1]:
            i, d = i - 1, d + 1
        elif best[i][d] == best[i - 1][d]:
            i -= 1
        else:
            pairs.append((i - 1, i - 1 + diagonal - band + d))
            i -= 1
    return pairs[::-1]


def _matches(index: Index, words: np.ndarray, hits: set[tuple[int, int]], band: int, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first and last word) from hits (template, diagonal). The match
    of most words comes first, of equal ones that of the greater coverage, then the leftmost;
    the others are aligned again without its words, and none reaches over it."""
    free, kept = np.ones(len(words), bool), []

    def best(t: int, diagonal: int) -> Iterator[tuple]:
        own, low = index.words[t], max(0, diagonal - band)
        x = slice(low, max(low, diagonal + len(own) + band))
        region = np.where(free[x], words[x], np.uint64(0))
        if np.isin(own, region).sum() >= coverage * len(own):
            pairs = align(own, region, diagonal - low, band)
            if pairs and len(pairs) >= coverage * len(own) and index.named[t] <= {i for i, _ in pairs}:
                first, last = low + pairs[0][1], low + pairs[-1][1]
                if free[first : last + 1].all():
                    yield -len(pairs), -len(pairs) / len(own), first, last, t, diagonal

    heap = [x for hit in hits for x in best(*hit)]
    heapify(heap)
    while heap:
        matched, _, first, last, t, diagonal = heappop(heap)
        if free[first : last + 1].all():
            kept.append((t, -matched, first, last))
            free[first : last + 1] = False
        else:
            for x in best(t, diagonal):
                heappush(heap, x)
    return kept


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, template, coverage, start, stop, matched_words): a row for each place where
    at least `coverage` of a template's words align, those that name its licence among them;
    start and stop count code points. Where matches overlap the best is reported. Null, empty and word-less texts, and an empty
    table, have none; rows that repeat are reported as often; other columns are not read."""
    index = Index(templates)
    names = ["doc_id", "template", "coverage", "start", "stop", "matched_words"]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            w, starts, ends, doc, hashes = bare_words(b.column("text"))
            known = np.isin(hashes, index.vocabulary)
            by_doc: dict[int, set[tuple[int, int]]] = defaultdict(set)
            first_of = np.searchsorted(doc, np.arange(b.num_rows + 1))
            for size, keys in index.keys.items():
                n = len(hashes) - size + 1
                if n < 1 or not known.any():
                    continue
                ok = doc[:n] == doc[size - 1 :]
                for j in range(size):
                    ok &= known[j : j + n]
                at = np.flatnonzero(ok)
                runs = np.zeros(len(at), np.uint64)
                for j in range(size):
                    runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + hashes[at + j])
                key = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
                hit = keys[key] == runs
                for i, x in zip(at[hit].tolist(), key[hit].tolist(), strict=True):
                    d = int(doc[i])
                    by_doc[d].update((t, i - int(first_of[d]) - p) for t, p in index.places[size][x])
            for d, hits in by_doc.items():
                first, last = int(first_of[d]), int(first_of[d + 1])
                text = w.data[w.offsets[d] : w.offsets[d + 1]].tobytes()
                for t, matched, a, z in _matches(index, hashes[first:last], hits, band, coverage):
                    start, stop = (len(text[: int(p) - int(w.offsets[d])].decode()) for p in (starts[first + a], ends[first + z]))
                    rows.append((b.column("doc_id")[d].as_py(), index.names[t], matched / len(index.words[t]), start, stop, matched))
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, template string, coverage double, start long, stop long, matched_words long")
