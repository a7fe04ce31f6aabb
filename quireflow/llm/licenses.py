"""License scan: winnowed fingerprints of license texts in an inverted index pick candidates, banded alignment of the
word sequences measures how much of a license a stretch of text holds, and where.

The index is built from the templates alone, so its size is theirs: the built-in ones below, or those of a table, such as
whole license bodies. Every word trigram of a document is looked up, so a
template's fingerprint that the document shares is always seen; only trigrams of template words can match, which numpy
tells without hashing the rest of the text. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import over_arrow, quoted

#: Words of a fingerprint, fingerprints of a winnowing window, cells to either side of the diagonal.
GRAM, WINDOW, BAND = 3, 3, 12
#: Templates of fewer words are indexed by every trigram: a changed word in a short line could hit its only fingerprint.
SHORT = 12
#: Matched share of a template from which a stretch is reported.
COVERAGE = 0.8
WORD = re.compile("[a-z0-9]+")

#: License texts and notices (fixed values). Words in braces must be matched: they tell the license from its relatives.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version {2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU {Lesser} General Public License as published by the Free Software Foundation; either version {2.1} of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0-notice": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU {Lesser} General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {Affero} General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "CC0-1.0": """To the extent possible under law, the person who associated {CC0} with this work has waived all copyright and related or neighboring rights to this work.""",
    "CC-BY-4.0-notice": """This work is licensed under the Creative Commons {Attribution} {4.0} International License. To view a copy of this license, visit http://creativecommons.org/licenses/{by}/{4.0}/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "MIT:line": "Released under the {MIT} License.",
    "MIT:licensed": "Licensed under the {MIT} License.",
    "Apache-2.0:line": "Licensed under the {Apache} License, Version {2.0}.",
    "GPL-3.0:line": "This work is licensed under the {GNU General} Public License, version {3}.",
    "GPL-2.0:line": "This work is licensed under the {GNU General} Public License, version {2}.",
    "LGPL-3.0:line": "This work is licensed under the GNU {Lesser} General Public License, version {3}.",
    "CC-BY-NC-4.0:line": "Licensed under {CC BY NC 4.0}.",
    "CC-BY-4.0:line": "Licensed under {CC BY 4.0}.",
    "CC-BY-SA-4.0:line": "Licensed under {CC BY SA 4.0}.",
    "MPL-2.0:line": "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}.",
    "BSD:line": "Released under the {BSD} License.",
    "SPDX-MIT": "SPDX-License-Identifier: {MIT}",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: {Apache 2.0}",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: {GPL 3.0}",
}


def tokenised(template: str) -> tuple[list[str], set[int]]:
    """Words of a template, and the positions that must be matched."""
    words, needed = [], set()
    for k, part in enumerate(re.split(r"[{}]", template)):
        found = WORD.findall(part.lower())
        if k % 2:
            needed |= set(range(len(words), len(words) + len(found)))
        words += found
    return words, needed


def winnowed(keys: list[int]) -> list[int]:
    """Positions of the least key of each window, the last of equal ones; all of a sequence shorter than a window give one."""
    if not keys:
        return []
    picked = {}
    for at in range(max(1, len(keys) - WINDOW + 1)):
        window = keys[at : at + WINDOW]
        low = min(window)
        picked[at + max(k for k, x in enumerate(window) if x == low)] = True
    return list(picked)


class Index:
    """Templates as word ids, and trigram -> where the templates hold it as a fingerprint."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.ids: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.needed: list[set[int]] = []
        for text in templates.values():
            words, needed = tokenised(text)
            self.words.append(np.array([self.ids.setdefault(w, len(self.ids)) for w in words], np.int64))
            self.needed.append(needed)
        self.size = max(len(self.ids), 1)
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.words):
            keys = self.keys(ids)
            mixed = [int(k) * 0x9E3779B97F4A7C15 % (1 << 64) for k in keys]
            for p in winnowed(mixed) if len(ids) >= SHORT else range(len(keys)):
                postings[int(keys[p])].append((t, p))
        self.postings = dict(postings)
        self.known = np.array(sorted(postings), np.int64)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """Key of the trigram at each position; -1 where a word is in no template."""
        if len(ids) < GRAM:
            return np.empty(0, np.int64)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        return np.where((a >= 0) & (b >= 0) & (c >= 0), (a * self.size + b) * self.size + c, -1)


def aligned(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> list[tuple[int, int]]:
    """Matched (template, text) positions of the best global-in-template alignment within a band around a diagonal.

    Longest common subsequence with ties towards the diagonal: words between matches may be missing, added or changed.
    """
    n, width = len(template), 2 * band + 1
    score = np.zeros((n + 1, width + 1), np.int32)
    for i in range(1, n + 1):
        js = diagonal + i - 1 + np.arange(-band, band + 1)
        inside = (js >= 0) & (js < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[js[inside]] == template[i - 1]
        stay = score[i - 1, :width] + same  # diagonal move
        skip = score[i - 1, 1 : width + 1]  # template word without a partner
        score[i, :width] = np.maximum.accumulate(np.maximum(stay, skip))
    out, i, k = [], n, int(score[n, :width].argmax())
    while i > 0 and k >= 0:
        here = score[i, k]
        j = diagonal + i - 1 + k - band
        if k > 0 and score[i, k - 1] == here:
            k -= 1
        elif score[i - 1, k + 1] == here and k + 1 < width:
            i, k = i - 1, k + 1
        elif 0 <= j < len(text) and text[j] == template[i - 1] and score[i - 1, k] + 1 == here:
            out.append((i - 1, j))
            i -= 1
        else:
            i -= 1
    return out[::-1]


def matches(ids: np.ndarray, index: Index, coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first text word, end text word) of all stretches that hold enough of a template.

    Hits of a template are chained along diagonals within the band; each chain is aligned once. Of overlapping
    stretches the one with more matched words stays.
    """
    keys = index.keys(ids)
    at = np.flatnonzero(np.isin(keys, index.known)) if len(index.known) else np.empty(0, np.int64)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in at.tolist():
        for t, q in index.postings[int(keys[p])]:
            hits[t].append((p - q, p))
    found = []
    for t, places in hits.items():
        words, needed = index.words[t], index.needed[t]
        places.sort()
        k, band = 0, min(BAND, max(1, len(words) // 3))  # copies one after another are at least a template apart
        while k < len(places):
            first = k
            while k < len(places) and places[k][0] - places[first][0] <= band:
                k += 1
            diagonal = places[(first + k) // 2][0]
            pairs = aligned(words, ids, diagonal, band)
            if len(pairs) >= coverage * len(words) and needed <= {i for i, _ in pairs}:
                found.append((t, len(pairs), pairs[0][1], pairs[-1][1] + 1))
    found.sort(key=lambda m: (-m[1], m[2], m[0]))
    kept: list[tuple[int, int, int, int]] = []
    starts: dict[int, bool] = {}
    for m in found:
        if not any(x in starts for x in range(m[2], m[3])):
            kept.append(m)
            starts.update(dict.fromkeys(range(m[2], m[3]), True))
    return sorted(kept, key=lambda m: m[2])


@functools.lru_cache(maxsize=1)
def default_index() -> Index:
    return Index(TEMPLATES)


def scan_text(text: str, index: Index, coverage: float = COVERAGE) -> list[tuple[str, int, float, int, int]]:
    """(license, matched words, coverage, start, end) in code points of the text."""
    low = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    words = WORD.findall(low)
    get = index.ids.get
    ids = np.array([get(w, -1) for w in words], np.int64)
    found = matches(ids, index, coverage) if len(ids) >= GRAM else []
    if not found:
        return []
    places = [m.span() for m in WORD.finditer(low)]
    return [(index.names[t], n, n / len(index.words[t]), places[a][0], places[b - 1][1]) for t, n, a, b in found]


#: Bytes that a table of templates may have: it is read to the driver and sent to the workers.
MOST_BYTES = 64 << 20


def scan(df: DataFrame, id_col: str, text_col: str, coverage: float = COVERAGE, templates: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, n_matches, licenses (names, comma-joined, in order of place), best_coverage, spans (``license:start:end:matched``).

    templates: a table (name, text) in place of the built-in ones, of MOST_BYTES at most, else an error is raised.
    Null and empty texts have no matches (0, "", 0.0, ""); repeated rows and null ids stay; other columns are not read;
    an empty table gives an empty result.
    """
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, n_matches int, licenses string, best_coverage double, spans string"

    given = None
    if templates is not None:
        name, body = (F.col(quoted(c)) for c in templates.columns[:2])
        rows = templates.select(name, body).where(body.isNotNull())
        size = rows.agg(F.sum(F.octet_length(body))).first()[0] or 0
        if size > MOST_BYTES:
            raise ValueError(f"templates of {size} bytes are beyond {MOST_BYTES}")
        given = df.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in rows.orderBy(name).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = default_index() if given is None else Index(given.value)
        for batch in batches:
            found = [scan_text(t.as_py() or "", index, coverage) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array([",".join(m[0] for m in f) for f in found], pa.string()),
                    pa.array([max((round(m[2], 6) for m in f), default=0.0) for f in found], pa.float64()),
                    pa.array([",".join(f"{m[0]}:{m[3]}:{m[4]}:{m[1]}" for m in f) for f in found], pa.string()),
                ],
                ["doc_id", "n_matches", "licenses", "best_coverage", "spans"],
            )

    return over_arrow(df.select(F.col(quoted(id_col)), F.col(quoted(text_col))), run, schema)
