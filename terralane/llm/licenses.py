"""License notices in documents, by MinHash bands over overlapping windows (operator 3).

A text's words (runs of letters and digits, lower case) are cut into 5-word shingles, and these into blocks; two neighbouring
blocks are a window, so anything of up to a block's length lies whole in some window.  A template of any length is cut into
equal parts of at most the largest block; if a text holds a share of the template, it holds as large a share of some part.
Windows and parts have ROWS minima each, one per hash order, and every minimum is a band of its own: per order, an index of the
parts' minima gives the parts that a window meets, at a cost that does not grow with the number of templates.

A part is looked for in windows of the least block size that holds it, so of B/2 to B shingles in windows of 2 B.  A window
that holds 0.8 of it has similarity of at least 0.19, as has one that holds half of it where the notice is interrupted, and
meets it in some of 64 bands with probability 1 - 1.4e-6 or more (two windows hold most notices), if the orders are
independent; they are salted and mixed hashes, and missed none of 2,000,000 single windows of four shingles with a one-shingle
template.  A text and a template that meet are verified on the whole text: it must have at least CONTAINED of the template's
shingles.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words

SHINGLE, CONTAINED, ROWS = 5, 0.8, 64
BLOCKS = (2, 4, 8, 16, 32, 64, 128)

# Public license notices and texts, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
}

_ODD = np.arange(1, 2 * ROWS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def shingled(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes in order, bounds by row)."""
    for first, stop in words.row_slices(column):
        data, offsets = words.joined(column.slice(first, stop - first))
        solid = words._CLASS[data] == 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        h = words.hash_spans(words.LOWER[data], starts, ends)
        bounds = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(stop - first), np.diff(bounds))
        run = h[: max(len(h) - SHINGLE + 1, 0)].copy()
        for j in range(1, SHINGLE):
            run = words.pair(run, h[j : len(h) - SHINGLE + 1 + j])
        full = np.arange(len(run)) + SHINGLE <= bounds[row[: len(run)] + 1]
        yield first, run[full], np.searchsorted(row[: len(run)][full], np.arange(stop - first + 1))


def salted(h: np.ndarray, r: int) -> np.ndarray:
    """Hashes in the r-th order."""
    return words.mix((h ^ np.uint64(r)) * _ODD[r])


def read_templates(folder: str) -> dict[str, str]:
    """Templates from the text files of a folder, by file name without its ending."""
    found = {}
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                found[name.removesuffix(".txt")] = f.read()
    return found


class Index:
    """By order, which parts of templates have a minimum: a table of its lowest bits, then the sorted minima."""

    SLOTS = 1 << 14

    def __init__(self, minima: np.ndarray, parts: np.ndarray):
        """``minima`` by part and order."""
        order = np.argsort(minima, axis=0, kind="stable")
        self._minima, self._parts = np.take_along_axis(minima, order, axis=0), parts[order]
        self._slots = np.zeros((minima.shape[1], self.SLOTS), bool)
        for r in range(minima.shape[1]):
            self._slots[r, minima[:, r] & np.uint64(self.SLOTS - 1)] = True

    def meet(self, r: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, part) for equal minima in the r-th order."""
        at = np.flatnonzero(self._slots[r][windows & np.uint64(self.SLOTS - 1)])
        first, last = (np.searchsorted(self._minima[:, r], windows[at], side) for side in ("left", "right"))
        n = last - first
        place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), self._parts[place, r]


class Matcher:
    """Templates' shingle sets, and an index of their parts for each block size."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.sets, parts, of = [], [], []
        for t, text in enumerate(templates.values()):
            h = np.concatenate([x[1] for x in shingled(pa.array([text]))])
            if not len(h):
                raise ValueError(f"a template needs {SHINGLE} words or more: {self.names[t]}")
            self.sets.append(np.unique(h))
            count = -(-len(h) // BLOCKS[-1])
            parts += np.array_split(h, count)
            of += [t] * count
        self._template = np.array(of)
        size = np.array([next(s for s in BLOCKS if s >= len(p)) for p in parts])
        minima = np.array([[salted(p, r).min() for r in range(ROWS)] for p in parts])
        self._index = {int(s): Index(minima[size == s], np.flatnonzero(size == s)) for s in np.unique(size)}

    def scan(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(row, template, first shingle, containment) of verified templates."""
        if not len(h):
            return
        n, sizes = np.diff(bounds), [s for s in BLOCKS if s <= max(self._index)]
        row, last, below = {}, {}, {}
        for size in sizes:
            per_row = -(-n // size)
            first = np.cumsum(per_row) - per_row
            row[size] = np.repeat(np.arange(len(n)), per_row)
            k = np.arange(len(row[size])) - np.repeat(first, per_row)
            last[size] = np.append(row[size][1:] != row[size][:-1], True)
            # A block's minimum is that of its two halves, blocks of the size before.
            below[size] = bounds[row[size]] + k * size if size == sizes[0] else before[row[size]] + 2 * k
            before = first
        met = [np.zeros(0, np.int64)]  # row * templates + template
        for r in range(ROWS):
            low = salted(h, r)
            for size in sizes:
                low = np.minimum.reduceat(low, below[size])
                if size in self._index:
                    window = low.copy()
                    window[:-1] = np.where(last[size][:-1], low[:-1], np.minimum(low[:-1], low[1:]))
                    at, part = self._index[size].meet(r, window)
                    met.append(np.unique(row[size][at] * len(self.names) + self._template[part]))
        for pair in np.unique(np.concatenate(met)).tolist():
            i, t = divmod(pair, len(self.names))
            own = h[bounds[i] : bounds[i + 1]]
            here = np.flatnonzero(np.isin(own, self.sets[t]))
            share = len(np.unique(own[here])) / len(self.sets[t])
            if share >= CONTAINED:
                yield i, t, int(here[0]), share


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document row and license found in its whole text: doc_id, license, first_word, containment.

    containment is the share of the template's shingles that the text has, first_word the place of the first of them.
    Templates have 5 words or more, without an upper bound.  Null and empty texts have none; repeated rows give rows each;
    an empty table gives no rows; other columns are not read.
    """
    chosen = templates or TEMPLATES
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("license", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("containment", T.DoubleType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(chosen)
        for batch in batches:
            for first, h, bounds in shingled(batch.column(1)):
                found = list(matcher.scan(h, bounds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([x[0] + first for x in found], pa.int64())), pa.array([matcher.names[x[1]] for x in found], pa.string())]
                    + [pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.float64())],
                    schema.names,
                )

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, schema)


def oracle_sql() -> str:
    """Exact containment, without retrieval."""
    rows = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in TEMPLATES.items())
    words_of = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    cut = f"unnest(range(0, len(w) - {SHINGLE - 1})) AS i"
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(1, SHINGLE + 1))
    return f"""
WITH t(license, text) AS (VALUES {rows}),
ts AS (SELECT DISTINCT license, {shingle} AS s FROM (SELECT license, w, {cut} FROM (SELECT license, {words_of("text")} AS w FROM t))),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY 1),
ds AS (SELECT r, doc_id, i, {shingle} AS s FROM (SELECT r, doc_id, w, {cut} FROM (SELECT row_number() OVER () AS r, doc_id, {words_of("text")} AS w FROM documents))),
hit AS (SELECT r, doc_id, license, min(i) AS first_word, count(DISTINCT s) AS n FROM ds JOIN ts USING (s) GROUP BY r, doc_id, license)
SELECT doc_id, license, first_word, hit.n / tn.n AS containment FROM hit JOIN tn USING (license) WHERE hit.n / tn.n >= {CONTAINED}
"""
