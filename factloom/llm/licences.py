"""Licence scans: normalised passages compared with licence templates by Dice coefficient over word bigrams.

A passage is any run of words; its bigrams are those of its normalised words (lower case, letters and digits, ``licence``
as ``license``). For multisets of a and b bigrams with o in common Dice is 2 o / (a + b). Reaching t takes b between
a t / (2 - t) and a (2 - t) / t, and an overlap of at least a t / (2 - t): these bounds drop a template for a text whose
words can't supply the overlap, every start after which too few of the template's bigrams follow, and end the growth of
a passage. Of overlapping passages the highest coefficient stays (ties: longer passage in code points, earlier start, first
template by name); what it leaves free is searched again, so passages are those of a greedy choice among all runs of words.

Work is linear in the text: one pass for words, and for texts that hold enough of a template's words a scan from each
template bigram over at most a (2 - t) / t bigrams. A passage starts and ends with a template bigram, as anything else
lowers the coefficient. No shuffle at all: templates are a parameter, texts stay where they are. Nulls and empty texts have
no passages; very long texts are scanned whole; repeated rows each give their rows; a null id is kept; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DICE = 0.8
WORD = re.compile(r"[^\W_]+")

#: The wording of public licences and of the notices by which they are applied.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

TEMPLATES = (
    ("agpl-3-header", _GNU.format(what="program", name=_AGPL, n=3)),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("bsd-0-clause", f"{_ISC}. {_ISC_WARRANTY}"),
    ("bsd-2-clause", f"{_BSD} {_BSD_WARRANTY}"),
    ("bsd-2-clause-conditions", _BSD),
    ("bsd-2-clause-notice", "Released under the 2-clause BSD License."),
    ("bsd-3-clause", f"{_BSD} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("bsd-3-clause-conditions", f"{_BSD} {_BSD_NAMES}"),
    ("bsd-3-clause-notice", "Released under the 3-clause BSD License."),
    ("bsl-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("bsl-1.0-notice", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0-notice", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("gpl-2-header", _GNU.format(what="program", name=_GPL, n=2)),
    ("gpl-2-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3-header", _GNU.format(what="program", name=_GPL, n=3)),
    ("gpl-3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("isc-permission", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1-header", _GNU.format(what="library", name=_LGPL, n=2.1)),
    ("lgpl-3-header", _GNU.format(what="library", name=_LGPL, n=3)),
    ("lgpl-3-notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", f"{_MIT} {_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-permission", _MIT),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense-notice", "This is free and unencumbered software released into the public domain."),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)


def words_of(text: str) -> list[str]:
    """Normalised words, one for each match of WORD."""
    found = WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]
    return ["license" if w == "licence" else w for w in found]


class Template:
    def __init__(self, name: str, words: list[str], least: float):
        self.name = name
        self.bigrams = Counter(zip(words, words[1:], strict=False))
        self.size = sum(self.bigrams.values())
        self.low, self.high = self.size * least / (2 - least), self.size * (2 - least) / least
        self.place = {b: i for i, b in enumerate(self.bigrams)}
        self.limit = np.array(list(self.bigrams.values()), dtype=np.int64)


class _Runs:
    """A template's bigrams in a text, and the best run of words from each of them."""

    def __init__(self, template: Template, at: np.ndarray, kind: np.ndarray, ends: list[tuple[int, int]], least: float):
        self.t, self.at, self.kind, self.ends, self.least = template, at, kind, ends, least
        order = np.argsort(kind, kind="stable")
        first = np.searchsorted(kind[order], np.arange(len(template.limit)))
        self.earlier = np.empty(len(kind), dtype=np.int64)  # how often the same bigram came before
        self.earlier[order] = np.arange(len(kind)) - first[kind[order]]
        self.reach = np.searchsorted(at, at + template.high + 1e-9)  # a run from i ends before this bigram

    def starts(self) -> np.ndarray:
        return np.flatnonzero(self.reach - np.arange(len(self.at)) >= self.t.low - 1e-9)

    def best(self, i: int, stop: int) -> tuple[float, int, int, int] | None:
        """(-coefficient, -code points, end, bigrams) of the best run from the i-th bigram that ends before bigram ``stop``."""
        js = np.arange(i, min(int(self.reach[i]), stop))
        if len(js) < self.t.low - 1e-9:
            return None
        kinds = self.kind[js]
        base = np.full(len(self.t.limit), -1, dtype=np.int64)
        base[kinds[::-1]] = self.earlier[js[::-1]]  # of the first in the run
        overlap = np.cumsum(self.earlier[js] - base[kinds] < self.t.limit[kinds])
        sizes = self.at[js] - self.at[i] + 1
        score = 2 * overlap / (self.t.size + sizes)
        top = float(score.max())
        if top < self.least:
            return None
        j = int(np.flatnonzero(score == top)[-1])
        start, end = self.ends[self.at[i]][0], self.ends[self.at[js[j]] + 1][1]
        return -top, start - end, end, int(sizes[j])


class Matcher:
    def __init__(self, templates: Sequence[tuple[str, str]], least: float):
        self.least = least
        self.templates = [t for name, text in sorted(templates) if (t := Template(name, words_of(text), least)).size]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for n, t in enumerate(self.templates):
            for b in t.bigrams:
                self.holders.setdefault(b, []).append(n)
        self.vocabulary = frozenset(w for b in self.holders for w in b)

    def passages(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coefficient, start, end, bigrams) in code points, in order of start."""
        words = words_of(text)
        if len(self.vocabulary.intersection(words)) < 2:
            return []
        hits: dict[int, tuple[list[int], list[int]]] = {}
        for i, b in enumerate(zip(words, words[1:], strict=False)):
            for n in self.holders.get(b, ()):
                at, kind = hits.setdefault(n, ([], []))
                at.append(i)
                kind.append(self.templates[n].place[b])
        near = {n: h for n, h in hits.items() if len(h[0]) >= self.templates[n].low - 1e-9}
        return self._choose(near, [m.span() for m in WORD.finditer(text)]) if near else []

    def _choose(self, near: dict[int, tuple[list[int], list[int]]], ends: list[tuple[int, int]]) -> list[tuple[str, float, int, int, int]]:
        runs = {n: _Runs(self.templates[n], np.array(at, dtype=np.int64), np.array(kind, dtype=np.int64), ends, self.least) for n, (at, kind) in near.items()}
        heap: list[tuple] = []

        def offer(n: int, i: int, stop: int) -> None:
            r = runs[n]
            if found := r.best(i, stop):
                score, length, end, size = found
                heapq.heappush(heap, (score, length, ends[r.at[i]][0], r.t.name, n, i, end, size))

        for n, r in runs.items():
            for i in r.starts().tolist():
                offer(n, i, len(r.at))
        taken: list[tuple[int, int, str, float, int]] = []  # in order of start
        while heap:
            score, _, start, name, n, i, end, size = heapq.heappop(heap)
            k = bisect.bisect_right(taken, (start, 1 << 62))
            if k and taken[k - 1][1] > start:
                continue
            if k < len(taken) and taken[k][0] < end:  # again, up to what is taken
                r = runs[n]
                wall = bisect.bisect_left(ends, (taken[k][0], 0))  # the first word taken
                offer(n, i, int(np.searchsorted(r.at, wall - 1)))
                continue
            taken.insert(k, (start, end, name, -score, size))
        return [(name, score, start, end, size) for start, end, name, score, size in taken]


def scan_licences(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = DICE) -> DataFrame:
    """A row per passage: id, template, dice, start, end, bigrams, and the passage itself."""
    kind = documents.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, least)
        for batch in batches:
            rows = [(i, *x, text[x[2] : x[3]]) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for x in matcher.passages(text)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = (batch.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_col, "template", "dice", "start", "end", "bigrams", "passage"])

    return documents.select(id_col, text_col).mapInArrow(scan, f"{id_col} {kind}, template string, dice double, start long, end long, bigrams long, passage string")


def op1_licences(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
