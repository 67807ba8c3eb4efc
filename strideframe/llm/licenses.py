"""License notices by conditional compression, confirmed by their exact wording.

Candidate blocks are the words around license words, as many to each side as the longest template
with its permitted differences has, so that line breaks don't matter. The words of a block are
compressed with zstandard, in overlapping windows twice as long as a match, alone and with each
template as a raw dictionary. Templates are ranked by the bytes that they save; those that save
none leave (short ones never do: a few bytes are noise). The others are aligned with the block word by word, and a match counts when the words
missing, added or changed are few; it is returned with those differences. The best match is cut out
and the rest is compared again, until nothing matches.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import text_rows

#: Notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MIT-short": "Released under the MIT License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-text": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}
#: Words one of which every template above contains.
CUES = ("licens", "permission", "copyright", "redistribut")
#: Words of a block whose ends are compared at a time.
SPAN = 4096
#: Windows for compression overlap by so many words at least.
LEAST_STEP = 16
#: Templates of fewer words save so few bytes that a saving of none tells nothing.
SHORT = 20
#: Part of a template's words that may differ.
MAX_DIFFERENCE = 0.15
_WORD = re.compile(r"[^\W_]+", re.UNICODE)


def cues_of(templates: dict[str, str]) -> tuple[str, ...]:
    """Words (lower case) to look for: the usual cues, and the longest word of every template that has none of them."""
    out = list(CUES)
    for text in templates.values():
        words = [w.lower() for w in _WORD.findall(text)]
        if words and not any(c in w for c in out for w in words):
            out.append(max(words, key=lambda w: (len(w), w)))
    return tuple(out)


def blocks(text: str, reach: int, cue: re.Pattern) -> list[list[tuple[int, int]]]:
    """The words of the candidate blocks of a text, as code-point ranges: all words within ``reach`` words of one with a cue, however lines are broken."""
    cues = [m.start() for m in cue.finditer(text)]
    if not cues:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    places = np.searchsorted(np.array([s for s, _ in spans]), cues, side="right") - 1
    out: list[list[int]] = []
    for place in places.tolist():
        first, end = max(0, place - reach), min(len(spans), place + reach + 1)
        if out and first <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([first, end])
    return [spans[first:end] for first, end in out]


def ends(words: list[str], template: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each end (0 to ``len(words)``) of a stretch of ``words`` the fewest words that differ from ``template``, and the stretch's first word.

    Word edit distance with free ends in ``words``, row by row over the template.
    """
    n = len(words)
    codes = {w: i for i, w in enumerate(dict.fromkeys(template))}
    text = np.array([codes.get(w, -1) for w in words])
    steps = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), steps.copy()
    for i, w in enumerate(template, 1):
        change = np.concatenate([[i], cost[:-1] + (text != codes[w])])
        begin = np.concatenate([[0], start[:-1]])
        lost = cost + 1
        begin = np.where(lost < change, start, begin)
        best = np.minimum(change, lost)
        # Added words: the least of best[j] + (k - j) over j <= k.
        shifted = best - steps
        least = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == least, steps, 0))
        cost, start = least + steps, begin[source]
    return cost, start


def align(words: list[str], template: list[str]) -> tuple[int, int, int]:
    """The stretch of ``words`` nearest to ``template``: differing words, first word, end."""
    cost, start = ends(words, template)
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Scanner:
    """Compressors of the templates, made once in each Python worker."""

    def __init__(self, templates: dict[str, str], level: int = 3) -> None:
        import zstandard

        def coder(words: list[str]):
            known = zstandard.ZstdCompressionDict(" ".join(words).encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=known)

        self.alone = zstandard.ZstdCompressor(level=level, write_content_size=False)
        lists = {name: [w.lower() for w in _WORD.findall(text)] for name, text in templates.items()}
        self.templates = {name: (words, coder(words)) for name, words in lists.items() if words}
        self.cue = re.compile("|".join(map(re.escape, cues_of(templates))), re.IGNORECASE)
        #: Words of the longest stretch that can match a template.
        self.reach = max((len(t) + int(MAX_DIFFERENCE * len(t)) for t, _ in self.templates.values()), default=1)

    def savings(self, words: list[str], names: list[str]) -> dict[str, int]:
        """Bytes that each template saves in compressing the words, ranked, the most first.

        They are the most of all windows twice as long as the template's longest match and half
        overlapping, of which one holds any match whole; other text in it is no longer than that.
        """
        best, alone = {}, {}
        for name in names:
            template, coder = self.templates[name]
            step = max(LEAST_STEP, len(template) + int(MAX_DIFFERENCE * len(template)))
            for at in range(0, max(1, len(words) - step), step):
                if (at, step) not in alone:
                    window = " ".join(words[at : at + 2 * step]).encode("utf-8", "surrogatepass")
                    alone[at, step] = window, len(self.alone.compress(window))
                window, size = alone[at, step]
                best[name] = max(best.get(name, -size), size - len(coder.compress(window)))
        return dict(sorted(best.items(), key=lambda x: (-x[1], x[0])))

    def scan(self, text: str) -> list[dict]:
        """Confirmed notices of a text: at each place the template with the fewest differences, then the longest."""
        found = []
        for spans in blocks(text, self.reach, self.cue):
            found += self.confirm([(text[s:e].lower(), s, e) for s, e in spans])
        return found

    def hits(self, words: list[str], names: list[str]) -> Iterator[tuple]:
        """(part of differences, -words, first, end, template, differences) of every stretch near enough to a template."""
        for name in names:
            template = self.templates[name][0]
            cost, start = ends(words, template)
            for end in np.flatnonzero((cost <= MAX_DIFFERENCE * len(template)) & (start < np.arange(len(cost)))).tolist():
                yield int(cost[end]) / len(template), -len(template), int(start[end]), end, name, int(cost[end])

    def near(self, words: list[str], lo: int, hi: int, after: int) -> Iterator[tuple]:
        """The ``hits`` within words ``lo`` to ``hi`` that end after ``after``, their places counted from the block's start.

        Templates are ranked by what they save; left out are long ones that save nothing and those of
        which so many words are missing that no stretch can match.
        """
        part = words[lo:hi]
        there = set(part)
        names = [n for n, saved in self.savings(part, list(self.templates)).items() if saved > 0 or len(self.templates[n][0]) < SHORT]
        missing = {n: sum(w not in there for w in self.templates[n][0]) for n in names}
        names = [n for n in names if missing[n] <= MAX_DIFFERENCE * len(self.templates[n][0])]
        for ratio, size, first, end, name, differ in self.hits(part, names):
            if lo + end > after:
                yield ratio, size, lo + first, lo + end, name, differ

    def confirm(self, part: list[tuple[str, int, int]]) -> list[dict]:
        """Notices in a block of words, best first; what was found is cut out and the rest is compared again."""
        plain = [w for w, _, _ in part]
        heap: list[tuple] = []
        # A stretch that ends in a span of words begins at most ``reach`` words before the span.
        for at in range(0, len(plain), SPAN):
            heap += self.near(plain, max(0, at - self.reach), at + SPAN, at)
        heapq.heapify(heap)
        taken: list[tuple[int, int]] = []
        out = []
        while heap:
            ratio, size, first, end, name, differ = heapq.heappop(heap)
            at = bisect.bisect_left(taken, (first + 1,))
            if (at and taken[at - 1][1] > first) or (at < len(taken) and taken[at][0] < end):
                continue
            if not any(self.cue.search(w) for w in plain[first:end]):
                continue
            taken.insert(at, (first, end))
            s, e = part[first][1], part[end - 1][2]
            around = plain[max(0, first - self.reach // 2) : end + self.reach // 2]
            out.append({"license": name, "start": s, "end": e, "words": -size, "differences": differ, "saved": self.savings(around, [name])[name]})
            # Stretches that began within the notice begin behind it now; all others are as they were.
            stop = min(end + self.reach, taken[at + 1][0] if at + 1 < len(taken) else len(plain))
            for hit in self.near(plain, end, stop, end):
                heapq.heappush(heap, hit)
        return sorted(out, key=lambda x: x["start"])


_scanners: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each license notice: ``id_col``, ``license``, ``start``, ``end``, ``words``, ``differences``, ``saved``.

    ``start`` and ``end`` are code points; ``words`` is the template's length, ``differences``
    the words in which the wording differs, ``saved`` the compressed bytes that the template saves
    on the notice and the words around it. Overlapping notices give way to the one with the smaller
    part of differences, then the longer. A notice has to contain one of the license words, or, for
    a template without any, its longest word.

    Null, empty and notice-free texts give no rows. Null ids and repeated rows give rows each. The
    blocks of long texts are compared in overlapping spans. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    templates = TEMPLATES if templates is None else templates
    made = tuple(sorted(templates.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.setdefault(made, Scanner(dict(made)))
        types = [("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("differences", pa.int32()), ("saved", pa.int32())]
        for batch in batches:
            ids, rows = [], []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = scanner.scan(text.as_py() or "")
                ids += [ident] * len(got)
                rows += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([r[n] for r in rows], t) for n, t in types]], ["id", *[n for n, _ in types]])

    rows = text_rows(docs, text_col, id=id_col)
    # Texts without any license word never leave the JVM; their whole text is searched.
    low = F.lower("text")
    rows = rows.filter(reduce(lambda a, b: a | b, [F.contains(low, F.lit(c)) for c in cues_of(templates)]))
    return rows.mapInArrow(run, "id long, license string, start int, end int, words int, differences int, saved int").withColumnRenamed("id", id_col)
