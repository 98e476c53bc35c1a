"""License scan: parts of a text compared to licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised alike. The parts are the whole text, its paragraphs, its lines and, for licences that
none of these shows, windows of its words, so that a template is found inside longer text at any layout. A template of
b bigrams can reach a Dice coefficient of t with a part of a bigrams only if t / (2 - t) <= a / b <= (2 - t) / t, so
part sizes, in normalised words, prune most templates; shared bigrams are then counted through an index of the templates'
bigrams. Parts without one of a few words, of which each part that reaches a template holds one, are passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import slices

_NOT_WORD = re.compile(r"[^\w.+-]+|(?<!\w)[.+-]+|[.+-]+(?!\w)")
_COPYRIGHT = re.compile(r"^\W*(?:copyright|\(c\)|©).*$", re.I | re.M)
_SPELLING = {"licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "v2": "2.0", "v3": "3"}

_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Licence notices and short licences, by SPDX identifier. Fixed values.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-2-Clause": [f"{_BSD_START} {_BSD_END}"],
    "BSD-3-Clause": [
        f"{_BSD_START} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        "or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, "
        "Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. "
        "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright "
        "notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
    ],
}


def normal_words(text: str) -> list[str]:
    return [_SPELLING.get(w, w) for w in _NOT_WORD.sub(" ", text.lower()).split()]


def bigrams(words: list[str]) -> Counter:
    """Bigrams of normalised words with their counts; a single word is paired with nothing."""
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter((w, "") for w in words)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least, self.templates, self.grams = least, [], []
        self.index: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for name, texts in templates.items():
            for t in texts:
                grams = bigrams(normal_words(t))
                for g, n in grams.items():
                    self.index.setdefault(g, []).append((len(self.templates), n))
                self.templates.append((name, sum(grams.values())))
                self.grams.append(grams)
        ratio = least / (2 - least)
        self.low = min((b for _, b in self.templates), default=1) * ratio
        self.high = max((b for _, b in self.templates), default=0) / ratio
        self.ratio = ratio
        needed = {w for g in self.grams for w in self.needed(g)}
        needed |= {old for old, new in _SPELLING.items() if new in needed}
        # a word that holds another needed one adds nothing
        self.words = [w for w in sorted(needed, key=lambda w: (len(w), w)) if not any(v in w for v in needed - {w})]

    def needed(self, grams: Counter) -> list[str]:
        """Words of which a window that reaches the threshold has at least one: without them too many bigrams are gone."""
        size, left, out = sum(grams.values()), dict(grams), []
        while left and size - sum(left.values()) <= size * (1 - self.least / (2 - self.least)):
            out.append(max((w for g in left for w in g), key=lambda w: ("licen" in w, len(w), w)))
            left = {g: n for g, n in left.items() if out[-1] not in g}
        return out

    def some(self, lowered: str) -> bool:
        """Whether a lower-cased text holds a word without which no part of it reaches the threshold."""
        return any(w in lowered for w in self.words)

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """(licence, Dice coefficient) of the nearest template that reaches the threshold; ties: the first by name."""
        a = max(len(words) - 1, min(len(words), 1))
        if not self.low <= a <= self.high:
            return None
        shared: dict[int, int] = {}
        for g, n in bigrams(words).items():
            for t, m in self.index.get(g, ()):
                shared[t] = shared.get(t, 0) + min(n, m)
        found = [(2 * s / (a + self.templates[t][1]), self.templates[t][0]) for t, s in shared.items() if self.ratio <= a / self.templates[t][1] <= 1 / self.ratio]
        found = [(-d, name) for d, name in found if d >= self.least]
        return (min(found)[1], -min(found)[0]) if found else None

    def windows(self, words: list[str]) -> list[tuple[float, str, int]]:
        """(Dice coefficient, licence, first word) of the nearest windows of words that don't overlap.

        A window counts as long as its template at least, unless the whole text is shorter: else the best one would leave out the
        words that differ at an end. It starts and ends with a bigram of the template.
        """
        grams = list(zip(words, words[1:], strict=False))
        hits: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            for t, _ in self.index.get(g, ()):
                hits.setdefault(t, []).append(i)
        found = []
        for t, at in hits.items():
            name, b = self.templates[t]
            most = int(b / self.ratio + 1e-9)
            # no window has more bigrams of the template than the longest one from its start on
            enough = self.least * (min(b, len(grams)) + b) / 2 - 1e-9
            own, every = self.grams[t], Counter(grams[i] for i in at)
            if sum((own & every).values()) < enough:
                continue
            held, shared, z, near, until = Counter(), 0, 0, 0.0, 0
            for first in at:
                while z < len(at) and at[z] < first + most:
                    held[g := grams[at[z]]] += 1
                    shared += held[g] <= own[g]
                    z += 1
                # a window that overlaps one of the same template must be able to come nearer
                if shared >= enough and (first >= until or 2 * shared / (min(b, len(grams)) + b) > near + 1e-9):
                    for new in self.grown(grams, t, first, min(first + most, len(grams))):
                        found.append(new)
                        if new[0] > near or first >= until:
                            near, until = new[0], new[3]
                shared -= held[g := grams[first]] <= own[g]
                held[g] -= 1
        out: list[tuple[float, str, int]] = []
        taken = bytearray(len(grams))
        for d, name, start, end in sorted(found, key=lambda f: (-f[0], f[1], f[2], f[3])):
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                out.append((d, name, start))
        return out

    def grown(self, grams: list[tuple[str, str]], t: int, first: int, stop: int) -> list[tuple[float, str, int, int]]:
        """The best window of template t whose first hit is at ``first``, if it reaches the threshold."""
        (name, b), left, shared, best = self.templates[t], dict(self.grams[t]), 0, None
        for end in range(first + 1, stop + 1):
            if left.get(grams[end - 1], 0) > 0:
                left[grams[end - 1]] -= 1
                shared += 1
                # words before the first hit stand for the template's missing beginning, those after the last for its end
                size = max(end - first, min(b, len(grams)))
                d = 2 * shared / (size + b)
                if d >= self.least and (best is None or d > best[0]):
                    best = (d, name, first, end)
        return [best] if best else []

    def scan(self, text: str) -> dict[str, tuple[float, str, int]]:
        """For each licence found its greatest Dice coefficient, the kind of part, and the part's number."""
        out: dict[str, tuple[float, str, int]] = {}
        if not self.some(text.lower()):
            return out
        lines = text.split("\n")
        paragraphs = re.split(r"\n[ \t\r]*\n", text)
        parts = [("line", i, x) for i, x in enumerate(lines)] + [("paragraph", i, x) for i, x in enumerate(paragraphs) if "\n" in x] + ([("text", 0, _COPYRIGHT.sub("", text))] if len(lines) > 1 else [])
        for kind, i, x in parts:
            if self.some(x.lower()) and (hit := self.best(normal_words(x))) and hit[1] > out.get(hit[0], (0.0,))[0]:
                out[hit[0]] = (hit[1], kind, i)
        known = set(out)
        for d, name, start in self.windows(normal_words(text)):
            if name not in known and d > out.get(name, (0.0,))[0]:
                out[name] = (d, "words", start)
        return out


OUT = "id long, license string, dice double, part string, part_no long"


def _scanned(templates: dict[str, list[str]], least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates, least)
        for b in (x for whole in batches for x in slices(whole, 1)):
            rows = [(key, name, *hit) for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) if text.is_valid for name, hit in sorted(s.scan(text.as_py()).items())]
            types = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split()[0] for x in OUT.split(", ")])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found in it: id_col, license, dice, part (line, paragraph, text or words), part_no
    (of words: the number of the window's first word).

    A part that reaches several templates counts for the nearest. Null and empty texts have no licence; repeated rows are
    scanned each; a null id stays null; an empty table gives an empty result. Only id_col and text_col are read.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(_scanned(templates or TEMPLATES, least), OUT).withColumnRenamed("id", id_col)
