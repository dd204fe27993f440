"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Units of a document are its lines, its paragraphs (runs of lines that are not blank), its whole text, and windows of its
words, which may begin and end amid lines. A unit with a
bigrams and a template with b have a Dice coefficient of at most ``2 min(a, b) / (a + b)``, so only templates of a
size for which that reaches the threshold are counted out, and of those only ones that share a bigram. Documents that share no bigram with any template are done after one look-up.

Of windows only those count that begin and end with a shared bigram which is not in them twice: to drop any other end
leaves the Dice coefficient as it is or raises it. A window needs ``t b / (2 - t)`` shared bigrams to reach t, so most
documents are done when their shared bigrams are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import portions

LEAST = 0.8
#: Names by which notices call licences (fixed values).
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU General Public License, version 2", "GPLv2 License"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License, version 3", "GPLv3 License"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["The Unlicense"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Creative Commons Zero v1.0 Universal License"],
}
PHRASES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This project is licensed under the terms of the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.")
#: Identifiers of licences as in tags of source files, beside the names above (fixed values).
TAGGED = ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "0BSD", "WTFPL")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_END = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(kind: str, version: str, what: str = "program") -> str:
    """The notice that goes into files under a licence of the GNU project."""
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


_GNU_END = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
#: Texts and notices by licence, as their publishers word them (fixed values).
TEXTS = {
    "MIT": ["Released under the MIT license.", "This project is licensed under the terms of the MIT license.", _MIT, _MIT + _MIT_END],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-2.0": [_gnu("General Public License", "2"), _gnu("General Public License", "2") + _GNU_END],
    "GPL-3.0": [_gnu("General Public License", "3"), _gnu("General Public License", "3") + _GNU_END],
    "LGPL-2.1": [_gnu("Lesser General Public License", "2.1", "library")],
    "LGPL-3.0": [_gnu("Lesser General Public License", "3", "library")],
    "AGPL-3.0": [_gnu("Affero General Public License", "3")],
    "BSD-2-Clause": [_BSD + _BSD_END],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", _BSD + _BSD_THIRD, _BSD + _BSD_THIRD + _BSD_END],
    "ISC": [_ISC + ", provided that the above copyright notice and this permission notice appear in all copies.", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END],
    "0BSD": [_ISC + "." + _ISC_END],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
#: All templates: the texts, every name in every phrase, and the tags of source files.
TEMPLATES = {
    name: list(dict.fromkeys([*TEXTS.get(name, ()), *[p.format(n) for n in NAMES.get(name, ()) for p in PHRASES], *([] if name == "Proprietary" else [f"SPDX-License-Identifier: {name}"])]))
    for name in dict.fromkeys([*TEXTS, *NAMES, *TAGGED])
}
_SIGNS = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words of letters and digits; other ASCII characters part them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SIGNS).split()


def bigrams(w: list[bytes]) -> set:
    return set(zip(w, w[1:]))


#: Starts of windows that are taken up at a time, and cells of the tables that hold their windows.
STARTS, CELLS = 4_096, 1 << 20


class Places:
    """The bigrams of a text by number, with the places before and after at which each occurs."""

    def __init__(self, pairs: list) -> None:
        self.number: dict = {}
        self.ids = np.array([self.number.setdefault(x, len(self.number)) for x in pairs], np.int64)
        n = self.n = len(pairs)
        self.before, self.after = np.full(n, -1), np.full(n, n)
        order = np.argsort(self.ids, kind="stable")
        same = self.ids[order[1:]] == self.ids[order[:-1]]
        self.before[order[1:][same]] = order[:-1][same]
        self.after[order[:-1][same]] = order[1:][same]

    def marked(self, template: set) -> np.ndarray:
        """By number of a bigram: whether the template has it."""
        out = np.zeros(len(self.number), bool)
        out[[self.number[x] for x in template if x in self.number]] = True
        return out

    def matches(self, start: int, end: int, i: int, size: int, marked: np.ndarray, t: float) -> np.ndarray:
        """Rows (-Dice, -size, i, first word, last word) of windows that begin in a range of places and reach ``t``.

        A window that is no more like the template than a shorter one with the same start never wins, and is left out.
        """
        starts = start + np.flatnonzero(marked[self.ids[start:end]])
        most = int((2 * size + 1e-9) / t) - size
        most += t * (most + 1 + size) <= 2 * size + 1e-9
        width = min(2 * most + 8, self.n)
        out = [np.empty((0, 5))]
        rows = max(1, CELLS // width)
        for at in range(0, len(starts), rows):
            s = starts[at : at + rows]
            seen, hits, best = (np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.zeros(len(s)))
            here, stop = s, self.after[s]
            while len(s):
                place = here[:, None] + np.arange(width)
                inside = place < stop[:, None]
                place = np.minimum(place, self.n - 1)
                new = inside & (self.before[place] < s[:, None])
                count = seen[:, None] + np.cumsum(new, 1)
                hit = new & marked[self.ids[place]]
                n = hits[:, None] + np.cumsum(hit, 1)
                dice = np.where(hit & (count <= most), 2 * n / (count + size), 0.0)
                top = np.maximum.accumulate(np.column_stack([best, dice]), 1)
                r, c = np.nonzero((dice >= t) & (dice > top[:, :-1]))
                out.append(np.column_stack([-dice[r, c], np.full(len(r), -size), np.full(len(r), i), s[r], place[r, c] + 1]))
                on = (count[:, -1] <= most) & (here + width < stop)
                s, here, stop, seen, hits, best = s[on], here[on] + width, stop[on], count[on, -1], n[on, -1], top[on, -1]
        return np.concatenate(out)


def settled(rows: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows taken, windows that wait) of ``rows`` (-Dice, -size, template, first word, last word), by rank.

    All windows that begin before word ``known`` are among the rows. One that ends before it is taken if no better one
    overlaps it, and waits if a better one that waits does.
    """
    if not len(rows):
        return rows, rows
    rows = rows[np.lexsort(rows.T[::-1])]
    p, q = rows[:, 3], rows[:, 4]
    low = int(p.min())
    alive, maybe = np.ones(len(rows), bool), bytearray(int(q.max()) + 1 - low)
    taken, waits, k = [], [], 0
    while k < len(rows):
        k += int(alive[k:].argmax())
        if not alive[k]:
            break
        a, b = int(p[k]) - low, int(q[k]) + 1 - low
        if q[k] >= known or maybe.find(1, a, b) >= 0:
            maybe[a:b] = b"\1" * (b - a)
            waits.append(k)
        else:
            alive &= (q < p[k]) | (p > q[k])
            taken.append(k)
        k += 1
    return rows[taken], rows[waits]


class Templates:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> None:
        self.least = least
        self.rows = [(name, bigrams(words(t))) for name, ts in templates.items() for t in ts]
        self.rows = [r for r in self.rows if r[1]]
        self.of: dict[tuple, list[int]] = {}
        for i, (_, b) in enumerate(self.rows):
            for x in b:
                self.of.setdefault(x, []).append(i)

    def best(self, unit: set) -> tuple[float, str] | None:
        """(Dice, name) of the template most like a unit, if at least ``least``; of ties the first listed."""
        a, t, shared = len(unit), self.least, {}
        hits = unit & self.of.keys()
        if len(hits) * (2 - t) < t * a - 1e-9:  # no template has so many of them
            return None
        for x in hits:
            for i in self.of[x]:
                shared[i] = shared.get(i, 0) + 1
        found = None
        for i in sorted(shared):
            name, b = self.rows[i]
            if 2 * min(a, len(b)) >= t * (a + len(b)) - 1e-9:
                dice = 2 * shared[i] / (a + len(b))
                if dice >= t and (found is None or dice > found[0]):
                    found = (dice, name)
        return found

    def windows(self, w: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, licence, Dice) of windows that match and do not overlap: the most like, the longest template, the first.

        Starts are taken up ``STARTS`` at a time. After each lot the windows are settled that nothing further on can
        beat; the others wait. Of windows with equal likeness the first wins, so what waits is bounded by the templates
        and their sizes, not by the text.
        """
        pairs, t, shared = list(zip(w, w[1:])), self.least, {}
        for x in self.of.keys() & set(pairs):
            for i in self.of[x]:
                shared[i] = shared.get(i, 0) + 1
        may = sorted(i for i, n in shared.items() if n * (2 - t) >= t * len(self.rows[i][1]) - 1e-9)
        if not may:
            return []
        places = Places(pairs)
        tables = {i: places.marked(self.rows[i][1]) for i in may}
        out: list[tuple[int, int, str, float]] = []
        waiting = np.empty((0, 5))
        for start in range(0, len(pairs), STARTS):
            end = min(start + STARTS, len(pairs))
            found = [places.matches(start, end, i, len(self.rows[i][1]), tables[i], t) for i in may]
            taken, waiting = settled(np.concatenate([waiting, *found]), end if end < len(pairs) else len(w))
            out += [(int(p), int(q), self.rows[int(i)][0], -dice) for dice, _, i, p, q in taken.tolist()]
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(first line, lines, licence, Dice) of the units that match, by place; lines count from 0."""
        if not text or not bigrams(words(text)) & self.of.keys():
            return []
        lines = text.split("\n")
        sets = [words(x) for x in lines]
        out = []
        for i, w in enumerate(sets):
            if len(w) > 1 and (hit := self.best(bigrams(w))):
                out.append((i, 1, hit[1], hit[0]))
        blocks, start = [], None
        for i, x in enumerate([*lines, ""]):
            if x.strip() and start is None:
                start = i
            elif not x.strip() and start is not None:
                blocks.append((start, i - start))
                start = None
        whole = [(0, len(lines))] if len(blocks) > 1 else []  # the only paragraph is the text
        for s, n in [b for b in [*blocks, *whole] if b[1] > 1]:
            if hit := self.best(bigrams([w for x in sets[s : s + n] for w in x])):
                out.append((s, n, hit[1], hit[0]))
        # a window within a unit that already names its licence is no further match
        within: dict[int, list] = {}
        for s, n, name, _ in out:
            for i in range(s, s + n):
                within.setdefault(i, []).append((name, s + n))
        at = [i for i, x in enumerate(sets) for _ in x]
        for p, q, name, dice in self.windows([w for x in sets for w in x]):
            if not any(x == name and at[q] < end for x, end in within.get(at[p], ())):
                out.append((at[p], at[q] - at[p] + 1, name, dice))
        return sorted(out, key=lambda x: (x[0], x[1]))


def find_licences(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, licence, dice, n_matches, matches.

    ``licence`` and ``dice`` are those of the unit most like a template (of ties the first in the text, then the
    shortest), null and 0 where no unit reaches ``least``; ``matches`` lists licence:first line:lines of all
    units that do. Null and empty texts match nothing. Rows that share an id are scanned each for itself. Texts of any length
    are read whole. Further columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Templates(templates, least)
        for pdf in portions(batches):
            out = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"], strict=True):
                found = table.scan(text if isinstance(text, str) else None)
                top = max(found, key=lambda x: x[3], default=(0, 0, None, 0.0))
                out.append((doc_id, top[2], top[3], len(found), ",".join(f"{name}:{s}:{n}" for s, n, name, _ in found)))
            yield pd.DataFrame(out, columns=["doc_id", "licence", "dice", "n_matches", "matches"]).astype({"doc_id": "Int64", "dice": float})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, licence string, dice double, n_matches bigint, matches string")
