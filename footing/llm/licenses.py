"""License texts and notices in documents: winnowed fingerprints, then banded alignment.

Templates are cut into runs of words whose hashes are winnowed into fingerprints, kept in
an inverted index.  Documents are winnowed the same way, so every common run of at least
RUN + WINDOW - 1 words shares a fingerprint; a text that keeps four words in five of a template
has such a run.  Short notices have too few words for that and are indexed by all their runs of
two.  Hits close to one diagonal make a candidate; a sequence alignment within a band around
these diagonals then says which of the template's words are there, and where.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footing.llm.common import text_bytes
from footing.llm.words import CACHE_WORDS, WordIndex, shingles

RUN, WINDOW = 3, 2
#: Words up to which a template counts as short, and the length of its runs.
SHORT, SHORT_RUN = 16, 2
#: Inserted or missing words that an alignment can take in one place: an eighth of a long template's, so many at least.
BAND = 8
#: Scores of an alignment: a word that is there, a changed or missing one, an extra word of the text.
HIT, MISS, EXTRA = 20, -6, -1

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_NO_WARRANTY = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
)
# Public license texts, and the notices and headers by which longer ones are named, by SPDX identifier.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS
    ),
    "MIT-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. " + _AS_IS
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
    "BSD-2-Clause": _BSD_START + _BSD_TWO + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_TWO + _BSD_THREE + _BSD_END,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
        "as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
        "copyright law."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
        "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
        "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "WTFPL": (
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as "
        "long as the name is changed. TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."
    ),
    "PostgreSQL": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided "
        "that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."
    ),
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    ),
    "MPL-2.0/header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program " + _NO_WARRANTY
        + "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
    ),
    "GPL-2.0/header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program " + _NO_WARRANTY
        + "See the GNU General Public License for more details."
    ),
    "LGPL-2.1/header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version. This library " + _NO_WARRANTY
        + "See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program " + _NO_WARRANTY
        + "See the GNU Affero General Public License for more details."
    ),
    "EUPL-1.2/notice": "Licensed under the EUPL, Version 1.2 or later.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}

#: All but ASCII letters, digits and the bytes of other characters parts words; case is folded.
_FOLD = bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or 48 <= k <= 57 or 97 <= k <= 122 else 32 for k in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

FOUND = "license string, matched_words long, template_words long, coverage double, start long, end long"


def words(body: bytes) -> list[bytes]:
    return body.translate(_FOLD).split()


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of every ``window`` neighbours; of fewer, of the least."""
    n = len(hashes)
    if n <= window:
        return np.array([int(hashes.argmin())]) if n else np.zeros(0, dtype=np.int64)
    best = np.arange(n - window + 1)
    for k in range(1, window):
        other = np.arange(k, n - window + 1 + k)
        best = np.where(hashes[other] < hashes[best], other, best)
    return np.unique(best)


def align(template: np.ndarray, body: np.ndarray, low: int, high: int) -> list[int]:
    """Places in body of the template's words (given by hash), -1 where missing, on diagonals low..high.

    Longest common subsequence of the band, a gap costing a little so that matches stay
    together; the body's ends are free.  Among equal scores the earliest end wins.  A row of the
    band is one array step: a run of extra words is a running maximum.
    """
    m, width, never = len(template), high - low + 1, -(10**9)
    slope = EXTRA * np.arange(width)
    score = np.full((m + 1, width + 1), never, dtype=np.int64)
    places = low + np.arange(width)  # words of body used so far, in row 0
    score[0, :-1] = np.where((places >= 0) & (places <= len(body)), 0, never)
    hits = np.zeros((m + 1, width), dtype=bool)
    for i in range(1, m + 1):
        j = places + i
        inside = (j >= 0) & (j <= len(body))
        word = (j > 0) & inside
        hits[i] = word & (body[np.clip(j - 1, 0, len(body) - 1)] == template[i - 1])
        here = np.maximum(np.where(word, score[i - 1, :-1] + np.where(hits[i], HIT, MISS), never), score[i - 1, 1:] + MISS)
        row = np.maximum.accumulate(np.where(inside, here, never) - slope) + slope
        score[i, :-1] = np.where(inside, row, never)
    out = [-1] * m
    i, d = m, int(score[m, :-1].argmax())
    if score[m, d] < never // 2:  # the band lies outside the body
        return out
    while i > 0:
        j = i + low + d
        if j > 0 and score[i, d] == score[i - 1, d] + (HIT if hits[i, d] else MISS):
            if hits[i, d]:
                out[i - 1] = j - 1
            i -= 1
        elif score[i, d] == score[i - 1, d + 1] + MISS:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return out


class Index:
    """Fingerprint -> (template, place), for long templates (winnowed) and short ones (all runs), and the templates' words."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        words_of = [words(templates[n].encode()) for n in self.names]
        index = WordIndex()
        self.words = [index.hashed(own) for own in words_of]
        self.parts = []
        for run, window, short in ((RUN, WINDOW, False), (SHORT_RUN, 1, True)):
            found: dict[int, list[tuple[int, int]]] = {}
            for t, own in enumerate(self.words):
                if (len(own) <= SHORT) == short:
                    hashes = shingles(own, run)
                    for k in winnow(hashes, window):
                        found.setdefault(int(hashes[k]), []).append((t, int(k)))
            self.parts.append((run, window, np.array(sorted(found), dtype=np.uint64), found))

    def _diagonals(self, own: np.ndarray) -> dict[int, list[int]]:
        """Template -> diagonals on which it shares a fingerprint with the text."""
        hits: dict[int, list[int]] = {}
        for run, window, keys, found in self.parts:
            hashes = shingles(own, run)
            places = winnow(hashes, window)
            if not len(keys) or not len(places):
                continue
            picked = hashes[places]
            at = np.minimum(np.searchsorted(keys, picked), len(keys) - 1)
            for k in np.flatnonzero(keys[at] == picked):
                for t, place in found[int(picked[k])]:
                    hits.setdefault(t, []).append(int(places[k]) - place)
        return hits

    def find(self, body: bytes, index: WordIndex, least: float) -> list[tuple]:
        own = index.hashed(words(body))
        out, spans = [], None
        for t, diagonals in sorted(self._diagonals(own).items()):
            template = self.words[t]
            band = max(1, len(template) // 4) if len(template) <= SHORT else max(BAND, len(template) // 8)  # a short notice may follow itself closely
            widest = max(BAND, len(template) // 4)
            groups: list[list[int]] = []
            for d in sorted(set(diagonals)):
                if groups and d - groups[-1][-1] <= band and d - groups[-1][0] <= widest:
                    groups[-1].append(d)
                else:
                    groups.append([d])
            taken: set[int] = set()
            for g in groups:
                low, high = g[0] - band, g[-1] + band
                near = own[max(0, low) : high + len(template)]
                if np.isin(template, near).sum() < least * len(template):
                    continue  # too few of its words are there at all
                got = align(template, own, low, high)
                held = [x for x in got if x >= 0]
                if len(held) >= least * len(got) and not taken & {*held}:
                    taken.update(held)
                    if spans is None:
                        spans = [m.span() for m in _WORD.finditer(body.decode("utf-8", "replace"))]
                    out.append((self.names[t], len(held), len(got), len(held) / len(got), spans[held[0]][0], spans[held[-1]][1]))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every place where at least ``least`` of a template's words stand in order.

    Returns doc_id, license, matched_words, template_words, coverage, start and end (code
    points of the whole text).  Null, empty and blank texts have no rows; repeated rows give
    repeated rows; a null id stays null; other columns are not looked at.  No shuffle; the
    templates are a fixed list.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("body"))
    names = ["doc_id", *(c.split()[0] for c in FOUND.split(", "))]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    built = Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WordIndex()
        for batch in batches:
            if len(index) > CACHE_WORDS:
                index.clear()
            rows = [(doc, *x) for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)) for x in built.find(body.as_py(), index, least)]
            columns = [*zip(*rows)] if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return own.mapInArrow(run, f"doc_id long, {FOUND}")
