"""License scan: Dice coefficient over word bigrams against licence templates.

Text and templates are normalised to lower-case words. A template of m
bigrams and a passage of k bigrams have a Dice coefficient of at most
2 min(m, k) / (m + k), so to reach the threshold t the passage must have
between m t / (2 - t) and m (2 - t) / t bigrams: templates outside that
bound are never compared. Passages are found where template bigrams occur:
each starts and ends at one, within the size bound, so a notice inside
running prose is found as well as one on a line of its own.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import small_batches

WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.'-][\p{L}\p{N}]+)*")

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. ")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
            "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
            "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
            "DAMAGE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted")
_ISC_END = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
            "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
            "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
            "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so")
_MIT_KEEP = (", subject to the following conditions: The above copyright notice and this permission notice shall be "
             "included in all copies or substantial portions of the Software")
_MIT_END = (". THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
            "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
            "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
            "OR OTHER DEALINGS IN THE SOFTWARE.")
_GNU = (("GPL-2.0", "", "2", "2.0"), ("GPL-3.0", "", "3", "3.0"), ("LGPL-2.0", "Library ", "2", "2.0"),
        ("LGPL-2.1", "Lesser ", "2.1", "2.1"), ("LGPL-3.0", "Lesser ", "3", "3.0"), ("AGPL-3.0", "Affero ", "3", "3.0"))
_CC = (("CC-BY", "Attribution"), ("CC-BY-SA", "Attribution-ShareAlike"), ("CC-BY-ND", "Attribution-NoDerivs"),
       ("CC-BY-NC", "Attribution-NonCommercial"), ("CC-BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
       ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivs"))
_CC_PORTS = (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"), ("1.0", "Generic"))


def _gnu_templates():
    """Sentences and file headers of every GNU licence and version."""
    for name, kind, n, v in _GNU:
        which = f"GNU {kind}General Public License"
        yield name, f"This work is licensed under the {which}, version {n}."
        yield name, f"Licensed under the {which} v{v}."
        yield name, f"Licensed under the {which} version {v}."
        for thing in ("program", "library", "software"):
            for use in (": you can", "; you can"):
                head = (f"This {thing} is free software{use} redistribute it and/or modify it under the terms of the {which} "
                        f"as published by the Free Software Foundation")
                yield name, f"{head}, either version {n} of the License"
                yield name, f"{head}; either version {n} of the License, or (at your option) any later version."
                yield name, f"{head}, version {n} of the License."
                yield name, f"{head}; version {n}."


def _cc_templates():
    """Long and short notices of every Creative Commons licence and version."""
    for name, long in _CC:
        for v, port in _CC_PORTS:
            full = long.replace("NoDerivs", "NoDerivatives") if v == "4.0" else long
            yield f"{name}-{v}", f"This work is licensed under a Creative Commons {full} {v} {port} License."
            yield f"{name}-{v}", f"Licensed under the Creative Commons {full} {v} {port} License."
            yield f"{name}-{v}", f"Creative Commons {full} {v} {port} License"
            yield f"{name}-{v}", f"Licensed under {name.replace('CC-', 'CC ')} {v}."


#: Licence notices in their usual public wording, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may "
                "not use this file except in compliance with the License."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("MIT", _MIT + _MIT_KEEP), ("MIT", _MIT + _MIT_KEEP + _MIT_END),
    ("MIT-0", _MIT + _MIT_END),
    ("BSD-2-Clause", _BSD), ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-2-Clause", "This project is licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "This project is licensed under the BSD 3-Clause License."),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", _ISC + "."), ("0BSD", _ISC + ". " + _ISC_END),
    ("ISC", "This project is licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    *_gnu_templates(), *_cc_templates(),
)
THRESHOLD = 0.8
#: Words that must be equal for two passages to share a result.
MEMO = 1024


def words_of(text: str) -> list[str]:
    """The lower-case words of a text; a word ends where it ends before lower-casing."""
    low = text.lower()
    if len(low) == len(text):
        return WORD.findall(low)
    return [w.lower() for w in WORD.findall(text)]


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Matcher:
    """Templates as bigram sets, and which templates hold a bigram."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.ids = [name for name, _ in templates]
        self.sets = []
        self.holders: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, (_, text) in enumerate(templates):
            w = words_of(text)
            grams = set(zip(w, w[1:], strict=False))
            self.sets.append(grams)
            for g in grams:
                self.holders[g].append(i)
        # size bounds: distinct bigrams of a passage that may reach the threshold
        self.low = [math.ceil(len(s) * threshold / (2 - threshold) - 1e-9) for s in self.sets]
        self.high = [math.floor(len(s) * (2 - threshold) / threshold + 1e-9) for s in self.sets]

    def _passage(self, t: int, own: set[int], i: int, values: list[int], after: dict[int, int]):
        """((length in words - 1, dice, gain), distance of the last place looked
        at, whether there was none after it) of the best passage from ``i``
        on, which ends at a bigram of the template. Stops when no further
        bigram can raise the coefficient."""
        size, most = len(self.sets[t]), self.high[t]
        best, common, pos, n, last = (0, 0.0, 0), 0, i, 0, i
        while pos >= 0 and n < most:
            n, last = n + 1, pos
            if values[pos] in own:
                common += 1
                score = 2 * common / (n + size)
                if score >= self.threshold and score > best[1]:
                    best = (pos + 1 - i, score, 4 * common - n - size)
            # at best all that is left of the template comes next, and nothing else
            if 2 * size / (n + 2 * size - common) <= max(best[1], self.threshold - 1e-9):
                return best, last - i, False
            pos = after[pos]
        return best, last - i, pos < 0

    def find(self, text: str) -> list[tuple[int, int, float, int]]:
        """(start, end, dice, template) of the licence passages, in code
        points, without overlaps: most shared less unshared bigrams first (so
        the full notice before a sentence of it, and the closest of a family),
        then the better coefficient, the earlier start and the order of the
        templates."""
        words = words_of(text)
        grams = list(zip(words, words[1:], strict=False))
        holding: dict[int, set] = defaultdict(set)  # template -> its bigrams in the text
        for g in {g for g in grams if g in self.holders}:
            for t in self.holders[g]:
                holding[t].add(g)
        holding = {t: own for t, own in holding.items() if len(own) >= self.low[t]}
        if not holding:
            return []
        numbers: dict[tuple[str, str], int] = {}
        ids = np.fromiter((numbers.setdefault(g, len(numbers)) for g in grams), np.int32, len(grams))
        inside = {t: {numbers[g] for g in own} for t, own in holding.items()}
        found, memo = [], {}
        # From the last word to the first: where each bigram occurs next, as a linked list in text order.
        # A passage from i on grows by the places of that list, so repeated notices cost no more than one.
        after: dict[int, int] = {}
        before: dict[int, int] = {}
        place: dict[int, int] = {}
        first = -1
        values = ids.tolist()
        for i in range(len(values) - 1, -1, -1):
            g = values[i]
            old = place.get(g)
            if old is not None:
                left, right = before.pop(old), after.pop(old)
                if left >= 0:
                    after[left] = right
                else:
                    first = right
                if right >= 0:
                    before[right] = left
            place[g], after[i], before[i] = i, first, -1
            if first >= 0:
                before[first] = i
            first = i
            for t, own in inside.items():
                if g in own:
                    key = (t, ids[i:i + MEMO].tobytes())
                    known = memo.get(key)
                    # a passage that ran out of new bigrams is shared only with one that does too
                    if known is None or (known[2] and after[i + known[1]] >= 0):
                        known = self._passage(t, own, i, values, after)
                        if known[1] < MEMO:
                            memo[key] = known
                    best = known[0]
                    if best[0]:
                        found.append((i, i + best[0], best[1], t, best[2]))
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        taken: list[tuple[int, int, float, int]] = []  # in text order
        for i, j, score, t, _ in sorted(found, key=lambda f: (-f[4], -f[2], f[0], f[3])):
            at = bisect_left(taken, (i,))
            if (at == 0 or taken[at - 1][1] < i) and (at == len(taken) or j < taken[at][0]):
                taken.insert(at, (i, j, score, t))
        return [(spans[i][0], spans[j][1], score, t) for i, j, score, t in taken]


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, license (id
    of the best passage, null if none), score, n_matches, licenses (distinct
    ids, sorted, comma-joined), spans (id:start:end of every passage in
    order, code points, end exclusive).

    One map over the input, no shuffle.

    Defined cases: a null text counts as empty and has no passage; of equal
    scores the longer template, then the earlier passage is best; repeated
    rows each get their row; very long texts are scanned whole; an empty
    table gives an empty result; extra columns are ignored whatever their
    names. Words are lower-cased one by one, so spans hold in every text.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("n_matches", T.LongType()), T.StructField("licenses", T.StringType()),
        T.StructField("spans", T.StringType())])

    def run(batches):
        m = Matcher(templates, threshold)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for value in batch.column(1):
                found = m.find(value.as_py() or "")
                best = min(found, key=lambda f: (-f[2], -len(m.sets[f[3]]), f[0], f[3]), default=None)
                for col, v in zip(out, (
                        m.ids[best[3]] if best else None, best[2] if best else 0.0, len(found),
                        ",".join(sorted({m.ids[f[3]] for f in found})),
                        ",".join(f"{m.ids[f[3]]}:{f[0]}:{f[1]}" for f in found)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())],
                names=[f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
