"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A template of m five-word shingles is looked for in every window of m shingles of a text (step 1, so windows overlap).
A window's signature is BANDS * ROWS MinHash values, the minima of as many hashes of its shingles, taken from a table of
minima over runs of 1, 2, 4, ... shingles. A window retrieves the templates of its size with which it shares all ROWS
values of a band: at Jaccard J with a probability of 1 - (1 - J^ROWS)^BANDS, 99.99 % at J = 2/3, the least that a
containment of 0.8 allows. Verification counts the template's distinct shingles in the window.

As a value is shared only if the template's minimal shingle stands in the window, texts without any of these get no
signatures: they could retrieve nothing.

Licenses that differ in a number have like notices, so of overlapping notices only the one of most containment
counts, of equal ones the longest.

Everything is local to a text: no shuffle, and tasks hold one batch.

Cases: a null or empty text has no licenses. Repeated rows are scanned each. Very long texts cost in proportion to their
length. A template of fewer than five words is refused. Other columns are kept; a column of the name of the result is
replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textnum

BANDS, ROWS = 16, 2
CONTAINMENT = 0.8
#: Notices by which works name their license, and texts of short licenses. A notice of fewer than five
#: words has no shingle.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "Licensed under the ISC License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, Version 2.0."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
for _name, _text in {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD} {_AS_IS}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}.items():
    TEMPLATES[_name].append(_text)
for _code, _title in {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    for _v, _port in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES[f"CC-{_code}-{_v}"] = [
            *(f"{x} under {y}CC {_code} {_v}{z}" for x in ("Licensed", "Released") for y in ("", "a ") for z in (".", "", " license.")),
            f"This work is licensed under a Creative Commons {_title} {_v} {_port} License.",
            f"Licensed under the Creative Commons {_title} {_v} {_port} License.",
        ]


class Index:
    """The templates' shingles and band values."""

    def __init__(self, templates: dict[str, list[str]], bands: int = BANDS, rows: int = ROWS):
        self.names, self.sets, self.bands, self.rows = [], [], bands, rows
        for name, texts in templates.items():
            for text in texts:
                (s,) = textnum.shingle_sets(pa.array([text]))
                if len(text.split()) < 5:
                    raise ValueError(f"template of fewer than five words: {text!r}")
                self.names.append(name)
                self.sets.append(s)
        self.seeds = textnum.mix(np.arange(101, 101 + bands * rows, dtype=np.uint64))
        self.signatures = [textnum.mix(s ^ seed).min() for s in self.sets for seed in self.seeds]
        self.signatures = np.array(self.signatures, np.uint64).reshape(len(self.sets), -1)
        anchors: dict[int, set[int]] = {}
        for t, s in enumerate(self.sets):
            for seed in self.seeds:
                anchors.setdefault(int(s[np.argmin(textnum.mix(s ^ seed))]), set()).add(t)
        self.keys = np.array(sorted(anchors), np.uint64)
        self.of = [sorted(anchors[int(k)]) for k in self.keys]

    def retrieved(self, s: np.ndarray, wanted: list[int]) -> dict[int, np.ndarray]:
        """Per template of `wanted` the places of the windows that share a band with it."""
        runs = [np.stack([textnum.mix(s ^ seed) for seed in self.seeds])]
        out = {}
        for m in sorted({len(self.sets[t]) for t in wanted}):
            if m >= len(s):
                least = runs[0].min(1, keepdims=True)
            else:
                k = m.bit_length() - 1
                while len(runs) <= k:
                    d = 1 << len(runs) - 1
                    runs.append(np.minimum(runs[-1][:, :-d], runs[-1][:, d:]))
                n = len(s) - m + 1
                least = np.minimum(runs[k][:, :n], runs[k][:, m - (1 << k) : m - (1 << k) + n])
            for t in wanted:
                if len(self.sets[t]) == m:
                    same = (least == self.signatures[t][:, None]).reshape(self.bands, self.rows, -1)
                    out[t] = np.flatnonzero(same.all(1).any(0))
        return out

    def scan(self, s: np.ndarray, containment: float = CONTAINMENT) -> list[tuple[int, int, int, float]]:
        """(template, first shingle, end shingle, containment) of the best window of each place in a text's shingles."""
        if not len(s):
            return []
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        wanted = sorted({t for k in np.unique(at[self.keys[at] == s]) for t in self.of[k]})
        result = []
        for t, places in self.retrieved(s, wanted).items() if wanted else ():
            m, done = len(self.sets[t]), -1
            known = np.isin(s, self.sets[t]) if len(places) else None
            for first in places:
                if first < done:
                    continue
                # the best window of those that begin within this one
                best, where = 0, first
                for b in places[(places >= first) & (places < first + m)]:
                    n = len(np.unique(s[b : b + m][known[b : b + m]]))
                    if n > best:
                        best, where = n, b
                if best >= containment * m - 1e-9:
                    result.append((t, int(where), int(min(where + m, len(s))), best / m))
                    done = where + m
        return result

    def apart(self, hits: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of hits that overlap the one of most containment, then the longest; equal ones of different licenses all stay."""
        taken = np.full(max((hi for _, _, hi, _ in hits), default=0), -1)
        kept: list[tuple[int, int, int, float]] = []
        for hit in sorted(hits, key=lambda x: (-x[3], x[1] - x[2], x[1])):
            t, lo, hi, c = hit
            over = [kept[k] for k in np.unique(taken[lo:hi]) if k >= 0]
            if all((y - x, d) == (hi - lo, c) and self.names[u] != self.names[t] for u, x, y, d in over):
                taken[lo:hi] = len(kept)
                kept.append(hit)
        return kept


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """docs with `licenses`: array<struct<name, first, last, containment>>, first and last word of each notice (from 0)."""
    scratch.ship(docs.sparkSession)
    index = Index(TEMPLATES if templates is None else templates)
    docs = docs.drop("licenses")
    names = docs.columns
    at = names.index("text")
    kind = pa.list_(pa.struct([("name", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("containment", pa.float64())]))
    schema = docs.withColumn("licenses", F.lit(None).cast("array<struct<name:string,first:int,last:int,containment:double>>")).schema

    def run(batches):
        for b in batches:
            found = []
            for _, data, offsets in textnum.slices(b.column(at)):
                h, row, bounds = textnum.words(data, offsets)
                s, r = textnum.shingles(h, row, bounds)
                near = np.searchsorted(index.keys, s)
                has = set(r[index.keys[np.minimum(near, len(index.keys) - 1)] == s].tolist())
                cut = np.searchsorted(r, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    hits = index.scan(s[cut[i] : cut[i + 1]], containment) if i in has else []
                    best: dict[tuple, float] = {}
                    for t, lo, hi, c in index.apart(hits):
                        best[index.names[t], lo, hi + 3] = c
                    found.append([{"name": k[0], "first": k[1], "last": k[2], "containment": c} for k, c in sorted(best.items(), key=lambda x: (x[0][1], x[0]))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*names, "licenses"])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = F.col("licenses")
    return scan(docs).select(
        "doc_id",
        F.size(x).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda l: l["name"]))), ",").alias("licenses"),
        F.array_join(F.transform(x, lambda l: F.concat_ws(":", l["name"], l["first"].cast("string"), l["last"].cast("string"))), ",").alias("spans"),
    )
