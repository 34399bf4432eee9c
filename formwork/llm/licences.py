"""Licence scans: MinHash bands over overlapping text windows find templates, shingle containment
verifies them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwork.llm.common import Rolling, Texts, text_chunks, type_of

#: Notices of common licences, and full texts of short ones (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Full texts of long licences, as files (fixed values).
FULL = ("Apache-2.0", "CC0-1.0", "GPL-3.0", "MPL-2.0")
TEMPLATES |= {f"{name}-full": (files("formwork.llm") / "texts" / f"{name}.txt").read_text(encoding="utf-8") for name in FULL}

SHINGLE = 5
#: Letters and digits, and all bytes beyond ASCII, make words; A-Z become a-z.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _shingles(texts: list[bytes]) -> tuple[Texts, np.ndarray]:
    """The texts' words and the hash of the shingle that begins at each word but the last four."""
    t = Texts([x.translate(_FOLD) for x in texts])
    t.words()
    flat, starts, ends = t.spaced()
    n = max(0, len(starts) - SHINGLE + 1)
    return t, Rolling(np.frombuffer(flat, np.uint8)).of(starts[:n], ends[SHINGLE - 1 :]) if n else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Bands:
    """``bands`` of ``rows`` least hashes.  Windows of a power of two of shingles, next to the
    template's own number, begin at each shingle, or at each eighth of the window's length.

    A passage with 80 % of a template's shingles then has a window whose Jaccard similarity with the
    template is 0.5 or more; by 24 bands of 2 it collides with a probability above 0.998, and each
    neighbouring window is another chance."""

    bands: int = 24
    rows: int = 2

    @property
    def factors(self) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, self.bands * self.rows, dtype=np.uint64) | np.uint64(1)


@dataclass
class Index:
    """The templates' shingles, and for each level (log2 of the window) and band which templates
    have a key."""

    bands: Bands
    shingles: list[np.ndarray] = field(default_factory=list)
    keys: dict[int, list[dict[int, list[int]]]] = field(default_factory=dict)
    marks: dict[int, list[np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, templates: dict[str, str], bands: Bands) -> Index:
        out = cls(bands)
        for i, text in enumerate(templates.values()):
            _, h = _shingles([text.encode()])
            if not len(h):
                raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
            out.shingles.append(np.unique(h))
            level = round(np.log2(len(h)))
            if level not in out.keys:
                out.keys[level] = [defaultdict(list) for _ in range(bands.bands)]
                out.marks[level] = [np.zeros(1 << 16, bool) for _ in range(bands.bands)]
            least = [(h * f >> np.uint64(32)).astype(np.uint32).min(keepdims=True) for f in bands.factors]
            for b, key in enumerate(_band_keys(least, bands)):
                out.keys[level][b][int(key[0])].append(i)
                out.marks[level][b][int(key[0]) >> 48] = True
        return out

    def retrieved(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, window's first shingle, its end) of all windows that share a band.

        Windows may reach beyond the last shingle, so that each shingle begins windows of all levels."""
        found: set[tuple[int, int, int]] = set()
        bands, factors = self.bands, self.bands.factors
        beyond = np.full(1 << max(self.keys), 0xFFFFFFFF, np.uint32)
        for b in range(bands.bands):
            least = [np.append((h * f >> np.uint64(32)).astype(np.uint32), beyond) for f in factors[b * bands.rows : (b + 1) * bands.rows]]
            step = 1
            for level in range(max(self.keys) + 1):
                if level:
                    half = (1 << (level - 1)) // step
                    stride = 2 if level > 3 else 1
                    least = [np.minimum(x[: max(0, len(x) - half)], x[half:])[::stride] for x in least]
                    step *= stride
                if level in self.keys:
                    key = _band_keys([x[: -(-len(h) // step)] for x in least], bands)[0]
                    for at in np.flatnonzero(self.marks[level][b][key >> np.uint64(48)]).tolist():
                        for i in self.keys[level][b].get(int(key[at]), ()):
                            found.add((i, at * step, at * step + (1 << level)))
        return found


def _band_keys(least: list[np.ndarray], bands: Bands) -> list[np.ndarray]:
    out = []
    for b in range(0, len(least), bands.rows):
        key = np.zeros(len(least[b]), np.uint64)
        for x in least[b : b + bands.rows]:
            key = (key ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out.append(key)
    return out


def _verified(h: np.ndarray, low: int, high: int, windows: list[tuple[int, int]], template: np.ndarray, least: float) -> Iterator[tuple[int, int, int]]:
    """(first shingle, last, shared) of passages in a text's shingles low..high: those around the
    windows where runs of the template's shingles, less than its length apart, have enough of them."""
    margin, reach = len(template), -1
    regions: list[list[int]] = []
    for a, b in sorted(windows):
        a, b = max(low, a - margin), min(high, b + margin)
        if a <= reach:
            regions[-1][1] = max(regions[-1][1], b)
        else:
            regions.append([a, b])
        reach = regions[-1][1]
    for a, b in regions:
        at = a + np.flatnonzero(np.isin(h[a:b], template))
        for part in np.split(at, np.flatnonzero(np.diff(at) > margin) + 1) if len(at) else ():
            shared = len(np.unique(h[part]))
            if shared >= least * len(template):
                yield int(part[0]), int(part[-1]), shared


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, bands: Bands = Bands(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:  # noqa: B008
    """Licence notices in texts: ``doc_id, licence, start_word, end_word, n_shingles, shared, containment``.

    One row for each passage that has at least ``containment`` of a template's 5-word shingles;
    words are runs of letters and digits, without regard to ASCII case, and end_word is exclusive.
    Windows of all whole texts are retrieved by MinHash bands (``Bands``), and the shingles of the
    texts around them are counted exactly.  The templates are an argument that each task holds,
    their number doesn't grow with the data.

    Null and empty texts and those under five words have no passages; repeated rows have theirs
    each; an empty table gives no rows; other columns are ignored.
    """
    chosen = TEMPLATES if templates is None else templates
    names = list(chosen)
    schema = "licence string, start_word long, end_word long, n_shingles long, shared long, containment double"

    def rows(batches) -> Iterator[pa.RecordBatch]:
        index = Index.of(chosen, bands)
        for part, chunk in text_chunks(batches, 1 << 20):
            t, h = _shingles(chunk)
            ids, out = part.column(0).to_pylist(), defaultdict(list)
            for i, a, b in index.retrieved(h):
                first, last = np.searchsorted(t.first, [a, min(b, len(h)) - 1], side="right") - 1
                for text in range(int(first), int(min(last, len(chunk) - 1)) + 1):
                    out[text, i].append((a, b))
            found = []
            for (text, i), windows in sorted(out.items()):
                low, high = int(t.first[text]), int(t.first[text + 1]) - SHINGLE + 1
                if high > low:
                    n = len(index.shingles[i])
                    found += [(ids[text], names[i], a - low, b - low + SHINGLE, n, shared, shared / n) for a, b, shared in _verified(h, low, min(high, len(h)), windows, index.shingles[i], containment)]
            columns = list(zip(*found)) if found else [()] * 7
            kinds = (part.schema.field("doc_id").type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "licence", "start_word", "end_word", "n_shingles", "shared", "containment"])

    whole = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    texts = docs.select(F.col(id_column).alias("doc_id"), whole)
    return texts.mapInArrow(rows, f"doc_id {type_of(texts, 'doc_id')}, {schema}")
