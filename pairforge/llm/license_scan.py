"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates become words (ASCII letters and digits in lower case, and everything beyond
ASCII) and shingles of five words. Templates fall in size classes, each at most 1.25 times their
shingles; for a class c a text is cut into windows of 2c shingles that begin every c/2 shingles, so a
copy of up to one and a half times that length lies in one. Windows retrieve templates by BANDS MinHash
bands of one row each: at the least Jaccard similarity that a window with containment 0.8 can have,
0.8 / (1 + 2.5 - 0.8) = 0.29, all bands miss with probability (1 - 0.29)^40 < 2e-6. Retrieved templates
are verified by exact containment.

The index is inverted: it leads from the shingle that is a band's minimum (an anchor) to the templates
that have it there. A window can only share that band if it holds the anchor, so the anchors of a text
are joined with the index, and the windows around each are asked whether it is their minimum too; this
loses no collision, and its cost grows with what is found, not with the number of templates. Only built-in
functions; texts are not exchanged, only what is found.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, MinHash bands, and the least share of a template's shingles in a window.
WORDS, BANDS, CONTAINED = 5, 40, 0.8
#: Shingles of a stretch, the part of a text that goes with each of its anchors; rows of an index that may be broadcast.
STRETCH, MOST_INDEX = 1 << 10, 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

#: Notices as their licenses publish them. Fixed values.
TEMPLATES: dict[str, list[str]] = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "Artistic-2.0": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed"],
    "BSD-2-Clause": [_BSD_TWO],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _WARRANTY,
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}


def words_of(text: str) -> list[str]:
    return [x for x in re.split(SEPARATORS, text.lower()) if x]


def shingles_of(text: str) -> list[str]:
    """The distinct shingles of a template, in order."""
    words = words_of(text)
    if len(words) < WORDS:
        raise ValueError(f"a template needs {WORDS} words: {text!r}")
    return list(dict.fromkeys(" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)))


@lru_cache
def size_class(shingles: int) -> int:
    """The least class of at least so many shingles: 1, 2, 3 ... 8, 10, 12, 15 ..., each a quarter above the last."""
    size = 1
    while size < shingles:
        size = max(size + 1, size * 5 // 4)
    return size


def window_of(shingles: int) -> tuple[int, int]:
    """(shingles of a window, step between windows) for a template of so many shingles."""
    size = size_class(shingles)
    return 2 * size, max(1, size // 2)


def _least(hashes: Column, band: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band)))


def index_of(spark: SparkSession, templates: dict[str, list[str]]) -> tuple[DataFrame, list[int], int]:
    """(anchor, license, part, shingles, size, span, step, bands) by the anchor's hash; the anchors; the longest span.

    A few rows for each template, made once on the driver; ``bands`` are those in which the anchor is the least.
    """
    listed = [(name, i, shingles_of(text)) for name, texts in templates.items() for i, text in enumerate(texts)]
    given = [(name, i, s, len(s), *window_of(len(s))) for name, i, s in listed]
    rows = spark.createDataFrame(given, "license string, part int, shingles array<string>, size int, span int, step int").coalesce(1)
    hashed = rows.withColumn("h", F.transform("shingles", lambda x: F.xxhash64(x)))
    banded = hashed.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    least = F.array_min(F.transform("h", lambda h: F.struct(F.xxhash64(h, F.col("band")).alias("m"), h.alias("h"))))
    # Grouped on the driver: as many rows as templates times BANDS.
    found: dict[tuple, list[int]] = {}
    for r in banded.select("license", "part", "band", least["h"].alias("anchor")).collect():
        found.setdefault((r["license"], r["part"], r["anchor"]), []).append(r["band"])
    of = {(name, i): rest for name, i, *rest in given}
    index = [(anchor, name, i, *of[name, i], sorted(bands)) for (name, i, anchor), bands in found.items()]
    held = spark.createDataFrame(index, "anchor long, license string, part int, shingles array<string>, size int, span int, step int, bands array<int>").coalesce(1)
    return held if len(index) > MOST_INDEX else F.broadcast(held), sorted({x[0] for x in index}), max((x[5] for x in index), default=0)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, contained: float = CONTAINED, stretch: int = STRETCH) -> DataFrame:
    """One row per text and license found: (id, license, containment, first_shingle, n_windows).

    ``containment`` is the best share of a template's distinct shingles in one window, ``first_shingle``
    where the first such window begins (in shingles, from 0), ``n_windows`` how many windows verify. A
    license with several templates gives its best. Texts that are null, empty or shorter than a shingle
    have no license and no row; null ids and repeated rows are scanned like any other; other columns
    are not read; an empty table gives no rows. Of a very long text the words are held at once, shingles
    and hashes for one stretch at a time. Notices of fewer than five words can't be templates.
    """
    templates = TEMPLATES if templates is None else templates
    index, anchors, longest = index_of(df.sparkSession, templates)
    # The longest word of each shingle that may be an anchor: a text without any of them has no anchor.
    anchor_words = sorted({max(s.split(), key=lambda w: (len(w), w)) for texts in templates.values() for text in texts for s in shingles_of(text)})

    # Each explode of one element is a barrier: a filter pushed below it would compute its arrays anew, place by place.
    words = F.array_remove(F.split(F.lower(F.col("text")), SEPARATORS), "")
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where(F.col("text").isNotNull())
    rows = rows.select("id", F.explode(F.array(words)).alias("w")).where((F.size("w") >= WORDS) & F.arrays_overlap("w", F.array(*map(F.lit, anchor_words))))
    # The windows that begin in a stretch lie in it with their ends.
    begins = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - WORDS) / stretch).cast("int")), lambda k: k * stretch)
    rows = rows.withColumn("text_number", F.monotonically_increasing_id()).select("id", "text_number", "w", F.explode(begins).alias("base"))
    rows = rows.select("id", "text_number", "base", F.explode(F.array(F.when(F.size("w") <= stretch, F.col("w")).otherwise(F.slice("w", F.col("base") + 1, stretch + longest + WORDS)))).alias("w"))
    # Words are fetched by place: a slice would copy the whole array for every shingle.
    shingle = F.transform(F.sequence(F.lit(0), F.size("w") - WORDS), lambda i: F.concat_ws(" ", *(F.get("w", i + k) for k in range(WORDS))))
    rows = rows.where(F.size("w") >= WORDS).select("id", "text_number", "base", F.explode(F.array(shingle)).alias("s"))
    rows = rows.select("id", "text_number", "base", "s", F.explode(F.array(F.transform("s", lambda x: F.xxhash64(x)))).alias("h"))
    placed = F.filter(F.transform("h", lambda h, i: F.struct(i.alias("i"), h.alias("anchor"))), lambda x: x["anchor"].isin(anchors))
    rows = rows.select("id", "text_number", "base", "s", "h", F.explode(placed).alias("a")).select("id", "text_number", "base", "s", "h", "a.i", "a.anchor")

    # The templates that an anchor leads to, and the windows around it; places count from the stretch's begin.
    met = rows.join(index, "anchor")
    at = F.col("base") + F.col("i")
    first = F.greatest(F.col("base"), at - F.col("span") + 1)
    windows = F.transform(F.sequence(F.ceil(first / F.col("step")), F.floor(at / F.col("step"))), lambda k: k * F.col("step"))
    starts = F.filter(windows, lambda x: (x >= first) & (x < F.col("base") + stretch))
    met = met.select("id", "text_number", "license", "part", "anchor", "bands", "shingles", "size", "span", "base", "s", "h", F.explode(starts).alias("at"))
    own = lambda c: F.slice(c, (F.col("at") - F.col("base") + 1).cast("int"), F.col("span"))
    met = met.select("id", "text_number", "license", "part", "at", "anchor", "bands", "shingles", "size", F.explode(F.array(F.struct(own("s").alias("s"), own("h").alias("h")))).alias("x"))
    collides = F.exists("bands", lambda band: _least(F.col("x.h"), band) == F.xxhash64(F.col("anchor"), band))
    share = F.size(F.array_intersect("x.s", "shingles")) / F.col("size")
    verified = met.where(collides).select("id", "text_number", "license", "part", "at", share.alias("c")).where(F.col("c") >= contained)
    # Only what is found is exchanged. Several anchors lead to the same window.
    once = verified.groupBy("text_number", "license", "part", "at").agg(F.first("id").alias("id"), F.max("c").alias("c"))
    best = once.groupBy("text_number", "license").agg(F.first("id").alias("id"), F.max(F.struct("c", (-F.col("at")).alias("at"))).alias("best"), F.count("*").alias("n_windows"))
    return best.select(F.col("id").alias(id_col), "license", F.col("best.c").alias("containment"), (-F.col("best.at")).cast("long").alias("first_shingle"), "n_windows")


def oracle(templates: dict[str, list[str]] | None = None, contained: float = CONTAINED) -> str:
    """The same result by exact containment of every window, without MinHash, for DuckDB."""
    listed = [(name, i, shingles_of(text)) for name, texts in (TEMPLATES if templates is None else templates).items() for i, text in enumerate(texts)]
    values = ", ".join(f"('{name}', {i}, {len(s)}, {window_of(len(s))[0]}, {window_of(len(s))[1]}, '{x}')" for name, i, s in listed for x in s)
    return f"""
WITH t(license, part, size, span, step, shingle) AS (VALUES {values}),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(len(w) - {WORDS - 1})) AS i FROM words WHERE len(w) >= {WORDS}),
shingles AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {WORDS}], ' ') AS shingle FROM places),
hits AS (SELECT s.doc_id, t.license, t.part, t.size, t.span, t.step, s.i, s.shingle FROM shingles s JOIN t USING (shingle)),
windows AS (
  SELECT doc_id, license, part, size, shingle,
         unnest(range(CAST(greatest(0, ceil((i - span + 1) / step)) AS BIGINT), CAST(floor(i / step) AS BIGINT) + 1)) * step AS begins
  FROM hits),
shares AS (SELECT doc_id, license, part, begins, count(DISTINCT shingle) / any_value(size) AS c FROM windows GROUP BY doc_id, license, part, begins)
SELECT doc_id, license, max(c) AS containment, CAST(arg_min(begins, struct_pack(a := -c, b := begins)) AS BIGINT) AS first_shingle, count(*) AS n_windows
FROM shares WHERE c >= {contained} GROUP BY doc_id, license
"""
