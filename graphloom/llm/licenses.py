"""Licence scan: Dice coefficient over word bigrams against licence templates.

Units of a document are its lines, its paragraphs of several lines and its
whole text.  A unit of a distinct bigrams and a template of b can only reach a
Dice coefficient t if t/(2-t) * b <= a <= (2-t)/t * b; these size bounds choose
the candidate templates of a unit by an equi-join on its size.  The same bound
says that t/(2-t) of a template's bigrams must occur, so a text that has none of
a small set of probe words (computed from the templates) holds no licence and is
not cut into units.

Only DataFrame functions run.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import let

# Public licence notices and texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_2 = next(t for n, t in TEMPLATES if n == "BSD-2-Clause")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Whole licence texts, as their files have them after the copyright line.
TEMPLATES += [
    ("MIT", "MIT License " + next(t for n, t in TEMPLATES if t.startswith("Permission is hereby")) + " " + _AS_IS),
    ("BSD-2-Clause", _BSD_2 + " " + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("ISC", next(t for n, t in TEMPLATES if n == "ISC") + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS.replace("OR COPYRIGHT HOLDERS ", "")),
]


def read_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Templates from whole licence files in a folder, named by their licences; a few files."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.txt)?$", 1), "value")
    return [tuple(r) for r in files.collect()]


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def _bigrams(text: str) -> list[str]:
    w = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def bounds(b: int, threshold: float) -> tuple[int, int]:
    """Sizes that can reach the threshold against b bigrams."""
    f = threshold / (2 - threshold)
    return math.ceil(f * b - 1e-9), math.floor(b / f + 1e-9)


def probe_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words such that a unit over the threshold for any template holds one of them.

    Such a unit has at least ``need`` of the template's m bigrams, so it has one
    of any m - need + 1; words are taken until they are part of that many.
    """
    chosen: list[str] = []
    for _, text in sorted(templates, key=lambda t: len(t[1])):
        grams = [g.split() for g in _bigrams(text)]
        target = len(grams) - bounds(len(grams), threshold)[0] + 1
        held = lambda: [g for g in grams if not any(w in chosen for w in g)]
        while len(grams) - len(held()) < target:
            left = held()
            counts = {w: sum(w in g for g in left) for g in left for w in g}
            # a long word first, so that ordinary prose seldom holds it
            chosen.append(max(counts, key=lambda w: (len(w) >= 5, counts[w], len(w), w)))
    return chosen


def _normal(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8,
) -> DataFrame:
    """``(doc_id, license, n_units, dice)``: the licences found in each document.

    n_units counts the distinct units over the threshold, dice is the best
    coefficient.  Words are lower-cased runs of a-z and 0-9.  Defined results: null and
    empty texts and units of fewer than two words have no licence; rows that
    share an id are one document; a null id is a document of its own; an empty
    table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    held, table = [], []
    for k, (name, text) in enumerate(templates):
        grams = _bigrams(text)
        low, high = bounds(len(grams), threshold)
        held.append((k, name, grams))
        table += [(n, k) for n in range(low, high + 1)]
    # one row for each template and size that can reach the threshold, and the templates: bounded by their length
    sized = F.broadcast(spark.createDataFrame(table, "n int, k int"))
    spelled = F.broadcast(spark.createDataFrame(held, "k int, license string, grams array<string>"))
    low = F.lower(F.col("text"))
    probed = F.lit(False)
    for word in probe_words(templates, threshold):
        probed = probed | F.contains(low, F.lit(word))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(probed)
    paragraphs = F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = F.array_distinct(F.concat(F.split("text", "\n"), paragraphs, F.array("text")))

    def grams(w: Column) -> Column:
        # get() reads one element; slice() would copy the array each time
        pair = lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))
        return F.when(F.size(w) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), pair)))

    each = docs.select("doc_id", F.explode(units).alias("unit")).where("length(unit) > 2")
    each = each.select("doc_id", "unit", let(_normal(F.col("unit")), grams).alias("has")).withColumn("n", F.size("has"))
    shared = F.size(F.array_intersect("has", "grams"))
    scored = each.join(sized, "n").join(spelled, "k").select(
        "doc_id", "license", F.xxhash64("unit").alias("unit"), (2.0 * shared / (F.col("n") + F.size("grams"))).alias("dice")
    )
    return scored.where(F.col("dice") >= threshold).groupBy("doc_id", "license").agg(
        F.countDistinct("unit").alias("n_units"), F.max("dice").alias("dice")
    )


def _sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    return rf"""
WITH t0 AS (SELECT * FROM (VALUES {rows}) t(k, license, body)),
t AS (
  SELECT k, license, list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM t0
), tg AS (
  SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t
), u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents
  UNION SELECT doc_id, p FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS p FROM documents) WHERE contains(p, chr(10))
  UNION SELECT doc_id, text FROM documents
), uw AS (
  SELECT doc_id, unit, list_filter(regexp_split_to_array(lower(unit), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM u
), ug AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS has FROM uw WHERE len(w) >= 2
), s AS (
  SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(has, g)) / (len(has) + len(g)) AS dice FROM ug, tg
)
SELECT doc_id, license, count(DISTINCT unit) AS n_units, max(dice) AS dice FROM s WHERE dice >= 0.8 GROUP BY doc_id, license
"""


#: DuckDB SQL of the query: every unit against every template.
SQL = _sql()
