"""Licence notices and texts in documents, by Dice coefficient over word bigrams.

Texts and templates are normalised alike: A-Z lower-cased, every run of other
characters than a-z and 0-9, line breaks too, one space. With n and m distinct bigrams
in a window of a text and in a template, k of them common, the coefficient is
2k / (n + m). A window is as long as the template (or the whole text, if shorter).

A window that reaches LEAST percent holds more than two thirds of the template's
distinct bigrams, so any third of them, and one more, has one in it. The third of the
longest words, the rarest as a rule, are the template's anchors. Each anchor in a
text puts a window where the template would begin, whatever stands before or behind
it and wherever lines break. Sizes then prune: a text too short to reach LEAST with a
template is not compared with it.

All of it is array expressions within a row: no row is multiplied or moved, and a
text without anchors, nearly every one, ends after one look at its bigrams.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Percent of a full match that a window needs.
LEAST = 80

# Fixed texts of licences and of the notices that refer to them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""

TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE),
    "BSD-2-Clause": (_BSD_TWO + _BSD_END,),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD_TWO + _BSD_THIRD + _BSD_END),
    "BSL-1.0": (_BOOST,),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "GPL-2.0": (_GPL.format(2),),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _GPL.format(3)),
    "ISC": (_ISC,),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _MIT),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", _MPL),
    "Unlicense": (_UNLICENSE,),
    "Zlib": (_ZLIB,),
}


def bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


class Shape:
    """A template's bigrams, their set and the places of its anchors."""

    def __init__(self, order: int, text: str):
        self.order, self.grams = order, bigrams(text)
        self.set = list(dict.fromkeys(self.grams))
        rare = sorted(self.set, key=lambda g: (-len(g), g))[: len(self.set) // 3 + 1]
        self.anchors = [(g, i) for i, g in enumerate(self.grams) if g in rare]


def shapes_of(templates: dict[str, tuple[str, ...]]) -> list[Shape]:
    return [Shape(i, t) for i, name in enumerate(sorted(templates)) for t in templates[name]]


def normalised_words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " ")), " ")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, license, dice, n_licenses: one row per input row.

    license and dice are those of the best window (ties: first name in order), null
    if none reaches LEAST percent; n_licenses counts the distinct licences found.
    Null and empty texts match nothing; texts of any length are read whole; repeated
    rows get equal results; extra columns are ignored; an empty table gives no rows.
    """
    shapes, names = shapes_of(templates), sorted(templates)
    anchors: dict[str, list[Column]] = {}
    for k, s in enumerate(shapes):
        for gram, at in s.anchors:
            anchors.setdefault(gram, []).append(F.struct(F.lit(k).alias("k"), F.lit(at).alias("at"), F.lit(len(s.grams)).alias("m")))
    places = F.create_map(*[c for gram, found in anchors.items() for c in (F.lit(gram), F.array(*found))])
    sets, orders = F.array(*[F.array(*map(F.lit, s.set)) for s in shapes]), F.array(*[F.lit(s.order) for s in shapes])
    known = list(anchors)
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised_words(F.col(text_col).cast("string")).alias("__words"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("__words") - 2), lambda i: F.concat(F.get("__words", i), F.lit(" "), F.get("__words", i + 1))
    )
    rows = rows.select("doc_id", F.when(F.size("__words") > 1, pairs).alias("__pairs"))
    hits = F.array_compact(F.transform("__pairs", lambda g, i: F.when(g.isin(known), F.struct(g.alias("g"), i.alias("i")))))
    rows = rows.withColumn("__hits", hits)
    n = F.size("__pairs")
    # Where the template would begin, moved into the text.
    starts = F.flatten(F.transform("__hits", lambda h: F.transform(
        F.element_at(places, h["g"]), lambda p: F.struct(p["k"].alias("k"), p["m"].alias("m"), F.greatest(F.lit(0), F.least(h["i"] - p["at"], n - p["m"])).alias("s"))
    )))
    # Windows are at most n long, so this size is what they can have in common.
    fits = lambda w: 200 * F.least(n, w["m"]) >= LEAST * (F.least(n, w["m"]) + F.size(F.get(sets, w["k"])))
    rows = rows.withColumn("__windows", F.when(F.size("__hits") > 0, F.filter(F.array_distinct(starts), fits)))

    def scored(w: Column) -> Column:
        have, want = F.array_distinct(F.slice("__pairs", w["s"] + 1, w["m"])), F.get(sets, w["k"])
        return F.struct((2.0 * F.size(F.array_intersect(have, want)) / (F.size(have) + F.size(want))).alias("dice"), (-F.get(orders, w["k"])).alias("order"))

    found = F.filter(F.transform("__windows", scored), lambda x: 100 * x["dice"] >= LEAST)
    rows = rows.select("doc_id", found.alias("__found")).withColumn("__top", F.array_max("__found"))
    return rows.select(
        "doc_id", F.get(F.array(*map(F.lit, names)), -F.col("__top.order")).alias("license"), F.col("__top.dice").alias("dice"),
        F.coalesce(F.size(F.array_distinct(F.transform("__found", lambda x: x["order"]))), F.lit(0)).cast("long").alias("n_licenses"),
    )


def oracle(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> str:
    """The same in DuckDB, by unnesting and joining."""
    shapes, names = shapes_of(templates), sorted(templates)
    lists = ", ".join(f"({k}, {-s.order}, '{names[s.order]}', {len(s.grams)}, [{', '.join(map(repr, s.set))}])" for k, s in enumerate(shapes))
    places = ", ".join(f"({gram!r}, {k}, {at})" for k, s in enumerate(shapes) for gram, at in s.anchors)
    return f"""
WITH t(k, o, license, m, grams) AS (VALUES {lists}),
anchors(g, k, p) AS (VALUES {places}),
words AS (
  SELECT row_number() OVER () AS row, doc_id,
    string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
pairs AS (SELECT row, doc_id, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS gs FROM words),
listed AS (SELECT row, len(gs) AS n, unnest(gs) AS g, unnest(range(len(gs))) AS i FROM pairs WHERE len(gs) > 0),
windows AS (
  SELECT DISTINCT row, n, k, greatest(0, least(i - p, n - m)) AS s FROM listed JOIN anchors USING (g) JOIN t USING (k)
  WHERE 200 * least(n, m) >= {LEAST} * (least(n, m) + len(grams))),
cut AS (SELECT row, o, license, grams, list_distinct(gs[s + 1:s + m]) AS have FROM windows JOIN t USING (k) JOIN pairs USING (row)),
hits AS (
  SELECT * FROM (SELECT row, o, license, 2.0 * len(list_intersect(have, grams)) / (len(have) + len(grams)) AS dice FROM cut) WHERE 100 * dice >= {LEAST}),
best AS (SELECT row, license, dice, row_number() OVER (PARTITION BY row ORDER BY dice DESC, o DESC) AS r, count(*) OVER (PARTITION BY row) AS c FROM hits),
counted AS (SELECT row, count(DISTINCT o) AS n_licenses FROM hits GROUP BY row)
SELECT p.doc_id, b.license, b.dice::DOUBLE AS dice, coalesce(c.n_licenses, 0)::BIGINT AS n_licenses
FROM pairs p LEFT JOIN best b ON b.row = p.row AND b.r = 1 LEFT JOIN counted c ON c.row = p.row
"""
