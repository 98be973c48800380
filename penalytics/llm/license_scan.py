"""Licence notices in documents, by Dice coefficient over word bigrams. DataFrame functions only.

The text is normalised (lower case; everything but letters, digits and line ends
becomes a space) and looked at whole, by paragraph and by line. A unit and a
template are compared by the Dice coefficient of their bags of word bigrams,
2 |A and B| / (|A| + |B|). Two exact bounds prune before that:

* size: a coefficient of t needs sizes within a factor (2 - t) / t of each other;
* anchors: it also needs t / (2 - t) of the template's bigrams, so a unit without
  any of a template's remaining share + 1 bigrams (those with numbers or long words)
  can't match, and neither can a text without the words of any of them.

Each unit gets the template with the largest coefficient (ties: the name that
comes first). A licence that no such unit shows is looked for inside the text, over
the ends of sentences, lines and paragraphs: windows of a template's own size are
laid where one of its anchors occurs; those that reach the threshold are taken in the
order of their common bigrams, each unless one that was taken overlaps it. A window has no
context: "not released under the MIT License" shows MIT. There is no join and no
shuffle: every row is judged on its own.

Defined results: null and empty texts, and texts without a match, have no licence
(null), an empty list and a coefficient of 0. Repeated rows each get their result. Very long
texts are scanned whole; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

THRESHOLD = 0.8

# Wordings of public licences' notices.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("BSD-3-Clause", "Released under the 3-clause BSD License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
]

_SHORT_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_THIRD_BSD = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""


def _gnu(licence: str, version: str, what: str = "program") -> str:
    """The notice that the GNU licences ask for."""
    return f"""This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {licence} as published
by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {what} is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU {licence} for more details."""


# Further licences, full texts, and paragraphs that occur in one licence only.
FURTHER: list[tuple[str, str]] = [
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("AGPL-3.0", """The GNU Affero General Public License is a free, copyleft license for software and other kinds of works,
specifically designed to ensure cooperation with the community in the case of network server software."""),
    ("Apache-2.0", """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1
through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting
the License."""),
    ("BSD-2-Clause", _SHORT_BSD),
    ("BSD-2-Clause", _SHORT_BSD + _BSD_DISCLAIMER),
    ("BSD-2-Clause", "Released under the 2-clause BSD License."),
    ("BSD-3-Clause", _SHORT_BSD + _THIRD_BSD + _BSD_DISCLAIMER),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)"""),
    ("CC0-1.0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to
this software to the public domain worldwide. This software is distributed without any warranty."""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-2.0", """The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU
General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free
for all its users."""),
    ("GPL-3.0", """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for
most software and other practical works are designed to take away your freedom to share and change the works."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("LGPL-3.0", """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU
General Public License, supplemented by the additional permissions listed below."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions"""),
    *((name, f"SPDX-License-Identifier: {name}{more}") for name in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
      for more in ("", "-only", "-or-later")),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("BSD-2-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "ISC", "MPL-2.0",
                                                              "Unlicense", "Zlib")),
]


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes that a unit may have to reach the threshold with a template of ``size`` bigrams."""
    ratio = (2 - threshold) / threshold
    return math.ceil(size / ratio - 1e-9), math.floor(size * ratio + 1e-9)


def anchors(grams: list[str], threshold: float) -> list[str]:
    """Bigrams of which a matching unit must hold one: those with numbers or long words, which are rare in prose."""
    spare = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
    return sorted(grams, key=lambda g: (-8 * any(c.isdigit() for c in g) - max(map(len, g.split())), g))[: spare + 1]


def marks(wanted: list[str], long: int = 6) -> list[tuple[str, ...]]:
    """Words of which a text must hold all of one entry to hold an anchor: a long word, or else both words."""
    words = {max(a.split(), key=lambda w: (len(w), w)) for a in wanted}
    words = {w for w in words if len(w) >= long}
    one = sorted(w for w in words if not any(o != w and o in w for o in words))
    return [(w,) for w in one] + sorted({tuple(a.split()) for a in wanted if not any(w in a for w in one)})


def _units(text: Column) -> Column:
    """Whole text, paragraphs and lines, normalised, as arrays of words."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    lined = F.regexp_replace(spaced, r" ?\n ?", "\n")
    units = F.flatten(F.transform(F.array(lined), lambda t: F.concat(
        F.array(F.regexp_replace(t, "\n+", " ")), F.transform(F.split(t, "\n\n+"), lambda p: F.translate(p, "\n", " ")),
        F.split(t, "\n"))))
    return F.transform(units, lambda u: F.trim(u))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice (of the best unit), licenses (sorted, comma-joined), n_units of every row."""
    entries = [(name, bigrams(text)) for name, text in templates or TEMPLATES + FURTHER]
    known = [(name, Counter(grams), len(grams)) for name, grams in entries]
    if any(size < 1 for _, _, size in known):
        raise ValueError("a template needs two words")
    bounds = [size_bounds(size, threshold) for _, _, size in known]
    least, most = min(b[0] for b in bounds), max(b[1] for b in bounds)
    wanted = sorted({a for _, grams, _ in known for a in anchors(list(grams.elements()), threshold)})

    def words_in(unit: Column) -> Column:
        return F.length(unit) - F.length(F.translate(unit, " ", "")) + 1

    def pairs(words: Column) -> Column:
        n = F.size(words) - 1
        return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))

    def dice(unit: Column, grams: Counter, size: int, bound: tuple[int, int]) -> Column:
        table = F.expr("array(" + ", ".join(f"named_struct('g', '{g}', 'c', {c})" for g, c in sorted(grams.items())) + ")")
        shared = F.aggregate(table, F.lit(0), lambda total, t: total + F.least(
            t["c"], F.size(F.filter(unit, lambda x: x == t["g"]))))
        return F.when(F.size(unit).between(*bound), shared * 2.0 / (F.size(unit) + size)).otherwise(0.0)

    def listed(grams: list[str]) -> dict[str, list[int]]:
        """The template's anchors with their places in it."""
        own = set(anchors(grams, threshold))
        return {g: [i for i, x in enumerate(grams) if x == g] for g in sorted(own)}

    # one literal for all templates: name, size, number of repeated bigrams, bigrams with counts, anchors with places
    literals = F.expr("array(" + ", ".join(
        f"named_struct('name', '{name}', 'size', {len(grams)}, 'again', {len(grams) - len(set(grams))}, 'set', array("
        + ", ".join(f"'{g}'" for g in sorted(set(grams))) + "), 'bag', array("
        + ", ".join(f"named_struct('g', '{g}', 'c', {c})" for g, c in sorted(Counter(grams).items())) + "), 'anchors', array("
        + ", ".join(f"named_struct('g', '{g}', 'o', {o})" for g, places in listed(grams).items() for o in places) + "))"
        for name, grams in entries) + ")")

    def windows(whole_text: Column, places: Column, t: Column) -> Column:
        """Windows of the template's size at its anchors that reach the threshold."""
        starts = F.array_distinct(F.flatten(F.transform(t["anchors"], lambda a: F.transform(
            F.filter(places, lambda p: p["g"] == a["g"]), lambda p: p["i"] - a["o"]))))
        cut = F.transform(starts, lambda s: F.struct(F.greatest(s, F.lit(0)).alias("start"), F.slice(
            whole_text, F.greatest(s, F.lit(0)) + 1, F.greatest(t["size"] + F.least(s, F.lit(0)), F.lit(0))).alias("w")))
        # the common bigrams are no more than the distinct common ones and the template's repeated ones
        able = F.filter(cut, lambda c: (F.size(F.array_intersect(c["w"], t["set"])) + t["again"]) * 2.0
                        >= threshold * (F.size(c["w"]) + t["size"]) - 1e-9)
        counted = F.transform(able, lambda c: F.struct(F.aggregate(t["bag"], F.lit(0), lambda n, g: n + F.least(
            g["c"], F.size(F.filter(c["w"], lambda x: x == g["g"])))).alias("shared"), c["start"], F.size(c["w"]).alias("n")))
        hits = F.transform(counted, lambda c: F.struct(
            (-c["shared"]).alias("fewer"), (-c["shared"] * 2.0 / (c["n"] + t["size"])).alias("less"), t["name"].alias("name"),
            c["start"].alias("start"), (c["start"] + c["n"]).alias("stop")))
        return F.filter(hits, lambda h: h["less"] <= -threshold)

    def inside(whole_text: Column) -> Column:
        """Windows of all templates in the bigrams of a text."""
        places = F.array_compact(F.transform(whole_text, lambda g, i: F.when(g.isin(wanted), F.struct(g.alias("g"), i.alias("i")))))
        return F.flatten(F.transform(F.array(places), lambda p: F.flatten(F.transform(
            F.filter(literals, lambda t: F.size(p) > 0), lambda t: windows(whole_text, p, t)))))

    # An anchor's longer word is a word of the text: one look-up for each word leaves few texts to the marks.
    longer = F.array(*[F.lit(w) for w in sorted({max(a.split(), key=lambda w: (len(w), w)) for a in wanted})])
    # bound to a name by the one-element array, so that the text is lowered once
    marked = F.exists(F.array(F.lower(whole(F.col(text_col)))), lambda t: F.arrays_overlap(F.split(t, r"[^\p{L}\p{N}]+"), longer) & reduce(
        lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(t, F.lit(w)) for w in entry]) for entry in marks(wanted)]))
    text = F.when(marked, whole(F.col(text_col))).otherwise(F.lit(""))
    sized = F.filter(_units(text), lambda u: words_in(u).between(least + 1, most + 1))
    grams = F.transform(F.transform(sized, lambda u: F.split(u, " ")), pairs)
    likely = F.filter(grams, lambda g: F.exists(g, lambda x: x.isin(wanted)))
    # the best template of a unit: the largest coefficient, then the first name
    scored = F.transform(likely, lambda g: F.array_sort(F.array(*[
        F.struct((-dice(g, own, size, bound)).alias("less"), F.lit(name).alias("name"))
        for (name, own, size), bound in zip(known, bounds)]))[0])
    every = F.transform(F.array(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")), pairs)
    found = docs.select(F.col(id_col).alias("doc_id"), F.filter(scored, lambda s: s["less"] <= -threshold).alias("units"),
                        F.flatten(F.transform(every, inside)).alias("hits"))
    # windows are taken in order (most common bigrams first), each unless one that was taken overlaps it
    taken = F.aggregate(F.array_sort("hits"), F.slice("hits", 1, 0), lambda own, h: F.when(F.exists(
        own, lambda o: (o["start"] < h["stop"]) & (h["start"] < o["stop"])), own).otherwise(F.array_append(own, h)))
    # and only licences that no unit shows
    more = F.filter(taken, lambda h: ~F.exists("units", lambda u: u["name"] == h["name"]))
    found = found.select("doc_id", F.concat("units", F.transform(more, lambda h: F.struct(h["less"], h["name"]))).alias("found"))
    best = F.array_min("found")
    return found.select(
        "doc_id", best["name"].alias("license"), F.round(F.coalesce(-best["less"], F.lit(0.0)), 6).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda s: s["name"]))), ",").alias("licenses"),
        F.size("found").cast("long").alias("n_units"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, without anchors."""
    rows = ",\n".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
    return rf"""
WITH templates(name, body) AS (VALUES {rows}),
bags AS (
  SELECT row_number() OVER () AS t, name, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS grams
  FROM (SELECT name, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM templates)),
template_grams AS (
  SELECT t, name, size, g, count(*) AS c FROM (SELECT t, name, len(grams) AS size, unnest(grams) AS g FROM bags) GROUP BY ALL),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS n
  FROM documents),
units AS (
  SELECT r, generate_subscripts(u, 1) AS k, trim(regexp_replace(unnest(u), '\n+', ' ', 'g')) AS unit
  FROM (SELECT r, list_concat(list_concat([n], regexp_split_to_array(n, '\n\n+')), string_split(n, chr(10))) AS u FROM texts)),
unit_grams AS (
  SELECT r, k, size, g, count(*) AS c FROM (
    SELECT r, k, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
    FROM (SELECT r, k, string_split(unit, ' ') AS w FROM units) WHERE len(w) BETWEEN 2 AND 400) GROUP BY ALL),
scores AS (
  SELECT r, k, name, sum(least(u.c, t.c)) * 2.0 / (any_value(u.size) + any_value(t.size)) AS dice
  FROM unit_grams u JOIN template_grams t USING (g) GROUP BY r, k, t.t, name),
best AS (
  SELECT r, k, arg_min(name, (-dice, name)) AS name, max(dice) AS dice FROM scores WHERE dice >= {threshold} GROUP BY r, k),
found AS (
  SELECT r, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, count(*) AS n,
         string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM best GROUP BY r)
SELECT doc_id, license, round(coalesce(dice, 0.0), 6) AS dice, coalesce(licenses, '') AS licenses, coalesce(found.n, 0) AS n_units
FROM texts LEFT JOIN found USING (r)"""
