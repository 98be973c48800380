"""Coefficients against brute force in Python; the plan holds no Python and no shuffle."""
import random
import re
from collections import Counter

from penalytics.llm import license_scan as L
from penalytics.sources.tables import table_path


def brute(text, threshold=L.THRESHOLD):
    text = re.sub(r" ?\n ?", "\n", re.sub(r"[^\w\n]+|_+", " ", (text or "").lower()))
    hits = []
    for unit in [text, *re.split(r"\n\n+", text), *text.split("\n")]:
        own = Counter(L.bigrams(unit))
        best = min(((-2 * sum((own & Counter(L.bigrams(body))).values()) / (sum(own.values()) + len(L.bigrams(body))), name)
                    for name, body in L.TEMPLATES))
        if -best[0] >= threshold:
            hits.append(best)
    if not hits:
        return None, 0.0, "", 0
    return min(hits)[1], round(-min(hits)[0], 6), ",".join(sorted({n for _, n in hits})), len(hits)


def result(r):
    return r.license, r.dice, r.licenses, r.n_units


def test_documents(spark, small):
    docs = spark.read.parquet(table_path(small, "documents"))
    found = L.scan(docs).collect()
    expected = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert {r.doc_id: result(r) for r in found} == expected
    assert any(v[0] for v in expected.values())


def test_edited_templates_and_odd_rows(spark, docs_of):
    rng, rows = random.Random(2), [(0, None), (0, None), (None, ""), (1, "\n\n \n"), (2, "word")]
    for i, (_, body) in enumerate(L.TEMPLATES * 3, 10):
        words = body.split()
        for _ in range(rng.randrange(0, 1 + len(words) // 5)):
            words[rng.randrange(len(words))] = "other"
        rows.append((i, "Some prose before.\n\n" + " ".join(words).upper() + "\n\nand after it " * 3))
    rows.append((99, "x y " * 30_000 + "\nReleased under the MIT License."))
    found = sorted((str(r.doc_id), *map(str, result(r))) for r in L.scan(docs_of(rows)).collect())
    assert found == sorted((str(i), *map(str, brute(t))) for i, t in rows)


def test_bounds_are_exact():
    for size in range(1, 200):
        low, high = L.size_bounds(size, 0.8)
        for other in range(1, 400):
            assert (2 * min(size, other) / (size + other) >= 0.8 - 1e-12) == (low <= other <= high)


def test_plan(spark, small):
    plan = L.scan(spark.read.parquet(table_path(small, "documents")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan


GPL_3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD_3 = """Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""


def test_notices_inside_longer_texts(spark, docs_of):
    code = "import os\n\n\ndef run(path):\n    return os.listdir(path)\n" * 20
    texts = {
        "GPL-3.0": "# Copyright (C) 2020 Some One\n#\n" + GPL_3.replace("#\n", "\n") + code,
        "GPL-2.0": GPL_3.replace("version 3", "version 2") + code,
        "LGPL-3.0": GPL_3.replace("General Public", "Lesser General Public") + code,
        "BSD-3-Clause": BSD_3,
        "BSD-2-Clause": BSD_3[:BSD_3.index("3. Neither")] + code,
        "MIT": "All of it is free to read. Released under the MIT License. Have fun with all of it.",
        "CC-BY-SA-4.0": "Text and pictures. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Bye.",
        "MPL-2.0": code + "/* SPDX-License-Identifier: MPL-2.0 */ " + "x = 1; " * 9,
        None: "The licence of MIT is one of many. They are released under the sun. " + code,
    }
    found = {r.doc_id: r for r in L.scan(docs_of(list(enumerate(texts.values())))).collect()}
    assert [(found[i].license, found[i].licenses) for i in range(len(texts))] == [(n, n or "") for n in texts]
    assert all((found[i].n_units > 0) == (n is not None) and (found[i].dice >= L.THRESHOLD) == (n is not None) for i, n in enumerate(texts))


def test_a_window_that_is_not_taken_suppresses_no_other(spark, docs_of):
    """B overlaps A and C, which don't overlap each other: the text holds A and C verbatim, so both are found."""
    a, b, c = ([f"{x}{i}" for i in range(n)] for x, n in (("a", 12), ("b", 2), ("c", 24)))
    known = [("A", " ".join(a)), ("B", " ".join([*a[6:], *b, *c[:8]])), ("C", " ".join(c))]
    text = " ".join(["start"] * 9 + a + b + c + ["end"] * 9)
    found = L.scan(docs_of([(1, text)]), templates=known).collect()[0]
    assert found.licenses == "A,C"
