"""License scans: word bigrams against licence templates by Dice coefficient.

Each line of a text, the text as a whole, and what lies between is a unit: a window
is a run of words, within a line or over several, with no more bigrams than a match
may have.  A window is given only where no line it touches, and not the whole text,
matches the template by itself; of overlapping ones that match a template the best
(then shortest, then first) is given.  A unit is lower-cased,
reduced to runs of ASCII letters and digits, and turned into the set of its word
bigrams.  With Dice ``2 |A and B| / (|A| + |B|)`` of at least t the sizes lie within
``t / (2 - t)`` of each other, so a unit is compared only with templates of such a
size; units outside all bounds are not even turned into bigrams.  As a match needs two
thirds of a template's bigrams, it holds one of a few anchor words; texts without
any are left out first, which loses nothing.  The templates
are a literal in the plan: nothing is joined or shuffled.

Only functions of Spark are used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from martflow.llm.common import UPPER, ascii_lower, split_words

THRESHOLD = 0.8

# Notices and texts as the licences give them.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "mit-short": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "bsd-3-clause-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}


def bigrams_of(text: str) -> list[str]:
    """The distinct word bigrams of a template."""
    words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, UPPER.lower())))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(size: int, threshold: float = THRESHOLD) -> tuple[float, float]:
    """The sizes a set may have to reach the threshold with one of this size."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def anchors_of(sets: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every text that matches a template holds at least one.

    A match shares at least ``t / (2 - t)`` of a template's bigrams.  Anchors of a
    template are added until the bigrams without one are too few for that;
    words of many templates come first.
    """
    words = {n: {w for g in s for w in g.split()} for n, s in sets.items()}
    uses = lambda w: sum(w in ws for ws in words.values())
    anchors: list[str] = []
    for name, grams in sets.items():
        rank = sorted(words[name], key=lambda w: (len(w) < 6, -uses(w), -len(w), w))
        for word in rank:
            free = [g for g in grams if not any(w in anchors for w in g.split())]
            if len(free) < bounds(len(grams), threshold)[0]:
                break
            if word not in anchors:
                anchors.append(word)
    return [a for a in anchors if not any(b != a and b in a for b in anchors)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _worded(unit: Column) -> Column:
    return split_words(ascii_lower(unit), "[^a-z0-9]+")


def _dice(n_common: Column, n: Column, n_template: Column) -> Column:
    return F.lit(2.0) * n_common / (n + n_template)


def _windows(threshold: float) -> Column:
    """(line_no, n_common, n_unit, dice) of each window that matches the template ``m``.

    Reads ``text``, its bigrams ``pairs`` in order, and ``m`` with ``grams``, ``size``,
    ``low`` and ``high``.  The best window starts and ends with a bigram of the
    template, so only these are tried, and ends only behind starts that have
    enough of the template within reach: the work grows with the length of the text.
    """
    grams, low, high = F.col("m.grams"), F.col("m.low"), F.col("m.high")
    at = lambda i: F.array_contains(grams, F.get("pairs", i - 1))
    common = lambda a: F.size(F.array_intersect(a, grams))
    dice = lambda b: _dice(common(b), F.size(F.array_distinct(b)), F.col("m.size"))
    # Line breaks as words of their own: those before a word number its line.
    tokens = F.array_remove(F.split(F.regexp_replace(ascii_lower(F.col("text")), "\n", " \n "), "[^a-z0-9\n]+", -1), "")
    places = _let(tokens, lambda v: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i) != "\n"))
    line_of = F.transform(places, lambda p, i: p - i)
    own = F.filter(F.transform(F.split("text", "\n", -1), lambda line, i: F.when(
        _let(_pairs(_worded(line)), lambda b: (F.size(b) > 0) & (dice(b) >= threshold)), i)), lambda i: i.isNotNull())
    starts = F.filter(F.sequence(F.lit(1), F.size("pairs")), lambda i: at(i) & (
        common(F.slice("pairs", i, high)) >= low))

    def from_start(i: Column, lines: Column, taken: Column) -> Column:
        ends = F.filter(F.sequence(i + low - 1, F.least(i + high - 1, F.size("pairs"))), at)
        made = F.transform(ends, lambda j: _let(F.slice("pairs", i, j - i + 1), lambda b: F.struct(
            (-dice(b)).alias("minus"), (j - i).alias("more"), i.alias("start"), j.alias("end"),
            common(b).alias("n_common"), F.size(F.array_distinct(b)).alias("n_unit"))))
        # Bigram j ends with word j + 1; lines are numbered from 0.
        return F.filter(made, lambda c: (c["minus"] <= -threshold) & ~F.exists(
            taken, lambda t: t.between(F.get(lines, c["start"] - 1), F.get(lines, c["end"]))))

    none = F.array().cast("array<struct<minus:double,more:int,start:int,end:int,n_common:int,n_unit:int>>")
    # Two notices next to each other share no word.
    apart = lambda a, c: (a["end"] + 1 < c["start"]) | (c["end"] + 1 < a["start"])
    best = lambda cands: F.aggregate(F.array_sort(cands), none, lambda out, c: F.when(
        F.forall(out, lambda a: apart(a, c)), F.concat(out, F.array(c))).otherwise(out))
    found = _let(line_of, lambda lines: _let(own, lambda taken: F.transform(
        _let(F.flatten(F.transform(starts, lambda i: from_start(i, lines, taken))), best),
        lambda c: F.struct(F.get(lines, c["start"] - 1).alias("line_no"), "m.template", c["n_common"].alias("n_common"),
                           c["n_unit"].alias("n_unit"), (-c["minus"]).alias("dice")))))
    return F.when(dice(F.col("pairs")) < threshold, found)


def license_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, line_no, template, n_common, n_unit, dice: every match of every row.

    ``unit`` is ``line`` with its number from 0, ``text`` with line number -1, or
    ``window`` with the number of the line where it starts; a text of one line is
    tested as a line and for windows only.  Null and empty texts and units
    of fewer than two words match nothing.  Repeated rows match each; other columns
    are not read.
    """
    sets = {name: bigrams_of(t) for name, t in (TEMPLATES if templates is None else templates).items()}
    sets = {n: s for n, s in sets.items() if s}
    least = min((bounds(len(s), threshold)[0] for s in sets.values()), default=0)
    most = max((bounds(len(s), threshold)[1] for s in sets.values()), default=0)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    # A word and its separator take two characters, so a very short unit has too few bigrams.
    # Letters beyond A-Z are lowered too, which leaves every anchor in place and is
    # much cheaper; the variable holds the lowered text for all anchors.
    anchors = anchors_of(sets, threshold)
    hopeful = F.exists(F.array(F.lower(text)), lambda t: reduce(
        or_, [F.contains(t, F.lit(word)) for word in anchors], F.lit(False)))
    units = (docs.where(hopeful).select(F.col(doc_id).alias("doc_id"), lines.alias("lines"), F.col(text).alias("all"))
             .select("doc_id", F.posexplode(F.when(F.size("lines") > 1, F.concat(F.array("all"), "lines"))
                                            .otherwise(F.concat(F.array(F.lit("")), "lines"))).alias("at", "unit"))
             .where(F.length("unit") >= 2 * (int(least) + 1) - 1))
    worded = units.select("doc_id", "at", _worded(F.col("unit")).alias("w"))
    # Repeated bigrams only make a set smaller, so words bound it from above alone.
    long_enough = worded.where(F.size("w") - 1 >= least)
    sized = long_enough.select("doc_id", "at", F.array_distinct(_pairs(F.col("w"))).alias("b")).withColumn(
        "n", F.size("b")).where((F.col("n") >= least) & (F.col("n") <= most))
    tests = []
    for name, s in sets.items():
        low, high = bounds(len(s), threshold)
        common = F.size(F.array_intersect("b", F.array(*[F.lit(x) for x in s])))
        tests.append(F.when((F.col("n") >= low) & (F.col("n") <= high), F.struct(
            F.lit(name).alias("template"), common.alias("n_common"), F.lit(len(s)).alias("n_template"))))
    nothing = F.array().cast("array<struct<template:string,n_common:int,n_template:int>>")
    whole = (sized.select("doc_id", "at", "n", F.explode(F.array_compact(F.array(*tests)) if tests else nothing).alias("m"))
             .withColumn("dice", _dice(F.col("m.n_common"), F.col("n"), F.col("m.n_template"))).where(F.col("dice") >= threshold)
             .select("doc_id", F.when(F.col("at") == 0, "text").otherwise("line").alias("unit"),
                     (F.col("at") - 1).alias("line_no"), "m.template", F.col("m.n_common").cast("long").alias("n_common"),
                     F.col("n").cast("long").alias("n_unit"), "dice"))
    if not sets:
        return whole
    # Bigrams of any template first: the few a text has are then compared with each.
    grams = {n: F.array(*[F.lit(x) for x in s]) for n, s in sets.items()}
    every = F.array(*[F.lit(x) for x in sorted({x for s in sets.values() for x in s})])
    likely = []
    for name, s in sets.items():
        low, high = bounds(len(s), threshold)
        low, high = math.ceil(low - 1e-9), int(high + 1e-9)
        likely.append(F.when(F.size(F.array_intersect("near", grams[name])) >= low, F.struct(
            F.lit(name).alias("template"), grams[name].alias("grams"), F.lit(len(s)).alias("size"),
            F.lit(low).alias("low"), F.lit(high).alias("high"))))
    longer = (docs.where(hopeful).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _worded(F.col(text)).alias("w"))
              .where(F.size("w") - 1 >= least).select("doc_id", "text", _pairs(F.col("w")).alias("pairs"))
              .withColumn("near", F.array_intersect("pairs", every))
              .select("doc_id", "text", "pairs", F.explode(F.array_compact(F.array(*likely))).alias("m")))
    windows = (longer.select("doc_id", F.explode(_windows(threshold)).alias("f")).select(
        "doc_id", F.lit("window").alias("unit"), F.col("f.line_no").cast("int").alias("line_no"), "f.template",
        F.col("f.n_common").cast("long").alias("n_common"), F.col("f.n_unit").cast("long").alias("n_unit"), "f.dice"))
    return whole.unionByName(windows)
