"""Licence scan [native]: normalised text against licence templates by the Dice coefficient of word-bigram sets.

The whole document, each paragraph, each line and each sentence is compared. Dice(A, B) = 2 |A & B| / (|A| + |B|) over
sets of word bigrams, so a template B can only reach the threshold t with t |B| / (2 - t) <= |A| <= (2 - t) |B| / t; other
templates are pruned by these bounds before any bigram is joined. A prefix bound comes first: a unit that reaches t with
B shares at least ceil(t (least |A| + |B|) / 2) bigrams with it, so it holds one of any |B| - that + 1 of them. These are
taken from B's least common words, and a document that has none of their first words is not looked at further. Both
bounds are exact: they lose no match. The templates are part of the code, so their bigrams are a fixed broadcast.

Main path: DataFrame functions only. Defined results: a null or empty text matches nothing; repeated rows give repeated
document ids but one result row for each (doc_id, licence); a null doc_id is a value of its own; ties between units keep
the highest Dice, then the earliest kind in the order document, paragraph, line, sentence; empty tables give no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Public licence texts, notices and one-line grants.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Words that many texts hold; prefix bigrams avoid them where they can.
COMMON = "a all an and any are as at be but by can copy file for found free from in is it kind may met more name no not of on one or out see shall source terms that the this to under use used version was will with without work you your 0 2 3 4 v".split()

THRESHOLD = 0.8
_SPACE = "[ \\t\\r\\n]+"


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _rarity(word: str) -> tuple[bool, int]:
    """Longer words are rarer; which words are taken changes the cost of the scan, never its result."""
    return word not in COMMON, len(word)


def template_table(threshold: float = THRESHOLD) -> list[dict]:
    out = []
    for name, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            w = _words(text)
            grams = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
            n, low = len(grams), math.ceil(round(threshold * len(grams) / (2 - threshold), 9))
            high = math.floor(round((2 - threshold) * n / threshold, 9))
            need = math.ceil(round(threshold * (low + n) / 2, 9))
            word = {g: max(g.split(), key=_rarity) for g in grams}  # a text with the bigram has this word
            rare = sorted(grams, key=lambda g: (_rarity(word[g]), g), reverse=True)[: n - need + 1]
            out.append({"license": name, "template": f"{name}#{i}", "grams": grams, "low": low, "high": high, "keys": sorted({word[g] for g in rare})})
    return out


def normalised(c):
    """Lower-case words with one space between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per (doc_id, licence) that some unit of a text reaches: dice, unit, n_units, template."""
    table = template_table(threshold)
    keys = F.array(*[F.lit(k) for k in sorted({k for t in table for k in t["keys"]})])
    held = docs.select("doc_id", "text").filter(F.arrays_overlap(F.split(normalised(F.col("text")), " "), keys))
    tidy = lambda kind, c: F.transform(c, lambda u: F.struct(F.lit(kind[0]).alias("rank"), F.lit(kind[1]).alias("unit"), normalised(u).alias("words")))
    units = F.concat(
        tidy((0, "document"), F.array("text")),
        tidy((1, "paragraph"), F.split("text", "\\n[ \\t\\r]*\\n")),
        tidy((2, "line"), F.split("text", "\\n")),
        tidy((3, "sentence"), F.split(F.regexp_replace("text", "([.!?])" + _SPACE, "$1\n"), "\\n")),
    )
    one = held.select("doc_id", F.explode_outer(F.array_distinct(units)).alias("u")).select("doc_id", "u.rank", "u.unit", F.split("u.words", " ").alias("w"))
    one = one.filter(F.arrays_overlap("w", keys))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    one = one.withColumn("grams", F.when(F.size("w") >= 2, F.array_distinct(pairs)))
    known = F.array(*[F.struct(F.lit(t["license"]).alias("license"), F.lit(t["template"]).alias("template"), F.lit(t["low"]).alias("low"), F.lit(t["high"]).alias("high"), F.array(*[F.lit(g) for g in t["grams"]]).alias("have")) for t in table])
    n = F.size("grams")
    near = F.filter(known, lambda t: n.between(t["low"], t["high"]))  # the templates that the size bounds leave
    dice = F.transform(near, lambda t: F.struct(t["license"].alias("license"), t["template"].alias("template"), F.round(F.lit(2.0) * F.size(F.array_intersect("grams", t["have"])) / (n + F.size(t["have"])), 6).alias("dice")))
    hits = one.select("doc_id", "rank", "unit", F.explode_outer(F.filter(dice, lambda t: t["dice"] >= threshold)).alias("t")).filter(F.col("t").isNotNull())
    hits = hits.select("doc_id", "rank", "unit", "t.license", "t.template", "t.dice")
    best = F.min(F.struct((-F.col("dice")).alias("d"), F.col("rank"), F.col("template"), F.col("unit")))
    return hits.groupBy("doc_id", "license").agg(best.alias("b"), F.count("*").alias("n_units")).select("doc_id", "license", (-F.col("b.d")).alias("dice"), F.col("b.unit").alias("unit"), F.col("b.template").alias("template"), "n_units")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def sql(threshold: float = THRESHOLD) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({quote(t['license'])}, {quote(t['template'])}, {quote(g)}, {len(t['grams'])})" for t in template_table(threshold) for g in t["grams"])
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"""
WITH tg(license, template, gram, size) AS (VALUES {rows}),
u AS (
  SELECT doc_id, 0 AS rank, 'document' AS unit, {norm("text")} AS words FROM documents
  UNION SELECT doc_id, 1, 'paragraph', {norm("x")} FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS x FROM documents)
  UNION SELECT doc_id, 2, 'line', {norm("x")} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
  UNION SELECT doc_id, 3, 'sentence', {norm("x")} FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10))) AS x FROM documents)),
w AS (SELECT *, string_split(words, ' ') AS w FROM u),
g AS (SELECT doc_id, rank, unit, words, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS grams FROM w WHERE len(w) >= 2),
e AS (SELECT doc_id, rank, unit, words, len(grams) AS n, unnest(grams) AS gram FROM g),
d AS (SELECT doc_id, rank, unit, words, license, template, round(2.0 * count(*) / (any_value(n) + any_value(size)), 6) AS dice FROM e JOIN tg USING (gram) GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, rank, template, unit) AS r, count(*) OVER (PARTITION BY doc_id, license) AS n_units FROM d WHERE dice >= {threshold})
SELECT doc_id, license, dice, unit, template, n_units FROM h WHERE r = 1
"""
