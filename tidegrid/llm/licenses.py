"""Licence scan: Dice coefficient over word bigrams of normalised text, with size bounds. DataFrame functions only.

Units are lines, whole texts and, where these match nothing, stretches of words. scan_sql() has the first two only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    name: str
    text: str


# Public licence wording, whole licences first, then notices as they stand in the wild.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TERM = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TERMS = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = [
    Template("MIT", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_AS_IS}"),
    Template("MIT-0", f"{_MIT_GRANT}. {_MIT_AS_IS}"),
    Template("ISC", f"{_ISC_GRANT}{_ISC_TERM}. {_ISC_AS_IS}"),
    Template("0BSD", f"{_ISC_GRANT}. {_ISC_AS_IS}"),
    Template("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_TERMS} {_BSD_AS_IS}"),
    Template("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_TERMS} {_BSD_NAMES} {_BSD_AS_IS}"),
    Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    Template("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    Template("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    Template("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    Template("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("MIT", "Released under the MIT License."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    Template("MIT", f"{_MIT_GRANT}, subject to the following conditions:"),
    Template("ISC", f"{_ISC_GRANT}{_ISC_TERM}."),
    Template("BSD", _BSD_GRANT),
    Template("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
THRESHOLD = 0.8
#: Of templates of more pairs, only stretches as long as the template are compared.
EVERY_STRETCH = 70


def read_templates(folder: str) -> list[Template]:
    """Templates from a folder of text files named after their licences, like MIT.txt."""
    return [Template(p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.txt"))]


def _words(text: Column) -> Column:
    """The words of the normalised text: A-Z lower-cased, all but a-z and 0-9 as one space. An empty one where there is none."""
    # [\W_] is [^A-Za-z0-9], which Java searches for twenty times slower. Only then lower(): other letters can lower to a-z.
    return F.split(F.trim(F.lower(F.regexp_replace(text, r"[\W_]+", " "))), " ")


def _pairs(words: Column) -> Column:
    # zipped with itself, shifted by one: linear in the number of words
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _known(pairs: list[str]) -> Column:
    """An array literal: one folded expression, as thousands of literals would take seconds to plan."""
    return F.split(F.lit("|".join(pairs)), "[|]")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(_pairs(_words(text)))


def template_words(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def template_pairs(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes that a set can have with 2*min/(n+size) >= threshold."""
    low = next(k for k in range(1, n + 1) if 2 * k >= threshold * (n + k))
    high = n
    while 2 * n >= threshold * (n + high + 1):
        high += 1
    return low, high


def _stretch(pairs: Column, i: int, p: list[str], whole: int, lo: int, hi: int, threshold: float) -> Column:
    """The best stretch of a text's pairs against a template: dice, -place of its first word, -template; null if none reaches the threshold.

    The best one begins and ends with pairs of the template. Only texts that hold lo of its pairs are looked at.
    Of a template of more than EVERY_STRETCH pairs, only stretches of its own length, whole, are.
    """
    most = 2 * hi  # pairs of a stretch, of which hi differ at most

    def of(at: Column, k: Column, places: Column) -> Column:
        if len(p) > EVERY_STRETCH:
            ends = F.array(F.least(at + whole, F.size(pairs)) - 1)
        else:
            ends = F.filter(F.slice(places, k + 1, F.lit(most)), lambda e: (e >= at + lo - 1) & (e < at + most))
        sets = F.filter(F.transform(ends, lambda e: F.array_distinct(F.slice(pairs, at + 1, e - at + 1))), lambda x: F.size(x).between(lo, hi))
        return F.array_max(F.transform(sets, lambda x: F.size(F.array_intersect(x, _known(p))) * F.lit(2.0) / (F.size(x) + len(p))))

    places = F.filter(F.transform(pairs, lambda x, k: F.when(F.array_contains(_known(p), x), k)), lambda k: k.isNotNull())
    # bound once: a lambda's variable is not evaluated again for each place
    best = F.transform(F.array(places), lambda all_: F.array_max(F.filter(F.transform(all_, lambda at, k: F.struct(of(at, k, all_).alias("dice"), (-at).cast("int").alias("line"), F.lit(-i).alias("template"))), lambda s: s["dice"] >= threshold)))
    return F.when(F.size(F.array_intersect(pairs, _known(p))) >= lo, best[0])


def _line_of(lines: Column, word: Column) -> Column:
    """The line, from 1, of a text's word, from 0."""
    count = lambda x: F.size(F.filter(_words(x), lambda w: w != ""))
    start = F.struct(word.cast("int").alias("left"), F.lit(0).alias("line"))
    step = lambda acc, x: F.when(acc["left"] < 0, acc).otherwise(F.struct((acc["left"] - count(x)).alias("left"), (acc["line"] + 1).alias("line")))
    return F.aggregate(lines, start, step)["line"]


def scan_licenses(docs: DataFrame, *, templates: list[Template] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, license, dice, line, template.

    Each line of a text, and the whole text, is normalised and compared to each template whose size
    bounds it meets. dice is the highest coefficient of at least the threshold, line where it was found
    (from 1; 0 for the whole text), template its number from 0; of equal ones the first line, then the
    first template. Where neither a line nor the whole text reaches the threshold, all stretches of words do
    as units, within a line or over several, and line is that of the first word: so wrapped notices and notices
    amid prose are found. Of a template of more than EVERY_STRETCH pairs only stretches of its own length are
    units. Where nothing reaches the threshold, license, dice, line and template are null.
    Null and empty texts match nothing; a null text has n_lines 0. Ids may be null or repeated: each row
    gives one row. Other columns are ignored. No shuffle: each row is judged where it is read.
    """
    known = [(i, t.name, template_pairs(t.text)) for i, t in enumerate(TEMPLATES if templates is None else templates)]
    whole = [len(template_words(t.text)) - 1 for t in (TEMPLATES if templates is None else templates)]
    known = [(i, name, p, *size_bounds(len(p), threshold)) for i, name, p in known if p]
    text = F.col("text")
    n_lines = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", n_lines.cast("long").alias("n_lines"), "text", _words(text).alias("words"))
    # A unit that meets a template holds low of its pairs, and so does the text: all others end here.
    base = base.withColumn("pairs", _pairs(F.col("words"))).withColumn("held", F.array_intersect("pairs", _known(sorted({x for k in known for x in k[2]}))) if known else F.array())
    enough = reduce(lambda a, b: a | b, [F.size(F.array_intersect("held", _known(p))) >= lo for _, _, p, lo, _ in known]) if known else F.lit(False)
    base = base.withColumn("maybe", F.coalesce((F.size("held") >= min((k[3] for k in known), default=1)) & enough, F.lit(False)))
    base = base.select("doc_id", "n_lines", F.when(F.col("maybe"), text).alias("text"), F.when(F.col("maybe"), F.col("pairs")).alias("pairs")).withColumn("lines", F.split("text", "\n"))
    none = F.lit(None).cast("struct<dice:double,line:int,template:int>")
    if not known:
        best = none
    else:
        low, high = min(k[3] for k in known), max(k[4] for k in known)
        place = F.transform("lines", lambda x, i: F.struct((-i - 1).cast("int").alias("at"), x.alias("unit")))
        units = F.concat(place, F.when(F.size("lines") > 1, F.array(F.struct(F.lit(0).alias("at"), F.col("text").alias("unit")))).otherwise(F.array().cast("array<struct<at:int,unit:string>>")))
        # A unit of low pairs has low + 1 words at least, so 2 * low + 1 characters: most short lines go here.
        units = F.filter(units, lambda u: F.length(u["unit"]) >= 2 * low + 1)
        pairs = F.transform(units, lambda u: F.struct(u["at"].alias("at"), bigrams(u["unit"]).alias("pairs")))
        pairs = F.filter(pairs, lambda u: (F.size(u["pairs"]) >= low) & (F.size(u["pairs"]) <= high))

        def against(u: Column) -> Column:
            rate = lambda p: F.size(F.array_intersect(u["pairs"], _known(p))) * F.lit(2.0) / (F.size(u["pairs"]) + len(p))
            each = [F.when(F.size(u["pairs"]).between(lo, hi), F.struct(rate(p).alias("dice"), u["at"].alias("line"), F.lit(-i).alias("template"))) for i, _, p, lo, hi in known]
            return F.array_max(F.array(*each))

        best = F.array_max(F.filter(F.transform(pairs, against), lambda s: s["dice"] >= threshold))
    out = base.withColumn("best", best)
    if known:
        found = F.array_max(F.array(*[_stretch(F.col("pairs"), i, p, whole[i], lo, hi, threshold) for i, _, p, lo, hi in known], none))
        out = out.withColumn("found", F.when(F.col("best").isNull() & F.col("pairs").isNotNull(), found))
        out = out.withColumn("best", F.coalesce("best", F.when(F.col("found").isNotNull(), F.struct(F.col("found.dice").alias("dice"), (-_line_of(F.col("lines"), -F.col("found.line"))).alias("line"), F.col("found.template").alias("template")))))
    out = out.select("doc_id", "n_lines", "best")
    template = -F.col("best.template")
    names = F.create_map(*[x for i, name, *_ in known for x in (F.lit(i), F.lit(name))]) if known else None
    return out.select("doc_id", "n_lines", (names[template] if known else F.lit(None).cast("string")).alias("license"), F.col("best.dice").alias("dice"), (-F.col("best.line")).cast("int").alias("line"), template.cast("int").alias("template"))


def scan_sql(templates: list[Template] | None = None, threshold: float = THRESHOLD) -> str:
    """The same over a table documents, in DuckDB's SQL."""
    rows = []
    for i, t in enumerate(TEMPLATES if templates is None else templates):
        if p := template_pairs(t.text):
            rows.append(f"({i}, '{t.name}', [{', '.join(f"'{x}'" for x in p)}], {', '.join(map(str, size_bounds(len(p), threshold)))})")
    return f"""
WITH t(template, license, pairs, lo, hi) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(string_split(text, chr(10)), []) AS lines FROM documents),
u AS (SELECT r, unnest(lines) AS unit, generate_subscripts(lines, 1) AS line FROM d
      UNION ALL SELECT r, text, 0 FROM d WHERE len(lines) > 1),
w AS (SELECT r, line, string_split(trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM u),
b AS (SELECT r, line, list_distinct(list_transform(list_zip(words[:-2], words[2:]), lambda x: x[1] || ' ' || x[2])) AS pairs FROM w WHERE len(words) > 1),
s AS (SELECT r, line, template, license, 2.0::DOUBLE * len(list_intersect(b.pairs, t.pairs)) / (len(b.pairs) + len(t.pairs)) AS dice
      FROM b JOIN t ON len(b.pairs) BETWEEN t.lo AND t.hi),
m AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, CASE WHEN line = 0 THEN -1 ELSE line END, template) AS k FROM s WHERE dice >= {threshold})
SELECT doc_id, len(lines)::BIGINT AS n_lines, license, dice, line::INTEGER AS line, template::INTEGER AS template
FROM d LEFT JOIN m ON d.r = m.r AND m.k = 1"""
