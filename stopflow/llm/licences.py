"""License scans: normalised text against licence templates, by the Dice coefficient of their word bigrams.

A segment is a line of a text, a paragraph (lines up to a blank one), the whole text, or a window: as many words as a
template has, laid so that one of the template's two window words (the longest of each of its halves) falls on an
occurrence of that word in the text. So a notice is found amid other words and a licence within a longer file.
Normalised, a segment is its runs of a-z and 0-9 after lowering, one space apart. A segment matches a template if twice
the distinct bigrams they share is at least DICE_AT times the distinct bigrams of both; the best template of a segment
counts, ties to the first name. Two exact bounds come first: a template is a candidate only if its number of
bigrams lies within DICE_AT / (2 - DICE_AT) of the segment's and its reciprocal; and a segment must hold an
anchor, one of a few words such that the bigrams of any template without them are too few for a match.

Templates are notices, headers and the short licences as published, whole and in parts. The long licences (Apache, GPL,
LGPL, AGPL, MPL) are found through their headers, which their published texts carry in an appendix.

Defined cases: null and empty texts have no segment and no match; texts of any length are scanned whole;
equal segments of a text count once; repeated rows are scanned each; an empty table gives an empty result; a
null doc_id is kept; other columns play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DICE_AT = 0.8
#: Bounds that hold exactly are widened by this much for rounding.
ROUNDING = 1e-9

#: Licence templates: short notices, and texts and headers as published. Fixed values.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-2-Clause conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General
Public License for more details.""",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General
Public License for more details.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "ISC permission": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    "Unlicense dedication": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a text, in order."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def window_words(templates: dict[str, str]) -> list[tuple[str, int, int]]:
    """(word, its place from 0 in the template, words of the template): the longest word of each half, the first of equals."""
    out = set()
    for words in (re.findall(r"[a-z0-9]+", t.lower()) for t in templates.values()):
        half = (len(words) + 1) // 2
        for low, high in ((0, half), (half, len(words))):
            if low < high:
                place = max(range(low, high), key=lambda k: (len(words[k]), -k))
                out.add((words[place], place, len(words)))
    return sorted(out)


def anchors(templates: dict[str, str], dice: float = DICE_AT) -> list[str]:
    """Words, the longest first as they are the rarest in other text, such that fewer bigrams without them remain than any match needs.

    A match with a template of b bigrams shares at least dice / (2 - dice) * b of them.
    """
    sets = [bigrams(t) for t in templates.values()]
    weight: dict[str, float] = {}
    for own in sets:
        for word in {w for b in own for w in b.split()}:
            weight[word] = weight.get(word, 0.0) + sum(word in b.split() for b in own) / len(own) * len(word)
    chosen: list[str] = []
    for word in sorted(weight, key=lambda w: (-len(w), -weight[w], w)):
        left = [sum(not set(chosen) & set(b.split()) for b in own) - dice / (2 - dice) * len(own) for own in sets]
        if all(x < 0 for x in left):
            break
        if any(x >= 0 and any(word in b.split() for b in own) for x, own in zip(left, sets, strict=True)):
            chosen.append(word)
    return chosen


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def with_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, dice: float = DICE_AT) -> DataFrame:
    """docs with `licences`: array<struct<dice, name>> of the distinct segments that match, best first."""
    words = anchors(templates, dice)
    anchor = r"(?:^| )(?:" + "|".join(words) + r")(?: |$)"
    kept = {n: b for n, t in sorted(templates.items()) if (b := bigrams(t))}
    low = dice / (2 - dice) * min(map(len, kept.values())) - ROUNDING
    high = (2 - dice) / dice * max(map(len, kept.values())) + ROUNDING

    def pairs(segment: Column) -> Column:
        parts = F.split(segment, " ")
        joined = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.filter(joined, lambda x: x.isNotNull()))

    def best(own: Column) -> Column:
        """struct<dice, name> of the best template, null if none matches."""
        n, found = F.size(own), []
        for name, theirs in kept.items():
            fits = (n >= dice / (2 - dice) * len(theirs) - ROUNDING) & (n <= (2 - dice) / dice * len(theirs) + ROUNDING)
            shared = F.size(F.array_intersect(own, F.split(F.lit("|".join(theirs)), r"\|")))
            value = F.round(2.0 * shared / (n + len(theirs)), 6)
            found.append(F.when(fits, F.struct(value.alias("dice"), F.lit(name).alias("name"))))
        good = F.filter(F.array(*found), lambda x: x.isNotNull() & (x["dice"] >= dice))
        return F.get(F.array_sort(good, lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["name"] < b["name"], -1).otherwise(1)), F.lit(0))

    text = F.coalesce(F.col("text"), F.lit(""))
    segments = F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text))
    laid = window_words(templates)

    def windows(parts: Column) -> Column:
        at = F.filter(F.transform(parts, lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda x: x["w"].isin(sorted({w for w, _, _ in laid})))

        def cut(hits: Column) -> Column:
            def of(word: str, place: int, size: int) -> Column:
                here = F.filter(hits, lambda h: h["w"] == word)
                return F.transform(here, lambda h: F.array_join(F.slice(parts, F.greatest(h["k"] - place, F.lit(0)) + 1, F.lit(size)), " "))

            return F.concat(*(of(*one) for one in laid))

        return F.aggregate(F.array().cast("array<int>"), at, lambda bound, _: bound, cut)

    normal = _normal(text)
    around = F.aggregate(F.array().cast("array<int>"), F.split(normal, " "), lambda bound, _: bound, windows)
    # The bounds on words follow from those on bigrams: a text of w words has w - 1 bigrams, with repetitions.
    likely = F.array_distinct(F.filter(F.concat(F.transform(segments, _normal), around), lambda s: s.rlike(anchor) & (F.size(F.split(s, " ")) > low)))
    some = F.filter(F.transform(likely, pairs), lambda p: F.size(p).between(low, high))
    found = F.filter(F.transform(some, best), lambda x: x.isNotNull())
    empty = F.array().cast("array<struct<dice: double, name: string>>")
    value = F.when(normal.rlike(anchor), F.sort_array(found, asc=False)).otherwise(empty)
    return docs.withColumn("licences", value)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licences (segments that match), licences (their names), best_dice."""
    found = with_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["name"])))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join(names, ", ").alias("licences"),
        F.get("licences", F.lit(0))["dice"].alias("best_dice"),
    )


def _sql() -> str:
    laid = ", ".join(f"('{w}', {place}, {size})" for w, place, size in window_words(TEMPLATES))
    rows = ", ".join(
        "('{}', [{}])".format(n, ", ".join(f"'{b}'" for b in bigrams(t))) for n, t in TEMPLATES.items() if bigrams(t)
    )
    return f"""
WITH templates(name, theirs) AS (VALUES {rows}),
laid(word, place, size) AS (VALUES {laid}),
cut AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM cut
), windows AS (
  SELECT r, array_to_string(w[greatest(k - 1 - place, 0) + 1 : greatest(k - 1 - place, 0) + size], ' ') AS segment
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM words) JOIN laid ON w[k] = word
), segments AS (
  SELECT r, segment FROM windows UNION
  SELECT DISTINCT r, trim(regexp_replace(lower(segment), '[^a-z0-9]+', ' ', 'g')) AS segment FROM (
    SELECT r, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), [text])) AS segment FROM cut)
), parts AS (
  SELECT r, segment, string_split(segment, ' ') AS w FROM segments
), pairs AS (
  SELECT r, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM parts WHERE len(w) > 1
), scored AS (
  SELECT r, segment, name, round(2.0 * len(list_intersect(own, theirs)) / (len(own) + len(theirs)), 6) AS dice
  FROM pairs JOIN templates ON len(own) >= {DICE_AT / (2 - DICE_AT)!r}::DOUBLE * len(theirs) - {ROUNDING}::DOUBLE AND len(own) <= {(2 - DICE_AT) / DICE_AT!r}::DOUBLE * len(theirs) + {ROUNDING}::DOUBLE
), matched AS (
  SELECT r, name, dice FROM scored WHERE dice >= {DICE_AT}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY r, segment ORDER BY dice DESC, name) = 1
)
SELECT doc_id, count(name) AS n_licences, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), ', '), '') AS licences,
  CAST(max(dice) AS DOUBLE) AS best_dice
FROM cut LEFT JOIN matched USING (r) GROUP BY r, doc_id
"""


OP2_SQL = _sql()
