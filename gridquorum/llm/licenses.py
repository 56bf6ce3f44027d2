"""License scan: Dice coefficient over word bigrams against licence templates.

All native.  The units of a document are its lines, its paragraphs (lines between
blank ones) and its whole text.  Text is normalised to lower-case runs of letters and
digits.  A unit carries the licence of a template if the Dice coefficient of their
sets of word bigrams is at least ``ALIKE``.

Size bounds: Dice of sets of a and b bigrams is at most 2 min(a, b) / (a + b), so
only templates with ALIKE / (2 - ALIKE) <= a / b <= (2 - ALIKE) / ALIKE are candidates.
Templates are listed under each size they can match and units meet them by an
equi-join on their size.

Pruning, cheapest first; nothing that can match is lost.  A unit that matches a template has
at least ALIKE / (2 - ALIKE), two thirds, of its bigrams.  So of any larger part than the other
third it has one: ``rare`` takes that part of each template around few long words.  A text,
then a unit, without any of those goes before it is split; a unit with fewer words than
the smallest size bound goes before its bigrams are made; a unit without a rare bigram
goes before it is joined.  The templates are a fixed table of this module, so it is
always broadcast.

Cases.  Null, empty and one-word texts have no unit with a bigram and no row; a very long text
is a unit like any other; several units of a document count once for each template, with the
best coefficient; equal rows stay; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIKE, LONG = 0.8, 6

# fixed values: notices and texts of public licences
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def pairs(w: Column) -> Column:
    """Distinct word bigrams."""
    some = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(w, 1, some), F.slice(w, 2, some), lambda a, b: F.concat_ws(" ", a, b)))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text."""
    return pairs(words(text))


def rare(templates: list[list[str]]) -> tuple[list[str], list[str], list[str]]:
    """Words, bigrams of short words, and bigrams: each unit that matches one of the templates (lists of bigrams) has one of
    the third list, which is made of the first two.

    Words of ``LONG`` letters are taken, those taken before and those of many bigrams first, then single bigrams,
    until there are more bigrams than a unit that matches can lack.
    """
    chosen: set[str] = set()
    short: set[str] = set()
    found: set[str] = set()
    for template in templates:
        lack = len(template) - math.ceil(ALIKE / (2 - ALIKE) * len(template) - 1e-9)
        having = {w: {x for x in template if w in x.split(" ")} for x in template for w in x.split(" ") if len(w) >= LONG}
        told: set[str] = set()
        for word in sorted(having, key=lambda w: (w not in chosen, -len(having[w]), -len(w), w)):
            if len(told) > lack:
                break
            told |= having[word]
            chosen.add(word)
        for bigram in sorted(set(template) - told, key=lambda x: (-len(x), x))[: max(0, lack + 1 - len(told))]:
            told.add(bigram)
            short.add(bigram)
        found |= told
    return sorted(chosen), sorted(short), sorted(found)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, license, dice (best), n_units (units that carry it): a row for each document and licence."""
    spark = docs.sparkSession
    made = spark.createDataFrame(templates, "license string, text string").select("license", bigrams(F.col("text")).alias("template"))
    made = made.withColumn("b", F.size("template")).where("b > 0")
    low, high = F.ceil(F.lit(ALIKE / (2 - ALIKE) - 1e-9) * F.col("b")), F.floor(F.lit((2 - ALIKE) / ALIKE + 1e-9) * F.col("b"))
    listed = made.select("license", "template", "b", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("a"))
    # the templates are fixed, so is what comes here
    long, short, known = rare([r[0] for r in made.select("template").collect()])
    least, most = listed.agg(F.min("a"), F.max("a")).first()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_llm_row", F.monotonically_increasing_id())
    pattern = "|".join(re.escape(x).replace(r"\ ", r"[^\p{L}\p{N}]+") for x in short) or "$^"

    def signed(text: Column) -> Column:
        signs = F.array(*[F.lit(x) for x in long]).cast("array<string>")
        # in an array so that the lower case is made once
        return F.exists(F.array(F.lower(text)), lambda low: F.exists(signs, lambda x: F.contains(low, x)) | F.rlike(low, F.lit(pattern)))

    parts = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n[ \t\r]*\n\s*"), F.array("text")))
    units = rows.where(signed(F.col("text"))).select("_llm_row", "doc_id", F.explode(parts).alias("unit")).where(signed(F.col("unit")))
    units = units.select("_llm_row", "doc_id", words(F.col("unit")).alias("w")).where(F.size("w") > (least or 0))
    units = units.select("_llm_row", "doc_id", pairs(F.col("w")).alias("unit")).withColumn("a", F.size("unit")).where(F.col("a").between(least or 0, most or 0))
    units = units.where(F.exists("unit", lambda x: x.isin(known)))
    dice = F.lit(2.0) * F.size(F.array_intersect("unit", "template")) / (F.col("a") + F.col("b"))
    found = units.join(F.broadcast(listed), "a").select("_llm_row", "doc_id", "license", "unit", dice.alias("dice")).where(F.col("dice") >= ALIKE)
    by_unit = found.groupBy("_llm_row", "doc_id", "license", F.array_sort("unit").alias("unit")).agg(F.max("dice").alias("dice"))
    return by_unit.groupBy("_llm_row", "doc_id", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("n_units")).select("doc_id", "license", "dice", "n_units")


def sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    split = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH made AS (
  SELECT license, {grams} AS template FROM (SELECT license, {split.format("t")} AS w FROM (VALUES {values}) v(license, t))),
units AS (
  SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n[ \\t\\r]*\\n\\s*'), [text]))) AS u
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
words AS (SELECT doc_id, {split.format("u")} AS w FROM units WHERE u <> ''),
sets AS (SELECT DISTINCT doc_id, list_sort({grams}) AS unit FROM words WHERE len(w) > 1),
found AS (
  SELECT doc_id, license, unit, 2.0::DOUBLE * len(list_intersect(unit, template)) / (len(unit) + len(template)) AS dice
  FROM sets, made WHERE list_has_any(unit, template)),
best AS (SELECT doc_id, license, unit, max(dice) AS dice FROM found WHERE dice >= {ALIKE} GROUP BY ALL)
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units FROM best GROUP BY doc_id, license
"""
