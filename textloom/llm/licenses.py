"""License scans, in DataFrame functions alone.

Every position of a text opens a window of four 5-word shingles, which overlaps the next in all but one word; each of `BANDS`
hash functions keeps the least hash of its shingles, one band of one row each. Templates are cut into windows in the same
way, and a text's window retrieves the templates with which it shares a band. Windows of the same four shingles share all
bands for certain, windows that share three of their five one of them with 1 - 0.4 ** BANDS, that is 0.9999. A text that
holds `percent`/100 = 0.8 of a template of n shingles in its order has been cut in 0.05 n places at most, as a changed,
missing or added word takes four shingles or more, so some four shingles in a row are whole and retrieve it for certain. A
template of fewer than four shingles is one window, which texts open in its width too.

What is retrieved, pairs of a document and a template, is verified, and nothing else: the texts of those documents alone
are cut into shingles, as strings, and the share of the template's distinct shingles among them must be `percent`/100 or
more. Of the first pass only keys that are met are shuffled, of the second the texts of retrieved documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.planning import kept_apart
from .store import among, kept, scratch, settle

SHINGLE_WORDS = 5
SHINGLES = 4
WINDOW_WORDS = SHINGLE_WORDS + SHINGLES - 1
BANDS = 10
#: Keys of templates that are broadcast (16 bytes each); more are joined by a shuffle.
MOST_KEYS = 1_000_000

#: Notices by licence, as their publishers word them (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit-line", "Released under the MIT License."),
    ("apache-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl3-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("apache-notice", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("mpl2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-3-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
)


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased. Null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos (from 0) and s0..s3, the window's shingles (null past the end), of the word hashes _w; a row a shingle."""
    shifted = ", ".join(f"slice(_w, {j + 1}, size(_w))" if j else "_w" for j in range(WINDOW_WORDS))
    out = rows.selectExpr(*keys, f"posexplode(arrays_zip({shifted})) as (pos, z)")
    out = out.select(*keys, "pos", *(F.col("z").getField(str(j) if j else "_w").alias(f"w{j}") for j in range(WINDOW_WORDS)))
    shingle = [f"case when w{j + SHINGLE_WORDS - 1} is not null then xxhash64({', '.join(f'w{j + i}' for i in range(SHINGLE_WORDS))}) end as s{j}" for j in range(SHINGLES)]
    return out.where(f"w{SHINGLE_WORDS - 1} is not null").selectExpr(*keys, "pos", *shingle)


def _bands() -> Column:
    """The widest window's least hash by each function, with the band's number; none for windows past the end."""
    each = [F.expr(f"xxhash64({b}, least({', '.join(f'xxhash64(s{j}, {b})' for j in range(SHINGLES))}))") for b in range(BANDS)]
    return F.when(F.col(f"s{SHINGLES - 1}").isNotNull(), F.array(*each)).otherwise(F.array().cast("array<bigint>"))


def _narrow(width: int) -> Column:
    """The first band of the window of `width` shingles, and its width."""
    return F.expr(f"case when s{width - 1} is not null then xxhash64({-width}, least({', '.join(f'xxhash64(s{j}, 0)' for j in range(width))}{', null' if width == 1 else ''})) end")


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """license, text of templates given in the program."""
    rows = F.array(*(F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in templates)) if templates else F.array().cast("array<struct<license:string,text:string>>")
    return spark.range(1).select(F.inline(rows))


def _shingles(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys and _s, the 5-word shingles of the text `column` as strings, in order."""
    out = rows.select(*keys, kept_apart(words_of(F.col(column))).alias("_v"))
    return out.select(*keys, kept_apart(F.expr(f"case when size(_v) < {SHINGLE_WORDS} then cast(array() as array<string>) else transform(sequence(0, size(_v) - {SHINGLE_WORDS}), i -> concat_ws(' ', slice(_v, i + 1, {SHINGLE_WORDS}))) end")).alias("_s"))


def scan(docs: DataFrame, templates: DataFrame | tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, license, n_shared, n_shingles (of the template), containment, first_word: a row
    for each document and template that it holds, in the order of no column.

    templates: a table (license, text), or a list in the program; those of fewer than five words are held by nothing. Texts
    are scanned whole. Null, empty or shorter texts hold nothing. A null doc_id counts as a document of its own text; rows
    that repeat doc_id and text count once. Other columns are ignored, whatever their names; no rows give no rows.
    """
    with scratch(docs.sparkSession):
        return kept(_scan(docs, templates, percent), "licenses")


def _scan(docs: DataFrame, templates: DataFrame | tuple[tuple[str, str], ...], percent: int) -> DataFrame:
    given = templates.select("license", "text") if isinstance(templates, DataFrame) else template_table(docs.sparkSession, templates)
    hashed = lambda x: F.transform(words_of(x), lambda w: F.xxhash64(w))
    own = given.select("license", hashed(F.col("text")).alias("_w"), (F.size(words_of(F.col("text"))) - SHINGLE_WORDS + 1).alias("width")).where("width > 0")
    windows = _windows(own, ["license", "width"])
    keys = windows.select("license", F.explode(_bands()).alias("x"))
    for w in range(1, SHINGLES):
        keys = keys.union(windows.where(f"width = {w} and pos = 0").select("license", _narrow(w).alias("x")))
    keys = settle(keys.distinct(), "template-keys")
    narrow = [r["width"] for r in own.where(f"width < {SHINGLES}").select("width").distinct().collect()]
    if keys.count() <= MOST_KEYS:
        keys = F.broadcast(keys)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    asked = _windows(rows.select("row", hashed(F.col("text")).alias("_w")), ["row"]).select("row", F.explode(F.concat(F.array(*map(_narrow, sorted(narrow))).cast("array<bigint>"), _bands())).alias("x"))
    # Few keys are met, and only those are shuffled.
    retrieved = settle(asked.join(keys, "x").select("row", "license").distinct(), "retrieved")

    met = among(rows, retrieved.select("row"), "row").join(retrieved, "row").select("doc_id", "row", "license", "text")
    held = _shingles(met, "text", ["doc_id", "row", "license"])
    wanted = _shingles(given, "text", ["license"]).select("license", F.array_distinct("_s").alias("_t"))
    both = held.join(wanted, "license").select("doc_id", "row", "license", F.size("_t").cast("long").alias("n_shingles"), "_s", kept_apart(F.array_intersect("_s", "_t")).alias("_both"))
    found = both.select("doc_id", "row", "license", F.size("_both").cast("long").alias("n_shared"), "n_shingles", (F.array_position("_s", F.get("_both", F.lit(0))) - 1).cast("long").alias("first_word"))
    found = found.where(f"n_shared > 0 and 100 * n_shared >= {percent} * n_shingles").distinct()
    return found.select("doc_id", "license", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"), "first_word")
