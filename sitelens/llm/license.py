"""License scan: MinHash bands over text windows retrieve templates, shingle containment verifies.

Texts and templates are reduced to lower-case letter and digit words and to
shingles of five words (a shorter template is one shingle of its length).  For each
template, windows of as many shingles as the template overlap by three quarters and
are widened by half the size on both sides.  A template counts if at least 0.8 of its
shingles lie in a widened window.  Of a widened window only the template's shingles
are signed, so its Jaccard similarity to the template is just that containment c.  The
signature of 32 minima is cut into 16 bands of 2, so a window meets its template with
probability 1 - (1 - c^2)^16: above 0.9999999 for every window that counts.

Texts that hold none of a template's shingles cannot reach that containment, so they
get no windows for it, nor do stretches without such a shingle.  This drops no match.  Before shingles are
hashed, texts without any of a few words, of which every template shingle has one,
are passed over: they hold no template shingle.  Templates are a small
fixed list, so their shingles and bands are broadcast.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import prepare, text_or_empty

SHINGLE = 5
BANDS, ROWS = 16, 2
CONTAINMENT = 0.8

#: Public licence texts and notices as their publishers word them, without the copyright line.
#: Short licences stand whole, long ones with the notice that their publishers ask to put on a work.  BSD-3-Clause
#: is BSD-2-Clause and one more clause, so that clause tells it; its texts are reported as both.
#: The GNU notices differ in few words, so only the clause that names licence and version stands here.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied.""",
    "gpl-3.0": """under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License""",
    "lgpl-3.0": """under the terms of the GNU Lesser General Public License as published by the Free Software Foundation,
        either version 3 of the License""",
    "agpl-3.0": """under the terms of the GNU Affero General Public License as published by the Free Software Foundation,
        either version 3 of the License""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission.""",
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _shingles(words: str, length: int) -> Column:
    n = F.size(words)                          # get, not slice: slice() copies the whole array for every shingle
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length),
                                           lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(length)]))
                  ).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    """One hash per band of the MinHash signature."""
    least = lambda j: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(j))))
    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """One row per template: id, length of its shingles, size (their number), distinct shingles, bands, words."""
    rows = spark.createDataFrame(list(templates.items()), "license_id string, text string")
    rows = rows.withColumn("w", _words(F.col("text"))).filter(F.size("w") > 0)
    rows = rows.withColumn("length", F.least(F.lit(SHINGLE), F.size("w")))
    rows = rows.withColumn("sh", F.transform(F.sequence(F.lit(0), F.size("w") - F.col("length")),
                                             lambda i: F.xxhash64(F.slice("w", i + 1, F.col("length")))))
    return rows.select("license_id", "length", F.size("sh").alias("size"), F.array_distinct("sh").alias("template"),
                       _bands(F.col("sh")).alias("bands"), "w")


def anchors(shingles: list[tuple[str, ...]]) -> list[str]:
    """Words of which every shingle has at least one: greedily the word in most shingles left, then the longest."""
    left, out = set(shingles), []
    while left:
        counts = Counter(w for sh in left for w in set(sh) if len(w) > 3) or Counter(w for sh in left for w in sh)
        out.append(max(counts, key=lambda w: (counts[w], len(w), w)))
        left = {sh for sh in left if out[-1] not in sh}
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """Rows (key, license_id, containment, first_word): each template found in a text, once.

    ``first_word`` is the first word of the earliest widened window that holds it.
    Null and empty texts and an empty table give no rows; repeated rows of one key
    count as one document.
    """
    spark = prepare(docs.sparkSession)
    table = template_table(spark, templates or TEMPLATES)
    own = [(r["license_id"], r["length"], r["size"], sorted(r["template"])) for r in table.select(
        "license_id", "length", "size", "template").collect()]              # the fixed template list, in hashed form
    parts = [tuple(r["w"][i:i + r["length"]]) for r in table.select("w", "length").collect()
             for i in range(len(r["w"]) - r["length"] + 1)]
    table = table.drop("w")
    rows = docs.select(F.col(key).alias("k"), _words(text_or_empty(text)).alias("w"))
    rows = rows.filter(F.arrays_overlap("w", F.split(F.lit(" ".join(anchors(parts))), " ")))
    for length in sorted({t[1] for t in own}):
        rows = rows.withColumn(f"h{length}", _shingles("w", length))
    rows = rows.drop("w")
    kinds = []
    for name, length, size, hashes in own:
        hits = F.transform(f"h{length}", lambda x, i: F.when(x.isin(hashes), i))
        kinds.append(F.struct(F.lit(name).alias("license_id"), F.lit(length).alias("length"), F.lit(size).alias("size"),
                              F.lit(max(1, size // 4)).alias("stride"), F.array_compact(hits).alias("hits")))
    # Outer explodes: a filter inferred from an inner one would be pushed down and recompute the shingles.
    rows = rows.withColumn("kinds", F.filter(F.array(*kinds), lambda x: F.size(x["hits"]) > 0))
    rows = rows.withColumn("kind", F.explode_outer("kinds")).filter(F.col("kind").isNotNull())
    pick = F.coalesce(*[F.when(F.col("kind.length") == n, F.col(f"h{n}")) for n in sorted({t[1] for t in own})])
    rows = rows.select("k", "kind.*", pick.alias("h"))
    size, stride, end = F.col("size"), F.col("stride"), F.size("h")
    last, half = F.greatest(end - size, F.lit(0)), F.ceil(size / 2).cast("int")
    # The widened windows that hold a template shingle, from its positions.
    steps = F.transform("hits", lambda i: F.sequence(
        F.greatest(F.floor(F.least(i - size - half + stride, last) / stride), F.lit(0)).cast("int"),
        F.greatest(F.floor(F.least(i + half, last) / stride), F.lit(0)).cast("int")))
    starts = F.filter(F.array_distinct(F.concat(
        F.transform(F.array_distinct(F.flatten(steps)), lambda j: j * stride), F.array(last))), lambda x: x <= last)
    low = lambda x: F.greatest(x - half, F.lit(0))
    inside = lambda x: F.array_distinct(F.transform(
        F.filter("hits", lambda i: (i >= low(x)) & (i < x + size + half)), lambda i: F.get("h", i)))
    rows = rows.select("k", "license_id", F.explode_outer(F.transform(starts, lambda x: F.struct(
        low(x).alias("first_word"), inside(x).alias("held")))).alias("window")).select("k", "license_id", "window.*")
    windows = rows.withColumn("bands", _bands(F.col("held")))
    met = windows.join(F.broadcast(table.withColumnRenamed("bands", "template_bands")), "license_id")
    met = met.filter(F.exists(F.zip_with("bands", "template_bands", lambda a, b: a == b), lambda x: x))
    part = F.size(F.array_intersect("template", "held")) / F.size("template")
    found = met.withColumn("containment", part).filter(F.col("containment") >= containment)
    return found.groupBy(F.col("k").alias(key), "license_id").agg(
        F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"))


def miss_probability(jaccard: float) -> float:
    """Chance that a window of this similarity, or containment, shares no band with its template."""
    return math.pow(1 - jaccard ** ROWS, BANDS)
