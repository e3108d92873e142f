"""License scans (DataFrame functions only).

Words are runs of letters and digits, lower-cased; shingles are five words, or all words of a template that has fewer.
Windows of a text overlap: for each class of window size the step is an eighth of the size, and a template belongs to
the smallest class in which some window holds the whole of it, and an eighth more for words put in, wherever it stands.
Sizes grow by a quarter from one shingle to what the longest template given needs, so there is no greatest length.

Windows retrieve templates by MinHash: ``bands`` bands of ``rows`` values.  A window is at most 1.8 times as long as its
template, so a window that holds four fifths of the template's shingles has a Jaccard similarity of 0.8 / (1.8 + 0.2) = 0.4 at
least, and the pair meets in some band with probability 1 - (1 - 0.4 ** 2) ** 40 > 0.999 by the defaults.  Windows that hold no
shingle of any template cannot be verified, so no signature is made for them.  Retrieved templates are verified exactly: the
share of a template's shingles that the window holds must reach ``containment``.

Defined cases: null and empty texts, and texts shorter than a template's shingle, have no match; templates and texts of any
length are taken whole, templates without words match nothing; a text that repeats a notice gives one row per license, with
the best share, the earliest word of the best window and the number of windows; rows that share an id are scanned as one
document; an empty table gives an empty result; only the id and the text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import let

SHINGLE = 5
#: Notices as their publishers word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


@dataclass(frozen=True)
class LicenseParams:
    containment: float = 0.8
    bands: int = 40
    rows: int = 2


def words(text: Column) -> Column:
    split = F.split(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ", -1)
    return F.filter(split, lambda w: w != "")


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Hashes of all shingles of ``k`` words, in order; none for fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
    return F.when(F.size(w) < k, F.array().cast("array<bigint>")).otherwise(each)


def _bands(window: Column, params: LicenseParams) -> Column:
    mins = F.transform(F.sequence(F.lit(0), F.lit(params.bands * params.rows - 1)), lambda k: F.array_min(F.transform(window, lambda x: F.xxhash64(x, k))))
    return let(mins, lambda m: F.transform(F.sequence(F.lit(0), F.lit(params.bands - 1)), lambda b: F.xxhash64(b, *(F.get(m, b * params.rows + r) for r in range(params.rows)))))


def window_class(n_words: int) -> tuple[int, int, int]:
    """Words of a shingle, and shingles of a window and of a step, for a template of so many words."""
    k = min(SHINGLE, n_words)
    need = n_words - k + 1
    need += need // 8
    size = 1
    while size - max(1, size // 8) + 1 < need:
        size = max(size + 1, size * 5 // 4)
    return k, size, max(1, size // 8)


def template_table(spark, templates: dict[str, list[str]], params: LicenseParams) -> DataFrame:
    """(license, template, k, size, step, t_shingles, t_bands): bounded by the templates given, a parameter of the scan."""
    rows = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "license string, template int, t_text string").coalesce(1).withColumn("t_words", words(F.col("t_text"))).filter(F.size("t_words") > 0)
    lengths = {r["n"] for r in df.select(F.size("t_words").alias("n")).distinct().collect()}
    classes = spark.createDataFrame([(n, *window_class(n)) for n in sorted(lengths)], "n int, k int, size int, step int").coalesce(1)
    df = df.join(F.broadcast(classes), F.size("t_words") == F.col("n"))
    own = F.coalesce(*(F.when(F.col("k") == k, F.array_distinct(shingles(F.col("t_words"), k))) for k in range(1, SHINGLE + 1)))
    return df.withColumn("t_shingles", own).select("license", "template", "k", "size", "step", "t_shingles", _bands(F.col("t_shingles"), params).alias("t_bands"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, params: LicenseParams = LicenseParams()) -> DataFrame:
    """Per id and license found: ``containment``, ``first_word`` (from 0), ``n_windows``."""
    spark = docs.sparkSession
    listed = template_table(spark, templates or TEMPLATES, params).collect()  # a parameter, not data
    known = spark.createDataFrame(listed, "license string, template int, k int, size int, step int, t_shingles array<bigint>, t_bands array<bigint>").coalesce(1)
    lengths = sorted({row["k"] for row in listed})
    every = {k: F.expr("array(" + ", ".join(f"{h}L" for h in sorted({h for row in listed if row["k"] == k for h in row["t_shingles"]})) + ")") for k in lengths}

    hashed = docs.select(F.col(id_col).alias("_id"), let(words(F.col(text)), lambda w: F.struct(*(shingles(w, k).alias(f"h{k}") for k in lengths))).alias("h")).select("_id", "h.*")
    hashed = hashed.withColumns({f"d{k}": F.array_intersect(f"h{k}", every[k]) for k in lengths})  # the known shingles of a text
    some = F.size(f"d{lengths[0]}") > 0
    for k in lengths[1:]:
        some = some | (F.size(f"d{k}") > 0)

    def windows(k: int, size: int, step: int) -> Column:
        h = F.col(f"h{k}")
        at = F.filter(F.sequence(F.lit(0), F.size(h) - 1, F.lit(step)), lambda i: F.arrays_overlap(F.slice(h, i + 1, F.lit(size)), F.col(f"d{k}")))
        made = F.transform(at, lambda i: F.struct(F.lit(k).alias("k"), F.lit(size).alias("size"), i.alias("at"), F.array_distinct(F.slice(h, i + 1, F.lit(size))).alias("held")))
        return F.when(F.size(f"d{k}") > 0, made).otherwise(F.array().cast("array<struct<k:int,size:int,at:int,held:array<bigint>>>"))

    classes = sorted({(row["k"], row["size"], row["step"]) for row in listed})
    cuts = hashed.filter(some).select("_id", F.explode(F.concat(*(windows(*c) for c in classes))).alias("w")).select("_id", "w.*")
    keys = cuts.select("_id", "k", "size", "at", "held", F.explode(F.array_distinct(_bands(F.col("held"), params))).alias("band"))
    wanted = known.select("license", "template", "k", "size", "t_shingles", F.explode("t_bands").alias("band")).distinct()
    met = keys.join(F.broadcast(wanted), ["k", "size", "band"])
    share = F.size(F.array_intersect("held", "t_shingles")) / F.size("t_shingles")
    verified = met.withColumn("containment", share).filter(F.col("containment") >= params.containment)
    best = verified.groupBy("_id", "license").agg(
        F.max("containment").alias("containment"),
        F.min(F.struct((-F.col("containment")).alias("c"), "at")).getField("at").cast("long").alias("first_word"),
        F.count_distinct("k", "size", "at").alias("n_windows"),
    )
    return best.select(F.col("_id").alias(id_col), "license", "containment", "first_word", "n_windows")
