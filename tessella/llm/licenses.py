"""Licence scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts are read as lower-case words of letters and digits, and as hashes of their five-word shingles. A set of shingles
is summarised by one-permutation MinHash: shingles fall into ``BANDS`` bands by their hash, and of each band the smallest
hash stays. Windows of a template's size and a quarter more, moved on by a quarter of it (of small templates: their very
size, moved on by one), retrieve the template if they share a band with it. A window that resembles a template to the
degree r misses it with probability (1 - r) ** k, k being the bands that the template fills: an uninterrupted
occurrence has a window with r of 0.8 or more and k of 7 or more, so fewer than one in 70,000 are missed, and of
templates of up to seven shingles none. An occurrence that other words interrupt lies in several windows with a part
in each, of which any may retrieve it.

As what stays of a band is a shingle itself, a window can only share one with a template around a shingle that is a
minimum of the template; only those windows are summarised, which changes no result.

Retrieved templates are verified by the exact share of their shingles that the whole text holds, however far apart, which
has to be ``CONTAINMENT``. Where another licence's template has most of them too, as another version of a licence does,
those that it has not are its marks, of which the text has to hold the share ``MARKS``. All of this is DataFrame functions; nothing runs in Python.

Templates are a fixed set, at most ``MOST`` shingles together, which is checked.

Defined results: null and empty texts match nothing, as do texts of fewer words than a shingle; a text that holds a
licence several times matches it once, with the best containment, of equal ones the place where most of the template
stands together, then the first; repeated rows are scanned each; texts of any length are read whole; an empty table
gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import bind, free_name

SHINGLE, CONTAINMENT, MARKS, BANDS = 5, 0.8, 0.5, 24
#: Shingles of all templates together: what each task holds of them.
MOST = 200_000

#: Licence notices and short licences, as they stand in files (fixed values, from the public texts of the licences).
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        _MIT,
        _MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        _BSD_TWO + _BSD_THIRD + _BSD_END,
    ],
    "BSD-2-Clause": [_BSD_TWO + _BSD_END],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "This work is marked with CC0 1.0 Universal.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(w: Column) -> Column:
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - SHINGLE + 1, F.lit(0))), lambda _, i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, in order."""
    return bind(words(text), _hashes)


def _minima(hashes: Column) -> Column:
    """Of each band the smallest hash; bands that no hash falls into are absent."""
    of_band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.filter(hashes, lambda h: F.pmod(h, F.lit(BANDS)) == b)))
    return F.filter(of_band, lambda m: m.isNotNull())


def _share(of: Column, held: Column) -> Column:
    """The share of distinct hashes that another array holds."""
    return F.size(F.array_intersect(of, held)) / F.size(of)


#: What is known of a template: distinct shingles, marks against each similar one, minima of its bands, width and step of windows.
TEMPLATE = "array<struct<license:string,hashes:array<bigint>,marks:array<array<bigint>>,minima:array<bigint>,width:int,step:int>>"


def templates(spark: SparkSession, texts: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row per template: the fields of ``TEMPLATE``."""
    rows = [(k, name, t) for k, (name, t) in enumerate((name, t) for name, many in sorted(texts.items()) for t in many)]
    made = spark.createDataFrame(rows, "template int, license string, text string").select("template", "license", F.array_distinct(shingles(F.col("text"))).alias("hashes"))
    made = made.where(F.size("hashes") > 0)
    one = made.select("template", "license", "hashes", F.explode("hashes").alias("h"))
    other = made.select(F.col("template").alias("t2"), F.col("license").alias("l2"), F.col("hashes").alias("h2"), F.explode("hashes").alias("h"))
    common = one.join(other, "h").where("license <> l2").groupBy("template", "t2").agg(F.count("*").alias("n"), F.first("hashes").alias("hashes"), F.first("h2").alias("h2"))
    similar = common.where((2 * F.col("n") > F.size("hashes")) & (F.col("n") < F.size("hashes")))
    marks = similar.groupBy("template").agg(F.collect_list(F.array_except("hashes", "h2")).alias("marks"))
    n = F.size("hashes")
    step = F.when(n < 8, 1).otherwise(F.floor(n / 4)).cast("int")
    fields = F.coalesce("marks", F.array().cast("array<array<bigint>>")).alias("marks"), _minima(F.col("hashes")).alias("minima")
    return made.join(marks, "template", "left").orderBy("template").select("license", "hashes", *fields, (n + F.when(n < 8, 0).otherwise(step)).cast("int").alias("width"), step.alias("step"))


def _known(spark: SparkSession, texts: dict[str, list[str]]) -> tuple[Column, Column]:
    """All templates as one literal, and the minima of all of them: they are few by their nature, which is checked."""
    rows = templates(spark, texts).collect()
    if (n := sum(len(r["hashes"]) for r in rows)) > MOST:
        raise ValueError(f"templates have {n} shingles, more than {MOST}")
    lists = lambda many: F.array(*[F.lit(list(x)) for x in many])
    one = [F.struct(F.lit(r["license"]), F.lit(list(r["hashes"])), lists(r["marks"]).cast("array<array<bigint>>"), F.lit(list(r["minima"])), F.lit(r["width"]), F.lit(r["step"])) for r in rows]
    minima = sorted({m for r in rows for m in r["minima"]})
    return F.array(*one).cast(TEMPLATE), F.lit(minima).cast("array<bigint>")


MATCHES = "array<struct<license:string,containment:double,first_shingle:int>>"


def scan(docs: DataFrame, text: str = "text", texts: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """docs with a column ``licenses``: array of (license, containment, first_shingle), one per licence found, in name order.

    containment: the share of a template's distinct shingles that the text holds. first_shingle: the smallest start, in
    shingles from 0, of the windows that hold most of the best template.
    """
    known, minima = _known(docs.sparkSession, texts)
    hashes, held = free_name(docs, "_h"), free_name(docs, "_held")
    out = docs.withColumn(hashes, shingles(F.col(text)))
    out = out.withColumn(held, F.array_intersect(F.col(hashes), minima))
    near = F.filter(known, lambda t: F.arrays_overlap(t["minima"], F.col(held)))
    found = F.filter(F.transform(near, lambda t: _match(F.col(hashes), t)), lambda m: m.isNotNull())
    none = F.array().cast(MATCHES)
    return out.withColumn("licenses", F.when(F.coalesce(F.size(held), F.lit(0)) > 0, bind(found, _best)).otherwise(none)).drop(hashes, held)


def _best(matches: Column) -> Column:
    """Of each licence the match of the largest containment, of equal ones the one whose window holds most, then the first."""

    def of(name: Column) -> Column:
        own = F.filter(matches, lambda m: m["license"] == name)
        return F.array_max(F.transform(own, lambda m: F.struct(m["containment"].alias("containment"), m["within"].alias("within"), m["back"].alias("back"), m["license"].alias("license"))))

    names = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["license"])))
    return F.transform(F.transform(names, of), lambda b: F.struct(b["license"].alias("license"), b["containment"].alias("containment"), (-b["back"]).cast("int").alias("first_shingle")))


def _match(hashes: Column, t: Column) -> Column:
    """The match of a template, or null: windows that share a band with it retrieve it, the whole text has to contain it."""
    places = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(t["minima"], h), i)), lambda i: i.isNotNull())
    width, step = t["width"], t["step"]
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - width + 1) / step)).cast("int")
    starts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(first(i), F.floor(i / step).cast("int")))))

    def window(k: Column) -> Column:
        shared = lambda w: F.when(F.arrays_overlap(_minima(w), t["minima"]), F.struct(_share(t["hashes"], w).alias("within"), (-k * step).alias("back")))
        return bind(F.slice(hashes, k * step + 1, width), shared)

    def verified(best: Column) -> Column:
        marked = F.forall(t["marks"], lambda m: _share(m, hashes) >= MARKS)
        match = lambda whole: F.when((whole >= CONTAINMENT) & marked, F.struct(t["license"].alias("license"), whole.alias("containment"), best["within"].alias("within"), best["back"].alias("back")))
        return F.when(best.isNotNull(), bind(_share(t["hashes"], hashes), match))

    return bind(F.array_max(F.transform(starts, window)), verified)


def plain_words(text: str) -> list[str]:
    """The words of a text as ``words`` finds them, for tests."""
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
