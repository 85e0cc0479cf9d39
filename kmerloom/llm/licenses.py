"""Operator 10: licence scans by sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

Units are all lines of all files and, for files with a licence file's name, also the whole text; these are held against all
templates.  Notices are wrapped over lines, so for each template all runs of as many words as it has, over line ends, are
units for it too (a shorter text is one run).  A unit's vector has tf * idf for the words
of the templates and, for each other word, the mean idf of the templates' words in its length only.  idf comes from the
document frequencies over all files.  A unit takes the template of the highest cosine, the first id where equal; a file
takes its best unit's if the cosine reaches CUT.

The whole texts of licence files are also held against whole LICENCES, by the cosine over all words; one that reaches CUT goes
before notices, which licences share.  read_licences() takes further ones from a folder.

Prefix filtering: per template, words in falling weight are set aside until the rest can't reach CUT alone; a unit
without any word set aside by some template can't match and goes no further.  So few lines are exploded, however many there are.
Runs of words are looked for only in stretches that hold such a word; a run goes on if its cosine could reach CUT with
every word counted as if it occurred once.

A licence file (LICENSE*, LICENCE*, COPYING*, NOTICE*) with a licence gives it to its directory (several: the highest cosine, then the first
path); a file without an own one takes that of its nearest ancestor directory.  Every file is joined by its ancestor
paths, a handful of rows each; a directory is one row on the other side.

Everything is DataFrame functions.  Null text: no units; null path: no directory.  Every row has a key of its own in a stored table, so rows with equal or
null ids and paths are judged each by their own text.  An empty table gives no rows.  The templates are a small fixed table, so joins to them are broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, small_side, stored

#: Licence notices by SPDX id; several texts for an id are several templates.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
_MIT_TERMS = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Texts of whole licences by SPDX id: public notices, held against the whole texts of licence files only.
LICENCES = (
    ("MIT", _MIT_TERMS),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
     "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
     "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)
#: Least cosine of a match.
CUT = 0.75
LICENSE_NAME = "(?i)^(licen[sc]e|copying|notice)"


def read_licences(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Whole licences, to be given to scan() beside LICENCES: a file each, its name the SPDX id, with or without `.txt`.

    They are broadcast, so a folder of more than BROADCAST_BYTES is refused.
    """
    name = F.regexp_replace("_metadata.file_name", r"\.txt$", "")
    files = spark.read.text(folder, wholetext=True).select(name.alias("name"), F.col("value").alias("text"))
    if (files.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BROADCAST_BYTES:
        raise ValueError(f"{folder} holds more than licences")
    return sorted(tuple(r) for r in files.collect())


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))


def _words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def _weights(spark: SparkSession, files: DataFrame, templates) -> tuple[DataFrame, DataFrame, dict[str, float], list[str], float]:
    """(template, license, word, weight, idf) with unit-length weights; (template, n, ahead, gains) with each template's number
    of words, its words set aside and idf * weight by word; idf by word; all words set aside; the other words' idf."""
    vocab = sorted({w for _, t in templates for w in words(t)})
    known = F.array(*(F.lit(w) for w in vocab))
    seen = files.select(F.explode(F.array_intersect(_words(F.col("text")), known)).alias("word"))
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the templates' words
    total = files.count()
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocab}
    rows, runs, ahead = [], [], set()
    for k, (lic, text) in enumerate(templates):
        w = words(text)
        raw = {x: w.count(x) * idf[x] for x in dict.fromkeys(w)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        rows += [(k, lic, x, v / norm, idf[x]) for x, v in raw.items()]
        own, left = [], 1.0
        for x, v in sorted(raw.items(), key=lambda p: (-p[1], p[0])):
            if math.sqrt(max(left, 0.0)) < CUT - 1e-9:
                break
            own.append(x)
            left -= (v / norm) ** 2
        ahead.update(own)
        runs.append((k, len(w), own, {x: idf[x] * v / norm for x, v in raw.items()}))
    table = spark.createDataFrame(rows, "template int, license string, word string, weight double, idf double")
    plan = spark.createDataFrame(runs, "template int, n int, ahead array<string>, gains map<string,double>")
    return table, plan, idf, sorted(ahead), sum(idf.values()) / max(1, len(idf))


def _runs(texts: DataFrame, plan: DataFrame, idf: dict[str, float], ahead: list[str], other: float, most: int) -> DataFrame:
    """texts(row, text) -> row, template, w: runs of each template's number of words that may reach CUT with it."""
    w = texts.select("row", _words(F.col("text")).alias("w"))
    # Stretches of twice the longest template, each beginning in the middle of the one before: every run lies in the one where it starts.
    at = F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - 1) / most), F.lit(0)).cast("int"))
    set_aside = F.array(*(F.lit(x) for x in ahead)).cast("array<string>")
    cut = F.transform(at, lambda k: F.struct(k.alias("k"), F.slice("w", k * most + 1, 2 * most - 1).alias("w")))
    cut = F.filter(cut, lambda s: F.arrays_overlap(s["w"], set_aside))
    some = w.select("row", F.explode(cut).alias("s")).select("row", "s.k", "s.w")
    costs = F.create_map(*(F.lit(x) for p in idf.items() for x in (p[0], p[1] ** 2)))
    some = some.withColumn("cost", F.transform("w", lambda x: F.coalesce(F.try_element_at(costs, x), F.lit(other * other))))
    each = some.join(F.broadcast(plan), F.arrays_overlap(some["w"], plan["ahead"]))
    each = each.where((F.size("w") >= F.col("n")) | (F.col("k") == 0))
    each = each.withColumn("gain", F.transform("w", lambda x: F.coalesce(F.try_element_at("gains", x), F.lit(0.0))))
    total = lambda c, s: F.aggregate(F.slice(c, s, F.col("n")), F.lit(0.0), lambda a, x: a + x)
    last = F.least(F.lit(most), F.greatest(F.size("w") - F.col("n") + 1, F.lit(1)))
    # A word's squared count is at least its count, so this cosine is at least the true one.
    may = F.filter(F.sequence(F.lit(1), last), lambda s: total("gain", s) >= F.lit(CUT - 1e-6) * F.sqrt(total("cost", s)))
    return each.select("row", "template", "w", "n", F.explode(may).alias("s")).select("row", "template", F.slice("w", F.col("s"), F.col("n")).alias("w"))


def _whole_licences(texts: DataFrame, licences, first: int) -> DataFrame:
    """texts(row, text) of licence files -> row, score, t, license: cosines of whole texts to whole licences of at least CUT.

    idf comes from the licences' own words and is the same for all others, so the words that set licences apart weigh most.
    """
    vocab = [words(t) for _, t in licences]
    idf = {w: math.log((len(vocab) + 1) / (sum(w in set(v) for v in vocab) + 1)) + 1 for v in vocab for w in v}
    rows = []
    for k, (w, (lic, _)) in enumerate(zip(vocab, licences, strict=True)):
        raw = {x: w.count(x) * idf[x] for x in dict.fromkeys(w)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        rows += [(-(first + k), lic, x, v / norm) for x, v in raw.items()]
    spark = texts.sparkSession
    weights = spark.createDataFrame(rows, "t int, license string, word string, weight double")
    costs = spark.createDataFrame(list(idf.items()), "word string, idf double")
    terms = texts.select("row", F.explode(_words(F.col("text"))).alias("word")).groupBy("row", "word").agg(F.count("*").alias("tf"))
    terms = terms.join(F.broadcast(costs), "word", "left").withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    norms = terms.groupBy("row").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = terms.join(F.broadcast(weights), "word").groupBy("row", "t", "license").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 6)
    return dots.join(norms, "row").select("row", score.alias("score"), "t", "license").where(F.col("score") >= CUT)


def own_licenses(files: DataFrame, templates=TEMPLATES, licences=LICENCES) -> tuple[DataFrame, DataFrame]:
    """files(id, path, text) -> two stored tables: (row, id, path), one row per row of files; (row, path, license, score), one
    row per row of files whose best unit reaches CUT."""
    spark = files.sparkSession
    weights, plan, idfs, ahead, other = _weights(spark, files, templates)
    hint = "(?i)\\b(" + "|".join(ahead) + ")\\b" if ahead else "(?!)"
    # A cheap test on whole texts first, then on lines; both only leave out what can't match.
    named = F.regexp_extract(F.col("path"), "([^/]*)$", 1).rlike(LICENSE_NAME)
    keyed = files.select(
        F.monotonically_increasing_id().alias("row"), "id", "path", F.when(F.col("text").rlike(hint), F.col("text")).alias("text"),
        F.when(named, F.col("text")).alias("whole"),
    )
    keyed = stored(keyed, "license-files")
    texts = keyed.where("text is not null").drop("whole")
    lines = F.split(F.col("text"), "\n")
    units = F.when(named, F.concat(F.array("text"), lines)).otherwise(lines)
    rows = texts.select("row", F.explode(units).alias("unit")).where(F.col("unit").rlike(hint))
    rows = rows.select("row", F.lit(None).cast("int").alias("only"), _words(F.col("unit")).alias("w"))
    most = max((len(words(t)) for _, t in templates), default=1)
    if ahead:
        runs = _runs(texts.select("row", "text"), plan, idfs, ahead, other, most)
        rows = rows.unionByName(runs.select("row", F.col("template").alias("only"), "w"))
    # Equal units are scored once, however many files hold them.
    rows = stored(rows.withColumn("u", F.xxhash64(F.array_join("w", " "))), "license-units")
    line = rows.groupBy("u").agg(F.any_value("w").alias("w"))
    terms = line.select("u", F.size("w").alias("size"), F.explode("w").alias("word")).groupBy("u", "size", "word").agg(F.count("*").alias("tf"))
    idf = weights.groupBy("word").agg(F.first("idf").alias("idf"))
    terms = terms.join(F.broadcast(idf), "word")
    inner = terms.groupBy("u").agg(
        (F.sum(F.pow(F.col("tf") * F.col("idf"), 2)) + (F.first("size") - F.sum("tf")) * F.lit(other * other)).alias("norm2")
    )
    dots = terms.join(F.broadcast(weights.drop("idf")), "word").groupBy("u", "template", "license").agg(
        F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot")
    )
    scored = dots.join(inner, "u").withColumn("score", F.round(F.col("dot") / F.sqrt("norm2"), 6)).where(F.col("score") >= CUT)
    scored = stored(scored.select("u", "template", "score", (-F.col("template")).alias("t"), "license"), "unit-scores")
    found = rows.select("row", "only", "u").join(small_side(scored, 64), "u").where("only is null or only = template")
    whole = _whole_licences(keyed.where("whole is not null").select("row", F.col("whole").alias("text")), licences, len(templates))
    found = found.select("row", F.lit(0).alias("whole"), "score", "t", "license").unionByName(whole.withColumn("whole", F.lit(1)))
    best = found.groupBy("row").agg(F.max(F.struct("whole", "score", "t", "license")).alias("b"))
    best = best.join(keyed.select("row", "path"), "row").select("row", "path", "b.license", "b.score")
    return keyed.select("row", "id", "path"), stored(best, "own-licenses")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates=TEMPLATES, licences=LICENCES) -> DataFrame:
    """files(id, path, text) -> (id, path, own_license, score, license, inherited_from), one row per row of files."""
    every, own = own_licenses(files, templates, licences)
    named = F.regexp_extract(F.col("path"), "([^/]*)$", 1).rlike(LICENSE_NAME)
    dirs = own.where(named).select(_directory(F.col("path")).alias("dir"), "path", "license", "score")
    dirs = dirs.groupBy("dir").agg(F.min_by("license", F.struct((-F.col("score")).alias("s"), "path")).alias("dir_license"))
    dirs = small_side(stored(dirs, "directory-licenses"), 256)
    rows = every.join(own.select("row", F.col("license").alias("own_license"), "score"), "row", "left")
    rows = stored(rows, "file-licenses")
    parts = F.split(_directory(F.col("path")), "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    chain = rows.where("own_license is null and path is not null").select("row", F.explode(F.array_distinct(prefixes)).alias("dir"))
    near = chain.join(dirs, "dir").groupBy("row").agg(F.max(F.struct(F.length("dir").alias("l"), "dir", "dir_license")).alias("n"))
    out = rows.join(near, "row", "left")
    return out.select(
        "id", "path", "own_license", "score", F.coalesce("own_license", "n.dir_license").alias("license"), F.col("n.dir").alias("inherited_from")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/lang/block of 64 ids/name; ids divisible by 16 are their directories' licence files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.when(F.col("doc_id") % 16 == 0, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    block = F.concat(F.lit("b"), F.floor(F.col("doc_id") / 64))
    up = F.when(F.col("doc_id") % 64 == 0, F.concat_ws("/", "source", "lang", name)).otherwise(F.concat_ws("/", "source", "lang", block, name))
    files = docs.select(F.col("doc_id").alias("id"), up.alias("path"), "text")
    return scan(files).withColumnRenamed("id", "doc_id")
