"""Licence scans with DataFrame functions only.

A unit of text (every line, and every block of several lines between empty
lines) is normalised to words; its set of word bigrams is compared to those of
the templates by the Dice coefficient 2 * shared / (unit + template). A
coefficient of at least t needs between t / (2 - t) and (2 - t) / t times as
many bigrams as the template has, so a unit meets only templates whose size
fits; and among these only those with which it shares a bigram.

Defined results: null and empty texts have no units; a unit of one word has that
word as its only gram; of templates that are equally near, the one whose name
sorts first is named; rows are told apart by key and text, so repeated rows give
one result; a null key is a key like any other; other columns never matter; an
empty table, or no templates, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.binding import let

THRESHOLD = 0.8
#: Most templates: they are broadcast.
MAX_TEMPLATES = 10_000

# fixed values: usual notices and headers
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _grams(words: Column) -> Column:
    """Distinct word bigrams, as hashes; a lone word is its own gram."""
    return F.array_distinct(F.when(
        F.size(words) > 1,
        F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                   lambda a, b: F.xxhash64(a, b)),
    ).otherwise(F.transform(words, lambda w: F.xxhash64(w))))


def template_grams(spark, templates: dict[str, str]) -> DataFrame:
    """(license, n_license, gram): a row per bigram of every template."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    rows = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    grams = rows.select("license", let(_words(F.col("body")), _grams).alias("g"))
    return grams.select("license", F.size("g").alias("n_license"), F.explode("g").alias("gram"))


def units(text: Column) -> Column:
    """Array of (unit, unit_no, body): lines, and blocks of more than one line."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(
        F.lit("line").alias("unit"), i.cast("long").alias("unit_no"), x.alias("body")))
    blocks = F.transform(F.split(text, r"\n[\t\r\x20]*\n\s*"), lambda x, i: F.struct(
        F.lit("block").alias("unit"), i.cast("long").alias("unit_no"), x.alias("body")))
    return F.concat(lines, F.filter(blocks, lambda b: F.trim(b["body"]).contains("\n")))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id",
                    text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, unit, unit_no, license, n_grams, n_shared, dice): the nearest template of each unit at the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    known = TEMPLATES if templates is None else templates
    wanted = template_grams(docs.sparkSession, known)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [r[0] for r in wanted.select("n_license").distinct().collect()]
    fits = F.lit(False)
    for n in sorted(sizes):
        fits = fits | F.col("n_grams").between(n * low, n * high)
    cut = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("print"),
                      F.explode(units(docs[text])).alias("u")).select("key", "print", "u.*")
    gram_sets = cut.select("key", "print", "unit", "unit_no", let(_words(F.col("body")), _grams).alias("g"))
    # a unit enters the join only if its number of bigrams fits a template
    fitting = gram_sets.withColumn("n_grams", F.size("g")).where(fits)
    probe = fitting.select("key", "print", "unit", "unit_no", "n_grams", F.explode("g").alias("gram"))
    shared = probe.join(F.broadcast(wanted), "gram").where(
        F.col("n_grams").between(F.col("n_license") * low, F.col("n_license") * high))
    scored = shared.groupBy("key", "print", "unit", "unit_no", "n_grams", "license", "n_license").agg(
        F.countDistinct("gram").alias("n_shared"))
    dice = 2.0 * F.col("n_shared") / (F.col("n_grams") + F.col("n_license"))
    near = scored.withColumn("dice", dice).where(F.col("dice") >= threshold)
    best = near.groupBy("key", "print", "unit", "unit_no").agg(F.min(F.struct(
        (-F.col("dice")).alias("d"), "license", F.col("n_grams").cast("long").alias("n_grams"), "n_shared")).alias("b"))
    return best.select(
        F.col("key").alias(key), "unit", "unit_no", "b.license", "b.n_grams", "b.n_shared",
        F.round(-F.col("b.d"), 9).alias("dice"))
