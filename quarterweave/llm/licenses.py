"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a paragraph: the lines up to one without words, as notices are wrapped in most files. A block's set
is that of its words which any template has, as no others can be shared. A template matches a block that contains at least
`THRESHOLD` of the template's words. Words are ordered by how many blocks of the corpus hold them, rarest first. Then a
template of size s that needs o words in common can match only blocks that hold one of its first s - o + 1 words (prefix
filter), have o words at least (length filter), and have enough words after the shared one in that order (positional
filter). What passes is verified exactly. Templates are a parameter of checked size (`MOST_WORDS`); their words, orders and
prefixes are broadcast.

Contract of `license_scan`: a null text counts as empty; words are runs of ASCII letters, digits and all characters beyond
ASCII, A-Z lower-cased; every row gives a row, repeats and null ids too; score is the largest share of a template found
in a block where it reaches the threshold, else 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

THRESHOLD = 0.9
#: Words that all templates may have together; what tasks are told about templates is in proportion to it.
MOST_WORDS = 20_000
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Wording of public licenses and of the notices they ask for, a paragraph or sentence each, by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution International License"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl-notice", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-notice", "under the terms of the GNU Lesser General Public License"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-notice", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing
_PARAGRAPH = r"\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"  # a line without words, in comments too
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BREAK), "")


def word_set(text: str) -> list[str]:
    """The same, of a template."""
    return sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))))


def _known(block: Column, vocabulary: list[str]) -> Column:
    """Line feeds, and the words of templates, in order. The Kelvin sign, which alone is lower-cased to an ASCII letter, gives
    way to another character; other characters beyond ASCII stay such, whatever their case."""
    low = F.lower(F.replace(block, F.lit("\u212a"), F.lit("\u212b")))
    return F.filter(F.regexp_extract_all(low, F.lit(r"\n|[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0)), lambda w: w.isin("\n", *vocabulary))


def phrases(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word and _base (array of labels)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    maybe = text.rlike("(?i)license|cc")  # case-insensitive within ASCII: true wherever a phrase can be
    # Each word stands between blanks of its own, so that phrases side by side are both found.
    step = docs.withColumn("_j", F.when(maybe, F.concat(F.lit(" "), F.array_join(words(text), "  "), F.lit(" "))))
    step = step.withColumn("n_words", F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long"))
    count: dict[str, Column] = {}
    first: list[Column] = []
    last: list[Column] = []
    for phrase in PHRASES:
        form = " " + phrase.replace(" ", "  ") + " "
        count[phrase] = F.coalesce(((F.length("_j") - F.length(F.replace(F.col("_j"), F.lit(form), F.lit("")))) / len(form)).cast("long"), F.lit(0))
        in_words = lambda c: ((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("long")
        found = F.col("_j").contains(form)
        first.append(F.when(found, in_words(F.substring_index("_j", form, 1))))
        last.append(F.when(found, F.col("n_words") - in_words(F.substring_index("_j", form, -1)) - len(phrase.split())))
    out = step.withColumns(
        {
            "n_base": sum(count.values(), F.lit(0)).cast("long"),
            "first_word": F.least(*first),
            "last_word": F.greatest(*last),
            "_base": F.array_compact(F.array(*[F.when(F.col("_j").contains(" " + p.replace(" ", "  ") + " "), F.lit(label)) for p, label in PHRASES.items()])),
        }
    )
    return out.drop("_j")


def template_join(docs: DataFrame, keys: list[str], text_col: str, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(keys, _found, score): for every document with a match its labels and the largest containment."""
    spark = docs.sparkSession
    sets = [word_set(text) for _, text in templates]
    needed = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    vocabulary = sorted({w for s in sets for w in s})
    if not vocabulary or sum(map(len, sets)) > MOST_WORDS:
        raise ValueError(f"templates need words, {MOST_WORDS} at most")
    paragraph = docs.select(*keys, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), _PARAGRAPH)).alias("block"))
    joined = paragraph.select(*keys, F.array_join(_known(F.col("block"), vocabulary), " ").alias("block"))
    lines = F.split("block", "\n")
    several = F.when(F.size(lines) > 1, F.concat(lines, F.array(F.translate("block", "\n", " ")))).otherwise(lines)  # one line is the paragraph
    blocks = joined.where(F.length("block") > 0).select(*keys, F.explode(several).alias("block"))
    blocks = blocks.select(*keys, F.array_distinct(F.array_remove(F.split("block", " "), "")).alias("known"))
    blocks = stage(blocks.where(F.size("known") > 0), "blocks")
    often = {r.word: r.n for r in blocks.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # the templates' words
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    index, bodies = [], []
    for k, (s, o) in enumerate(zip(sets, needed, strict=True)):
        codes = sorted(order[w] for w in s)
        bodies.append((k, templates[k][0], codes, o))
        index += [(code, k, p, len(codes), o) for p, code in enumerate(codes[: len(codes) - o + 1])]
    prefixes = spark.createDataFrame(index, "code int, template int, p int, t_size int, needed int")
    body = spark.createDataFrame(bodies, "template int, label string, codes_t array<int>, needed_t int")
    ranks = F.create_map(*[x for w, k in order.items() for x in (F.lit(w), F.lit(k))])
    coded = blocks.where(F.size("known") >= min(needed)).select(*keys, F.sort_array(F.transform("known", lambda w: F.element_at(ranks, w))).alias("codes"))
    rare = F.array(*[F.lit(c) for c in sorted({i[0] for i in index})])
    candidates = (
        coded.where(F.arrays_overlap("codes", rare))
        .select(*keys, "codes", F.posexplode("codes").alias("q", "code"))
        .join(F.broadcast(prefixes), "code")
        .where(F.size("codes") >= F.col("needed"))
        .where(1 + F.least(F.col("t_size") - F.col("p"), F.size("codes") - F.col("q")) - 1 >= F.col("needed"))
    )
    matched = (
        candidates.join(F.broadcast(body), "template")
        .withColumn("common", F.size(F.array_intersect("codes", "codes_t")))
        .where(F.col("common") >= F.col("needed_t"))
    )
    return matched.groupBy(*keys).agg(F.collect_set("label").alias("_found"), F.max(F.col("common") / F.col("t_size")).alias("score"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    rows = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("t"))
    found = template_join(rows, ["i", "print"], "t", templates, threshold).withColumnsRenamed({"i": "i_", "print": "print_"})
    base = phrases(rows, "t").drop("t")
    joined = base.join(found, F.col("i").eqNullSafe(F.col("i_")) & (F.col("print") == F.col("print_")), "left")
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        F.col("i").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        listed(F.col("_base")).alias("base_labels"),
        listed(F.concat(F.col("_base"), F.coalesce(F.col("_found"), F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
