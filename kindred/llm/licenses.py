"""License scans by a positional index of rare words, in DataFrame expressions only.

The index holds, for each licence template, its words of highest inverse document frequency among the templates, each
with its position. A file's words are looked up in it; every hit votes for (template, position in the file less
position in the template); a template matches where the votes on one offset carry enough of its weight and where its
mandatory phrases stand in the file. Base phrases are searched by themselves, in every text.

Defined results: null is an empty text (no words, no labels, score 0); score is the largest share of a matched
template's weight, and 1 where a base phrase stands. Repeated rows are scanned one by one; further columns are ignored.
No shuffle: one pass over the texts, and only those that hold a stem of licence language are cut into words.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.winnowing import let

#: label and words of the phrases whose places are counted; fixed by the contract of the query
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))

#: Notices by which works name their licence, and clauses of the licences' own texts that hold no name or year: label, words,
#: phrases that must stand in the file. Fixed values.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache", "Licensed under the Apache License Version 2 0", ("apache license",)),
    ("gpl", "This work is licensed under the GNU General Public License version 3", ("general public license",)),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("cc-by-nc", "Licensed under CC BY NC 4 0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY SA 4 0", ("cc by sa",)),
    ("cc-by", "Licensed under CC BY 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial 4 0 International License", ("attribution noncommercial",)),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike 4 0 International License", ("attribution sharealike",)),
    ("cc-by", "Creative Commons Attribution 4 0 International License", ("commons attribution 4 0",)),
    ("cc0", "Creative Commons CC0 1 0 Universal Public Domain Dedication", ("cc0 1 0",)),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "Released under the BSD License", ("bsd license",)),
    ("mpl", "subject to the terms of the Mozilla Public License", ("mozilla public license",)),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("proprietary", "All rights reserved", ("all rights reserved",)),
    ("mit", "to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished to do so", ("sublicense and or sell copies", "persons to whom the software is furnished")),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ("this permission notice shall be included",)),
    ("bsd", "Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("zlib", "Permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("alter it and redistribute it freely",)),
    ("bsl", "Permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the Software to use reproduce display distribute execute and transmit the Software", ("any person or organization obtaining a copy",)),
    ("apache", "Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied See the License for the specific language governing permissions and limitations under the License", ("agreed to in writing software distributed under the license", "limitations under the license")),
    ("apache", "Subject to the terms and conditions of this License each Contributor hereby grants to You a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare Derivative Works of publicly display publicly perform sublicense and distribute the Work and such Derivative Works in Source or Object form", ("each contributor hereby grants to you a perpetual",)),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("terms of the gnu general public license",)),
    ("lgpl", "This library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("terms of the gnu lesser general public license",)),
    ("agpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("terms of the gnu affero general public license",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0 If a copy of the MPL was not distributed with this file You can obtain one at", ("source code form is subject to the terms of the mozilla public license",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    ("unlicense", "Anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish use compile sell or distribute this software",)),
    ("artistic", "You may distribute your Modified Version as Source either gratis or for a Distributor Fee under the Artistic License", ("artistic license",)),
    ("cc0", "To the greatest extent permitted by but not in contravention of applicable law Affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of Affirmer s Copyright and Related Rights", ("unconditionally waives abandons and surrenders all",)),
    ("cc-by", "Subject to the terms and conditions of this Public License the Licensor hereby grants You a worldwide royalty free non sublicensable non exclusive irrevocable license to exercise the Licensed Rights in the Licensed Material", ("non sublicensable non exclusive irrevocable license to exercise the licensed rights",)),
)
#: a text without any of these stems can't match a template
STEMS = ("licen", "creative commons", "permission", "redistribution", "unencumbered", "anyone is free", "affirmer", "rights reserved", "cc by")
RARE_WORDS = 6
LEAST_SHARE = 0.6
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RAW_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def index(templates: tuple = TEMPLATES, rare_words: int = RARE_WORDS) -> tuple[list[tuple[str, int, int, float]], list[float]]:
    """Postings (word, template, position, weight) of each template's rarest words, and each template's whole weight.
    Weight: inverse document frequency among the templates."""
    words = [t[1].lower().split() for t in templates]
    held: dict[str, int] = {}
    for ws in words:
        for w in set(ws):
            held[w] = held.get(w, 0) + 1
    idf = {w: math.log((len(words) + 1) / n) for w, n in held.items()}
    postings, whole = [], []
    for t, ws in enumerate(words):
        best = sorted(range(len(ws)), key=lambda i: (-idf[ws[i]], i))[:rare_words]
        postings += [(ws[i], t, i, round(idf[ws[i]], 6)) for i in sorted(best)]
        whole.append(sum(round(idf[ws[i]], 6) for i in best))
    return postings, whole


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def phrase_places(words: Column, phrase: tuple[str, ...]) -> Column:
    """array<int>: where the phrase's words stand consecutively."""
    at = F.transform(words, lambda w, i: F.when(w == phrase[-1], reduce(lambda a, b: a & b, (F.get(words, i - (len(phrase) - 1 - j)) == phrase[j] for j in range(len(phrase) - 1)), i >= len(phrase) - 1) & F.lit(True)))
    return F.transform(F.filter(F.transform(at, lambda ok, i: F.when(ok, i - (len(phrase) - 1))), lambda x: x.isNotNull()), lambda x: x)


def matched(words: Column, templates: tuple = TEMPLATES) -> Column:
    """array<struct<template int, share double>>: for each template with hits, the largest share on one offset."""
    postings, whole = index(templates)
    by_word: dict[str, list[str]] = {}
    for w, t, i, weight in postings:
        by_word.setdefault(w, []).append(f"named_struct('t', {t}, 'p', {i}, 'w', {weight}D)")
    table = F.expr(f"map({', '.join(f'{quoted(w)}, array({", ".join(p)})' for w, p in by_word.items())})")
    vocabulary = F.expr(f"array({', '.join(quoted(w) for w in by_word)})")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains(vocabulary, x["word"]))
    votes = F.array_sort(F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(table, x["word"]), lambda p: F.struct(p["t"].alias("t"), (x["at"] - p["p"]).alias("offset"), p["w"].alias("w"))))))
    # one walk over the sorted votes: (template, offset) of the run, its weight so far, and the best run of each template
    best = F.expr(f"array_repeat(0D, {len(templates)})")
    start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("offset"), F.lit(0.0).alias("sum"), best.alias("best"))

    def walk(acc: Column, v: Column) -> Column:
        total = F.when((acc["t"] == v["t"]) & (acc["offset"] == v["offset"]), acc["sum"] + v["w"]).otherwise(v["w"])
        return let(total, lambda s: F.struct(v["t"].alias("t"), v["offset"].alias("offset"), s.alias("sum"), F.when(s > F.get(acc["best"], v["t"]), F.transform(acc["best"], lambda b, i: F.when(i == v["t"], s).otherwise(b))).otherwise(acc["best"]).alias("best")))

    totals = F.expr(f"array({', '.join(f'{w}D' for w in whole)})")
    return F.transform(F.aggregate(votes, start, walk)["best"], lambda b, i: F.least(b / F.get(totals, i), F.lit(1.0)))


def scan(documents: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """Every column of documents, and n_words, places (of each base phrase), shares (of each template), found (labels of
    verified templates)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    stem = reduce(lambda a, b: a | b, (F.contains(F.col("_low"), F.lit(s)) for s in STEMS))
    cut = F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")
    # base phrases need "license"; the pattern tolerates any separators, hence the bare stem
    edges = lambda ws: F.size(ws) - F.when(F.get(ws, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(ws) > 1) & (F.element_at(ws, -1) == ""), 1).otherwise(0)
    out = documents.withColumn("n_words", let(F.split(text, RAW_SEPARATORS), edges).cast("bigint"))
    out = out.withColumn("_low", low).withColumn("_stem", stem | F.expr("_low rlike 'cc[^a-z0-9]+by|rights[^a-z0-9]+reserved|creative[^a-z0-9]+commons|anyone[^a-z0-9]+is[^a-z0-9]+free|cc0'")).drop("_low")
    out = out.withColumn("_words", F.when(F.col("_stem"), cut).otherwise(F.array().cast("array<string>")))
    for label, phrase in BASE:
        out = out.withColumn(f"_{label}", F.when(F.col("_stem"), phrase_places(F.col("_words"), phrase)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("_shares", F.when(F.col("_stem"), matched(F.col("_words"), templates)).otherwise(F.expr(f"array_repeat(0D, {len(templates)})")))
    out = out.withColumn("_joined", F.when(F.col("_stem"), F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))).otherwise(F.lit("")))
    ok = [F.when((F.get(F.col("_shares"), F.lit(t)) >= LEAST_SHARE) & reduce(lambda a, b: a & b, (F.contains(F.col("_joined"), F.lit(f" {p} ")) for p in phrases)), F.struct(F.lit(label).alias("label"), F.get(F.col("_shares"), F.lit(t)).alias("share"))) for t, (label, _, phrases) in enumerate(templates)]
    out = out.withColumn("found", F.when(F.col("_stem"), F.filter(F.array(*ok), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<label:string,share:double>>")))
    return out.withColumn("places", F.struct(*(F.col(f"_{label}").alias(label) for label, _ in BASE))).drop("_stem", "_words", "_shares", "_joined", *(f"_{label}" for label, _ in BASE))


def digest(documents: DataFrame) -> DataFrame:
    rows = scan(documents.select("doc_id", "text"))
    labels = [label for label, _ in BASE]
    rows = rows.withColumn("at", F.flatten(F.array(*(F.col(f"places.{label}") for label in labels))))
    rows = rows.withColumn("base", F.filter(F.array(*(F.when(F.size(f"places.{label}") > 0, F.lit(label)) for label in labels)), lambda x: x.isNotNull()))
    name = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("at").cast("bigint").alias("n_base"), F.array_min("at").cast("bigint").alias("first_word"), F.array_max("at").cast("bigint").alias("last_word"),
        name(F.col("base")).alias("base_labels"), name(F.concat("base", F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )
