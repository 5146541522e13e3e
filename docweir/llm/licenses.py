"""Licence scans: passages against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import json
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices, by SPDX identifier. An identifier may have several wordings.
TEMPLATES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]

THRESHOLD = 0.8


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """The bigrams of words, in order and with repeats."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def demands(grams: list[str], least: int) -> list[tuple[list[str], int]]:
    """``(words, n)``: a text that holds ``least`` of ``grams`` holds ``n`` of ``words`` at least.

    No gram holds two of ``words``, so that each missing word costs all of its grams, and no two words the same one.
    """
    near = {w: {x for g in grams if w in g.split(" ") for x in g.split(" ")} for w in {w for g in grams for w in g.split(" ")}}
    cost = {w: sum(w in g.split(" ") for g in grams) for w in near}
    left, out = sorted(near, key=lambda w: (-len(w), w)), []
    while left:
        words: list[str] = []
        for w in left:
            if not near[w].intersection(words):
                words.append(w)
        spared = sum(c <= len(grams) - least for c in accumulate(sorted(cost[w] for w in words)))
        out.append((words, len(words) - spared))
        left = [w for w in left if w not in words]
    return [(words, n) for words, n in out if n > 0]


def _templates(spark, templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"id": i, "text": t} for i, t in templates])), "array<struct<id: string, text: string>>")))
    out = []
    for r in rows.select("id", _pairs(_words(F.col("text"))).alias("pairs")).collect():
        grams = list(dict.fromkeys(r.pairs))
        if n := len(grams):
            # Dice >= t needs a shared part that neither side can hold if it is much smaller than the other
            out.append({"id": r.id, "n": n, "wide": len(r.pairs), "least": max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9)), "most": math.floor(n * (2 - threshold) / threshold + 1e-9), "grams": grams})
            out[-1]["demands"] = [{"words": words, "n": k} for words, k in demands(grams, out[-1]["least"])]
    return out


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, matches)``, a row for each row of ``docs(doc_id, text, ...)``; no shuffle.

    ``matches`` is an array of ``(dice, license, passage, word)``. A text is put
    into lower-case words of letters and digits, and its passages are compared
    to the templates whose number of distinct bigrams allows the threshold:

    * lines, in order, and then paragraphs of more than one line (blank lines
      part them); ``passage`` counts them from 0 and ``word`` is null;
    * windows over the words of the whole text, across lines, comment signs and
      sentences: as many words as the template has (fewer at the end) from each
      word at which one of the template's bigrams begins; ``word`` counts words
      from 0 and ``passage`` is null.

    A null or empty text, and passages of fewer than two words, match nothing.
    Repeated rows stay; other columns are not used and not returned.

    Two exact bounds spare work: a passage at the threshold shares so many
    bigrams with the template that the text must meet its ``demands`` on words;
    and a window must hold the least number of hits.
    """
    known = _templates(docs.sparkSession, templates, threshold)
    none = F.array().cast("array<struct<dice: double, license: string, passage: int, word: int>>")
    if not known:
        return docs.select("doc_id", none.alias("matches"))
    least, most = min(t["least"] for t in known), max(t["most"] for t in known)
    table = F.from_json(F.lit(json.dumps(known)), "array<struct<id: string, n: int, least: int, most: int, grams: array<string>, demands: array<struct<words: array<string>, n: int>>>>")
    named = list(dict.fromkeys(w for t in known for g in t["grams"] for w in g.split(" ")))

    rows = docs.select("doc_id", "text", _words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text", "words", F.array_intersect("words", F.array(*map(F.lit, named))).alias("present"))
    met = F.exists(table, lambda t: F.forall(t["demands"], lambda d: F.size(F.array_intersect(F.col("present"), d["words"])) >= d["n"]))
    rows = rows.select("doc_id", "text", "words", ((F.size("present") > 1) & met).alias("met"))
    rows = rows.select("doc_id", F.when(F.col("met"), F.col("text")).otherwise("").alias("text"), F.when(F.col("met"), F.col("words")).otherwise(F.array()).alias("words"))
    passages = F.concat(F.split("text", "\n"), F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n"))))
    rows = rows.select("doc_id", F.transform(passages, lambda p, i: F.struct(i.alias("passage"), _words(p).alias("words"))).alias("units"), _pairs(F.col("words")).alias("pairs"))
    rows = rows.select("doc_id", F.filter("units", lambda u: F.size(u["words"]) > least).alias("units"), "pairs")
    rows = rows.select("doc_id", F.transform("units", lambda u: F.struct(u["passage"].alias("passage"), F.array_distinct(_pairs(u["words"])).alias("grams"))).alias("units"), "pairs", F.transform("pairs", lambda g, i: F.struct(i.alias("word"), g.alias("gram"))).alias("hits"))
    every = list(dict.fromkeys(g for t in known for g in t["grams"]))
    rows = rows.select("doc_id", F.filter("units", lambda u: F.size(u["grams"]).between(least, most)).alias("units"), "pairs", F.filter("hits", lambda h: h["gram"].isin(every)).alias("hits"))

    def scored(u: Column) -> Column:
        fits = F.filter(table, lambda t: F.size(u["grams"]).between(t["least"], t["most"]))
        return F.transform(fits, lambda t: F.struct((2.0 * F.size(F.array_intersect(u["grams"], t["grams"])) / (F.size(u["grams"]) + t["n"])).alias("dice"), t["id"].alias("license"), u["passage"].alias("passage"), F.lit(None).cast("int").alias("word")))

    def windows(at: str, t: dict) -> Column:
        dense = F.filter(at, lambda w, k: F.get(F.col(at), k + t["least"] - 1) - w < t["wide"])
        window = lambda w: F.slice(F.col("pairs"), w + 1, F.lit(t["wide"]))
        shared = lambda w: F.size(F.array_intersect(window(w), F.array(*map(F.lit, t["grams"]))))
        return F.transform(dense, lambda w: F.struct((2.0 * shared(w) / (F.size(F.array_distinct(window(w))) + t["n"])).alias("dice"), F.lit(t["id"]).alias("license"), F.lit(None).cast("int").alias("passage"), w.alias("word")))

    hits_of = lambda t: F.transform(F.filter("hits", lambda h: h["gram"].isin(t["grams"])), lambda h: h["word"])
    ats = [hits_of(t).alias(f"at{k}") for k, t in enumerate(known)]
    rows = rows.select("doc_id", "units", "pairs", *ats)
    found = F.concat(none, F.flatten(F.transform("units", scored)), *[windows(f"at{k}", t) for k, t in enumerate(known)])
    return rows.select("doc_id", F.filter(found, lambda m: m["dice"] >= threshold).alias("matches"))


def best_license(scanned: DataFrame) -> DataFrame:
    """``(doc_id, license, dice, licenses)``: the best match of each row, ties to the smaller name, nulls without a match; all names that match, in order, comma-joined."""
    best = F.sort_array(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return scanned.select("doc_id", F.get(best, 0).alias("b"), names.alias("licenses")).select("doc_id", F.col("b.license").alias("license"), (-F.col("b.d")).alias("dice"), "licenses")


def oracle_sql() -> str:
    """DuckDB's SQL for the best licences of ``documents``."""
    quoted = ", ".join("({}, {}, {})".format(i, *("'" + x.replace("'", "''") + "'" for x in t)) for i, t in enumerate(TEMPLATES))
    words = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    pairs = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    grams = f"list_distinct({pairs})"
    return f"""
WITH t AS (
    SELECT id, name, {grams.format("w")} AS grams, len(w) - 1 AS wide FROM (SELECT id, name, {words.format("body")} AS w FROM (VALUES {quoted}) AS v(id, name, body))
), d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), p AS (
    SELECT r, unnest(list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda x: contains(x, chr(10))))) AS body FROM d
), g AS (
    SELECT r, {grams.format("w")} AS grams FROM (SELECT r, {words.format("body")} AS w FROM p)
), s AS (
    SELECT r, {pairs.format("w")} AS s FROM (SELECT r, {words.format("text")} AS w FROM d)
), h AS (
    SELECT DISTINCT x.r, x.i, y.id FROM (SELECT r, unnest(s) AS gram, generate_subscripts(s, 1) AS i FROM s) x JOIN (SELECT id, unnest(grams) AS gram FROM t) y USING (gram)
), c AS (
    SELECT r, t.name, g.grams, t.grams AS of FROM g JOIN t ON 10 * len(g.grams) BETWEEN 6 * len(t.grams) AND 16 * len(t.grams)
    UNION ALL SELECT h.r, t.name, list_distinct(s.s[h.i:h.i + t.wide - 1]), t.grams FROM h JOIN t USING (id) JOIN s USING (r)
), m AS (
    SELECT r, name, 2.0::DOUBLE * len(list_intersect(grams, of)) / (len(grams) + len(of)) AS dice FROM c
), b AS (
    SELECT r, array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses, arg_min(name, (-dice, name)) AS name, max(dice) AS dice FROM m WHERE dice >= {THRESHOLD} GROUP BY r
)
SELECT d.doc_id, b.name AS license, b.dice, coalesce(b.licenses, '') AS licenses FROM d LEFT JOIN b USING (r)
"""
