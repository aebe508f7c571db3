"""License scans: TF-IDF cosine to templates, then inheritance down the directories.

Every line of every file, every run of ``RUNS`` lines with ``MOST_WORDS`` words or fewer (headers
wrapped over comment lines, titles over two), and the whole text of a licence file are compared
with the templates by the cosine of sparse TF-IDF vectors. Document frequencies of the templates'
words count all files; a word that no template has weighs as one that no file has. A file's own
licence is that of the best of these units at ``threshold`` or more; a bare reservation of rights
counts only where no licence is found.

Comparing is cut short without loss: a template's words are ordered by weight, and its lightest
words, as long as their squares sum below the square of ``threshold``, can't reach it without
one of the others. Units with none of the others' words are not compared, nor are those that two
bounds on the cosine rule out (``promising``). Texts that agree are read once, and units that agree,
of whatever texts, are compared once. A unit stays one row: its words are counted and weighed in place.

A file without a licence of its own takes that of the nearest directory above it that has a
licence file with one. Directories, not files, are joined with their ancestors; files then
meet their directory. Everything is DataFrame work; the templates are a fixed table.

Cases: null and empty texts have no licence of their own; a null path lies in no directory and
inherits nothing. Of equal scores the template listed first counts. Rows that repeat path and
text are judged alike, and extra columns do not matter. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, table, written

#: Fixed values: (licence, title, header or statement).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
#: Counts only where no other licence reaches the threshold.
LAST_RESORT = "Proprietary"
#: Numbers of lines, and the most words, of a run of lines.
RUNS, MOST_WORDS = (2, 3, 4, 6, 8), 128
WORD = r"[a-z0-9]+(?:[.][0-9]+)*"
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)([._-][^/]*)?$"


def template_words() -> list[Counter]:
    return [Counter(re.findall(WORD, text.lower())) for _, text in TEMPLATES]


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def file_table(files: DataFrame, path_col: str, text_col: str, license_file: str = LICENSE_FILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(row, path, text, version, whole)``: texts in lower case, their hash, and whether they count as a whole."""
    path, text = col(path_col).cast("string"), F.lower(F.coalesce(col(text_col).cast("string"), F.lit("")))
    row = F.struct(*[col(c) for c in keep]) if keep else F.lit(None)
    return files.select(row.alias("row"), path.alias("path"), text.alias("text"), F.sha2(text, 256).alias("version"), F.coalesce(path.rlike(license_file), F.lit(False)).alias("whole"))


def word_weights(texts: DataFrame) -> tuple[dict[str, float], float]:
    """The idf of the templates' words over all files, and that of any other word.

    What comes to the driver is a number for each word of the templates.
    """
    vocabulary = sorted(set().union(*template_words()))
    held = F.array_intersect(F.split("text", "[^a-z0-9.]+|[.](?![0-9])"), F.array(*[F.lit(w) for w in vocabulary]))
    counted = texts.select(F.explode_outer(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}
    n = found.get("", 0)
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) + 1 for w in vocabulary}, math.log(n + 1) + 1


def template_vectors(weights: dict[str, float]) -> list[dict[str, float]]:
    """Each template's vector, of length one."""
    out = []
    for words in template_words():
        v = {w: n * weights[w] for w, n in words.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: x / norm for w, x in v.items()})
    return out


def telling_words(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Words of which a text must hold one to reach the threshold for any template."""
    out = set()
    for v in vectors:
        light = 0.0
        for w, x in sorted(v.items(), key=lambda p: (p[1], p[0])):
            light += x * x
            if light >= 0.999 * threshold * threshold:
                out.add(w)
    return sorted(out)


def at_once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, for which ``value`` is computed once, however often ``then`` names it in lambdas."""
    return F.transform(F.array(value), then)[0]


def promising(words: Column, weights: dict[str, float], other: float, vectors: list[dict[str, float]], threshold: float) -> Column:
    """Whether the cosine of ``words`` can reach the threshold for any template, by two bounds.

    It is no more than the length of what a template has in the words held, and than the share that
    template words have in the words' own length; each other word adds ``other`` squared at least.
    """
    least = 0.999 * threshold * threshold
    known = sorted(weights)
    vocabulary = F.array(*[F.lit(w) for w in known])
    table_of = lambda xs: F.map_from_arrays(vocabulary, F.array(*[F.lit(x) for x in xs]))
    most, idfs = table_of([max(v.get(w, 0.0) for v in vectors) ** 2 for w in known]), table_of([weights[w] for w in known])
    held = F.array_intersect(words, vocabulary)
    added = lambda value: F.aggregate(held, F.lit(0.0), lambda a, w: a + value(w))
    own = added(lambda w: F.pow((F.size(words) - F.size(F.array_remove(words, w))) * F.element_at(idfs, w), F.lit(2.0)))
    rest = F.size(F.array_except(words, vocabulary)) * F.lit(other * other)
    return (added(lambda w: F.element_at(most, w)) >= least) & (own * (1 - least) >= rest * least)


def license_units(texts: DataFrame, weights: dict[str, float], other: float, vectors: list[dict[str, float]], threshold: float) -> DataFrame:
    """``(version, whole, unit)``: the words of lines, runs and whole texts that can reach the threshold, once for equal texts."""
    telling = r"(?<![a-z0-9.])(?:" + "|".join(re.escape(w) for w in telling_words(vectors, threshold)) + r")(?![a-z0-9])"
    words_of = lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    line = lambda x: F.struct(words_of(x).alias("words"), x.rlike(telling).alias("telling"))

    def units(lines: Column) -> Column:
        def run(i: Column, width: int) -> Column:
            own = F.slice(lines, i + 1, width)
            fits = (F.size(own) == width) & F.exists(own, lambda o: o["telling"]) & (F.aggregate(own, F.lit(0), lambda a, o: a + F.size(o["words"])) <= MOST_WORDS)
            return F.when(fits, F.flatten(F.transform(own, lambda o: o["words"])))

        single = F.transform(F.filter(lines, lambda x: x["telling"]), lambda x: x["words"])
        runs = F.array_compact(F.flatten(F.transform(lines, lambda x, i: F.array(*[run(i, w) for w in RUNS]))))
        return F.concat(single, runs)

    different = texts.where(F.col("text").rlike(telling)).select("text", "whole").distinct()
    whole = F.when(F.col("whole"), F.array(words_of(F.col("text")))).otherwise(F.array().cast("array<array<string>>"))
    every = F.concat(at_once(F.transform(F.split("text", "\n"), line), units), whole)
    can = F.filter(every, lambda u: promising(u, weights, other, vectors, threshold))
    parts = F.array_distinct(F.transform(can, lambda u: F.array_join(u, " ")))
    # the outer form keeps Spark from testing the array's size first, by computing it once more
    return different.select(F.sha2("text", 256).alias("version"), "whole", F.explode_outer(parts).alias("unit")).where("unit IS NOT NULL")


def unit_words(units: DataFrame) -> DataFrame:
    """``(key, words)`` of each different unit: one row, its words ``array<struct<word, tf>>`` by name."""

    def counted(words: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: ~F.get(words, i - 1).eqNullSafe(F.get(words, i)))
        entry = lambda places: F.transform(places, lambda end, j: F.struct(F.get(words, end - 1).alias("word"), (end - F.coalesce(F.get(places, j - 1), F.lit(0))).alias("tf")))
        return at_once(ends, entry)

    return units.select("unit").distinct().select(F.sha2("unit", 256).alias("key"), at_once(F.sort_array(F.split("unit", " ")), counted).alias("words"))


def judged_units(units: DataFrame, weights: dict[str, float], other: float, vectors: list[dict[str, float]], threshold: float) -> DataFrame:
    """``(key, best)`` of each different unit; ``best`` is null below the threshold."""
    known = ", ".join(f"'{w}', named_struct('idf', {weights[w]!r}D, 'shares', array({', '.join(f'{v.get(w, 0.0)!r}D' for v in vectors)}))" for w in sorted(weights))
    found = F.transform("words", lambda c: F.struct(c["tf"].alias("tf"), F.try_element_at(F.expr(f"map({known})"), c["word"]).alias("known")))
    weighed = F.transform("found", lambda c: F.struct((c["tf"] * F.coalesce(c["known"]["idf"], F.lit(other))).alias("w"), c["known"]["shares"].alias("shares")))
    norm = F.sqrt(F.aggregate("weighed", F.lit(0.0), lambda a, c: a + c["w"] * c["w"]))
    dots = F.aggregate(F.filter("weighed", lambda c: c["shares"].isNotNull()), F.array_repeat(F.lit(0.0), len(vectors)), lambda a, c: F.zip_with(a, c["shares"], lambda d, x: d + c["w"] * x))
    named = F.array(*[F.lit(name != LAST_RESORT) for name, _ in TEMPLATES])
    scores = at_once(F.col("norm"), lambda norm: F.transform("dots", lambda d, i: F.struct(F.get(named, i).alias("named"), F.round(d / norm, 6).alias("score"), (-i).alias("i"))))
    best = F.array_max(F.filter("scores", lambda x: x["score"] >= threshold))
    steps = unit_words(units).withColumn("found", found).withColumn("weighed", weighed).select("key", norm.alias("norm"), dots.alias("dots"))
    return steps.select("key", scores.alias("scores")).select("key", best.alias("best"))


def own_licenses(texts: DataFrame, threshold: float) -> DataFrame:
    """``(version, whole, licence, score)`` of the texts that have one."""
    weights, other = word_weights(texts)
    vectors = template_vectors(weights)
    units = written(license_units(texts, weights, other, vectors, threshold), "licence-units")
    judged = written(judged_units(units, weights, other, vectors, threshold), "judged-units").where("best IS NOT NULL")
    top = units.select("version", "whole", F.sha2("unit", 256).alias("key")).join(judged, "key").groupBy("version", "whole").agg(F.max("best").alias("best"))
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    return top.select("version", "whole", F.element_at(names, 1 - F.col("best.i")).alias("licence"), F.col("best.score").alias("score"))


def directory(path: Column) -> Column:
    """All before the last slash; the root is empty."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """``directories(dir)``, ``licensed(dir, licence)`` -> ``(dir, from_dir, inherited)`` by the nearest ancestor."""
    parts = F.split("dir", "/", -1)
    above = F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("at")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))
    )
    steps = directories.select("dir", F.explode(above).alias("up")).select("dir", F.col("up.depth").alias("depth"), F.col("up.at").alias("at"))
    met = steps.join(licensed.select(F.col("dir").alias("from_dir"), "licence"), F.col("at") == F.col("from_dir"))
    return met.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "licence")).alias("near")).select("dir", F.col("near.from_dir").alias("from_dir"), F.col("near.licence").alias("inherited"))


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.6, license_file: str = LICENSE_FILE) -> DataFrame:
    """For each row ``path``, the columns ``keep``, ``licence``, ``score`` and ``from_dir``.

    ``licence`` is the file's own, with its ``score``, or else that of directory ``from_dir``.
    """
    texts = file_table(files, path_col, text_col, license_file, keep)
    own = written(own_licenses(texts, threshold), "licences")
    rows = written(texts.select("row", "path", "version", "whole", directory(F.col("path")).alias("dir")), "licence-files")
    found = rows.where("whole AND dir IS NOT NULL").join(own, ["version", "whole"])
    licensed = found.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("best")).select("dir", F.col("best.licence").alias("licence"))
    near = written(inherited(written(rows.where("dir IS NOT NULL").select("dir").distinct(), "directories"), written(licensed, "licensed-directories")), "inherited")
    mine = own.select("version", "whole", F.struct("licence", "score").alias("own"))
    out = rows.join(mine, ["version", "whole"], "left").join(near, "dir", "left")
    has = F.col("own").isNotNull()
    return out.select(
        "path",
        *[F.col("row")[c].alias(c) for c in keep],
        F.when(has, F.col("own.licence")).otherwise(F.col("inherited")).alias("licence"),
        F.col("own.score").alias("score"),
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )


def document_path(doc_id: Column, source: Column) -> Column:
    """Documents as files: 16 to a directory, of which the first is its licence file; 16 of those to one above."""
    up, at = F.floor(doc_id / 256).cast("string"), F.floor(doc_id / 16).cast("string")
    name = F.when(doc_id % 16 == 0, F.concat(at, F.lit("/LICENSE"))).when(doc_id % 256 == 1, F.lit("COPYING")).otherwise(F.concat(at, F.lit("/"), doc_id.cast("string"), F.lit(".txt")))
    return F.concat(F.coalesce(source, F.lit("none")), F.lit("/"), up, F.lit("/"), name)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", document_path(F.col("doc_id"), F.lit("all")).alias("path"))
    return scan(docs, keep=("doc_id",)).select("doc_id", "path", "licence", "score", "from_dir")


def oracle() -> str:
    """DuckDB SQL of the query; every unit is compared."""
    terms = ", ".join(f"({i}, '{w}', {n})" for i, words in enumerate(template_words()) for w, n in sorted(words.items()))
    names = ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(TEMPLATES))
    match = r"'(^|/)(un)?(licen[cs]e|copying|notice)([._-][^/]*)?$', 'i'"
    return f"""
WITH t(i, word, n) AS (VALUES {terms}), names(i, licence) AS (VALUES {names}),
d AS (
  SELECT doc_id, lower(coalesce(text, '')) AS text,
    'all/' || (doc_id // 256) || '/' || CASE WHEN doc_id % 16 = 0 THEN (doc_id // 16) || '/LICENSE' WHEN doc_id % 256 = 1 THEN 'COPYING' ELSE (doc_id // 16) || '/' || doc_id || '.txt' END AS path
  FROM documents
), f AS (SELECT *, regexp_replace(path, '(^|/)[^/]*$', '') AS dir, regexp_matches(path, {match}) AS is_lic FROM d),
total AS (SELECT count(*) AS n FROM f),
df AS (
  SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '[.]([^0-9]|$)', ' \\1', 'g'), '[^a-z0-9.]+')) AS word FROM f)
  WHERE word IN (SELECT word FROM t) GROUP BY word
), idf AS (
  SELECT word, ln(((SELECT n FROM total) + 1)::DOUBLE / (coalesce(df.n, 0) + 1)) + 1 AS w FROM (SELECT DISTINCT word FROM t) LEFT JOIN df USING (word)
), tv AS (
  SELECT i, word, t.n * w / sqrt(sum(t.n * w * t.n * w) OVER (PARTITION BY i)) AS x FROM t JOIN idf USING (word)
), counted AS (
  SELECT doc_id, ls, [len(regexp_extract_all(x, '{WORD}')) FOR x IN ls] AS ns FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM f)
), lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS place, unnest(ls) AS line FROM counted
), parts AS (
  SELECT doc_id, place * 16 AS place, line FROM lines
  UNION ALL SELECT doc_id, -1, text FROM f WHERE is_lic
  UNION ALL SELECT doc_id, place * 16 + width, array_to_string(ls[place:place + width - 1], chr(10))
  FROM (SELECT *, list_sum([n FOR n IN ns[place:place + width - 1]]) AS words FROM
        (SELECT doc_id, ls, ns, unnest(range(1, len(ls) + 1)) AS place FROM counted), (SELECT unnest({list(RUNS)}) AS width) WHERE place + width - 1 <= len(ls))
  WHERE words <= {MOST_WORDS}
), pw AS (
  SELECT doc_id, place, word, count(*) AS tf FROM (SELECT doc_id, place, unnest(regexp_extract_all(line, '{WORD}')) AS word FROM parts) GROUP BY ALL
), pv AS (
  SELECT doc_id, place, word, tf * coalesce(w, ln((SELECT n FROM total) + 1) + 1) AS x FROM pw LEFT JOIN idf USING (word)
), norms AS (SELECT doc_id, place, sqrt(sum(x * x)) AS norm FROM pv GROUP BY ALL),
dots AS (SELECT doc_id, place, i, sum(pv.x * tv.x) AS dot FROM pv JOIN tv USING (word) GROUP BY ALL),
best AS (
  SELECT doc_id, i, round(dot / norm, 6) AS score FROM dots JOIN norms USING (doc_id, place)
  JOIN names USING (i) WHERE round(dot / norm, 6) >= 0.6
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY licence <> '{LAST_RESORT}' DESC, round(dot / norm, 6) DESC, i) = 1
), own AS (SELECT doc_id, licence, score FROM best JOIN names USING (i)),
lic AS (
  SELECT dir, licence FROM f JOIN own USING (doc_id) WHERE is_lic
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1
), near AS (
  SELECT a.dir, lic.dir AS from_dir, lic.licence AS inherited
  FROM (SELECT DISTINCT dir FROM f) a JOIN lic ON lic.dir = '' OR a.dir = lic.dir OR starts_with(a.dir, lic.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY length(lic.dir) DESC) = 1
)
SELECT doc_id, path, coalesce(own.licence, inherited) AS licence, score, CASE WHEN own.licence IS NULL THEN from_dir END AS from_dir
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)
"""


OP1_SQL = oracle()
