"""Licence scan: the Dice coefficient of word bigrams against licence templates.

Units of a text are its lines, its paragraphs of several lines (parted by blank
lines) and, where it has several paragraphs, the whole. A unit is lower-cased and cut into words of
letters and digits; its distinct word bigrams are compared with those of each
template whose size allows the coefficient to reach the limit: with a and b
bigrams it is at most 2 min(a, b) / (a + b). By the same bound a match shares so
many bigrams with a template that it must have one of a few of its words, so
texts and units without any of these are passed over. The best template of a unit is
reported if it reaches the limit; equal coefficients go to the first name.

Each row is scanned by itself, without a shuffle; the templates are a literal of
fixed size. Null and empty texts have no units; units of one word have no bigram
and match nothing. Repeated rows are reported each. Native expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 0.8

# Notices and texts as their licences give them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "BSD conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": "Released under the MIT License.",
    "MIT permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
        do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^\\p{L}\\p{N}\n]+", " "))


def _words(unit: Column) -> Column:
    return F.array_remove(F.split(unit, "[ \n]+"), "")


def _grams(words: Column) -> Column:
    """Hashes of the distinct bigrams of a list of words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda x, y: F.xxhash64(x, y)))


def anchors(words: list[str], slack: float) -> set[str]:
    """Words of a template one of which any matching unit must have.

    A match shares at least `slack` of the template's bigrams. Long words are
    taken until fewer bigrams than that are without one.
    """
    left = set(zip(words, words[1:], strict=False))
    most, out = slack * len(left) - 1e-9, set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < most:
            break
        out.add(word)
        left = {g for g in left if word not in g}
    return out


def _templates(docs: DataFrame, templates: dict[str, str]) -> list[tuple[str, list[int], list[str]]]:
    rows = docs.sparkSession.createDataFrame(sorted(templates.items()), "name string, text string").select("name", _words(_normal(F.col("text"))).alias("w"))
    rows = rows.select("name", _grams(F.col("w")).alias("g"), "w").collect()
    return [(r.name, r.g, r.w) for r in sorted(rows, key=lambda r: r.name)]


def scanned(docs: DataFrame, limit: float = LIMIT, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, kind, unit, license, dice): each unit of a text that matches a template; units count from 0 within a kind."""
    known = _templates(docs, templates)
    slack = limit / (2 - limit)
    low, high = min(len(g) for _, g, _ in known) * slack, max(len(g) for _, g, _ in known) / slack
    needed = F.array(*map(F.lit, sorted(set().union(*(anchors(w, slack) for *_, w in known)))))
    pars = F.split("t", "\n(?: *\n)+")
    units = F.concat(
        F.transform(F.split("t", "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("unit"), x.alias("text"))),
        F.filter(F.transform(pars, lambda x, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("unit"), x.alias("text"))), lambda x: F.instr(x.text, "\n") > 0),
        F.when(F.size(pars) > 1, F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("unit"), F.col("t").alias("text")))).otherwise(F.array()))
    rows = docs.where("text is not null").select("doc_id", _normal(F.col("text")).alias("t")).where(F.arrays_overlap(_words(F.col("t")), needed))
    rows = (rows.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.kind", "u.unit", _words(F.col("u.text")).alias("w"))
            .where((F.size("w") > low) & F.arrays_overlap("w", needed)).withColumn("g", _grams(F.col("w")))
            .where((F.size("g") >= low - 1e-9) & (F.size("g") <= high + 1e-9)))
    size = F.size("g")
    scores = [F.when((size >= len(g) * slack - 1e-9) & (size * slack <= len(g) + 1e-9),
                     F.lit(2.0) * F.size(F.array_intersect("g", F.array(*map(F.lit, g)))) / (size + len(g))).otherwise(0.0) for _, g, _ in known]
    best = F.array_max(F.array(*[F.struct(s.alias("dice"), F.lit(-k).alias("k")) for k, s in enumerate(scores)]))
    names = F.array(*[F.lit(name) for name, *_ in known])
    return (rows.withColumn("best", best).where(F.col("best.dice") >= limit)
            .select("doc_id", "kind", F.col("unit").cast("int").alias("unit"), F.get(names, -F.col("best.k")).alias("license"), F.col("best.dice").alias("dice")))


def _sql() -> str:
    values = ", ".join("('" + name.replace("'", "''") + "', '" + " ".join(text.split()).replace("'", "''") + "')" for name, text in TEMPLATES.items())
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]))"
    return rf"""
WITH t AS (SELECT name, {grams} AS g FROM (SELECT name, list_filter(string_split_regex(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' +'), lambda x: x <> '') AS w
           FROM (VALUES {values}) v(name, text))),
d AS (SELECT doc_id, row_number() OVER () AS k, lower(regexp_replace(text, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, string_split_regex(t, '\n(?: *\n)+') AS p, string_split(t, chr(10)) AS l FROM d),
u AS (SELECT k, doc_id, 'line' AS kind, unnest(l) AS x, unnest(range(0, len(l))) AS unit FROM p
      UNION ALL SELECT * FROM (SELECT k, doc_id, 'paragraph', unnest(p) AS x, unnest(range(0, len(p))) FROM p) WHERE contains(x, chr(10))
      UNION ALL SELECT k, doc_id, 'text', t, 0 FROM p WHERE len(p) > 1),
g AS (SELECT k, doc_id, kind, unit, {grams} AS g FROM (SELECT *, list_filter(string_split_regex(x, '[ \n]+'), lambda y: y <> '') AS w FROM u) WHERE len(w) < 400),
s AS (SELECT g.k, doc_id, kind, unit, name, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g JOIN t ON len(g.g) >= {LIMIT} / (2 - {LIMIT}) * len(t.g) - 1e-9 AND len(g.g) * {LIMIT} / (2 - {LIMIT}) <= len(t.g) + 1e-9)
SELECT doc_id, kind, unit::INTEGER AS unit, name AS license, dice FROM s WHERE dice >= {LIMIT}
QUALIFY row_number() OVER (PARTITION BY k, kind, unit ORDER BY dice DESC, name) = 1
"""


SQL = _sql()
