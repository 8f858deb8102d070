"""Operator 9, licence scan: normalised lines and paragraphs against licence notices by the Dice coefficient over word bigrams.

DataFrame functions only, inside one row: no join, no shuffle, no explode. A segment (a line, a paragraph of several lines) is
lower-cased (A-Z), reduced to runs of [a-z0-9] and turned into its set of word bigrams. Dice of at least t needs the sizes a, b to keep
t/(2-t) <= a/b <= (2-t)/t, so segments outside the bounds of every notice go first, then each notice is compared only with
segments within its own bounds. Notices are a parameter, a short list of literals.

Defined cases: null, empty and blank texts have no segment and match nothing; equal best scores go to the name first in order; repeated rows each get
a row; null ids pass; very long texts are scanned whole, all their segments in one row; an empty table gives an empty result; further columns are
left aside."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DICE = 0.8

# The notices by which these licences ask to be named, or which are in common use.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
]


def bigrams_of(text: str) -> list[str]:
    """The word bigrams of a notice, each once, in order."""
    words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _bounds(size: int, dice: float) -> tuple[int, int]:
    return math.ceil(size * dice / (2 - dice) - 1e-9), math.floor(size * (2 - dice) / dice + 1e-9)


def _words(segment: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(segment, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, dice: float = DICE) -> DataFrame:
    """doc_id, license (of the best match), dice, n_matches (segment and notice pairs), licenses (all names matched, in order)."""
    known = [(name, b) for name, text in (notices or NOTICES) if (b := bigrams_of(text))]
    low, high = (f(x) for f, x in ((min, [_bounds(len(b), dice)[0] for _, b in known]), (max, [_bounds(len(b), dice)[1] for _, b in known])))
    text = F.regexp_replace(text_of(), "\r", "")
    # a line can match by itself, or the lines of a paragraph together
    segments = F.concat(F.split(text, "\n"), F.filter(F.split(text, "\n[ \t]*\n"), lambda p: F.contains(p, F.lit("\n"))))
    # each word but the last takes two characters at least, so shorter segments can't have `low` bigrams
    long = F.filter(segments, lambda s: F.length(s) > 2 * low)
    listed = F.transform(F.filter(F.transform(long, _words), lambda w: F.size(w) > low), _bigrams)
    # a segment must have a bigram of some notice, and a size within some bounds
    every = F.array(*[F.lit(x) for x in sorted({x for _, b in known for x in b})])
    near = F.filter(listed, lambda b: F.size(b).between(low, high) & F.arrays_overlap(b, every))

    def against(b: Column) -> Column:
        found = []
        for name, mine in known:
            least, most = _bounds(len(mine), dice)
            score = 2 * F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in mine]))) / (F.size(b) + len(mine))
            found.append(F.when(F.size(b).between(least, most) & (score >= dice), F.struct((-score).alias("s"), F.lit(name).alias("name"))))
        return F.array_compact(F.array(*found))

    # best first: the greatest score, then the name
    hits = docs.select("doc_id", near.alias("near")).select("doc_id", F.array_sort(F.flatten(F.transform("near", against))).alias("hits"))
    first = F.try_element_at("hits", F.lit(1))
    return hits.select(
        "doc_id",
        first["name"].alias("license"),
        F.round(-first["s"], 6).alias("dice"),
        F.size("hits").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("hits")["name"])), ",").alias("licenses"),
    )


def _oracle() -> str:
    rows = [(n, b) for n, t in NOTICES if (b := bigrams_of(t))]
    values = ", ".join("(%d, '%s', [%s])" % (i, n, ", ".join(f"'{x}'" for x in b)) for i, (n, b) in enumerate(rows))
    return f"""
WITH notice(k, name, b) AS (VALUES {values}),
t AS (SELECT doc_id, row_number() OVER () AS r, replace(coalesce(text, ''), chr(13), '') AS text FROM documents),
parts AS (SELECT r, unnest(list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda p: contains(p, chr(10))))) AS s FROM t),
words AS (SELECT r, row_number() OVER () AS q, string_split(trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM parts),
grams AS (SELECT r, q, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
hits AS (SELECT r, name, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS s FROM grams JOIN notice ON len(g) BETWEEN len(b) / 2 AND len(b) * 2),
good AS (SELECT r, name, s, row_number() OVER (PARTITION BY r ORDER BY s DESC, name) AS k FROM hits WHERE s >= {DICE}::DOUBLE),
per AS (SELECT r, max(CASE WHEN k = 1 THEN name END) AS license, max(CASE WHEN k = 1 THEN round(s, 6) END) AS dice, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM good GROUP BY r)
SELECT doc_id, license, dice, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses FROM t LEFT JOIN per USING (r)
"""


ORACLE = _oracle()
