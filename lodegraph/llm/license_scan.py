"""Licence notices in texts, with built-in functions only.

A notice is a run of words, which may start and end anywhere in a line and go over any lines.  Its words are compared
with licence templates by the Dice coefficient over their sets of word bigrams, ``2 |A and B| / (|A| + |B|)``.  Few
runs need comparing:

* a coefficient of ``LEAST`` is out of reach if the sets differ too much in size; a run is one of a template's
  candidates if its number of bigrams, repeats included, is within these bounds;
* bigrams at the ends of a run that the template does not have only lower its coefficient, so runs start and end with
  bigrams of the template (its marks), and hold as many of them as the lower bound of size has bigrams;
* each template has anchor words, chosen so that a text without any of them shares too few bigrams with it whatever
  its size (with r template bigrams free of anchors, the coefficient is ``2 r / (r + |B|)`` at most).

All follow from the templates alone.  A mark starts runs to later marks within the template's own upper bound only, so
the work grows with the number of marks, however long the text and however short its lines.

Defined results: a null or empty text has no notice; of equally good runs the one with the first line and then the
fewest lines counts; each row is reported by itself, repeated rows included; there is no bound on the length of a text
or a line.  Licences whose notices are much alike (the GNU ones, the Creative Commons ones) are all reported, each with
its own coefficient.

Out of scope are licences without a template below and full licence bodies other than those of the BSD licences'
conditions.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.7

#: Customary licence notices by the licences' short identifiers.
TEMPLATES = (
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        ' software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR'
        " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met: 1. Redistributions of source code must retain the above copyright"
        " notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must"
        " reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "Released under the BSD License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met:",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation; either version 3 of the License, or"
        " (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
        " was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Words that are no anchors, being in most texts.
FREQUENT = frozenset(
    "a an and any are as at be by for from in into is it no not of on one or that the this to use was with you".split()
)

SIGNS = r"[^\p{L}\p{N}]+"


def bigrams_of(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors_of(bigrams: list[str], least: float) -> set[str]:
    """Words such that a text without them stays under ``least``; those in most bigrams first."""
    free, chosen = list(bigrams), set()
    while 2 * len(free) / (len(free) + len(bigrams)) >= least:
        counts = Counter(w for b in free for w in set(b.split()))
        pool = [w for w in counts if w not in FREQUENT] or list(counts)
        word = min(pool, key=lambda w: (-counts[w], w))
        chosen.add(word)
        free = [b for b in free if word not in b.split()]
    return chosen


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


Match = "struct<license:string,dice:double,first_line:int,last_line:int>"


def no_matches() -> Column:
    return F.expr(f"cast(array() as array<{Match}>)")


class Scanner:
    """Column expressions for a list of templates."""

    def __init__(self, templates, least: float):
        self.least, self.names = least, sorted({n for n, _ in templates})
        self.templates = [(n, s, len(s) * least / (2 - least), len(s) * (2 - least) / least) for n, s in templates]
        self.bigrams = sorted(set().union(*(s for _, s in templates)))
        self.anchors = sorted(set().union(*(anchors_of(s, least) for _, s in templates)))

    def words(self, text: Column) -> Column:
        """(line, word) of each word, in order."""

        def of_line(x: Column, i: Column) -> Column:
            own = F.filter(F.split(F.regexp_replace(x, SIGNS, " "), " "), lambda w: w != "")
            return F.transform(own, lambda w: F.struct(i.alias("line"), w.alias("word")))

        return F.flatten(F.transform(F.split(text, "\n", -1), of_line))

    def pairs_of(self, words: Column) -> Column:
        """(at, pair, first, last) of each bigram: its place, words and their lines."""
        rest = F.slice(words, F.lit(2), F.size(words))
        both = F.zip_with(
            F.slice(words, F.lit(1), F.size(words) - 1),
            rest,
            lambda a, b: F.struct(
                F.concat_ws(" ", a["word"], b["word"]).alias("pair"), a["line"].alias("first"), b["line"].alias("last")
            ),
        )
        return F.transform(
            both, lambda x, i: F.struct(i.alias("at"), x["pair"].alias("pair"), x["first"].alias("first"), x["last"].alias("last"))
        )

    def runs(self, pairs: Column, marks: Column, name: str, bigrams: list[str], lo: float, hi: float) -> Column:
        """Matches of one template; ``marks`` are the pairs that it has, in order."""
        least, last = ceil(lo), F.size(marks) - 1
        span = lambda i, j: F.get(marks, j)["at"] - F.get(marks, i)["at"] + 1

        def starting(i: Column) -> Column:
            def match(j: Column) -> Column:
                shared = F.size(F.array_distinct(F.slice(marks, i + 1, j - i + 1)["pair"]))
                own = F.size(F.array_distinct(F.slice(pairs, F.get(marks, i)["at"] + 1, span(i, j))["pair"]))
                return F.struct(
                    F.lit(name).alias("license"),
                    F.round(2.0 * shared / (own + len(bigrams)), 9).alias("dice"),
                    F.get(marks, i)["first"].alias("first_line"),
                    F.get(marks, j)["last"].alias("last_line"),
                )

            # as marks are at different places, no end within the bounds is farther
            ends = F.filter(F.sequence(i + least - 1, F.least(i + int(hi), last)), lambda j: span(i, j) <= hi)
            return F.filter(F.transform(ends, match), lambda x: x["dice"] >= self.least)

        # no run of fewer marks than the lower bound shares enough
        starts = F.filter(F.sequence(F.lit(0), last - least + 1), lambda i: span(i, i + least - 1) <= hi)
        return F.flatten(F.transform(starts, starting))

    def best(self, found: Column) -> Column:
        order = F.transform(found, lambda x: F.struct(x["dice"], -x["first_line"], -x["last_line"], x.alias("match")))
        return F.array_max(order)["match"]

    def of_template(self, pairs: Column, hits: Column, name: str, bigrams: list[str], lo: float, hi: float) -> Column:
        """The best match of one template, or null."""
        return let(
            F.filter(hits, lambda x: x["pair"].isin(bigrams)),
            lambda marks: F.when(
                F.size(marks) >= lo, self.best(self.runs(pairs, marks, name, bigrams, lo, hi))
            ).otherwise(F.lit(None).cast(Match)),
        )

    def of_license(self, found: Column, name: str) -> Column:
        return self.best(F.filter(found, lambda x: x["license"] == name))

    def in_words(self, text: Column) -> Column:
        """The best run of words of each licence, by licence."""
        def of_pairs(pairs: Column) -> Column:
            def of_hits(hits: Column) -> Column:
                found = [self.of_template(pairs, hits, *t) for t in self.templates]
                least = min(lo for *_, lo, _ in self.templates)
                return F.when(F.size(hits) >= least, F.array(*found)).otherwise(no_matches())

            return let(F.filter(pairs, lambda x: x["pair"].isin(self.bigrams)), of_hits)

        def by_license(found: Column) -> Column:
            kept = F.array(*(self.of_license(found, name) for name in self.names))
            return F.filter(kept, lambda x: x.isNotNull())

        def of_words(words: Column) -> Column:
            return F.when(F.size(words) > 1, let(let(self.pairs_of(words), of_pairs), by_license)).otherwise(no_matches())

        return let(self.words(text), of_words)


def scan(df: DataFrame, keep: list[str], text: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """Columns ``keep`` of each row and ``notices``: for each licence found the best run, as an array of
    (license, dice, first_line, last_line) by licence; lines count from 0."""
    scanner = Scanner([(name, bigrams_of(t)) for name, t in templates], least)
    marked = r"(?<![\p{L}\p{N}])(?:" + "|".join(scanner.anchors) + r")(?![\p{L}\p{N}])"
    kept = [F.col(c).alias(f"_{i}_keep") for i, c in enumerate(keep)]
    rows = df.select(*kept, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    notices = F.when(F.col("_text").rlike(marked), scanner.in_words(F.col("_text"))).otherwise(no_matches())
    return rows.select(*(F.col(f"_{i}_keep").alias(c) for i, c in enumerate(keep)), notices.alias("notices"))
