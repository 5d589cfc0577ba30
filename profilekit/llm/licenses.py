"""Licence scans: a trained paragraph classifier, run with DataFrame functions alone.

A softmax regression over word unigrams and bigrams (``model``) is trained here, from constants, on notices: ``GRANTS``
with every name of ``NAMED``, sentences and windows of ``BODIES``, and on ordinary text as class "unknown": ``ORDINARY`` and
``MENTIONS``, which speak of licences without granting one. ``HELD_GRANTS``, ``HELD_MENTIONS`` and
``HELD_ORDINARY`` are kept from training and set the temperature, so that probabilities mean what they say on texts not seen. Weights are whole
numbers (``SCALE`` to one), so that sums do not depend on order. The model has a fixed size.

On the main path, all paragraphs (lines up to a blank one) are scored: the whole paragraph if it has at most ``WHOLE`` words, and
overlapping windows of it (``WINDOWS``: words, step), so that a notice inside prose counts however long the
paragraph is. Those whose bigrams cannot meet the template comparison below for any family are left out first, which
changes no result. Their n-grams are joined to the table of weights, which is broadcast (a few thousand rows); sums give
logits, logits give probabilities. One counts if a family is likelier than unknown, its probability is at least ``SURE``, and
the template comparison (``TEMPLATES``) confirms it: at least ``OVERLAP`` of its bigrams are in notices of that
family, and, in a window, one of these with a licence's name (``NAMES``) or ``BODY`` of them. The widest that is confirmed
speaks for its paragraph, a document gets the family of its surest paragraph.

Defined cases: null and empty texts have no licence; rows that repeat a doc_id and text are scored once and all
returned with that result; null ids are kept; ties go to the family first in the alphabet; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURE, OVERLAP, BODY, WHOLE, SCALE = 0.6, 0.45, 8, 120, 256
WINDOWS = ((4, 1), (6, 2), (10, 3), (16, 5), (30, 10))
# Stems of notices, words of licences' names, names, and public notices.
NAMES = frozenset("apache mit gnu gpl gplv2 gplv3 lgpl agpl agplv3 affero lesser mozilla mpl bsd isc cc cc0 creative commons spdx reserved proprietary".split())
#: Stems that ``oracle`` asks for; the operator does not.
ANCHORS = ("licen", "copyright", "warrant", "redistribut", "rights reserved", "public domain", "creative commons", "cc by", "cc-by", "cc0", "gnu ", "gpl", "spdx", "permission", "proprietary")
NAMED: dict[str, tuple[str, ...]] = {
    "AGPL": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL", "AGPLv3", "AGPL-3.0-only"),
    "Apache-2.0": ("Apache License", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "BSD": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-3-Clause"),
    "CC-BY": ("Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 3.0 license", "CC-BY-4.0"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 3.0 license", "CC-BY-NC-4.0"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0 license", "CC-BY-SA-4.0"),
    "CC0": ("CC0", "CC0 1.0 Universal", "Creative Commons Zero", "CC0 public domain dedication", "CC0-1.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL version 2", "GPLv2", "GPL-2.0-only"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL version 3", "GPLv3", "GPL-3.0-or-later"),
    "ISC": ("ISC License", "ISC"),
    "LGPL": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL", "LGPL v3", "LGPL-2.1-or-later"),
    "MIT": ("MIT License", "MIT licence", "MIT"),
    "MPL-2.0": ("Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "proprietary": (),
}
GRANTS = (
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "This project is licensed under the terms of the {}.",
    "Distributed under the {}; see the file for details.",
    "The code is available under the {} license.",
    "SPDX-License-Identifier: {}",
    "License: {}",
)
MENTIONS = (
    "He had a copy of the {} on his desk.",
    "The lecture on the {} was held in the large hall and many came.",
    "They argued about the {} for years and never agreed.",
    "She read the {} twice and wrote a letter to the newspaper.",
    "A history of the {} would fill a book.",
    "{} and other names were on the list of the meeting.",
    "{}",
    "the {}",
    "about the {} of old",
    "of the {} is",
    "when the {} was",
    "if the {} has",
)
HELD_GRANTS = ("Published under the {}.", "This file is subject to the {}.", "You may use it under the terms of the {}.", "The software in this directory is under the {}.")
HELD_MENTIONS = ("The old man had never heard of the {} before the trial.", "In the museum a page of the {} hangs beside the door.", "Whether the {} is good or bad was asked in the exam.")
BODIES: dict[str, tuple[str, ...]] = {
    "AGPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain. Released into the public domain by the author.",
    ),
    "GPL-2.0": ("as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version of the GNU General Public License.",),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, stored or transmitted without the prior written permission of the publisher.",
        "This document is proprietary and confidential.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
ORDINARY = (
    "The driving license was renewed in the spring and the office was closed.",
    "He had no license to practise and the committee asked for permission to speak in the hall.",
    "They gave permission for the children to go to the museum with the teacher.",
    "The warranty on the washing machine covers two years of use in the home.",
    "She wrote about copyright in the newspaper and about the history of the public library.",
    "The version of the story that was published in the magazine is not the one that you may know.",
    "It is to be noted that this is the work of many people and that the terms of the agreement are open.",
    "A copy of the letter was sent to the general and the public was not told of the software.",
    "The fishing licence costs twenty pounds and can be obtained at the post office.",
    "Under the bridge the river is free and the source of the water is in the hills.",
    "The warrant was signed and the police went to the house with the file and the notice.",
    "Public domain names are sold by the registrar for a fee for any purpose.",
    "Soup is granted free of charge to any person who asks at the door of the church.",
    "The copyright of the photograph belongs to the family of the sailor.",
    "All seats are reserved and the rights of the passengers are listed on the back of the ticket.",
    "A licensed guide led the visitors under the walls and released the birds.",
    "The use of the hall, with or without music, is permitted on weekdays.",
    "The permission of the owner is needed to copy the key.",
)
HELD_ORDINARY = (
    "The pilot lost his licence after the second flight and moved to the coast.",
    "The warranty ended in March, so the shop would not repair the clock.",
    "Permission to build the tower was refused by the council.",
    "The gun licence was hereby declared void by the judge.",
    "Any person may walk free of charge through the garden and take a copy of the map.",
    "The history of copyright in the theatre is long.",
    "The restaurant was licensed in May and released its menu to the public.",
)
TEMPLATES = {k: (*BODIES.get(k, ()), *(g.format(n) for n in names for g in GRANTS)) for k, names in NAMED.items()}
_LOWER = (string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(r"[^a-z0-9.]+", text.translate(str.maketrans(*_LOWER)))) if w]


def grams_of(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _training(classes: list[str]) -> Iterator[tuple[list[str], int]]:
    unknown = len(classes) - 1
    for k, name in enumerate(classes[:-1]):
        for g in GRANTS:
            for n in NAMED[name]:
                yield words_of(g.format(n)), k
        for text in BODIES.get(name, ()):
            words = words_of(text)
            yield words, k
            for a in range(0, len(words) - 9, 6):
                yield words[a : a + 14], k
    for text in (*ORDINARY, *(m.format(n) for names in NAMED.values() for n in names for m in MENTIONS)):
        words = words_of(text)
        yield words, unknown
        for a in range(0, len(words) - 5, 3):
            yield words[a : a + 8], unknown
    yield from (([w], unknown) for text in ORDINARY for w in words_of(text))
    yield from [([], unknown)] * 20


def held_out() -> list[tuple[str, str]]:
    """(text, family) pairs that take no part in training."""
    notices = [(g.format(n), k) for k, names in NAMED.items() for n in names for g in HELD_GRANTS]
    mentions = [(m.format(n), "unknown") for names in NAMED.values() for n in names for m in HELD_MENTIONS]
    return [*notices, *mentions, *((t, "unknown") for t in HELD_ORDINARY)]


@cache
def model() -> tuple[list[str], dict[str, list[int]], list[int], dict[str, int]]:
    """Classes (unknown last), weights by n-gram, biases, and for each bigram the families whose notices hold it as bits."""
    classes = [*sorted(TEMPLATES), "unknown"]
    cases = list(_training(classes))
    names = sorted({g for words, _ in cases for g in grams_of(words)})
    at = {g: i for i, g in enumerate(names)}

    def table(texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(names)), np.float32)
        for r, words in enumerate(texts):
            x[r, [at[g] for g in grams_of(words) if g in at]] = 1
        return x

    x, y = table([words for words, _ in cases]), np.array([k for _, k in cases])
    onehot, weight = np.eye(len(classes), dtype=np.float32)[y], 1 / np.bincount(y, minlength=len(classes))[y]
    weight = np.where(y == len(classes) - 1, 4, 1) * weight / weight.sum()
    w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    mw, mb = w, b
    for step in range(200):  # accelerated full gradients
        z = x @ mw + mb
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = ((onehot - p / p.sum(axis=1, keepdims=True)) * weight[:, None]).astype(np.float32)
        nw, nb = mw + 2.0 * (x.T @ g - 1e-4 * mw), mb + 2.0 * g.sum(axis=0)
        mw, mb = nw + step / (step + 3) * (nw - w), nb + step / (step + 3) * (nb - b)
        w, b = nw, nb
    held = held_out()
    z, is_ = table([words_of(t) for t, _ in held]) @ w + b, np.array([classes.index(k) for _, k in held])

    def loss(heat: float) -> float:
        s = z * heat - (z * heat).max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), is_]).mean())

    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss) * SCALE
    bits: dict[str, int] = {}
    for k, name in enumerate(classes[:-1]):
        for text in TEMPLATES[name]:
            words = words_of(text)
            for a, c in zip(words, words[1:], strict=False):
                bits[f"{a} {c}"] = bits.get(f"{a} {c}", 0) | 1 << k
    whole = np.rint(w * heat).astype(int)
    return classes, {g: whole[i].tolist() for g, i in at.items() if whole[i].any() or g in bits}, np.rint(b * heat).astype(int).tolist(), bits


def named_bits(bits: dict[str, int]) -> dict[str, int]:
    return {g: b if NAMES.intersection(g.split()) else 0 for g, b in bits.items()}


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, para, width (0: the whole paragraph), part, words: those paragraphs and windows that ``scan`` could
    confirm for any family by their bigrams; rows that repeat a doc_id and text count once."""
    bits = model()[3]
    named, others = [g for g, b in named_bits(bits).items() if b], [g for g, b in named_bits(bits).items() if not b]
    unit, name = F.lit(1).cast("long"), 1 << 32  # of a sum of marks: bigrams of templates, and those of them with a name
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    parts = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n[ \t\r\n]*\n")).alias("para", "content"))
    words = F.filter(F.transform(F.split(F.translate("content", *_LOWER), "[^a-z0-9.]+"), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")
    key = ["doc_id", "text_hash", "para"]

    def once(frame: DataFrame, value: Column, name: str) -> DataFrame:
        """With a column that later filters do not compute again, as they would that of a projection."""
        return frame.select(*[c for c in frame.columns if c != "content"], F.explode(F.array(F.struct(value.alias(name)))).alias("x")).select("*", f"x.{name}").drop("x")

    def enough(total: Column, pairs: Column, whole: bool) -> Column:
        count = total % name
        share = count / F.greatest(pairs, F.lit(1)) >= OVERLAP
        return share if whole else share & ((total >= name) | (count >= BODY))

    def summed(marks: Column) -> Column:
        return F.aggregate(marks, F.lit(0).cast("long"), lambda a, v: a + v)

    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))
    marks = F.transform(pairs, lambda g: F.when(g.isin(named), unit + name).when(g.isin(others), unit).otherwise(0))
    parts = once(once(parts, words, "words").where(F.size("words") > 1), marks, "marks")
    parts = once(parts, summed(F.col("marks")), "total")
    small = (F.size("words") <= WHOLE) & enough(F.col("total"), F.size("marks"), True)
    parts = parts.where(small | (F.col("total") >= name) | (F.col("total") >= BODY))

    def cut(width: int, step: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + step, F.lit(1)), F.lit(step))
        inside = lambda i: F.slice("marks", i, width - 1)
        starts = F.filter(starts, lambda i: enough(summed(inside(i)), F.size(inside(i)), False))
        parts = F.transform(starts, lambda i: F.struct(F.lit(width).alias("width"), i.alias("part"), F.slice("words", i, width).alias("words")))
        return F.when((F.size("words") > width) & ((F.col("total") >= name) | F.lit(width > BODY)), parts)

    whole = F.array(F.struct(F.lit(0).alias("width"), F.lit(0).alias("part"), F.col("words")))
    none = F.slice(whole, 1, 0)
    cuts = F.concat(F.when(small, whole).otherwise(none), *[F.coalesce(cut(*w), none) for w in WINDOWS])
    parts = parts.select(*key, F.explode(cuts).alias("x")).select(*key, "x.width", "x.part", "x.words")
    return parts.dropDuplicates([*key, "width", "part"])


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, para, width, part, family, probability, overlap, named, shared of every paragraph and window
    (family "unknown" included): bigrams shared with the family, and those of them with a name."""
    spark = docs.sparkSession
    classes, weights, bias, bits = model()
    n, named = len(classes), named_bits(bits)
    table = spark.createDataFrame([(g, bits.get(g, 0), named.get(g, 0), *w) for g, w in sorted(weights.items())], "gram string, bits long, named long, " + ", ".join(f"w{k} int" for k in range(n)))
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    key = ["doc_id", "text_hash", "para", "width", "part"]
    grams = paragraphs(docs).select(*key, pairs.alias("pairs"), "words").select(*key, F.greatest(F.size("pairs"), F.lit(1)).alias("n_pairs"), F.explode(F.array_distinct(F.concat("words", "pairs"))).alias("gram"))
    bit = lambda name, k: F.sum(F.shiftright(name, k).bitwiseAND(F.lit(1)))
    sums = (
        grams.join(F.broadcast(table), "gram")  # a few thousand rows, from constants
        .groupBy(*key, "n_pairs")
        .agg(*[F.sum(f"w{k}").alias(f"z{k}") for k in range(n)], *[bit("bits", k).alias(f"m{k}") for k in range(n - 1)], *[bit("named", k).alias(f"q{k}") for k in range(n - 1)])
    )
    logits = [F.col(f"z{k}") + F.lit(bias[k]) for k in range(n)]
    shares = [F.least(F.col(f"m{k}") / F.col("n_pairs"), F.lit(1.0)) for k in range(n - 1)] + [F.lit(0.0)]
    counts = [F.array(*[F.col(f"{c}{k}") for k in range(n - 1)], F.lit(0).cast("long")).alias(name) for c, name in (("m", "m"), ("q", "q"))]
    out = sums.select(*key, F.array(*logits).alias("z"), F.array(*shares).alias("shares"), *counts)
    out = out.withColumn("top", F.array_max("z")).withColumn("at", F.array_position("z", F.col("top")).cast("int"))
    total = F.aggregate(F.transform("z", lambda v: F.exp((v - F.col("top")) / F.lit(float(SCALE)))), F.lit(0.0), lambda a, v: a + v)
    names = F.array(*map(F.lit, classes))
    of = lambda c: F.element_at(c, F.col("at"))
    return out.select(*key, of(names).alias("family"), (1 / total).alias("probability"), of("shares").alias("overlap"), of("q").alias("named"), of("m").alias("shared"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, family (null: none), probability, n_paragraphs (confirmed paragraphs), for every row."""
    sure = classify(docs).where((F.col("family") != "unknown") & (F.col("probability") >= SURE) & (F.col("overlap") >= OVERLAP))
    sure = sure.where((F.col("width") == 0) | (F.col("named") > 0) | (F.col("shared") >= BODY))
    p = (-F.round("probability", 6)).alias("p")
    wide = F.when(F.col("width") == 0, F.lit(-(1 << 30))).otherwise(-F.col("width")).alias("wide")
    of_part = sure.groupBy("doc_id", "text_hash", "para").agg(F.min(F.struct(wide, p, F.col("family"))).alias("found"))
    best = F.min(F.struct(F.col("found.p").alias("p"), F.col("found.family").alias("family")))
    hits = of_part.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("h"))
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits["hit_id"]) & (rows["h"] == hits["hit_hash"]), "left")
    return joined.select("doc_id", F.col("best.family").alias("family"), (-F.col("best.p")).alias("probability"), F.coalesce("n", F.lit(0)).alias("n_paragraphs"))


def op10(docs: DataFrame) -> DataFrame:
    return scan(docs)


def oracle() -> str:
    """The same in DuckDB's SQL, the weights as a table of constants. There each row of ``documents`` has its own number."""
    classes, weights, bias, bits = model()
    n, named = len(classes), named_bits(bits)
    anchored: Callable[[str], str] = lambda c: "(" + " OR ".join(f"contains({c}, '{a}')" for a in ANCHORS) + ")"
    values = ", ".join(f"('{g}', {bits.get(g, 0)}, {named.get(g, 0)}, [{', '.join(map(str, w))}])" for g, w in sorted(weights.items()))
    lists = lambda f, m: "[" + ", ".join(f(k) for k in range(m)) + "]"
    windows = " UNION ALL ".join(f"SELECT r, para, {w} AS width, i AS part, list_slice(words, i, i + {w - 1}) AS words FROM (SELECT r, para, words, unnest(range(1, greatest(len(words) - {w} + {s}, 1) + 1, {s})) AS i FROM p WHERE len(words) > {w})" for w, s in WINDOWS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
p AS (SELECT r, para, list_filter(list_transform(regexp_split_to_array(translate(content, '{_LOWER[0]}', '{_LOWER[1]}'), '[^a-z0-9.]+'), lambda w: trim(w, '.')), lambda w: w <> '') AS words
 FROM (SELECT r, unnest(parts) AS content, unnest(range(len(parts))) AS para FROM (SELECT r, regexp_split_to_array(text, '\n[ \t\r\n]*\n') AS parts FROM d WHERE {anchored("lower(text)")})) WHERE {anchored("lower(content)")}),
x AS (SELECT r, para, 0 AS width, 0 AS part, words FROM p WHERE len(words) BETWEEN 1 AND {WHOLE} UNION ALL SELECT * FROM ({windows}) WHERE {anchored("array_to_string(words, ' ') || ' '")}),
y AS (SELECT r, para, width, part, words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs FROM x),
g AS (SELECT r, para, width, part, greatest(len(pairs), 1) AS n_pairs, unnest(list_distinct(list_concat(words, pairs))) AS gram FROM y),
w(gram, bits, named, v) AS (VALUES {values}),
s AS (SELECT r, para, width, part, n_pairs, {lists(lambda k: f"CAST(sum(v[{k + 1}]) AS BIGINT) + {bias[k]}", n)} AS z, {lists(lambda k: f"CAST(sum((bits >> {k}) & 1) AS BIGINT)", n - 1)} AS m, {lists(lambda k: f"CAST(sum((named >> {k}) & 1) AS BIGINT)", n - 1)} AS q
 FROM g JOIN w ON g.gram = w.gram GROUP BY ALL),
c AS (SELECT r, para, width, {classes}[k] AS family, 1 / list_sum(list_transform(z, lambda v: exp((v - z[k]) / {float(SCALE)}))) AS probability, least(m[k] / n_pairs, 1.0) AS overlap, q[k] AS named, m[k] AS shared FROM (SELECT *, list_position(z, list_max(z)) AS k FROM s) WHERE k < {n}),
o AS (SELECT r, para, min((CASE WHEN width = 0 THEN -{1 << 30} ELSE -width END, -round(probability, 6), family)) AS found FROM c WHERE probability >= {SURE} AND overlap >= {OVERLAP} AND (width = 0 OR named > 0 OR shared >= {BODY}) GROUP BY ALL),
h AS (SELECT r, min((found[2], found[3])) AS best, count(*) AS n FROM o GROUP BY r)
SELECT doc_id, best[2] AS family, -best[1] AS probability, CAST(coalesce(n, 0) AS BIGINT) AS n_paragraphs FROM d LEFT JOIN h ON d.r = h.r
"""
