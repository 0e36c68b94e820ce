"""License scans: a trained paragraph classifier, with DataFrame functions alone.

A multinomial logistic regression over sparse word n-grams (1 to 3 words, hashed with CRC-32)
says which licence family a paragraph is of, or that it is of none. It is trained here, on
paragraphs made from the templates (whole, cut, damaged, and among other words) and on
paragraphs that merely use the same words; a temperature fitted on held-out paragraphs
calibrates its probabilities, the unknown class's among them. A prediction stands if the
probability is at least CERTAIN and the paragraph holds enough of one of the family's templates.

Weights are array literals of fixed size. A paragraph is a line, or a window of words that
reaches over line ends, so hard-wrapped notices are found too; a window counts unless one of its
lines, or a window before that it overlaps, names the family already. Only paragraphs with an
anchor word are classified: without all of these no template has the share that confirms it.

Cases: null and empty texts have no paragraphs, and rows without licences come out with none;
rows that repeat are scanned each by itself; other columns are not looked at.
"""

from __future__ import annotations

import functools
import random
import re
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import let
from quarry.llm.common import column_or_null, table

#: Notices and key sentences of public licences.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under CC BY",
        "Licensed under CC BY-SA",
        "Licensed under CC BY-NC",
        "Licensed under CC BY-ND",
        "Licensed under CC BY-NC-SA",
        "Licensed under CC BY-NC-ND",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Released under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited without a license.",
        "All rights reserved.",
    ),
}
#: Sentences that use licences' words and are none: the unknown class learns from them.
OTHERS = (
    "He lost his driver license and the license plate of the car.",
    "The restaurant has a license to sell wine in the public square.",
    "She gave permission to use the garden without restriction.",
    "Public transport is free of charge on the first day of the month.",
    "The rights of the person were reserved for the general public.",
    "A copy of the source was included in the work of the foundation.",
    "The version of the story that was published later is free.",
    "Released in the spring, the film was a creative work of the common people.",
    "Copyright law is a subject that students of law can choose.",
    "The license fee was raised again, and no notice was given.",
)
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
BUCKETS, NGRAMS = 4096, 3
CERTAIN, CONFIRMED = 0.5, 0.7
#: A paragraph longer than this many words is classified in windows of so many, each half overlapping the last.
WINDOW = 80
SEED, EPOCHS, RATE, L2 = 7, 300, 0.5, 1e-3
_TOKEN = re.compile(r"[a-z0-9]+")
_SPLIT = r"[^a-z0-9]+"


def tokens(text: str) -> list[str]:
    return _TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def grams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, NGRAMS + 1) for i in range(len(words) - n + 1)))


def buckets(words: list[str]) -> list[int]:
    """Numbers of a paragraph's n-grams; those of one number count once."""
    return sorted({crc32(g.encode()) % BUCKETS for g in grams(words)})


@functools.cache
def anchors() -> tuple[str, ...]:
    """Few words such that what has none of them has less than CONFIRMED of every template's n-grams."""
    ordinary = set("the this that these those under with along have should must shall will they which from your you may can any all and not are for use work terms following".split())
    common, out = {w for t in OTHERS for w in tokens(t)}, []
    for words in sorted((tokens(t) for ts in TEMPLATES.values() for t in ts), key=len):
        of = [set(g.split()) for g in grams(words)]
        while sum(not g & set(out) for g in of) >= CONFIRMED * len(of):
            out.append(max(set(words) - set(out), key=lambda w: (w not in ordinary and len(w) > 3, w not in common, sum(w in g for g in of if not g & set(out)), len(w), w)))
    return tuple(out)


def examples(rng: random.Random, n: int) -> list[tuple[list[str], int]]:
    """n training paragraphs of each class."""
    pool = [w for t in OTHERS for w in tokens(t)] + ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    known = [w for ts in TEMPLATES.values() for t in ts for w in tokens(t)]
    out = []
    for label, family in enumerate(FAMILIES):
        for _ in range(n):
            if family == UNKNOWN:
                kind = rng.random()
                if kind < 0.4:
                    words = tokens(rng.choice(OTHERS))
                elif kind < 0.7:  # a licence's words without their order
                    words = [rng.choice(known) for _ in range(rng.randint(3, 40))]
                else:
                    words = []
                words = words + [rng.choice(pool) for _ in range(rng.randint(0 if words else 3, 80))]
            else:
                words = [w for w in tokens(rng.choice(TEMPLATES[family])) if rng.random() > 0.04]
                if rng.random() < 0.6:
                    words = [rng.choice(pool) for _ in range(rng.randint(0, 50))] + words + [rng.choice(pool) for _ in range(rng.randint(0, 50))]
            out.append((words, label))
    return out


@functools.cache
def model() -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (classes x buckets), intercepts and the temperature; the same on every call."""
    rng = random.Random(SEED)
    data = examples(rng, 240)
    rng.shuffle(data)
    x = np.zeros((len(data), BUCKETS), np.float32)
    for i, (words, _) in enumerate(data):
        x[i, buckets(words)] = 1
    y = np.array([k for _, k in data])
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used]
    x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
    cut = len(data) * 4 // 5
    hot = np.eye(len(FAMILIES), dtype=np.float32)[y]

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    w, b = np.zeros((len(FAMILIES), len(used)), np.float32), np.zeros(len(FAMILIES), np.float32)
    for _ in range(EPOCHS):
        g = soft(x[:cut] @ w.T + b) - hot[:cut]
        w -= RATE * 20 * (g.T @ x[:cut] / cut + L2 / 20 * w)
        b -= RATE * g.mean(axis=0)
    z = x[cut:] @ w.T + b
    heats = np.linspace(0.05, 3, 60)
    heat = min(heats, key=lambda t: -np.log(np.maximum(1e-9, soft(z / t)[np.arange(len(z)), y[cut:]])).mean())
    full = np.zeros((len(FAMILIES), BUCKETS))
    full[:, used] = w
    return full, b.astype(float), float(heat)


def classify(words: list[str]) -> tuple[str, float]:
    """The plain version of what the DataFrame functions compute, for one paragraph's words."""
    w, b, heat = model()
    at = buckets(words)
    z = (w[:, at].sum(axis=1) / np.sqrt(max(1, len(at))) + b) / heat
    p = np.exp(z - z.max())
    p /= p.sum()
    k = int(p.argmax())
    return FAMILIES[k], float(p[k])


def _grams(words: Column) -> Column:
    """Distinct n-grams of an array of words."""
    of = lambda n: F.transform(
        F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)")),
        lambda i: F.array_join(F.slice(words, i, n), " "),
    )
    return F.array_distinct(F.concat(*[of(n) for n in range(1, NGRAMS + 1)]))


def _literal(values) -> Column:
    """A constant array: the optimizer folds the split and the cast."""
    return F.split(F.lit(",".join(f"{v:.5g}" for v in values)), ",").cast("array<double>")


def _strings(values) -> Column:
    return F.split(F.lit("|".join(values)), "\\|")


def _windows(words: Column) -> Column:
    """Words in windows that overlap by half, so a long paragraph hides no notice."""
    half = WINDOW // 2
    count = F.greatest(F.lit(1), F.ceil(F.size(words) / half).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(words, i * half + 1, F.lit(WINDOW)))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its licence families, sorted and joined by commas, how many paragraphs name
    one, and the places (line:family:probability:share of the template) of those paragraphs."""
    w, b, heat = model()
    rows = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), F.coalesce(column_or_null(docs, text_col, "string"), F.lit("")).alias("text"))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = lambda c: functools.reduce(lambda x, y: x | y, [F.contains(c, F.lit(a)) for a in anchors()])
    rows = rows.withColumn("low", low).drop("text").withColumn("maybe", has(F.col("low")))
    lines = F.transform(F.split("low", "\n", -1), lambda x, i: F.struct(i.alias("line"), F.filter(F.split(x, _SPLIT, -1), lambda v: v != "").alias("words")))
    lines = F.filter(lines, lambda x: F.size(x["words"]) > 0)
    lines = F.when(F.col("maybe"), lines).otherwise(F.expr("cast(array() as array<struct<line:int,words:array<string>>>)"))
    rows = rows.withColumn("lines", lines).drop("low", "maybe")
    named = lambda words: F.arrays_overlap(words, _strings(anchors()))

    def parts(x: Column) -> Column:
        return F.transform(let(x["words"], _windows), lambda v: F.struct(x["line"].alias("line"), x["line"].alias("to"), F.lit(False).alias("over"), v.alias("words")))

    def over_ends(lines: Column) -> Column:
        words = F.flatten(F.transform(lines, lambda x: F.transform(x["words"], lambda w: F.struct(x["line"].alias("line"), w.alias("word")))))
        parts = F.transform(let(words, _windows), lambda v: F.struct(F.get(v, F.lit(0))["line"].alias("line"), F.get(v, F.size(v) - 1)["line"].alias("to"), F.lit(True).alias("over"), v["word"].alias("words")))
        return F.filter(parts, lambda x: x["line"] < x["to"])

    own = F.flatten(F.transform(F.filter("lines", lambda x: named(x["words"])), parts))
    found = F.filter(F.concat(own, over_ends(F.col("lines"))), lambda x: named(x["words"]))
    rows = rows.withColumn("parts", F.transform(found, lambda x: F.struct(x["line"].alias("line"), x["to"].alias("to"), x["over"].alias("over"), _grams(x["words"]).alias("grams")))).drop("lines")
    # templates' own n-grams, for the confirmation
    shapes = [(k, grams(tokens(t))) for k, family in enumerate(FAMILIES) if k for t in TEMPLATES[family]]

    def scored(x: Column) -> Column:
        numbers = F.array_distinct(F.transform(x["grams"], lambda g: F.pmod(F.crc32(g), F.lit(BUCKETS)).cast("int")))

        def logits(at: Column) -> Column:
            norm = F.sqrt(F.greatest(F.lit(1), F.size(at)).cast("double"))

            def logit(k: int) -> Column:
                total = F.aggregate(F.transform(at, lambda i: F.get(_literal(w[k]), i)), F.lit(0.0), lambda s, v: s + v)
                return (total / norm + F.lit(float(b[k]))) / F.lit(heat)

            return F.array(*[logit(k) for k in range(len(FAMILIES))])

        return F.struct(*[x[c].alias(c) for c in ("line", "to", "over", "grams")], let(numbers, logits).alias("z"))

    rows = rows.withColumn("scored", F.transform("parts", scored)).drop("parts")

    def judged(x: Column) -> Column:
        top = F.array_max(x["z"])
        total = F.aggregate(F.transform(x["z"], lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v)
        return F.struct(*[x[c].alias(c) for c in ("line", "to", "over", "grams")], (F.array_position(x["z"], top) - 1).cast("int").alias("family"), (1 / total).alias("p"))

    rows = rows.withColumn("judged", F.filter(F.transform("scored", judged), lambda x: (x["family"] > 0) & (x["p"] >= CERTAIN))).drop("scored")

    def confirmed(x: Column) -> Column:
        shares = [F.when(x["family"] == k, F.size(F.array_intersect(x["grams"], _strings(g))) / len(g)).otherwise(F.lit(0.0)) for k, g in shapes]
        return F.struct(*[x[c].alias(c) for c in ("line", "to", "over")], F.get(_strings(FAMILIES), x["family"]).alias("family"), x["p"].alias("p"), F.greatest(*shares).alias("share"))

    rows = rows.withColumn("found", F.filter(F.transform("judged", confirmed), lambda x: x["share"] >= CONFIRMED)).drop("judged")
    same = lambda x, y: (y["family"] == x["family"]) & (y["line"] <= x["to"]) & (y["to"] >= x["line"]) & (~y["over"] | (y["line"] < x["line"]))
    first = F.filter("found", lambda x: ~x["over"] | ~F.exists("found", lambda y: same(x, y)))
    rows = rows.withColumn("found", F.array_sort(first))
    return rows.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("families"),
        F.size(F.array_distinct(F.transform("found", lambda x: x["line"]))).cast("long").alias("n_paragraphs"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"], F.format_number(x["p"], 3), F.format_number(x["share"], 3))), ",").alias("places"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
