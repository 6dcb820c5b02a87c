"""Operator 9: licence scans by a trained paragraph classifier.

Sparse word pairs (with marks for a paragraph's start and end) feed a softmax
regression whose classes are licence families and "unknown".  It is trained on
the templates below, parts of them, sentences about licences that grant none,
and a bounded sample of the corpus's own lines.  A temperature, fitted on
examples left out of training, calibrates the probabilities.  A prediction
counts if it is likely enough and a template of its family shares enough word
triples with the paragraph.

Scoring is DataFrame expressions: pairs are looked up in the model, which has a
few hundred rows whatever the input; paragraphs without any are unknown.  Equal
paragraphs are scored once.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, let, literal_rows, table

#: Characteristic sentences of licence families.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License, Version 2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike License.",
        "Released under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc0": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.",
        "Released under the GNU General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Released under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved. No part of this work may be reproduced without permission.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Sentences that mention licences and grant none.
OTHERS = (
    "She has held a driving license since 1999.", "Researchers at MIT released a new study under the direction of the dean.", "The license fee is due in March.",
    "The general public was invited to the opening.", "The software was released under great pressure.", "See the license for details.",
    "Apache helicopters were seen over the city.", "The work is based on a version of the story.", "Permission to enter is granted by the guard.",
    "Copies of the report are available free of charge.", "The licensed premises close at midnight.", "All rights and duties pass to the buyer.",
    "The library is free to enter.", "The source of the river was found.", "No part of the city was spared.",
)
WORD = r"[a-z0-9]+"
#: Corpus lines in training, at most, and characters of such a line, at most; a pair that is in a larger share of them is no feature.
SAMPLE_LINES, SAMPLE_CHARS, FREQUENT = 2000, 2000, 0.005
#: Lines with these words aren't taken for unknown ones.
SPEAKS = r"(?i)licen[sc]|copyright|gpl|spdx|creative commons|all rights|permission"
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.5, 0.6
STEPS, RATE, L2 = 300, 1.0, 1e-3


def _pairs(text: str) -> list[tuple[str, str]]:
    words = ["^", *re.findall(WORD, text.lower()), "$"]
    return list(zip(words, words[1:])) if len(words) > 2 else []


class Classifier:
    """Weights of pairs for each class (the last is unknown), and the classes' biases, all over the temperature."""

    def __init__(self, families: list[str], weights: dict[tuple[str, str], np.ndarray], bias: np.ndarray):
        self.families, self.weights, self.bias = families, weights, bias


def train(lines: list[str]) -> Classifier:
    """Softmax regression by full-batch descent; every fifth example is left out and fits the temperature."""
    families = sorted(TEMPLATES)
    examples: list[tuple[list, int]] = []
    for k, family in enumerate(families):
        for text in TEMPLATES[family]:
            words = text.split()
            examples.append((_pairs(text), k))
            # Wrapped lines: halves of long templates, and short ones inside a sentence.
            if len(words) > 12:
                examples += [(_pairs(" ".join(words[: len(words) // 2])), k), (_pairs(" ".join(words[len(words) // 2 :])), k)]
            else:
                examples += [(_pairs(f"Note: {text}"), k), (_pairs(f"{text} See the file for details."), k)]
    unknown = [(_pairs(text), len(families)) for text in (*OTHERS, *lines)]
    seen: dict[tuple[str, str], int] = {}
    for pairs, _ in unknown:
        for p in set(pairs):
            seen[p] = seen.get(p, 0) + 1
    features = sorted({p for pairs, _ in examples for p in pairs if seen.get(p, 0) <= max(1, FREQUENT * len(unknown))})
    number = {p: i for i, p in enumerate(features)}
    examples += unknown
    x = np.zeros((len(examples), len(features)))
    for row, (pairs, _) in enumerate(examples):
        for p in pairs:
            if p in number:
                x[row, number[p]] += 1
    y = np.array([k for _, k in examples])
    held = np.arange(len(y)) % 5 == 4
    classes = len(families) + 1
    weight = 1 / np.maximum(np.bincount(y[~held], minlength=classes), 1)[y]
    goal = np.eye(classes)[y]

    def descend(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((len(features), classes)), np.zeros(classes)
        part = weight[use, None] / weight[use].sum()
        for _ in range(STEPS):
            p = _softmax(x[use] @ w + b)
            error = (p - goal[use]) * part
            w -= RATE * 10 * (x[use].T @ error + L2 / classes * w)
            b -= RATE * 10 * error.sum(0)
        return w, b

    w, b = descend(~held)
    scores = x[held] @ w + b
    loss = {t: -np.log(np.maximum(_softmax(scores / t)[np.arange(held.sum()), y[held]], 1e-12)).sum() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    temperature = min(loss, key=loss.get)
    w, b = descend(np.ones(len(y), bool))
    return Classifier(families, {p: w[i] / temperature for p, i in number.items()}, b / temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _words(text: Column) -> Column:
    return F.concat(F.array(F.lit("^")), F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array(F.lit("$")))


def _hashed(text: Column, width: int) -> Column:
    """Hashes of the text's runs of so many words (with the marks, if width is 2)."""
    def grams(w):
        last = F.size(w) - width + 1
        run = F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        return F.when(last > 0, run).otherwise(F.array().cast("array<bigint>"))

    return let(_words(text), grams)


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """Licence paragraphs: doc_id, paragraph (line number from 0), family, probability, similarity.

    A paragraph is a line.  Null and empty texts have none.  Rows that repeat are
    reported once, and rows that share a doc_id each report their own.  Ties
    between families go to the first in order.  Other columns are ignored.
    """
    spark = docs.sparkSession
    k = len(model.families) + 1
    # At most as many rows as the templates have pairs of words.
    rows = [{"a": a, "b": b} | {f"w{i}": float(x) for i, x in enumerate(w)} for (a, b), w in sorted(model.weights.items())]
    weights = literal_rows(spark, rows, "a:string,b:string," + ",".join(f"w{i}:double" for i in range(k)))
    weights = weights.select(F.xxhash64("a", "b").alias("pair"), *(f"w{i}" for i in range(k)))
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode_outer(F.split("text", r"\n")).alias("paragraph", "line"))
    pairs = lines.select("doc_id", "text_key", "paragraph", "line", _hashed(F.col("line"), 2).alias("pairs")).select("*", F.explode_outer("pairs").alias("pair"))
    hit = cut(pairs.join(F.broadcast(weights.select("pair")), "pair", "left_semi").select("doc_id", "text_key", "paragraph", "line").distinct())
    own = hit.select("line").distinct()
    scores = own.select("line", F.explode(_hashed(F.col("line"), 2)).alias("pair")).join(F.broadcast(weights), "pair").groupBy("line").agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(k)))
    total = F.array(*(F.col(f"w{i}") + float(model.bias[i]) for i in range(k)))

    def chosen(z):
        top = F.array_max(z)
        place = F.array_position(z, top).cast("int")
        norm = F.aggregate(F.transform(z, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v)
        return F.struct(F.get(F.array(*map(F.lit, model.families)), place - 1).alias("family"), (1 / norm).alias("probability"))

    found = scores.select("line", let(total, chosen).alias("c")).select("line", "c.*").filter(F.col("family").isNotNull() & (F.col("probability") >= LEAST_PROBABILITY))
    texts = literal_rows(spark, [{"template_family": f, "template": t} for f, ts in TEMPLATES.items() for t in ts], "template_family:string,template:string")
    texts = texts.select("template_family", F.array_distinct(_hashed(F.col("template"), 3)).alias("t"))
    compared = found.withColumn("mine", F.array_distinct(_hashed(F.col("line"), 3))).join(F.broadcast(texts), F.col("family") == F.col("template_family"))
    # A paragraph may hold a template or be a part of one.
    common = F.size(F.array_intersect("mine", "t"))
    compared = compared.withColumn("s", common / F.greatest(F.lit(1), F.least(F.size("t"), F.size("mine"))))
    best = compared.groupBy("line", "family", "probability").agg(F.max("s").alias("similarity")).filter(F.col("similarity") >= LEAST_SIMILARITY)
    return hit.join(best, "line").select("doc_id", "paragraph", "family", "probability", "similarity")


def sample_lines(docs: DataFrame) -> list[str]:
    """Different lines of the corpus for the unknown class, the first by their hash, without long ones and those that speak of licences."""
    lines = docs.select(F.explode(F.split("text", r"\n")).alias("line")).filter(F.length("line").between(1, SAMPLE_CHARS) & ~F.col("line").rlike(SPEAKS))
    hashed = F.xxhash64("line")
    # Only hashes are ordered and sent, then the lines up to the last one.
    first = lines.select(hashed.alias("h")).distinct().orderBy("h").limit(SAMPLE_LINES).collect()
    if not first:
        return []
    found = lines.filter(hashed <= F.lit(first[-1]["h"])).distinct().orderBy(hashed, "line").limit(SAMPLE_LINES).collect()
    return [r["line"] for r in found]


def op9_licences(spark, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(sample_lines(docs)))
