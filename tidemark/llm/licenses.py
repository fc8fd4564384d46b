"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

Paragraphs (lines) that hold an anchor word, or so many 2-grams of templates that
one may confirm a family, are scored by a multinomial logistic regression over
sparse word 1- and 2-grams, whose classes are licence families and ``unknown``. The model is trained once per process on variants of notice
templates and on other sentences with the same words; its weights are a table of
bounded size. A family counts where its probability passes a threshold that was
set on held-out unknown sentences, and where a template of the family confirms
it: the 2-grams of paragraph and template overlap by ``CONFIRM`` of the smaller set.

Without an anchor word, only confirmed paragraphs are reported.

Results for odd input: null and empty texts have no such paragraphs.
Rows are told apart by doc_id and text: rows of one doc_id with different texts are each scanned; rows that
are the same in both give their paragraphs once, and ``op5_licenses`` reports them each. Rows whose
doc_id is null take part where ``null_ids`` says so, as in ``op5_licenses``. An empty table gives no rows; other columns are
ignored. Of equal probabilities the family whose name is last counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, tables

#: Short notices of well-known licences, by family.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "This project is available under the terms of the MIT License.", "SPDX-License-Identifier: MIT", "Licensed under the terms of the MIT license, see the LICENSE file.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl-2.0": ["This program is licensed under the GNU General Public License, version 2.", "GNU General Public License version 2 only.", "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-2.0-only", "This software is released under the GNU GPL version 2 or later.", "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPLv3.", "This software is released under the GNU GPL version 3 or later."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the LGPL version 2.1 or later.", "SPDX-License-Identifier: LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the AGPLv3.", "Released under the GNU AGPL version 3."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the MPL 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Licensed under the BSD 2-Clause License."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC", "Licensed under the ISC license."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Available under the Creative Commons Attribution license."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Available under the Creative Commons Attribution-NonCommercial license."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0 Universal.", "This work is in the public domain.", "SPDX-License-Identifier: CC0-1.0", "The author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the copyright holder.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential.", "This document contains confidential information and may not be disclosed."],
}
FAMILIES = (*TEMPLATES, "unknown")
#: Sentences that share words with notices and are none.
OTHERS = [
    "She renewed her driver license at the public office last week.", "The general was in the public eye and reserved a table for version three of the story.",
    "All seats are reserved for guests with a permit.", "The warranty on the car covers the engine for five years.", "He read about the history of copyright law in the library.",
    "A fishing license is required on this lake.", "Freedom of movement and free speech are rights of the people.", "The apache tribe lived in the south of the country.",
    "The foundation was granted permission to build a school.", "The MIT campus lies by the river.", "They use the same conditions in all following experiments.",
    "The bar lost its license to serve drinks.", "Public work on the road was under way.", "The software was slow and the source of the error unknown.",
    "Released in spring, the film was free of charge for students.", "Copyright disputes between the two artists lasted for years.", "Licensed drivers may rent a car here.",
    "He applied for a licence to sell fish at the market.", "The council granted planning permission for the new hall.", "Copies of the letter were distributed to all members.", "The library is open to the general public on Sundays.", "Version 3 of the plan was released to the press.", "All rights of way are marked on the map.", "The conditions of the race were hard, and the following day it rained.", "She wrote free software for a living and taught at the university.", "The author reserved his judgement until the source was known.", "Permission slips must be signed by a parent.", "The contract was terminated without notice or compensation.", "The domain of the function is the set of real numbers.", "Notice of the meeting was given in the local paper.", "The public prosecutor dropped all charges.", "A warranty claim must include the receipt.", "The material may be used in class.", "Contributors to the volume include two historians.", "The foundation of the house had to be modified.", "International attribution of the painting is disputed.", "The commercial was shown before the film.", "He shared the work with a common friend.", "The clause was struck from the agreement.", "Terms of three years are served by each member.", "The file was closed and the case distributed to another court.",
]
ANCHOR = r"(?i)licen[sc]|copyright|rights reserved|public domain|permission|redistribut|gpl\b|\bcc0|apache 2|published by the free software|free software foundation|creative commons|\bcc[ -]by\b|mozilla public|(?-i:\b(?:BSD|ISC|MPL)\b)"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
CONFIRM = 0.5


def grams(text: str, sizes: tuple[int, ...] = (1, 2)) -> list[str]:
    words = re.findall(TOKEN, text.lower())
    return sorted({" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)})


def variants(rng: np.random.Generator, text: str, filler: list[str], n: int) -> list[str]:
    """The text itself, and versions with words lost, cut off, or framed by filler."""
    out, words = [text], text.split()
    while len(out) < n:
        w = [x for x in words if rng.random() > 0.08] or words
        if len(w) > 12 and rng.random() < 0.5:
            lo = int(rng.integers(0, len(w) - 10))
            w = w[lo : lo + int(rng.integers(10, len(w)))]
        before, after = (list(rng.choice(filler, int(rng.integers(0, 6)))) if rng.random() < 0.4 else [] for _ in range(2))
        out.append(" ".join([*before, *w, *after]))
    return out


def gate() -> tuple[str, list[str], list[str]]:
    """What a paragraph needs to be confirmed by any template: a match of this pattern (in lower case), and one of the first 2-grams or two of the others, unless it has two in all."""
    sets = [set(grams(t, (2,))) for ts in TEMPLATES.values() for t in ts]
    every = set().union(*sets)
    first: dict[str, dict[str, set[str]]] = {}
    for a, b in (g.split(" ") for g in every):
        first.setdefault(a[0], {}).setdefault(a[1:], set()).add(b)
    join = lambda parts: f"(?:{'|'.join(sorted(parts))})"
    tree = join(c + join(f"{re.escape(rest)}[^a-z0-9]+{join(map(re.escape, b))}" for rest, b in words.items()) for c, words in first.items())
    few = set().union(*(s for s in sets if CONFIRM * len(s) <= 1))
    return f"(?<![a-z0-9]){tree}", sorted(few), sorted(every)


@dataclass(frozen=True)
class LicenseModel:
    grams: tuple[str, ...]
    weights: np.ndarray  # grams x families
    bias: np.ndarray
    cutoff: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix(texts: list[str], index: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(index)), np.float32)
    for i, t in enumerate(texts):
        x[i, [index[g] for g in grams(t) if g in index]] = 1
    return x


def training_texts(seed: int, per_text: int) -> tuple[list[str], np.ndarray]:
    rng = np.random.default_rng(seed)
    filler = sorted({w for t in OTHERS for w in t.split()} | {"onre", "thable", "heer", "inst", "der", "und", "que", "de", "la", "nous", "ist"})
    texts, y = [], []
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES.get(family, OTHERS):
            for v in variants(rng, t, filler, per_text):
                texts.append(v)
                y.append(k)
    words = sorted({w for t in [*OTHERS, *(x for ts in TEMPLATES.values() for x in ts)] for w in t.split()})
    for _ in range(20 * per_text):  # word salad is unknown as well
        texts.append(" ".join(rng.choice(words, int(rng.integers(4, 16)))))
        y.append(len(FAMILIES) - 1)
    return texts, np.array(y)


@lru_cache(maxsize=1)
def trained(seed: int = 1, per_text: int = 16, steps: int = 150) -> LicenseModel:
    texts, y = training_texts(seed, per_text)
    count: dict[str, int] = {}
    for t in texts:
        for g in grams(t):
            count[g] = count.get(g, 0) + 1
    names = sorted(g for g, n in count.items() if n >= 4)
    index = {g: i for i, g in enumerate(names)}
    x = matrix(texts, index)
    w, b = np.zeros((len(names), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    share = target.sum(axis=0)
    weigh = (1 / share[y] / len(FAMILIES))[:, None].astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        d = (softmax(x @ w + b) - target) * weigh
        g = x.T @ d + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= 0.5 * d.sum(axis=0)
    held, held_y = training_texts(seed + 1, 6)
    p = softmax(matrix(held, index) @ w + b)[:, :-1].max(axis=1)
    unknown = p[held_y == len(FAMILIES) - 1]
    return LicenseModel(tuple(names), w, b, float(max(0.5, np.quantile(unknown, 0.99))))


def gram_column(text: Column, sizes: tuple[int, ...]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    parts = [words]
    if 2 in sizes:
        two = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        parts = [*(parts if 1 in sizes else []), two]
    return F.array_distinct(F.concat(*parts))


def scan_paragraphs(docs: DataFrame, model: LicenseModel | None = None, text: str = "text", null_ids: bool = False) -> DataFrame:
    """A row per paragraph with an anchor or confirmed: doc_id, text_hash (xxhash64 of the text), paragraph, content, family, probability, similarity, confirmed."""
    spark, model = docs.sparkSession, model or trained()
    pattern, few, every = gate()
    some = lambda c: F.lower(c).rlike(pattern)
    docs = docs if null_ids else docs.filter(F.col("doc_id").isNotNull())
    keep = docs.filter(some(F.col(text)) | F.col(text).rlike(ANCHOR)).select(F.col("doc_id").cast("string").alias("__id"), F.xxhash64(text).alias("__text"), F.col("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("paragraph", "content"))
    two, content = gram_column(F.col("content"), (2,)), F.col("content")
    enough = (F.size(two) <= 2) | F.arrays_overlap(two, F.array(*map(F.lit, few))) | (F.size(F.array_intersect(two, F.array(*map(F.lit, every)))) >= 2)
    keep = keep.filter(content.rlike(ANCHOR) | (some(content) & enough))
    weights = spark.createDataFrame([(g, [float(x) for x in model.weights[i]]) for i, g in enumerate(model.grams)], "gram string, w array<double>")
    forms = [(f, k, g) for f, ts in TEMPLATES.items() for k, t in enumerate(ts) for g in grams(t, (2,))]
    size = {}
    for f, k, _ in forms:
        size[f, k] = size.get((f, k), 0) + 1
    templates = spark.createDataFrame([(g, f, k, size[f, k]) for f, k, g in forms], "gram string, tfamily string, template int, tsize int")
    # both tables on the right are of fixed size: model and templates
    keys = ["__id", "__text", "paragraph"]
    one = cut(keep.withColumn("__id", F.coalesce(F.concat(F.lit("="), "__id"), F.lit(""))).groupBy(*keys).agg(F.first("doc_id").alias("doc_id"), F.first("content").alias("content")))
    pairs = one.select(*keys, F.explode(gram_column(F.col("content"), (1, 2))).alias("gram")).join(F.broadcast(weights), "gram")
    n = len(FAMILIES)
    score = pairs.groupBy(*keys).agg(*(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)))
    scored = one.join(score, keys, "left")
    z = F.array(*(F.coalesce(f"z{i}", F.lit(0.0)) + F.lit(float(model.bias[i])) for i in range(n)))
    scored = scored.withColumn("z", z).withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    best = F.array_max(F.zip_with(F.slice("e", 1, n - 1), F.array(*map(F.lit, FAMILIES[:-1])), lambda e, f: F.struct(e.alias("e"), f.alias("f"))))
    scored = scored.withColumn("best", best).withColumn("probability", F.col("best.e") / total)
    scored = scored.withColumn("guess", F.when(F.col("probability") >= model.cutoff, F.col("best.f")).otherwise("unknown"))
    twos = scored.filter("guess <> 'unknown'").select(*keys, "guess", F.size(gram_column(F.col("content"), (2,))).alias("psize"), F.explode(gram_column(F.col("content"), (2,))).alias("gram"))
    meet = twos.join(F.broadcast(templates), (twos["gram"] == templates["gram"]) & (F.col("guess") == F.col("tfamily")))
    meet = meet.groupBy(*keys, "template").agg((F.count("*") / F.least(F.max("psize"), F.max("tsize"))).alias("s")).groupBy(*keys).agg(F.max("s").alias("similarity"))
    out = scored.join(meet, keys, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    sure = (F.col("guess") != "unknown") & (F.col("similarity") >= CONFIRM)
    return out.filter(sure | content.rlike(ANCHOR)).select("doc_id", F.col("__text").alias("text_hash"), "paragraph", "content", F.when(sure, F.col("guess")).otherwise("unknown").alias("family"), "probability", "similarity", sure.alias("confirmed"))


def document_licenses(docs: DataFrame) -> DataFrame:
    """Each row's doc_id with the families of its confirmed paragraphs (sorted, comma-joined), their number, and that of unknown ones."""
    docs = docs.select("doc_id", "text")
    found = scan_paragraphs(docs, null_ids=True).groupBy(F.col("doc_id").alias("d"), "text_hash").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licenses"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(~F.col("confirmed")).alias("n_unknown"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["h"] == found["text_hash"]), "left")
    return out.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_licenses(tables(spark, sf_dir, "documents"))
