"""Licence scan: a trained paragraph classifier with DataFrame functions and Spark ML only.

A multinomial logistic regression on word n-grams of the licence templates tells a paragraph's licence
family from the unknown class, which is learned from all lines of two thirds of the documents, counted by
the grams they hold. The accepting probability is calibrated on all lines of the other third, and a
prediction is confirmed by comparing the paragraph's word shingles with the family's templates.

The penalty makes the model sparse. Scoring therefore first drops paragraphs that provably stay
unknown: ``needles`` are the n-grams without which the sum of all other positive weights cannot reach
an even chance. Every other paragraph is scored on all its n-grams.

Defined cases: null and empty texts have no paragraphs; lines without a word are skipped but counted
in the paragraph number; ties between families take the first in order; repeated rows are scanned
alike; a null doc_id is kept; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import written

UNKNOWN = "unknown"
UNKNOWN_WEIGHT = 5000.0        # all unknown lines together weigh at most this, a template row 20
SHINGLE = 3
MIN_SIMILARITY = 0.5
CALIBRATED_RATE = 0.999        # share of the held unknown lines below the accepting probability
STEPS = 10_000                 # that probability is a multiple of a STEPS-th
LEAST_PROBABILITY = 0.5
# fixed values: words that are no feature alone, nor paired with each other
COMMON = "a all an and any as at be by for from in is it may no not of on or that the this to used with without you".split()
# fixed values: common notices of licence families
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Released under the Apache License 2.0.",
                   "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD License.", "Licensed under the 3-Clause BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "Released under the GNU GPL version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
            "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["Licensed under the Mozilla Public License, Version 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright the authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.",
                    "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
# fixed values: sentences with licence words that grant nothing
NEAR_MISSES = ["You need a driver license to rent a car.", "She is a licensed psychologist in private practice.", "The Apache helicopter landed at the public airport.",
               "MIT is a university in the state of Massachusetts.", "The rights of the people are reserved to the states.", "The film was released under the title of the novel.",
               "Mozilla released version 2.0 of the browser.", "The general public is free to use the library.", "Creative work is common in the arts.", "He lost his fishing license last year.",
               "Copyright law is a part of the course.", "The foundation published the software in May.", "Permission to land was granted by the tower.", "Version 3 of the report is under review."]


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words: Column) -> Column:
    """Distinct words and word pairs."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))))


def _shingles(words: Column) -> Column:
    """Distinct runs of SHINGLE words, or the whole of a shorter paragraph."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    return F.array_distinct(runs)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, line) of every line with a word."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("paragraph", "line")).filter(
        F.col("line").rlike(r"[\p{L}\p{N}]"))


def template_rows(spark: SparkSession) -> DataFrame:
    rows = [(family, k, text) for family, texts in sorted(TEMPLATES.items()) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, template int, line string").withColumn("words", words_of(F.col("line")))


@dataclass
class Model:
    classes: list[str]
    weights: DataFrame          # gram string, w array<double> (by class): the non-zero rows of the model
    bias: list[float]
    needles: list[str]          # words without which a paragraph is unknown
    accept: float


def _needles(vocabulary: list[str], weights: list[list[float]], bias: list[float], unknown: int) -> list[str]:
    """Words such that a paragraph without any of them has less than an even chance in every family.

    Grams are dropped from the needles from the weakest on, as long as the positive margins of all
    dropped ones together leave each family's log odds against the unknown class below zero.
    """
    families = [c for c in range(len(bias)) if c != unknown]
    gain = {g: {c: max(0.0, weights[c][k] - weights[unknown][k]) for c in families} for k, g in enumerate(vocabulary)}
    room = {c: bias[unknown] - bias[c] - 1e-6 for c in families}
    keep = []
    for g in sorted(vocabulary, key=lambda g: (max(gain[g].values()), g)):
        if all(gain[g][c] <= room[c] for c in families):
            for c in families:
                room[c] -= gain[g][c]
        else:
            keep.append(g)
    return sorted({max(g.split(" "), key=lambda w: (w not in COMMON, len(w))) for g in keep})  # a pair needs both of its words: the rarer one will do


def _probabilities(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """keys, p (array by class): sums of the weights of a paragraph's grams through a softmax."""
    hits = rows.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(model.weights), "gram", "left")
    n = len(model.classes)
    z = hits.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col("w")[c]), F.lit(0.0)).alias(f"z{c}") for c in range(n)])
    z = z.withColumn("z", F.array(*[F.col(f"z{c}") + model.bias[c] for c in range(n)]))
    e = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    return z.withColumn("e", e).select(*keys, F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def unknown_lines(docs: DataFrame, vocabulary: list[str], known: list[str]) -> DataFrame:
    """(held, grams, n): all lines of the corpus without a licence shingle, counted by the vocabulary's grams that they hold.

    ``held`` lines, those of a third of the documents, calibrate; the others teach the unknown class.
    """
    # words come out of the explode as a column: an expression would be worked out again for every shingle
    lines = F.transform(F.split(F.col("text").cast("string"), "\n"), words_of)
    words = docs.select((F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(3)) == 0).alias("held"), F.explode(lines).alias("words")).filter(F.size("words") > 0)
    lent = words.filter(~F.exists(_shingles(F.col("words")), lambda s: s.isin(known)))  # licence lines are not unknown
    return lent.groupBy("held", F.array_sort(F.filter(_grams(F.col("words")), lambda g: g.isin(vocabulary))).alias("grams")).agg(F.count(F.lit(1)).alias("n"))


def accepting(held: DataFrame, model: Model) -> float:
    """The probability, rounded up to a STEPS-th, that CALIBRATED_RATE of all held lines stay below; bounded by STEPS counts."""
    marked = held.select("n", "grams", F.concat(F.array(F.lit("")), "grams").alias("own"))  # a line without a gram has the bias alone
    p = _probabilities(marked.select("n", F.col("grams").alias("key"), F.col("own").alias("grams")), model, ["key", "n"])
    steps = p.groupBy((F.floor((1 - F.col("p")[len(model.classes) - 1]) * STEPS) + 1).alias("step")).agg(F.sum("n").alias("n")).orderBy("step").collect()
    wanted, seen = CALIBRATED_RATE * sum(r["n"] for r in steps), 0
    for r in steps:
        seen += r["n"]
        if seen >= wanted:
            return max(LEAST_PROBABILITY, min(0.99, r["step"] / STEPS))
    return LEAST_PROBABILITY


def fit(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    templates = template_rows(spark)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    known = [r["s"] for r in templates.select(F.explode(_shingles(F.col("words"))).alias("s")).distinct().orderBy("s").collect()]  # of the fixed templates
    grams = templates.select(F.explode(_grams(F.col("words"))).alias("g")).distinct().orderBy("g").collect()  # of the fixed templates
    vocabulary = [r["g"] for r in grams if not set(r["g"].split(" ")) <= set(COMMON)]
    lent = written(unknown_lines(docs, vocabulary, known), "unknown")
    lines = lent.filter(~F.col("held")).agg(F.sum("n")).first()[0] or 0
    label = F.lit(float(len(classes) - 1))
    train = lent.filter(~F.col("held")).select("grams", label.alias("label"), (F.col("n") * F.lit(min(1.0, UNKNOWN_WEIGHT / max(lines, 1)))).alias("weight"))
    misses = spark.createDataFrame([(x,) for x in NEAR_MISSES], "line string").select(_grams(words_of(F.col("line"))).alias("grams"), label.alias("label"), F.lit(1.0).alias("weight"))
    number = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, float(k))])
    # a template teaches as a whole, and long ones by their halves
    size = F.size("words")
    half = F.ceil(size / 2).cast("int")
    cuts = F.when(size > 16, F.array(F.col("words"), F.slice("words", 1, half), F.slice("words", half, size))).otherwise(F.array(F.col("words")))
    shown = templates.select(F.explode(cuts).alias("words"), number[F.col("family")].alias("label")).select(_grams(F.col("words")).alias("grams"), "label", F.lit(20.0).alias("weight"))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    data = written(vectors.transform(shown.unionByName(train).unionByName(misses)).select("features", "label", "weight"), "training")
    lr = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0008, elasticNetParam=1.0, maxIter=60, standardization=False)
    fitted = lr.fit(data)
    matrix, bias = fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist()
    weights = spark.createDataFrame([(g, [matrix[c][k] for c in range(len(classes))]) for k, g in enumerate(vocabulary) if any(matrix[c][k] for c in range(len(classes)))],
                                    "gram string, w array<double>")
    model = Model(classes, weights, bias, _needles(vocabulary, matrix, bias, len(classes) - 1), LEAST_PROBABILITY)
    model.accept = accepting(lent.filter("held"), model)
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed, n_words) of licence paragraphs."""
    spark = docs.sparkSession
    lines = paragraphs(docs).withColumn("words", words_of(F.col("line")))
    maybe = lines.filter(F.arrays_overlap("words", F.array(*[F.lit(w) for w in model.needles]))) if model.needles else lines.limit(0)
    # a row number for equal (doc_id, paragraph) of repeated rows is not needed: equal lines score alike
    maybe = written(maybe.select("doc_id", "paragraph", F.xxhash64("line").alias("at"), "words").groupBy("doc_id", "paragraph", "at").agg(
        F.first("words").alias("words"), F.count(F.lit(1)).alias("copies")), "candidates")
    keys = ["doc_id", "paragraph", "at"]
    p = _probabilities(maybe.withColumn("grams", _grams(F.col("words"))).withColumnRenamed("doc_id", "d").withColumn("doc_id", F.coalesce("d", F.lit(-(1 << 62)))).drop("d"), model, keys)
    named = F.slice("p", 1, len(model.classes) - 1)
    best = F.array_max(named)
    called = p.filter(1 - F.col("p")[len(model.classes) - 1] >= model.accept).select(
        *keys, F.get(F.array(*[F.lit(c) for c in model.classes]), F.array_position(named, best).cast("int") - 1).alias("family"), best.alias("probability"))
    back = maybe.withColumnRenamed("doc_id", "id").withColumn("doc_id", F.coalesce("id", F.lit(-(1 << 62))))
    found = called.join(back, keys)
    shapes = template_rows(spark).select("family", _shingles(F.col("words")).alias("shape"))
    mine = _shingles(F.col("words"))
    likeness = F.size(F.array_intersect(mine, F.col("shape"))) / F.least(F.size(mine), F.size("shape"))
    out = found.join(F.broadcast(shapes), "family").groupBy(*keys, "id", "family", "probability", "copies", F.size("words").alias("n_words")).agg(F.max(likeness).alias("similarity"))
    return out.select(F.col("id").alias("doc_id"), "paragraph", "family", "probability", "similarity", (F.col("similarity") >= MIN_SIMILARITY).alias("confirmed"),
                      "n_words", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def scan_licenses(docs: DataFrame) -> DataFrame:
    return scan(docs, fit(docs))
