"""License scans by a trained paragraph classifier, in DataFrame functions and JVM learners only.

A paragraph is a line with words. Of its words and word pairs, those that some example holds are hashed to a sparse vector; a
multinomial logistic regression with an elastic net gives a probability to each licence family and to the class ``unknown``. Examples
are the templates below, whole, clipped, and between other words. All corpus paragraphs that resemble no template are ``unknown``:
paragraphs with the same vector are one row of that weight, which gives the model that each for itself would give, and all together
weigh as ``UNKNOWN_WEIGHT`` rows at most, so that a large corpus does not outweigh the examples. Half of the vectors are held out: a
family's probability must exceed every probability that a family got on them, and one half at least, or the paragraph be confirmed.
A prediction is confirmed if the paragraph holds ``CONFIRM`` of the word pairs of one of the family's templates.

Null and empty texts have no paragraphs. Repeated rows and null ids are returned as they are. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm.common import written

UNKNOWN_WEIGHT, CONFIRM, FEATURES, UNKNOWN = 4000, 0.8, 1 << 14, "unknown"
#: Notices of licence families (fixed texts).
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "Licensed under CC BY 4.0"),
    ("cc", "Licensed under CC BY-SA 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
)
CLASSES = (UNKNOWN, *sorted({f for f, _ in TEMPLATES}))


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def pairs_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def examples() -> list[tuple[str, list[str]]]:
    """Family and words of each template: whole, without its first or last word, and after and before other words."""
    out = []
    for family, text in TEMPLATES:
        w = words_of(text)
        for words in (w, w[1:], w[:-1], ["the", "project", "is", *w], [*w, "see", "file", "for", "details"], ["this", "text", "is", *w, "or", "later"]):
            out.append((family, words))
    return out


#: Words and word pairs of the examples: what a paragraph is judged by.
WORDS = sorted({w for _, words in examples() for w in words})
PAIRS = sorted({p for _, words in examples() for p in pairs_of(" ".join(words))})


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph`` (index of the line) and ``words``."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    plain = F.trim(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " "))
    return lines.select("doc_id", "paragraph", plain.alias("plain")).where("plain <> ''").select("doc_id", "paragraph", F.split("plain", " ").alias("words"))


def with_grams(rows: DataFrame) -> DataFrame:
    """``words`` replaced by ``grams``: its words and pairs that some example holds, once each, sorted. A run of other words becomes one dot first."""
    seen = F.array_join(F.transform("words", lambda w: F.when(w.isin(WORDS), w).otherwise(".")), " ")
    rows = rows.withColumn("words", F.split(F.regexp_replace(seen, r"\.(?: \.)+", "."), " "))
    rows = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows)
    known = F.filter(F.concat("words", "pairs"), lambda g: g.isin(WORDS + PAIRS))
    return rows.withColumn("grams", F.sort_array(F.array_distinct(known))).drop("words", "pairs")


def featured(rows: DataFrame) -> DataFrame:
    """``features``: the places of the hashed vector that grams of examples have."""
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="hashed")
    places = sorted({hashing.indexOf(g) for g in WORDS + PAIRS})
    return VectorSlicer(inputCol="hashed", outputCol="features", indices=places).transform(hashing.transform(rows)).drop("hashed")


def share_held(grams: Column, template: list[str]) -> Column:
    return F.size(F.array_intersect(grams, F.array(*[F.lit(p) for p in template]))) / F.lit(float(len(template)))


def example_rows(spark: SparkSession) -> DataFrame:
    """Examples as training rows of weight one, and a row of the class unknown, which a corpus may lack."""
    rows = [*examples(), (UNKNOWN, ["no", "words", "of", "a", "notice"])]
    each = [F.struct(F.array(*[F.lit(x) for x in words]).alias("words"), F.lit(float(CLASSES.index(family))).alias("label"), F.lit(1.0).alias("weight")) for family, words in rows]
    return with_grams(spark.range(1).select(F.explode(F.array(*each)).alias("r")).select("r.*")).select("grams", "label", "weight")


def unknowns(rows: DataFrame) -> DataFrame:
    """``grams, times, out``: every set of grams of paragraphs (``grams``) that resemble no template, how many they are, and whether it is held out."""
    similar = F.greatest(*[share_held(F.col("grams"), pairs_of(t)) for _, t in TEMPLATES])
    out = F.pmod(F.shiftright(F.xxhash64("grams"), 32), F.lit(2)) == 1
    # written before it is filtered, or else the filter would run on paragraphs instead of sets
    sets = written(rows.groupBy("grams").agg(F.count("*").alias("times")).select("grams", "times", out.alias("out"), similar.alias("similar")), "licence-sets")
    return sets.where("similar < 0.5").select("grams", "times", "out")


def train(rows: DataFrame):
    """The model and the probability that a family must exceed, from the ``grams`` of all paragraphs."""
    sets = unknowns(rows)
    total = sets.where("not out").agg(F.sum("times")).first()[0] or 0
    weight = F.col("times") * F.lit(min(1.0, UNKNOWN_WEIGHT / max(1, total)))
    learner = LogisticRegression(family="multinomial", regParam=1e-4, elasticNetParam=0.5, maxIter=60, standardization=False, weightCol="weight")
    model = learner.fit(featured(sets.where("not out").select("grams", F.lit(0.0).alias("label"), weight.alias("weight")).unionAll(example_rows(rows.sparkSession))))
    worst = model.transform(featured(sets.where("out").select("grams"))).agg(F.max(best_family(vector_to_array("probability")))).first()[0]
    return model, max(0.5, worst or 0.0)


def best_family(p: Column) -> Column:
    """The highest probability of a family."""
    return F.array_max(F.slice(p, 2, len(CLASSES) - 1))


def licensed(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity, confirmed`` for each paragraph that a family claims."""
    rows = written(with_grams(paragraphs(docs)), "licence-grams")
    model, least = train(rows)
    got = model.transform(featured(rows)).select("doc_id", "paragraph", "grams", vector_to_array("probability").alias("p"))
    got = got.withColumn("best", best_family(F.col("p")))
    # the fewest pairs that can confirm; similarity is worked out for what may be returned only
    pairs = F.size(F.filter("grams", lambda g: g.contains(" "))) >= math.ceil(CONFIRM * min(len(pairs_of(t)) for _, t in TEMPLATES))
    got = got.where((F.col("best") > least) | pairs)
    got = got.withColumn("family", F.get(F.array(*[F.lit(c) for c in CLASSES]), (F.array_position(F.slice("p", 2, len(CLASSES) - 1), F.col("best"))).cast("int")))
    similar = F.greatest(F.lit(0.0), *[F.when(F.col("family") == f, share_held(F.col("grams"), pairs_of(t))).otherwise(0.0) for f, t in TEMPLATES])
    got = got.withColumn("similarity", similar).withColumn("confirmed", F.col("similarity") >= CONFIRM).where((F.col("best") > least) | F.col("confirmed"))
    return got.select("doc_id", "paragraph", "family", F.col("best").alias("probability"), "similarity", "confirmed")


def op8_licenses(docs: DataFrame) -> DataFrame:
    return licensed(docs)
