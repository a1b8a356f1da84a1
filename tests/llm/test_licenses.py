"""What the licence classifier and its cut are learned from: every paragraph of the corpus."""

import re

from pyspark.sql import functions as F

from probatum.llm import licenses

PROSE = 9000
NOTICES = [("mit", "Released under the MIT License."), ("apache", "Licensed under the Apache License, Version 2.0."), ("cc", "Licensed under CC BY-NC 4.0."), ("gpl", "This work is licensed under the GNU General Public License, version 3.")]


def docs_of(spark, lines):
    """Prose under the ids from 0, a paragraph each, then a document for each of ``lines``."""
    prose = spark.range(PROSE).select(F.col("id").alias("doc_id"), F.concat(F.lit("row x"), "id", F.lit(" of the gardens and rivers")).alias("text"))
    return prose.unionAll(spark.createDataFrame([(PROSE + i, x) for i, x in enumerate(lines)], "doc_id long, text string")).repartition(4)


def claimed(docs):
    return {(r["doc_id"], r["family"], r["confirmed"]) for r in licenses.op8_licenses(docs).collect()}


def test_rare_paragraphs_set_the_cut(spark):
    """Lines that read like a notice and are none, in three documents of 9003; a sample of 4000 documents leaves some out."""
    assert claimed(docs_of(spark, ["The Apache software license", "Affero GNU General Public License", "GPL 3 or later"])) == set()


def test_every_paragraph_counts(spark):
    rows = licenses.with_grams(licenses.paragraphs(docs_of(spark, ["of the\n\nof the\n" + NOTICES[0][1]])))
    times = {tuple(r["grams"]): r["times"] for r in licenses.unknowns(rows).collect()}
    assert times == {("and", "of", "of the", "the"): PROSE, ("of", "of the", "the"): 2}


def test_the_cut_loses_no_confirmed_notice(spark):
    """Lines of other notices are held out and more probable than whole notices."""
    docs = docs_of(spark, [t for _, t in NOTICES] + ["the terms of the GNU General Public License as published by", "BSD 3 clause"])
    _, least = licenses.train(licenses.with_grams(licenses.paragraphs(docs)))
    assert least > 0.99
    assert {x for x in claimed(docs) if x[2]} == {(PROSE + i, f, True) for i, (f, _) in enumerate(NOTICES)}


def test_grams_are_those_of_the_examples(spark):
    texts = ["Released under the MIT License", "zebra the zebra zebra terms", "of x the terms of of the", "zebra", "é under"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = {*licenses.WORDS, *licenses.PAIRS}
    for r in licenses.with_grams(licenses.paragraphs(docs)).collect():
        w = re.findall("[a-z0-9]+", texts[r["doc_id"]].lower())
        assert r["grams"] == sorted(known & {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))})


def test_the_model_is_as_small_as_its_examples(spark):
    """Every iteration sends all coefficients from the driver and back: a place for each gram, not for each hash."""
    model, _ = licenses.train(licenses.with_grams(licenses.paragraphs(docs_of(spark, []))))
    assert model.numFeatures <= len(licenses.WORDS) + len(licenses.PAIRS) < 1000
