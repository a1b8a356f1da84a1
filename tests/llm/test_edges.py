"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from probatum.llm import bpe, epsjoin, licenses, mixing, secrets, shingles, simhash, suffix, tokenfile, topk, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, blob string, key string, hash long, score double, row string, component_id long, part int"
VEC = "vec_id long, embedding array<float>, label int, norm double, rep long, iv int"
LABEL = "doc_id long, quality int, toxic int, score double"
LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "One short text with token = abcdefgh12 inside.", "en", "src1"), (2, None, None, None), (3, "", "en", "src2"), (4, LONG, "de", "src3"), (5, " \t\n", "fr", "x"),
    (6, "Same words here", "en", "src1"), (7, "Same words here", "en", "src1"), (7, "Same words here", "en", "src1"), (None, "no id é中😀", "en", "src1"), (9, "x" * 30_000, None, "src2"),
]
DOC_OPS = {
    "op1": secrets.op1_secrets, "op2": mixing.op2_mixing, "op4": suffix.op4_suffix_dedup, "op6": bpe.op6_byte_bpe, "op7": tokenfile.op7_token_file, "op8": licenses.op8_licenses, "op10": simhash.op10_simhash,
}


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "b", "k", 1, 0.5, "r", 1, 0) for r in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, 0.1), (6, None, 1, 0.2), (7, 0, None, 0.3), (None, 1, 1, 0.4), (4, 0, 0, 0.0)], LABEL)


@pytest.mark.parametrize("op", DOC_OPS)
def test_document_operators_take_odd_rows(docs, op):
    out = DOC_OPS[op](docs).collect()
    if op not in ("op2", "op8"):
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("op", DOC_OPS)
def test_document_operators_take_empty_tables(spark, op):
    assert DOC_OPS[op](frame(spark, [])).collect() == []


def test_toxicity_takes_odd_rows(spark, docs, labels):
    out = toxicity.op3_toxicity(docs, labels).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.op3_toxicity(frame(spark, []), labels).collect() == []
    assert {r["score"] for r in toxicity.op3_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_vector_operators_take_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (50, [1.0, 1.0], 2)]
    vecs = spark.createDataFrame([(*r, 1.0, 1, 1) for r in rows], VEC)
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in epsjoin.op5_near_embeddings(vecs).collect())
    assert got == [(-1, 0, -1), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (50, 0, 50)]
    top = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op9_top_products(vecs).orderBy("rank").collect()]
    assert top == [(50, 1, 3, 131072), (50, 2, 1, 65536), (50, 3, 2, 65536), (50, 4, 8, 65536), (50, 5, 9, 65536)]
    assert epsjoin.op5_near_embeddings(vecs.limit(0)).collect() == []
    assert topk.op9_top_products(vecs.limit(0)).collect() == []


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_keep_columns(spark, docs, labels, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, frame(spark, [])):
        out = stage(spark, rows, str(tmp_path))
        got = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == rows.columns
        assert len(got) <= rows.count()


def test_stages_change_what_they_should(spark, docs):
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_secrets(spark, docs, "").collect()}
    assert masked[1] == "One short text with <assign> inside."
    assert masked[4] == LONG
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert 6 in kept and 7 not in kept and None in kept and 2 in kept and 3 not in kept and 5 not in kept


def test_hot_groups_of_equal_rows(spark):
    rows = [(i, "the very same text of some words " * 20, "en", "src0") for i in range(300)] + [(1000, "another text", "en", "src1")]
    docs = frame(spark, rows)
    gone = {r["doc_id"]: r["n_removed"] for r in suffix.op4_suffix_dedup(docs).collect()}
    assert gone[1000] == 0 and all(gone[i] == len(rows[0][1]) for i in range(300))
    comps = {r["doc_id"]: r["component_id"] for r in simhash.op10_simhash(docs).collect()}
    assert comps[1000] == 1000 and all(comps[i] == 0 for i in range(300))
    assert shingles.near_copies(docs).where(F.col("doc_id") != F.col("component_id")).count() == 299
