"""Samples at every size, and budgets of trees with dead branches."""

import duckdb
import pytest
from pyspark.sql import functions as F

from probatum.llm import common, mixing


@pytest.mark.parametrize("wanted", [400, 4000, 4096, 20_000])
@pytest.mark.parametrize("rows", [1, 10_000, 400_000_001, 10**12, 10**15])
def test_the_bound_of_a_sample_follows_the_rows(wanted, rows):
    bound = common.hash_bound(wanted, rows, -(1 << 63) + 5)
    expected = rows * ((bound + (1 << 63)) / (1 << 64))
    assert -(1 << 63) < bound < 1 << 63
    assert abs(expected - min(wanted, rows)) < 1e-3 * wanted + 1


def test_the_lowest_hash_is_always_in_a_sample():
    assert common.hash_bound(1, 10**30, 77) == 77


def test_a_sample_is_never_empty_where_rows_exist(spark):
    same = spark.range(5000).select(F.lit("x").alias("text"))
    assert common.sampled(same, F.xxhash64("text"), 10).count() == 5000  # equal rows come together
    some = common.sampled(spark.range(50_000), F.xxhash64("id"), 500).count()
    assert 400 < some < 600
    assert common.sampled(same.limit(0), F.xxhash64("text"), 10).count() == 0
    assert common.some([], same.limit(0)) == [] and common.some([1], same) == [1]
    with pytest.raises(ValueError, match="empty"):
        common.some([], same)


DOCS = [(i, "w " * (5 + i % 7), ("en", "de", None)[i % 3], f"src{i % 8}" if i % 5 else "odd") for i in range(400)]


@pytest.mark.parametrize(
    "weights",
    [
        {}, {"source_weights": {"src0": 0, "src3": 5}}, {"source_weights": {"src0": 0, "src4": 0}}, {"lang_weights": {"en": 0, "de": 2}}, {"domain_weights": {"domain1": 0, "domain2": 3}},
        {"domain_weights": {"domain0": 0}, "lang_weights": {"de": 0}, "source_weights": {"src1": 0, "src5": 2, "odd": 0}}, {"domain_weights": {f"domain{i}": 0 for i in range(4)} | {"other": 0}},
    ],
)
def test_budgets_of_dead_branches_are_the_sqls(spark, weights):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    got = sorted(map(tuple, mixing.mixed(docs, **weights).select("doc_id", "epoch", "tokens", "taken").collect()))
    con = duckdb.connect()
    con.register("frame", docs.toPandas())
    con.execute("CREATE TABLE documents AS SELECT * FROM frame")
    want = con.execute(f"SELECT doc_id, epoch, tokens, taken FROM ({mixing.mixed_sql(**weights)})").fetchall()
    assert got == sorted(want)


@pytest.mark.parametrize("dead", [{"source_weights": {"src0": 0}}, {"domain_weights": {"domain0": 0}}, {"lang_weights": {"de": 0}}])
def test_no_budget_is_lost_to_what_has_no_weight(spark, dead):
    docs = spark.createDataFrame([(i, "w " * 10, "de" if i % 2 else "en", f"src{i % 2}") for i in range(200)], "doc_id long, text string, lang string, source string")
    if "source_weights" in dead:
        dead = {"source_weights": {"src1": 0}} | {"lang_weights": {}}
    out = mixing.mixed(docs, fraction=0.5, epochs=1, **({"domain_weights": {}, "lang_weights": {}} | dead))
    assert out.agg(F.sum("taken")).first()[0] == 1000
