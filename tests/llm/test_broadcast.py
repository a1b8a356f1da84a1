"""Spark takes a table for small where an explode or an aggregate hides its rows; what grows with the corpus must not go through the driver for that."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

import corpus_pipeline
from probatum.llm import common, mixing, secrets, simhash


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of all that is written, where Spark takes any table for small enough to broadcast."""
    seen, parquet, key = [], DataFrameWriter.parquet, "spark.sql.autoBroadcastJoinThreshold"

    def recorded(self, *a, **kw):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return parquet(self, *a, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 30))
    yield seen
    spark.conf.set(key, before)


def docs_of(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[k : k + 30] + [f"own{i % 40}"]) for i in range(120) for k in (i % 7,)]
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_simhash_broadcasts_nothing(spark, plans):
    got = common.written(simhash.op10_simhash(docs_of(spark)), "out")
    assert got.count() == 120 and len(plans) > 3
    assert not any("Broadcast" in p for p in plans)
    fps = [r["fp"] for r in spark.range(200).select(F.xxhash64("id").alias("fp")).collect()]
    near = spark.createDataFrame([(f ^ (b and 1 << b),) for f in fps for b in (0, 5, 40)], "fp long")
    assert simhash.near_fingerprints(near).count() == 600


def test_the_pipelines_stages_broadcast_no_documents(spark, plans):
    docs = docs_of(spark).withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" password = hunter2hunter2"))).otherwise(F.col("text")))
    kept = common.written(corpus_pipeline.drop_near_copies(spark, docs, ""), "kept")
    assert 0 < kept.count() < 120
    masked = common.written(secrets.masked(docs), "masked")
    assert masked.where("text like '%<assign>%'").count() == 14
    assert len(plans) > 15 and not any("Broadcast" in p for p in plans)
    plans.clear()
    assert common.written(mixing.mixed(docs, 0.9, 1), "mixed").count() > 0
    assert not any("BroadcastHashJoin" in line and "bucket" in line for p in plans for line in p.splitlines())  # a leaf's budget is one row
