"""A training corpus from raw documents: five stages, each written and read again before the next.

Toxic documents go, one document of each group of near copies stays, documents with secrets get them masked, sources
are mixed to target weights, and what is left is encoded. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm import bpe, common, mixing, secrets, shingles, toxicity

#: Of the tokens that reach the mixing stage, the share that leaves it; no document is taken twice.
MIX_FRACTION, MIX_EPOCHS = 0.9, 1
#: SQL can't express learned scores or XXH64 fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def _same(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the cut."""
    common.ship(spark)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return _same(docs, docs.where(toxicity.score_column(model)(F.col("text")) < toxicity.CUT))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that SimHash fingerprints (as op10 links them) or shingles (0.8 alike) join: the smallest id (nulls last), then the least digest of its text."""
    common.ship(spark)
    decided = shingles.with_one_kept(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), shingles.text_digest().alias("same"))
    rows = rows.withColumn("id", F.col("row.doc_id"))
    gone = decided.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("same").alias("gone"))
    rows = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("same") == F.col("gone")), "left_anti")
    if decided.where("kept and times > 1").take(1):  # repeated rows: one of them stays
        rows = rows.dropDuplicates(["id", "same"])
    return rows.select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that a rule finds is replaced by its kind in angle brackets; ``n_chars`` follows the text."""
    return _same(docs, secrets.masked(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the token prefix of their leaf, whole; rows that share an id, or have none, stay if one of them is taken."""
    taken = mixing.mixed(docs, fraction=MIX_FRACTION, epochs=MIX_EPOCHS).select(F.col("doc_id").alias("taken_id")).distinct()
    return _same(docs, docs.join(taken.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(taken["taken_id"]), "left_semi"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    common.ship(spark)
    return bpe.round_trip(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
