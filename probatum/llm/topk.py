"""Exact top-k inner products by norm-bucketed retrieval.

Every component becomes floor(256 x). Candidates are sorted by length (largest first) and cut into buckets. A first
pass scores every query, in blocks, against the longest bucket, which gives each query a threshold: its k-th best score so
far. A query then visits only buckets whose greatest length can still reach the threshold: a range join of queries with
the table of buckets, by levels of a quarter of a binary order of length. Inside a bucket the local
cosine threshold decides between length pruning (a prefix of the bucket's candidates, which are in order of length)
and coordinate pruning (the interval that a unit vector's coordinate must lie in); survivors' products are computed
exactly. Ties go to the smaller id, so nothing that can tie is pruned.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part; equal rows count
once; rows that share the query's id are the query's own. Shorter vectors count as padded with zeros.
Scores beyond the range of a long are clamped to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probatum.llm.common import written

K, EVERY, SCALE, BUCKET, QUERY_BLOCK, COORDINATE_FROM = 5, 50, 256.0, 8192, 2048, 0.75
EXACT = float(1 << 53)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return a @ b.T
    whole = np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1)


def best_of_bucket(q_ids, queries, theta, c_ids, cands, k=K):
    """For each query the best ``k`` of the bucket that reach its threshold, as ``(query position, candidate position, score)`` lists."""
    norm = np.sqrt((cands * cands).sum(1))
    order = np.lexsort((c_ids, -norm))
    c_ids, cands, norm = c_ids[order], cands[order], norm[order]
    q_norm = np.sqrt((queries * queries).sum(1))
    exact = float(norm.max(initial=0)) * float(q_norm.max(initial=0)) < EXACT
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(q_norm > 0, theta / q_norm * (1 - 1e-9), np.where(theta > 0, np.inf, -np.inf))
        local = np.where(least > 0, least / max(float(norm.max(initial=0)), 1e-300), -1.0)
    units = cands / np.where(norm > 0, norm, 1)[:, None]
    prefix = np.searchsorted(-norm, -least, side="right")
    out = []

    def keep(i, at, scores):
        own = c_ids[at] != q_ids[i]
        at, scores = at[own], scores[own]
        if len(at) > k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= cut], scores[scores >= cut]
        best = np.lexsort((c_ids[at], -scores))[:k]
        out.extend((i, c_ids[at[b]], scores[b]) for b in best)

    sharp = local > COORDINATE_FROM
    for i in np.flatnonzero(sharp & (prefix > 0)):
        t, u = min(local[i], 1.0), queries[i] / q_norm[i]
        at = np.arange(prefix[i])
        for f in np.argsort(-np.abs(u))[:2]:
            slack = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-9
            low, high = (-1.0 if -u[f] >= t else t * u[f] - slack), (1.0 if u[f] >= t else t * u[f] + slack)
            at = at[(units[at, f] >= low - 1e-9) & (units[at, f] <= high + 1e-9)]
        if len(at):
            keep(i, at, _products(queries[i : i + 1], cands[at], exact)[0])
    blunt = np.flatnonzero(~sharp & (prefix > 0))
    blunt = blunt[np.argsort(prefix[blunt], kind="stable")]
    for at in range(0, len(blunt), 64):
        block = blunt[at : at + 64]
        scores = _products(queries[block], cands[: prefix[block].max()], exact)
        for row, i in zip(scores, block, strict=True):
            keep(i, np.arange(len(row)), row)
    return out


def _retrieve(k: int):
    def retrieve(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["v"].map(len).max())
        is_q = pdf["query"].to_numpy()
        q, c = pdf[is_q], pdf[~is_q]
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q_ids = q["vec_id"].to_numpy()
        got = best_of_bucket(q_ids, _matrix(q["v"], width), q["theta"].to_numpy(dtype=float), c["vec_id"].to_numpy(), _matrix(c["v"], width), k)
        return pd.DataFrame({"query_id": [q_ids[i] for i, _, _ in got], "vec_id": [v for _, v, _ in got], "score": [int(s) for _, _, s in got]}).astype("int64")

    return retrieve


def top_products(embeddings: DataFrame, every: int = EVERY, k: int = K, bucket: int = BUCKET) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest inner products of each row with an id divisible by ``every``."""
    c = F.col("embedding")
    fine = F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.col("vec_id").isNotNull()
    scaled = F.transform(c.cast("array<double>"), lambda x: _floor(x * SCALE))
    rows = embeddings.where(fine).select("vec_id", scaled.alias("v")).distinct()
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    rows = written(rows, "scaled")
    total = rows.count()
    parts, blocks = max(1, -(-total // bucket)), max(1, -(-total // (every * QUERY_BLOCK)))
    cands = written(rows.repartitionByRange(parts, F.desc("norm"), "vec_id").withColumn("bucket", F.spark_partition_id()), "buckets")
    tops = cands.groupBy("bucket").agg(F.max("norm").alias("top")).withColumn("level", _level(F.col("top")))
    first, longest = tops.agg(F.min("bucket"), F.max("level")).first()
    if first is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))  # no row
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    none = F.lit(None).cast("double").alias("theta")

    def passed(asked: DataFrame, over: DataFrame) -> DataFrame:
        """Queries ``asked (bucket, block, ...)`` against candidates ``over (bucket, block, ...)``; a group is one bucket and one block of queries."""
        both = asked.select("bucket", "block", "vec_id", "v", "theta", F.lit(True).alias("query")).unionAll(over.select("bucket", "block", "vec_id", "v", none, F.lit(False).alias("query")))
        return both.groupBy("bucket", "block").applyInPandas(_retrieve(k), "query_id long, vec_id long, score long")

    of_first = cands.where(F.col("bucket") == first).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    seeds = written(passed(queries.select(F.lit(first).alias("bucket"), "block", "vec_id", "v", F.lit(float("-inf")).alias("theta")), of_first), "seeds")
    theta = seeds.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("theta"))
    held = queries.join(theta, queries.vec_id == theta.query_id, "left").select("block", "vec_id", "v", "norm", F.coalesce("theta", F.lit(float("-inf"))).alias("theta"))
    least = F.when(F.col("theta") <= 0, F.lit(0.0)).when(F.col("norm") > 0, F.col("theta") / F.col("norm") * (1 - 1e-9)).otherwise(F.lit(float("inf")))
    held = held.withColumn("least", least).where(F.col("least") < float("inf"))
    held = held.withColumn("level", F.explode(F.sequence(_level(F.col("least")), F.greatest(F.lit(longest), _level(F.col("least"))))))
    others = tops.where(F.col("bucket") != first)
    asked = written(held.join(others, "level").where("top >= least").select("bucket", "block", "vec_id", "v", "theta"), "asked")
    wanted = asked.select("bucket", "block").distinct()
    every_best = seeds.unionAll(passed(asked, cands.where(F.col("bucket") != first).join(wanted, "bucket")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every_best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _level(length):
    """A quarter of a binary order of a length; lengths of integer vectors are 0 or at least 1."""
    return F.floor(4 * F.log2(F.greatest(length, F.lit(1.0)))).cast("int")


def _floor(x):
    """floor() that stays a double, whatever the size."""
    return F.when(F.abs(x) < EXACT, F.floor(F.when(F.abs(x) < EXACT, x)).cast("double")).otherwise(x)


def op9_top_products(embeddings: DataFrame) -> DataFrame:
    return top_products(embeddings)


OP9_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
