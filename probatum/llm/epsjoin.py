"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t) of each other, and so do their projections on any
orthonormal axes. Vectors are given the cells (width eps) of their projections on the leading principal axes and
sorted by label, cells and id; the sort is cut into sequence intervals. Pairs of intervals whose cell boxes are more
than one cell apart in any dimension are skipped; the others are joined by recursive halving, which skips distant
halves in the same way, down to blocks whose cosines are computed in double precision.

Equal vectors of a label are joined once, with their multiplicity. A task returns link counts per vector and a
spanning forest of its links, never all pairs. The axes come from a bounded sample (``AXES_SAMPLE`` vectors); they
only steer skipping and cannot change the result.

Null, zero, or non-finite vectors, vectors with null components and vectors with a null label link with nothing and
are their own component. Vectors of different lengths never link. Rows with a null id are returned with no links;
repeated ids count as separate rows and share a component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import connected_components, sampled, written

THRESHOLD, AXES, AXES_SAMPLE, INTERVAL, LEAF = 0.93, 6, 4096, 4096, 256


def usable(column: str = "embedding"):
    """True where a vector is not null, not zero, and has only finite components."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int, k: int = AXES) -> np.ndarray:
    """Leading axes of a bounded sample: about ``AXES_SAMPLE`` vectors of length ``dims``, chosen by a hash of their id."""
    got = sampled(vectors.where(F.size("embedding") == dims), F.xxhash64("rep", F.lit("axes")), AXES_SAMPLE).limit(2 * AXES_SAMPLE).select("embedding").toPandas()
    if got.empty:
        return np.zeros((dims, 0))
    rows = unit(np.stack(got["embedding"].to_numpy()).astype(float))
    _, _, axes = np.linalg.svd(rows - rows.mean(axis=0), full_matrices=False)
    return axes[:k].T


def _cells_of(axes: dict[int, np.ndarray], eps: float, k: int):
    def cells(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), k), dtype=np.int64)
            size = pdf["embedding"].map(len).to_numpy()
            for d in np.unique(size):
                if (a := axes.get(int(d))) is not None and a.shape[1]:
                    at = np.flatnonzero(size == d)
                    rows = unit(np.stack(pdf["embedding"].to_numpy()[at]).astype(float))
                    out[at, : a.shape[1]] = np.floor(rows @ a / eps).astype(np.int64)
            yield pdf.assign(dims=size, **{f"c{i}": out[:, i] for i in range(k)})

    return cells


class _Forest:
    """Union-find over positions; ``join`` returns the links that merged two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
        kept = []
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            if (a := self.root(x)) != (b := self.root(y)):
                self.up[max(a, b)] = min(a, b)
                kept.append((x, y))
        return kept


def grid_order_join(rows: np.ndarray, cells: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Yield ``(i, j)`` position arrays of links between the sequences ``left`` and ``right`` (the same: each pair once)."""
    todo = [(left, right, left is right)]
    while todo:
        a, b, same = todo.pop()
        if not len(a) or not len(b):
            continue
        if not same:
            low, high = np.maximum(cells[a].min(0), cells[b].min(0)), np.minimum(cells[a].max(0), cells[b].max(0))
            if (low - high > 1).any():
                continue
        if len(a) <= LEAF and len(b) <= LEAF:
            cos = rows[a] @ rows[b].T
            i, j = np.nonzero(cos >= threshold - 1e-9)
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                exact = np.einsum("ij,ij->i", rows[a[i]], rows[b[j]]) >= threshold
                yield a[i[exact]], b[j[exact]]
            continue
        if same:
            x, y = np.array_split(a, 2)
            todo += [(x, x, True), (y, y, True), (x, y, False)]
        elif len(a) >= len(b):
            todo += [(x, b, False) for x in np.array_split(a, 2)]
        else:
            todo += [(a, y, False) for y in np.array_split(b, 2)]


def _join_intervals(k: int, threshold: float):
    def joined(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([f"c{i}" for i in range(k)] + ["rep"], kind="stable")
        rows = unit(np.stack(pdf["embedding"].to_numpy()).astype(float))
        cells, side = pdf[[f"c{i}" for i in range(k)]].to_numpy(), pdf["side"].to_numpy()
        rep, n = pdf["rep"].to_numpy(), pdf["n"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = left if key[2] == key[3] else np.flatnonzero(side == 1)
        links, forest, edges = np.zeros(len(pdf), dtype=np.int64), _Forest(len(pdf)), []
        for i, j in grid_order_join(rows, cells, left, right, threshold):
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            edges += forest.join(i, j)
        at = np.flatnonzero(links)
        u = np.concatenate([rep[at], rep[[x for x, _ in edges]] if edges else rep[:0]])
        v = np.concatenate([rep[at], rep[[y for _, y in edges]] if edges else rep[:0]])
        return pd.DataFrame({"u": u, "v": v, "n": np.concatenate([links[at], np.zeros(len(edges), dtype=np.int64)])})

    return joined


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, interval: int = INTERVAL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings (vec_id, embedding, label)``."""
    spark, k, eps = embeddings.sparkSession, AXES, float(np.sqrt(2 - 2 * threshold)) + 1e-9
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    able = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    reps = written(rows.where(able).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    sizes = [r[0] for r in reps.select(F.size("embedding").alias("d")).groupBy("d").count().orderBy(F.desc("count")).limit(16).collect()]
    total, label = reps.count(), reps.schema["label"].dataType.simpleString()
    axes = {d: principal_axes(reps, d) for d in sizes}
    cs = [f"c{i}" for i in range(k)]
    schema = f"label {label}, embedding array<double>, rep long, n long, dims int, " + ", ".join(f"{c} long" for c in cs)
    parts = max(1, -(-total // interval))
    cut = written(
        reps.select("label", "embedding", "rep", "n").mapInPandas(_cells_of(axes, eps, k), schema).repartitionByRange(parts, "label", "dims", *cs, "rep").withColumn("iv", F.spark_partition_id()),
        "intervals",
    )
    boxes = cut.groupBy("label", "dims", "iv").agg(*[f(c).alias(f"{p}{c}") for c in cs for f, p in ((F.min, "lo_"), (F.max, "hi_"))])
    by_first = boxes.withColumn("first", F.explode(F.sequence("lo_c0", F.col("hi_c0") + 1)))
    x, y = by_first.alias("x"), by_first.alias("y")
    apart = [F.greatest(f"x.lo_{c}", f"y.lo_{c}") - F.least(f"x.hi_{c}", f"y.hi_{c}") <= 1 for c in cs]
    near = F.lit(True)
    for test in apart:
        near = near & test
    plan = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.dims") == F.col("y.dims")) & (F.col("x.first") == F.col("y.first")) & (F.col("x.iv") <= F.col("y.iv")) & near)
    plan = plan.select(F.col("x.label").alias("label"), F.col("x.dims").alias("dims"), F.col("x.iv").alias("p"), F.col("y.iv").alias("q")).distinct()
    sides = plan.select("label", "dims", "p", "q", F.col("p").alias("iv"), F.lit(0).alias("side")).unionAll(
        plan.where("p < q").select("label", "dims", "p", "q", F.col("q").alias("iv"), F.lit(1).alias("side"))
    )
    found = written(
        cut.join(sides, ["label", "dims", "iv"]).groupBy("label", "dims", "p", "q").applyInPandas(_join_intervals(k, threshold), "u long, v long, n long"),
        "links",
    )
    comps = connected_components(found.where("u <> v").select("u", "v"))
    counts = found.where("u = v").groupBy("u").agg(F.sum("n").alias("near"))
    of_rep = (
        reps.join(counts, reps.rep == counts.u, "left").join(comps, F.col("rep") == F.col("node"), "left")
        .select("label", "embedding", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("comp"))
    )
    keyed = rows.withColumn("able", able).select("vec_id", F.when(F.col("able"), F.col("label")).alias("label"), F.when(F.col("able"), F.col("embedding")).alias("embedding"))
    out = keyed.join(of_rep, ["label", "embedding"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_near_embeddings(embeddings: DataFrame) -> DataFrame:
    return near_vectors(embeddings)


OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, vec_id) AS component_id, vec_id = coalesce(c.c, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.a = vec_id
"""
