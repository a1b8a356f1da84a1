"""Hard negatives from k-means inverted lists.

Rows get the nearest of a few centroids (fitted on a bounded sample; every row is indexed) and are laid into lists: runs of
rows of one centroid, ordered by label and distance, with the radius of the run around the centroid and the range
of its labels. For a query q, a list's products lie within ``q.c - |q| r`` and ``q.c + |q| r`` (Cauchy-Schwarz).

Queries go in blocks. A block asks clusters in rounds, in each query's own order of upper bounds; a round asks only clusters
that can still matter: not if the bound lies strictly below the k-th score so far (equal scores may win by a smaller id), and, where
a window of scores is wanted, not if a list lies outside it. What a round finds is merged per block before the
next. The last round takes all clusters that are left, so the result is exact; sample and centroids only steer the order.
First each anchor's positives are sought among rows of its label, then, per positive, the negatives of its window.

Every component becomes floor(scale * x). Rows with a null id, label or vector, or with a null or non-finite component, take no part;
equal rows count once; rows that share the anchor's id are the anchor itself. Shorter vectors count as padded with zeros. Scores beyond
the range of a long are clamped to it. Anchors without positives, and positives without negatives, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import written
from probatum.llm.topk import EXACT, _floor, _products

EVERY, RELABEL, LABELS, POSITIVES, NEGATIVES, SCALE = 50, 7, 10, 5, 3, 256.0
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: The most centroids, the rows that each is made for, and the rows of the sample for each.
CENTROIDS, CLUSTER_ROWS, SAMPLE_EACH, STEPS, SEED = 512, 1024, 32, 8, 11
LIST, BLOCK, ROUNDS = 2048, 128, (4, 16)
NONE = np.iinfo(np.int64).min


def centroids_of(sample: np.ndarray, k: int, steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    """Lloyd's iterations from ``k`` distinct rows of the sample."""
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].astype(float)
    for _ in range(steps):
        own = nearest(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance."""
    own = ((centres * centres).sum(1)[None] - 2 * rows @ centres.T).argmin(1)
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(1))


def padded(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


class Packed:
    """Rows of ids, labels and vectors as one row of arrays in binary form."""

    SCHEMA = "ids binary, labels binary, vectors binary"

    def __init__(self, ids, labels, vectors):
        self.ids, self.labels, self.vectors = ids, labels, vectors

    def row(self) -> dict:
        return {"ids": self.ids.astype("<i8").tobytes(), "labels": self.labels.astype("<i8").tobytes(), "vectors": self.vectors.astype("<f8").tobytes()}

    @classmethod
    def of(cls, ids: bytes, labels: bytes, vectors: bytes) -> Packed:
        ids = np.frombuffer(ids, dtype="<i8")
        return cls(ids, np.frombuffer(labels, dtype="<i8"), np.frombuffer(vectors, dtype="<f8").reshape(len(ids), -1))


def _runs(width: int, size: int, centres: np.ndarray):
    """Consecutive rows of a cluster as lists of at most ``size`` rows."""

    def laid(batches):
        held, cluster = [], None

        def full():
            pdf = pd.concat(held, ignore_index=True)
            labels = pdf["label"].to_numpy()
            packed = Packed(pdf["vec_id"].to_numpy(), labels, padded(pdf["v"], width)).row()
            own = int(pdf["cluster"].iloc[0])
            return pd.DataFrame([packed | {"cluster": own, "radius": float(pdf["far"].max()), "least": int(labels.min()), "most": int(labels.max()), "n": len(pdf)}])

        n = 0
        for pdf in batches:
            at = pdf["cluster"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and cluster != at[a]:
                    yield full()
                    held, n = [], 0
                cluster = at[a]
                while a < b:
                    part = pdf.iloc[a : min(b, a + size - n)]
                    held.append(part)
                    n, a = n + len(part), a + len(part)
                    if n == size:
                        yield full()
                        held, n = [], 0
        if held:
            yield full()

    return laid


def ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` greatest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Goal:
    """What a block of queries still wants: for each query ``slots`` targets of ``k`` results within ``low`` to ``high``.

    ``best`` is an array (queries, slots, k, 2) of scores and ids; ``NONE`` marks empty places and slots that want nothing.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, best: np.ndarray, same: bool):
        self.low, self.high, self.best, self.same = low, high, best, same

    @classmethod
    def positives(cls, n: int, k: int) -> Goal:
        limits = np.iinfo(np.int64)
        return cls(np.full((n, 1), limits.min + 1), np.full((n, 1), limits.max), np.full((n, 1, k, 2), NONE), True)

    @classmethod
    def negatives(cls, positives: np.ndarray, k: int, low: int, high: int) -> Goal:
        """Windows from found positives (queries, 1, slots, 2): ``low * p <= 100 * n <= high * p`` in whole numbers."""
        score = positives[:, 0, :, 0].astype(object)
        none = positives[:, 0, :, 0] == NONE
        at_least, at_most = -((-low * score) // 100), (high * score) // 100
        at_least[none], at_most[none] = 1, 0
        return cls(at_least.astype(np.int64), at_most.astype(np.int64), np.full((*none.shape, k, 2), NONE), False)

    def least(self) -> np.ndarray:
        """The least score that can still enter each slot: the k-th so far, or the window's lower end."""
        return np.maximum(self.low, self.best[:, :, -1, 0])

    def needed(self, products: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The least radius with which a list around each centroid can matter, per query: the bound must reach ``least`` and the list meet the window."""
        low, high = self.least().astype(float), self.high.astype(float)
        out = np.full(products.shape, np.inf)
        for s in range(low.shape[1]):
            short = np.maximum(low[:, s, None] - products, products - high[:, s, None])
            slack = 1e-9 * (1 + np.abs(low[:, s, None]) + np.abs(products))
            with np.errstate(divide="ignore", invalid="ignore"):
                radius = np.where(short <= slack, 0.0, (short - slack) / lengths[:, None])
            radius[(self.low[:, s] > self.high[:, s]) | (low[:, s] > high[:, s])] = np.inf
            out = np.minimum(out, radius)
        return out

    def merge(self, i: int, s: int, scores: np.ndarray, ids: np.ndarray) -> None:
        held = self.best[i, s]
        held = held[held[:, 0] != NONE]
        scores, ids = np.concatenate([held[:, 0], scores]), np.concatenate([held[:, 1], ids])
        top = ranked(scores, ids, self.best.shape[2])
        self.best[i, s, : len(top), 0], self.best[i, s, : len(top), 1] = scores[top], ids[top]

    def search(self, asked: np.ndarray, queries: Packed, found: Packed) -> None:
        """Adds what the queries at ``asked`` find in a list."""
        q, c = queries.vectors[asked], found.vectors
        longest = [float(np.sqrt((x * x).sum(1).max(initial=0))) for x in (q, c)]
        products = _products(q, c, longest[0] * longest[1] < EXACT)
        least = self.least()
        for row, i in zip(products, asked, strict=True):
            able = (found.labels == queries.labels[i]) == self.same
            able &= (found.ids != queries.ids[i]) & (row >= float(least[i].min()) - 1) & (row <= float(self.high[i].max()) + 1)
            if not able.any():
                continue
            scores, ids = row[able].astype(np.int64), found.ids[able]
            for s in range(least.shape[1]):
                inside = (scores >= least[i, s]) & (scores <= self.high[i, s])
                if inside.any():
                    top = ranked(scores[inside], ids[inside], self.best.shape[2])
                    self.merge(i, s, scores[inside][top], ids[inside][top])

    SCHEMA = "low binary, high binary, best binary, slots int, wanted int, same boolean"

    def row(self) -> dict:
        return {"low": self.low.tobytes(), "high": self.high.tobytes(), "best": self.best.tobytes(), "slots": self.low.shape[1], "wanted": self.best.shape[2], "same": self.same}

    @classmethod
    def of(cls, row) -> Goal:
        slots, k = int(row.slots), int(row.wanted)
        flat = [np.frombuffer(x, dtype=np.int64) for x in (row.low, row.high, row.best)]
        return cls(flat[0].reshape(-1, slots), flat[1].reshape(-1, slots), flat[2].reshape(-1, slots, k, 2).copy(), bool(row.same))


_STATE = f"block long, {Packed.SCHEMA}, {Goal.SCHEMA}"


def _state(block: int, queries: Packed, goal: Goal) -> pd.DataFrame:
    return pd.DataFrame([{"block": block} | queries.row() | goal.row()])


def _asking(centres: np.ndarray, radii: np.ndarray, first: int, last: int):
    """``block, cluster, radius, asked``: the clusters that queries ask in a round, and the radius that a list needs to matter."""

    def plan(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                queries, goal = Packed.of(row.ids, row.labels, row.vectors), Goal.of(row)
                products, lengths = queries.vectors @ centres.T, np.sqrt((queries.vectors**2).sum(1))
                bounds = products + lengths[:, None] * radii
                rank = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1, kind="stable")
                needed = goal.needed(products, lengths)
                needed[(rank < first) | (rank >= last) | (needed > radii * (1 + 1e-9) + 1e-9)] = np.inf
                out = []
                for c in np.flatnonzero(np.isfinite(needed).any(0)):
                    asked = np.flatnonzero(np.isfinite(needed[:, c]))
                    out.append((row.block, int(c), float(needed[asked, c].min()), asked.astype("<i4").tobytes(), bool(goal.same), int(queries.labels[asked].min()), int(queries.labels[asked].max())))
                if out:
                    yield pd.DataFrame(out, columns=["block", "cluster", "needed", "asked", "same", "low_label", "high_label"])

    return plan


def _visit(batches):
    """What a block finds in one list, as a goal of its own that starts from the block's thresholds."""
    for pdf in batches:
        for row in pdf.itertuples():
            queries, goal = Packed.of(row.ids, row.labels, row.vectors), Goal.of(row)
            before = goal.best.copy()
            goal.search(np.frombuffer(row.asked, dtype="<i4"), queries, Packed.of(row.l_ids, row.l_labels, row.l_vectors))
            changed = np.argwhere((goal.best != before).any((2, 3)))
            if len(changed):
                held = goal.best[changed[:, 0], changed[:, 1]]
                yield pd.DataFrame([{"block": row.block, "at": changed.astype("<i4").tobytes(), "found": held.tobytes()}])


def _gather(key, state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    row = next(state.itertuples())
    goal, k = Goal.of(row), int(row.wanted)
    for at, held in zip(found["at"], found["found"], strict=True):
        for (i, s), best in zip(np.frombuffer(at, dtype="<i4").reshape(-1, 2), np.frombuffer(held, dtype=np.int64).reshape(-1, k, 2), strict=True):
            known = {(NONE, NONE), *map(tuple, goal.best[i, s])}  # an empty place is no result, also where the goal has none left
            new = np.array([b for b in best if tuple(b) not in known], dtype=np.int64).reshape(-1, 2)
            goal.merge(i, s, new[:, 0], new[:, 1])
    return _state(row.block, Packed.of(row.ids, row.labels, row.vectors), goal)


def usable_rows(embeddings: DataFrame, scale: float, relabel: int, labels: int) -> DataFrame:
    """``vec_id, label, v``: the rows that take part, in whole numbers, with the labels that count."""
    c = F.col("embedding")
    fine = F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    label = F.col("label").cast("long")
    if relabel:
        label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % labels).otherwise(label)
    scaled = F.transform(c.cast("array<double>"), lambda x: _floor(x * scale))
    return embeddings.where(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), scaled.alias("v")).distinct()


class Index:
    """The inverted lists of ``rows (vec_id, label, v)``: ``lists`` on shared storage, centroids and radii of clusters here."""

    def __init__(self, rows: DataFrame, size: int = LIST):
        self.rows = rows
        about = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
        self.n, self.width = about["n"], max(1, about["width"])
        k = max(1, min(CENTROIDS, self.n // CLUSTER_ROWS))
        # an order by hash gives the sample the same number of rows at every size
        some = rows.select("v", F.xxhash64("vec_id", "label", F.lit(SEED)).alias("h")).orderBy("h").limit(SAMPLE_EACH * k).select("v").collect()
        self.centres = centroids_of(padded([r["v"] for r in some], self.width), k) if some else np.zeros((1, self.width))
        centres, width = self.centres, self.width

        def assigned(batches):
            for pdf in batches:
                own, far = nearest(padded(pdf["v"], width), centres)
                yield pdf.assign(cluster=own, far=far)

        near = written(rows.mapInPandas(assigned, "vec_id long, label long, v array<double>, cluster int, far double"), "near")
        order = ["cluster", "label", "far", "vec_id"]
        laid = near.repartitionByRange(max(1, -(-self.n // (8 * size))), *order).sortWithinPartitions(*order)
        schema = f"cluster int, radius double, least long, most long, n long, {Packed.SCHEMA}"
        self.lists = written(laid.mapInPandas(_runs(width, size, centres), schema).withColumn("list", F.monotonically_increasing_id()), "lists")
        self.radii = np.zeros(len(centres))
        for r in self.lists.groupBy("cluster").agg(F.max("radius").alias("radius")).collect():  # at most CENTROIDS rows
            self.radii[r["cluster"]] = r["radius"]

    def blocks(self, queries: DataFrame, k: int, every: int, size: int = BLOCK) -> DataFrame:
        """Queries near each other as blocks that want their ``k`` best rows of the same label."""
        centres, width = self.centres, self.width

        def keyed(batches):
            for pdf in batches:
                yield pdf.assign(cluster=nearest(padded(pdf["v"], width), centres)[0])

        def packed(batches):
            held, n = [], 0

            def full():
                pdf = pd.concat(held, ignore_index=True)
                return pd.DataFrame([Packed(pdf["vec_id"].to_numpy(), pdf["label"].to_numpy(), padded(pdf["v"], width)).row() | Goal.positives(len(pdf), k).row()])

            for pdf in batches:
                at = 0
                while at < len(pdf):
                    part = pdf.iloc[at : at + size - n]
                    held.append(part)
                    n, at = n + len(part), at + len(part)
                    if n == size:
                        yield full()
                        held, n = [], 0
            if held:
                yield full()

        order = ["cluster", "label", "vec_id"]
        rows = queries.mapInPandas(keyed, "vec_id long, label long, v array<double>, cluster int")
        rows = rows.repartitionByRange(max(1, -(-self.n // (every * 8 * size))), *order).sortWithinPartitions(*order)
        return written(rows.mapInPandas(packed, f"{Packed.SCHEMA}, {Goal.SCHEMA}").withColumn("block", F.monotonically_increasing_id()).select(*_STATE_COLUMNS), "blocks")

    def answered(self, state: DataFrame, rounds: tuple = ROUNDS) -> DataFrame:
        """``state`` with the best results of every block, exact."""
        edges = [0, *(r for r in rounds if r < len(self.centres)), len(self.centres)]
        heads = self.lists.select("list", "cluster", "radius", "least", "most")
        bodies = self.lists.select("list", *[F.col(c).alias(f"l_{c}") for c in ("ids", "labels", "vectors")])
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            plan = state.mapInPandas(_asking(self.centres, self.radii, first, last), "block long, cluster int, needed double, asked binary, same boolean, low_label long, high_label long")
            matters = F.col("radius") * (1 + 1e-9) + 1e-9 >= F.col("needed")
            shared = (F.col("least") <= F.col("high_label")) & (F.col("most") >= F.col("low_label"))
            other = (F.col("least") < F.col("most")) | (F.col("low_label") < F.col("high_label")) | (F.col("least") != F.col("low_label"))
            pairs = plan.join(heads, "cluster").where(matters & F.when(F.col("same"), shared).otherwise(other)).select("block", "list", "asked")
            asked = pairs.join(state, "block").join(bodies, "list")
            found = asked.mapInPandas(_visit, "block long, at binary, found binary")
            state = written(state.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_gather, _STATE), "blocks")
        return state


_STATE_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]


def hard_negatives(
    embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (LOW, HIGH),
    scale: float = SCALE, relabel: int = RELABEL, labels: int = LABELS, list_rows: int = LIST, block_rows: int = BLOCK, rounds: tuple = ROUNDS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for anchors with an id divisible by ``every``; ``relabel`` 0 leaves labels as they are."""
    rows = written(usable_rows(embeddings, scale, relabel, labels), "rows")
    index = Index(rows, list_rows)
    sought = index.answered(index.blocks(rows.where(F.col("vec_id") % every == 0), positives, every, block_rows), rounds)

    def windows(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                found = Goal.of(row).best
                goal = Goal.negatives(found, negatives, *window)
                yield _state(row.block, Packed.of(row.ids, row.labels, row.vectors), goal).assign(positives=found.tobytes())

    state = written(sought.mapInPandas(windows, f"{_STATE}, positives binary"), "windows")
    mined = index.answered(state.select(*_STATE_COLUMNS), rounds).join(state.select("block", "positives"), "block")

    def rows_of(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                queries, best = Packed.of(row.ids, row.labels, row.vectors), Goal.of(row).best
                found = np.frombuffer(row.positives, dtype=np.int64).reshape(len(best), -1, 2)
                i, s, r = np.nonzero(best[:, :, :, 0] != NONE)
                yield pd.DataFrame({"anchor_id": queries.ids[i], "positive_id": found[i, s, 1], "rank": (r + 1).astype(np.int32), "negative_id": best[i, s, r, 1], "positive_score": found[i, s, 0], "negative_score": best[i, s, r, 0]})

    return mined.mapInPandas(rows_of, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_hard_negatives(embeddings: DataFrame) -> DataFrame:
    return hard_negatives(embeddings)


OP12_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a, v c WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT a, c, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS r FROM s WHERE same) WHERE r <= {POSITIVES}),
n AS (SELECT p.a, p.c AS positive_id, p.score AS positive_score, s.c AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT a AS anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
