"""Comparison of evaluation results: a difference exists only between arms that share a split, a unit count and a criterion."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class NotComparable(Exception):
    """Raised by the scalar interface; in bulk a refusal is a row with its reasons."""


def split_id(members: tuple[str, ...] | list[str]) -> str:
    """12 hex digits of the SHA-256 of sorted members, one a line; repeats count, none is refused."""
    if isinstance(members, str) or not members:
        raise NotComparable("a split needs a list of members")
    return hashlib.sha256("\n".join(sorted(members)).encode()).hexdigest()[:12]


def split_ids(members: DataFrame) -> DataFrame:
    """``split_id`` of each ``split`` as ``split_id`` makes it, and the number of its members; splits without members have none.

    A split's members reach one task, since the hash is a chain, but as a sorted stream: Spark's sort keeps them on disk, and the task holds a batch and the state of the hash.
    """
    kind = members.schema["split"].dataType.simpleString()

    def hashed(batches):
        open_, chain, n = [], None, 0
        for batch in batches:
            splits, items = batch.column("split"), batch.column("item").to_pylist()
            at = 0
            for run in pc.run_end_encode(splits).run_ends.to_pylist() if len(splits) else []:
                if open_ != [splits[at].as_py()]:
                    if open_:
                        yield _told(open_[0], chain, n, batch.schema.field("split").type)
                    open_, chain, n = [splits[at].as_py()], hashlib.sha256(), 0
                chain.update((("\n" if n else "") + "\n".join(items[at:run])).encode("utf-8", "surrogatepass"))
                n, at = n + run - at, run
            last = batch.schema.field("split").type
        if open_:
            yield _told(open_[0], chain, n, last)

    rows = members.where(F.col("item").isNotNull()).select("split", F.col("item").cast("string").alias("item"))
    return rows.repartition("split").sortWithinPartitions("split", "item").mapInArrow(hashed, f"split {kind}, split_id string, n_items long")


def _told(split, chain, n: int, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"split": pa.array([split], type=kind), "split_id": [chain.hexdigest()[:12]], "n_items": pa.array([n], type=pa.int64())})


def shown_difference(difference: DataFrame, most: int = 3) -> DataFrame:
    """``side, shown``: the first members of each side of a ``split_difference`` and how many more there are."""
    ranked = difference.withColumn("k", F.row_number().over(Window.partitionBy("side").orderBy("item")))
    firsts = ranked.where(F.col("k") <= most).groupBy("side").agg(F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("first"))
    return firsts.join(difference.groupBy("side").agg(F.count("*").alias("n")), "side").select(
        "side", F.concat("first", F.when(F.col("n") > most, F.format_string(" and %d more", F.col("n") - most)).otherwise("")).alias("shown")
    )


def units_of(block: dict, names: tuple[str, ...]) -> int | None:
    """The number of units as a sum of counts of a metrics block, none if one is missing or not whole."""
    held = [block.get(n) for n in names]
    return sum(held) if all(isinstance(x, int) for x in held) else None


def split_difference(members: DataFrame, a: str, b: str) -> DataFrame:
    """``side, item``: members that only one of two splits has."""
    left, right = (members.where(F.col("split") == s).select("item").distinct() for s in (a, b))
    return left.join(right, "item", "left_anti").select(F.lit("a").alias("side"), "item").unionAll(right.join(left, "item", "left_anti").select(F.lit("b").alias("side"), "item"))


def canonical(value) -> str:
    """A criterion's value as JSON, with numbers that Python holds equal alike."""
    if isinstance(value, bool):
        value = int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, sort_keys=True)


def criterion(fields: dict) -> str:
    """The comparison key of a criterion: its fields sorted by name, null kept apart from absent."""
    if not fields:
        raise NotComparable("a criterion needs a field")
    return json.dumps([[k, canonical(fields[k])] for k in sorted(fields)])


def criterion_difference(fields: DataFrame, a: str, b: str) -> DataFrame:
    """``k, a_value, b_value``: fields that differ; a side without the field shows ``(absent)``, which is not null."""
    left, right = (fields.where(F.col("criterion") == c).select("k", F.coalesce("v", F.lit("null")).alias(f"{n}_value")) for c, n in ((a, "a"), (b, "b")))
    both = left.join(right, "k", "full_outer").select("k", *[F.coalesce(c, F.lit("(absent)")).alias(c) for c in ("a_value", "b_value")])
    return both.where("a_value <> b_value")


def pairs(arms: DataFrame) -> DataFrame:
    """Every pair of ``arms (name, split_id, n_units, criterion)`` of one task, with its ``problems``.

    Pairs are formed within ``task``, an equi-join; the unit count is checked only where splits agree, and both problems and criterion are told.
    """
    a, b = arms.alias("a"), arms.alias("b")
    both = a.join(b, (F.col("a.task") == F.col("b.task")) & (F.col("a.name") < F.col("b.name")))
    split = F.col("a.split_id") != F.col("b.split_id")
    units = ~split & (F.col("a.n_units") != F.col("b.n_units"))
    problems = F.array_compact(F.array(F.when(split, "split"), F.when(units, "n_units"), F.when(F.col("a.criterion") != F.col("b.criterion"), "criterion")))
    asserted = [(F.startswith(c, F.lit("asserted")) | F.contains(c, F.lit("reconstructed"))) for c in (F.col("a.provenance"), F.col("b.provenance"))]
    return both.select(
        F.col("a.task").alias("task"), F.col("a.name").alias("a"), F.col("b.name").alias("b"), problems.alias("problems"),
        (F.coalesce(asserted[0], F.lit(False)) | F.coalesce(asserted[1], F.lit(False))).alias("asserted"),
    )


def deltas(arms: DataFrame, metrics: DataFrame, role: str, metric: str) -> DataFrame:
    """``a - b`` of one metric for every pair without problems; a pair that lacks the metric under that role is a row of ``without_metric``."""
    values = metrics.where((F.col("role") == role) & (F.col("metric") == metric)).select("name", "value")
    good = pairs(arms).where(F.size("problems") == 0)
    left, right = values.select(F.col("name").alias("a"), F.col("value").alias("va")), values.select(F.col("name").alias("b"), F.col("value").alias("vb"))
    return good.join(left, "a").join(right, "b").select("task", "a", "b", "asserted", "va", "vb", (F.col("va") - F.col("vb")).alias("delta"))


def without_metric(arms: DataFrame, metrics: DataFrame, role: str, metric: str) -> DataFrame:
    """``task, a, b, problems`` of pairs that could be compared but for a metric that an arm lacks under that role."""
    has = metrics.where((F.col("role") == role) & (F.col("metric") == metric)).select("name").distinct()
    good = pairs(arms).where(F.size("problems") == 0).select("task", "a", "b")
    for side in ("a", "b"):
        good = good.join(has.select(F.col("name").alias(side), F.lit(True).alias(f"has_{side}")), side, "left")
    lacking = F.array_compact(F.array(*[F.when(F.col(f"has_{x}").isNull(), f"metric:{x}") for x in ("a", "b")]))
    return good.withColumn("problems", F.array_join(lacking, ",")).where("problems <> ''").select("task", "a", "b", "problems")


def refused(arms: DataFrame) -> DataFrame:
    return pairs(arms).where(F.size("problems") > 0).select("task", "a", "b", F.array_join("problems", ",").alias("problems"))


def compare(arms: DataFrame, metrics: DataFrame, a: str, b: str, role: str, metric: str) -> float:
    """The difference of two named arms, or ``NotComparable`` with the reasons."""
    two = arms.where(F.col("name").isin(a, b)).withColumn("task", F.lit("")).cache()
    try:
        problems = pairs(two).select("problems").first()
        if problems is None:
            raise NotComparable(f"no arm {a} or no arm {b}")
        if problems[0]:
            raise NotComparable(", ".join(problems[0]))
        value = {r["name"]: r["value"] for r in metrics.where(F.col("name").isin(a, b) & (F.col("role") == role) & (F.col("metric") == metric)).collect()}
        if len(value) < 2:
            raise NotComparable(f"{metric} is not known for both arms under role {role}")
        return value[a] - value[b]
    finally:
        two.unpersist()


def sweep_interior(sweep: DataFrame, parameter: str, metric: str) -> DataFrame:
    """Per ``run``: where the metric is best (first of ties), and whether that is inside the swept range; one point passes."""
    best = F.max(F.struct(F.col(metric), (-F.col(parameter)).alias("p")))
    out = sweep.groupBy("run").agg(best.alias("best"), F.min(parameter).alias("low"), F.max(parameter).alias("high"), F.count_distinct(parameter).alias("n"))
    at = -F.col("best.p")
    return out.select("run", at.alias("best_at"), F.col(f"best.{metric}").alias("best_value"), ((F.col("n") < 2) | ((at > F.col("low")) & (at < F.col("high")))).alias("interior"))


def constant_units(points: DataFrame) -> DataFrame:
    """``run, points, least, most, constant``: whether ``tp + fn`` is the same at every point of a sweep ``(run, tp, fn)``; a point without one of them is not."""
    units = F.col("tp") + F.col("fn")
    out = points.groupBy("run").agg(F.count("*").alias("points"), F.count(units).alias("known"), F.min(units).alias("least"), F.max(units).alias("most"))
    return out.select("run", "points", "least", "most", ((F.col("known") == F.col("points")) & (F.col("least") == F.col("most"))).alias("constant"))


def ground_truth(*counts: Column) -> Column:
    """The number of units as a sum of counts, null if one is missing."""
    out = counts[0]
    for c in counts[1:]:
        out = out + c
    return out


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``run, threshold, tp, fp, fn, f1`` of ``scored (run, score, truth)``: one pass, counting by the highest threshold reached."""
    steps = sorted(thresholds)
    level = F.size(F.filter(F.array(*[F.lit(t) for t in steps]), lambda t: t <= F.col("score")))
    byl = scored.groupBy("run", level.alias("level")).agg(F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") == 0).alias("neg"))
    rows = byl.select("run", "pos", "neg", F.explode(F.transform(F.array(*[F.lit(t) for t in steps]), lambda t, i: F.struct(t.alias("threshold"), (i < F.col("level")).alias("hit")))).alias("s"))
    out = rows.groupBy("run", F.col("s.threshold").alias("threshold")).agg(
        F.sum(F.when(F.col("s.hit"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s.hit"), F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~F.col("s.hit"), F.col("pos")).otherwise(0)).alias("fn")
    )
    return out.withColumn("f1", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)))


def leaked_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Groups of a test split that a training split has too."""
    return test.select(group).distinct().join(train.select(group).distinct(), group, "left_semi")


def label_guard(rows: DataFrame, columns: list[str], most: float = 0.5) -> DataFrame:
    """``column, share, suspicious``: columns with nearly as many values as rows are keys, not labels."""
    one = rows.agg(*[(F.count_distinct(c) / F.count("*")).alias(c) for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns])
    return one.select(F.explode(parts).alias("r")).select("r.column", F.round("r.share", 6).alias("share"), (F.col("r.share") > most).alias("suspicious"))


def trajectory(runs: DataFrame) -> DataFrame:
    """Per metric and run: the change from the run before, and whether its sign turned."""
    w = Window.partitionBy("metric").orderBy("run")
    out = runs.withColumn("delta", F.col("value") - F.lag("value").over(w))
    return out.withColumn("reversed", F.coalesce(F.signum("delta") * F.signum(F.lag("delta").over(w)) < 0, F.lit(False)))
