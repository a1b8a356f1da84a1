"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A token budget for the root flows down: each node's budget is divided among its
children in proportion to their weights, a child takes at most what its subtree holds over all epochs, and what it
leaves goes to its siblings by weight. A shortage thus reaches an ancestor only when a whole subtree is exhausted.
The split of one node is solved exactly with cumulative sums over the children ordered by capacity over weight.

A leaf's stream is its documents in seeded random order, once per epoch; the leaf takes the prefix of the stream that
holds its budget of tokens. The stream is never sorted as a whole: token sums of hash buckets tell which buckets lie
wholly inside the prefix, and only the bucket at its end is ordered.

Tokens are maximal runs other than ASCII white space; null texts have none. A null language or source counts as an
empty string; null ids order first. A node of weight 0 or less takes nothing; a node that no weights name has weight 1.
Repeated rows are separate documents. A document without tokens is taken if the
prefix is not yet full where it stands. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probatum.llm.common import written

LEVELS = ("domain", "lang", "source")
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 3, "de": 1, "fr": 1, "es": 1}
FRACTION, EPOCHS, SEED, BUCKET_DIGITS = 0.5, 2, 17, 3
WORD = r"[^ \t\n\x0B\f\r]+"


def domain_of(source: Column) -> Column:
    """The domain of a source: the number at its end modulo 4, or ``other``."""
    n = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    return F.coalesce(F.concat(F.lit("domain"), (n % 4).cast("string")), F.lit("other"))


def weight_of(value: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(value == name, F.lit(w)).otherwise(out)
    return out.cast("double")


def divide(children: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Adds ``given``: each child's part of its parent's ``budget`` by ``weight``, at most its ``capacity``."""
    key = [F.col(c) for c in parent] or [F.lit(0)]
    order = Window.partitionBy(*key).orderBy(F.col("capacity") / F.col("weight"), "node")
    whole = Window.partitionBy(*key)
    out = children.withColumn("ratio", F.col("capacity") / F.col("weight"))
    out = out.withColumn("cum_cap", F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("rest_w", F.sum("weight").over(whole) - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("full", F.col("cum_cap") + F.col("ratio") * F.col("rest_w") <= F.col(budget))
    out = out.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole))
    out = out.withColumn("w_open", F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("weight"))).over(whole))
    given = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.col("weight") * ((F.col(budget) - F.col("cap_full")) / F.col("w_open")))
    return out.withColumn("given", given).drop("ratio", "cum_cap", "rest_w", "full", "cap_full", "w_open")


def leaf_budgets(leaves: DataFrame, fraction: float, epochs: int, domain_weights: dict, lang_weights: dict, source_weights: dict) -> DataFrame:
    """``domain, lang, source, budget`` from ``leaves (domain, lang, source, tokens)``, one row per leaf."""
    weights = {"domain": domain_weights, "lang": lang_weights, "source": source_weights}
    level = leaves.agg(F.floor(F.sum("tokens") * fraction).cast("double").alias("budget"))
    for name in LEVELS:  # what nothing can be taken from has no capacity at any level above it
        leaves = leaves.where(weight_of(F.col(name), weights[name]) > 0)
    for i, name in enumerate(LEVELS):
        own, parent = list(LEVELS[: i + 1]), list(LEVELS[:i])
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * epochs).alias("capacity"))
        nodes = nodes.join(level, parent) if parent else nodes.crossJoin(F.broadcast(level))  # the root's budget is one row
        nodes = nodes.withColumns({"weight": weight_of(F.col(name), weights[name]), "node": F.col(name)})
        level = divide(nodes, parent, "budget").select(*own, F.col("given").alias("budget"))
    return level.withColumn("budget", F.floor("budget"))


def mixed(
    docs: DataFrame, fraction: float = FRACTION, epochs: int = EPOCHS, seed: int = SEED,
    domain_weights: dict | None = None, lang_weights: dict | None = None, source_weights: dict | None = None,
) -> DataFrame:
    """``doc_id, domain, lang, source, epoch, tokens, taken``: a row for each epoch in which a document is taken."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = docs.select(
        "doc_id", domain_of(empty("source")).alias("domain"), empty("lang").alias("lang"), empty("source").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
    )
    base = written(base, "mixing")
    leaves = base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    given = (DOMAIN_WEIGHTS if domain_weights is None else domain_weights, LANG_WEIGHTS if lang_weights is None else lang_weights, source_weights or {})
    budgets = written(leaf_budgets(leaves, fraction, epochs, *given), "budgets")
    # a leaf has about as many buckets as a bucket has rows, whatever the size, so neither the sums nor the last bucket is a large group
    digits = max(BUCKET_DIGITS, math.ceil(math.log(max(1, base.count())) / math.log(16) / 2))
    stream = base.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    stream = stream.withColumn("key", F.md5(name)).withColumn("bucket", F.substring("key", 1, digits))
    leaf = list(LEVELS)
    sums = stream.groupBy(*leaf, "epoch", "bucket").agg(F.sum("tokens").alias("held")).join(budgets, leaf)
    before = Window.partitionBy(*leaf).orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("start", F.sum("held").over(before) - F.col("held")).where("start < budget")
    rows = stream.join(sums.hint("merge"), [*leaf, "epoch", "bucket"])  # up to a row for each document: never broadcast
    whole = rows.where("start + held <= budget").select("doc_id", *leaf, "epoch", "tokens", F.col("tokens").alias("taken"))
    inside = Window.partitionBy(*leaf, "epoch", "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("start + held > budget").withColumn("at", F.col("start") + F.sum("tokens").over(inside) - F.col("tokens")).where("at < budget")
    return whole.unionAll(last.select("doc_id", *leaf, "epoch", "tokens", F.least(F.col("tokens"), F.col("budget") - F.col("at")).alias("taken")))


def op2_mixing(docs: DataFrame) -> DataFrame:
    return mixed(docs)


def _weight_sql(name: str, weights: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    return f"CASE {name} {cases} ELSE 1 END" if cases else "1"


def _level_sql(i: int, weights: dict[str, int]) -> str:
    own, parent = LEVELS[: i + 1], LEVELS[:i]
    part = "PARTITION BY " + ", ".join(parent) if parent else ""
    run = f"OVER ({part} ORDER BY ratio, {LEVELS[i]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    join = f"JOIN b{i} USING ({', '.join(parent)})" if parent else "CROSS JOIN b0"
    return f"""
n{i} AS (SELECT {", ".join(own)}, sum(tokens)::BIGINT * {EPOCHS} AS capacity, ({_weight_sql(LEVELS[i], weights)})::DOUBLE AS weight FROM alive GROUP BY {", ".join(own)}),
r{i} AS (SELECT n{i}.*, budget, capacity / weight AS ratio FROM n{i} {join}),
c{i} AS (SELECT *, sum(capacity) {run} + ratio * (sum(weight) OVER ({part}) - sum(weight) {run}) <= budget AS is_full FROM r{i}),
d{i} AS (SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({part}) AS cap_full, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) AS w_open FROM c{i}),
b{i + 1} AS (SELECT {", ".join(own)}, CASE WHEN is_full THEN capacity::DOUBLE ELSE weight * ((budget - cap_full) / w_open) END AS budget FROM d{i})"""


def mixed_sql(domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS, source_weights: dict[str, int] | None = None) -> str:
    weights = (domain_weights, lang_weights, source_weights or {})
    alive = " AND ".join(f"({_weight_sql(name, w)}) > 0" for name, w in zip(LEVELS, weights, strict=True))
    levels = ",".join(_level_sql(i, w) for i, w in enumerate(weights))
    return f"""
WITH base AS (
  SELECT doc_id, coalesce('domain' || (try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INT) % 4)::VARCHAR, 'other') AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS tokens
  FROM documents),
alive AS (SELECT * FROM base WHERE {alive}),
b0 AS (SELECT floor(sum(tokens)::BIGINT * {FRACTION}::DOUBLE)::DOUBLE AS budget FROM base),
{levels},
stream AS (
  SELECT doc_id, domain, lang, source, epoch::INT AS epoch, tokens, floor(budget)::BIGINT AS budget,
    (sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens)::BIGINT AS start
  FROM base JOIN b3 USING (domain, lang, source), range({EPOCHS}) t(epoch))
SELECT doc_id, domain, lang, source, epoch, tokens, least(tokens, budget - start) AS taken FROM stream WHERE start < budget
"""


OP2_SQL = mixed_sql()
