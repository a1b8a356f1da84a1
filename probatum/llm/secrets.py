"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a text is addressed by the SHA-256 of its content (its blob). Rules come in sets, each with a
version. A ledger (a stored table) holds the findings of each blob under each rule version. A scan fetches the text of one
path per blob that some rule version in force has not seen yet, runs only those rules on it, and appends what it finds;
findings of old and new blobs are joined back to all paths. Only hashes are grouped; texts move once, by path, so that a
blob shared by very many paths makes no large group.

Spans are positions in code points, end exclusive, of leftmost non-overlapping matches per rule. Starts follow from the
pieces between matches, which are split off by the same pattern, by running sums over the matches of a text: one row per
match, so that a text with very many matches costs in proportion to them. Null texts count as empty; null ids are scanned
and returned; repeated rows are all returned; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probatum.llm.common import release, scratch_dir, written


def any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules. Runs of a class are matched with their least length where a shorter run can hide nothing.
RULES = (
    Rule("assign", "(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
#: What the base rules don't name (fixed shapes of public token formats).
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{20,}", 0, 24),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", "AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 30),
    Rule("keyblock", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 10),
)
ALL_RULES = RULES + MORE_RULES


@dataclass(frozen=True)
class RuleSet:
    """Rules (places in ``ALL_RULES``) that change together, and their version."""

    version: str
    kinds: tuple[int, ...]


BASE, MORE = RuleSet("base-1", tuple(range(len(RULES)))), RuleSet("more-1", tuple(range(len(RULES), len(ALL_RULES))))
SPANS, LEDGER = "array<struct<start:long,kind:int,end:long>>", "blob string, version string, spans array<struct<start:long,kind:int,end:long>>"
CHUNK = 4096


def _matches(text: Column, kind: int) -> Column:
    """For each match of a rule: its place, the length of the piece before it, its own, and whether its group is long enough."""
    rule = ALL_RULES[kind]
    pattern = F.lit(rule.pattern)
    lengths = lambda strings: F.transform(strings, lambda x: F.length(x))
    zipped = F.arrays_zip(
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("m"), lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("g"), lengths(F.split(text, rule.pattern, -1)).alias("p")
    )
    made = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["p"].alias("gap"), x["m"].alias("length"), (x["g"] >= rule.least).alias("ok")))
    return F.filter(made, lambda x: x["length"].isNotNull())  # there is one piece more than matches


def found_in(texts: DataFrame, sets: tuple[RuleSet, ...]) -> DataFrame:
    """``blob, version, spans`` of the blobs with matches from ``texts (blob, text, todo)``; ``todo`` lists rule versions."""
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,length:int,ok:boolean>>")
    parts, version = [], F.lit(None).cast("string")
    for one in sets:
        asked = F.array_contains("todo", one.version)
        parts += [F.when(asked & F.col("text").rlike(ALL_RULES[k].pattern), _matches(F.col("text"), k)).otherwise(none) for k in one.kinds]
        version = F.when(F.col("kind").isin(*one.kinds), F.lit(one.version)).otherwise(version)
    rows = texts.select("blob", F.explode(F.concat(*parts)).alias("x")).select("blob", "x.*").distinct()  # repeated rows are one blob
    upto = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum((F.col("gap") + F.col("length")).cast("long")).over(upto)).where("ok")
    span = F.struct((F.col("end") - F.col("length")).alias("start"), "kind", "end")
    return rows.withColumn("version", version).groupBy("blob", "version").agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))


def addressed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, sets: tuple[RuleSet, ...] = (BASE,)) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, blob, spans)`` of every row of ``docs (doc_id, text)``, and the ledger's new rows ``(blob, version, spans)``.

    ``ledger`` has the rows of earlier scans; rows of versions that are not in force are not used.
    """
    rows = addressed(docs)
    versions = F.array(*[F.lit(x.version) for x in sets])
    blobs = rows.groupBy("blob").agg(F.min("doc_id").alias("path")).withColumn("todo", versions)
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("version").alias("seen"))
        blobs = blobs.join(seen.hint("merge"), "blob", "left").withColumn("todo", F.array_except("todo", F.coalesce("seen", F.array().cast("array<string>"))))
    unseen = written(blobs.where(F.size("todo") > 0).select(F.col("blob").alias("unseen"), "path", "todo"), "unseen")
    texts = rows.join(unseen.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("path")) & (F.col("blob") == F.col("unseen")))
    hits = found_in(texts.select("blob", "text", "todo"), sets)
    empty = F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    new = written(unseen.select(F.col("unseen").alias("blob"), F.explode("todo").alias("version")).join(hits.hint("merge"), ["blob", "version"], "left").select("blob", "version", empty), "findings")
    every = new if ledger is None else new.unionAll(ledger.select("blob", "version", "spans"))
    return on_paths(rows, every, sets), new


def on_paths(rows: DataFrame, ledger: DataFrame, sets: tuple[RuleSet, ...]) -> DataFrame:
    """``doc_id, blob, spans``: the ledger's findings under the versions in force, joined back to all paths."""
    some = ledger.where(F.col("version").isin(*[x.version for x in sets]) & (F.size("spans") > 0)).dropDuplicates(["blob", "version"])  # most blobs have none
    some = some.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return rows.select("doc_id", "blob").join(some.hint("merge"), "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


class Ledger:
    """A stored ledger: a folder of findings that scans append to."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def read(self) -> DataFrame:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("blob", "string"), ("version", "string"), ("spans", SPANS))]
        self.spark.range(0).select(*none).write.mode("ignore").parquet(self.path)  # the first scan finds an empty ledger
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, docs: DataFrame, sets: tuple[RuleSet, ...]) -> DataFrame:
        """``doc_id, blob, spans`` of every row; what was unseen is scanned and appended first."""
        scan(docs, self.read(), sets)[1].write.mode("append").parquet(self.path)
        release(self.spark)
        return on_paths(addressed(docs), self.read(), sets)


def masked(docs: DataFrame, ledger: DataFrame | None = None, sets: tuple[RuleSet, ...] = (BASE, MORE)) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets (overlapping spans by the first's); ``n_chars`` follows."""
    found = scan(docs, ledger, sets)[0].where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    spans = found.select("blob", F.explode("spans").alias("s")).select("blob", "s.*")
    before = Window.partitionBy("blob").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    clear = F.when(F.col("start") >= F.col("from"), F.struct("start", "from", "kind"))
    cuts = spans.groupBy(F.col("blob").alias("found")).agg(F.array_sort(F.collect_list(clear)).alias("cuts"), F.max("end").alias("rest"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # whatever names they have, columns can't clash
    rows = rows.withColumn("blob", F.sha2("row.text", 256)).join(cuts.hint("merge"), F.col("blob") == F.col("found"), "left")
    names, text = F.array(*[F.lit(f"<{r.kind}>") for r in ALL_RULES]), F.col("row.text")

    def part(chunks, a, b):
        """Code points a to b, from the chunks they lie in, so that no cut walks the text from its start."""
        inside = lambda k: F.greatest(a - k * CHUNK, F.lit(0))
        piece = lambda k: F.substring(F.get(chunks, k.cast("int")), (inside(k) + 1).cast("int"), (F.least(b - k * CHUNK, F.lit(CHUNK)) - inside(k)).cast("int"))
        return F.when(a < b, F.array_join(F.transform(F.sequence(F.floor(a / CHUNK), F.floor((b - 1) / CHUNK)), piece), "")).otherwise("")

    def cleaned(chunks):
        cut = F.transform("cuts", lambda c: F.concat(part(chunks, c["from"], c["start"]), F.get(names, c["kind"])))
        return F.concat(F.array_join(cut, ""), part(chunks, F.col("rest"), F.length(text).cast("long")))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    clean = F.get(F.transform(F.array(chunks), cleaned), F.lit(0))  # as a lambda's argument the chunks are cut once
    rows = rows.withColumn("clean", F.when(F.col("cuts").isNull(), text).otherwise(clean))
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("cuts").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType))
        row = row.withField("n_chars", n)
    return rows.select(row.alias("row")).select("row.*")


def op1_secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document.

    Two scans over one stored ledger: the base rules first; then, with the further rules in force too, only the pairs of blobs
    and rule versions that the ledger doesn't hold.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, (BASE,))
    paths = ledger.scan(docs, (BASE, MORE))
    names = F.array(*[F.lit(r.kind) for r in ALL_RULES])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] < len(RULES))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(RULES)]
    return paths.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql(rule: Rule) -> str:
    p, k = rule.pattern.replace("'", "''"), rule.kind
    return f"regexp_extract_all(x, '{p}', 0) AS m_{k}, regexp_extract_all(x, '{p}', {rule.group}) AS g_{k}, string_split_regex(x, '{p}') AS p_{k}"


def _sql_spans(rule: Rule, kind: int) -> str:
    k = rule.kind
    before = f"(list_sum(list_transform(p_{k}[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m_{k}[1:i - 1], lambda s: length(s))), 0))::BIGINT"
    return (
        f"list_transform(list_filter(range(1, len(m_{k}) + 1), lambda i: length(g_{k}[i]) >= {rule.least}), "
        f"lambda i: {{'start': {before}, 'kind': {kind}, 'name': '{k}', 'end': {before} + length(m_{k}[i])}})"
    )


def _joined_sql(rules: tuple[Rule, ...]) -> str:
    lists = ", ".join(f"s_{r.kind}" for r in rules)
    return f"""coalesce(array_to_string(list_transform(list_sort(list_concat({lists})), lambda s: s.name || ':' || s.start || ':' || s."end"), ','), '')"""


OP1_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS (SELECT doc_id, {", ".join(_sql(r) for r in ALL_RULES)} FROM t),
s AS (SELECT doc_id, {", ".join(f"{_sql_spans(r, i)} AS s_{r.kind}" for i, r in enumerate(ALL_RULES))} FROM m),
j AS (SELECT *, {_joined_sql(RULES)} AS base, {_joined_sql(ALL_RULES)} AS spans FROM s)
SELECT doc_id, {", ".join(f"len(s_{r.kind})::BIGINT AS n_{r.kind}" for r in RULES)}, sha256(base) AS base_sha256, spans FROM j
"""
