"""Tallies, envelopes and exit status."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probatum.operators.verify import finding_verdict, flag_reason, needs_attention


def tally(rows: DataFrame, by: str = "verdict") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: ``total, verified, errors, attention, exit_code`` of a verified bibliography."""
    bad = F.coalesce(needs_attention(rows), F.lit(False))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("verdict") != "error").alias("verified"), F.count_if(F.col("verdict") == "error").alias("errors"),
        F.count_if(bad).alias("attention"), F.when(F.coalesce(F.bool_or(bad), F.lit(False)), 1).otherwise(0).alias("exit_code"),
    )


def attention(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", flag_reason()).where(F.col("reason").isNotNull())


def rolled_up(findings: DataFrame) -> DataFrame:
    """``total, supported, refuted, inconclusive, by_verdict`` of verification verdicts in a study's vocabulary."""
    v = finding_verdict(F.col("verdict"))
    counts = findings.groupBy("verdict").agg(F.count("*").alias("n")).withColumn("kind", v)
    total = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("supported", "refuted", "inconclusive")]
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *total, F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("by_verdict"))


def json_report(rows: DataFrame, most: int | None = None) -> str:
    """A bibliography's report as one strict JSON object: ``count, verified, errors, summary, needs_attention, results``.

    The driver holds what it prints: ``most`` bounds the lists for a bibliography that is no report of its own, and their whole lengths are told.
    """
    one = summary(rows).first()
    by = {r["verdict"]: r["n"] for r in tally(rows.where("verdict <> 'error'")).collect()}
    take = (lambda df: df.limit(most)) if most is not None else (lambda df: df)
    flagged = [r.asDict() for r in take(attention(rows).select("ref_id", "verdict", "reason").orderBy("ref_id")).collect()]
    results = [json.loads(r["json"]) for r in take(envelopes(rows.orderBy("ref_id"))).collect()]
    whole = {"count": one["total"], "verified": one["verified"], "errors": one["errors"], "summary": by, "attention": one["attention"], "needs_attention": flagged, "results": results}
    return json.dumps(whole, allow_nan=False)


#: Exit codes of a command.
CLEAN, ATTENTION, USAGE = 0, 1, 2


def exit_code(rows: DataFrame | None) -> int:
    """0 for a clean bibliography, 1 if one reference needs attention, 2 if there was nothing to verify."""
    if rows is None:
        return USAGE
    return summary(rows).first()["exit_code"]


def label(title: Column, doi: Column, raw: Column) -> Column:
    """What a report calls a reference: its title, its DOI, or how it begins."""
    return F.coalesce(*[F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in (title, doi, F.substring(raw, 1, 50))], F.lit("(no id)"))


#: Providers as reports name them.
SOURCES = {"crossref": "Crossref", "openalex": "OpenAlex", "datacite": "DataCite", "unpaywall": "Unpaywall", "arxiv": "arXiv"}


def source_label(provider: Column) -> Column:
    out = provider
    for name, shown in SOURCES.items():
        out = F.when(provider == name, F.lit(shown)).otherwise(out)
    return out


def finite(column: Column, kind: T.DataType) -> Column:
    """A value as strict JSON can hold it: non-finite numbers become null, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (F.abs(column) != math.inf), column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: finite(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[finite(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return column


def envelopes(rows: DataFrame) -> DataFrame:
    """One strict JSON object per row, with ``success`` added."""
    clean = [finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(F.lit(True).alias("success"), *clean), {"ignoreNullFields": "false"}).alias("json"))


#: Marks of a text report.
MARKS = {"verified": "ok", "warnings": "warn", "unverifiable": "?", "not_found": "missing", "retracted": "retracted", "error": "error"}


def text_lines(rows: DataFrame) -> DataFrame:
    """``ref_id, line`` of a text report; ``rows (ref_id, label, verdict, score)``."""
    mark = F.lit("?")
    for k, v in MARKS.items():
        mark = F.when(F.col("verdict") == k, F.lit(v)).otherwise(mark)
    return rows.select("ref_id", F.format_string("[%s] %s (%s)", mark, F.col("label"), F.coalesce(F.format_number("score", 2), F.lit("-"))).alias("line"))


def text_report(rows: DataFrame) -> list[str]:
    """A text report: a line per reference, the tally, and what needs attention; ``rows (ref_id, label, verdict, score, metadata)``."""
    lines = [r["line"] for r in text_lines(rows).orderBy("ref_id").collect()]
    counts = ", ".join(f"{r['verdict']}={r['n']}" for r in tally(rows).orderBy("verdict").collect())
    flagged = [f"  {r['label']}: {r['reason']}" for r in attention(rows).orderBy("ref_id").collect()]
    return [*lines, "", f"{len(lines)} references: {counts}", *(["Needs attention:", *flagged] if flagged else [])]
