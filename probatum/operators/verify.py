"""Four-axis verification of references against provider tables.

A provider lookup has three outcomes, ``ok``, ``absent`` and ``error``; a missing row is ``absent``. No axis turns a lookup that was
not made, or failed, into agreement: such an axis is ``unknown`` and leaves the score's numerator and denominator alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions import text

#: Thresholds, weights, qualities, caps.
TITLE_MATCH, TITLE_DISTINCT, VERIFIED, UNREACHED_URL_CAP = 0.85, 0.60, 0.8, 0.95
WEIGHTS = {"existence": 0.5, "metadata": 0.3, "retraction": 0.1, "url": 0.1}
QUALITY = {"pass": 1.0, "warn": 0.6, "fail": 0.0}
CAPS = {"retracted": 0.1, "not_found": 0.1, "unverifiable": 0.4, "warnings": 0.79}
PROVIDERS, CANDIDATES = ("crossref", "openalex", "datacite"), 5
#: What grows with the bibliography is never sent to the driver, which a broadcast would do.
SORTED = "merge"
CONFIDENCE = {"crossref": 0.95, "openalex": 0.9, "datacite": 0.9}
RETRACTION_SOURCES = ("crossref", "openalex")


def score(statuses: dict[str, Column]) -> Column:
    """The weighted mean quality of the axes that are not unknown, to three places; 0 if all are."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for axis, status in statuses.items():
        made = status.isin(*QUALITY)
        quality = F.lit(0.0)
        for name, q in QUALITY.items():
            quality = F.when(status == name, F.lit(q)).otherwise(quality)
        total = total + F.when(made, quality * WEIGHTS[axis]).otherwise(0.0)
        weight = weight + F.when(made, F.lit(WEIGHTS[axis])).otherwise(0.0)
    return F.round(F.when(weight > 0, total / weight).otherwise(0.0), 3)


def verdict(statuses: dict[str, Column], mean: Column) -> Column:
    e, m, r, u = (statuses[a] for a in WEIGHTS)
    doubtful = m.isin("warn", "fail") | r.isin("warn", "fail") | u.isin("warn", "fail")
    return (
        F.when(r == "fail", "retracted").when(e == "fail", "not_found").when((e == "unknown") | (m == "unknown"), "unverifiable")
        .when(doubtful | (r == "unknown"), "warnings").when(mean >= VERIFIED, "verified").otherwise("warnings")
    )


def capped(mean: Column, decided: Column, url_cited: Column, url_status: Column) -> Column:
    out = mean
    for name, cap in CAPS.items():
        out = F.when(decided == name, F.least(mean, F.lit(cap))).otherwise(out)
    return F.when(url_cited & (url_status == "unknown"), F.least(out, F.lit(UNREACHED_URL_CAP))).otherwise(out)


def judged(rows: DataFrame, url_cited: Column) -> DataFrame:
    """Adds ``score`` and ``verdict`` to rows with ``existence, metadata, retraction, url`` statuses."""
    statuses = {a: F.col(a) for a in WEIGHTS}
    rows = rows.withColumn("mean", score(statuses)).withColumn("verdict", verdict(statuses, F.col("mean")))
    return rows.withColumn("score", capped(F.col("mean"), F.col("verdict"), url_cited, F.col("url"))).drop("mean")


def best_candidates(refs: DataFrame, search: DataFrame) -> DataFrame:
    """The most similar of the first ``CANDIDATES`` search results of each reference; of equal similarities the first.

    ``refs (ref_id, title)``; ``search (ref_id, rank, title, year, authors, retraction)``, ranks from 1.
    """
    cited = text.with_plain(refs.select("ref_id", "title"), "title", "cited").where("cited <> ''").select("ref_id", "cited")
    found = text.with_plain(search.where(F.col("rank") <= CANDIDATES), "title", "known")
    rows = text.with_ratio(found.join(cited.hint(SORTED), "ref_id"), "cited", "known", "similarity")
    best = F.max_by(F.struct("similarity", "title", "year", "authors", "retraction"), F.struct("similarity", -F.col("rank"))).alias("b")
    return rows.groupBy("ref_id").agg(best).select("ref_id", "b.*")


_FIELDS = ("title", "plain", "year", "authors", "retraction")


def _known(records: DataFrame) -> DataFrame:
    """``_doi`` and a column per provider with its outcome and record.

    Of several records of one provider and DOI one counts: an answer before an error, then the greatest by its fields.
    """
    records = text.with_plain(records.where("doi <> ''"), "title", "plain")
    one = [F.max(F.when(F.col("provider") == p, F.struct("outcome", *_FIELDS))).alias(f"_{p}") for p in PROVIDERS]
    return records.groupBy(F.col("doi").alias("_doi")).agg(*one)


def _answered(rows: DataFrame) -> DataFrame:
    """Each provider's outcome and record of rows that are joined to ``_known``."""
    for p in PROVIDERS:
        rows = rows.withColumn(f"{p}_outcome", F.when(F.col("doi") != "", F.coalesce(F.col(f"_{p}.outcome"), F.lit("absent"))))
        rows = rows.withColumn(p, F.when(F.col(f"_{p}").isNotNull(), F.struct(*[F.col(f"_{p}.{f}").alias(f) for f in _FIELDS]))).drop(f"_{p}")
    return rows


def looked_up(refs: DataFrame, records: DataFrame) -> DataFrame:
    """``refs (doi, ...)`` with each provider's outcome and record: one table with a column per provider, one equi-join."""
    return _answered(refs.join(_known(records).hint(SORTED), F.col("doi") == F.col("_doi"), "left").drop("_doi"))


def _first_hit() -> Column:
    """The provider that answers first in the cascade; ``error`` if one before it fails, null if all are absent."""
    out = F.lit(None).cast("string")
    for p in reversed(PROVIDERS):
        o = F.col(f"{p}_outcome")
        out = F.when(o == "ok", F.lit(p)).when(o == "error", F.lit("error")).otherwise(out)
    return out


def verified(refs: DataFrame, records: DataFrame, probes: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row per reference with four axis statuses and confidences, ``score`` and ``verdict``.

    ``refs (ref_id, doi, title, year, authors, url)``; ``records (provider, doi, outcome, title, year, authors, retraction)``;
    ``probes (url, http_status, archived)``; ``candidates (ref_id, similarity, title, year, authors, retraction)``, the best title match of
    references without a DOI. A lookup that fails makes the verdict ``error``.
    """
    rows = refs.withColumn("doi", text.doi(F.col("doi"))).withColumns({"title": F.trim(F.coalesce("title", F.lit(""))), "url_cited": F.coalesce("url", F.lit("")) != ""})
    rows = text.with_plain(rows, "title", "plain")
    if candidates is not None:
        # a reference has a DOI or else a candidate, so both meet it in one join, and its row is shuffled once
        found = text.with_plain(candidates, "title", "plain").select(F.concat(F.lit("title "), F.col("ref_id").cast("string")).alias("_key"), "similarity", F.struct(*_FIELDS).alias("found"))
        known = _known(records).withColumn("_key", F.concat(F.lit("doi "), "_doi")).drop("_doi").unionByName(found, allowMissingColumns=True)
        key = F.when(F.col("doi") != "", F.concat(F.lit("doi "), "doi")).otherwise(F.concat(F.lit("title "), F.col("ref_id").cast("string")))
        rows = _answered(rows.withColumn("_cited", key).join(known.hint(SORTED), F.col("_cited") == F.col("_key"), "left").drop("_cited", "_key"))
    else:
        kind = "struct<title:string,plain:string,year:int,authors:array<string>,retraction:string>"
        rows = looked_up(rows, records).withColumns({"similarity": F.lit(None).cast("double"), "found": F.lit(None).cast(kind)})
    rows = rows.withColumn("hit", _first_hit())
    has_doi, has_title = F.col("doi") != "", F.col("title") != ""
    sim = F.col("similarity")
    by_doi = F.when(F.col("hit") == "error", "error").when(F.col("hit").isNull(), "fail").otherwise("pass")
    by_title = F.when(sim >= TITLE_MATCH, "pass").otherwise("unknown")
    confidence = F.lit(0.9)
    for p in PROVIDERS:
        confidence = F.when(F.col("hit") == p, F.lit(CONFIDENCE[p])).otherwise(confidence)
    rows = rows.withColumns({
        "existence": F.when(has_doi, by_doi).when(has_title, by_title).otherwise("unknown"),
        "existence_confidence": F.when(has_doi, confidence).when(~has_title, 0.0).when(sim.isNull(), 0.3).when(sim >= TITLE_MATCH, sim).otherwise(0.4),
    })
    record = F.when(~has_doi & (sim >= TITLE_MATCH), F.col("found"))
    for p in PROVIDERS:
        record = F.when(has_doi & (F.col("hit") == p), F.col(p)).otherwise(record)
    rows = with_metadata(rows.withColumn("record", record))
    rows = with_retraction(rows, has_doi)
    rows = with_url(rows, probes)
    rows = judged(rows, F.col("url_cited"))
    failed = F.col("existence") == "error"
    rows = rows.withColumns({"verdict": F.when(failed, "error").otherwise(F.col("verdict")), "score": F.when(~failed, F.col("score"))})
    return rows.select("ref_id", "doi", "existence", "metadata", "retraction", "url", "existence_confidence", "metadata_confidence", "score", "verdict")


def with_metadata(rows: DataFrame) -> DataFrame:
    """Adds the metadata axis. A title under the distinct threshold ends the comparison; null and 0 years are missing."""
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "_plain": F.when((F.col("title") != "") & (F.trim(F.coalesce("record.title", F.lit(""))) != ""), F.col("plain")),
        "_known": F.col("record.plain"), "_names": F.coalesce("authors", none), "_held": F.coalesce("record.authors", none),
    })
    rows = text.with_overlap(text.with_ratio(rows, "_plain", "_known", "sim"), "_names", "_held", "_overlap")
    sim = F.col("sim")
    year, known_year = F.nullif(F.col("year"), F.lit(0)), F.nullif(F.col("record.year"), F.lit(0))
    both_names = (F.size("_names") > 0) & (F.size("_held") > 0)
    warned = F.coalesce(sim < TITLE_MATCH, F.lit(False)) | F.coalesce(year != known_year, F.lit(False)) | (both_names & (F.col("_overlap") < 0.5))
    distinct = sim < TITLE_DISTINCT
    status = F.when(F.col("record").isNull(), "unknown").when(distinct, "fail").when(sim.isNull() & ~both_names, "unknown").when(warned, "warn").otherwise("pass")
    rows = rows.withColumn("metadata", status).drop("_plain", "_known", "_names", "_held", "_overlap")
    sure = F.when(F.col("metadata") == "unknown", 0.0).when(F.col("metadata") == "fail", 1 - sim).when(F.col("metadata") == "warn", 0.6)
    return rows.withColumn("metadata_confidence", sure.otherwise(F.greatest(F.coalesce(sim, F.lit(0.8)), F.lit(0.8))))


def with_retraction(rows: DataFrame, has_doi: Column) -> DataFrame:
    """Adds the retraction axis: every capable provider is consulted, and any signal fails it."""
    consulted, signal = F.lit(0), F.lit(None).cast("string")
    for p in RETRACTION_SOURCES:
        consulted = consulted + F.when(F.col(f"{p}_outcome") == "ok", 1).otherwise(0)
        signal = F.coalesce(signal, F.when(F.col(f"{p}_outcome") == "ok", F.nullif(F.col(f"{p}.retraction"), F.lit(""))))
    by_title = ~has_doi & F.col("record").isNotNull()
    consulted = F.when(by_title, 1).otherwise(consulted)
    signal = F.when(by_title, F.nullif(F.col("record.retraction"), F.lit(""))).otherwise(signal)
    return rows.withColumns({"consulted": consulted, "signal": signal}).withColumn(
        "retraction", F.when(F.col("signal").isNotNull(), "fail").when(F.col("consulted") == 0, "unknown").otherwise("pass")
    )


def url_status(http_status: Column, archived: Column) -> Column:
    return F.when(http_status.isNull(), "unknown").when(http_status.between(200, 399), "pass").when(archived, "warn").otherwise("fail")


def url_confidence(http_status: Column, archived: Column) -> Column:
    return F.when(http_status.isNull(), 0.2).when(http_status.between(200, 399), 0.9).when(archived, 0.6).otherwise(0.8)


def with_url(rows: DataFrame, probes: DataFrame) -> DataFrame:
    found = probes.select(F.col("url").alias("_url"), "http_status", F.coalesce("archived", F.lit(False)).alias("archived"))
    rows = rows.withColumnRenamed("url", "cited_url").join(found, F.col("cited_url") == F.col("_url"), "left")
    return rows.withColumn("url", F.when(~F.col("url_cited"), "unknown").otherwise(url_status(F.col("http_status"), F.coalesce("archived", F.lit(False)))))


def needs_attention(rows: DataFrame) -> Column:
    return F.col("verdict").isin("not_found", "retracted") | (F.col("metadata") == "fail")


def flag_reason() -> Column:
    return F.when(F.col("verdict").isin("error", "not_found", "retracted"), F.col("verdict")).when(F.col("metadata") == "fail", "metadata_mismatch")


def finding_verdict(name: Column) -> Column:
    """A verification verdict in a study's vocabulary."""
    return F.when(name == "verified", "supported").when(name.isin("warnings", "unverifiable"), "inconclusive").when(name.isin("not_found", "retracted"), "refuted").otherwise("inconclusive")
