"""Where an open-access copy is, through a cascade of provider tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions import text


def located(refs: DataFrame, locations: DataFrame, email: bool = True, resolver: DataFrame | None = None) -> DataFrame:
    """``ref_id, doi, is_oa, oa_status, best_url, source, consulted, message`` per reference ``(ref_id, doi)``.

    ``locations (provider, doi, outcome, is_oa, oa_status, pdf_url, landing_url)``, providers ``openalex`` and ``unpaywall`` (the latter only
    with ``email``); ``resolver (doi, url)`` is asked last and never makes a copy open. A clean miss counts as consulted, an error does not.
    """
    rows = refs.select("ref_id", text.doi(F.col("doi")).alias("doi"))
    for p in ("openalex", "unpaywall"):
        one = locations.where(F.col("provider") == p).select(F.col("doi").alias("_d"), F.struct("outcome", "is_oa", "oa_status", "pdf_url", "landing_url").alias(p))
        rows = rows.join(one, (F.col("doi") == F.col("_d")) & (F.col("doi") != ""), "left").drop("_d")
    resolver = resolver if resolver is not None else refs.sparkSession.createDataFrame([], "doi string, url string")
    rows = rows.join(resolver.select(F.col("doi").alias("_d"), F.nullif("url", F.lit("")).alias("external")), F.col("doi") == F.col("_d"), "left").drop("_d")

    def field(p, name):
        return F.when(F.col(f"{p}.outcome") == "ok", F.col(f"{p}.{name}"))

    empty = F.lit("")
    url = {p: F.coalesce(F.nullif(field(p, "pdf_url"), empty), F.nullif(field(p, "landing_url"), empty)) for p in ("openalex", "unpaywall")}
    asked = F.col("doi") != ""
    use_mail = F.lit(email)
    by_oa = F.coalesce(field("openalex", "is_oa"), F.lit(False)) & url["openalex"].isNotNull()
    by_un = use_mail & F.coalesce(field("unpaywall", "is_oa"), F.lit(False)) & url["unpaywall"].isNotNull()
    preprint = text.arxiv_pdf(F.col("doi"))
    source = F.when(~asked, "").when(by_oa, "openalex").when(by_un, "unpaywall").when(preprint != "", "arxiv").when(F.col("external").isNotNull(), "external-resolver").otherwise("")
    failed_oa = F.coalesce(F.col("openalex.outcome") == "error", F.lit(False))
    failed_un = use_mail & F.coalesce(F.col("unpaywall.outcome") == "error", F.lit(False))
    rows = rows.withColumns({"source": source, "failed": failed_oa | (~by_oa & failed_un)})
    src = F.col("source")
    flagged = F.coalesce(field("openalex", "is_oa"), F.lit(False))
    is_oa = F.when(~asked, False).when(src.isin("openalex", "unpaywall", "arxiv"), True).otherwise(flagged)
    known = F.coalesce(F.nullif(field("openalex", "oa_status"), empty), F.when(F.col("openalex.outcome") == "ok", F.lit("closed")), empty)
    status = (
        F.when(~asked, "").when(src == "openalex", F.coalesce(field("openalex", "oa_status"), empty)).when(src == "unpaywall", F.coalesce(field("unpaywall", "oa_status"), empty))
        .when(src == "arxiv", "green").when(F.col("failed") & ~flagged, "unknown").otherwise(known)
    )
    best = F.when(src == "openalex", url["openalex"]).when(src == "unpaywall", url["unpaywall"]).when(src == "arxiv", preprint).when(src == "external-resolver", F.col("external")).otherwise(empty)
    consulted = F.array_compact(F.array(F.when(asked & ~failed_oa, "openalex"), F.when(asked & ~by_oa & use_mail & ~failed_un, "unpaywall")))
    rows = rows.withColumns({"is_oa": is_oa, "oa_status": status, "best_url": best, "consulted": F.array_join(consulted, ",")})
    message = F.when(F.col("is_oa"), "oa").when(src == "external-resolver", "external").when(F.col("failed"), "incomplete").otherwise("none")
    return rows.select("ref_id", "doi", "is_oa", "oa_status", "best_url", "source", "consulted", message.alias("message"))
