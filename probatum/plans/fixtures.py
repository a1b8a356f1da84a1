"""Bibliographic, evaluation and signal tables derived from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probatum.sources.shipping import ship

#: Parts stand for works; the rest of the key modulo small primes decides who knows a work, and how.
WORKS = """
SELECT p_partkey AS work, concat('10.5555/', p_partkey) AS doi, concat('Trials of ', p_name, ' by ', p_brand, ' ', p_partkey) AS title,
  CAST(1980 + p_size AS INT) AS year, concat('Author', p_partkey % 50) AS family, p_partkey % 10 AS slot
FROM {part}
"""
_KNOWN = {"crossref": "slot <= 5", "openalex": "slot BETWEEN 3 AND 7", "datacite": "slot IN (7, 8)"}
_SIGNAL = {"crossref": "CASE WHEN work % 19 = 5 THEN 'retraction' END", "openalex": "CASE WHEN work % 23 = 6 THEN 'retraction (OpenAlex is_retracted)' END", "datacite": "CAST(NULL AS VARCHAR(40))"}
RECORDS = " UNION ALL ".join(
    f"SELECT '{p}' AS provider, doi, CASE WHEN work % 17 = {i} THEN 'error' ELSE 'ok' END AS outcome, title, year, family, {_SIGNAL[p]} AS retraction FROM ({WORKS}) w WHERE {_KNOWN[p]}"
    for i, p in enumerate(_KNOWN)
)
REFS = """
SELECT l_orderkey * 10 + l_linenumber AS ref_id, l_partkey AS work,
  CASE WHEN l_linenumber = 6 THEN '' ELSE concat(
    CASE l_linenumber WHEN 1 THEN 'https://doi.org/' WHEN 2 THEN ' doi: ' WHEN 4 THEN 'HTTP://dx.doi.org/' ELSE '' END, '10.5555/',
    CASE WHEN l_orderkey % 11 = 0 THEN l_partkey + 10000000 ELSE l_partkey END) END AS doi,
  CASE WHEN l_orderkey % 5 = 1 AND l_linenumber <> 6 THEN '' WHEN l_orderkey % 13 = 2 THEN '####'
    WHEN l_orderkey % 13 IN (4, 6) AND l_linenumber <> 6 THEN substring(concat('Trials of ', p_name, ' by ', p_brand, ' ', p_partkey), 1,
      CAST(floor(length(concat('Trials of ', p_name, ' by ', p_brand, ' ', p_partkey)) * CASE WHEN l_orderkey % 13 = 4 THEN 70 ELSE 40 END / 100) AS INT))
    ELSE concat('Trials of ', p_name, ' by ', p_brand, ' ', p_partkey) END AS title,
  CAST(CASE WHEN l_orderkey % 7 = 3 THEN 1981 + p_size WHEN l_orderkey % 7 = 5 THEN NULL ELSE 1980 + p_size END AS INT) AS year,
  CASE WHEN l_orderkey % 9 = 4 THEN 'Somebody, Else' WHEN l_orderkey % 9 = 5 THEN '' ELSE concat('Given ', 'Author', p_partkey % 50) END AS author,
  CASE WHEN l_orderkey % 4 = 1 THEN concat('https://example.org/', l_orderkey % 8) ELSE '' END AS url
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) li JOIN {part} ON p_partkey = l_partkey
"""
#: What a provider's title search returns for references without a DOI: a bad first result, then a better one, then that again from another year.
SEARCH = """
SELECT r.ref_id, k.n AS rank, substring(w.title, 1, CAST(floor(length(w.title) * CASE WHEN k.n = 1 THEN 55 WHEN w.work % 3 = 0 THEN 100 WHEN w.work % 3 = 1 THEN 90 ELSE 70 END / 100) AS INT)) AS title,
  CAST(w.year + CASE WHEN k.n = 3 THEN 7 ELSE 0 END AS INT) AS year, w.family, CASE WHEN w.work % 19 = 5 THEN 'retraction' END AS retraction
FROM ({refs}) r JOIN ({works}) w ON w.work = r.work CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) k
WHERE r.doi = '' AND r.title NOT IN ('', '####') AND w.slot <= 5 AND w.work % 17 <> 0
"""
#: Files with the results of one evaluation each; some lack what an arm needs.
RESULTS = """
SELECT concat('results-', lang, '-', k) AS path, lang, k, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS fn,
  min(d.doc_id) AS low, max(d.doc_id) AS high FROM (SELECT *, doc_id % 6 AS k FROM {documents}) d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY lang, k
"""
PROBES = """
SELECT concat('https://example.org/', k) AS url, CAST(CASE WHEN k = 1 THEN 200 WHEN k = 5 THEN 404 END AS INT) AS http_status, k = 5 AND k % 2 = 0 AS archived
FROM (SELECT DISTINCT l_orderkey % 8 AS k FROM {lineitem}) x
"""
FINDINGS = "SELECT l_orderkey * 10 + l_linenumber AS ref_key FROM {lineitem} WHERE l_orderkey % 6 = 0"
SPLITS = """
SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 THEN 'valid' ELSE 'train' END AS split, concat(source, '/', doc_id) AS item FROM {documents}
UNION ALL SELECT 'test2' AS split, concat(source, '/', doc_id) AS item FROM {documents} WHERE doc_id % 5 = 0 AND doc_id % 100 <> 0
"""
SCORED = """
SELECT lang AS run, round(least(1.0, CAST(n_chars AS DOUBLE) / 4000), 4) AS score, CAST(quality AS INT) AS truth, source, d.doc_id
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""
ARMS = """
SELECT lang AS task, concat('arm', doc_id % 4, '-', lang) AS name, CASE WHEN doc_id % 4 = 3 THEN 'other' ELSE lang END AS split_id,
  CAST(CASE WHEN doc_id % 4 = 2 THEN 99 ELSE 100 END AS INT) AS n_units, CASE WHEN doc_id % 4 = 1 THEN '[["iou","0.3"]]' ELSE '[["iou","0.5"]]' END AS criterion,
  CASE WHEN doc_id % 4 = 0 THEN 'asserted by hand' ELSE 'file' END AS provenance
FROM (SELECT DISTINCT lang, doc_id % 4 AS doc_id FROM {documents}) x
UNION ALL SELECT DISTINCT lang, concat('arm9-', lang), lang, CAST(100 AS INT), '[["iou","0.5"]]', 'reconstructed from notes' FROM {documents}
"""
METRICS = "SELECT name, 'test' AS role, 'f1' AS metric, CAST(length(name) % 7 + ascii(substring(name, 4, 1)) AS DOUBLE) / 100 AS value FROM ({arms}) a"
#: Events stand for a recording: kinds are channels, clicks trigger, time in seconds.
SAMPLES = "SELECT 'events' AS recording, event_type AS channel, CAST(event_id AS DOUBLE) AS t, value AS amp FROM {events}"
TRIGGERS = "SELECT 'events' AS recording, CAST(event_id AS DOUBLE) AS t, CAST(user_id % 3 AS INT) AS code FROM {events} WHERE event_id % 20 = 7"
LOCATIONS = """
SELECT 'openalex' AS provider, doi, CASE WHEN work % 17 = 1 THEN 'error' ELSE 'ok' END AS outcome, work % 3 = 0 AS is_oa, CASE WHEN work % 3 = 0 THEN 'gold' ELSE '' END AS oa_status,
  CASE WHEN work % 6 = 0 THEN concat('https://example.org/pdf/', work) ELSE '' END AS pdf_url, CASE WHEN work % 3 = 0 AND work % 5 <> 0 THEN concat('https://example.org/page/', work) ELSE '' END AS landing_url
FROM ({works}) w WHERE slot < 8
UNION ALL SELECT 'unpaywall', doi, CASE WHEN work % 13 = 1 THEN 'error' ELSE 'ok' END, work % 4 = 1, 'green', concat('https://example.org/un/', work), '' FROM ({works}) w WHERE slot BETWEEN 2 AND 9
"""
SQL = {
    "works": WORKS, "records": RECORDS, "refs": REFS, "search": SEARCH.replace("{refs}", REFS).replace("{works}", WORKS), "results": RESULTS, "probes": PROBES, "findings": FINDINGS, "splits": SPLITS, "scored": SCORED, "arms": ARMS,
    "metrics": METRICS.replace("{arms}", ARMS), "samples": SAMPLES, "triggers": TRIGGERS, "locations": LOCATIONS.replace("{works}", WORKS),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in SQL[name]}
    if "part" in used:  # works grow with the tables: in a join they are sorted, not broadcast through the driver
        used["part"] = used["part"].hint("merge")
    return spark.sql(SQL[name], **used)


def duck(name: str) -> str:
    """The derivation for DuckDB, where the driver's tables are views."""
    out = SQL[name]
    for t in TABLES:
        out = out.replace(f"{{{t}}}", t)
    return f"({out})"
