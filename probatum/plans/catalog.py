"""Every query over the driver's tables, with the SQL it is held against.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``SQL`` has the same result for DuckDB where SQL can express it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.functions import detectors, text
from probatum.operators import compare, filters, fulltext, registry, report, scan, signal, study, titles, verify
from probatum.plans.fixtures import derived, duck, table
from probatum.sources import bibtex, catalog
from probatum.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- verification

def _records(spark, d):
    return derived(spark, d, "records").withColumn("authors", F.array("family"))


def _refs(spark, d):
    return derived(spark, d, "refs").withColumn("authors", F.when(F.col("author") != "", F.array("author")).otherwise(F.array().cast("array<string>")))


def _verified(spark, d):
    refs = _refs(spark, d)
    search = derived(spark, d, "search").withColumn("authors", F.array("family"))
    without = refs.where(text.doi(F.col("doi")) == "")
    return verify.verified(refs, _records(spark, d), derived(spark, d, "probes"), verify.best_candidates(without, search))


_PLAIN = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_DOI = r"trim(regexp_replace(trim(regexp_replace(trim(coalesce(doi, '')), '(?i)^https?://(dx\.)?doi\.org/', '')), '(?i)^doi:\s*', ''))"
_JUDGE = """
j AS (SELECT *,
  (CASE existence WHEN 'pass' THEN 0.5::DOUBLE WHEN 'warn' THEN 0.6::DOUBLE * 0.5::DOUBLE ELSE 0 END) + (CASE metadata WHEN 'pass' THEN 0.3::DOUBLE WHEN 'warn' THEN 0.6::DOUBLE * 0.3::DOUBLE ELSE 0 END)
  + (CASE retraction WHEN 'pass' THEN 0.1::DOUBLE WHEN 'warn' THEN 0.6::DOUBLE * 0.1::DOUBLE ELSE 0 END) + (CASE url WHEN 'pass' THEN 0.1::DOUBLE WHEN 'warn' THEN 0.6::DOUBLE * 0.1::DOUBLE ELSE 0 END) AS s,
  (CASE WHEN existence <> 'unknown' THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN metadata <> 'unknown' THEN 0.3::DOUBLE ELSE 0 END)
  + (CASE WHEN retraction <> 'unknown' THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN url <> 'unknown' THEN 0.1::DOUBLE ELSE 0 END) AS w FROM a),
k AS (SELECT *, round(CASE WHEN w > 0 THEN s / w ELSE 0 END, 3) AS mean FROM j),
l AS (SELECT *, CASE WHEN existence = 'error' THEN 'error' WHEN retraction = 'fail' THEN 'retracted' WHEN existence = 'fail' THEN 'not_found' WHEN existence = 'unknown' OR metadata = 'unknown' THEN 'unverifiable'
  WHEN metadata IN ('warn', 'fail') OR retraction IN ('warn', 'fail') OR url IN ('warn', 'fail') OR retraction = 'unknown' THEN 'warnings' WHEN mean >= 0.8 THEN 'verified' ELSE 'warnings' END AS verdict FROM k),
m AS (SELECT *, CASE verdict WHEN 'error' THEN NULL WHEN 'retracted' THEN least(mean, 0.1) WHEN 'not_found' THEN least(mean, 0.1) WHEN 'unverifiable' THEN least(mean, 0.4) WHEN 'warnings' THEN least(mean, 0.79) ELSE mean END AS capped FROM l),
v AS (SELECT *, CASE WHEN url_cited AND url = 'unknown' THEN least(capped, 0.95) ELSE capped END::DOUBLE AS score FROM m)"""
_RATIO = "CASE WHEN {0} = '' OR {1} = '' THEN 0.0 ELSE 2.0::DOUBLE * least(length({0}), length({1})) / (length({0}) + length({1})) END"  # one is the beginning of the other
_BEST = f"""
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY similarity DESC, rank) AS k FROM (
  SELECT s.*, {_RATIO.format(_PLAIN.format("r.title"), _PLAIN.format("s.title"))}::DOUBLE AS similarity FROM {duck("search")} s JOIN {duck("refs")} r ON r.ref_id = s.ref_id) m) n WHERE k = 1)"""
_VERIFY = f"""
WITH rec AS (SELECT * FROM {duck("records")}),{_BEST},
c AS (SELECT * FROM rec WHERE provider = 'crossref'), o AS (SELECT * FROM rec WHERE provider = 'openalex'), d AS (SELECT * FROM rec WHERE provider = 'datacite'),
r AS (SELECT ref_id, {_DOI} AS doi, trim(title) AS title, year, author, url FROM {duck("refs")}),
x AS (SELECT r.*, c.outcome AS co, o.outcome AS oo, d.outcome AS dox, c.retraction AS cr, o.retraction AS orr,
  CASE WHEN r.doi = '' THEN NULL WHEN c.outcome = 'ok' THEN 'crossref' WHEN c.outcome = 'error' THEN 'error' WHEN o.outcome = 'ok' THEN 'openalex' WHEN o.outcome = 'error' THEN 'error'
    WHEN d.outcome = 'ok' THEN 'datacite' WHEN d.outcome = 'error' THEN 'error' END AS hit,
  coalesce(c.title, o.title, d.title, t.title) AS kt, coalesce(c.year, o.year, d.year, t.year) AS ky, coalesce(c.family, o.family, d.family, t.family) AS kf, t.title AS tt, t.retraction AS tr, b.similarity AS found
  FROM r LEFT JOIN c ON c.doi = r.doi LEFT JOIN o ON o.doi = r.doi LEFT JOIN d ON d.doi = r.doi
  LEFT JOIN best b ON b.ref_id = r.ref_id LEFT JOIN best t ON r.doi = '' AND t.ref_id = r.ref_id AND t.similarity >= 0.85),
y AS (SELECT *, CASE WHEN doi <> '' THEN CASE WHEN hit = 'error' THEN 'error' WHEN hit IS NULL THEN 'fail' ELSE 'pass' END WHEN title <> '' AND tt IS NOT NULL THEN 'pass' ELSE 'unknown' END AS existence,
  (hit IS NOT NULL AND hit <> 'error') OR tt IS NOT NULL AS has_record, {_RATIO.format(_PLAIN.format("title"), _PLAIN.format("kt"))}::DOUBLE AS sim FROM x),
a AS (SELECT y.ref_id, y.doi, y.existence, y.url <> '' AS url_cited,
  CASE WHEN doi <> '' THEN CASE hit WHEN 'crossref' THEN 0.95 ELSE 0.9 END WHEN title = '' THEN 0.0 WHEN found IS NULL THEN 0.3 WHEN tt IS NULL THEN 0.4 ELSE found END::DOUBLE AS existence_confidence,
  CASE WHEN NOT has_record THEN 'unknown' WHEN title <> '' AND sim < 0.6 THEN 'fail' WHEN title = '' AND author = '' THEN 'unknown'
    WHEN (title <> '' AND sim < 0.85) OR year <> ky OR (author <> '' AND lower(CASE WHEN author LIKE '%,%' THEN split_part(author, ',', 1) ELSE split_part(author, ' ', -1) END) <> lower(kf)) THEN 'warn' ELSE 'pass' END AS metadata,
  CASE WHEN doi <> '' THEN CASE WHEN (co = 'ok' AND cr IS NOT NULL) OR (oo = 'ok' AND orr IS NOT NULL) THEN 'fail' WHEN coalesce(co, '') <> 'ok' AND coalesce(oo, '') <> 'ok' THEN 'unknown' ELSE 'pass' END
    WHEN tt IS NOT NULL THEN CASE WHEN tr IS NOT NULL THEN 'fail' ELSE 'pass' END ELSE 'unknown' END AS retraction,
  CASE WHEN y.url = '' OR p.http_status IS NULL THEN 'unknown' WHEN p.http_status BETWEEN 200 AND 399 THEN 'pass' WHEN p.archived THEN 'warn' ELSE 'fail' END AS url
  FROM y LEFT JOIN {duck("probes")} p ON p.url = y.url),
{_JUDGE.strip()}
"""
_META_CONF = "CASE metadata WHEN 'unknown' THEN 0.0 WHEN 'fail' THEN 1 - sim WHEN 'warn' THEN 0.6 ELSE (CASE WHEN has_title THEN greatest(sim, 0.8) ELSE 0.8 END) END::DOUBLE"
_VERIFY = _VERIFY.replace("y.url <> '' AS url_cited,", "y.url <> '' AS url_cited, y.title <> '' AS has_title, y.sim,")


@query(_VERIFY + f"SELECT ref_id, doi, existence, metadata, retraction, url, existence_confidence, {_META_CONF} AS metadata_confidence, score, verdict FROM v")
def verify_verdicts(spark, d):
    return _verified(spark, d)


@query(_VERIFY + "SELECT verdict, count(*) AS n FROM v GROUP BY verdict")
def verify_tally(spark, d):
    return report.tally(_verified(spark, d))


@query(
    _VERIFY
    + "SELECT ref_id, verdict, CASE WHEN verdict IN ('error', 'not_found', 'retracted') THEN verdict ELSE 'metadata_mismatch' END AS reason FROM v WHERE verdict IN ('error', 'not_found', 'retracted') OR metadata = 'fail'"
)
def needs_attention(spark, d):
    return report.attention(_verified(spark, d)).select("ref_id", "verdict", "reason")


@query(
    _VERIFY
    + """SELECT count(*) AS total, count(*) FILTER (verdict <> 'error') AS verified, count(*) FILTER (verdict = 'error') AS errors,
  count(*) FILTER (verdict IN ('not_found', 'retracted') OR metadata = 'fail') AS attention, CASE WHEN count(*) FILTER (verdict IN ('not_found', 'retracted') OR metadata = 'fail') > 0 THEN 1 ELSE 0 END AS exit_code FROM v"""
)
def bibliography_summary(spark, d):
    return report.summary(_verified(spark, d))


_FINDING = "CASE verdict WHEN 'verified' THEN 'supported' WHEN 'not_found' THEN 'refuted' WHEN 'retracted' THEN 'refuted' ELSE 'inconclusive' END"


@query(_VERIFY + f"SELECT count(*) AS total, count(*) FILTER ({_FINDING} = 'supported') AS supported, count(*) FILTER ({_FINDING} = 'refuted') AS refuted, count(*) FILTER ({_FINDING} = 'inconclusive') AS inconclusive FROM v")
def bibliography_rollup(spark, d):
    return report.rolled_up(_verified(spark, d)).drop("by_verdict")


_AXES = {"existence": ("o_orderkey", 1, ("pass", "fail", "unknown")), "metadata": ("o_custkey", 1, ("pass", "warn", "fail", "unknown")), "retraction": ("o_orderkey", 3, ("pass", "fail", "unknown")), "url": ("o_custkey", 4, ("pass", "warn", "fail", "unknown"))}
_GRID = "SELECT " + ", ".join(f"CASE CAST(floor({k} / {n}) AS BIGINT) % {len(v)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(v)) + f" END AS {name}" for name, (k, n, v) in _AXES.items()) + ", CAST(floor(o_orderkey / 9) AS BIGINT) % 2 = 0 AS url_cited FROM {orders}"


@query(f"WITH a AS (SELECT *, count(*) AS n FROM ({_GRID.replace('{orders}', 'orders')}) GROUP BY ALL)," + _JUDGE + " SELECT existence, metadata, retraction, url, url_cited, score, verdict, n FROM v")
def score_grid(spark, d):
    """Score and verdict of every combination of statuses that the orders imply."""
    rows = spark.sql(_GRID, orders=table(spark, d, "orders"))
    return verify.judged(rows.groupBy(*_AXES, "url_cited").agg(F.count("*").alias("n")), F.col("url_cited"))


@query(f"SELECT ref_id, {_DOI} AS doi FROM {duck('refs')}")
def doi_normalize(spark, d):
    return derived(spark, d, "refs").select("ref_id", text.doi(F.col("doi")).alias("doi"))


@query("""
WITH n AS (SELECT s_suppkey, s_name || ' of Nation' || s_nationkey AS cited, ['Nation' || (s_suppkey % 5), 'Nation' || s_nationkey || ', ' || s_name] AS known FROM supplier)
SELECT s_suppkey, lower(split_part(cited, ' ', -1)) AS surname, CASE WHEN list_contains(list_transform(known, lambda k: lower(trim(split_part(k, ',', 1)))), lower(split_part(cited, ' ', -1))) THEN 0.5 ELSE 0 END
  + CASE WHEN list_contains(list_transform(known, lambda k: lower(trim(split_part(k, ',', 1)))), 'nobody') THEN 0.5 ELSE 0 END::DOUBLE AS overlap FROM n""")
def surname_overlap(spark, d):
    rows = table(spark, d, "supplier")
    name, nation = F.col("s_name"), F.col("s_nationkey").cast("string")
    cited = F.concat(name, F.lit(" of Nation"), nation)
    known = F.array(F.concat(F.lit("Nation"), (F.col("s_suppkey") % 5).cast("string")), F.concat(F.lit("Nation"), nation, F.lit(", "), name))
    return rows.select("s_suppkey", text.surname(cited).alias("surname"), text.author_overlap(F.array(cited, F.lit("Nobody")), known).alias("overlap"))


@query()
def title_search_top1(spark, d):
    """The best of all titles for citations that lack a title's middle (no Ratcliff-Obershelp in SQL; tested against difflib)."""
    works = derived(spark, d, "works")
    refs = works.select(F.col("work").alias("ref_id"), F.concat_ws(" ", F.expr("substring_index(title, ' ', 3)"), F.lit("bt"), F.expr("substring_index(title, ' ', -2)")).alias("title"))
    return titles.best_titles(refs, works.select("doi", "title"), 0.0)


#: One letter of the first word is missing, doubled by another, or wrong; a title of n letters is then so similar to its work.
_TYPO = {0: "concat(substring(title, 1, {at}), substring(title, {at} + 2))", 1: "concat(substring(title, 1, {at}), 'q', substring(title, {at} + 1))", 2: "concat(substring(title, 1, {at}), 'q', substring(title, {at} + 2))"}
_TYPOS = "SELECT work AS ref_id, doi, title AS whole, CASE work % 3 " + " ".join(f"WHEN {k} THEN {v.format(at='(1 + CAST(work % 4 AS INT))')}" for k, v in _TYPO.items()) + " END AS title FROM ({works}) w"


@query(f"""
WITH t AS ({_TYPOS.replace("({works})", duck("works"))}), n AS (SELECT *, length(trim(regexp_replace(lower(whole), '[^a-z0-9]+', ' ', 'g'))) AS n FROM t)
SELECT ref_id, CASE ref_id % 3 WHEN 0 THEN 2.0 * (n - 1) / (2 * n - 1) WHEN 1 THEN 2.0 * n / (2 * n + 1) ELSE 2.0 * (n - 1) / (2 * n) END::DOUBLE AS similarity, doi FROM n""")
def title_search_typos(spark, d):
    """Every work, cited with a typo in the first word of its title: the work itself must be the best of all."""
    works = derived(spark, d, "works")
    refs = spark.sql(_TYPOS.replace("({works})", "{works}"), works=works)
    return titles.best_titles(refs.select("ref_id", "title"), works.select("doi", "title"))


@query(f"WITH {_BEST.strip()} SELECT ref_id, rank, similarity, title FROM best")
def title_search_ranked(spark, d):
    refs = _refs(spark, d)
    search = derived(spark, d, "search").withColumn("authors", F.array("family"))
    best = verify.best_candidates(refs, search.withColumn("retraction", F.col("rank").cast("string")))  # carries the rank through
    return best.select("ref_id", F.col("retraction").cast("int").alias("rank"), "similarity", "title")


_RETRACT = f"""
WITH rec AS (SELECT * FROM {duck("records")}), w AS (SELECT doi FROM {duck("works")})
SELECT w.doi, (c.outcome = 'ok' AND c.outcome IS NOT NULL)::INT + (o.outcome = 'ok' AND o.outcome IS NOT NULL)::INT AS consulted,
  CASE WHEN (c.outcome = 'ok' AND c.retraction IS NOT NULL) OR (o.outcome = 'ok' AND o.retraction IS NOT NULL) THEN 'fail' WHEN coalesce(c.outcome, '') <> 'ok' AND coalesce(o.outcome, '') <> 'ok' THEN 'unknown' ELSE 'pass' END AS retraction
FROM w LEFT JOIN rec c ON c.provider = 'crossref' AND c.doi = w.doi LEFT JOIN rec o ON o.provider = 'openalex' AND o.doi = w.doi"""


@query(_RETRACT)
def retraction_crosscheck(spark, d):
    rows = verify.looked_up(derived(spark, d, "works").select("doi"), _records(spark, d)).withColumn("record", F.lit(None).cast("struct<retraction:string>"))
    return verify.with_retraction(rows, F.lit(True)).select("doi", "consulted", "retraction")


@query("""SELECT page_id, CASE WHEN s IS NULL THEN 'unknown' WHEN s BETWEEN 200 AND 399 THEN 'pass' WHEN page_id % 2 = 0 THEN 'warn' ELSE 'fail' END AS url_status,
  CASE WHEN s IS NULL THEN 0.2 WHEN s BETWEEN 200 AND 399 THEN 0.9 WHEN page_id % 2 = 0 THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN 500 END AS s FROM pages) p""")
def url_liveness(spark, d):
    k = F.col("page_id") % 5
    http = F.when(k == 0, 200).when(k == 1, 301).when(k == 2, 404).when(k == 3, 500)
    archived = F.col("page_id") % 2 == 0
    return table(spark, d, "pages").select("page_id", verify.url_status(http, archived).alias("url_status"), verify.url_confidence(http, archived).alias("confidence"))


@query(f"""
WITH loc AS (SELECT * FROM {duck("locations")}), w AS (SELECT work, CASE WHEN work % 29 = 0 THEN '10.48550/arXiv.' || work ELSE doi END AS doi FROM {duck("works")}),
x AS (SELECT w.work, w.doi, CASE WHEN o.outcome = 'ok' THEN coalesce(nullif(o.pdf_url, ''), nullif(o.landing_url, '')) END AS ou, CASE WHEN u.outcome = 'ok' THEN coalesce(nullif(u.pdf_url, ''), nullif(u.landing_url, '')) END AS uu,
  o.outcome = 'ok' AND o.is_oa AS oa, u.outcome = 'ok' AND u.is_oa AS ua, coalesce(o.outcome, 'absent') AS oo, coalesce(u.outcome, 'absent') AS uo, o.oa_status AS os, u.oa_status AS us, CASE WHEN w.work % 31 = 0 THEN 'https://resolver.example/' || w.work END AS ext
  FROM w LEFT JOIN loc o ON o.provider = 'openalex' AND o.doi = w.doi LEFT JOIN loc u ON u.provider = 'unpaywall' AND u.doi = w.doi),
y AS (SELECT *, coalesce(oa, false) AND ou IS NOT NULL AS by_oa, coalesce(ua, false) AND uu IS NOT NULL AS by_un, regexp_extract(doi, '(?i)^10\\.48550/arxiv\\.(.+)$', 1) AS ax FROM x),
z AS (SELECT *, CASE WHEN by_oa THEN 'openalex' WHEN by_un THEN 'unpaywall' WHEN ax <> '' THEN 'arxiv' WHEN ext IS NOT NULL THEN 'external-resolver' ELSE '' END AS source, oo = 'error' OR (NOT by_oa AND uo = 'error') AS failed FROM y),
q AS (SELECT *, source IN ('openalex', 'unpaywall', 'arxiv') OR coalesce(oa, false) AS is_oa FROM z)
SELECT work AS ref_id, doi, is_oa, CASE source WHEN 'openalex' THEN os WHEN 'unpaywall' THEN us WHEN 'arxiv' THEN 'green' ELSE CASE WHEN failed AND NOT coalesce(oa, false) THEN 'unknown' WHEN oo = 'ok' THEN coalesce(nullif(os, ''), 'closed') ELSE '' END END AS oa_status,
  CASE source WHEN 'openalex' THEN ou WHEN 'unpaywall' THEN uu WHEN 'arxiv' THEN 'https://arxiv.org/pdf/' || ax WHEN 'external-resolver' THEN ext ELSE '' END AS best_url, source,
  concat_ws(',', CASE WHEN oo <> 'error' THEN 'openalex' END, CASE WHEN NOT by_oa AND uo <> 'error' THEN 'unpaywall' END) AS consulted,
  CASE WHEN is_oa THEN 'oa' WHEN source = 'external-resolver' THEN 'external' WHEN failed THEN 'incomplete' ELSE 'none' END AS message FROM q""")
def fulltext_cascade(spark, d):
    works = derived(spark, d, "works").select(F.col("work").alias("ref_id"), F.when(F.col("work") % 29 == 0, F.concat(F.lit("10.48550/arXiv."), F.col("work"))).otherwise(F.col("doi")).alias("doi"))
    resolver = works.where("ref_id % 31 = 0").select("doi", F.concat(F.lit("https://resolver.example/"), F.col("ref_id")).alias("url"))
    return fulltext.located(works, derived(spark, d, "locations"), True, resolver)


@query(f"SELECT r.ref_id AS ref_key, r.work FROM {duck('refs')} r WHERE NOT EXISTS (SELECT 1 FROM {duck('findings')} f WHERE f.ref_key = r.ref_id)")
def resume_pending(spark, d):
    refs = derived(spark, d, "refs").select(F.col("ref_id").alias("ref_key"), "work")
    return study.pending(refs, derived(spark, d, "findings"))


# --- comparison

@query(f"SELECT split, substring(sha256(string_agg(item, chr(10) ORDER BY item)), 1, 12) AS split_id, count(*) AS n_items FROM {duck('splits')} GROUP BY split")
def split_ids(spark, d):
    return compare.split_ids(derived(spark, d, "splits"))


@query(f"""WITH s AS (SELECT * FROM {duck("splits")})
SELECT 'a' AS side, item FROM (SELECT item FROM s WHERE split = 'test' EXCEPT SELECT item FROM s WHERE split = 'test2') UNION ALL
SELECT 'b', item FROM (SELECT item FROM s WHERE split = 'test2' EXCEPT SELECT item FROM s WHERE split = 'test')""")
def split_diff(spark, d):
    return compare.split_difference(derived(spark, d, "splits"), "test", "test2")


#: Criteria from the parts: a field per brand, not all of them in both, some null.
_FIELDS = """SELECT CASE p_partkey % 2 WHEN 0 THEN 'strict' ELSE 'loose' END AS criterion, p_brand AS k, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE CAST(max(p_size) AS VARCHAR(9)) END AS v FROM {part}
WHERE NOT (p_partkey % 2 = 0 AND p_brand LIKE '%1') AND NOT (p_partkey % 2 = 1 AND p_brand LIKE '%2') GROUP BY p_partkey % 2, p_brand"""


@query(f"""WITH f AS ({_FIELDS.replace("{part}", "part")}), a AS (SELECT k, coalesce(v, 'null') AS v FROM f WHERE criterion = 'strict'), b AS (SELECT k, coalesce(v, 'null') AS v FROM f WHERE criterion = 'loose')
SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, '(absent)') AS a_value, coalesce(b.v, '(absent)') AS b_value FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.v, '(absent)') <> coalesce(b.v, '(absent)')""")
def criterion_diff(spark, d):
    return compare.criterion_difference(spark.sql(_FIELDS, part=table(spark, d, "part")), "strict", "loose")


_PAIRS = f"""
WITH arms AS (SELECT * FROM {duck("arms")}), met AS (SELECT * FROM {duck("metrics")}),
p AS (SELECT a.task, a.name AS a, b.name AS b, a.split_id <> b.split_id AS s, a.split_id = b.split_id AND a.n_units <> b.n_units AS u, a.criterion <> b.criterion AS c,
  a.provenance LIKE 'asserted%' OR a.provenance LIKE '%reconstructed%' OR b.provenance LIKE 'asserted%' OR b.provenance LIKE '%reconstructed%' AS asserted FROM arms a JOIN arms b ON a.task = b.task AND a.name < b.name)"""


@query(_PAIRS + " SELECT p.task, p.a, p.b, asserted, x.value AS va, y.value AS vb, x.value - y.value AS delta FROM p JOIN met x ON x.name = p.a JOIN met y ON y.name = p.b WHERE NOT (s OR u OR c)")
def compare_pairs(spark, d):
    return compare.deltas(derived(spark, d, "arms"), derived(spark, d, "metrics"), "test", "f1")


@query(_PAIRS + " SELECT task, a, b, concat_ws(',', CASE WHEN s THEN 'split' END, CASE WHEN u THEN 'n_units' END, CASE WHEN c THEN 'criterion' END) AS problems FROM p WHERE s OR u OR c")
def compare_refused(spark, d):
    return compare.refused(derived(spark, d, "arms"))


@query("""WITH d AS (SELECT side, item, row_number() OVER (PARTITION BY side ORDER BY item) AS k, count(*) OVER (PARTITION BY side) AS n FROM (
  SELECT 'a' AS side, item FROM (SELECT item FROM s WHERE split = 'test' EXCEPT SELECT item FROM s WHERE split = 'test2') UNION ALL
  SELECT 'b', item FROM (SELECT item FROM s WHERE split = 'test2' EXCEPT SELECT item FROM s WHERE split = 'test')) e)
SELECT side, string_agg(item, ', ' ORDER BY item) || CASE WHEN max(n) > 3 THEN ' and ' || (max(n) - 3) || ' more' ELSE '' END AS shown FROM d WHERE k <= 3 GROUP BY side""".replace("FROM s", f"FROM {duck('splits')} s"))
def split_diff_shown(spark, d):
    return compare.shown_difference(compare.split_difference(derived(spark, d, "splits"), "test", "test2"))


@query(_PAIRS + """, lack AS (SELECT name FROM met WHERE ascii(substring(name, 4, 1)) % 2 = 0)
SELECT task, a, b, concat_ws(',', CASE WHEN a IN (SELECT name FROM lack) THEN 'metric:a' END, CASE WHEN b IN (SELECT name FROM lack) THEN 'metric:b' END) AS problems
FROM p WHERE NOT (s OR u OR c) AND (a IN (SELECT name FROM lack) OR b IN (SELECT name FROM lack))""")
def compare_without_metric(spark, d):
    metrics = derived(spark, d, "metrics").where("ascii(substring(name, 4, 1)) % 2 = 1")
    return compare.without_metric(derived(spark, d, "arms"), metrics, "test", "f1")


def _results(spark, d):
    """Results files as JSON: of every language six, of which some lack a part."""
    k, s = F.col("k"), lambda c: F.col(c).cast("string")
    rows = derived(spark, d, "results")
    block = lambda role: F.struct(F.struct(F.col("tp"), F.col("fn"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall")).alias(role))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    body = text(
        '{"results_by_method":{"', F.when(k == 5, "other").otherwise("main"), '":{', F.when(k != 4, F.lit('"parameters":{"threshold":0.5},')).otherwise(""), '"aggregate":',
        F.when(k == 3, F.to_json(block("train"))).otherwise(F.to_json(block("test"))), "}},", F.when(k != 2, text('"test_items":["', s("low"), '","', s("high"), '"],')).otherwise(""),
        '"matching_criteria":{"iou":0.5', F.when(k != 1, F.lit(',"classes":"all"')).otherwise(""), "}}",
    )
    return registry.results(rows.select("path", body.alias("body")), ["iou", "classes"], "main")


@query(f"""SELECT path AS name, CASE k WHEN 5 THEN 'method' WHEN 4 THEN 'params' WHEN 3 THEN 'metrics' WHEN 2 THEN 'split' ELSE 'criterion:classes' END AS problem FROM {duck("results")} WHERE k > 0""")
def results_refused(spark, d):
    return registry.refused(_results(spark, d))


@query(f"""SELECT path AS name, substring(sha256(least(low::VARCHAR, high::VARCHAR) || chr(10) || greatest(low::VARCHAR, high::VARCHAR)), 1, 12) AS split_id, (tp + fn)::INT AS n_units,
  '[["classes","all"],["iou","0.5"]]' AS criterion, 'file' AS provenance FROM {duck("results")} WHERE k = 0""")
def results_arms(spark, d):
    return registry.arms_of(_results(spark, d))


@query(f"SELECT path AS name, 'test' AS role, unnest(['tp', 'fn']) AS metric, unnest([tp, fn])::DOUBLE AS value FROM {duck('results')} WHERE k = 0")
def results_counts(spark, d):
    return registry.whole_metrics(registry.metrics_of(_results(spark, d)))


_STEPS = [round(0.1 * i, 1) for i in range(1, 10)]
_SWEEP = f"""
WITH t AS (SELECT unnest([{", ".join(map(str, _STEPS))}]::DOUBLE[]) AS threshold),
s AS (SELECT run, threshold, count(*) FILTER (score >= threshold AND truth = 1) AS tp, count(*) FILTER (score >= threshold AND truth = 0) AS fp, count(*) FILTER (score < threshold AND truth = 1) AS fn FROM {duck("scored")} x, t GROUP BY run, threshold),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp::DOUBLE / (2 * tp + fp + fn), 6) END AS f1 FROM s)"""


@query(_SWEEP + " SELECT run, threshold, tp, fp, fn, f1 FROM f")
def threshold_sweep(spark, d):
    return compare.threshold_sweep(derived(spark, d, "scored"), _STEPS).withColumns({c: F.col(c).cast("long") for c in ("tp", "fp", "fn")})


@query(_SWEEP + """, b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, threshold) AS k, min(threshold) OVER (PARTITION BY run) AS lo, max(threshold) OVER (PARTITION BY run) AS hi FROM f)
SELECT run, threshold AS best_at, f1 AS best_value, threshold > lo AND threshold < hi AS interior FROM b WHERE k = 1""")
def sweep_interior(spark, d):
    return compare.sweep_interior(compare.threshold_sweep(derived(spark, d, "scored"), _STEPS), "threshold", "f1")


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey % 10 = 0 AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 10 <> 0)")
def leakage_by_group(spark, d):
    rows = table(spark, d, "lineitem")
    return compare.leaked_groups(rows.where("l_orderkey % 10 <> 0"), rows.where("l_orderkey % 10 = 0"), "l_suppkey")


@query("""WITH x AS (SELECT count(DISTINCT doc_id) / count(*)::DOUBLE AS a, count(DISTINCT lang) / count(*)::DOUBLE AS b, count(DISTINCT source) / count(*)::DOUBLE AS c FROM documents)
SELECT 'doc_id' AS "column", round(a, 6) AS share, a > 0.5 AS suspicious FROM x UNION ALL SELECT 'lang', round(b, 6), b > 0.5 FROM x UNION ALL SELECT 'source', round(c, 6), c > 0.5 FROM x""")
def label_guard(spark, d):
    return compare.label_guard(table(spark, d, "documents"), ["doc_id", "lang", "source"])


@query("""WITH r AS (SELECT l_returnflag AS metric, l_linenumber AS run, count(*) AS value FROM lineitem GROUP BY 1, 2),
x AS (SELECT *, value - lag(value) OVER (PARTITION BY metric ORDER BY run) AS delta FROM r)
SELECT metric, run, value, delta, coalesce(sign(delta) * sign(lag(delta) OVER (PARTITION BY metric ORDER BY run)) < 0, false) AS reversed FROM x""")
def run_trajectory(spark, d):
    runs = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), F.col("l_linenumber").alias("run")).agg(F.count("*").alias("value"))
    return compare.trajectory(runs)


@query("""WITH p AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT (SELECT sum(n) FROM p)::BIGINT AS sum_of_parts, (SELECT count(*) FROM documents) AS whole,
  (SELECT count(*) FROM documents) = (SELECT sum(n) FROM p) AS holds, round((SELECT count(*) FROM documents WHERE lang = 'en')::DOUBLE / (SELECT count(*) FROM documents), 6) AS dropped_share""")
def free_assertions(spark, d):
    docs = table(spark, d, "documents")
    by = docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"))
    total = by.agg(F.sum("n").alias("sum_of_parts"), F.sum("en").alias("en"))
    whole = docs.agg(F.count("*").alias("whole"))
    return total.crossJoin(whole).select("sum_of_parts", "whole", (F.col("sum_of_parts") == F.col("whole")).alias("holds"), F.round(F.col("en") / F.col("whole"), 6).alias("dropped_share"))


_POINTS = f"""SELECT run, threshold, count(*) FILTER (score >= threshold AND truth = 1) AS tp, count(*) FILTER (score < threshold AND truth = 1) AS fn
  FROM {duck("scored")} x, (SELECT unnest([{", ".join(map(str, _STEPS))}]::DOUBLE[]) AS threshold) t WHERE run <> 'de' OR score >= threshold / 10 GROUP BY run, threshold"""


@query(f"SELECT run, count(*) AS points, min(tp + fn) AS least, max(tp + fn) AS most, min(tp + fn) = max(tp + fn) AS constant FROM ({_POINTS}) GROUP BY run")
def sweep_units(spark, d):
    """Units of every sweep; one of them drops documents as its threshold rises, as a faulty script would."""
    rows = derived(spark, d, "scored").withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in _STEPS]))).where("run <> 'de' OR score >= threshold / 10")
    hit = F.col("score") >= F.col("threshold")
    points = rows.groupBy("run", "threshold").agg(F.count_if(hit & (F.col("truth") == 1)).alias("tp"), F.count_if(~hit & (F.col("truth") == 1)).alias("fn"))
    return compare.constant_units(points)


# --- scanner

_NO_LOOK = ("email", "ssn", "hardcoded-credential", "jwt", "aws-access-key", "github-token", "private-key-block")
_FREE = {x.label: x for x in detectors.DETECTORS}


def _sql_hits(name, column, source, key):
    p = _FREE[name].pattern.replace("'", "''").replace("\\s", "[\\s\\v]")
    body = f"regexp_extract_all({column}, '{p}', {1 if _FREE[name].gate == 'group' else 0})"
    cut = f"m[{_FREE[name].strip + 1}:]" if _FREE[name].gate == "strip" else "m"
    return f"SELECT {key}, '{name}' AS label, unnest(regexp_extract_all({column}, '{p}', 0)) AS match, unnest({body}) AS m0 FROM {source}", cut, _FREE[name].gate


def _sql_scan(column, source, key):
    parts = []
    for name in _NO_LOOK:
        inner, cut, gate = _sql_hits(name, column, source, key)
        ok = "true" if gate == "pii" else "NOT (length(trim(b, '''\"')) >= 6 AND len(list_distinct(string_split(trim(b, '''\"'), ''))) <= 2)"
        parts.append(f"SELECT {key}, label, match FROM (SELECT *, {cut.replace('m', 'm0', 1)} AS b FROM ({inner}) i) j WHERE {ok}")
    return " UNION ALL ".join(parts)


@query(_sql_scan("text", "documents", "doc_id"))
def secret_hits(spark, d):
    return scan.scanned(table(spark, d, "documents").select("doc_id", "text"), labels=_NO_LOOK)


@query(_sql_scan("html", "pages", "page_id"))
def pii_hits_pages(spark, d):
    return scan.scanned(table(spark, d, "pages").select("page_id", "html"), "html", labels=_NO_LOOK)


@query("""SELECT doc_id, regexp_matches(text, '(^|[^0-9])(?:\\+?1[\\s\\v.\\-]?)?\\(?[0-9]{3}\\)?[\\s\\v.\\-][0-9]{3}[\\s\\v.\\-][0-9]{4}([^0-9]|$)') AS us_phone,
  regexp_matches(text, '(^|[^0-9])\\+[0-9]{7,15}([^0-9]|$)') AS intl_phone, regexp_matches(text, '(^|[^0-9])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}([^0-9]|$)') AS ipv4 FROM documents""")
def lookaround_docs(spark, d):
    marks = [F.col("text").rlike(_FREE[n].pattern).alias(n.replace("-", "_")) for n in ("us-phone", "intl-phone", "ipv4")]
    return table(spark, d, "documents").select("doc_id", *marks)


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:[0-9][ \\-]?){13,19}\\b')) AS match FROM documents),
x AS (SELECT doc_id, match, list_reverse(string_split(regexp_replace(match, '[^0-9]', '', 'g'), '')) AS r FROM m)
SELECT doc_id, trim(match) AS match FROM x WHERE len(r) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN r[i]::INT WHEN r[i]::INT * 2 > 9 THEN r[i]::INT * 2 - 9 ELSE r[i]::INT * 2 END)) % 10 = 0""")
def card_luhn(spark, d):
    return scan.scanned(table(spark, d, "documents").select("doc_id", "text"), labels=("credit-card",)).select("doc_id", F.trim("match").alias("match"))


@query()
def scanner_all(spark, d):
    """All detectors over three tables, with an allow list (look-around and Unicode shapes have no RE2 form)."""
    parts = [table(spark, d, t).select(F.lit(t).alias("source"), F.col(k).alias("id"), F.col(c).alias("text")) for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"))]
    return scan.scanned(parts[0].unionAll(parts[1]).unionAll(parts[2]), allowed=("example.com", "127.0.0.1"))


@query("""SELECT c_custkey, length(b) >= 6 AND len(list_distinct(string_split(b, ''))) <= 2 AS placeholder, regexp_matches(b, '[0-9]') AND regexp_matches(b, '[A-Za-z]') AS entropy
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN repeat('x', (c_custkey % 9)::INT) WHEN 1 THEN c_name ELSE c_mktsegment END AS b FROM customer) t""")
def placeholder_gate(spark, d):
    k = F.col("c_custkey") % 3
    body = F.when(k == 0, F.repeat(F.lit("x"), (F.col("c_custkey") % 9).cast("int"))).when(k == 1, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", body.alias("b")).select("c_custkey", detectors.is_placeholder(F.col("b")).alias("placeholder"), detectors.has_entropy(F.col("b")).alias("entropy"))


@query("""SELECT page_id, target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS target FROM pages) t WHERE NOT regexp_matches(target, '^(https?:|mailto:|#)')""")
def link_extract(spark, d):
    return scan.links(table(spark, d, "pages").select("page_id", "html"))


@query("""WITH m AS (SELECT doc_id, 'd/' || source || '/' || doc_id || '.md' AS path, 'See [next](../' || source || '/' || (doc_id + 1) || '.md#top) and [web](https://example.org) and [top](/d/' || source || ') here' AS text FROM documents),
t AS (SELECT path, '../' || split_part(path, '/', 2) || '/' || (doc_id + 1) || '.md#top' AS target, 'd/' || split_part(path, '/', 2) || '/' || (doc_id + 1) || '.md' AS goal FROM m)
SELECT path, target FROM t WHERE goal NOT IN (SELECT path FROM m)""")
def broken_links(spark, d):
    """Documents stand for Markdown pages in folders of their sources."""
    source, doc = F.col("source"), F.col("doc_id")
    path = F.concat(F.lit("d/"), source, F.lit("/"), doc, F.lit(".md"))
    text = F.concat(F.lit("See [next](../"), source, F.lit("/"), doc + 1, F.lit(".md#top) and [web](https://example.org) and [top](/d/"), source, F.lit(") here"))
    pages = table(spark, d, "documents").where("source is not null").select(path.alias("path"), text.alias("text"))
    return scan.broken_links(pages, pages)


@query("SELECT sha256(text) AS sha256, count(*) AS copies, substring(sha256(text), 1, 16) || '.bin' AS path FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_archive(spark, d):
    return scan.archive(table(spark, d, "documents"), "text")


#: Every page with a line of where it was kept, which one in four marks as meant, and the name and number of a file.
_KEPT = """SELECT page_id, html || chr(10) || 'kept in /Users/u' || page_id || '/x of ' || url || CASE WHEN page_id % 4 = 1 THEN ' <!-- shown -->' ELSE '' END || chr(10)
  || 'site' || page_id || '_2024-0' || (page_id % 9 + 1) || '-17.' || CASE WHEN page_id % 3 = 0 THEN 'wav' ELSE 'txt' END || chr(10) || 'no ' || (page_id + 1) || repeat('7', CAST(12 + page_id % 9 AS INT)) AS text FROM {pages}"""
_LINES = {
    "operator-host-path": "(^|[^0-9A-Za-z_`/])/(home|Users|Volumes)/[0-9A-Za-z_.\\-]+", "raw-data-filename": "\\b[0-9A-Za-z_\\-]*[0-9]{4}[_\\-][0-9]{2}[_\\-][0-9]{2}[0-9A-Za-z_\\-]*\\.(wav|mp3|flac|edf|fif|nii|csv)\\b",
    "chat-platform-snowflake": "(^|[^0-9])[0-9]{17,19}([^0-9]|$)",
}


@query(f"""WITH f AS ({_KEPT.replace("{pages}", "pages")}), p AS (SELECT page_id, regexp_split_to_array(text, '\r\n|\n|\r') AS parts FROM f),
l AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS line FROM p)
""" + " UNION ALL ".join(f"SELECT page_id, line::INT AS line, '{k}' AS label FROM l WHERE NOT contains(part, '<!-- shown -->') AND regexp_matches(part, '{v}')" for k, v in _LINES.items()))
def line_shapes(spark, d):
    """Lines that tell of a machine, a recording or an account, but for those marked as meant."""
    return scan.line_hits(spark.sql(_KEPT, pages=table(spark, d, "pages")), marker="<!-- shown -->")


# --- signal

_EPOCH = f"""
WITH e AS (SELECT s.recording, t.t AS event_t, channel, s.t - t.t AS lag, amp FROM {duck("triggers")} t JOIN {duck("samples")} s ON s.t BETWEEN t.t - 5 AND t.t + 15),
f AS (SELECT recording, event_t, channel, lag, round(amp * 1000000)::BIGINT AS amp FROM e),
b AS (SELECT *, amp - coalesce(floor((sum(CASE WHEN lag <= 0 THEN amp END) OVER w)::DOUBLE / (count(CASE WHEN lag <= 0 THEN amp END) OVER w)), 0)::BIGINT AS adj FROM f WINDOW w AS (PARTITION BY recording, event_t, channel)),
v AS (SELECT recording, channel, floor(lag / 2)::BIGINT AS lag_step, floor(sum(adj)::DOUBLE / count(*)) / 1000000 AS amp, count(*) AS n FROM b GROUP BY 1, 2, 3)"""


def _evoked(spark, d):
    rows = signal.baseline_corrected(signal.epochs(derived(spark, d, "samples"), derived(spark, d, "triggers"), -5.0, 15.0))
    return signal.averaged(rows, 2.0)


@query(_EPOCH + " SELECT recording, channel, lag_step, amp, n FROM v")
def epoch_average(spark, d):
    return _evoked(spark, d)


@query(_EPOCH + " SELECT recording, channel, lag_step, amp, n FROM (SELECT recording, channel, lag_step, amp, n, row_number() OVER (PARTITION BY recording ORDER BY abs(amp) DESC, lag_step, channel) AS k FROM v WHERE lag_step BETWEEN 0 AND 6) WHERE k = 1")
def epoch_peak(spark, d):
    return signal.peak(_evoked(spark, d), 0, 6)


@query(f"SELECT recording, code, n FROM (SELECT recording, code, count(*) AS n, row_number() OVER (PARTITION BY recording ORDER BY count(*) DESC, min(t), code) AS k FROM {duck('triggers')} GROUP BY 1, 2) WHERE k = 1")
def trigger_mode(spark, d):
    return signal.modal_code(derived(spark, d, "triggers"))


@query("""WITH s AS (SELECT user_id AS recording, event_id::DOUBLE AS t, (value > 50)::INT AS code FROM events), x AS (SELECT *, coalesce(lag(code) OVER (PARTITION BY recording ORDER BY t), 0) AS b FROM s) SELECT recording, t, code FROM x WHERE code > b""")
def trigger_edges(spark, d):
    return signal.rising_edges(table(spark, d, "events").select(F.col("user_id").alias("recording"), F.col("event_id").cast("double").alias("t"), (F.col("value") > 50).cast("int").alias("code")))


def _series(spark, d):
    """All events as one channel, a sample a second."""
    return table(spark, d, "events").select(F.lit("events").alias("recording"), F.lit("value").alias("channel"), F.col("event_id").cast("double").alias("t"), F.col("value").alias("amp"))


#: Resampling from 1 Hz to 2/5 Hz, and a band of 0.05 to 0.2 Hz.
_UP, _DOWN, _BAND = 2, 5, (0.05, 0.2)
_HALF, _TAPS = filters.CROSSINGS * max(_UP, _DOWN), len(filters.band_kernel(*_BAND, 1.0))


@query(f"""
WITH x AS (SELECT event_id AS n, value AS amp FROM events), m AS (SELECT unnest(range((SELECT ceil(min(n) * {_UP} / {_DOWN}.0)::BIGINT FROM x), (SELECT floor(max(n) * {_UP} / {_DOWN}.0)::BIGINT + 1 FROM x))) AS m),
j AS (SELECT m, amp, (m * {_DOWN} - n * {_UP})::DOUBLE AS s FROM m JOIN x ON n BETWEEN ceil((m * {_DOWN} - {_HALF}) / {_UP}.0) AND floor((m * {_DOWN} + {_HALF}) / {_UP}.0)),
h AS (SELECT m, amp, {_UP} * {filters.ROLLOFF} / {_DOWN} * CASE WHEN s = 0 THEN 1 ELSE sin(pi() * {filters.ROLLOFF} * s / {_DOWN}) / (pi() * {filters.ROLLOFF} * s / {_DOWN}) END
  * (0.42 + 0.5 * cos(pi() * s / {_HALF}) + 0.08 * cos(2 * pi() * s / {_HALF})) AS tap FROM j)
SELECT 'events' AS recording, 'value' AS channel, m * {_DOWN}::DOUBLE / {_UP} AS t, round(sum(amp * tap), 4) AS amp FROM h GROUP BY m""")
def signal_resampled(spark, d):
    return filters.resampled(_series(spark, d), 1, Fraction(_UP, _DOWN)).withColumn("amp", F.round("amp", 4))


def _low_pass_sql(high: float) -> str:
    return f"CASE WHEN k = 0 THEN {2 * high} ELSE sin(pi() * {2 * high} * k) / (pi() * k) END"


@query(f"""
WITH x AS (SELECT event_id AS n, value AS amp FROM events), j AS (SELECT a.n, b.amp, (a.n - b.n)::DOUBLE AS k FROM x a JOIN x b ON b.n BETWEEN a.n - {_TAPS // 2} AND a.n + {_TAPS // 2})
SELECT 'events' AS recording, 'value' AS channel, n::DOUBLE AS t, round(sum(amp * ({_low_pass_sql(_BAND[1])} - {_low_pass_sql(_BAND[0])}) * (0.54 + 0.46 * cos(2 * pi() * k / {_TAPS - 1}))), 4) + 0.0 AS amp FROM j GROUP BY n""")
def signal_band(spark, d):
    return filters.filtered(_series(spark, d), filters.band_kernel(*_BAND, 1.0), 1).withColumn("amp", F.round("amp", 4) + 0.0)


@query(f"""
WITH s AS (SELECT event_type AS channel, event_id / 1000::DOUBLE AS t, value AS amp, event_id % 400 = 150 AS fires FROM events),
e AS (SELECT g.t AS event_t, s.channel, s.t - g.t AS lag, round(s.amp * 1000000)::BIGINT AS amp FROM s g JOIN s ON s.t BETWEEN g.t - 0.5 AND g.t + 0.5 AND s.t - g.t BETWEEN -0.1 AND 0.3 WHERE g.fires),
b AS (SELECT *, amp - coalesce(floor((sum(CASE WHEN lag <= 0 THEN amp END) OVER w)::DOUBLE / (count(CASE WHEN lag <= 0 THEN amp END) OVER w)), 0)::BIGINT AS adj FROM e WINDOW w AS (PARTITION BY event_t, channel)),
v AS (SELECT channel, floor(round(lag, 6) / 0.001)::BIGINT AS step, floor(sum(adj)::DOUBLE / count(*)) / 1000000 AS amp FROM b GROUP BY 1, 2),
p AS (SELECT channel, step::DOUBLE AS latency, amp, (SELECT count(DISTINCT event_t) FROM b) AS n FROM v WHERE step BETWEEN 30 AND 235 ORDER BY abs(amp) DESC, step, channel LIMIT 1),
z AS (SELECT *, CASE WHEN latency BETWEEN 80 AND 120 THEN 'supported' WHEN latency <= 70 THEN 'p50_ambiguous' WHEN latency BETWEEN 170 AND 215 THEN 'p200_ambiguous' WHEN latency > 215 THEN 'refutable' WHEN latency < 80 THEN 'off_window_early' ELSE 'off_window_late' END AS zone,
  least(abs(latency - 30), abs(latency - 235)) <= 1 AS edge FROM p)
SELECT 'events' AS recording, channel, latency AS latency_ms, amp AS amplitude, n AS n_epochs, zone,
  CASE WHEN zone = 'supported' THEN 'supported' WHEN zone = 'refutable' AND NOT edge AND n >= 8 THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM z""")
def signal_study(spark, d):
    """A whole study over the events, run through the store: kinds are channels, a sample a millisecond."""
    rows = table(spark, d, "events").withColumn("t", F.col("event_id") / 1000)
    samples = rows.select(F.lit("events").alias("recording"), F.col("event_type").alias("channel"), "t", F.col("value").alias("amp"))
    triggers = rows.where("event_id % 400 = 150").select(F.lit("events").alias("recording"), "t", F.lit(1).alias("code"))
    store = study.StudyStore(spark, f"{shared_dir(spark)}/studies-{uuid.uuid4().hex}")
    ran = study.run(store, "events", study.signal_steps(samples, triggers, f"{store.root}/work", event="all", crop_s=float(1 << 50)))
    if ran["error"]:
        raise RuntimeError(ran["error"])
    told = {"channel": "string", "latency_ms": "double", "amplitude": "double", "n_epochs": "bigint", "zone": "string"}
    fields = [F.get_json_object("evidence", f"$.{k}").cast(t).alias(k) for k, t in told.items()]
    return store.outputs("events", "findings").select(F.col("ref_key").alias("recording"), *fields, "verdict")


#: Every event as a peak: its value is the latency, its user's number the epochs.
_LATENCIES = "(SELECT event_id AS i, CASE WHEN event_id % 41 = 0 THEN NULL ELSE value END AS latency_ms, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 1.0 END::DOUBLE AS amplitude, (user_id % 20)::INT AS n_epochs FROM events)"


@query(f"""
WITH x AS (SELECT *, CASE WHEN latency_ms IS NULL THEN 'no_peak' WHEN latency_ms BETWEEN 80 AND 120 THEN 'supported' WHEN latency_ms <= 70 THEN 'p50_ambiguous' WHEN latency_ms BETWEEN 170 AND 215 THEN 'p200_ambiguous'
  WHEN latency_ms > 215 THEN 'refutable' WHEN latency_ms < 80 THEN 'off_window_early' ELSE 'off_window_late' END AS zone, coalesce(least(abs(latency_ms - 30), abs(latency_ms - 235)) <= 1, false) AS edge FROM {_LATENCIES} l),
y AS (SELECT *, CASE WHEN edge AND zone <> 'supported' THEN 'inconclusive' WHEN zone = 'supported' THEN 'supported' WHEN zone = 'refutable' THEN 'refuted' ELSE 'inconclusive' END AS first FROM x)
SELECT i, zone, CASE WHEN first = 'refuted' AND (n_epochs < 8 OR amplitude IS NULL) THEN 'inconclusive' ELSE first END AS verdict,
  concat_ws(',', CASE WHEN edge THEN 'boundary_hit' END, CASE WHEN zone LIKE '%ambiguous' THEN 'component_ambiguous' END, CASE WHEN n_epochs < 8 THEN 'low_evidence' END) AS caveats FROM y""")
def latency_zones(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(
        i.alias("i"), F.when(i % 41 != 0, F.col("value")).alias("latency_ms"), F.when(i % 7 != 0, F.lit(1.0)).alias("amplitude"), (F.col("user_id") % 20).cast("int").alias("n_epochs"),
        F.lit(30.0).alias("search_lo_ms"), F.lit(235.0).alias("search_hi_ms"), F.lit(80.0).alias("window_lo"), F.lit(120.0).alias("window_hi"),
    )
    return signal.finding(rows).select("i", "zone", "verdict", F.array_join("caveats", ",").alias("caveats"))


_PLANTED = "CASE WHEN event_id % 500 = 200 THEN 3.0 ELSE 0.0 END"


@query(f"""
WITH s AS (SELECT event_id / 1000::DOUBLE AS t, round(({_PLANTED} + value / 1000) * 1000000)::BIGINT AS amp, event_id % 500 = 100 AS fires FROM events),
e AS (SELECT g.t AS event_t, s.t - g.t AS lag, s.amp FROM s g JOIN s ON s.t BETWEEN g.t - 0.5 AND g.t + 0.5 AND s.t - g.t BETWEEN -0.1 AND 0.3 WHERE g.fires),
b AS (SELECT *, amp - coalesce(floor((sum(CASE WHEN lag <= 0 THEN amp END) OVER w)::DOUBLE / (count(CASE WHEN lag <= 0 THEN amp END) OVER w)), 0)::BIGINT AS adj FROM e WINDOW w AS (PARTITION BY event_t)),
v AS (SELECT floor(round(lag, 6) / 0.001)::BIGINT AS step, floor(sum(adj)::DOUBLE / count(*)) / 1000000 AS amp, count(*) AS n FROM b GROUP BY 1)
SELECT 'MEG1' AS channel, step AS latency_ms, round(amp, 3) AS amp, n FROM v WHERE step BETWEEN 30 AND 235 ORDER BY abs(amp) DESC, step LIMIT 1""")
def golden_signal(spark, d):
    """A peak planted at 100 ms after every trigger, in the events' values as noise, found again."""
    rows = table(spark, d, "events").withColumn("t", F.col("event_id") / 1000)
    planted = F.expr(_PLANTED.replace("3.0", "3.0D").replace("0.0", "0.0D")) + F.col("value") / 1000
    samples = rows.select(F.lit("events").alias("recording"), F.lit("MEG1").alias("channel"), "t", planted.alias("amp"))
    triggers = rows.where("event_id % 500 = 100").select(F.lit("events").alias("recording"), "t", F.lit(1).alias("code"))
    evoked = signal.averaged(signal.baseline_corrected(signal.epochs(samples, triggers)).withColumn("lag", F.round("lag", 6)), 0.001)
    return signal.peak(evoked, 30, 235).select("channel", F.col("lag_step").alias("latency_ms"), F.round("amp", 3).alias("amp"), "n")


# --- catalogue, bibliography, studies

@query("""SELECT 'ds' || lpad(page_id::VARCHAR, 6, '0') AS id, '1.0.' || (page_id % 3) AS latest_tag, length(html)::BIGINT AS size, CASE WHEN page_id % 2 = 0 THEN 'meg,mri' ELSE 'eeg' END AS modalities FROM pages WHERE page_id % 7 <> 0""")
def dataset_catalogue(spark, d):
    i = F.col("page_id")
    snap = F.struct(F.concat(F.lit("1.0."), i % 3).alias("tag"), F.length("html").alias("size"), F.struct(F.when(i % 2 == 0, F.array(F.lit("meg"), F.lit("mri"))).otherwise(F.array(F.lit("eeg"))).alias("modalities")).alias("summary"))
    node = F.when(i % 7 != 0, F.struct(F.concat(F.lit("ds"), F.lpad(i.cast("string"), 6, "0")).alias("id"), snap.alias("latestSnapshot")))
    bodies = table(spark, d, "pages").select(F.to_json(F.struct(node.alias("dataset"))).alias("body"))
    return catalog.datasets(bodies).select("id", "latest_tag", "size", F.array_join("modalities", ",").alias("modalities"))


@query("""SELECT 'ds' || (page_id % 10) AS dataset, '1.0.' || (page_id % 3) AS tag, 'page-' || page_id AS filename, length(url)::BIGINT AS size, url FROM pages WHERE page_id % 3 = 1""")
def dataset_files(spark, d):
    i = F.col("page_id")
    entry = F.struct(F.concat(F.lit("page-"), i).alias("filename"), F.length("url").alias("size"), F.array("url").alias("urls"))
    rows = table(spark, d, "pages").groupBy(F.concat(F.lit("ds"), i % 10, F.lit(":1.0."), i % 3).alias("id")).agg(F.collect_list(entry).alias("files"))
    latest = spark.range(10).select(F.concat(F.lit("ds"), F.col("id")).alias("id"), F.lit("1.0.1").alias("latest_tag"))
    return catalog.files(rows.select(F.to_json(F.struct(F.struct("id", "files").alias("snapshot"))).alias("body")), latest)


@query("SELECT (i - 1)::INT AS position, 'ds' || (page_id * 100 + i) AS id FROM pages, range(1, 21) t(i) WHERE (page_id + i) % 4 <> 0")
def dataset_listing(spark, d):
    """A listing for every page, with more datasets than it shows, of which one in four has no id."""
    page, name = F.col("page_id"), lambda i: F.concat(F.lit("ds"), (F.col("page_id") * 100 + i).cast("string"))
    edges = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.struct(F.struct(F.when((page + i) % 4 != 0, name(i)).alias("id")).alias("node")))
    return catalog.listed(table(spark, d, "pages").select(F.to_json(F.struct(F.struct(edges.alias("edges")).alias("datasets"))).alias("body")))


@query(f"""SELECT 'p' || work AS path, 'Trials of ' || work AS title, 'Author' || (work % 50) || ', Given|Other Person' AS authors, year, '10.5555/' || work AS doi FROM {duck("works")}""")
def bibtex_parse(spark, d):
    w = F.col("work").cast("string")
    body = F.concat(F.lit("@article{key"), w, F.lit(",\n  title = {{Trials} of "), w, F.lit("},\n  author = \"Author"), F.col("work") % 50, F.lit(", Given and Other Person\",\n  year = "), F.col("year"), F.lit(",\n doi={https://doi.org/10.5555/"), w, F.lit("}\n}\n@comment{none}"))
    files = derived(spark, d, "works").select(F.concat(F.lit("p"), w).alias("path"), body.alias("text"))
    return bibtex.parse_bibtex(files).select("path", "title", F.array_join("authors", "|").alias("authors"), "year", "doi")


@query(f"""SELECT 'Trials of ' || work AS title, 'Author' || (work % 50) || ', Given|Other Person' AS authors, year, '10.5555/' || work AS doi FROM {duck("works")}""")
def bibtex_files(spark, d):
    """The works as files of BibTeX, written and read again as lines, whose entries go over lines and splits."""
    w = F.col("work").cast("string")
    lines = [
        F.concat(F.lit("@article{key"), w, F.lit(",")), F.concat(F.lit("  title = {{Trials} of "), w, F.lit("},")), F.concat(F.lit('  author = "Author'), F.col("work") % 50, F.lit(', Given and Other Person",')),
        F.concat(F.lit("  year = "), F.col("year"), F.lit(",")), F.concat(F.lit(" doi={https://doi.org/10.5555/"), w, F.lit("}")), F.lit("}"), F.lit("@comment{none}"),
    ]
    folder = f"{shared_dir(spark)}/bibtex-{uuid.uuid4().hex}"
    derived(spark, d, "works").select(F.array_join(F.array(*lines), "\n").alias("value")).write.text(folder)
    return bibtex.read_references(spark, folder).select("title", F.array_join("authors", "|").alias("authors"), "year", "doi")


@query(f"SELECT ref_id, '10.5555/' || work AS doi FROM {duck('refs')} WHERE ref_id % 4 <> 0")
def doi_list_parse(spark, d):
    rows = derived(spark, d, "refs")
    line = F.when(F.col("ref_id") % 4 == 0, F.lit("# none")).otherwise(F.concat(F.lit("  doi: 10.5555/"), F.col("work")))
    out = bibtex.parse_dois(rows.select(F.col("ref_id").alias("path"), F.concat(F.lit("\n"), line, F.lit("\n\nnothing here\n")).alias("text")))
    return out.select(F.col("path").alias("ref_id"), "doi")


def _store(spark):
    return study.StudyStore(spark, f"{shared_dir(spark)}/studies-{uuid.uuid4().hex}")


@query("""SELECT CASE WHEN l_linenumber <= 3 THEN 'done' WHEN l_linenumber = 4 THEN 'failed' WHEN l_returnflag = 'R' AND l_linenumber = 5 THEN 'skipped' ELSE 'pending' END AS status, count(*) AS n
FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem) x GROUP BY 1""")
def study_status(spark, d):
    """Return flags stand for studies, line numbers for steps."""
    seen = sorted(map(tuple, table(spark, d, "lineitem").select("l_returnflag", "l_linenumber").distinct().collect()))
    store = _store(spark)
    slugs = sorted({s for s, _ in seen})
    store.create_studies([{"slug": s, "plan": [str(n) for t, n in seen if t == s]} for s in slugs])
    for s in slugs:
        names = store.study(s)["plan"]
        store.add_steps(s, names)
        store.set_steps(s, {n: "done" if int(n) <= 3 else "failed" if n == "4" else "skipped" if (s, n) == ("R", "5") else "pending" for n in names})
    return store.step_tally()


@query("SELECT n_nationkey + 1 AS id, n_name AS slug, 'planned' AS status FROM nation ORDER BY n_nationkey DESC LIMIT 20")
def study_recent(spark, d):
    """Nations stand for studies, made in the order of their keys."""
    store = _store(spark)
    store.create_studies([{"slug": r["n_name"]} for r in table(spark, d, "nation").orderBy("n_nationkey").collect()])
    return store.recent(20).select("id", "slug", "status")


@query(_VERIFY + f"SELECT {_FINDING} AS verdict, count(*) AS n FROM v WHERE ref_id % 10 = 6 GROUP BY 1")
def study_bibliography(spark, d):
    """A study of the references without a DOI that stops after its first batch and is resumed."""
    refs = _refs(spark, d).where("ref_id % 10 = 6")
    search, calls = derived(spark, d, "search").withColumn("authors", F.array("family")), []

    def verifier(some):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("stopped")
        return verify.verified(some, _records(spark, d), derived(spark, d, "probes"), verify.best_candidates(some, search))

    store, steps = _store(spark), study.bibliography_steps(refs, verifier, batches=2)
    study.run(store, "refs", steps)
    study.resume(store, "refs", steps)
    return report.tally(store.outputs("refs", "findings"))


@query("""SELECT event_id, '{"success":true,"event_id":' || event_id || ',"level":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE (event_id % 10)::VARCHAR || '.5' END || '}' AS json FROM events""")
def strict_json(spark, d):
    e = F.col("event_id")
    level = F.when(e % 3 == 0, F.lit(float("nan"))).otherwise((e % 10) + 0.5)
    rows = table(spark, d, "events").select("event_id", level.alias("level"))
    return report.envelopes(rows).select(F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), "json")
