from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from probatum.functions import text
from probatum.operators import report, verify
from probatum.plans import catalog

TITLE = "Magnetoencephalography of auditory cortex"
RECORD = "provider string, doi string, outcome string, title string, year int, authors array<string>, retraction string"
REF = "ref_id long, doi string, title string, year int, authors array<string>, url string"
PROBE = "url string, http_status int, archived boolean"
OK = ("crossref", "10.1/a", "ok", TITLE, 2001, ["Müller"], None)


def judge(spark, ref, records=(OK,), probes=(), candidates=None):
    got = verify.verified(spark.createDataFrame([ref], REF), spark.createDataFrame(list(records), RECORD), spark.createDataFrame(list(probes), PROBE), candidates)
    return got.first()


@pytest.mark.parametrize(
    ("ref", "records", "probes", "expected"),
    [
        ((1, "10.1/a", TITLE, 2001, ["Müller, Hans"], None), (OK,), (), {"verdict": "verified", "score": 1.0}),
        ((1, "https://doi.org/10.1/a", "", None, [], None), (OK,), (), {"verdict": "unverifiable", "metadata": "unknown"}),
        ((1, "10.1/a", "Quantum wells under strain xyz", 2001, [], None), (OK,), (), {"metadata": "fail", "verdict": "warnings"}),
        ((1, "10.1/a", "Magnetoencephalography of visual cortices", 2001, [], None), (OK,), (), {"metadata": "warn"}),
        ((1, "10.1/a", TITLE, 1999, [], None), (OK,), (), {"metadata": "warn", "score": 0.79}),
        ((1, "10.1/none", TITLE, 2001, [], None), (OK,), (), {"existence": "fail", "verdict": "not_found", "score": 0.0}),
        ((1, "10.1/a", TITLE, 2001, [], None), ((*OK[:6], "retraction"),), (), {"verdict": "retracted", "score": 0.1}),
        ((1, "10.1/a", TITLE, 2001, [], None), (("datacite", *OK[1:]),), (), {"existence": "pass", "retraction": "unknown", "verdict": "warnings"}),
        ((1, "10.1/a", TITLE, 2001, [], None), (("crossref", "10.1/a", "error", None, None, None, None),), (), {"verdict": "error", "score": None}),
        ((1, "10.1/a", TITLE, 2001, [], "http://x"), (OK,), (), {"url": "unknown", "score": 0.95}),
        ((1, "10.1/a", TITLE, 2001, [], "http://x"), (OK,), (("http://x", 404, False),), {"url": "fail", "verdict": "warnings"}),
        ((1, "10.1/a", TITLE, 2001, [], "http://x"), (OK,), (("http://x", 404, True),), {"url": "warn"}),
        ((1, None, None, None, None, None), (OK,), (), {"existence": "unknown", "verdict": "unverifiable"}),
        ((1, "10.1/a", TITLE, 0, [], None), (OK,), (), {"metadata": "pass", "verdict": "verified"}),
    ],
)
def test_verdicts(spark, ref, records, probes, expected):
    got = judge(spark, ref, records, probes)
    assert {k: got[k] for k in expected} == expected


def test_openalex_flag_fails_a_clean_crossref_record(spark):
    flagged = ("openalex", "10.1/a", "ok", TITLE, 2001, [], "retraction (OpenAlex is_retracted)")
    assert judge(spark, (1, "10.1/a", TITLE, 2001, [], None), (OK, flagged))["verdict"] == "retracted"


def test_score_grid_invariant(spark):
    from probatum.plans import catalog

    axes = [F.explode(F.array(*[F.lit(x) for x in values])).alias(name) for name, (_, _, values) in catalog._AXES.items()] + [F.explode(F.array(F.lit(True), F.lit(False))).alias("url_cited")]
    grid = spark.range(1)
    for axis in axes:
        grid = grid.select("*", axis)
    rows = verify.judged(grid.drop("id"), F.col("url_cited")).collect()
    assert len(rows) == 288 >= len(catalog.queries()["score_grid"](spark, "/root/testdata/sf0.001").collect()) > 200
    assert all((r["score"] >= 0.8) == (r["verdict"] == "verified") for r in rows)
    assert {r["score"] for r in rows if r["verdict"] == "verified"} == {1.0, 0.95}


@pytest.mark.parametrize(("a", "b"), [("Łukasiewicz", "Lukasiewicz"), ("Sørensen", "Sorensen"), ("Müller", "Muller"), ("Weiß", "Weiss"), ("Þór", "Thor"), ("Škoda", "Skoda")])
def test_surnames_fold(spark, a, b):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(text.title(F.col("a")).alias("a"), text.title(F.col("b")).alias("b")).first()
    assert got["a"] == got["b"] == text.plain_title(b)


def test_similarity_is_difflibs_and_asymmetric(spark):
    rows = [("tide", "diet"), ("diet", "tide"), ("abc", "abc"), ("", "x"), ("x" * 250 + "ab", "ab" + "x" * 250)]
    got = spark.createDataFrame(rows, "a string, b string").select(text.title_ratio(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in rows]


def test_title_search_query_cites_every_work(spark):
    got = catalog.QUERIES["title_search_top1"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_envelopes_hold_no_non_finite_number(spark):
    rows = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")])], "id int, x double, y array<double>")
    assert report.envelopes(rows).first()["json"] == '{"success":true,"id":1,"x":null,"y":[1.0,null]}'


def test_references_are_shuffled_for_no_column(spark):
    refs = spark.createDataFrame(
        [("a", "10.1/x", "Über Straßen", 2000, ["Łukasz Żak"], None), ("b", "", "Ærlige svar", 2001, ["Olsen"], None), ("c", None, "Plain words", 2002, [], None), ("d", "10.1/none", "Plain words", 2002, [], None)], REF.replace("long", "string")
    )
    records = spark.createDataFrame([("crossref", "10.1/x", "ok", "uber strassen", 2000, ["Zak, Ł."], None)], RECORD)
    found = spark.createDataFrame(
        [("a", 1.0, "Another title", 1900, ["Nobody"], "retraction"), ("b", 0.9, "aerlige svar", 2001, ["Olsen"], None), ("10.1/none", 1.0, "Plain words", 2002, [], None)],
        "ref_id string, similarity double, title string, year int, authors array<string>, retraction string",
    )
    rows = verify.verified(refs, records, spark.createDataFrame([], PROBE), found)
    got = {r["ref_id"]: (r["existence"], r["metadata"], r["retraction"], r["existence_confidence"]) for r in rows.collect()}
    assert got == {"a": ("pass", "pass", "pass", 0.95), "b": ("pass", "pass", "pass", 0.9), "c": ("unknown", "unknown", "unknown", 0.3), "d": ("fail", "unknown", "unknown", 0.9)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # what is known of a reference, and its link


def test_records_and_candidates_are_not_broadcast(spark):
    refs = spark.createDataFrame([(1, "10.1/a", TITLE, 2001, ["Müller"], None), (2, "", TITLE, 2001, ["Müller"], None)], REF)
    search = spark.createDataFrame([(2, 1, TITLE, 2001, ["Müller"], None)], "ref_id long, rank int, title string, year int, authors array<string>, retraction string")
    best = verify.best_candidates(refs, search)
    rows = verify.looked_up(refs, spark.createDataFrame([OK], RECORD))
    both = verify.verified(refs, spark.createDataFrame([OK], RECORD), spark.createDataFrame([], PROBE), best).select("ref_id", "existence", "metadata")
    assert sorted(map(tuple, both.collect())) == [(1, "pass", "pass"), (2, "pass", "pass")]
    for df, joins in ((best, 1), (rows, 1), (both, 2)):
        df.collect()
        assert df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin ") >= joins
