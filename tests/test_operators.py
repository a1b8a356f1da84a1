import pytest
from pyspark.sql import functions as F

from probatum.functions import detectors
from probatum.operators import compare, fulltext, scan, signal, study
from probatum.sources import bibtex, catalog

HEX = "0123456789abcdef"
POSITIVE = {
    "anthropic-key": "sk-" + "ant-" + "a1B2" * 6, "openai-key": "sk-" + "a1B2c3D4" * 3, "stripe-key": "sk_" + "live_" + "a1B2c3D4" * 2, "github-token": "gh" + "p_" + "a1B2c3D4" * 4,
    "github-fine-grained-pat": "github" + "_pat_" + "a1B2c3D4" * 3, "slack-token": "xox" + "b-" + "1a2b3c4d5e6f", "slack-webhook": "hooks.slack" + ".com/services/" + "T0/B0/" + "a1B2c3D4" * 3,
    "aws-access-key": "AK" + "IA" + "A1B2C3D4E5F6G7H8", "google-api-key": "AI" + "za" + ("a1B2c3D" * 5), "google-oauth-client-secret": "GOC" + "SPX-" + "a1B2c3D4e5", "twilio-sid-or-key": "A" + "C" + HEX * 2,
    "sendgrid-key": "S" + "G." + "a1B2c3D4" * 2 + "." + "e5F6g7H8" * 2, "notion-token": "nt" + "n_" + "a1B2c3D4" * 3, "private-key-block": "-----BEGIN RSA PRIV" + "ATE KEY-----", "jwt": "ey" + "J" + "a1B2c3D4e5" + "." + "f6G7h8I9j0" + "." + "k1L2m3",
    "bearer-token": "Bea" + "rer " + "a1B2c3D4" * 3, "basic-auth": "Authoriz" + "ation: Basic " + "a1B2c3D4" * 3, "connection-string-credentials": "db://me:" + "s3cr3t@host",
    "hardcoded-credential": "pass" + "word = 'a1B2c3D4e5F6g7H8'", "hardcoded-credential-unquoted": "api_" + "key: a1B2c3D4e5F6g7H8", "email": "someone@" + "site.org", "us-phone": "212-" + "555-" + "0187",
    "intl-phone": "+" + "442071838750", "ssn": "123-" + "45-" + "6789", "credit-card": "4111 1111 " + "1111 1111", "ipv4": "10.2" + ".3.44",
}


def hits(spark, *texts, **kw):
    rows = scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), **kw).collect()
    return [(r["doc_id"], r["label"], r["match"]) for r in rows]


def test_every_detector_has_a_positive_control(spark):
    assert set(POSITIVE) == {d.label for d in detectors.DETECTORS}
    got = {(i, label) for i, label, _ in hits(spark, *[f"see {t} here" for t in POSITIVE.values()])}
    assert {(i, label) for i, label in enumerate(POSITIVE)} <= got


def test_placeholders_identifiers_and_bad_checksums_are_no_hits(spark):
    texts = ["sk-" + "ant-" + "x" * 24, "api_" + "key = someFunctionNameWithLetters", "4111 1111 1111 1112", None, ""]
    assert hits(spark, *texts, labels=("anthropic-key", "hardcoded-credential-unquoted", "credit-card")) == []


def test_allow_list_looks_inside_the_match(spark):
    got = hits(spark, "a@" + "example.com and b@" + "site.org", labels=("email",), allowed=("example.com",))
    assert [m for _, _, m in got] == ["b@" + "site.org"]


def test_split_ids_ignore_order_and_notice_a_swap(spark):
    rows = [("x", str(i)) for i in range(30)] + [("y", str(i)) for i in reversed(range(30))] + [("z", str(i)) for i in range(1, 31)]
    got = {r["split"]: r["split_id"] for r in compare.split_ids(spark.createDataFrame(rows, "split string, item string")).collect()}
    assert got["x"] == got["y"] != got["z"]
    assert len(got["x"]) == 12


def test_criterion_tells_null_from_absent():
    assert compare.criterion({"a": None, "b": 1}) != compare.criterion({"b": 1})
    assert compare.criterion({"a": 1, "b": True}) == compare.criterion({"b": 1.0, "a": 1.0})
    with pytest.raises(compare.NotComparable):
        compare.criterion({})


ARM = "name string, split_id string, n_units int, criterion string, provenance string"
METRIC = "name string, role string, metric string, value double"


def test_compare_refuses_or_answers(spark):
    arms = spark.createDataFrame([("a", "s", 10, "c", ""), ("b", "s", 10, "c", ""), ("c", "t", 10, "k", ""), ("d", "s", 9, "c", ""), ("e", "s", None, "c", "")], ARM)
    metrics = spark.createDataFrame([(n, "test", "f1", v) for n, v in (("a", 0.75), ("b", 0.5), ("e", 0.25))], METRIC)
    assert compare.compare(arms, metrics, "a", "b", "test", "f1") == 0.25
    assert compare.compare(arms, metrics, "a", "e", "test", "f1") == 0.5
    for other, reason in (("c", "split, criterion"), ("d", "n_units")):
        with pytest.raises(compare.NotComparable, match=reason):
            compare.compare(arms, metrics, "a", other, "test", "f1")
    with pytest.raises(compare.NotComparable, match="role"):
        compare.compare(arms, metrics, "a", "b", "valid", "f1")


@pytest.mark.parametrize(("f1", "interior"), [([0.9, 0.5, 0.1], False), ([0.1, 0.5, 0.9], False), ([0.1, 0.9, 0.5], True), ([0.5], True), ([0.9, 0.9, 0.1], False)])
def test_sweep_interior(spark, f1, interior):
    rows = spark.createDataFrame([("r", i / 10, v) for i, v in enumerate(f1)], "run string, threshold double, f1 double")
    assert compare.sweep_interior(rows, "threshold", "f1").first()["interior"] is interior


PEAK = "latency_ms double, amplitude double, n_epochs int, search_lo_ms double, search_hi_ms double, window_lo double, window_hi double"


@pytest.mark.parametrize(
    ("latency", "amplitude", "n", "hi", "zone", "verdict", "caveats"),
    [
        (70.0, 1.0, 40, 235.0, "p50_ambiguous", "inconclusive", ["component_ambiguous"]), (70.1, 1.0, 40, 235.0, "off_window_early", "inconclusive", []),
        (100.0, 1.0, 40, 235.0, "supported", "supported", []), (140.0, 1.0, 40, 235.0, "off_window_late", "inconclusive", []),
        (215.0, 1.0, 40, 235.0, "p200_ambiguous", "inconclusive", ["component_ambiguous"]), (215.1, 1.0, 40, 235.0, "refutable", "refuted", []),
        (225.0, 1.0, 7, 235.0, "refutable", "inconclusive", ["low_evidence"]), (225.0, None, 40, 235.0, "refutable", "inconclusive", []), (225.0, 1.0, 8, 235.0, "refutable", "refuted", []),
        (30.0, 1.0, 40, 235.0, "p50_ambiguous", "inconclusive", ["boundary_hit", "component_ambiguous"]), (100.0, 1.0, 40, 150.0, "supported", "supported", ["unfalsifiable_late"]),
        (None, None, 0, 235.0, "no_peak", "inconclusive", ["low_evidence"]),
    ],
)
def test_findings(spark, latency, amplitude, n, hi, zone, verdict, caveats):
    got = signal.finding(spark.createDataFrame([(latency, amplitude, n, 30.0, hi, 80.0, 120.0)], PEAK)).first()
    assert (got["zone"], got["verdict"], got["caveats"]) == (zone, verdict, caveats)


def test_golden_study_runs_and_resumes(spark, tmp_path):
    samples, triggers = signal.synthetic(spark)
    store = study.StudyStore(spark, str(tmp_path / "store"))
    out = study.run(store, "golden", study.signal_steps(samples, triggers, str(tmp_path / "work")))
    assert out["status"] == "done"
    assert out["results"]["validate_finding"]["latency_ms"] == 100.0
    assert store.outputs("golden", "findings").first()["verdict"] == "supported"


def test_a_failed_step_blocks_and_resume_skips_done_ones(spark, tmp_path):
    calls = []

    def step(name, fail=False):
        def fn(ctx):
            calls.append(name)
            if fail and calls.count(name) == 1:
                raise ValueError("once")
            return study.StepResult({"n": len(calls)})

        return study.Step(name, fn)

    store, steps = study.StudyStore(spark, str(tmp_path)), [step("a"), step("b", True), step("c")]
    first = study.run(store, "s", steps)
    assert (first["status"], first["unfinished_steps"]) == ("blocked", ["c"])
    again = study.resume(study.StudyStore(spark, str(tmp_path)), "s", steps)
    assert (again["status"], calls) == ("done", ["a", "b", "b", "c"])
    assert [r["error"] for r in store.steps("s")] == [None] * 3
    assert store.create_study("s", title="other")["title"] == ""


def test_bibtex(spark):
    text = r"""@article{k1, title = {A {Nested} Title}, author={M\"uller, Hans and S\o rensen, Ida}, year = "in 2020", journal=Nature, doi = {https://doi.org/10.1/x}}
    @comment{skip} @book{k2, title="Quoted", booktitle = {B}, year = 1999,} @misc{k3}"""
    got = bibtex.parse_bibtex(spark.createDataFrame([("p", text), ("q", None)], "path string, text string")).collect()
    assert [(r["title"], r["authors"], r["year"], r["doi"], r["venue"]) for r in got] == [
        ("A Nested Title", ["Müller, Hans", "Sørensen, Ida"], 2020, "10.1/x", "Nature"), ("Quoted", [], 1999, "", "B")
    ]


def test_files_of_either_kind(spark):
    rows = [("a.bib", "10.1234/only a list"), ("b.txt", "# c\n doi: 10.1234/x \n\nnone"), ("c", "@a{k, title={T}, doi=10.5/z}")]
    got = {(r["path"], r["doi"]) for r in bibtex.parse_any(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("a.bib", "10.1234/only a list"), ("b.txt", "10.1234/x"), ("c", "10.5/z")}


def test_provider_json(spark):
    rows = [
        ("crossref", "10.1/a", "ok", '{"message":{"title":["T"],"author":[{"family":"F"}],"issued":{"date-parts":[[2001]]},"updated-by":[{"type":"retraction","label":""}]}}'),
        ("crossref", "10.1/b", "ok", '{"title":"Bare","relation":{"is-retracted-by":[{"id":"x"}]}}'), ("openalex", "10.1/c", "ok", '{"id":"W1","display_name":"T","is_retracted":true}'),
        ("openalex", "10.1/d", "ok", "{}"), ("datacite", "10.1/e", "ok", '{"data":{"attributes":{"titles":[{"title":"D"}],"publicationYear":2020,"creators":[{"name":"N"}]}}}'), ("crossref", "10.1/f", "error", None),
    ]
    got = {r["doi"]: r for r in catalog.normalized(spark.createDataFrame(rows, "provider string, key string, outcome string, body string")).collect()}
    assert (got["10.1/a"]["title"], got["10.1/a"]["year"], got["10.1/a"]["authors"], got["10.1/a"]["retraction"]) == ("T", 2001, ["F"], "retraction")
    assert (got["10.1/b"]["title"], got["10.1/b"]["retraction"]) == ("Bare", "is-retracted-by")
    assert got["10.1/c"]["retraction"] == "retraction (OpenAlex is_retracted)"
    assert (got["10.1/d"]["outcome"], got["10.1/f"]["outcome"], got["10.1/e"]["year"], got["10.1/e"]["retraction"]) == ("absent", "error", 2020, None)


LOC = "provider string, doi string, outcome string, is_oa boolean, oa_status string, pdf_url string, landing_url string"


@pytest.mark.parametrize(
    ("doi", "rows", "email", "expected"),
    [
        ("10.1/a", [("openalex", "10.1/a", "ok", True, "gold", "http://p", "")], True, ("openalex", True, "gold", "oa")), ("10.1/a", [("openalex", "10.1/a", "ok", False, "", "", "")], True, ("", False, "closed", "none")),
        ("10.1/a", [("unpaywall", "10.1/a", "ok", True, "green", "", "http://l")], True, ("unpaywall", True, "green", "oa")), ("10.1/a", [("unpaywall", "10.1/a", "ok", True, "green", "", "http://l")], False, ("", False, "", "none")),
        ("10.48550/arXiv.1.2", [], True, ("arxiv", True, "green", "oa")), ("10.1/a", [("openalex", "10.1/a", "error", None, None, None, None)], True, ("", False, "unknown", "incomplete")), ("", [], True, ("", False, "", "none")),
    ],
)
def test_full_text(spark, doi, rows, email, expected):
    got = fulltext.located(spark.createDataFrame([(1, doi)], "ref_id long, doi string"), spark.createDataFrame(rows, LOC), email).first()
    assert (got["source"], got["is_oa"], got["oa_status"], got["message"]) == expected


def test_stream_verifies_each_reference_once(spark, tmp_path):
    from probatum.streaming.verify import verified_stream

    schema = "ref_id long, doi string, title string, year int, authors array<string>, url string, seen_at timestamp"
    rows = spark.createDataFrame([(1, "10.1/a", "T", 2001, [], None), (2, "10.1/a", "T", 2001, [], None)], schema.rsplit(", ", 1)[0]).withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    records = spark.createDataFrame([("crossref", "10.1/a", "ok", "T", 2001, ["x"], None)], "provider string, doi string, outcome string, title string, year int, authors array<string>, retraction string")
    probes = spark.createDataFrame([], "url string, http_status int, archived boolean")
    q = verified_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), records, probes).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["verdict"] for r in spark.sql("select * from seen").collect()] == ["verified"]


def test_patterns_that_ignore_case_skip_rows_without_their_words(spark):
    from probatum.functions.detectors import DETECTORS
    from probatum.operators import scan

    texts = ["Authorization: BASIC abcdefgh12345678", "BEARER abcdefghij0123456789xyz", "Client_Secret = 'abcdefgh12345678'", "API-KEY: abcdefgh12345678", "pWd=abcdefgh12345678", "nothing at all"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["id"], r["label"]) for r in scan.scanned(rows).collect()}
    assert {(0, "basic-auth"), (1, "bearer-token"), (2, "hardcoded-credential"), (3, "hardcoded-credential-unquoted"), (4, "hardcoded-credential-unquoted")} <= got
    assert not any(i == 5 for i, _ in got)
    for d in DETECTORS:
        if d.pattern.startswith("(?i)"):
            assert "lower(text)" in rows.select(scan.hits_of(rows["text"], d))._jdf.queryExecution().optimizedPlan().toString()
