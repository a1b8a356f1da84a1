import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from probatum.operators import compare, provenance, recordings, registry, report, scan, study, verify
from probatum.operators.compare import NotComparable
from probatum.sources import collectors, live

CRITERION = registry.Criterion.of(note="as told", iou=0.5)
FILE = {"results_by_method": {"m": {"parameters": {"threshold": 0.5}, "aggregate": {"test": {"tp": 3, "fn": 1, "f1": 0.75}}}}, "test_items": ["b", "a"], "matching_criteria": {"iou": 0.5, "method": "prose"}, "best_method": "m"}


def test_criteria():
    assert CRITERION == registry.Criterion.of(iou=0.5, note="else") and hash(CRITERION) == hash(registry.Criterion.of(iou=0.5))
    assert CRITERION != registry.Criterion.of(iou=0.5, x=None) and CRITERION.get("iou") == 0.5 and CRITERION.as_dict() == {"iou": 0.5, "note": "as told"}
    with pytest.raises(NotComparable):
        registry.Criterion.of()
    with pytest.raises(NotComparable, match="classes"):
        registry.Criterion.read({"iou": 1}, ["iou", "classes"])


def test_arms_from_files(spark):
    known = registry.Registry()
    arm = known.read("new", "/x/r.json", json.dumps(FILE), ["iou"], "m", lambda rows, threshold: (rows, threshold), operator=">=")
    assert (arm.split.n_units, arm.split.split_id, arm.metric("f1"), arm.run(1)) == (4, compare.split_id(["a", "b"]), 0.75, (1, 0.5))
    assert arm.counts() == {"tp": 3, "fn": 1} and arm.provenance == {"params": "r.json#/results_by_method/m/parameters", "metrics": "r.json#/results_by_method/m/aggregate/test", "split": "r.json#/test_items", "criterion": "r.json#/matching_criteria", "criterion.operator": "asserted, not in the file"}
    for bad in (lambda: arm.metric("f1", "train"), lambda: arm.metric("auc"), lambda: arm.run(1, threshold=1), lambda: known.get("none"), lambda: known.read("new", "r", json.dumps(FILE), ["iou"], "m")):
        with pytest.raises(NotComparable):
            bad()
    for drop, match in (("test_items", "test_items"), ("matching_criteria", "matching_criteria/iou"), ("results_by_method", "m/parameters, results_by_method/m/aggregate/test")):
        with pytest.raises(NotComparable, match=match):
            known.read("y", "r", json.dumps({k: v for k, v in FILE.items() if k != drop}), ["iou"], "m")
    with pytest.raises(NotComparable, match="not take"):
        known.register("odd", ["a"], CRITERION, "s", params={"zeta": 1}, fn=lambda rows: rows)
    with pytest.raises(NotComparable, match="criterion"):
        known.register("odd", ["a"], "iou > 0.5", "s")
    known.register("old", ["a", "b"], arm.criterion, "s", n_units=4, metrics={"test": {"f1": 0.5}}, provenance={"x": "asserted by hand"})
    known.register("far", [f"m{i}" for i in range(9)], arm.criterion, "s")
    assert known.names() == ["far", "new", "old"] and "threshold" in str(arm)
    assert known.difference("new", "old") == {"a": "new", "b": "old", "metric": "f1", "a_value": 0.75, "b_value": 0.5, "delta": 0.25, "asserted": ["new.criterion.operator", "old.x"]}
    with pytest.raises(NotComparable, match="and 6 more"):
        known.difference("new", "far")
    arms, metrics = known.frames(spark)
    assert (arms.count(), metrics.count()) == (3, 4)
    with pytest.raises(NotComparable):
        registry.Split.holding("abc")
    known.clear()
    assert known.names() == []


def test_provenance(spark, tmp_path):
    when = datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)
    assert provenance.stamped("/a/b.tar.json", when) == "/a/b.tar.20240102T030405Z.json"
    seeds = provenance.seeded(7)
    assert seeds["seed"] == 7 and seeds["seeded"][:2] == ["random", "numpy"]
    block = provenance.provenance(seeds, cap=3)
    assert block["cap"] == 3 and block["python"].count(".") == 2
    rows = spark.createDataFrame([(1, 0.5)], "id int, f1 double")
    target = provenance.write_stamped(rows, str(tmp_path / "out.json"), block, when)
    assert spark.read.json(target).first()["provenance"]["seed"] == "7"
    with pytest.raises(Exception, match="exists"):
        provenance.write_stamped(rows, str(tmp_path / "out.json"), block, when)
    for run in ("r1", "r2"):
        provenance.results_index(spark, str(tmp_path / "index"), run, {"f1": 0.5, "tp": 3}, block)
    assert spark.read.parquet(str(tmp_path / "index")).count() == 4


def test_lookups_have_three_outcomes(spark):
    waits, answers = [], {"ok": [live.Answer(200, b"{}")], "gone": [live.Answer(404)], "busy": [live.Answer(429, headers={"Retry-After": "7"}), live.Answer(503), live.Answer(200, b"x")], "down": [live.Answer(None, error="E")] * 9, "no": [live.Answer(403)] * 9}
    left = {k: list(v) for k, v in answers.items()}
    got = {k: live.looked_up(k, lambda url, **_: left[url].pop(0), sleep=waits.append) for k in answers}
    assert {k: v[0] for k, v in got.items()} == {"ok": "ok", "gone": "absent", "busy": "ok", "down": "error", "no": "error"}
    assert waits == [7.0, 2.0, 1.0, 2.0] and len(left["no"]) == 8
    assert live.wait_before(0, {"Retry-After": "900"}) == 60.0
    heads = {"HEAD": live.Answer(405), "GET": live.Answer(200, url="http://y")}
    assert live.probed("http://x", lambda url, method, timeout: heads[method]) == (200, "http://y", None)
    with pytest.raises(ValueError, match="GraphQL"):
        live.queried("u", "q", transport=lambda *a, **k: live.Answer(200, b'{"errors":[1]}'))
    rows = spark.createDataFrame([("crossref", "10.1/a", "u")], "provider string, key string, url string")
    assert live.responses(rows, lambda url, **_: live.Answer(404)).first()["outcome"] == "absent"
    files = spark.createDataFrame([("d", "f", "u"), ("d", "g", "")], "dataset string, filename string, url string")
    assert live.download(files, "d", "f", lambda *a, **k: live.Answer(200, b"bytes")) == b"bytes"
    for name in ("g", "h"):
        with pytest.raises(LookupError):
            live.download(files, "d", name)


def test_collectors(spark):
    assert collectors.names() == ["stub"] and collectors.get("none") is None
    assert collectors.get("stub")().collect(spark, "q").count() == 0
    with pytest.raises(TypeError):
        collectors.register("bad", object)


def test_lines_with_the_marker_are_exempt(spark):
    text = "in /home/me/x\r\nin /Users/me <!-- ok -->\nno/home/me and `/home/you`\rsite7_2024-01-02.wav\n" + "7" * 18 + "\n" + "7" * 20 + "\n/opt/data/x"
    docs = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "", "c")], "doc_id long, text string, label_of string")
    hits = lambda **kw: sorted((r["doc_id"], r["line"], r["label"]) for r in scan.line_hits(docs, **kw).collect())
    kept = [(1, 1, "operator-host-path"), (1, 4, "raw-data-filename"), (1, 5, "chat-platform-snowflake")]
    assert hits(marker="<!-- ok -->") == kept
    assert hits() == sorted([*kept, (1, 2, "operator-host-path")])
    assert hits(shapes={"own": ("opt/data", "w")}) == [(1, 7, "own")]


def test_units_of_a_sweep_are_constant_or_not(spark):
    rows = [("a", 1, 2), ("a", 2, 1), ("b", 1, 2), ("b", 1, 1), ("c", 1, None)]
    got = {r["run"]: (r["points"], r["least"], r["most"], r["constant"]) for r in compare.constant_units(spark.createDataFrame(rows, "run string, tp int, fn int")).collect()}
    assert got == {"a": (2, 3, 3, True), "b": (2, 2, 3, False), "c": (1, None, None, False)}


def test_gate(spark, tmp_path):
    key = "AK" + "IA" + "A1B2C3D4E5F6G7H8"
    (tmp_path / "docs").mkdir()
    (tmp_path / "tests").mkdir()
    (tmp_path / "docs" / "a.txt").write_text(f"key {key}")
    (tmp_path / "tests" / "t.txt").write_text(f"key {key}")
    (tmp_path / "README.md").write_text("see [a](docs/a.txt#x), [gone](./docs/none.md), [web](https://x.org)")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    files = scan.tree(spark, str(tmp_path)).cache()
    assert {r["path"]: r["text"] is None for r in files.collect()} == {"docs/a.txt": False, "tests/t.txt": False, "README.md": False, "b.bin": True}
    config = scan.load_config(spark, str(tmp_path)) | {"deterministic": {"skip_paths": ["tests/"], "allow_substrings": []}}
    got = scan.gate(files, config)
    assert (got["exit_code"], [h["path"] for h in got["hits"]], got["ran"]) == (1, ["docs/a.txt"], False)
    assert scan.gate(files, config, only=True, required=True)["exit_code"] == 2 == scan.gate(files, config, required=True)["exit_code"]
    clean = files.where("path = 'README.md'")
    assert scan.gate(clean, config, only=True) == {"exit_code": 0, "hits": [], "flagged": [], "ran": None, "error": None}
    assert scan.gate(clean, config, spark.createDataFrame([("README.md", True)], "path string, flagged boolean"))["flagged"] == ["README.md"]
    assert [(r["path"], r["target"]) for r in scan.broken_links(files, files).collect()] == [("README.md", "./docs/none.md")]
    (tmp_path / "scan.config.json").write_text('{"sensitive_prefixes": ["x/"]}')
    assert scan.load_config(spark, str(tmp_path)) == {"sensitive_prefixes": ["x/"]}
    assert scan.verdict_in('prose {"a": {1}} ```{"flagged": false, "r": []}``` {x}') == {"flagged": False, "r": []}
    with pytest.raises(ValueError, match="flagged"):
        scan.verdict_in("{}")
    for _ in range(2):
        held = scan.archived(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "c string"), "c", str(tmp_path / "archive"))
    assert held.count() == 2


def test_title_search_takes_the_best_of_five(spark):
    refs = spark.createDataFrame([(1, "Deep sleep and memory"), (2, ""), (3, "Ärger über Größe")], "ref_id long, title string")
    found = [(1, 1, "Sleep"), (1, 2, "Deep sleep & memories"), (1, 3, "Deep sleep, and memory!"), (1, 4, "deep sleep and memory"), (1, 6, "Deep sleep and memory"), (2, 1, "x"), (3, 1, "Aerger uber Grosse")]
    search = spark.createDataFrame([(r, k, t, 2000, [], None) for r, k, t in found], "ref_id long, rank int, title string, year int, authors array<string>, retraction string")
    got = {r["ref_id"]: (round(r["similarity"], 3), r["title"]) for r in verify.best_candidates(refs, search).collect()}
    from difflib import SequenceMatcher

    assert got == {1: (1.0, "Deep sleep, and memory!"), 3: (round(SequenceMatcher(None, "arger uber grosse", "aerger uber grosse").ratio(), 3), "Aerger uber Grosse")}


def test_reports(spark):
    rows = [(1, "Deep", "10/a", "verified", 1.0, "pass"), (2, "Gone", "10/b", "retracted", 0.1, "pass"), (3, "Odd", "10/c", "warnings", 0.5, "fail"), (4, "Err", "10/d", "error", None, "unknown")]
    df = spark.createDataFrame(rows, "ref_id int, label string, doi string, verdict string, score double, metadata string")
    got = json.loads(report.json_report(df))
    assert (got["count"], got["verified"], got["errors"], got["attention"]) == (4, 3, 1, 2)
    assert [f["reason"] for f in got["needs_attention"]] == ["retracted", "metadata_mismatch", "error"] and len(got["results"]) == 4
    assert report.text_report(df)[:2] == ["[ok] Deep (1.00)", "[retracted] Gone (0.10)"] and report.text_report(df)[-3:] == ["  Gone: retracted", "  Odd: metadata_mismatch", "  Err: error"]
    assert (report.exit_code(df), report.exit_code(df.where("ref_id = 1")), report.exit_code(None)) == (1, 0, 2)
    rolled = report.rolled_up(df).first()
    assert rolled["by_verdict"] == {"verified": 1, "retracted": 1, "warnings": 1, "error": 1} and rolled["total"] == 4
    names = spark.createDataFrame([("T", "d", "r"), ("", "d", "r"), (None, "", "r" * 60), ("", None, "")], "t string, d string, r string").select(report.label(F.col("t"), F.col("d"), F.col("r")))
    assert [r[0] for r in names.collect()] == ["T", "d", "r" * 50, "(no id)"]


def test_a_stopped_bibliography_keeps_what_it_verified(spark, tmp_path):
    refs = spark.range(40).withColumnRenamed("id", "ref_id")
    seen = []

    def verifier(some):
        seen.append(sorted(r["ref_id"] for r in some.collect()))
        if len(seen) == 2:
            raise OSError("stopped")
        return some.select("ref_id", F.lit("verified").alias("verdict"), F.lit(1.0).alias("score"))

    store, steps = study.StudyStore(spark, str(tmp_path)), study.bibliography_steps(refs, verifier, batches=3)
    assert study.run(store, "s", steps)["status"] == "blocked"
    assert store.outputs("s", "findings").count() == 0 < store.outputs("s", "findings", under_way=True).count()
    out = study.resume(store, "s", steps)
    assert out["status"] == "done" and out["results"]["summarize"] == {"supported": 40, "total": 40, "by_verdict": {"verified": 40}}
    assert seen[2] == [] and sorted(x for s in (seen[0], seen[3], seen[4]) for x in s) == list(range(40))
    assert store.outputs("s", "findings").select("ref_key").distinct().count() == 40
    assert store.study(1)["slug"] == "s" and store.study("none") is None and store.step("s", "summarize")["result"]["total"] == 40
    assert recordings.missing_stages(object()) == list(recordings.STAGES)
