"""BibTeX files of many splits against whole texts."""

import random

import pytest

from probatum.sources import bibtex


def some_text(rng, n, open_too=True):
    parts = ["@article{k1, title={A {Nested} Title}, year=2020,\n doi={10.1/x}}", "@book{b, title = \"Quoted\",\n author={A and B}}", "@comment{ignored, title={x}}", "stray } brace { and text\n", "mail me @ home\n", "@misc{open, title={never {closed}\n",
             "@string{s = {x}}", "\n\n", "\\{ \\} \\\"{o}", "}", "{", "@", "title={lost}", "@misc{m, title={Größe 中},\n url={http://a.b/c}}"]
    if not open_too:  # an entry that never closes takes all that follows
        parts = [p for p in parts if p != "{" and not p.startswith("@misc{open")]
    return "".join(rng.choice(parts) + rng.choice(["", "\n", " "]) for _ in range(n))


def test_passages_compose_to_the_whole():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("@{}}{a") for _ in range(rng.randrange(40)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        parts = [bibtex.Passage.of(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        whole = bibtex.Passage.of(text)
        left = parts[0].then(parts[1]).then(parts[2]).then(parts[3])
        right = parts[0].then(parts[1].then(parts[2].then(parts[3])))
        for s in range(-1, 12):
            assert left.at(s) == right.at(s) == whole.at(s) == bibtex.Passage.read(left.told()).at(s)


def test_entries_of_a_text_are_the_references():
    rng = random.Random(2)
    for _ in range(200):
        text = some_text(rng, rng.randrange(20))
        found = [r for _, piece, _ in bibtex.entries_in(text, bibtex.OUTSIDE, 0) for r in bibtex.references(piece)]
        assert [x[1:] for x in found] == [x[1:] for x in bibtex.references(text)]


@pytest.mark.parametrize("segment", [40, 1 << 20])
def test_files_of_many_splits_are_whole_files(spark, tmp_path, segment):
    rng = random.Random(3)
    texts = {f"f{i}.bib": some_text(rng, n, i == 1) for i, n in enumerate((400, 150, 3, 0))} | {"long.bib": "@a{x, title={" + "word {b} \n" * 3000 + "}}\n" + some_text(rng, 40, False)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = bibtex.read_references(spark, str(tmp_path), segment).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = spark.createDataFrame([(n, t) for n, t in texts.items()], "path string, text string")
    key = lambda r: (r["path"].rsplit("/", 1)[-1], r["raw"], r["title"], tuple(r["authors"]), r["year"], r["doi"], r["venue"], r["url"])
    expected = sorted(map(key, bibtex.parse_bibtex(want).collect()), key=repr)
    assert sorted(map(key, rows), key=repr) == expected and len(expected) > 100


def test_an_empty_folder_has_no_references(spark, tmp_path):
    (tmp_path / "a.bib").write_text("")
    assert bibtex.read_references(spark, str(tmp_path)).collect() == []
