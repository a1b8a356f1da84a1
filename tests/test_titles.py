"""Title search over all records, against difflib on all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from probatum.functions import text
from probatum.operators import titles
from probatum.plans.fixtures import derived

REF, WORK = "ref_id long, title string, doi string", "doi string, title string, cited string"


def brute(refs, works, least):
    known = {}
    for doi, t in works:
        if p := text.plain_title(t):
            known[p] = min(known.get(p, doi or ""), doi or "")
    out = {}
    for ref, t in refs:
        cited = text.plain_title(t)
        if cited and known:
            s, _, doi = min((-text.similarity(cited, k), abs(len(k) - len(cited)), doi) for k, doi in known.items())
            if -s >= least:
                out[ref] = (-s, doi)
    return out


def found(spark, refs, works, least, **kw):
    got = titles.best_titles(spark.createDataFrame([(*r, "x") for r in refs], REF), spark.createDataFrame([(*w, "x") for w in works], WORK), least, **kw).collect()
    assert len({r["ref_id"] for r in got}) == len(got)
    return {r["ref_id"]: (r["similarity"], r["doi"]) for r in got}


def edited(rng, title, n):
    t = list(title)
    for _ in range(n):
        if not t:
            return "ab"
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        t[i : i + 1] = [[], [t[i], rng.choice("abcxyz ")], [rng.choice("abcxyz ")]][kind]
    return "".join(t)


def some(seed, n=120, k=60):
    rng = random.Random(seed)
    words = ["sleep", "memory", "deep", "mice", "trials", "of", "a", "the", "Über", "naïve", "field", "dependence", "cortex", "中文", "rhythm", "42"]
    works = [(f"10.1/{i:03}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for i in range(n)]
    refs = [(i, edited(rng, rng.choice(works)[1], rng.randrange(6))) for i in range(k)]
    return refs, works


@pytest.mark.parametrize("least", [0.0, 0.6])
def test_best_titles_are_difflibs(spark, least):
    refs, works = some(1)
    refs += [(900, ""), (901, None), (902, "!!"), (903, "ab"), (904, "zz"), (905, works[0][1]), (906, " ".join(w[1] for w in works[:12]))]
    works += [(None, works[3][1]), ("10.1/z", works[4][1]), ("10.2/empty", None), ("10.2/long", " ".join(w[1] for w in works[:12]) + " more"), ("10.2/one", "a")]
    want = brute(refs, works, least)
    assert found(spark, refs, works, least, cited_block=16, known_block=32) == want
    assert found(spark, refs, works, least, postings=3) == want  # few postings: most titles go to the blocks


def test_a_typo_in_the_first_word_is_found_by_the_index(spark):
    refs, works = [(1, "Seep sleep and memory of mice in the field"), (2, "Deepq sleep and memory of mice in a lab")], [("10.1/a", "Deep sleep and memory of mice in the field"), ("10.1/b", "Deep sleep and memory of mice in a lab"), ("10.1/c", "Other")]
    assert found(spark, refs, works, 0.6) == brute(refs, works, 0.6) and found(spark, refs, works, 0.6)[1][1] == "10.1/a"


def test_bounds_hold_for_any_pair():
    rng = random.Random(3)
    known = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    codes = titles.Codes(known)
    for _ in range(60):
        cited = "".join(rng.choice("abcdf é") for _ in range(rng.randrange(1, 200)))
        own = codes.of(cited)
        letters, order = codes.common_letters(own), codes.common_subsequence(own, np.arange(len(known)))
        for k, a, b in zip(known, letters, order, strict=True):
            row = [0] * (len(k) + 1)
            for x in cited:
                diagonal = 0
                for j, y in enumerate(k, 1):
                    diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
            assert b == row[-1]
            matched = sum(m.size for m in SequenceMatcher(None, cited, k).get_matching_blocks())
            assert matched <= b <= a


def test_the_index_misses_no_near_title(spark):
    """Titles with up to UNMATCHED unmatched letters share a chosen q-gram, whatever the edits."""
    rng = random.Random(5)
    works = [(f"10.1/{i:03}", "".join(rng.choice("abcdefgh ") for _ in range(60)).strip()) for i in range(80)]
    refs = []
    for i in range(120):
        t = list(works[i % 80][1])
        for _ in range(2):  # two letters wrong: four unmatched
            t[rng.randrange(len(t))] = "z"
        refs.append((i, "".join(t)))
    assert found(spark, refs, works, 0.6) == brute(refs, works, 0.6)


def test_a_hot_gram_and_equal_titles_stay_whole(spark):
    works = [(f"10.1/{i:04}", f"the very same long beginning of a title number {i}") for i in range(300)] + [("10.0/x", "the very same long beginning of a title number 7")]
    refs = [(i, f"the very same long beginning of a titel number {i}") for i in range(0, 300, 10)] + [(1000 + i, works[0][1]) for i in range(5)]
    assert found(spark, refs, works, 0.6, postings=40) == brute(refs, works, 0.6)


def test_empty_tables(spark):
    assert found(spark, [], [("10.1/a", "a title")], 0.6) == {}
    assert found(spark, [(1, "a title")], [], 0.0) == {}


def test_search_of_whole_tables_is_all_pairs(spark):
    works = derived(spark, "/root/testdata/sf0.001", "works").select("work", "doi", "title").collect()
    rng = random.Random(8)
    refs = [(w["work"], edited(rng, w["title"], 1 + w["work"] % 9)) for w in works]
    pairs = [(w["doi"], w["title"]) for w in works]
    assert found(spark, refs, pairs, 0.6) == brute(refs, pairs, 0.6)


def test_blocks_grow_so_that_what_meets_does_not_grow_faster_than_the_titles(monkeypatch):
    import pandas as pd

    met = lambda n: (-(-n // titles.block_size(n, titles.CITED_BLOCK))) * n + (-(-n // titles.block_size(n, titles.KNOWN_BLOCK))) * n
    assert met(1_200_000) <= 10.5 * met(120_000)  # titles in all pairs of blocks
    assert titles.block_size(10, 128) == 128 and titles.block_size(1 << 40, 128) == titles.LARGEST
    monkeypatch.setattr(titles, "KNOWN_BLOCK", 3)
    known = sorted((f"title {i}{'x' * (i % 4)}" for i in range(20)), key=len)
    pair = {"part": 0, "cited": ["title 7xxy", "title 1"], "least": [0.0, 0.5], "block": 1, "known": known, "dois": [f"d{t}" for t in known]}
    got = pd.concat(titles._blocks_compared([pd.DataFrame([pair])]))
    codes = titles.Codes(known)
    for cited, least in zip(pair["cited"], pair["least"], strict=True):
        best = got[got["cited"] == cited].sort_values(["similarity", "apart", "doi"], ascending=[False, True, True]).iloc[0]
        assert tuple(best[["similarity", "apart", "doi"]]) == titles.best_of_block(cited, codes, known, pair["dois"], least)


def test_the_tree_finds_all_that_reach_a_similarity():
    rng = random.Random(11)
    for letters in ("abcd é", "ab"):
        known = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 30, 70, 140]))) for _ in range(60)}, key=len)
        cited = sorted({t for k in known[:40] if (t := edited(rng, k, rng.randrange(5)))})
        dois = [f"d{rng.randrange(9)}" for _ in known]
        codes, tree = titles.Codes(known), titles.Tree(known)
        for least in (0.96, 0.85, 0.4):
            got = {c: tuple(found) for c, *found in titles.best_reaching(cited, tree, dict(zip(known, dois, strict=True)), least)}
            assert got == {c: f for c in cited if (f := titles.best_of_block(c, codes, known, dois, least))}


def test_titles_that_begin_alike_are_compared_once(monkeypatch):
    """What the tree looks at for a title grows with what its records don't share, and not with all their letters."""
    known = [f"trials of {a} {b} by brand {c} {i}" for i, (a, b, c) in enumerate((a, b, c) for a in ("cold", "hot", "large") for b in ("bolt", "plate", "ring", "gear") for c in range(300))]
    tree, looked, least = titles.Tree(known), [], titles._LEAST
    monkeypatch.setattr(titles, "_LEAST", type("Counted", (), {"__getitem__": lambda self, at: (looked.append(len(at)), least[at])[1]})())
    cited = known[1234].replace("bolt by", "bt")
    who, which, _ = tree.reaching([cited], 0.85)
    assert known[1234] in {tree.titles[j] for j in which} and sum(looked) < sum(map(len, known)) / 10


def test_near_titles_need_no_index_of_all_titles(spark, monkeypatch):
    refs, works = [(i, f"trials of hot bt brand 7 {i}") for i in range(200)], [(f"10.1/{i}", f"Trials of hot bolt by brand 7 {i}") for i in range(200)]
    monkeypatch.setattr(titles, "_probes", None)  # the rounds settle all of these
    assert found(spark, refs, works, 0.0) == brute(refs, works, 0.0)
