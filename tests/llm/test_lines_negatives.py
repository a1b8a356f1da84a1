"""Line deduplication and hard negatives against brute force, and on odd rows."""

import hashlib
import random

import numpy as np
import pytest

from probatum.llm import lines, negatives

DOC = "doc_id long, text string, key string, gone string, slot long, digest binary"
VEC = "vec_id long, embedding array<float>, label int, cluster int, far double, block long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "k", "g", 1, b"d") for i, t in rows], DOC)


def vecs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, 2) for r in rows], VEC)


def brute_lines(rows, least=lines.LEAST_CHARS, docs=lines.LEAST_DOCS):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(k := key(x)) >= least:
                held.setdefault(k, set()).add(i)
    keeper = {k: max((i for i in s if i is not None), default=None) for k, s in held.items() if len(s) >= docs}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(parts), len(parts) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows(seed=4, n=300):
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdeé 中") for _ in range(rng.randrange(36, 60))) for _ in range(40)] + ["A very common line that every third document holds, word for word"]
    rows = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(80))) for _ in range(rng.randrange(12))]
        parts = [rng.choice(["", " ", "\t \r"]) + (p.upper() if rng.random() < 0.2 else p) + rng.choice(["", "  ", "\x0b", " "]) for p in parts]
        rows.append((i, "\n".join(parts + ([common[-1]] if i % 3 == 0 else []))))
    return rows + [(None, common[-1]), (None, common[-1]), (7, common[-1]), (7, None), (900, None), (901, ""), (902, "\n\n"), (903, "x" * 200_000 + "\n" + common[-1])]


@pytest.mark.parametrize("filter_bytes", [lines.FILTER_BYTES, 0])
def test_repeated_lines_are_brute_force(spark, filter_bytes):
    rows = some_rows()
    got = lines.without_repeats(docs_of(spark, rows).repartition(5), filter_bytes=filter_bytes).drop("kept")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(rows)


@pytest.mark.parametrize("filter_bytes", [lines.FILTER_BYTES, 0])
def test_small_filters_over_many_slots_lose_nothing(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(lines, "SLOT_KEYS", 64)
    monkeypatch.setattr(lines, "FLUSH", 100)
    rows = some_rows(seed=9)
    got = lines.without_repeats(docs_of(spark, rows).repartition(3), filter_bytes=filter_bytes).drop("kept")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(rows)


def test_filters_hold_every_key_seen_twice_and_few_others():
    rng = np.random.default_rng(1)
    once, twice = rng.integers(0, 1 << 63, 2 * lines.SLOT_KEYS, dtype=np.uint64), rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    import pandas as pd

    parts = pd.concat([lines._partial([np.concatenate([x, twice])], 2) for x in np.array_split(once, 7)])
    kept = {int(s): bytes(lines._merged(g)["bits"].iloc[0]) for s, g in parts.groupby("slot")}
    held = lines.Twice(kept, 2)
    slot, first, second = lines.places(np.concatenate([twice, once]), 2)
    hit = lines._set(held.bits, slot * lines.SLOT_BITS + first) & lines._set(held.bits, slot * lines.SLOT_BITS + second)
    assert hit[:1000].all() and hit[1000:].mean() < 0.03


def test_line_dedup_keeps_texts_and_takes_empty_tables(spark):
    line = "this line of more than forty characters stands in six documents"
    rows = [(i, f"head {i}\n{line}\ntail {i}") for i in range(6)]
    out = {r["doc_id"]: r for r in lines.without_repeats(docs_of(spark, rows)).collect()}
    assert out[5]["kept"] is None and out[5]["n_dropped"] == 0
    assert all(out[i]["kept"] == f"head {i}\ntail {i}" for i in range(5))
    assert lines.op11_line_dedup(docs_of(spark, [])).collect() == []
    assert lines.op11_line_dedup(docs_of(spark, rows[:4])).where("n_dropped > 0").count() == 0


def brute_negatives(rows, every=50, relabel=7):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % relabel == 0 else label
        kept[(i, tuple(np.floor(256 * np.float64(np.float32(x))) for x in v), label)] = None
    kept = list(kept)
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    out = []
    for i, v, label in kept:
        if i % every:
            continue
        others = [(dot(v, w), j, m == label) for j, w, m in kept if j != i]
        best = sorted((-s, j) for s, j, same in others if same)[:5]
        for s, j in best:
            found = sorted((-n, m) for n, m, same in others if not same and 50 * -s <= 100 * n <= 95 * -s)[:3]
            out += [(i, j, r + 1, m, -s, -n) for r, (n, m) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("rounds", [(1, 3), ()])
def test_hard_negatives_are_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(negatives, "CLUSTER_ROWS", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 6))
    rows = []
    for i in range(700):
        v = centres[i % 9] * rng.choice([0.0, 0.2, 1.0, 1.5]) + rng.normal(size=6) * 0.2
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 4)) if i % 3 else 0))
    rows += [(1000 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(120)]  # one common vector
    vecs = vecs_of(spark, rows).repartition(3)
    got = negatives.hard_negatives(vecs, list_rows=16, block_rows=4, rounds=rounds)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_a_full_goal_takes_no_empty_places():
    import pandas as pd

    queries, goal = negatives.Packed(np.array([50]), np.array([1]), np.ones((1, 2))), negatives.Goal.positives(1, 2)
    lists = [[(9, 1), (8, 2)], [(10, 3), (negatives.NONE, negatives.NONE)]]
    found = pd.DataFrame([{"block": 0, "at": np.array([[0, 0]], dtype="<i4").tobytes(), "found": np.array([b], dtype=np.int64).tobytes()} for b in lists])
    out = negatives._gather((0,), negatives._state(0, queries, goal), found)
    assert negatives.Goal.of(next(out.itertuples())).best[0, 0].tolist() == [[10, 3], [9, 1]]


def test_hard_negatives_take_odd_rows(spark):
    nan = float("nan")
    rows = [
        (50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (50, [0.5, 0.0], 2), (1, [2.0, 0.0], 1), (2, [1.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [nan, 0.0], 2), (6, [None, 0.0], 2),
        (8, [0.75, 0.0], 2), (9, [0.75, 0.0, 3.0], 2), (None, [0.75, 0.0], 2), (10, [0.0, 0.0], 3), (100, [0.0, 0.0], 1), (150, [1.0, 1.0], 9), (12, [0.95, 0.0], 4),
    ]
    assert sorted(map(tuple, negatives.op12_hard_negatives(vecs_of(spark, rows)).collect())) == brute_negatives(rows)
    assert negatives.op12_hard_negatives(vecs_of(spark, [])).collect() == []
    assert negatives.op12_hard_negatives(vecs_of(spark, [(50, [1.0], 1)])).collect() == []


def test_lists_are_skipped_by_bounds_and_windows():
    rng = np.random.default_rng(5)
    centres = np.eye(4) * 100
    radii = np.full(4, 5.0)
    queries = negatives.Packed(np.array([50]), np.array([1]), np.array([[10.0, 0, 0, 0]]))
    goal = negatives.Goal(np.array([[900]]), np.array([[1100]]), np.full((1, 1, 3, 2), negatives.NONE), False)
    needed = goal.needed(queries.vectors @ centres.T, np.array([10.0]))
    assert (needed <= radii).tolist() == [[True, False, False, False]]  # the others lie below the window
    low = negatives.Goal(np.array([[-10]]), np.array([[10]]), np.full((1, 1, 3, 2), negatives.NONE), False)
    assert (low.needed(queries.vectors @ centres.T, np.array([10.0])) <= radii).tolist() == [[False, True, True, True]]  # the first lies above it
    rows = rng.normal(size=(200, 4)) + centres[0]
    goal.search(np.array([0]), queries, negatives.Packed(np.arange(200), np.zeros(200, dtype=np.int64), np.floor(rows)))
    assert goal.least()[0, 0] == goal.best[0, 0, -1, 0] >= 900
