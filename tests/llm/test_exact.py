"""Operators against brute force, round trips and the libraries they stand for."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from probatum.llm import bpe, common, epsjoin, licenses, mixing, pretoken, queries, secrets, shingles, simhash, suffix, tokenfile, topk, toxicity

DOC = "doc_id long, text string"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


def test_pieces_are_the_patterns():
    import public_tokenizers
    import regex

    rng, letters = random.Random(1), " '  \n\tabstmdrvel'09.,!é中　\xa0²𝔸😀$-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    pieces, firsts = pretoken.pieces_of(texts)
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert all(pieces[firsts[i] : firsts[i + 1]] == pattern.findall(t) for i, t in enumerate(texts))


def test_bpe_is_tiktokens_and_decodes(spark):
    import public_tokenizers
    import tiktoken

    codec = bpe.codec(bpe.vocabulary_path(bpe.VOCABULARY))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = ["it's a test’s  test\n\n x", "Größe 12345 中文字符😀 " * 50, "a" * 3000, "", "ünïcødé'll  "]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids == plain.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        assert codec.offsets(ids)[-1] == len(text.encode())
    tokens = bpe.encoded(docs_of(spark, texts))
    assert [bytes(r["bytes"]).decode() for r in bpe.decoded(tokens).orderBy("doc_id").collect()] == texts
    row = bpe.op6_byte_bpe(docs_of(spark, texts)).where("doc_id = 1").first()
    ids = plain.encode_ordinary(texts[1])
    assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_token_file_is_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdé'") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["<|endoftext|> is text", "", "a  b\n c", "a<|endoftext|>b", "Größe中 x² <|endoftext|>", "é" * 5000]
    library = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    start, expected = 0, []
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in tokenfile.op7_token_file(docs_of(spark, texts).repartition(5)).orderBy("doc_id").collect()] == expected


def test_token_file_orders_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "PART_DOCS", 7)
    monkeypatch.setattr(tokenfile, "PARTS_A_BLOCK", 3)
    docs = spark.createDataFrame([(i % 3, f"text number {i}") for i in range(60)], DOC)
    runs = [sorted(map(tuple, tokenfile.op7_token_file(docs.repartition(n)).collect()), key=lambda r: r[1]) for n in (1, 4)]
    assert runs[0] == runs[1]
    ends = [s + n for _, s, n, _ in runs[0]]
    assert [s for _, s, _, _ in runs[0]] == [0, *ends[:-1]]
    assert [d for d, *_ in runs[0]] == sorted(i % 3 for i in range(60))


def test_token_file_keeps_large_ids_beside_null_ones(spark):
    big = (1 << 53) + 1
    docs = spark.createDataFrame([(None, "no id"), (big, "one text"), (big + 2, "and another")], DOC).coalesce(1)
    assert [r["doc_id"] for r in tokenfile.op7_token_file(docs).orderBy("start").collect()] == [None, big, big + 2]


def test_token_file_takes_batches_in_slices():
    import pyarrow as pa

    batches = [pa.record_batch({"x": list(range(n))}) for n in (600, 0, 3)]
    got = list(tokenfile.sliced(iter(batches)))
    assert max(b.num_rows for b in got) <= tokenfile.SLICE
    assert [x for b in got for x in b["x"].to_pylist()] == [*range(600), *range(3)]


def test_ids_beside_a_null_one_are_not_rounded(spark):
    big = (1 << 53) + 1
    docs = spark.createDataFrame([(None, "no id"), (big, "one text"), (big + 2, "and another")], DOC).coalesce(1)
    ids = lambda out: sorted(r["doc_id"] or 0 for r in out.collect())
    assert ids(bpe.round_trip(docs)) == ids(shingles.near_copies(docs)) == [0, big, big + 2]


def test_a_worker_keeps_the_cache_of_one_operator(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "_held", [])
    common.alone("bpe", bpe.codec.cache_clear)
    bpe.codec(bpe.vocabulary_path(bpe.VOCABULARY))
    common.alone("bpe", bpe.codec.cache_clear)
    assert bpe.codec.cache_info().currsize == 1
    batches = [pa.record_batch({"text": ["a text of five or six words", None]})]
    assert sum(b.num_rows for b in shingles._sampled(iter(batches))) == 4
    assert bpe.codec.cache_info().currsize == 0


def test_a_full_cache_still_encodes(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE", 10)
    lib = tokenfile.LibraryCache(bpe.vocabulary_path(tokenfile.VOCABULARY))
    texts = [f"word{i} other words here {i % 7}" for i in range(40)]
    got = [ids for t in texts for ids in lib.encode_batch([t])]
    assert got == [np.array(lib.tokenizer.encode(t, add_special_tokens=False).ids, dtype=lib.kind).tobytes() for t in texts]


def secret_spans(text):
    words = "|".join(secrets.any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(f"({words})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secrets_and_their_ledger(spark):
    rng, parts = random.Random(5), ["token", "TOKEN", "secret", "api_key", "apikey", ":", "=", " ", '"', "'", "abcdefgh", "a1", "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "é中", "\n", "b" * 12]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in secrets.op1_secrets(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i]["spans"] == secret_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(secret_spans(t).encode()).hexdigest()
    _, ledger = secrets.scan(docs.where("doc_id < 1000"))
    paths, new = secrets.scan(docs, ledger)
    assert new.count() == len(set(texts) - set(texts[:1000]))
    assert paths.where(F.size("spans") > 0).count() == sum(bool(secret_spans(t)) for t in texts)
    assert secrets.scan(docs, ledger.withColumn("version", F.lit("older")))[1].count() == len(set(texts))


def test_suffix_dedup_is_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé") for _ in range(120)) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = rng.choice(base) + rng.choice(base)[rng.randrange(30) :]
        k = rng.randrange(len(t))
        texts.append(t[:k] + "x" + t[k + 1 :] if rng.random() < 0.7 else t)
    raws, n = [t.encode() for t in texts], 24
    seen = collections.Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    for hot, most in ((20_000, 1 << 27), (1, 1 << 27), (20_000, 50)):
        got = {bytes(r["blob"]): r for r in suffix.removed(docs_of(spark, texts), length=n, gram=8, hot=hot, most=most).collect()}
        for r in raws:
            gone = np.zeros(len(r), dtype=bool)
            for i in range(len(r) - n + 1):
                gone[i : i + n] |= seen[r[i : i + n]] > 1
            row = got.get(hashlib.sha256(r).digest()[:16])
            assert (row["n_removed"] if row else 0) == gone.sum()
            assert (bytes(row["kept"]) if row else r) == np.frombuffer(r, dtype=np.uint8)[~gone].tobytes()


def test_fingerprints_and_links_are_brute_force(spark):
    rng = random.Random(4)
    texts = ["", "one", "two words"]
    for _ in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 400))]
        texts += [" ".join(w)] + [" ".join(w[:k] + ["changed"] + w[k + 1 :]) for k in rng.sample(range(len(w)), min(len(w), 3))]

    def slow(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [slow(t) for t in texts]
    root = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 3]
    before = None
    while before != root:
        before = root[:]
        for i, j in links:
            root[i] = min(root[i], root[j])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op10_simhash(docs_of(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in range(len(texts))}


def test_near_copies_by_shingles(spark):
    rng = random.Random(6)
    texts, truth = [], []
    for g in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for c in range(4):
            k = rng.randrange(200)
            texts.append(" ".join(w if c == 0 else w[:k] + ["new"] + w[k + 1 :]))
            truth.append(4 * g)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs_of(spark, texts)).collect()}
    found = sum(got.get(i, i) == truth[i] for i in range(len(texts)))
    assert found >= 0.97 * len(texts)
    assert all(got.get(i, i) in (i, truth[i]) or truth[got[i]] == truth[i] for i in range(len(texts)))


def near_pairs(texts):
    """Components of texts that are 0.8 alike, by all pairs of sets."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    return comp


def test_near_copies_meet_every_member_of_a_bucket(spark):
    rng = random.Random(16)
    common, texts = [f"c{i}" for i in range(200)], []
    for g in range(150):  # nearly the same words, but a word in forty changed: 0.6 alike, in the same buckets by words
        own = [f"g{g}w{i}" if i % 40 == 20 else w for i, w in enumerate(common)]
        texts += [" ".join(own), " ".join([f"x{g}", *own[1:]])]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs_of(spark, texts)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == near_pairs(texts)


def test_near_copies_of_block_edits_at_the_threshold(spark):
    rng = random.Random(26)
    texts = []
    for g in range(30):
        n = (100, 200, 400)[g % 3]
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for share in (0.805, 0.82, 0.85, 0.78):
            k, at = int((n - 4) * (1 / share - 1)), rng.randrange(n)
            block = [f"b{rng.randrange(10**6)}" for _ in range(k)]
            kind = len(texts) % 3
            texts.append(" ".join(w + block if kind == 0 else w[: n - int(n * (1 - share))] if kind == 1 else w[:at] + block[: k // 2] + w[at + k // 2 :]))
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs_of(spark, texts)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == near_pairs(texts)


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16))
    rows = np.repeat(base, 6, axis=0) + rng.normal(size=(240, 16)) * rng.choice([0.0, 0.1, 0.35], size=(240, 1))
    label = rng.integers(0, 3, 40).repeat(6)
    vecs = spark.createDataFrame([(i, r.tolist(), int(lab)) for i, (r, lab) in enumerate(zip(rows, label, strict=True))], "vec_id long, embedding array<double>, label int")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    comp = np.arange(240)
    for _ in range(240):
        comp = np.array([comp[link[i]].min() for i in range(240)])
    for size in (4096, 17):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in epsjoin.near_vectors(vecs, interval=size).collect()}
        assert got == {i: (int(link[i].sum()) - 1, int(comp[i]), comp[i] == i) for i in range(240)}
    ints = np.floor(rows * 256).astype(np.int64)
    scores = ints @ ints.T
    expected = []
    for q in range(0, 240, 50):
        order = sorted((i for i in range(240) if i != q), key=lambda i: (-scores[q, i], i))[:5]
        expected += [(q, k + 1, i, int(scores[q, i])) for k, i in enumerate(order)]
    for size in (8192, 20):
        got = [tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in topk.top_products(vecs, bucket=size).orderBy("query_id", "rank").collect()]
        assert got == expected


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    words, bad = [f"word{i}" for i in range(400)], ["nasty", "horrid", "vexed"]
    rows, marks = [], []
    for i in range(900):
        w, toxic = rng.choices(words, k=60), i % 6 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(bad)
        if i >= 600 and toxic:
            w = [x.replace("nasty", "n4sty").replace("horrid", "hоrrid") for x in w]  # a digit and a look-alike
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.op3_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.98 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_exceptions_spare_terms():
    lex = toxicity.Lexicon({" clown ": 3.0})
    assert toxicity.features("what a clown", lex.automaton())[2] == 3.0
    assert toxicity.features("a clown fish", lex.automaton())[2] == 0.0


def test_licenses(spark):
    lines = ["Some prose about nothing in particular here", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3."]
    docs = docs_of(spark, ["\n".join(["plain words of prose, by the way", x, "and more of the same"]) for x in lines] + [f"words {i} about gardens and rivers" for i in range(200)])
    got = {r["doc_id"]: r["family"] for r in licenses.op8_licenses(docs).where("confirmed").collect()}
    assert got == {1: "mit", 2: "apache", 3: "cc", 4: "gpl"}


def test_mixing_shares_shortages_among_siblings(spark):
    texts = [("a", "src0", 5)] * 2 + [("a", "src4", 100)] * 10 + [("b", "src1", 50)] * 20
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), lang, src) for i, (lang, src, n) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = mixing.mixed(docs, fraction=0.25, epochs=1, domain_weights={"domain0": 1, "domain1": 1}, lang_weights={})
    by = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert by == {"src0": 10, "src4": 241, "src1": 251}


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_source_mixing", "op5_embedding_dedup", "op9_topk"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted(map(tuple, got.select(*expected.columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)


def test_near_copies_of_one_vocabulary(spark):
    rng, vocabulary, texts = random.Random(36), [f"v{i}" for i in range(120)], []
    for _ in range(50):  # the same words in other orders, and each once more with one word changed
        w = rng.sample(vocabulary, 120)
        texts += [" ".join(w), " ".join([*w[:-1], "new"])]
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == near_pairs(texts)


def test_near_copies_at_sf001_are_all_pairs(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    texts = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split(" ") for t in texts)]
    where, comp = collections.defaultdict(list), list(range(len(texts)))
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    near = {(a, b) for i, s in enumerate(sets) for a, n in collections.Counter(j for x in s for j in where[x] if j < i).items() for b in [i] if 5 * n >= 4 * (len(sets[a]) + len(s) - n)}
    for _ in range(len(texts)):
        before = comp[:]
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if before == comp:
            break
    least = collections.defaultdict(list)
    for (i, _), c in zip(rows, comp, strict=True):
        least[c].append(i)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == {i: min(least[c]) for (i, _), c in zip(rows, comp, strict=True)}


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    import corpus_pipeline

    a, b, c = ("one text of several words here", "quite another text with other words", "a third text that stands alone too")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (5, c), (5, c), (None, a), (None, "no id but a text of its own")], DOC)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [(0, "no id but a text of its own"), (1, a), (2, b), (5, c)]


def test_mixing_takes_zero_and_empty_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", f"src{i % 3}") for i in range(60)], "doc_id long, text string, lang string, source string")
    by = lambda **w: {r["source"]: r["n"] for r in mixing.mixed(docs, epochs=1, **w).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert by(domain_weights={}, lang_weights={}) == {"src0": 100, "src1": 100, "src2": 100}
    assert by(domain_weights={"domain0": 0}, lang_weights={}) == {"src1": 150, "src2": 150}
    assert by(domain_weights={}, lang_weights={}, source_weights={"src2": 0}) == {"src0": 150, "src1": 150}
    one = {"domain0": 1, "domain1": 1, "domain2": 1}
    merged = docs.withColumn("source", F.concat("source", F.lit("-x0")))  # one domain
    got = {r["source"]: r["n"] for r in mixing.mixed(merged, epochs=1, domain_weights=one, source_weights={"src0-x0": 4, "src1-x0": 1}).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert got == {"src0-x0": 200, "src1-x0": 50, "src2-x0": 50}


def test_secret_spans_of_many_matches_cost_in_proportion(spark):
    import time

    def seconds(n):
        text = " ".join(f"{i:040x} é😀" for i in range(n))
        begin = time.time()
        (row,) = secrets.op1_secrets(docs_of(spark, [text])).collect()
        assert row["n_hex"] == n and row["spans"] == secret_spans(text)
        (clean,) = secrets.masked(docs_of(spark, [text])).collect()
        assert clean["text"] == re.sub("[0-9a-f]{40}", "<hex>", text)
        return time.time() - begin

    seconds(100)
    few, many = seconds(10_000), seconds(20_000)
    assert many < 3 * few


def test_secret_ledger_holds_versions(spark, tmp_path):
    docs = docs_of(spark, ["token = abcdefgh12", "ghp_" + "a1" * 15, "nothing", "nothing", "xoxb-1234567890ab token=xoxb-1234567890ab"])
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    first = {r["doc_id"]: r["spans"] for r in ledger.scan(docs.where("doc_id < 3"), (secrets.BASE,)).collect()}
    assert [len(first[i]) for i in range(3)] == [1, 0, 0]
    assert {(r["version"], r["n"]) for r in ledger.read().groupBy("version").agg(F.count("*").alias("n")).collect()} == {("base-1", 3)}
    both = {r["doc_id"]: r["spans"] for r in ledger.scan(docs, (secrets.BASE, secrets.MORE)).collect()}
    assert [len(both[i]) for i in range(5)] == [1, 1, 0, 0, 3]
    assert {(r["version"], r["n"]) for r in ledger.read().groupBy("version").agg(F.count("*").alias("n")).collect()} == {("base-1", 4), ("more-1", 4)}
    assert secrets.scan(docs, ledger.read(), (secrets.BASE, secrets.MORE))[1].count() == 0
    out = {r["doc_id"]: r for r in secrets.op1_secrets(docs).collect()}
    assert out[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[1]["spans"] == "github:0:34"
    assert out[4]["base_sha256"] == hashlib.sha256(b"assign:18:41").hexdigest()
    assert secrets.masked(docs).where("doc_id = 4").first()["text"] == "<slack> <assign>"


def test_near_copies_of_crowded_shingles(spark):
    rng, texts = random.Random(46), []
    for g in range(3):  # texts of one base, most of them under 0.8 alike, some pairs over it
        base = [f"g{g}w{i}" for i in range(150)]
        for c in range(60):
            w = list(base)
            for k in rng.sample(range(150), 4 + c % 5):
                w[k] = f"e{rng.randrange(10**6)}"
            texts += [" ".join(w)] + ([" ".join([*w[:-1], "last"])] if c % 10 == 0 else [])
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs_of(spark, texts)).collect()}
    truth = near_pairs(texts)
    assert 20 < len(set(truth)) < len(texts)
    assert [got[i] for i in range(len(texts))] == truth


def test_the_stage_links_by_fingerprints_too(spark):
    import corpus_pipeline

    rng, pair = random.Random(2), None
    while not pair:  # alike for fingerprints, less than 0.8 alike by shingles
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        a, b = " ".join(words), " ".join(w if rng.random() > 0.02 else f"y{rng.randrange(10**6)}" for w in words)
        x, y = set(shingles.shingle_hashes(a)), set(shingles.shingle_hashes(b))
        if ((simhash.fingerprint(a) ^ simhash.fingerprint(b)) & (1 << 64) - 1).bit_count() <= 3 and 5 * len(x & y) < 4 * len(x | y):
            pair = [a, b]
    docs = docs_of(spark, [*pair, "another text altogether", pair[0] + " and a tail"])
    assert [r["component_id"] for r in shingles.near_copies(docs).orderBy("doc_id").collect()] == [0, 1, 2, 0]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]
