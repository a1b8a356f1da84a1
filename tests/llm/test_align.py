"""Cross-tokenizer alignment against the libraries and brute force, and on odd rows."""

import bisect
import collections
import hashlib
import random

import pytest

from probatum.llm import align

DOC = "doc_id long, text string, code int, batch long, n long, ids string"
TEXTS = [
    "A plain text, it's about 12345 words\n\nand lines.  Two blanks", " leads", "trails ", "   ", " ", "", None, "Größe 中文字符 😀 é é ﬁ ① 　中", "a▁b", "x <s> </s> <unk> <0x41> <|endoftext|> y",
    "tab\tand\r\nnul\x00 \xa0 end", "word " * 500, "z" * 3000, "a  b   c    d" + " " * 40 + "e", "same text", "same text", "12 34 5678 !!?? ...", "I'll we've don't 'quoted' ''s",
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, 1, 2, 3, "x") for i, t in enumerate(texts)], DOC)


def bytes_of_a():
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(align.VOCABULARY_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.VOCABULARY_B))
    chars, links, out = bytes_of_a(), [], []
    for t in texts:
        links.append([])
        out.append((0, 0, 0, 0, ""))
        if not t:
            continue
        raw = (" " + t).encode()
        a_ids, b_ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        a_parts = [bytes(chars[c] for c in a.id_to_token(i)) for i in a_ids]
        b_parts = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            continue
        spans = []
        for parts in (a_parts, b_parts):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        j = 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b_ids) and spans[1][k][0] < e:
                links[-1].append((a_ids[i], b_ids[k]))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, place = [([], []) for _ in cuts], {}
        for side, (ids, own) in enumerate(zip((a_ids, b_ids), spans, strict=True)):
            for i, (_, e) in zip(ids, own, strict=True):
                if e not in place:
                    place[e] = bisect.bisect_left(cuts, e)
                groups[place[e]][side].append(str(i))
        groups = ["|".join(map(",".join, g)) for g in groups]
        out[-1] = (len(a_ids), len(b_ids), len(groups), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = collections.Counter(x for own in links for x in own)
    most = collections.Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(*o[:4], sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), o[4]) for o, own in zip(out, links, strict=True)]


def held(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else 3, *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


def expected(texts):
    return sorted((i, *x) for i, x in enumerate(brute(texts)))


@pytest.mark.parametrize("small", [False, True])
def test_alignment_is_brute_force(spark, monkeypatch, small):
    if small:  # many batches, runs and cut texts, and caches that fill up
        for name, value in (("RUN", 60), ("BATCH_LINKS", 50), ("CACHE", 5)):
            monkeypatch.setattr(align, name, value)
        monkeypatch.setattr(align.runs_of, "__defaults__", (60,))
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma's", "délta", "x1y2", "中文", "...", "--", "\n", "\t", "", " ", "naïve", "tokenization", "😀"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(120)]
    df = docs_of(spark, texts)
    assert held(align.op13_alignment(df.repartition(3))) == expected(texts)


def test_texts_that_do_not_come_back_have_no_tokens(spark):
    got = {r["doc_id"]: r for r in align.op13_alignment(docs_of(spark, TEXTS)).collect()}
    for i in (5, 6, 8):
        assert tuple(got[i])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert got[9]["n_a"] > 0 and got[None]["n_a"] > 0


def test_alignment_takes_empty_tables_and_long_texts(spark):
    assert align.op13_alignment(docs_of(spark, [])).collect() == []
    assert align.op13_alignment(docs_of(spark, [None, ""])).where("n_links > 0").count() == 0
    texts = ["lorem ipsum dolor, sit amet " * 100_000, "lorem ipsum dolor"]
    got = held(align.op13_alignment(docs_of(spark, texts)))
    assert got == expected(texts)


def test_long_texts_are_cut_where_both_end():
    text = " some words 12 and 中 more  words " * 40
    parts = align.cut(text, 50)
    assert "".join(parts) == text and len(parts) > 10
    assert all(p[0] == " " and p[1].isalpha() for p in parts[1:])
    assert align.cut("中" * 500, 50) == ["中" * 500]


def test_words_hold_the_blanks_before_them():
    for text in (" a", "  a b", " a ", "   ", " ", " a  b   c "):
        words = align.words_of(text)
        assert "".join(words) == text and all(w[0] == " " for w in words)
