"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: look-alike letters of other scripts and full-width forms become Latin, digits that stand for
letters become those letters, and case goes. The folded words, joined by single spaces, are run through one automaton
of learned terms (whole words and word beginnings) and exception phrases; terms inside an exception phrase do not
count. The best term of each word gives the word's weight. Total weight, weight per 100 words, the greatest weight and
the number of different terms go into a logistic model that gives the score.

Term weights are smoothed log-odds of document frequencies in labelled training rows (crc32 of the id modulo 3 is not
1), the logistic model is fitted to features made with weights from the other folds of those rows. Both use at most
about ``SAMPLE`` training rows, chosen by a hash of the id. Score uses the text only.

Null and empty texts have no terms and get the model's score for that. Without training rows of both classes every
score is 0. Rows with a null id are scored and are not held out. Repeated rows are all returned. A document with several
labels counts as toxic if one says so; null labels do not count.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probatum.llm.common import alone, sampled, written

SAMPLE, SUPPORT, SUPPORT_SHARE, LEAST_WEIGHT, LEAST_Z, CUT, FOLDS = 20_000, 4, 0.01, 2.5, 7.0, 0.7, 4
PREFIXES = range(4, 9)
EXCEPTIONS = ("trash can", "clown fish", "pathetic fallacy", "class clown", "trash bag", "white trash bag")
#: Look-alikes of Latin letters.
LOOKALIKES = dict(
    zip("абвгеіјкмнорстухѕԁցһԛԝαβεικνορτυχАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abbreijkmhopctyxsdghqwabeikvoptuxabekmhopctxijsabezhikmnoptyx", strict=True)
)
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
FOLD = str.maketrans(LOOKALIKES | DIGITS | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)})
BETWEEN, WORD = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])"), re.compile(r"[^\W_]+")


def folded(text: str | None) -> str:
    """The words of a text after folding, each after one space, and a space at the end."""
    text = (text or "").translate(FOLD).lower()
    if "@" in text or "$" in text:
        text = BETWEEN.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return f" {' '.join(WORD.findall(text))} "


def terms_of(text: str | None) -> set[str]:
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            a.add_word(term, (len(term), weight, term))
        for phrase in self.exceptions if self.weights else ():
            if (term := folded(phrase)) not in self.weights:
                a.add_word(term, (len(term), 0.0, None))
        if not len(a):
            return None
        a.make_automaton()
        return a


def features(text: str | None, automaton: ahocorasick.Automaton | None) -> tuple[float, float, float, float]:
    """log(1 + total weight), log(1 + weight per 100 words), greatest weight, log(1 + number of different terms)."""
    if automaton is None or not text:
        return 0.0, 0.0, 0.0, 0.0
    run = folded(text)
    best: dict[int, tuple[float, str]] = {}
    spared = []
    for end, (n, weight, term) in automaton.iter(run):
        start = end - n + 1
        if term is None:
            spared.append((start, end))
        elif weight > best.get(start, (0.0, ""))[0]:
            best[start] = weight, term
    if spared:
        best = {at: x for at, x in best.items() if not any(s <= at < e for s, e in spared)}
    if not best:
        return 0.0, 0.0, 0.0, 0.0
    total, words = sum(w for w, _ in best.values()), max(1, run.count(" ") - 1)
    return float(np.log1p(total)), float(np.log1p(100 * total / words)), max(w for w, _ in best.values()), float(np.log1p(len({t for _, t in best.values()})))


def lexicon(counts: pd.DataFrame, folds: list[int], rows: dict[tuple[int, int], int]) -> Lexicon:
    """``counts (term, pos0, neg0, pos1, neg1, ...)``; the terms that count by the rows of ``folds``."""
    pos, neg = sum(counts[f"pos{h}"] for h in folds), sum(counts[f"neg{h}"] for h in folds)
    n_pos, n_neg = sum(rows.get((h, 1), 0) for h in folds), sum(rows.get((h, 0), 0) for h in folds)
    weight = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    keep = (pos >= max(SUPPORT * len(folds) / FOLDS, SUPPORT_SHARE * n_pos)) & (weight >= LEAST_WEIGHT) & (weight * np.sqrt(pos) >= LEAST_Z * np.sqrt(len(folds) / FOLDS))
    return Lexicon(dict(zip(counts["term"][keep], weight[keep].astype(float), strict=True)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Coefficients, intercept first, by Newton steps on the penalised likelihood."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass
class Model:
    words: Lexicon
    beta: tuple[float, ...] | None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.zeros(len(rows))
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + rows @ np.array(self.beta[1:]), -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    marks = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    h = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    rows = sampled(marks, h, sample).withColumn("fold", F.pmod(F.shiftright(h, 32), F.lit(FOLDS)).cast("int"))
    rows = written(docs.select("doc_id", "text").join(rows, "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), "fold"), "labelled")
    n = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    n_pos, n_neg = (sum(n.get((fold, kind), 0) for fold in range(FOLDS)) for kind in (1, 0))
    if not n_pos or not n_neg:
        return Model(Lexicon({}), None)

    def counted(which: int, only: frozenset | None):
        def count(batches):
            seen = Counter()
            for pdf in batches:
                for text, fold in zip(pdf["text"], pdf["fold"], strict=True):
                    seen.update((t, fold) for t in (terms_of(text) if only is None else terms_of(text) & only))
                    if len(seen) > 500_000:
                        yield frame(seen)
                        seen = Counter()
            if seen:  # Spark 4.1 can't take a frame of strings without rows
                yield frame(seen)

        def frame(seen):
            return pd.DataFrame({"term": [t for t, _ in seen], "fold": [f for _, f in seen], "n": list(seen.values())})

        part = rows.where(F.col("toxic") == which).select("text", "fold").mapInPandas(count, "term string, fold int, n long")
        name = "pos" if which else "neg"
        return part.groupBy("term").agg(*[F.sum(F.when(F.col("fold") == i, F.col("n")).otherwise(0)).alias(f"{name}{i}") for i in range(FOLDS)])

    support = max(SUPPORT, SUPPORT_SHARE * n_pos) * (FOLDS - 1) / FOLDS
    pos = counted(1, None).where(f"{' + '.join(f'pos{i}' for i in range(FOLDS))} >= {support}").toPandas()
    neg = counted(0, frozenset(pos["term"])).toPandas()
    counts = pos.merge(neg, on="term", how="left").fillna(0)
    crossed = [lexicon(counts, [f for f in range(FOLDS) if f != fold], n) for fold in range(FOLDS)]

    def featured(batches):
        autos = [x.automaton() for x in crossed]
        for pdf in batches:
            got = np.array([features(t, autos[h]) for t, h in zip(pdf["text"], pdf["fold"], strict=True)], dtype=float).reshape(-1, 4)
            yield pd.DataFrame({"toxic": pdf["toxic"], **{f"f{i}": got[:, i] for i in range(4)}})

    seen = rows.mapInPandas(featured, "toxic int, f0 double, f1 double, f2 double, f3 double").toPandas()
    beta = fit_logistic(seen[[f"f{i}" for i in range(4)]].to_numpy(), seen["toxic"].to_numpy(dtype=float))
    return Model(lexicon(counts, list(range(FOLDS)), n), tuple(beta.tolist()))


def score_column(model: Model):
    """A function from a text column to its score."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        alone("toxicity", _BUILT.clear)
        auto = _automaton(model.words)
        rows = np.array([features(t, auto) for t in texts], dtype=float).reshape(-1, 4)
        return pd.Series(model.scores(rows))

    return score


_BUILT: dict[int, tuple] = {}


def _automaton(words: Lexicon):
    key = hash(frozenset(words.weights.items()))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (words.automaton(),)
    return _BUILT[key][0]


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    out = docs.select("doc_id", score_column(model)("text").alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
