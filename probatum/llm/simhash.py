"""SimHash near-duplicates, found by multi-index hashing.

Fingerprints are 64-bit majority votes over XXH64 hashes of word shingles. Two fingerprints that differ in at
most ``RADIUS`` bits differ in at most ``RADIUS // SEGMENTS`` bits inside one of ``SEGMENTS`` equal segments, so every
fingerprint probes, per segment, the small Hamming ball around its own segment value; the table of a segment
holds each distinct fingerprint once, and matches are verified on all 64 bits.

Null and empty texts have no words and get fingerprint zero. Rows with a null ``doc_id`` keep their fingerprint
but take no part in linking (component null). Repeated rows are all returned. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probatum.llm.common import connected_components, written

WORDS, SEED, RADIUS, SEGMENTS = 3, 42, 3, 2


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one whole text as a signed 64-bit integer."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return _signed(xxhash.xxh64_intdigest(joined, seed))
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[: len(parts) - words])]
    hashed = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    hashes = np.array([hashed(joined[s:e]) for s, e in zip(starts, ends[words - 1 :], strict=True)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


@F.pandas_udf(T.LongType())
def fingerprint_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _segment(fp: Column, i: int, segments: int) -> Column:
    width = 64 // segments
    return F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct values of ``fps.fp`` that differ in at most ``radius`` bits."""
    width, near = 64 // segments, radius // segments
    balls = [0]
    for _ in range(near):
        balls = sorted({x ^ (1 << bit) for x in balls for bit in range(width)} | set(balls))
    index = fps.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _segment(F.col("fp"), i, segments).alias("key")) for i in range(segments)])).alias("k"), F.col("fp").alias("b")
    ).select("k.seg", "k.key", "b")
    flips = F.array(*[F.lit(x).cast("long") for x in balls])
    probes = fps.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _segment(F.col("fp"), i, segments).alias("key")) for i in range(segments)])).alias("k"), F.col("fp").alias("a")
    ).select("k.seg", "k.key", "a", F.explode(flips).alias("flip"))
    probes = probes.select("seg", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "a")
    # Spark sizes a table with an explode as if it had no more rows: without a hint the probes, 66 a fingerprint, would be broadcast through the driver
    met = probes.hint("merge").join(index, (probes.seg == index.seg) & (probes.key == index.key) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return met.select("a", "b").distinct()


def links_of(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: the representatives of fingerprints that differ in at most ``radius`` bits, from ``reps (fp, rep)``."""
    named = reps.select(F.col("fp").alias("a"), F.col("rep").alias("u"))
    pairs = near_fingerprints(reps.select("fp"), radius).join(named.hint("merge"), "a")  # never broadcast: these grow with the table
    return pairs.join(named.select(F.col("a").alias("b"), F.col("u").alias("v")).hint("merge"), "b").select("u", "v")


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs (doc_id, text)``."""
    marked = written(docs.select("doc_id", fingerprint_udf("text").alias("fp")), "fingerprints")
    reps = written(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    comps = connected_components(links_of(reps, radius))
    of_fp = reps.join(comps.hint("merge"), reps.rep == comps.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(of_fp.hint("merge"), "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op10_simhash(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 lowercase hex digits) and ``component_id`` of every document."""
    return simhash_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
