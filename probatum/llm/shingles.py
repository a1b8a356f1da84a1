"""Near copies by shingle similarity: texts whose sets of five-word shingles are 0.8 alike (Jaccard), every such link found.

A 64-bit SimHash is too coarse for a similarity of 0.8 (such pairs differ in 9 bits at the median and in up to 19), so
candidates come from a prefix filter: sets of sizes m and n that are 0.8 alike share at least 4/9 (m + n) shingles, so in any
common order of shingles they meet within their first n - ceil(0.8 n) + 1. The order puts shingles last that are frequent
in every ``ORDER_ONE_IN``-th document; it decides how many candidates are met, never which links are found.

Equal texts are one class, keyed by digest, never by id. Members of a shingle first meet the member that has it earliest
(in a group of edited copies that is the least edited one), which is linear in the rows; then only members that are still
of different components meet: all of them where a shingle has up to ``FEW`` members. Texts of larger shingles are
ordered anew, by exact counts of their shingles among themselves: what a group of texts has in common moves to the end, and
only texts that are nearly alike still meet. A pair goes on if sizes and places in the prefixes allow a similarity of 0.8, then
if the parity bitmaps of its sets do (equal shingles cancel out, so bits that differ are shingles that differ), and is then
verified on the whole texts. All three tests are exact bounds: no partner is capped. Joins are sorted by hint: Spark sizes exploded and
aggregated tables too low, and would broadcast them through the driver.

Words are runs other than ASCII white space, A-Z lower-cased; a text of fewer than five words is one shingle, a null or empty
text the empty one. Rows with a null id take part and order last. Repeated rows are one row here. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import alone, connected_components, forget, release, sliced, written
from probatum.llm.simhash import fingerprint, links_of

SHINGLE, ORDER_ONE_IN, FREQUENT, MOST_FREQUENT, FEW = 5, 12, 2, 1 << 20, 16
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype="<u8")
_FINAL, _HALF = np.uint64(0xC4CEB9FE1A85EC53), np.uint64(32)


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct ``words``-word shingles (fewer words: the whole sequence)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts))], dtype="<u8")
    own = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype="<u8", count=len(parts))
    n = len(parts) - words + 1
    h = np.zeros(n, dtype="<u8")
    for i in range(words):
        h += own[i : i + n] * _MIX[i % len(_MIX)]
        h ^= h >> _HALF
    h *= _FINAL
    h ^= h >> _HALF
    return np.unique(h)


def prefix_length(size: int) -> int:
    """How many first shingles of a set of ``size`` meet those of every set that is 0.8 alike."""
    return size - (4 * size + 4) // 5 + 1


def parity_bits(hashes: np.ndarray) -> bytes:
    """A bitmap of two to four bits a shingle; a bit is 1 if an odd number of shingles falls on it."""
    n = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bits_allow(a: bytes, m: int, b: bytes, n: int) -> bool:
    """Whether sets of sizes m and n with these bitmaps can be 0.8 alike: bits that differ are shingles of one set only."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) != len(y):  # the larger bitmap folds to the smaller
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    differ = int(np.bitwise_count(x ^ y).sum())
    return 9 * (m + n - differ) >= 8 * (m + n)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    """Arrays of hashes as one column of lists of longs."""
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, "<u8"), *sets]).view("<i8"), pa.int64()))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone("shingles")
    for part in sliced(batches):
        yield pa.record_batch({"token": _lists([shingle_hashes(t) for t in part["text"].to_pylist()]).flatten()})


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that are frequent in a sample, at most ``MOST_FREQUENT``; they decide an order only.

    The sample is the same share of the documents at every size; only the list reaches the driver.
    """
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ORDER_ONE_IN)) == 0)
    counts = sample.select("text").mapInArrow(_sampled, "token long").groupBy("token").agg(F.count("*").alias("n"))
    counts = written(counts.where(F.col("n") >= FREQUENT), "frequent")
    least, held = FREQUENT, 0
    for n, times in sorted(((r["n"], r["times"]) for r in counts.groupBy("n").agg(F.count("*").alias("times")).collect()), reverse=True):
        if (held := held + times) > MOST_FREQUENT:
            least = n + 1
            break
    got = counts.where(F.col("n") >= least).toArrow()
    tokens, n = got["token"].to_numpy().view("<u8"), got["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order].astype("<i4")


def _prefixes(frequent: tuple[np.ndarray, np.ndarray], fingerprints: bool):
    """Per document its SimHash fingerprint if asked, the number of its shingles, their bitmap, and the shingles of its prefix in order."""
    tokens, counts = frequent

    def prefix(text):
        own = shingle_hashes(text)
        count = np.zeros(len(own), dtype="<i4")
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
            count = np.where(tokens[at] == own, counts[at], 0)
        return len(own), parity_bits(own), own[np.argsort(count, kind="stable")][: prefix_length(len(own))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("shingles")
        for part in sliced(batches):
            texts = part["text"].to_pylist()
            size, bits, firsts = zip(*map(prefix, texts), strict=True)
            fp = pa.array([fingerprint(t) if fingerprints else 0 for t in texts], pa.int64())
            yield pa.record_batch({"doc_id": part["doc_id"], "same": part["same"], "fp": fp, "size": pa.array(size, pa.int32()), "bits": pa.array(bits, pa.binary()), "tokens": _lists(firsts)})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone("shingles")
    for part in sliced(batches):
        yield pa.record_batch({"node": part["node"], "tokens": _lists([shingle_hashes(t) for t in part["text"].to_pylist()])})


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone("shingles")
    for part in sliced(batches):
        got = [bits_allow(*x) for x in zip(*(part[c].to_pylist() for c in ("bits_u", "size_u", "bits_v", "size_v")), strict=True)]
        yield part.select(["u", "v"]).filter(pa.array(got, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone("shingles")
    hashes = functools.lru_cache(maxsize=8)(shingle_hashes)
    for part in sliced(batches):
        got = []
        for x, y in zip(part["text_u"].to_pylist(), part["text_v"].to_pylist(), strict=True):
            a, b = hashes(x), hashes(y)
            both = len(np.intersect1d(a, b, assume_unique=True))
            got.append(5 * both >= 4 * (len(a) + len(b) - both))
        yield part.select(["u", "v"]).filter(pa.array(got, pa.bool_()))


def _may_be_alike(a: str, b: str) -> Column:
    """Whether two sets that meet first at places ``pos`` of their orders can be 0.8 alike."""
    m, n = F.col(f"{a}.size"), F.col(f"{b}.size")
    left = F.least(m - F.col(f"{a}.pos"), n - F.col(f"{b}.pos"))
    return (5 * F.least(m, n) >= 4 * F.greatest(m, n)) & (9 * left >= 4 * (m + n))


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def near_copies(docs: DataFrame, fingerprints: bool = False) -> DataFrame:
    """``doc_id, same, times, group, component_id`` of every different row ``(doc_id, text)``, which occurs ``times`` times.

    ``same`` is the digest of the text; ``group`` numbers the texts that links join; ``component_id`` is their smallest id,
    null where none has one. With ``fingerprints``, texts whose SimHash fingerprints link are joined first, by the multi-index
    hashing of ``simhash``; the prefix filter then finds the links that those are too coarse for.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("same"), "text")
    prefixes = written(rows.mapInArrow(_prefixes(frequent_shingles(docs), fingerprints), "doc_id long, same binary, fp long, size int, bits binary, tokens array<long>"), "prefixes")
    marked = written(prefixes.groupBy("same", "doc_id").agg(F.count("*").alias("times")), "marked")
    classes = written(prefixes.dropDuplicates(["same"]).withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered once, in the files
    forget(prefixes)
    release(spark)
    keyed = classes.select("node", "size", F.posexplode("tokens").alias("pos", "token"))
    met = keyed.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token")
    shared = written(keyed.join(met.hint("merge"), "token").select("token", F.struct("pos", "size", "node").alias("own")), "shared")
    release(spark)

    def pairs_of(met: DataFrame) -> DataFrame:
        met = met.where(_may_be_alike("own", "other"))
        return met.select(F.least("own.node", "other.node").alias("u"), F.greatest("own.node", "other.node").alias("v")).distinct()

    def with_earliest() -> DataFrame:
        earliest = shared.groupBy("token").agg(F.min("own").alias("other"))
        return pairs_of(shared.join(earliest.hint("merge"), "token").where("own.node <> other.node"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = nodes.join(classes.select("node", F.col("same").alias("wanted"), F.col("doc_id").alias("at")).hint("merge"), "node")
        texts = rows.join(wanted.hint("merge"), (F.col("same") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("at"))).select("node", "text")
        return written(texts, "texts").dropDuplicates(["node"])  # repeated rows have one text

    def across(own: DataFrame) -> DataFrame:
        other = own.select("token", F.col("own").alias("other"), F.col("comp").alias("other_comp"))
        return pairs_of(own.join(other.hint("merge"), "token").where("comp > other_comp"))

    def with_all(comps: DataFrame) -> DataFrame:
        own = shared.join(comps.hint("merge"), F.col("own.node") == comps.node, "left").select("token", "own", F.coalesce("component", "own.node").alias("comp"))
        mixed = own.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).where("low < high")
        own = written(own.join(mixed.select("token", "members").hint("merge"), "token"), "mixed")
        crowd = written(own.where(F.col("members") > FEW).select("own.node", "comp").distinct(), "crowd")
        sets = written(texts_of(crowd.select("node")).mapInArrow(_sets, "node long, tokens array<long>"), "sets")
        release(spark)
        each = sets.select("node", F.explode("tokens").alias("token"))
        counted = each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
        common = each.join(counted.hint("merge"), "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("common"))
        size = F.col("size")
        alone, prefix = size - F.size("common"), size - F.floor((4 * size + 4) / 5) + 1  # shingles of no other text come first
        first = F.slice("common", 1, F.greatest(prefix - alone, F.lit(0)).cast("int"))
        anew = sets.select("node", F.size("tokens").alias("size")).join(common.hint("merge"), "node").select("node", "size", alone.alias("alone"), F.posexplode(first).alias("i", "t"))
        anew = anew.join(crowd.hint("merge"), "node").select("t.token", F.struct((F.col("alone") + F.col("i")).alias("pos"), "size", "node").alias("own"), "comp")
        few = across(own.where(F.col("members") <= FEW))
        return few.unionAll(across(written(anew, "anew"))).distinct()

    def sided(table: DataFrame, side: str, *columns: str) -> DataFrame:
        return table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sided(classes, "u", "bits", "size").hint("merge"), "u").join(sided(classes, "v", "bits", "size").hint("merge"), "v")
        likely = written(both.mapInArrow(_allowed, "u long, v long"), "likely")
        release(spark)
        needed = likely.select(F.col("u").alias("node")).unionAll(likely.select(F.col("v").alias("node"))).distinct()
        texts = texts_of(needed)
        release(spark)
        links = written(likely.join(sided(texts, "u", "text").hint("merge"), "u").join(sided(texts, "v", "text").hint("merge"), "v").mapInArrow(_verified, "u long, v long"), "links")
        release(spark)
        return links

    def by_fingerprint() -> DataFrame:
        reps = written(classes.groupBy("fp").agg(F.min("node").alias("rep")), "reps")
        equal = classes.select("fp", "node").join(reps.hint("merge"), "fp").where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
        links = written(links_of(reps).unionAll(equal), "alike")
        release(spark)
        return links

    first = linked(with_earliest())
    if fingerprints:
        first = by_fingerprint().unionAll(first)
    links = first.unionAll(linked(with_all(connected_components(first))))
    comps = connected_components(links)
    groups = classes.select("same", "node").join(comps.hint("merge"), "node", "left").select("same", F.coalesce("component", "node").alias("group"))
    named = written(marked.join(groups.hint("merge"), "same"), "named")
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return named.join(least.hint("merge"), "group").select("doc_id", "same", "times", "group", "component_id")


def with_one_kept(docs: DataFrame) -> DataFrame:
    """``doc_id, same, times, kept`` of every different row; one of each group of texts that fingerprints or shingles link is kept: the least id (nulls last), then the least digest."""
    named = written(near_copies(docs, fingerprints=True).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")), "groups")
    first = named.groupBy("group").agg(F.min("rank").alias("first"))
    return written(named.join(first.hint("merge"), "group").select("doc_id", "same", "times", F.col("rank").eqNullSafe(F.col("first")).alias("kept")), "kept")
