"""Suffix-array deduplication: remove every byte covered by a ``LENGTH``-byte string that also starts elsewhere.

Sharding. Every ``LENGTH``-byte window holds ``LENGTH - GRAM + 1`` grams; its anchor is the leftmost gram with the lowest
hash. Equal windows have equal anchors at equal offsets, so a shard that holds all contexts (the bytes of the windows that
share an anchor) of one anchor hash holds every repeat among them. Anchors whose hash occurs once are dropped, and equal
contexts are sorted once, with their multiplicity.

External induced sorting. Spark's external sorter (sorted runs on disk, merged by a priority queue) orders a shard's
anchor suffixes by hash and following bytes; only the groups of one batch are ever in memory. Their common-prefix values
are taken between neighbours. All longer suffixes are then induced: suffixes that start d bytes before the anchor are in
the order of (byte there, order of the suffixes d - 1 before), a stable sort of tuples, and a common prefix is one more
than the least of those between the two tuples' sources, or zero where the bytes differ. A window repeats if a
neighbour at its step shares ``LENGTH`` bytes or its context has copies.

A hash with more than ``HOT`` different contexts is dealt anew by blocks of ``BLOCK`` windows, keyed by the bytes that
all windows of the block share. With blocks of one window a group holds equal windows only, which are counted with partial sums:
no group of a hot hash is sorted or held, however many contexts it has.

Texts longer than ``SLICE`` bytes are cut into slices that overlap by a window less one byte, so positions fit their 28 bits.
Texts are UTF-8 bytes; null texts are empty; matches never cross documents; repeats are judged on the input. Repeated
rows and equal texts are repeats of each other. Null ids are returned as they are; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import forget, release, written

LENGTH, GRAM, HOT, BLOCK, BATCH, SLICE = 400, 128, 20_000, 1, 8192, 1 << 22
_POSITION_BITS = np.uint64(28)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at every position that has as many."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[raw] * _powers_of(_BASE, len(raw)), out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _powers_of(_INVERSE, len(raw) - gram + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(hash, anchor, first, last)`` of each run of window starts with one anchor; ``ends`` are the documents' ends in ``raw``."""
    if len(raw) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))
    hashes = gram_hashes(raw, gram)
    low = (hashes >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(hashes), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: -(width - have)], low[width - have :])
    at = (low & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(at))
    valid = starts + length <= ends[np.searchsorted(ends, starts, side="right")]
    starts, at = starts[valid], at[valid]
    if not len(starts):
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    return hashes[at[new]], at[new], starts[new], starts[last]


def _anchor_rows(length: int, gram: int, most: int = SLICE):
    def sliced(pdf):
        for blob, text in zip(pdf["blob"], pdf["text"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for base in range(0, max(1, len(raw) - length + 1), most):
                yield blob, raw[base : base + most + length - 1], base

    def runs(pdf):
        held, size = [], 0
        for part in sliced(pdf):
            if held and size + len(part[1]) > 1 << 20:
                yield held
                held, size = [], 0
            held.append(part)
            size += len(part[1])
        if held:
            yield held

    def rows(batches):
        for pdf in batches:
            for run in runs(pdf):
                blobs, raws, bases = zip(*run, strict=True)
                raw, ends = np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum([len(t) for t in raws])
                h, p, lo, hi = anchors(raw, ends, length, gram)
                doc = np.searchsorted(ends, lo, side="right")
                base = np.concatenate([[0], ends])[doc] - np.array(bases)[doc]
                if len(doc):  # Spark 4.1 can't take a frame of binaries without rows
                    yield pd.DataFrame({"blob": [blobs[d] for d in doc], "hash": h.view(np.int64), "p": p - base, "lo": lo - base, "hi": hi - base})

    return rows


def _tag_rows(length: int, block: int | None):
    """Where the contexts of each document's candidate anchors lie, with a digest; whole, or (for hot hashes) by blocks of windows."""
    columns = ["blob", "copies", "first", "left", "size", "key", "tag"]

    def rows(batches):
        for pdf in batches:
            out = []
            for blob, copies, text, marks in zip(pdf["blob"], pdf["copies"], pdf["text"], pdf["marks"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for m in marks:
                    h, p, lo, hi = m["hash"], m["p"], m["lo"], m["hi"]
                    if block is None:
                        parts = [(h, lo, hi)]
                    else:
                        parts = []
                        for b in range((p - hi) // block, (p - lo) // block + 1):  # windows that start block * b to block * (b + 1) - 1 before the anchor
                            core = raw[max(0, p - block * b) : p - block * (b + 1) + 1 + length]
                            key = xxhash.xxh3_64_intdigest(core + h.to_bytes(8, "little", signed=True) + b.to_bytes(4, "little"))
                            parts.append((key - (1 << 64) if key >> 63 else key, max(lo, p - block * (b + 1) + 1), min(hi, p - block * b)))
                    for key, first, last in parts:
                        tag = xxhash.xxh3_128_digest(raw[first : last + length] + key.to_bytes(8, "little", signed=True) + (p - first).to_bytes(4, "little"))
                        out.append((blob, copies, first, p - first, last + length - first, key, tag))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    return rows


def _byte_rows(batches):
    """The bytes before and after the anchor of each wanted context."""
    columns = ["key", "tag", "copies", "left", "right"]
    for pdf in batches:
        out = []
        for text, wants in zip(pdf["text"], pdf["wants"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for w in wants:
                first, p = w["first"], w["first"] + w["left"]
                out.append((w["key"], w["tag"], w["copies"], raw[first:p], raw[p : first + w["size"]]))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)


def induced(group: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Which windows repeat inside groups of contexts that come ordered by group and right part.

    Returns a flag for each context and each number d of bytes that a window starts before the anchor.
    """
    n = len(group)
    left_n, right_n = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    flags = np.zeros((n, int(left_n.max(initial=0)) + 1), dtype=bool)
    if n < 2:
        return flags
    # common prefixes of neighbouring anchor suffixes; -1 between groups
    joined = np.frombuffer(b"".join(rights) + bytes(1), dtype=np.uint8)
    at = np.cumsum(right_n) - right_n
    lcp = np.full(n, -1, dtype=np.int64)
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    for part in np.array_split(same, max(1, len(same) // 4096)):
        most = np.minimum(right_n[part], right_n[part - 1])
        steps = np.arange(int(most.max(initial=0)))
        inside = steps[None, :] < most[:, None]
        x = joined[np.where(inside, at[part][:, None] + steps, 0)]
        y = joined[np.where(inside, at[part - 1][:, None] + steps, 0)]
        differ = (x != y) & inside
        lcp[part] = np.where(differ.any(1), differ.argmax(1) if differ.shape[1] else 0, most)
    before = np.frombuffer(b"".join(lefts) + bytes(1), dtype=np.uint8)
    left_end = np.cumsum(left_n)
    order = np.arange(n)
    for d in range(flags.shape[1]):
        if d:
            keep = np.flatnonzero(left_n[order] >= d)
            if len(keep) < 2:
                break
            if len(keep) < len(order):
                lcp = _least(lcp, np.concatenate([[-1], keep[:-1]]), keep)
                order = order[keep]
            symbol = before[left_end[order] - d].astype(np.int64)
            tuples = group[order] * 256 + symbol
            to = np.argsort(tuples, kind="stable")
            ordered = tuples[to]
            got = np.where(np.concatenate([[False], ordered[1:] == ordered[:-1]]), _least(lcp, np.concatenate([[-1], to[:-1]]), to) + 1, 0)
            fresh = np.concatenate([[True], group[order][to][1:] != group[order][to][:-1]])
            lcp, order = np.where(fresh, -1, got), order[to]
        hit = np.flatnonzero(lcp >= length)
        flags[order[hit], d] = True
        flags[order[hit - 1], d] = True
    return flags


def _least(lcp: np.ndarray, frm: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The least of ``lcp[frm + 1 .. to]`` for each pair; meaningless where frm >= to."""
    out = lcp[to].copy()
    far = np.flatnonzero(to > frm + 1)
    if len(far):
        cuts = np.empty(2 * len(far), dtype=np.int64)
        cuts[::2], cuts[1::2] = frm[far] + 1, to[far] + 1
        padded = np.append(lcp, np.iinfo(np.int64).max)
        out[far] = np.minimum.reduceat(padded, cuts)[::2]
    return out


def _repeats(length: int):
    def found(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= BATCH:
                both = pd.concat(held, ignore_index=True)
                open_ = both["key"] == both["key"].iloc[-1]  # the last group may go on
                if not open_.all():
                    yield from ranges(both[~open_])
                    both = both[open_]
                held = [both]
        if held:
            yield from ranges(pd.concat(held, ignore_index=True))

    def ranges(pdf: pd.DataFrame):
        group = pd.factorize(pdf["key"])[0]
        lefts, rights = pdf["left"].tolist(), pdf["right"].tolist()
        flags = induced(group, lefts, rights, length)
        left_n, right_n = np.array([len(x) for x in lefts], dtype=np.int64), np.array([len(x) for x in rights], dtype=np.int64)
        d = np.arange(flags.shape[1])
        real = (d[None, :] <= left_n[:, None]) & (d[None, :] >= length - right_n[:, None])
        flags = (flags | (pdf["copies"].to_numpy() > 1)[:, None]) & real
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        tags = pdf["tag"].to_numpy()
        if len(i):
            yield pd.DataFrame({"tag": tags[i], "a": left_n[i] - (hi - 1), "b": left_n[i] - lo + length})  # bytes from the context's start

    return found


def _cut(pdf_batches):
    for pdf in pdf_batches:
        out = []
        for blob, text, spans in zip(pdf["blob"], pdf["text"], pdf["spans"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            mark = np.zeros(len(raw) + 1, dtype=np.int32)
            np.add.at(mark, [s["a"] for s in spans], 1)
            np.add.at(mark, [s["b"] for s in spans], -1)
            gone = np.cumsum(mark[:-1]) > 0
            kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
            out.append((blob, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept))
        yield pd.DataFrame(out, columns=["blob", "n_removed", "n_spans", "kept"])


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, most: int = SLICE) -> DataFrame:
    """``blob, n_removed, n_spans, kept`` (bytes) of each text with repeats; ``blob`` is 16 bytes of the text's SHA-256."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("blob", blob_of(F.col("text")))
    long_ = rows.where(F.octet_length("text") >= length)
    marks = written(long_.select("blob", "text").mapInPandas(_anchor_rows(length, gram, most), "blob binary, hash long, p int, lo int, hi int"), "anchors")
    often = marks.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash")
    shared = marks.join(often, "hash").groupBy("blob").agg(F.collect_set(F.struct("hash", "p", "lo", "hi")).alias("marks")).withColumnRenamed("blob", "b")
    reps = long_.groupBy("blob").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    wanted = written(shared.join(reps, shared.b == reps.blob).select("b", "rep", "copies", "marks"), "wanted")
    forget(marks)
    release(spark)
    texts = written(
        rows.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("blob") == F.col("b"))).select("blob", "text", "copies", "marks"), "texts"
    )
    forget(wanted)
    release(spark)
    texts = texts.dropDuplicates(["blob"]) if _repeated(texts) else texts
    tags, crowded = _tagged(texts, length, None, hot)
    spans = _spans(texts, tags.join(crowded, "key", "left_anti") if crowded else tags, length)
    if crowded:
        keys = crowded.select(F.col("key").alias("hash"))
        again = texts.select("blob", F.explode("marks").alias("m")).join(keys, F.col("m.hash") == F.col("hash"), "left_semi")
        again = again.groupBy("blob").agg(F.collect_list("m").alias("marks")).join(texts.drop("marks"), "blob")
        spans = spans.unionAll(_spans(texts, _tagged(again, length, BLOCK, None)[0], length))
    spans = written(spans.groupBy("blob").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    release(spark)
    return texts.select("blob", "text").join(spans.hint("shuffle_hash"), "blob").mapInPandas(_cut, "blob binary, n_removed long, n_spans long, kept binary")


def blob_of(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _tagged(texts: DataFrame, length: int, block: int | None, hot: int | None) -> tuple[DataFrame, DataFrame | None]:
    """The contexts' places and digests; the keys with more than ``hot`` different contexts, if any."""
    schema = "blob binary, copies long, first int, left int, size int, key long, tag binary"
    tags = written(texts.select("blob", "copies", "text", "marks").mapInPandas(_tag_rows(length, block), schema), "tags")
    if hot is None:
        return tags, None
    crowded = written(tags.select("key", "tag").distinct().groupBy("key").count().where(F.col("count") > hot).select("key"), "hot")
    return tags, (crowded if crowded.take(1) else None)


def _spans(texts: DataFrame, tags: DataFrame, length: int) -> DataFrame:
    """``blob, a, b``: the bytes that repeated windows cover.

    A context that is alone under its key is sorted as it stands: its windows repeat if it has copies. The bytes of one copy
    of each other context go to its key's shard.
    """
    place = F.struct("blob", "first", "left", "size")
    once = tags.groupBy("key", "tag").agg(F.sum("copies").alias("copies"), F.min(place).alias("at"))
    once = written(once, "once")
    mixed = once.groupBy("key").count().where("count > 1").select("key")
    alone = once.join(mixed, "key", "left_anti").where("copies > 1").select("tag", F.lit(0).alias("a"), F.col("at.size").alias("b"))
    wants = once.join(mixed, "key").groupBy("at.blob").agg(F.collect_list(F.struct("key", "tag", "copies", "at.first", "at.left", "at.size")).alias("wants"))
    suffixes = texts.select("blob", "text").join(wants.hint("shuffle_hash"), "blob").mapInPandas(_byte_rows, "key long, tag binary, copies long, left binary, right binary")
    shard = suffixes.repartition("key").sortWithinPartitions("key", "right")
    found = written(shard.mapInPandas(_repeats(length), "tag binary, a int, b int"), "ranges")
    release(texts.sparkSession)
    return tags.select("blob", "first", "tag").join(found.unionAll(alone), "tag").select("blob", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))


def _repeated(texts: DataFrame) -> bool:
    """True if a blob comes from several equal rows (repeated rows of one id)."""
    return bool(texts.groupBy("blob").count().where("count > 1").take(1))


def op4_suffix_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    gone = removed(docs).select(F.col("blob"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = F.coalesce("text", F.lit(""))
    every = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("whole")).withColumn("blob", F.substring("whole", 1, 16))
    none = F.lit(0).cast("long")
    return every.join(gone, "blob", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("whole"))).alias("kept_sha256")
    )
