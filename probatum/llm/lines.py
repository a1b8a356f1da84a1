"""Line deduplication with two Bloom filters.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of at least ``LEAST_CHARS``
code points that ``LEAST_DOCS`` documents or more hold lose their lines everywhere but in the greatest id that holds them.

Every task puts the hashes of its documents' keys into a partial pair of filters: the bits of keys seen once, and of keys
seen twice. The pair is cut into slots of a fixed number of bits, and the number of slots follows the number of lines, so
that load and memory are the same at every size. Partial filters meet per slot: a bit that two of them hold as
seen once is seen twice. A key is suspected if all its bits are set in the filter of twice-seen keys; a key that two
documents hold always is. Only suspected keys shuffle, as (id, SHA-256 of the key); counting documents per digest confirms them
exactly and chooses the document that keeps them. Only documents with a suspected key carry their text into the last join.

The filter of twice-seen keys goes to all tasks while it has at most ``FILTER_BYTES``. A larger one stays cut into slots,
and hashes and digests of lines are dealt to the slots, each of which is read as a stream. Results are the same.

Null and empty texts are one empty line. Rows that share an id are one document, as are all rows without an id, which come
before all others in the choice of the greatest; each row is returned. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import written

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Bits of a slot, and the keys it is made for: 16 bits a key, of which each key sets two.
SLOT_BITS, SLOT_KEYS = 1 << 22, 1 << 18
#: Hashes that a task holds before it lays them down as partial filters; the largest filter that every task gets whole.
FLUSH, FILTER_BYTES, SALTS = 2_000_000, 64 << 20, 16
WHITE = " \t\n\x0b\f\r"


def key_of(line: str, least: int) -> bytes | None:
    """The key of a line in UTF-8, if it is long enough to count; bytes are put in lower case where they are A-Z."""
    key = line.strip(WHITE)
    return key.encode("utf-8", "surrogatepass").lower() if len(key) >= least else None


def lines_of(text) -> list[str]:
    return (text if isinstance(text, str) else "").split("\n")


def long_keys(text, least: int) -> list[bytes]:
    """The distinct keys of a text that are long enough to count."""
    return list({k for x in lines_of(text) if (k := key_of(x, least)) is not None})


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


def places(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slot of each hash and its two bits there."""
    first = (hashes // np.uint64(slots)) & np.uint64(SLOT_BITS - 1)
    second = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS.bit_length() + 1)
    return (hashes % np.uint64(slots)).astype(np.int64), first.astype(np.int64), second.astype(np.int64)


def _packed(at: np.ndarray) -> bytes:
    """Sorted bit positions as differences."""
    return zstandard.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(raw), dtype="<u4"), dtype=np.int64)


def _partial(held: list[np.ndarray], slots: int) -> pd.DataFrame:
    """The partial pair of filters of some documents' hashes, a row for each slot."""
    hashes, times = np.unique(np.concatenate(held), return_counts=True)
    slot, first, second = places(hashes, slots)
    order = np.argsort(slot, kind="stable")
    cuts = np.flatnonzero(np.diff(slot[order], prepend=-1, append=-1))
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        again = own[times[own] > 1]
        bits = [np.unique(np.concatenate([first[x], second[x]])) for x in (own, again)]
        rows.append((int(slot[own[0]]), *map(_packed, bits)))
    return pd.DataFrame(rows, columns=["slot", "once", "twice"])


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The filter of twice-seen keys of one slot."""
    once, twice = np.zeros(SLOT_BITS, dtype=bool), np.zeros(SLOT_BITS, dtype=bool)
    for seen, again in zip(pdf["once"], pdf["twice"], strict=True):
        at = _unpacked(seen)
        twice[at[once[at]]] = True
        once[at] = True
        twice[_unpacked(again)] = True
    return pd.DataFrame({"slot": pdf["slot"].iloc[:1], "bits": [zstandard.compress(np.packbits(twice).tobytes(), 1)]})


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def bloom_filters(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``slot, bits``: the filter of keys seen in two documents or more, and the number of slots."""
    lines = docs.agg(F.sum(F.regexp_count("text", F.lit(f"[^\\n]{{{least},}}")))).first()[0] or 0
    slots = max(1, -(-lines // SLOT_KEYS))

    def partials(batches):
        held, n = [], 0
        for pdf in batches:
            for text in pdf["text"]:
                if keys := long_keys(text, least):
                    held.append(hashes_of(keys))
                    n += len(keys)
                if n >= FLUSH:
                    yield _partial(held, slots)
                    held, n = [], 0
        if held:
            yield _partial(held, slots)

    partial = docs.select("text").mapInPandas(partials, "slot long, once binary, twice binary")
    return written(partial.groupBy("slot").applyInPandas(_merged, "slot long, bits binary"), "twice"), slots


class Twice:
    """The filter of twice-seen keys, whole; ``suspects`` picks the keys that all their bits are set for."""

    def __init__(self, rows: dict[int, bytes], slots: int):
        self.slots, self.raw = slots, rows

    @functools.cached_property
    def bits(self) -> np.ndarray:
        out = np.zeros((self.slots, SLOT_BITS // 8), dtype=np.uint8)
        for slot, raw in self.raw.items():
            out[slot] = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
        return out.reshape(-1)

    def suspects(self, keys: list[bytes]) -> list[bytes]:
        if not keys:
            return keys
        slot, first, second = places(hashes_of(keys), self.slots)
        hit = _set(self.bits, slot * SLOT_BITS + first) & _set(self.bits, slot * SLOT_BITS + second)
        return [keys[i] for i in np.flatnonzero(hit)]


def _everywhere(docs: DataFrame, filters: DataFrame, slots: int, least: int, id_type: str) -> tuple[DataFrame, DataFrame]:
    """Suspects ``doc_id, digest``, and the documents, tested by each task against the whole filter."""
    sent = docs.sparkSession.sparkContext.broadcast(Twice({r["slot"]: bytes(r["bits"]) for r in filters.collect()}, slots))

    def suspected(batches):
        twice = sent.value
        for pdf in batches:
            found = [twice.suspects(long_keys(t, least)) for t in pdf["text"]]
            ids = pdf["doc_id"].repeat([len(x) for x in found])
            yield pd.DataFrame({"doc_id": ids, "digest": [hashlib.sha256(k).digest() for x in found for k in x]})

    def marked(batches):
        twice = sent.value
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_lines": [len(lines_of(t)) for t in pdf["text"]], "whole": [_digest(t) for t in pdf["text"]], "text": [t if twice.suspects(long_keys(t, least)) else None for t in pdf["text"]]})

    return docs.mapInPandas(suspected, f"doc_id {id_type}, digest binary"), docs.mapInPandas(marked, f"doc_id {id_type}, n_lines long, whole string, text string")


def _by_slot(docs: DataFrame, filters: DataFrame, slots: int, least: int, id_type: str) -> tuple[DataFrame, DataFrame]:
    """The same where the filter is too large for a task: lines go to the slots, and a slot's filter comes first in its stream."""

    def dealt(batches):
        for pdf in batches:
            keys = [long_keys(t, least) for t in pdf["text"]]
            flat = [k for x in keys for k in x]
            slot, first, second = places(hashes_of(flat), slots)
            yield pd.DataFrame({"slot": slot, "salt": first % SALTS, "doc_id": pdf["doc_id"].repeat([len(x) for x in keys]).to_numpy(), "first": first, "second": second, "digest": [hashlib.sha256(k).digest() for k in flat]})

    def tested(batches):
        slot, bits = None, np.zeros(0, dtype=np.uint8)
        for batch in batches:
            at = batch.column("slot").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                raws = [x.as_py() for x in part.column("bits") if x.is_valid]
                if raws:
                    slot, bits = at[a], np.frombuffer(zstandard.decompress(raws[0]), dtype=np.uint8)
                elif slot != at[a]:
                    continue  # no key of this slot was seen twice
                lines = part.filter(part.column("digest").is_valid())
                first, second = (lines.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second"))
                hit = _set(bits, first) & _set(bits, second)
                yield lines.select(["doc_id", "digest"]).filter(pa.array(hit))

    lines = docs.mapInPandas(dealt, f"slot long, salt long, doc_id {id_type}, first long, second long, digest binary").withColumn("bits", F.lit(None).cast("binary"))
    heads = filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    for c in ("doc_id", "first", "second", "digest"):
        heads = heads.withColumn(c, F.lit(None).cast(lines.schema[c].dataType))
    both = lines.unionByName(heads).repartition("slot", "salt").sortWithinPartitions("slot", F.col("bits").isNull())
    facts = docs.select("doc_id", F.size(F.split(_text(), "\n", -1)).cast("long").alias("n_lines"), F.sha2(_text(), 256).alias("whole"), "text")
    return both.mapInArrow(tested, f"doc_id {id_type}, digest binary"), facts


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _digest(text) -> str:
    return hashlib.sha256((text if isinstance(text, str) else "").encode("utf-8", "surrogatepass")).hexdigest()


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents ``doc_id, n_lines, whole, text`` (``text`` is null where no line can be a repeat), and ``doc_id, gone``: the digests of the keys that a document loses."""
    docs = docs.select("doc_id", "text")
    filters, slots = bloom_filters(docs, least_chars)
    test = _everywhere if slots * SLOT_BITS // 8 <= filter_bytes else _by_slot
    suspects, marked = test(docs, filters, slots, least_chars, docs.schema["doc_id"].dataType.simpleString())
    suspects = written(suspects, "suspects")
    held = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    known = suspects.groupBy("digest").agg(held.alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= least_docs)
    # a key that very many documents hold is split by their ids; the confirmed keys are few and go to all splits
    known = known.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    split = suspects.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    gone = split.join(known, ["digest", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return marked, gone.groupBy("doc_id").agg(F.collect_set("digest").alias("gone"))


def without_repeats(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256, kept``; ``kept`` is the remaining text, and null where the text stays as it is."""
    marked, gone = repeated_lines(docs, least_chars, least_docs, filter_bytes)
    id_type = marked.schema["doc_id"].dataType.simpleString()

    def dropped(batches):
        for pdf in batches:
            n, sha, kept = [], [], []
            for text, whole, lost in zip(pdf["text"], pdf["whole"], pdf["gone"], strict=True):
                lines = lines_of(text) if lost is not None else []
                lost = set(lost) if lost is not None else ()
                stay = [x for x in lines if (k := key_of(x, least_chars)) is None or hashlib.sha256(k).digest() not in lost]
                n.append(len(lines) - len(stay))
                kept.append("\n".join(stay) if n[-1] else None)
                sha.append(_digest(kept[-1]) if n[-1] else whole)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_lines": pdf["n_lines"], "n_dropped": n, "kept_sha256": sha, "kept": kept})

    gone = gone.select(F.col("doc_id").alias("of"), "gone")
    rows = marked.join(gone, F.col("doc_id").eqNullSafe(F.col("of")), "left").withColumn("text", F.when(F.col("gone").isNotNull(), F.col("text")))
    return rows.select("doc_id", "n_lines", "whole", "text", "gone").mapInPandas(dropped, f"doc_id {id_type}, n_lines long, n_dropped long, kept_sha256 string, kept string")


def op11_line_dedup(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
s AS (SELECT doc_id, r, string_split(text, chr(10)) AS parts FROM d),
l AS (SELECT doc_id, r, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= {LEAST_DOCS}),
f AS (SELECT k.*, m.key IS NOT NULL AND k.doc_id IS DISTINCT FROM m.keeper AS gone FROM k LEFT JOIN m ON k.key = m.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY r
"""
