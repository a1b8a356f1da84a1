"""Token ids in a binary file format with one zstandard dictionary.

A file is a table of shards. Each shard holds documents in ascending order of id: ``doc_ids``, ``starts`` (tokens before
the document within its partition), ``frames`` (byte offsets into ``payload``, one more than documents), ``payload``
(one zstandard frame per document) and the SHA-256 of the dictionary. A short document is read by decompressing its own
frame. The dictionary is trained on serialized id arrays of at most about ``SAMPLES`` documents chosen by a hash of the id.

Ids come from the tokenizers library as it is loaded: each distinct piece of text is encoded once and cached, since the
library's model works on pieces, and a text that holds the string of an added token goes to the library whole. Partitions
are ranges of id; the tokens before a partition are summed in two levels of windows, and the sums join the shards.

Null and empty texts have the end id only. Null ids sort first. Repeated ids are separate documents, in the order of a
hash of their ids. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probatum.llm.bpe import vocabulary_path
from probatum.llm.common import SLICE, sampled, sliced, some, trim, written
from probatum.llm.pretoken import in_chunks, pieces_of

VOCABULARY, END, SAMPLES, DICTIONARY_BYTES, SHARD_DOCS, SHARD_BYTES, PART_DOCS, CACHE = "byte_bpe_50k.json", 0, 400, 65_536, 512, 1 << 20, 20_000, 500_000
PART_BYTES, PARTS_A_BLOCK = 16 << 20, 4096


class LibraryCache(dict):
    """The serialized ids of pieces, encoded by the library in batches.

    A space and letters are always a piece of their own, so such pieces are given to the library many to a text, and the
    bytes that each token stands for tell their ids apart. A full cache is kept until as many pieces were missing again.
    """

    TOGETHER = 512

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.missed = Tokenizer.from_file(path), 0
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)  # in a byte-level vocabulary each character of a token is one byte

    def library_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learned(self, pieces: list[str]) -> dict[str, bytes]:
        plain, other, out = [], [], {}
        for p in pieces:
            (plain if p[0] == " " and p[1:].isalpha() else other).append(p)
        size = self.kind.itemsize
        groups = [plain[i : i + self.TOGETHER] for i in range(0, len(plain), self.TOGETHER)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, ids in zip(part, self.library_ids(["".join(g) for g in part]), strict=True):
                ends = np.cumsum([len(p.encode()) for p in group])
                token_ends = np.cumsum(self.width[ids])
                last = np.searchsorted(token_ends, ends)
                if not len(ids) or token_ends[-1] != ends[-1] or not np.array_equal(token_ends[last], ends):
                    other += group
                    continue
                raw, cuts = ids.tobytes(), ((last + 1) * size).tolist()
                out.update(zip(group, [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            out.update(zip(part, (ids.tobytes() for ids in self.library_ids(part)), strict=True))
        return out

    def encode_batch(self, texts: list):
        """The serialized ids of each text, one text after another."""
        for run in in_chunks(texts):
            whole = {i: self.library_ids([t])[0].tobytes() for i, t in enumerate(run) if any(x in t for x in self.added)}
            pieces, firsts = pieces_of(["" if i in whole else t for i, t in enumerate(run)] if whole else run)
            got = list(map(self.get, pieces))
            new = missing(got)
            learned = self.learned(list({pieces[i] for i in new}))
            for i in new:
                got[i] = learned[pieces[i]]
            self.keep(learned)
            for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
                yield whole[i] if i in whole else b"".join(got[a:b])

    def keep(self, learned: dict[str, bytes]) -> None:
        if len(self) >= CACHE:
            self.missed += len(learned)
            if self.missed < CACHE:
                return
            self.clear()
            self.missed = 0
        self.update(learned)


def rest() -> None:
    """Drops the cache of a worker that is not about to encode, and gives its memory back."""
    library.cache_clear()
    gc.enable()
    gc.collect()
    trim()


def missing(values: list) -> list[int]:
    """The positions of None."""
    out, i = [], -1
    with contextlib.suppress(ValueError):
        while True:
            i = values.index(None, i + 1)
            out.append(i)
    return out


@functools.lru_cache(maxsize=2)
def library(path: str) -> LibraryCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryCache(path)


def end_of(lib: LibraryCache) -> bytes:
    return np.array([END], dtype=lib.kind).tobytes()


def trained_dictionary(docs: DataFrame, path: str, samples: int = SAMPLES) -> bytes:
    chosen = sampled(docs, F.xxhash64("doc_id", "text", F.lit("zstd")), samples).dropDuplicates(["doc_id", "text"]).limit(2 * samples)

    def serialize(batches):
        lib = library(path)
        for pdf in batches:
            yield pd.DataFrame({"raw": [ids + end_of(lib) for ids in lib.encode_batch(pdf["text"].tolist())]})

    raw = some([bytes(r["raw"]) for r in chosen.select("text").mapInPandas(serialize, "raw binary").collect()], docs)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes are the dictionary
        return b"".join(raw)[:DICTIONARY_BYTES]


def write_tokens(docs: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, bytes, int]:
    """The shards, written in order of id; ``part, base``: the tokens before each partition; the dictionary; the bytes of an id.

    Only the numbers of documents and bytes come to the driver, to choose how many partitions there are.
    """
    path = path or vocabulary_path(VOCABULARY)
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    shared = trained_dictionary(docs, path)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdCompressor(level=3)
        gc.disable()  # the cache is large and free of cycles
        lib = library(path)
        end, size = end_of(lib), lib.kind.itemsize
        for part in sliced(batches):
            n, tie, packed = [], [], []
            for ids in lib.encode_batch(part["text"].to_pylist()):
                n.append(len(ids) // size + 1)
                tie.append(xxhash.xxh3_64_intdigest(ids) >> 1)
                packed.append(press.compress(ids + end))
            yield pa.record_batch({"doc_id": part["doc_id"], "tie": pa.array(tie, pa.int64()), "n": pa.array(n, pa.int64()), "frame": pa.array(packed, pa.binary())})

    packed = written(docs.mapInArrow(frames, f"doc_id {id_type}, tie long, n long, frame binary"), "frames")
    held = packed.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("frame")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-held["docs"] // PART_DOCS), -(-held["bytes"] // PART_BYTES))  # a partition can be one Arrow batch
    digest = hashlib.sha256(shared).hexdigest()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest()
        start, held, size = 0, [], 0

        def full():
            ends = np.cumsum([0, *(len(f) for _, _, f in held)]).tolist()
            ids = pa.array([[d for d, _, _ in held]], pa.list_(kind))
            longs = {"starts": pa.array([starts], pa.list_(pa.int64())), "frames": pa.array([ends], pa.list_(pa.int64()))}
            rest_ = {"payload": pa.array([b"".join(f for _, _, f in held)], pa.binary()), "dictionary": pa.array([digest]), "tokens": pa.array([sum(n for _, n, _ in held)], pa.int64())}
            return pa.record_batch({"first": pa.array([starts[0]], pa.int64()), "doc_ids": ids, **longs, **rest_})

        starts, kind = [], None
        for part in sliced(batches):
            kind = part["doc_id"].type
            for d, n, f in zip(*(part[c].to_pylist() for c in ("doc_id", "n", "frame")), strict=True):
                held.append((d, n, f))
                starts.append(start)
                start, size = start + n, size + len(f)
                if len(held) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield full()
                    held, starts, size = [], [], 0
        if held:
            yield full()

    laid = packed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    file = written(
        laid.mapInArrow(shards, f"first long, doc_ids array<{id_type}>, starts array<long>, frames array<long>, payload binary, dictionary string, tokens long").withColumn("part", F.spark_partition_id()),
        "tokens",
    )
    totals = file.groupBy("part").agg(F.sum("tokens").alias("n")).withColumn("block", F.floor(F.col("part") / PARTS_A_BLOCK))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("n").alias("held"))  # one row for PARTS_A_BLOCK * PART_DOCS documents
    blocks = blocks.select("block", F.coalesce(F.sum("held").over(before().orderBy("block")), F.lit(0)).alias("ahead"))
    bases = totals.join(blocks, "block").select("part", (F.col("ahead") + F.coalesce(F.sum("n").over(before("block").orderBy("part")), F.lit(0))).alias("base"))
    return file, written(bases, "bases"), shared, library(path).kind.itemsize


def read_tokens(file: DataFrame, bases: DataFrame, shared: bytes, size: int) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a token file; ids have ``size`` bytes there."""
    id_type = file.schema["doc_ids"].dataType.elementType.simpleString()
    digest = hashlib.sha256(shared).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest()
        open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdDecompressor()
        for part in sliced(batches, 1):
            row = {c: part[c][0] for c in part.schema.names}
            if row["dictionary"].as_py() != digest:
                raise ValueError(f"the file needs another dictionary than {digest}")
            view, cuts = memoryview(row["payload"].as_buffer()), row["frames"].as_py()
            n, crc = [], []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                ids = np.frombuffer(open_.decompress(view[x:y]), dtype=f"<u{size}").astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids))
            starts = row["starts"].values.to_numpy() + row["base"].as_py()
            yield pa.record_batch({"doc_id": row["doc_ids"].values, "start": pa.array(starts), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    # the written sums are broadcast where Spark finds their files small
    shards = file.join(bases, "part").select("doc_ids", "starts", "frames", "payload", "dictionary", "base")
    return shards.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op7_token_file(docs: DataFrame) -> DataFrame:
    return read_tokens(*write_tokens(docs))
