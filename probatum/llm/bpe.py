"""Byte-level BPE encoding and decoding from a file of ranks.

Pieces come from the vectorised pre-tokeniser; each piece's merges are done once and cached (the cache is bounded and
starts afresh beyond ``CACHE`` pieces). Merging takes the pair of lowest rank, leftmost first, from a heap, so very long
pieces stay n log n. Token byte offsets are kept, so that any range of tokens can be decoded on its own.

Null and empty texts have no tokens. Repeated rows and null ids are returned as they are. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from probatum.llm.common import alone, sliced
from probatum.llm.pretoken import in_chunks, pieces_of

VOCABULARY, CACHE = "byte_bpe_multi_50k.tiktoken", 600_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec(dict):
    """Maps a piece to its ids, merging at the first request."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        size = max(self.ranks.values(), default=-1) + 1
        self.bytes_of, self.digits = [b""] * size, [str(i) for i in range(size)]
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self[piece] = self.merge(piece.encode("utf-8", "surrogatepass"))
        return ids

    def merge(self, raw: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return (whole,)
        n = len(raw)
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) < 0 or ends[j] != end:
                continue
            ends[i], after[i], alive[j] = end, after[j], False
            if (k := after[j]) >= 0:
                before[k] = i
                if (r := ranks.get(raw[i : ends[k]])) is not None:
                    heapq.heappush(heap, (r, i, ends[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(raw[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i >= 0:
            out.append(ranks[raw[i : ends[i]]])
            i = after[i]
        return tuple(out)

    def encode_batch(self, texts: list):
        """The ids of each text, as lists, one text after another."""
        for run in in_chunks(texts):
            if len(self) > CACHE:
                self.clear()
            pieces, firsts = pieces_of(run)
            got = list(map(self.__getitem__, pieces))
            for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                yield list(chain.from_iterable(got[a:b]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[int]:
        """The byte at which each token starts, and the end of the last."""
        return list(accumulate((len(self.bytes_of[i]) for i in ids), initial=0))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, offsets``: the token ids of every text and their byte offsets."""
    path = path or vocabulary_path(VOCABULARY)

    def encode(batches):
        c = codec(path)
        for pdf in batches:
            ids = list(c.encode_batch(pdf["text"].tolist()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "offsets": [c.offsets(x) for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(encode, _schema(docs, "ids array<int>, offsets array<long>"))


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, bytes`` from ``tokens (doc_id, ids)``."""
    path = path or vocabulary_path(VOCABULARY)

    def decode(batches):
        c = codec(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "bytes": [c.decode(x.tolist() if x is not None else []) for x in pdf["ids"]]})

    return tokens.select("doc_id", "ids").mapInPandas(decode, _schema(tokens, "bytes binary"))


def _schema(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {rest}"


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again."""
    path = path or vocabulary_path(VOCABULARY)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("bpe", codec.cache_clear)
        c = codec(path)
        for part in sliced(batches):
            n, of_ids, of_bytes = [], [], []
            for ids in c.encode_batch(part["text"].to_pylist()):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch({"doc_id": part["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(digest, _schema(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op6_byte_bpe(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
