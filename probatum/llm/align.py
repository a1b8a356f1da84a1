"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A run of texts is laid end to end as bytes, each text as a space and the text. The ends of A's and of B's tokens are counted
once per byte; where both occur, a group is cut, and every byte at which either ends closes one link: the pair of tokens that
overlap there (a pair overlaps in one interval, so links and such bytes correspond one to one). Ranks among ends are prefix sums
that start anew with each text, and sums of a text are differences of prefix sums at its byte offsets.

Ids come from the libraries. Byte-level pieces and runs of white space and word are encoded once each and cached, as no token crosses them;
a piece of B whose bytes are not its text's marks the text. A text too long for a run is cut before a blank between two ASCII letters, where a
token of both ends; where there is no such blank for long, the run is longer.

Counts of id pairs are corpus-wide: a batch of texts keeps its distinct pairs and their numbers; these meet by pair, and counts and
whether a pair is its B id's best come back to the batch by pair. A batch holds at most about ``BATCH_LINKS`` links, or one run.

Null and empty texts, and texts whose tokens do not give back space and text byte by byte in both tokenizers, have no tokens: zeros and ''.
Repeated rows and null ids are rows of their own and all count. Other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.bpe import vocabulary_path
from probatum.llm.common import written
from probatum.llm.pretoken import pieces_of
from probatum.llm.tokenfile import LibraryCache

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a run, links of a batch, cached words, the longest cached word, words given to a library at once.
RUN, BATCH_LINKS, CACHE, LONGEST, TOGETHER = 1 << 20, 4_000_000, 300_000, 64, 256
BLANK = "▁"


class Bytes(LibraryCache):
    """Serialized ids of the byte-level tokenizer; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of each text's."""
        pieces, firsts = pieces_of(texts)
        got = list(map(self.get, pieces))
        new = [i for i, x in enumerate(got) if x is None]
        learned = self.learned(list({pieces[i] for i in new}))
        for i in new:
            got[i] = learned[pieces[i]]
        self.keep({k: v for k, v in learned.items() if len(k) <= LONGEST})
        return _joined(got, firsts, self.kind)


class Pieces(dict):
    """Serialized ids of the piece tokenizer, by words with the blanks before them; None where the pieces' bytes are not the word's."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) for p in names):
            raise ValueError("a piece of this vocabulary crosses words")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.width = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.kind = np.dtype("<u2" if len(names) <= 1 << 16 else "<u4")

    def learned(self, words: list[str]) -> dict[str, bytes | None]:
        """Words begin with a blank, which the library adds by itself."""
        out = {" ": np.array([self.library.piece_to_id(BLANK)], dtype=self.kind).tobytes()} if " " in words else {}
        words = [w for w in words if w != " "]
        for word, ids in zip(words, self.library.encode([w[1:] for w in words], num_threads=1), strict=True):
            same = BLANK not in word and b"".join(map(self.bytes_of.__getitem__, ids)) == word.encode("utf-8", "surrogatepass")
            out[word] = np.array(ids, dtype=self.kind).tobytes() if same else None
        return out

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts (each begins with a blank), the number of each text's, and whether they give the text back."""
        words, firsts = [], [0]
        for text in texts:
            words += words_of(text)
            firsts.append(len(words))
        new = list({w for w in words if w not in self})
        learned = {}
        for at in range(0, len(new), TOGETHER):
            learned |= self.learned(new[at : at + TOGETHER])
        got = [self[w] if w in self else learned[w] for w in words]
        if len(self) + len(learned) > CACHE:
            self.clear()
        self.update((w, x) for w, x in learned.items() if len(w) <= LONGEST)
        firsts = np.array(firsts)
        lost = [i for i, x in enumerate(got) if x is None]
        for i in lost:
            got[i] = b""
        fine = np.ones(len(texts), dtype=bool)
        fine[np.searchsorted(firsts, lost, side="right") - 1] = False
        return *_joined(got, firsts, self.kind), fine


def words_of(text: str) -> list[str]:
    """A text that begins with a blank, cut before every run of blanks."""
    out, held = [], ""
    for part in text.split(" ")[1:]:
        held += " "
        if part:
            out.append(held + part)
            held = ""
    return [*out, held] if held else out


def _joined(got: list[bytes], firsts: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)]) // kind.itemsize
    return np.frombuffer(b"".join(got), dtype=kind), np.diff(ends[firsts])


@functools.lru_cache(maxsize=1)
def tokenizers(a: str, b: str) -> tuple[Bytes, Pieces]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Bytes(a), Pieces(b)


def cut(text: str, most: int) -> list[str]:
    """A text in parts of about ``most`` characters that begin with a blank between two ASCII letters."""
    out, at = [], 0
    while len(text) - at > most:
        to = at + most
        while (to := text.find(" ", to)) >= 0:
            if to + 1 < len(text) and all(c.isascii() and c.isalpha() for c in (text[to - 1], text[to + 1])):
                break
            to += 1
        if to < 0:
            break
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def runs_of(texts: list, most: int = RUN):
    """Runs of parts of texts, as parts with the position of their text; each part begins with a blank."""
    run, size = [], 0
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        for part in cut(" " + text, most):
            if run and size + len(part) > most:
                yield run
                run, size = [], 0
            run.append((i, part))
            size += len(part)
    if run:
        yield run


def _digits(size: int) -> np.ndarray:
    """The decimal form of each id followed by its separator: ',' inside a group, '|' after its last A token, ';' after its last B token; zero bytes fill up."""
    wide = len(str(size - 1))
    table = np.zeros((3, size, wide + 1), dtype=np.uint8)
    for i in range(size):
        raw = str(i).encode()
        table[:, i, : len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        table[:, i, len(raw)] = [ord(c) for c in ",|;"]
    return table


@functools.lru_cache(maxsize=1)
def digits(size: int) -> np.ndarray:
    return _digits(size)


class Aligned:
    """A run of parts aligned: per part its numbers of tokens, groups and links; for all links their codes; the groups as bytes with their offsets."""

    def __init__(self, a_ids: np.ndarray, b_ids: np.ndarray, a_width: np.ndarray, b_width: np.ndarray, sizes: np.ndarray, sides: int):
        """``sizes``: bytes of each part; tokens of both sides cover the parts' bytes exactly."""
        total = int(sizes.sum())
        last = np.cumsum(sizes) - 1
        ends_a, ends_b = np.cumsum(a_width[a_ids]) - 1, np.cumsum(b_width[b_ids]) - 1
        ends = np.bincount(ends_a, minlength=total).astype(np.uint8)
        ends |= np.bincount(ends_b, minlength=total).astype(np.uint8) << 1
        at = np.flatnonzero(ends)
        kinds = ends[at]
        in_a, in_b, both = (kinds & 1).astype(np.int64), (kinds >> 1).astype(np.int64), (kinds == 3).astype(np.int64)
        a_of, b_of, group_of = (np.cumsum(x) - x for x in (in_a, in_b, both))
        upto = np.searchsorted(at, last, side="right")
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], upto])])
        self.n_a, self.n_b, self.n_groups = sums(in_a), sums(in_b), sums(both)
        self.n_links = np.diff(np.concatenate([[0], upto]))
        self.codes = (a_ids[a_of].astype(np.uint32) << np.uint32(15)) | b_ids[b_of].astype(np.uint32)
        # a group's A tokens come before its B tokens: a token moves by the other side's tokens of groups before it (or of its own too)
        closing = np.flatnonzero(both)
        a_group, b_group = group_of[in_a == 1], group_of[in_b == 1]
        b_before = np.concatenate([[0], b_of[closing] + 1])[a_group]
        a_before = (a_of[closing] + 1)[b_group]
        table = digits(sides)
        kind, ids = np.zeros(len(a_ids) + len(b_ids), dtype=np.int64), np.zeros(len(a_ids) + len(b_ids), dtype=np.int64)
        to_a, to_b = np.arange(len(a_ids)) + b_before, np.arange(len(b_ids)) + a_before
        ids[to_a], ids[to_b] = a_ids, b_ids
        kind[to_a[a_of[closing]]], kind[to_b[b_of[closing]]] = 1, 2
        wide = table[kind, ids]
        held = wide != 0
        self.text = wide[held].tobytes()
        offsets = np.concatenate([[0], np.cumsum(held.sum(1))])
        self.offsets = offsets[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]


def aligned(texts: list, a: Bytes, b: Pieces):
    """For each run: positions of the texts of its parts, the alignment of the parts, and whether tokens gave each part back."""
    for run in runs_of(texts):
        where, parts = np.array([i for i, _ in run]), [p for _, p in run]
        raws = [len(p.encode("utf-8", "surrogatepass")) for p in parts]
        b_ids, n_b, fine = b.run(parts)
        a_ids, n_a = a.run(parts)
        sizes = np.array(raws, dtype=np.int64)
        for ids, n, width in ((a_ids, n_a, a.width), (b_ids, n_b, b.width)):
            ends = np.concatenate([[0], np.cumsum(width[ids])])
            fine &= np.diff(ends[np.concatenate([[0], np.cumsum(n)])]) == sizes
        a_ids, b_ids = a_ids[np.repeat(fine, n_a)], b_ids[np.repeat(fine, n_b)]
        yield where, Aligned(a_ids, b_ids, a.width, b.width, np.where(fine, sizes, 0)[fine], len(a.width)), fine


class Batch:
    """Texts on their way to one row: their numbers, digests, and links as positions among the batch's distinct pairs."""

    NUMBERS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, id_type: pa.DataType):
        self.id_type, self.ids, self.numbers, self.digests, self.codes, self.owners, self.links = id_type, [], [], [], [], [], 0

    def add(self, ids: pa.Array, texts: list, a: Bytes, b: Pieces) -> None:
        """Aligns whole texts; a text's parts are put together again."""
        first = len(self.ids)
        n = len(texts)
        numbers, digests, spoilt = np.zeros((n, 4), dtype=np.int64), [None] * n, np.zeros(n, dtype=bool)
        codes, owners = [], []
        for where, run, fine in aligned(texts, a, b):
            spoilt[where[~fine]] = True
            where = where[fine]
            numbers_of = np.stack([run.n_a, run.n_b, run.n_groups, run.n_links], axis=1)
            np.add.at(numbers, where, numbers_of)
            codes.append(run.codes)
            owners.append(np.repeat(where, run.n_links))
            view = memoryview(run.text)
            for i, start, end in zip(where.tolist(), run.offsets[:-1].tolist(), run.offsets[1:].tolist(), strict=True):
                digests[i] = digests[i] or [hashlib.sha256(), b""]
                digests[i][0].update(digests[i][1])
                digests[i][0].update(view[start : end - 1])
                digests[i][1] = b";"
        numbers[spoilt] = 0
        if codes:
            codes, owners = np.concatenate(codes), np.concatenate(owners)
            if spoilt.any():
                stay = ~spoilt[owners]
                codes, owners = codes[stay], owners[stay]
            self.codes.append(codes)
            self.owners.append(owners + first)
            self.links += len(codes)
        self.ids += ids.to_pylist()
        self.numbers.append(numbers)
        self.digests += ["" if bad or d is None else d[0].hexdigest() for d, bad in zip(digests, spoilt, strict=True)]

    def row(self) -> dict:
        """Pairs in order of frequency; per text the sorted positions of its pairs as differences, and how often it holds each."""
        codes = np.concatenate([*self.codes, np.zeros(0, dtype=np.uint32)]).astype(np.int64)
        owners = np.concatenate([*self.owners, np.zeros(0, dtype=np.int64)])
        pairs, place, times = np.unique(codes, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        held, often = np.unique(owners * len(pairs) + rank[place], return_counts=True)
        owner, at = np.divmod(held, max(1, len(pairs)))
        steps = np.diff(at, prepend=0)
        firsts = np.flatnonzero(np.diff(owner, prepend=-1))
        steps[firsts] = at[firsts]
        press = zstandard.ZstdCompressor(level=1).compress
        numbers = np.concatenate([*self.numbers, np.zeros((0, 4), dtype=np.int64)])
        return {
            "ids": self.ids, **dict(zip(self.NUMBERS, numbers.T.tolist(), strict=True)), "digests": self.digests, "distinct": np.bincount(owner, minlength=len(self.ids)).tolist(),
            "steps": press(_planes(steps)), "often": press(_planes(often)), "pairs": pairs[order].astype(np.int32), "times": times[order].astype(np.int32),
        }


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, lowest bytes first: bytes of one kind lie together."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


_ROW = "ids array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, distinct array<long>, steps binary, often binary, pairs array<int>, times array<int>"


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Batches of aligned texts, written, and ``code, n, best``: the corpus-wide count of every pair (``code`` is A id * 2^15 + B id) and whether it is its B id's highest."""
    path_a, path_b = path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def batched(batches):
        a, b = tokenizers(path_a, path_b)
        gc.disable()  # the caches are large and free of cycles
        held = None
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(ids), 64):
                held = held or Batch(ids.type)
                held.add(ids.slice(at, 64), texts.slice(at, 64).to_pylist(), a, b)
                if held.links >= BATCH_LINKS:
                    yield _record(held)
                    held = None
        if held and held.ids:
            yield _record(held)

    rows = docs.select("doc_id", "text").mapInArrow(batched, _ROW.format(id=id_type))
    batches = written(rows.withColumn("batch", F.monotonically_increasing_id()), "aligned")
    pairs = batches.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("code"), F.col("p.times").cast("long").alias("n"))
    counts = written(pairs.groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("code").bitwiseAND(F.lit((1 << 15) - 1)).alias("b")
    highest = counts.groupBy(b_id).agg(F.max("n").alias("most"))
    return batches, counts.withColumn("b", b_id).join(highest, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _record(held: Batch) -> pa.RecordBatch:
    row = held.row()
    types = {"ids": pa.list_(held.id_type), "digests": pa.list_(pa.string()), "steps": pa.binary(), "often": pa.binary(), "pairs": pa.list_(pa.int32()), "times": pa.list_(pa.int32())}
    return pa.RecordBatch.from_pydict({k: pa.array([v], type=types.get(k, pa.list_(pa.int64()))) for k, v in row.items()})


def scored(batches: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every text."""
    id_type = batches.schema["ids"].dataType.elementType.simpleString()

    def told(rows):
        for batch in rows:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                codes, n, best = (row[c].values.to_numpy(zero_copy_only=False) if row[c].is_valid else np.zeros(0, dtype=np.int64) for c in ("codes", "ns", "bests"))
                order = np.argsort(codes)
                mine = row["pairs"].values.to_numpy()
                to = order[np.searchsorted(codes[order], mine)] if len(mine) else np.zeros(0, dtype=np.int64)
                n, best = n[to].astype(np.int64), best[to].astype(np.int64)
                steps, often = _values(row["steps"].as_py()), _values(row["often"].as_py())
                distinct = row["distinct"].values.to_numpy()
                firsts = np.concatenate([[0], np.cumsum(distinct)])
                run = np.concatenate([[0], np.cumsum(steps)])
                at = run[1:] - np.repeat(run[firsts[:-1]], distinct)
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[firsts])  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({
                    "doc_id": row["ids"].values, **{c: row[c].values for c in Batch.NUMBERS},
                    "n_best": pa.array(sums(often * best[at])), "count_sum": pa.array(sums(often * n[at])), "groups_sha256": row["digests"].values,
                })

    asked = batches.select("batch", F.explode("pairs").alias("code"))
    answers = asked.join(counts, "code").groupBy("batch").agg(F.collect_list(F.struct("code", "n", "best")).alias("a"))
    answers = answers.select("batch", F.col("a.code").alias("codes"), F.col("a.n").alias("ns"), F.col("a.best").alias("bests"))
    rows = batches.drop("times").join(answers.hint("shuffle_hash"), "batch", "left").drop("batch")
    return rows.mapInArrow(told, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_alignment(docs: DataFrame) -> DataFrame:
    return scored(*alignment(docs))
