"""The most similar of all recorded titles for each cited one, by Ratcliff-Obershelp similarity, without a block key.

The similarity of two titles is 2M/T: M letters in matching blocks, T letters in all. Four steps, each exact for what it settles:

1. Equal titles are an equi-join.
2. Rounds of falling similarity (``ROUNDS``): recorded titles are a tree of their beginnings, block by block, and a cited title goes down it only while the
   longest common subsequence may still reach the round's similarity. That finds all records that reach it, so the best of them is final; the others wait for the next round.
   What many titles begin with is compared once for all of them.
3. An index of q-grams. A pair with U = T - 2M unmatched letters has at most U damaged places, so of U + 1 disjoint q-grams of the cited title
   one stands in the recorded title as it is. A title looks up its p rarest disjoint q-grams, as many as ``POSTINGS`` postings allow, and is compared
   with the records that hold one. What is not met so has p unmatched letters or more, and is at most ``1 - p / (2n + p)`` similar to a title of n letters:
   a better find is final, another one is a lower bound for the next step.
4. What is left is compared with all records, block by block. A pair is looked at while 2 x (common letters) / T, and then 2 x (longest common
   subsequence) / T, may still reach the best so far: matching blocks stand in order, so M is no more than either. The subsequences of a title and a whole
   block come from bits in whole arrays; the measure itself is computed for the few pairs that are left, the most promising first.

Nothing is grouped by a value: blocks have a fixed number of rows, and postings meet titles in an equi-join of at most ``POSTINGS`` rows for each title.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probatum.functions import text
from probatum.sources.shared import written

#: Letters of a q-gram, unmatched letters up to which the index may be complete, the most postings that a title looks up.
Q, UNMATCHED, POSTINGS = 5, 4, 500
#: Titles and records of a block at least, and the letters by which lengths of blocks are compared.
CITED_BLOCK, KNOWN_BLOCK, STRIDE = 128, 4096, 16
#: Blocks of a side, of which each meets the other side's: they grow with the tables up to the largest, so that what is shuffled grows no faster.
SIDES, TREES, LARGEST = 32, 8, 1 << 17
#: The rows here are few and dear, so tasks are dealt by their number and not by their bytes.
PROBES_A_TASK, PAIRS_A_TASK = 4000, 8
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Similarities that the rounds look for, one after the other; titles of a batch, and places in the tree that are looked at together.
ROUNDS, BATCH, FRONT = (0.96, 0.9, 0.875, 0.85), 1024, 1 << 18
#: For 16 bits, of which a set one stands for -1 and another for 1: their sum, and the least sum of the first ones (0 for none).
_SUMS, _LEAST = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
for _bit in range(16):
    _SUMS += 1 - 2 * ((np.arange(1 << 16) >> _bit) & 1)
    np.minimum(_LEAST, _SUMS, out=_LEAST)


class Codes:
    """Titles as a matrix of letter codes, one column per title; 0 fills up."""

    def __init__(self, titles: list[str]):
        self.lengths = np.array([len(t) for t in titles], dtype=np.int64)
        points = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.letters, codes = np.unique(points, return_inverse=True)
        width = int(self.lengths.max(initial=0))
        self.matrix = np.zeros((width, len(titles)), dtype=np.intp)
        column = np.repeat(np.arange(len(titles)), self.lengths)
        row = np.arange(len(points)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.matrix[row, column] = codes + 1
        self.counts = np.zeros((len(self.letters) + 1, len(titles)), dtype=np.int16)
        np.add.at(self.counts, (codes + 1, column), 1)

    def of(self, title: str) -> np.ndarray:
        """The codes of a title's letters; 0 for letters that no title here holds."""
        points = np.frombuffer(title.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.minimum(np.searchsorted(self.letters, points), max(0, len(self.letters) - 1))
        return np.where(self.letters[at] == points, at + 1, 0) if len(self.letters) else np.zeros(len(points), dtype=np.int64)

    def common_letters(self, title: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Letters that titles ``first`` to ``last`` have in common with ``title``, whatever their order."""
        own, n = np.unique(title[title > 0], return_counts=True)
        return np.minimum(self.counts[own, first:last], n[:, None].astype(np.int16)).sum(0, dtype=np.int64)

    def common_subsequence(self, title: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences with the titles at ``at``, 64 letters of ``title`` to a word of bits."""
        words = -(-len(title) // 64)
        places = np.zeros((words, len(self.letters) + 1), dtype=np.uint64)
        for i, c in enumerate(title):
            if c:
                places[i // 64, c] |= np.uint64(1 << (i % 64))
        state = np.full((words, len(at)), _ALL)
        for letters in self.matrix[: int(self.lengths[at].max(initial=0)), at]:
            carry = None
            for w in range(words):
                v, hit = state[w], places[w].take(letters)
                total = v + (v & hit)
                if words > 1:
                    over = total < v
                    if carry is not None:
                        total = total + carry
                        over |= (total == 0) & carry.astype(bool)
                    carry = over.astype(np.uint64)
                state[w] = total | (v & ~hit)
        return np.bitwise_count(~state).sum(0, dtype=np.int64)


class Tree:
    """Different titles by their beginnings: per level (letters from the start) the nodes' letters, children, whole titles, and lengths of the titles below."""

    def __init__(self, titles: list[str]):
        self.titles = sorted(titles)
        lengths = np.array([len(t) for t in self.titles], dtype=np.int64)
        points = np.frombuffer("".join(self.titles).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.letters, codes = np.unique(points, return_inverse=True)
        starts, n = np.cumsum(lengths) - lengths, len(self.titles)
        same, live, depth = np.zeros(n, dtype=np.int64), np.arange(1, n), 0  # letters at the start that a title shares with the one before
        while len(live):
            live = live[(lengths[live] > depth) & (lengths[live - 1] > depth)]
            live = live[codes[starts[live] + depth] == codes[starts[live - 1] + depth]]
            depth += 1
            same[live] = depth
        same[:1] = -1
        self.levels, live, above = [], np.arange(n), np.zeros(1, dtype=np.int64)
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            live = live[lengths[live] >= depth]
            own = live[same[live] < depth]
            parent = np.searchsorted(above, own, "right") - 1
            count = np.bincount(parent, minlength=len(above))
            self.levels.append({"code": codes[starts[own] + depth - 1] + 1, "parent": parent, "count": count, "first": np.cumsum(count) - count, "whole": np.where(lengths[own] == depth, own, -1)})
            above = own
        for depth in range(len(self.levels), 0, -1):
            level = self.levels[depth - 1]
            level["low"], level["high"] = np.where(level["whole"] >= 0, depth, 1 << 40), np.where(level["whole"] >= 0, depth, 0)
            if depth < len(self.levels):
                below = self.levels[depth]
                np.minimum.at(level["low"], below["parent"], below["low"])
                np.maximum.at(level["high"], below["parent"], below["high"])

    def reaching(self, cited: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``cited``, places in ``titles`` and 2 x (longest common subsequence) / T of all pairs for which that is ``least`` (over 0) or more."""
        n, words = np.array([len(t) for t in cited]), -(-max(map(len, cited)) // 64)
        points = np.frombuffer("".join(cited).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.minimum(np.searchsorted(self.letters, points), max(0, len(self.letters) - 1))
        held = np.flatnonzero(self.letters[at] == points) if len(self.letters) else np.zeros(0, dtype=np.int64)
        column, place = np.repeat(np.arange(len(cited)), n)[held], (np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n))[held]
        places = np.zeros((words, len(cited), len(self.letters) + 1), dtype=np.uint64)
        np.bitwise_or.at(places, (place // 64, column, at[held] + 1), np.uint64(1) << (place % 64).astype(np.uint64))
        shortest, longest = n * least / (2 - least) - 1e-9, n * (2 - least) / least + 1e-9
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        todo = [(0, np.arange(len(cited)), np.zeros(len(cited), dtype=np.int64), np.full((len(cited), words), _ALL))]
        while todo:
            depth, who, node, state = todo.pop()
            if depth == len(self.levels) or not len(who):
                continue
            level = self.levels[depth]
            count = level["count"][node]
            if len(node) > 1 and count.sum() > FRONT:
                half = len(node) // 2
                todo += [(depth, who[half:], node[half:], state[half:]), (depth, who[:half], node[:half], state[:half])]
                continue
            of = np.repeat(np.arange(len(node)), count)
            node = level["first"][node][of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]
            near = (level["low"][node] <= longest[who[of]]) & (level["high"][node] >= shortest[who[of]])
            of, node = of[near], node[near]
            who, state, code, carry = who[of], state[of], level["code"][node], None
            for w in range(words):
                v, hit = state[:, w], places[w, who, code]
                total = v + (v & hit)
                if words > 1:
                    over = total < v
                    if carry is not None:
                        total = total + carry
                        over |= (total == 0) & carry.astype(bool)
                    carry = over.astype(np.uint64)
                state[:, w] = total | (v & ~hit)
            # letters that match nothing, of the title's first ones and the record's: at best, all that follow match
            parts, length = np.ascontiguousarray(~state).astype("<u8", copy=False).view("<u2"), n[who]
            lone, total = np.zeros(len(who), dtype=np.int64), np.zeros(len(who), dtype=np.int64)
            for k in range(-(-int(length.max(initial=0)) // 16)):
                np.minimum(lone, total + _LEAST[parts[:, k]], out=lone)
                total += _SUMS[parts[:, k]]
            depth += 1
            keep = depth + lone <= (1 - least) * (length + np.minimum(level["high"][node], longest[who])) + 1e-9
            who, node, state = who[keep], node[keep], state[keep]
            whole = np.flatnonzero(level["whole"][node] >= 0)
            if len(whole):
                ratio = 2.0 * np.bitwise_count(~state[whole]).sum(1, dtype=np.int64) / (n[who[whole]] + depth)
                reached = ratio >= least - 1e-12
                found.append((who[whole][reached], level["whole"][node[whole]][reached], ratio[reached]))
            todo.append((depth, who, node, state))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best_reaching(cited: list[str], tree: Tree, doi_of: dict[str, str], least: float) -> list[tuple[str, float, int, str]]:
    """``cited, similarity, difference of lengths, doi``, as ``best_of_block`` finds them, of the titles that a record of the tree is ``least`` similar to."""
    out = []
    cited = sorted(cited, key=lambda t: -(-len(t) // 64))  # titles of as many words of bits go together
    for at in range(0, len(cited), BATCH):
        part = cited[at : at + BATCH]
        who, which, bound = tree.reaching(part, least)
        order = np.lexsort((which, -bound, who))
        best = {}
        for i, j, b in zip(who[order].tolist(), which[order].tolist(), bound[order].tolist(), strict=True):
            title, record = part[i], tree.titles[j]
            if b < (-best[i][0] if i in best else least) - 1e-12:
                continue
            ratio = 1.0 if record == title else text.similarity(title, record)
            if ratio >= least:
                got = (-ratio, abs(len(record) - len(title)), doi_of[record])
                best[i] = min(best.get(i, got), got)
        out += [(part[i], -r, apart, doi) for i, (r, apart, doi) in best.items()]
    return out


def best_of_block(title: str, known: Codes, titles: list[str], dois: list[str], least: float) -> tuple[float, int, str] | None:
    """``similarity, difference of lengths, doi`` of the best record that reaches ``least``; equal ones by nearest length, then by doi."""
    own, total = known.of(title), known.lengths + len(title)
    near = np.flatnonzero(2.0 * np.minimum(known.lengths, len(title)) >= (least - 1e-12) * total)
    if not len(near):
        return None
    first, last = int(near[0]), int(near[-1]) + 1  # a block is in order of length, so this is its part of near lengths
    at = first + np.flatnonzero(2.0 * known.common_letters(own, first, last) / total[first:last] >= least - 1e-12)
    if not len(at):
        return None
    bound = 2.0 * known.common_subsequence(own, at) / total[at]
    best = None
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] < (best[0] if best else least) - 1e-12:
            break
        j = int(at[i])
        ratio = 1.0 if titles[j] == title else text.similarity(title, titles[j])
        if ratio >= least:
            found = (ratio, -abs(int(known.lengths[j]) - len(title)), dois[j])
            if best is None or found[:2] > best[:2] or (found[:2] == best[:2] and found[2] < best[2]):
                best = found
    return best and (best[0], -best[1], best[2])


def _compared(pairs):
    """The best record of each cited title among the rows at hand; ``bound`` of unmatched pairs decides which are computed."""
    for pdf in pairs:
        rows = []
        for cited, part in pdf.groupby("cited", sort=False):
            titles = part["known"].tolist()
            if found := best_of_block(cited, Codes(titles), titles, part["doi"].tolist(), 0.0):
                rows.append((cited, *found))
        yield pd.DataFrame(rows, columns=["cited", "similarity", "apart", "doi"])


def _blocks_compared(pairs):
    last, slices = None, []
    for pdf in pairs:
        for row in pdf.itertuples():
            if row.block != last:  # a few thousand records at a time stay in the processor's cache
                last, cuts = row.block, range(0, len(row.known), KNOWN_BLOCK)
                parts = [(list(row.known[at : at + KNOWN_BLOCK]), list(row.dois[at : at + KNOWN_BLOCK])) for at in cuts]
                slices = [(Codes(titles), titles, dois) for titles, dois in parts]
            rows = []
            for cited, least in zip(row.cited, row.least, strict=True):
                for codes, titles, dois in slices:
                    if found := best_of_block(cited, codes, titles, dois, least):
                        rows.append((cited, *found))
                        least = max(least, found[0])
            yield pd.DataFrame(rows, columns=["cited", "similarity", "apart", "doi"])


def _near_compared(pairs):
    last, tree, doi_of = None, None, None
    for pdf in pairs:
        for row in pdf.itertuples():
            if row.block != last:
                last, tree, doi_of = row.block, Tree(list(row.known)), dict(zip(row.known, row.dois, strict=True))
            yield pd.DataFrame(best_reaching(list(row.cited), tree, doi_of, float(row.least[0])), columns=["cited", "similarity", "apart", "doi"])


def block_size(rows: int, least: int, sides: int = SIDES) -> int:
    """Rows of a block: what gives ``sides`` blocks, but ``least`` at least and ``LARGEST`` at most."""
    return max(least, min(LARGEST, -(-rows // sides)))


_FOUND = "cited string, similarity double, apart long, doi string"


def _best(found: DataFrame) -> DataFrame:
    """One row per cited title."""
    order = F.struct((-F.col("similarity")).alias("s"), "apart", "doi")
    return found.groupBy("cited").agg(F.min(order).alias("b")).select("cited", (-F.col("b.s")).alias("similarity"), F.col("b.apart").alias("apart"), F.col("b.doi").alias("doi"))


def _grams(title: str, q: int):
    """Hashes of all q-grams of a title, in order."""
    n = F.length(title)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.xxhash64(F.substring(F.col(title), i, F.lit(q)))))


def _probes(cited: DataFrame, postings: DataFrame, q: int, unmatched: int, most: int) -> DataFrame:
    """``cited, gram, places``: the disjoint q-grams that a title looks up, and how many these are, those without postings included.

    At every shift the rarest ones are taken while their postings stay within ``most``; the shift that takes most of them, with the fewest postings, counts.
    """
    own = cited.select("cited", F.posexplode(_grams("cited", q)).alias("at", "gram")).join(postings, "gram", "left").fillna(0, ["n"])
    shift = Window.partitionBy("cited", F.col("at") % q).orderBy("n", "gram", "at")  # a window holds the q-grams of one title
    own = own.withColumn("place", F.row_number().over(shift)).withColumn("upto", F.sum("n").over(shift)).where((F.col("place") <= unmatched + 1) & (F.col("upto") <= most))
    shifts = own.groupBy("cited", (F.col("at") % q).alias("shift")).agg(F.count("*").alias("places"), F.sum("n").alias("total"), F.collect_set(F.when(F.col("n") > 0, F.col("gram"))).alias("g"))
    best = shifts.groupBy("cited").agg(F.min_by(F.struct("g", "places"), F.struct(-F.col("places"), "total", "shift")).alias("b"))
    return best.select("cited", F.explode("b.g").alias("gram"), "b.places")


def _packed(size: int, columns: dict[str, str], extra: dict):
    """Rows in order as blocks of ``size``: arrays of ``columns``, and the least and greatest length of a title."""
    first = next(iter(columns))

    def pack(batches):
        held = []
        for pdf in batches:
            for row in pdf[list(columns)].itertuples(index=False):
                held.append(row)
                if len(held) == size:
                    yield full(held)
                    held = []
        if held:
            yield full(held)

    def full(held):
        lengths = [len(getattr(r, first)) for r in held]
        return pd.DataFrame([{new: [getattr(r, old) for r in held] for old, new in columns.items()} | {"low": min(lengths), "high": max(lengths)} | extra])

    return pack


def best_titles(refs: DataFrame, records: DataFrame, least: float = 0.6, q: int = Q, unmatched: int = UNMATCHED, postings: int = POSTINGS, cited_block: int = CITED_BLOCK, known_block: int = KNOWN_BLOCK) -> DataFrame:
    """``ref_id, similarity, doi``: for each of ``refs (ref_id, title)`` the most similar of all ``records (doi, title)``, if it is at least ``least`` similar.

    Titles are compared in plain form; empty ones take no part. Of records with equal similarity the nearest in length counts, then the least doi (null
    counts as ''). References may repeat.
    """
    refs = written(text.with_plain(refs.select("ref_id", "title"), "title", "cited").where("cited <> ''").select("ref_id", "cited"), "cited")
    known = text.with_plain(records.select("doi", "title"), "title", "known").where("known <> ''")
    known = written(known.groupBy("known").agg(F.min(F.coalesce("doi", F.lit(""))).alias("doi")), "known")
    cited = refs.select("cited").distinct()
    equal = cited.join(known, F.col("cited") == F.col("known")).select("cited", F.lit(1.0).alias("similarity"), F.lit(0).cast("long").alias("apart"), "doi")
    other = written(cited.join(known.select(F.col("known").alias("cited")), "cited", "left_anti"), "unequal")

    by_title = lambda df, c: df.repartitionByRange(c).sortWithinPartitions(c)
    in_a_tree = block_size(known.count(), known_block, TREES)
    trees = by_title(known, "known").mapInPandas(_packed(in_a_tree, {"known": "known", "doi": "dois"}, {}), "known array<string>, dois array<string>, low int, high int")
    trees = written(trees.withColumn("block", F.monotonically_increasing_id()), "trees")
    n_trees, reached = max(1, trees.count()), []
    for reach in (*(s for s in ROUNDS if s > least), *([least] if least >= ROUNDS[-1] else [])):
        if not (rest := other.count()):
            break
        rows = block_size(rest * n_trees, cited_block)
        asked = by_title(other, "cited").withColumn("least", F.lit(float(reach))).mapInPandas(_packed(rows, {"cited": "cited", "least": "least"}, {}), "cited array<string>, least array<double>, low int, high int")
        asked = written(asked.withColumn("part", F.monotonically_increasing_id()), "asked")
        pairs = written(asked.select("part").crossJoin(trees.select("block")), "pairs")  # numbers of blocks of up to LARGEST titles
        both = pairs.join(asked.select("part", "cited", "least").hint("merge"), "part").join(trees.select("block", "known", "dois").hint("merge"), "block")
        near = both.repartition(max(1, -(-pairs.count() // max(1, PAIRS_A_TASK * CITED_BLOCK * KNOWN_BLOCK // (rows * in_a_tree))))).mapInPandas(_near_compared, _FOUND)
        reached.append(written(_best(near), "reached"))
        other = written(other.join(reached[-1].select("cited").hint("merge"), "cited", "left_anti"), "unequal")
    for one in reached:
        equal = equal.unionAll(one)
    if least >= ROUNDS[-1] or not other.take(1):
        return refs.join(_best(equal).where(F.col("similarity") >= least).hint("merge"), "cited").select("ref_id", "similarity", "doi")

    index = known.select("known", "doi", F.explode(F.array_distinct(_grams("known", q))).alias("gram"))
    probes = written(_probes(other, index.groupBy("gram").agg(F.count("*").alias("n")), q, unmatched, postings), "probes")
    near = probes.select("cited", "gram").join(index, "gram").select("cited", "known", "doi").distinct()
    parts = max(1, -(-probes.count() // PROBES_A_TASK))
    near = near.repartition(parts, "cited").sortWithinPartitions("cited").mapInPandas(_compared, _FOUND)
    places = probes.groupBy("cited").agg(F.first("places").alias("places"))
    found = written(_best(near).join(places, "cited"), "near")
    ceiling = 1 - F.col("places") / (2 * F.length("cited") + F.col("places"))
    final = F.col("similarity") > ceiling + 1e-12
    settled = found.where(final).select("cited", "similarity", "apart", "doi")

    left = other.join(found.select("cited", "similarity", final.alias("final")), "cited", "left").where("final is null or not final")
    left = written(left.select("cited", F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(float(least))).alias("least")), "left")
    cited_rows, known_rows = block_size(left.count(), cited_block), block_size(known.count(), known_block)
    by_length = lambda df, c: df.withColumn("n", F.length(c)).repartitionByRange("n", c).sortWithinPartitions("n", c)
    asked = by_length(left, "cited").mapInPandas(_packed(cited_rows, {"cited": "cited", "least": "least"}, {}), "cited array<string>, least array<double>, low int, high int")
    asked = written(asked.withColumn("part", F.monotonically_increasing_id()), "asked")
    held = by_length(known, "known").mapInPandas(_packed(known_rows, {"known": "known", "doi": "dois"}, {}), "known array<string>, dois array<string>, low int, high int")
    held = written(held.withColumn("block", F.monotonically_increasing_id()), "held")
    # a title of n letters reaches s only with titles of n s / (2 - s) to n (2 - s) / s letters
    reach = F.array_min("least")
    low, high = F.floor(F.col("low") * reach / (2 - reach) - 1e-9), F.when(reach > 0, F.ceil(F.col("high") * (2 - reach) / F.greatest(reach, F.lit(1e-9)) + 1e-9)).otherwise(1 << 40)
    longest = F.lit(held.agg(F.max("high")).first()[0] or 0)
    strides = lambda a, b: F.explode(F.sequence(F.floor(a / STRIDE), F.floor(b / STRIDE)))
    heads = asked.select("part", low.alias("from"), F.least(high, longest).alias("to")).where(F.col("from") <= F.col("to"))
    heads = heads.withColumn("stride", strides(F.col("from"), F.col("to")))
    blocks = held.select("block", "low", "high").withColumn("stride", strides(F.col("low"), F.col("high")))
    pairs = written(heads.join(blocks, "stride").where((F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))).select("part", "block").distinct(), "pairs")
    both = pairs.join(asked.select("part", "cited", "least"), "part").join(held.select("block", "known", "dois"), "block")
    a_task = max(1, PAIRS_A_TASK * CITED_BLOCK * KNOWN_BLOCK // (cited_rows * known_rows))
    compared = both.repartition(max(1, -(-pairs.count() // a_task))).mapInPandas(_blocks_compared, _FOUND)
    best = _best(equal.unionAll(settled).unionAll(compared)).where(F.col("similarity") >= least)
    return refs.join(best, "cited").select("ref_id", "similarity", "doi")
