"""Bibliography text as reference rows: BibTeX, lists of DOIs, and files that may be either."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from probatum.functions import text as words
from probatum.sources.shared import written

#: Accent commands and the combining marks they stand for.
ACCENTS = {
    '"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306",
    "v": "\u030c", "H": "\u030b", "r": "\u030a", "c": "\u0327", "k": "\u0328", "d": "\u0323", "b": "\u0331",
}
#: Letter commands.
LETTERS = {
    "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ",
    "dj": "đ", "DJ": "Đ", "ng": "ŋ", "NG": "Ŋ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "i", "j": "j",
}
#: Entry types without references.
OTHER = ("comment", "string", "preamble")
SCHEMA = "raw string, title string, authors array<string>, year int, doi string, venue string, url string"
_TOKEN = re.compile(r"""\\[A-Za-z]+|\\[^A-Za-z{}]|[{}",=]|[^\\{}",=]+|\\""", re.S)
_ENTRY, _NAME, _YEAR = re.compile(r"@([^{]*)\{"), re.compile(r"([A-Za-z][\w-]*)\s*$", re.ASCII), re.compile(r"\d{4}")


def _close(tokens: list[str], at: int) -> int:
    """The place of the token that closes the brace at ``at``; the number of tokens if none does."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i] == "{") - (tokens[i] == "}")
        if not depth:
            return i
    return len(tokens)


def _accented(tokens: list[str], at: int, mark: str) -> tuple[str, int] | None:
    """The letter that an accent before ``at`` falls on, with its mark, and the place after it."""
    braced = False
    while at < len(tokens) and (tokens[at].isspace() or (tokens[at] == "{" and not braced)):
        braced |= tokens[at] == "{"
        at += 1
    if at == len(tokens):
        return None
    t = tokens[at]
    letter, rest = (t[1], "") if t in ("\\i", "\\j") else (t.lstrip()[:1], t.lstrip()[1:])
    if not (letter.isascii() and letter.isalpha()):
        return None
    tokens[at] = rest
    if braced and not rest and tokens[at + 1 : at + 2] == ["}"]:
        at += 2
    elif not rest:
        at += 1
    return letter + mark, at


def plain_value(raw: str) -> str:
    """A field's value as text: commands of letters and accents as the letters they stand for, no braces, spaces squeezed."""
    tokens, out, at = _TOKEN.findall(raw), [], 0
    while at < len(tokens):
        t, name = tokens[at], tokens[at][1:] if tokens[at][0:1] == "\\" else None
        at += 1
        if name in LETTERS:
            out.append(LETTERS[name])
            if at < len(tokens):
                tokens[at] = tokens[at].lstrip()
            at += 2 * (tokens[at : at + 2] == ["{", "}"])
        elif name in ACCENTS and (not name.isalpha() or tokens[at : at + 1] == ["{"] or tokens[at : at + 1] and tokens[at][:1].isspace()) and (got := _accented(tokens, at, ACCENTS[name])):
            out.append(got[0])
            at = got[1]
        elif t not in ("{", "}"):
            out.append(t)
    text = "".join(out)
    return " ".join((unicodedata.normalize("NFC", text) if "\\" in raw else text).split())


def fields(body: str) -> dict[str, str]:
    """The fields of an entry's body, its key first; names in lower case, of repeated ones the last."""
    tokens = _TOKEN.findall(body)
    at = tokens.index(",") + 1 if "," in tokens else len(tokens)
    found, before = {}, ""
    while at < len(tokens):
        t = tokens[at]
        at += 1
        if t != "=" or not (name := _NAME.search(before)):
            before = t if t in ("{", "}", ",", '"', "=") else before + t
            continue
        while at < len(tokens) and tokens[at].isspace():
            at += 1
        if at == len(tokens):
            break
        first = tokens[at]
        if first == "{":
            end = _close(tokens, at)
            value = tokens[at + 1 : end]
        elif first == '"':
            end = next((i for i in range(at + 1, len(tokens)) if tokens[i] == '"'), len(tokens))
            value = tokens[at + 1 : end]
        else:
            end = next((i for i in range(at, len(tokens)) if tokens[i] == ","), len(tokens))
            value = tokens[at:end]
        found[name[1].lower()] = plain_value("".join(value))
        at, before = end + 1, ""
    return found


def references(text: str | None) -> list[tuple]:
    """``raw, title, authors, year, doi, venue, url`` of every entry that has fields."""
    out, at, text = [], 0, text or ""
    while m := _ENTRY.search(text, at):
        depth, at = 0, len(text) + 1
        for t in _TOKEN.finditer(text, m.end() - 1):
            depth += (t[0] == "{") - (t[0] == "}")
            if not depth:
                at = t.end()
                break
        body = text[m.end() : at - 1]
        f = {} if m[1].strip().lower() in OTHER else fields(body)
        if f:
            year = _YEAR.search(f.get("year", ""))
            authors = [a for a in map(str.strip, re.split(r"\s+and\s+", f.get("author", ""))) if a]
            out.append((body.strip(), f.get("title", ""), authors, int(year[0]) if year else None, f.get("doi", ""), f.get("journal") or f.get("booktitle") or "", f.get("url", "")))
    return out


@udtf(returnType=SCHEMA)
class BibtexReferences:
    """``bibtex_references(text)`` for SQL, once registered with ``register``."""

    def eval(self, text: str):
        yield from references(text)


def register(spark: SparkSession) -> None:
    spark.udtf.register("bibtex_references", BibtexReferences)


def parse_bibtex(files: DataFrame) -> DataFrame:
    """References of ``files (path, text)``, whole files at a time."""

    def parse(batches):
        for pdf in batches:
            rows = [(p, *r) for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in references(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "raw", "title", "authors", "year", "doi", "venue", "url"]).astype({"year": "Int32"})

    out = files.select("path", "text").mapInPandas(parse, f"path string, {SCHEMA}")
    return out.withColumn("doi", words.doi(F.col("doi")))


#: Where a scan of BibTeX stands: outside of entries, after an "@" and before its brace, or (1 and more) as many braces deep.
OUTSIDE, AFTER_AT, SEGMENT = 0, -1, 1 << 20
_MARK = re.compile("[@{}]")


class Passage:
    """What a piece of text does to a scan, whatever state the scan comes in with; ``a.then(b)`` is associative.

    ``ends`` maps the states outside, after "@", and each depth that the piece closes to the state at its end and the number of entries begun in it. From
    greater depths it adds ``net`` braces and begins none.
    """

    def __init__(self, net: int = 0, ends: dict[int, tuple[int, int]] | None = None):
        self.net, self.ends = net, ends if ends is not None else {OUTSIDE: (OUTSIDE, 0), AFTER_AT: (AFTER_AT, 0)}

    @classmethod
    def of(cls, text: str) -> Passage:
        marks = [m[0] for m in _MARK.finditer(text)]
        n, depth, low, closes, open_, partner = len(marks), [0], 0, [], [], {}
        for i, c in enumerate(marks):
            depth.append(depth[-1] + (c == "{") - (c == "}"))
            if c == "{":
                open_.append(i)
            elif c == "}" and open_:
                partner[open_.pop()] = i
            if depth[-1] < low:
                low = depth[-1]
                closes.append(i + 1)  # a scan that came in -low deep is outside from here
        # from the back: how a scan ends that is outside, or after an "@", at each mark
        outside, after = [(OUTSIDE, 0)] * (n + 1), [(AFTER_AT, 0)] * (n + 1)
        for i in range(n - 1, -1, -1):
            outside[i], after[i] = outside[i + 1], after[i + 1]
            if marks[i] == "@":
                outside[i] = (after[i + 1][0], after[i + 1][1] + 1)
            elif marks[i] == "{":
                after[i] = outside[partner[i] + 1] if i in partner else (1 + depth[n] - depth[i + 1], 0)
        return cls(depth[n], {OUTSIDE: outside[0], AFTER_AT: after[0]} | {d: outside[at] for d, at in enumerate(closes, 1)})

    def at(self, state: int) -> tuple[int, int]:
        return self.ends.get(state) or (state + self.net, 0)

    def then(self, other: Passage) -> Passage:
        ends = {}
        for s, (state, begun) in self.ends.items():
            end, more = other.at(state)
            ends[s] = (end, begun + more)
        for d in other.ends:
            if d > 0 and (s := d - self.net) > 0 and s not in self.ends:
                ends[s] = other.ends[d]
        return Passage(self.net + other.net, ends)

    def told(self) -> str:
        return json.dumps([self.net, [[s, *e] for s, e in self.ends.items()]])

    @classmethod
    def read(cls, told: str) -> Passage:
        net, ends = json.loads(told)
        return cls(net, {s: (end, n) for s, end, n in ends})


def entries_in(text: str, state: int, begun: int):
    """Pieces of entries in a text that a scan enters in ``state`` after ``begun`` entries, as ``ordinal, piece, whole``."""
    first, whole = (0, False) if state != OUTSIDE else (None, False)
    for m in _MARK.finditer(text):
        if state == OUTSIDE:
            if m[0] == "@":
                state, begun, first, whole = AFTER_AT, begun + 1, m.start(), True
        elif state == AFTER_AT:
            state = 1 if m[0] == "{" else state
        else:
            state += (m[0] == "{") - (m[0] == "}")
            if state == OUTSIDE:
                yield begun, text[first : m.end()], whole
                first = None
    if first is not None:
        yield begun, text[first:], False


def _segments(size: int):
    def cut(batches):
        held, length, key, seq = [], 0, None, 0

        def full():
            text = "".join(held)
            return pd.DataFrame([{"path": key[0], "block": key[1], "seq": seq, "text": text, "passage": Passage.of(text).told()}])

        for pdf in batches:
            for path, block, line in zip(pdf["path"], pdf["block"], pdf["value"], strict=True):
                if held and (key != (path, block) or length >= size):
                    yield full()
                    seq, held, length = (seq + 1 if key == (path, block) else 0), [], 0
                elif key != (path, block):
                    seq = 0
                key = (path, block)
                held.append(line + "\n")
                length += len(line) + 1
        if held:
            yield full()

    return cut


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    whole = Passage()
    for told in pdf["passage"]:
        whole = whole.then(Passage.read(told))
    return pd.DataFrame([{"path": pdf["path"].iloc[0], "block": pdf["block"].iloc[0], "passage": whole.told()}])


def _entered(order: str):
    """The state and the number of entries begun with which a scan enters each passage, in order."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, states = pdf.sort_values(order), []
        state, begun = int(pdf["state"].iloc[0]), int(pdf["begun"].iloc[0])
        for told in pdf["passage"]:
            states.append((state, begun))
            state, more = Passage.read(told).at(state)
            begun += more
        return pdf[["path", "block", "seq"]].assign(state=[s for s, _ in states], begun=[b for _, b in states])

    return walk


_FOUND = ["raw", "title", "authors", "year", "doi", "venue", "url"]


def _pieces(batches):
    for pdf in batches:
        rows = []
        for row in pdf.itertuples():
            for ordinal, piece, whole in entries_in(row.text, row.state, row.begun):
                if not whole:
                    rows.append((row.path, ordinal, row.block, row.seq, piece, *[None] * 7))
                else:
                    rows += [(row.path, ordinal, row.block, row.seq, None, *r) for r in references(piece)]
        if rows:
            yield pd.DataFrame(rows, columns=["path", "ordinal", "block", "seq", "piece", *_FOUND]).astype({"year": "Int32"})


def _joined(key, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(key[0], *r) for r in references("".join(pdf.sort_values(["block", "seq"])["piece"]))]
    return pd.DataFrame(rows, columns=["path", *_FOUND]).astype({"year": "Int32"})


def read_references(spark: SparkSession, path: str, segment: int = SEGMENT) -> DataFrame:
    """What ``parse_bibtex`` finds in the files under ``path``, for files of any size: no file is read as one row.

    Spark reads splits of lines. Each split is cut into segments, and each segment tells what it does to a scan (``Passage``). These are composed per split, the splits
    of a file are walked through, and then each split's segments, so that every segment knows in which state, and after how many entries, the scan enters it.
    Entries within a segment are parsed there; only pieces of entries that cross segments are brought together.
    """
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    segments = written(lines.mapInPandas(_segments(segment), "path string, block long, seq long, text string, passage string"), "segments")
    marks = segments.select("path", "block", "seq", "passage")
    entered = "path string, block long, seq long, state int, begun long"
    blocks = marks.groupBy("path", "block").applyInPandas(_composed, "path string, block long, passage string")
    start = {"state": F.lit(OUTSIDE), "begun": F.lit(0).cast("long")}
    into = blocks.withColumns(start | {"seq": F.lit(0).cast("long")}).groupBy("path").applyInPandas(_entered("block"), entered).drop("seq")
    states = marks.join(into, ["path", "block"]).groupBy("path", "block").applyInPandas(_entered("seq"), entered)
    pieces = written(segments.drop("passage").join(states, ["path", "block", "seq"]).mapInPandas(_pieces, f"path string, ordinal long, block long, seq long, piece string, {SCHEMA}"), "pieces")
    whole = pieces.where("piece is null").select("path", *_FOUND)
    crossing = pieces.where("piece is not null").groupBy("path", "ordinal").applyInPandas(_joined, f"path string, {SCHEMA}")
    return whole.unionAll(crossing).withColumn("doi", words.doi(F.col("doi")))


def parse_dois(files: DataFrame) -> DataFrame:
    """``path, doi`` of every line that holds a DOI; blank lines and comments do not count."""
    rows = files.select("path", F.explode(F.split(F.coalesce("text", F.lit("")), "\r\n|[\r\n]")).alias("line")).withColumn("line", F.trim("line")).where("line <> '' and line not like '#%'")
    return rows.select("path", words.doi(F.col("line")).alias("doi")).where(F.col("doi").rlike("10\\.[0-9]{4,9}/"))


def parse_any(files: DataFrame) -> DataFrame:
    """References of files of either kind; what looks like BibTeX but yields nothing is read as a list of DOIs."""
    looks = F.endswith("path", F.lit(".bib")) | (F.contains("text", F.lit("@")) & F.contains("text", F.lit("=")))
    bib = parse_bibtex(files.where(looks))
    rest = files.join(bib.select("path").distinct(), "path", "left_anti")
    return bib.select("path", "doi", "title", "authors", "year", "venue", "url").unionByName(parse_dois(rest), allowMissingColumns=True)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
