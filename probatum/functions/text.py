"""String functions of bibliographic comparison, as columns; Arrow UDFs only for what SQL lacks."""

from __future__ import annotations

import sys
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters without a Unicode decomposition and their comparison forms.
UNDECOMPOSED = {
    "ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D",
    "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ħ": "h", "Ħ": "H",
    "ŧ": "t", "Ŧ": "T", "ı": "i", "İ": "I", "ŀ": "l", "Ŀ": "L",
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
    "ŋ": "ng", "Ŋ": "NG", "ə": "e", "Ə": "E", "ʼ": "'", "’": "'",
}
#: Marks that a decomposed letter carries go; letters without a decomposition get their form above.
_STRIPPED = {ord(k): v for k, v in UNDECOMPOSED.items()} | {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}
ASCII = r"^[\x00-\x7F]*$"


def plain(values: pd.Series) -> pd.Series:
    """A column's plain forms: folded to ASCII where that is possible, lower case, runs of anything but letters and digits one space."""
    bare = values.fillna("").str.normalize("NFKD").str.translate(_STRIPPED)
    return bare.str.lower().str.replace(r"[\W_]+", " ", regex=True).str.strip()


def plain_surnames(names: pd.Series) -> pd.Series:
    """Of "Last, First" what stands before the comma, else the last word, in plain form."""
    parts = names.fillna("").str.partition(",")
    forms = plain(parts[0])
    return forms.where(parts[1] != "", forms.str.rpartition(" ")[2])


def plain_title(text: str | None) -> str:
    return plain(pd.Series([text or ""]))[0]


def similarity(cited: str, recorded: str) -> float:
    """Ratcliff-Obershelp ratio of two plain titles; the cited one comes first, since the measure is not symmetric."""
    return SequenceMatcher(None, cited, recorded).ratio() if cited and recorded else 0.0


@lru_cache(maxsize=1 << 14)
def _remembered(cited: str, recorded: str) -> float:
    """Many references cite one record in one way; a worker computes that once."""
    return similarity(cited, recorded)


@F.pandas_udf(T.StringType())
def _plain_udf(texts: pd.Series) -> pd.Series:
    """Plain forms of a batch's different values; nulls, which need none, stay null."""
    values = texts.dropna().drop_duplicates()
    return texts.map(dict(zip(values, plain(values), strict=True))) if len(values) else texts


@F.pandas_udf(T.DoubleType())
def _similarity_udf(cited: pd.Series, recorded: pd.Series) -> pd.Series:
    both = cited.notna() & recorded.notna()
    out = pd.Series(float("nan"), index=cited.index, dtype="float64").astype(object).where(both, None)
    for i in both.index[both]:
        out[i] = _remembered(cited[i], recorded[i])
    return out


def doi(raw: Column) -> Column:
    """A DOI without its URL or ``doi:`` prefix; its own case is kept, null is empty."""
    bare = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.trim(F.regexp_replace(bare, r"(?i)^doi:\s*", ""))


def ascii_title(raw: Column) -> Column:
    """The plain title of ASCII text, JVM-side."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z0-9]+", " "))


def title(raw: Column) -> Column:
    """The plain title; the UDF gets null for rows that are ASCII."""
    raw = F.coalesce(raw, F.lit(""))
    return F.when(raw.rlike(ASCII), ascii_title(raw)).otherwise(_plain_udf(F.when(~raw.rlike(ASCII), raw)))


def with_plain(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the plain form of a column, in place: to join different values back would shuffle the whole rows once for each column."""
    return rows.withColumn(name, title(F.col(column)))


def known_ratio(cited: Column, recorded: Column) -> Column:
    """The similarity of two plain titles where no search is needed: equal, empty, or one the beginning of the other; else null."""
    a, b = F.length(cited), F.length(recorded)
    begins = F.startswith(cited, recorded) | F.startswith(recorded, cited)
    short = b < 200  # from there on the measure leaves out letters that are frequent in the recorded title
    return F.when((cited == "") | (recorded == ""), F.lit(0.0)).when(cited == recorded, F.lit(1.0)).when(begins & short, 2.0 * F.least(a, b) / (a + b))


def title_ratio(cited: Column, recorded: Column) -> Column:
    """Similarity of two plain titles; the UDF gets null for pairs that need no search."""
    known = known_ratio(cited, recorded)
    return F.coalesce(known, _similarity_udf(F.when(known.isNull(), cited), F.when(known.isNull(), recorded)))


def with_ratio(rows: DataFrame, cited: str, recorded: str, name: str) -> DataFrame:
    """Adds the similarity of two columns of plain titles, in place."""
    return rows.withColumn(name, title_ratio(F.col(cited), F.col(recorded)))


def surname(name: Column) -> Column:
    """Of an ASCII "Last, First" what stands before the comma, else the last word."""
    return F.when(F.contains(name, F.lit(",")), ascii_title(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(ascii_title(name), " "), -1))


@F.pandas_udf(T.DoubleType())
def _overlap_udf(cited: pd.Series, recorded: pd.Series) -> pd.Series:
    """All names of a batch are folded at once; rows without arrays give null."""
    if not cited.notna().any():
        return pd.Series([None] * len(cited), dtype="float64")
    sides = []
    for side in (cited, recorded):
        flat = side.explode()
        sides.append(plain_surnames(flat.astype("object").where(flat.notna(), "")).groupby(level=0).agg(list))
    shares = []
    for row, names, known in zip(cited, sides[0], sides[1], strict=True):
        held = [n for n in names if n]
        shares.append(None if row is None else sum(n in known for n in held) / len(held) if held else 0.0)
    return pd.Series(shares, dtype="float64")


def ascii_names(cited: Column, recorded: Column) -> Column:
    return F.array_join(cited, "").rlike(ASCII) & F.array_join(recorded, "").rlike(ASCII)


def ascii_overlap(cited: Column, recorded: Column) -> Column:
    """The share of cited surnames (repeats count) that are among the recorded ones; 0 if none is cited. ASCII names only."""
    known = F.transform(recorded, surname)
    names = F.filter(F.transform(cited, surname), lambda s: s != "")
    return F.when(F.size(names) > 0, F.size(F.filter(names, lambda s: F.array_contains(known, s))) / F.size(names)).otherwise(F.lit(0.0))


def author_overlap(cited: Column, recorded: Column) -> Column:
    """``ascii_overlap`` for names of any script; the UDF gets null for rows that are ASCII."""
    native = ascii_names(cited, recorded)
    return F.when(native, ascii_overlap(cited, recorded)).otherwise(_overlap_udf(F.when(~native, cited), F.when(~native, recorded)))


def with_overlap(rows: DataFrame, cited: str, recorded: str, name: str) -> DataFrame:
    """Adds the author overlap of two array columns, in place."""
    return rows.withColumn(name, author_overlap(F.col(cited), F.col(recorded)))


def arxiv_pdf(bare_doi: Column) -> Column:
    """The PDF address of an arXiv DOI, else empty."""
    number = F.regexp_extract(bare_doi, r"(?i)^10\.48550/arxiv\.(.+)$", 1)
    return F.when(number != "", F.concat(F.lit("https://arxiv.org/pdf/"), number)).otherwise(F.lit(""))


def reference_key(row_doi: Column, row_title: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(row_doi, F.lit("")), F.nullif(row_title, F.lit("")), F.nullif(F.substring(raw, 1, 80), F.lit("")), F.lit("(unidentified)"))
