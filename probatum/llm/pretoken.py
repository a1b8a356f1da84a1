"""Vectorised pre-tokenisation: the boundaries of the public byte-level pattern, found without regular expressions.

A table gives each code point its class (other, letter, number, white space). Reading a character is a transition
function on the splitter's state. Composition of such functions is associative, so all prefixes could be scanned in
parallel; for this pattern the composition is constant after one character (the class just read decides the state, with
one character of look-ahead for the last white space of a run), and after at most three for contractions. The scan over
whole arrays therefore closes after shifts by up to three positions, which is what ``boundaries`` does.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points that ``\\s`` matches.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
QUOTE, BLANK = ord("'"), ord(" ")
ONE, TWO = "stmd", ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    table[WHITE] = SPACE
    return table


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions at which a piece starts; ``firsts`` holds the positions at which a document starts."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[points]
    first = np.zeros(n + 3, dtype=bool)
    first[firsts[firsts < n]] = True
    first[n:] = True
    start = np.zeros(n + 3, dtype=bool)
    start[:n] = first[:n]
    start[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    start[last] = True
    start[last[points[last] == BLANK] + 1] = False
    at = np.flatnonzero((points == QUOTE) & start[:n])
    if len(at):
        ahead = np.zeros((2, len(at)), dtype=np.uint32)
        for j in (1, 2):
            inside = ~first[at + 1] if j == 1 else ~first[at + 1] & ~first[at + 2]
            ahead[j - 1, inside] = points[at[inside] + j]
        one = np.isin(ahead[0], [ord(c) for c in ONE])
        two = np.zeros(len(at), dtype=bool)
        for a, b in TWO:
            two |= (ahead[0] == ord(a)) & (ahead[1] == ord(b))
        for size, found in ((2, at[one]), (3, at[two])):
            start[found + 1] = False
            start[found + size] = True
    return np.flatnonzero(start[:n])


def pieces_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all ``texts`` in order, and for each text the position of its first piece (one more at the end)."""
    whole = "".join(texts)
    firsts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=firsts[1:])
    starts = boundaries(codepoints(whole), firsts)
    ends = [*starts[1:].tolist(), len(whole)] if len(starts) else []
    return [whole[a:b] for a, b in zip(starts.tolist(), ends, strict=True)], np.searchsorted(starts, firsts)


def in_chunks(texts: list, most: int = 1 << 19):
    """Runs of ``texts`` of about ``most`` characters (a longer text is a run of its own); null counts as empty."""
    run, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
