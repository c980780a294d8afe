"""Problem 1: cut oversized texts at natural boundaries.

Method: recursive bisection. A range of text that still exceeds the limit minus the overlap is cut at the strongest
boundary near its middle, both halves are treated alike, and afterwards each piece but the first is given the last words of
the piece before it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class Limits:
    words: int = 350
    chars: int = 3000
    overlap: int = 50


_WORD = re.compile(rf"[^{X.WS}]+")
#: Ends of natural units, strongest first: blank line, line, sentence (with closing marks) before white space or after CJK marks.
_ENDS = (
    re.compile(r"(?:\r\n|[\n\r\u2029])[^\S\n\r]*(?:\r\n|[\n\r\u2029])\s*"),
    re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]+"),
    re.compile(rf"[.!?…]+[\"'»”’)\]]*(?=[{X.WS}])[{X.WS}]+|[。！？।]+"),
)
_NUMBERING = re.compile(rf"(?:^|[{X.WS}])\(?(?:\d{{1,3}}|[A-Za-z])[.)][{X.WS}]+$")


def _glued(text: str, i: int) -> bool:
    """A cut before text[i] would part a character from its marks or joiners."""
    return unicodedata.combining(text[i]) > 0 or text[i] in "\u200d\ufe0f" or text[i - 1] == "\u200d" or 0x1F3FB <= ord(text[i]) <= 0x1F3FF


class _Text:
    def __init__(self, text: str, limits: Limits):
        self.t, self.l = text, limits
        spans = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        taken: set[int] = set()
        self.cuts: list[list[int]] = []
        for k, p in enumerate(_ENDS):
            at = [m.end() for m in p.finditer(text) if k < 2 or not _NUMBERING.search(text, max(0, m.end() - 8), m.end())]
            at = [i for i in at if 0 < i < len(text) and i not in taken]
            taken.update(at)
            self.cuts.append(at)

    def words(self, a: int, b: int) -> int:
        """White-space words that text[a:b] has."""
        return max(0, bisect_left(self.starts, b) - bisect_right(self.ends, a))

    def carry(self, a: int, room_words: int, room_chars: int, low: int) -> int:
        """Where the overlap before ``a`` begins: the last words in text[low:a] that the room allows."""
        last = bisect_left(self.starts, a) - 1  # the last word that begins before a
        at, n = a, 0
        while last >= 0 and n < room_words and self.ends[last] > low:
            begin = max(self.starts[last], low)
            if a - begin > room_chars:
                break
            at, n, last = begin, n + 1, last - 1
        return at

    def fits(self, a: int, b: int) -> bool:
        n, c = self.words(a, b), b - a
        if a == 0:
            return n <= self.l.words and c <= self.l.chars
        need = a - self.carry(a, self.l.overlap, self.l.chars // 2, 0)
        return n <= self.l.words - self.l.overlap and c <= self.l.chars - need

    def middle(self, a: int, b: int) -> int:
        """Half of the words of the range, or half of its characters where those are what exceeds."""
        if self.words(a, b) > self.l.words - self.l.overlap:
            first, last = bisect_right(self.ends, a), bisect_left(self.starts, b)
            return self.starts[(first + last) // 2]
        return (a + b) // 2

    def cut(self, a: int, b: int) -> int:
        mid, quarter = self.middle(a, b), (b - a) // 4
        lo, hi = max(a + 1, mid - quarter), min(b - 1, mid + quarter)
        for x, y in ((lo, hi), (a + 1, b - 1)):  # strongest near the middle, else anywhere inside
            for cuts in self.cuts:
                if (i := self._nearest(cuts, mid, x, y)) is not None:
                    return i
        if (i := self._nearest(self.starts, mid, a + 1, b - 1)) is not None:
            return i
        for d in range(0, b - a):
            for i in (mid - d, mid + d):
                if a < i < b and not _glued(self.t, i):
                    return i
        return mid if a < mid < b else a + 1

    @staticmethod
    def _nearest(xs: list[int], mid: int, x: int, y: int) -> int | None:
        k = bisect_left(xs, mid)
        near = [xs[i] for i in (k - 1, k) if 0 <= i < len(xs) and x <= xs[i] <= y]
        return min(near, key=lambda v: (abs(v - mid), v), default=None)


def split_text(text: str, limits: Limits = Limits()) -> list[str]:
    """The pieces of ``text`` in order, each within the limits; ``[text]`` if it is within them already."""
    return [text[begin:b] for begin, _, b in split_spans(text, limits)]


def split_spans(text: str, limits: Limits = Limits()) -> list[tuple[int, int, int]]:
    """(begin, core, end) of each piece: text[begin:end] is the piece, of which text[begin:core] is the overlap.

    The cores join to the text again. White space at a cut stays at the end of the piece before it.
    An overlap has the last ``limits.overlap`` words of the piece before, or as many as fit; it never reaches beyond that
    piece, and has none if its last word alone doesn't fit.
    """
    x = _Text(text, limits)
    if len(x.starts) <= limits.words and len(text) <= limits.chars:
        return [(0, 0, len(text))]
    cores, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= 1 or x.fits(a, b):
            cores.append((a, b))
        else:
            i = x.cut(a, b)
            todo += [(i, b), (a, i)]
    out, before = [], 0
    for a, b in cores:
        begin = x.carry(a, min(limits.overlap, limits.words - x.words(a, b)), limits.chars - (b - a), before) if a else 0
        out.append((begin, a, b))
        before = begin
    return out


def is_oversized(text: Column, limits: Limits = Limits()) -> Column:
    """True if a text exceeds a limit; never null. Words are counted only where there are bytes enough for so many."""
    return F.coalesce(
        (F.char_length(text) > limits.chars) | ((F.octet_length(text) > 2 * limits.words) & (X.ws_count(text) > limits.words)), F.lit(False)
    )


def split_oversized(df: DataFrame, text_col: str, keys: list[str], limits: Limits = Limits()) -> DataFrame:
    """(*keys, piece_pos INT, n_pieces INT, piece STRING) of every row whose text exceeds the limits.

    Null, empty and blank texts, and texts within the limits, have no rows. Rows are told apart by nothing but themselves:
    a repeated row gives its pieces again. Other columns of ``df`` are left out, so their names can't clash. Only oversized
    texts reach Python; no shuffle.
    """
    big = df.filter(is_oversized(F.col(text_col), limits)).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text_col).alias("text"))
    kinds = dict(big.dtypes)
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pieces = [split_text(t, limits) for t in pdf["text"]]
            out = pdf[names].loc[pdf.index.repeat([len(p) for p in pieces])].reset_index(drop=True)
            out["piece_pos"] = [i for p in pieces for i in range(len(p))]
            out["n_pieces"] = [len(p) for p in pieces for _ in p]
            out["piece"] = [x for p in pieces for x in p]
            yield out

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "piece_pos int", "n_pieces int", "piece string"])
    return big.mapInPandas(run, schema).select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "piece_pos", "n_pieces", "piece")
