"""Problem 9: evaluation passages inside training text.

Method: spaced seeds. A seed is a fixed mask over ``run`` consecutive words of which some positions don't count. Masked hashes
of all windows of the evaluation texts are joined with those of all windows of the corpus; around each hit the overlap is
verified, with substituted words allowed. A window that agrees in every word agrees under every mask, so no exact passage of
``run`` words is missed. The masks are all choices of a few groups of positions to ignore, as many as there may be substitutions,
so that whatever the places of those, one mask ignores them all, and no passage with substitutions is missed either.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

_RUN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Seeds:
    run: int = 12
    #: Share of equal words that an overlap with substitutions must have.
    same: float = 0.8
    #: Evaluation words per block, each of which is sent to all tasks (16 bytes a word and 16 a seed, 15 seeds a word: about 260 MB a block).
    block_words: int = 1_000_000

    @property
    def least(self) -> int:
        """Equal words that ``run`` words in a row must have."""
        return int(np.ceil(self.same * self.run))


def masks(seeds: Seeds) -> list[np.ndarray]:
    """Positions that count, for each mask. The positions are dealt into four groups more than there may be substitutions (15
    masks of eight of 12 positions for two), and each mask ignores another choice of as many groups as there may be."""
    off = seeds.run - seeds.least
    groups = np.array_split(np.arange(seeds.run), min(seeds.run, off + 4))
    return [np.concatenate([g for k, g in enumerate(groups) if k not in out]) for out in combinations(range(len(groups)), off)]


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    if not text:
        return []
    if "İ" in text:  # the one letter whose lower case holds a mark that is no letter
        return [w.lower() for w in _RUN.findall(text)]
    return _RUN.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: np.ndarray) -> np.ndarray:
    return _mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class _Block:
    """Evaluation texts as one row of word numbers, and their seeds in hash order. Words of no evaluation text are number 0."""

    FILTER_BITS = 22

    def __init__(self, items: list[tuple[int, str]], seeds: Seeds):
        self.seeds, self.number = seeds, {}
        texts = [(i, [self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)]) for i, t in items]
        gap = [0]
        self.words = np.array(gap + [n for _, ws in texts for n in (*ws, 0)], np.int64)  # a 0 parts texts
        self.gaps = np.flatnonzero(self.words == 0)
        self.item = np.array(gap + [i for i, ws in texts for _ in (*ws, 0)], np.int64)
        starts = np.arange(max(0, len(self.words) - seeds.run + 1))
        inside = np.lib.stride_tricks.sliding_window_view(self.words, seeds.run).all(axis=1) if len(starts) else np.zeros(0, bool)
        starts = starts[inside]
        at, h = [], []
        self.masks = masks(seeds)
        for m in range(len(self.masks)):
            h.append(self.hashes(_word_hashes(self.words), starts, m))
            at.append(starts)
        self.h, self.at = np.concatenate(h), np.concatenate(at)
        order = np.argsort(self.h, kind="stable")
        self.h, self.at = self.h[order], self.at[order]
        self.filter = np.zeros(1 << self.FILTER_BITS, bool)
        self.filter[self.h >> np.uint64(64 - self.FILTER_BITS)] = True

    def hashes(self, v: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
        """Of the windows of ``run`` words at ``starts``, under mask ``m``; v: hashes of the words."""
        h = np.full(len(starts), m + 1, np.uint64)
        for j in self.masks[m].tolist():
            h += v[starts + j] * np.uint64(2 * (j * 0x9E3779B97F4A7C15 % (1 << 62)) + 1)
        return _mix(h)

    def equal(self, doc: np.ndarray, p: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Equal words of the windows at ``p`` in doc and ``e`` in the evaluation texts."""
        return sum((doc[p + j] == self.words[e + j]).astype(np.int64) for j in range(self.seeds.run))

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, longest run of equal words, words of the largest overlap, equal words in it) of each pair found."""
        get, parts, ends = self.number.get, [np.zeros(1, np.int64)], [1]
        for t in texts:
            ws = words_of(t)
            parts.append(np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)))
            parts.append(np.zeros(1, np.int64))
            ends.append(ends[-1] + len(ws) + 1)
        doc, ends, run = np.concatenate(parts), np.array(ends), self.seeds.run
        if len(doc) < run or not len(self.h):
            return
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        spans: dict[tuple[int, int], tuple[int, int]] = {}  # (row, diagonal) -> where the last overlap on it lies
        # Windows inside a text in which enough words are known: only words of the evaluation texts can match.
        starts = np.arange(len(doc) - run + 1)
        row_of = np.searchsorted(ends, starts, side="right") - 1
        known = np.concatenate(([0], np.cumsum(doc > 0)))
        starts = starts[(row_of >= 0) & (starts + run < ends[row_of + 1]) & (known[run:] - known[:-run] >= self.seeds.least)]
        v = _word_hashes(doc)
        for m in range(len(self.masks)):
            h = self.hashes(v, starts, m)
            hit = self.filter[h >> np.uint64(64 - self.FILTER_BITS)]
            pos, h = starts[hit], h[hit]
            lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
            for k in range(0, len(pos), 4096):  # hits of some windows at a time
                a, n = lo[k : k + 4096], (hi - lo)[k : k + 4096]
                p = np.repeat(pos[k : k + 4096], n)
                e = self.at[np.arange(len(p)) + np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n)]
                good = self.equal(doc, p, e) >= self.seeds.least
                p, e = p[good], e[good]
                for p, row, e in zip(p.tolist(), (np.searchsorted(ends, p, side="right") - 1).tolist(), e.tolist()):
                    begin, end = spans.get((row, e - p), (0, 0))
                    if begin <= p and p + run <= end:
                        continue
                    if (found := self._overlap(doc, int(ends[row]), int(ends[row + 1]) - 1, p, e)) is not None:
                        spans[(row, e - p)] = found[3:]
                        key = (row, int(self.item[e]))
                        best[key] = max(best.get(key, (0, 0, 0)), found[:3])
        for (row, item), (longest, size, same) in best.items():
            yield row, item, longest, size, same

    def _overlap(self, doc: np.ndarray, low: int, high: int, p: int, e: int) -> tuple[int, int, int, int, int] | None:
        """The overlap on the diagonal of a hit: (longest equal run, words, equal words, begin, end), None if the hit is chance.

        It reaches from the hit to both sides while, of every ``run`` words, at least ``same`` are equal.
        """
        run, least = self.seeds.run, self.seeds.least
        k = int(np.searchsorted(self.gaps, e))
        left, right = min(p - low, e - int(self.gaps[k - 1]) - 1), min(high - p, int(self.gaps[k]) - e)
        d, q = doc[p - left : p + right], self.words[e - left : e + right]
        eq = (d == q).astype(np.int64)
        sums = np.convolve(eq, np.ones(run, np.int64), "valid") if len(eq) >= run else np.zeros(0, np.int64)
        if len(sums) <= left or sums[left] < least:
            return None
        good = np.flatnonzero(sums < least)
        a = good[good < left].max() + 1 if (good < left).any() else 0
        b = (good[good > left].min() - 1 if (good > left).any() else len(sums) - 1) + run
        part = eq[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], part, [0]))))
        longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
        return longest, int(b - a), int(part.sum()), p - left + int(a), p - left + int(b)


def find_leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, seeds: Seeds = Seeds()) -> DataFrame:
    """(doc_id, item_id, longest_run INT, overlap_words INT, equal_words INT): pairs of which a passage of at least ``run``
    words agrees in at least ``same`` of its words; longest_run is the longest stretch of equal words within the overlap
    with the longest stretch.

    Items that share a text all count. Null, empty and short texts match nothing. A repeated document row gives its rows
    again; null ids are kept as they are. The corpus is read once per block of items and isn't shuffled. Blocks have a bounded
    number of words, so what a task receives doesn't grow with the items; the driver holds one block at a time, and the pairs of
    all but the last are stored in the shared folder.
    """
    rows = items.filter(F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).toLocalIterator()
    source = corpus.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    stored, block, size = [], [], 0
    for r in rows:
        n = len(words_of(r.t))
        if size and size + n > seeds.block_words:
            hits, sent = _hits(source, block, seeds)
            stored.append(cut(hits))
            sent.unpersist()
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    out = reduce(DataFrame.unionByName, [*stored, _hits(source, block, seeds)[0]])
    return out.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "longest_run", "overlap_words", "equal_words")


def _hits(source: DataFrame, block: list[tuple[int, str]], seeds: Seeds) -> tuple[DataFrame, Broadcast]:
    """The pairs of one block of items, and the block as it is sent."""
    sent, name = source.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(name, sent, seeds)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at : at + 500]
                found = list(index.search(some["t"].tolist()))
                ids = some["d"].tolist()
                yield pd.DataFrame([(ids[r], *rest) for r, *rest in found], columns=["d", "i", "longest_run", "overlap_words", "equal_words"])

    kind = dict(source.dtypes)["d"]
    return source.mapInPandas(run, f"d {kind}, i bigint, longest_run int, overlap_words int, equal_words int"), sent


#: The index a worker made last, by its block's name; a worker's later tasks use it again.
_MADE: dict[str, _Block] = {}


def _index(name: str, sent: Broadcast, seeds: Seeds) -> _Block:
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = _Block(sent.value, seeds)
    return _MADE[name]
