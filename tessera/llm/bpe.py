"""Byte-pair encoding with a public rank file, by two exact routes.

``HeapBPE`` keeps a piece as a linked list of symbols with a priority queue of merges (problem 3). ``CutEncoder`` cuts text
where no token can reach across and encodes the fragments independently (problem 8).
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex

#: Where the vocabulary files lie, unless a query is told otherwise.
TOKENIZER_DIR = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
#: The published pre-tokenizer pattern of the rank files. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's memory of fragments; when it is full it is emptied, so its size is bounded and results don't change.
MEMORY = 400_000


def rank_file(name: str, folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pieces(text: str) -> list[str]:
    return _PIECES.findall(text)


_PIECES = regex.compile(PATTERN)
#: White space and what follows it. The pattern never lets a piece go on into white space, and it looks only ahead, at most
#: to the end of its own white space; so pieces of such a fragment are pieces of the whole text.
FRAGMENT = re.compile(r"\s*\S+|\s+")


class _Memory(dict):
    """fragment -> what ``make`` gives for it."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, fragment):
        if len(self) >= MEMORY:
            self.clear()
        self[fragment] = out = self.make(fragment)
        return out


class HeapBPE:
    """Merges inside one piece: a doubly linked list of symbols and a heap of (rank, position) of neighbouring pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.fragments = _Memory(lambda f: sum(len(self.symbols(p.encode())) for p in pieces(f)))

    def symbols(self, piece: bytes) -> list[bytes]:
        if len(piece) < 2 or piece in self.ranks:
            return [piece] if piece else []
        n = len(piece)
        sym: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = sym[i]
            if left is None or (j := after[i]) >= n or len(left) + len(sym[j]) != size:
                continue  # one of the pair has merged since
            sym[i], sym[j] = left + sym[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(sym[i] + sym[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(sym[k])))
            if (h := before[i]) >= 0 and (r := rank(sym[h] + sym[i])) is not None:
                heapq.heappush(heap, (r, h, len(sym[h]) + size))
        return [s for s in sym if s is not None]

    def encode(self, piece: bytes) -> list[int]:
        return [self.ranks[s] for s in self.symbols(piece)]

    def weigh(self, texts: Iterable[str]) -> int:
        """Tokens of all texts: fragments that end where the pattern surely parts are counted, each is encoded once, and its
        surviving symbols are weighted by its frequency."""
        seen: Counter[str] = Counter()
        for t in texts:
            seen.update(FRAGMENT.findall(t))
        return sum(n * self.fragments[f] for f, n in seen.items())


def forced_pairs(ranks: dict[bytes, int]) -> set[bytes]:
    """Byte pairs that occur inside a token. Between the bytes of any other pair there is always a token boundary."""
    return {t[i : i + 2] for t in ranks for i in range(len(t) - 1)}


#: White-space characters of more than one byte, as byte patterns of their last three bytes (None: any). Fixed values.
_WIDE_BLANKS = (
    [(None, 0xC2, x) for x in (0x85, 0xA0)] + [(0xE1, 0x9A, 0x80), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80)] + [(0xE2, 0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)]
)
_BLANKS = (*range(0x09, 0x0E), *range(0x1C, 0x21))
_APOSTROPHE = 0x27


class CutEncoder:
    """Encodes text as it is, without special tokens: bytes are cut at forced boundaries, the fragments are encoded independently
    by the merges, and their ids are joined.

    Between two bytes that are neighbours in no token of the vocabulary there is a token boundary in every encoding. Such a
    boundary is used as a cut where the pre-tokenizer's pattern, too, gives the parts the pieces it gives the whole: before a
    character, not after white space (whose pieces depend on what follows), and not at or within two bytes after an apostrophe
    (whose contractions do). All cuts come from one look-up of all byte pairs; no text is cut by a pattern.
    """

    def __init__(self, ranks: dict[bytes, int]):
        inside = np.zeros((256, 256), bool)
        for pair in forced_pairs(ranks):
            inside[pair[0], pair[1]] = True
        may = ~inside
        may[:, 0x80:0xC0] = False  # inside a character
        may[:, _APOSTROPHE] = may[_APOSTROPHE, :] = False
        may[list(_BLANKS), :] = False
        self.may = may.ravel()
        self.bpe = HeapBPE(ranks)
        self.memory = _Memory(self._fragment)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in UTF-8 ``data`` before which a cut is certain."""
        at = np.flatnonzero(self.may[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]) + 1
        at = at[(at < 2) | (data[at - 2] != _APOSTROPHE)]
        wide = np.flatnonzero(data[at - 1] >= 0x80)
        if len(wide):
            last, mid, first = (data[np.maximum(at[wide] - k, 0)] for k in (1, 2, 3))
            blank = np.zeros(len(wide), bool)
            for x, y, z in _WIDE_BLANKS:
                blank |= (last == z) & (mid == y) & (True if x is None else first == x)
            at = np.delete(at, wide[blank])
        return at

    def _fragment(self, fragment: bytes) -> bytes:
        ids = array("i")
        for p in pieces(fragment.decode()):
            ids.extend(self.bpe.encode(p.encode()))
        return ids.tobytes()

    def encode_all(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends of each text's ids) of the texts in UTF-8 ``data`` that end at ``ends``."""
        if not len(ends) or not len(data):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        at = np.union1d(self.cuts(np.frombuffer(data, np.uint8)), np.concatenate(([0], ends)))
        places = at.tolist()
        coded = [self.memory[data[a:b]] for a, b in zip(places, places[1:])]
        upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))))) // 4
        return np.frombuffer(b"".join(coded), np.int32), upto[np.searchsorted(at, ends)]

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        return self.encode_all(data, np.array([len(data)]))[0].tolist()


@lru_cache(maxsize=2)
def cut_encoder(path: str) -> CutEncoder:
    return CutEncoder(load_ranks(path))


@lru_cache(maxsize=2)
def heap_bpe(path: str) -> HeapBPE:
    return HeapBPE(load_ranks(path))
