"""Problem 10: reading level of each document.

Method: gradient-boosted regression trees over the distributions of lengths, vocabulary, syntax and cohesion. Out-of-fold
predictions, with whole sources held out, calibrate the cuts between grades and tell the error by source.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_words

#: Words (runs of letters), numbers, ends of sentences, and marks inside them, in one pass over a text.
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[.!?…]+(?=\s|$)|[。！？]+|\n\s*\n|[,;:()\[\]—–]")
_VOWELS = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûëïœæ]+")
#: Codes of tokens that are no words.
_END, _COMMA, _COLON, _BRACKET, _NUMBER = -1, -2, -3, -4, -5

#: Words of the corpus that are ranked by frequency; the rest count as rarer than all of them.
RANKED = 50_000
#: The most frequent words, each of whose shares is a feature: what languages and styles differ by, learnt from the corpus.
TOP = 20

FEATURES = (
    "word_len word_len_sd word_len_p50 word_len_p90 long7 long10 long13 long16 syllables polysyllables rank rank_sd rank_p50 rank_p90 unranked "
    "sent_len sent_len_sd sent_len_p50 sent_len_p90 clause_len clause_len_sd clause_len_p90 clauses commas colons brackets numbers first_variety first_rank "
    "types_root hapax type_len type_len_p75 overlap_next repeated log_words other_script"
).split() + [f"top{k}" for k in range(TOP)]


class Lexicon:
    """What is known of words: length, vowel groups, rank in the corpus. Words get numbers as they are met; when there are too many,
    numbering begins anew, which changes no feature."""

    MOST = 400_000

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self._clear()

    def _clear(self) -> None:
        self.codes, self.new = _Codes(self), []
        self.n, room = 0, 4096
        self.length, self.syllables, self.slot = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.rank, self.other = np.zeros(room), np.zeros(room)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all tokens, number of tokens of each text)."""
        if len(self.codes) > self.MOST:
            self._clear()
        found = [_TOKEN.findall(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        out = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        self._learn()
        return out, sizes

    def _learn(self) -> None:
        upto = self.n + len(self.new)
        while upto > len(self.length):
            for name in ("length", "syllables", "slot", "rank", "other"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate((x, np.zeros_like(x))))
        ranks = [self.ranks.get(w, RANKED) for w in self.new]
        here = slice(self.n, upto)
        self.length[here] = [min(len(w), 63) for w in self.new]
        self.syllables[here] = [len(_VOWELS.findall(w)) or 1 for w in self.new]
        self.slot[here] = [min(r, TOP) for r in ranks]
        self.rank[here] = np.log2(1.0 + np.array(ranks, float)) if ranks else []
        self.other[here] = [ord(w[0]) > 0x24F for w in self.new]
        self.n, self.new = upto, []


class _Codes(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.words = lexicon, 0

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c.isalpha():
            code, self.words = self.words, self.words + 1
            self.lexicon.new.append(token)
        elif c in ",—–":
            code = _COMMA
        elif c in ";:":
            code = _COLON
        elif c in "()[]":
            code = _BRACKET
        else:
            code = _END if c in ".!?…。！？\n" else _NUMBER
        self[token] = code
        return code


def _marks(group: np.ndarray, value: np.ndarray, groups: int, *marks: float) -> list[np.ndarray]:
    """Of the values (0 to 4095) of each group, those at the given shares of their order; 0 for an empty group."""
    key = np.sort(group * 4096 + np.minimum(value, 4095))
    n = np.bincount(group, minlength=groups)
    first = np.cumsum(n) - n
    out = []
    for m in marks:
        at = first + np.maximum(np.ceil(m * n).astype(np.int64) - 1, 0)
        out.append(np.where(n > 0, key[np.minimum(at, max(len(key) - 1, 0))] & 4095 if len(key) else 0, 0).astype(float))
    return out


def _mean_sd(group: np.ndarray, value: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.bincount(group, minlength=groups), 1)
    mean = np.bincount(group, weights=value, minlength=groups) / n
    return mean, np.sqrt(np.maximum(np.bincount(group, weights=value * value, minlength=groups) / n - mean**2, 0))


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES of each text, all of it; zeros for a text without letters.

    Distributions of word lengths, syllables and ranks (vocabulary), of words in sentences and between marks and of how sentences
    begin (syntax), of words that neighbouring sentences share and that come back (cohesion).
    """
    d = len(texts)
    tok, sizes = lexicon.tokens(texts)
    doc = np.repeat(np.arange(d), sizes)
    word = tok >= 0
    out = np.zeros((d, len(FEATURES)))
    if not word.any():
        return out
    begins = np.concatenate(([True], doc[1:] != doc[:-1]))
    after_end = np.concatenate(([False], tok[:-1] == _END))
    after_mark = np.concatenate(([False], (tok[:-1] < 0) & (tok[:-1] != _NUMBER)))
    w, wd = tok[word], doc[word]
    v = lexicon.n
    n = np.bincount(wd, minlength=d)
    total = np.maximum(n, 1)
    per = lambda g, x=None, size=d: np.bincount(g, weights=x, minlength=size)

    def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the stretches that begin so and have words: the stretch of each word, its place of the first word, its document."""
        at = np.cumsum(starts)[word]
        new = np.concatenate(([True], at[1:] != at[:-1]))
        return np.cumsum(new) - 1, np.flatnonzero(new), wd[new]

    sent, first, sdoc = runs(begins | after_end)
    clause, _, cdoc = runs(begins | after_mark)
    slen, clen = per(sent, size=len(first)), per(clause, size=len(cdoc))
    length, rank = lexicon.length[w], lexicon.rank[w]
    wl, wl_sd = _mean_sd(wd, length, d)
    rk, rk_sd = _mean_sd(wd, rank, d)
    sl, sl_sd = _mean_sd(sdoc, slen, d)
    cl, cl_sd = _mean_sd(cdoc, clen, d)
    w50, w90 = _marks(wd, length, d, 0.5, 0.9)
    r50, r90 = _marks(wd, (rank * 64).astype(np.int64), d, 0.5, 0.9)
    s50, s90 = _marks(sdoc, slen, d, 0.5, 0.9)
    (c90,) = _marks(cdoc, clen, d, 0.9)
    sentences, clauses = np.maximum(per(sdoc), 1), per(cdoc)

    key, times = np.unique(wd * v + w, return_counts=True)
    tdoc, tword = np.divmod(key, v)
    types = per(tdoc)
    tl, _ = _mean_sd(tdoc, lexicon.length[tword], d)
    (t75,) = _marks(tdoc, lexicon.length[tword], d, 0.75)

    pairs = np.unique(sent * v + w)  # distinct words of each sentence
    held = per(pairs // v, size=len(first))
    at = np.searchsorted(pairs, pairs + v)
    again = pairs[at[at < len(pairs)]] == (pairs + v)[at < len(pairs)]
    shared = per((pairs[at < len(pairs)] // v)[again], size=len(first))[:-1]
    both = sdoc[1:] == sdoc[:-1]
    over = _mean_sd(sdoc[:-1][both], shared[both] / np.minimum(held[:-1], held[1:])[both], d)[0]

    starts = np.unique(sdoc * v + w[first])
    marks = {c: per(doc[tok == c]) for c in (_COMMA, _COLON, _BRACKET, _NUMBER)}
    top = per(wd * (TOP + 1) + lexicon.slot[w], size=d * (TOP + 1)).reshape(d, TOP + 1)[:, :TOP]
    share = lambda x: per(wd, x) / total
    columns = [
        wl, wl_sd, w50, w90, *(share((length >= k).astype(float)) for k in (7, 10, 13, 16)), share(lexicon.syllables[w]), share((lexicon.syllables[w] >= 4).astype(float)),
        rk, rk_sd, r50, r90, share((rank >= np.log2(1.0 + RANKED)).astype(float)),
        sl, sl_sd, s50, s90, cl, cl_sd, c90, clauses / sentences, *(marks[c] / total for c in (_COMMA, _COLON, _BRACKET, _NUMBER)),
        per(starts // v) / sentences, per(sdoc, rank[first]) / sentences,
        types / np.sqrt(total), per(tdoc, (times == 1).astype(float)) / total, tl, t75, over, per(tdoc, np.where(times > 2, times, 0).astype(float)) / total, np.log1p(n), share(lexicon.other[w]),
    ]
    out[:] = np.column_stack((*columns, top / total[:, None]))
    out[n == 0] = 0.0
    return out


def word_ranks(docs: DataFrame, text: str, ranked: int = RANKED, most: int = 500_000) -> dict[str, int]:
    """The ``ranked`` most frequent words of all documents and their ranks from 0, ties by word. Tasks count before anything is
    shuffled, ``most`` distinct words at a time; what the driver gets is bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        flush = lambda: pd.DataFrame({"w": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})
        for pdf in batches:
            for t in pdf["t"]:
                if t:
                    seen.update(_LETTERS.findall(t.lower()))
                if len(seen) > most:
                    yield flush()
                    seen.clear()
        yield flush()

    counts = docs.select(F.col(text).alias("t")).mapInPandas(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return {r.w: k for k, r in enumerate(counts.orderBy(F.desc("n"), "w").limit(ranked).collect())}


_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Boosting:
    trees: int = 120
    depth: int = 4
    rate: float = 0.1
    bins: int = 48
    least: int = 8
    #: Labelled documents that the model is fitted on at most, those with the smallest hashes. Levels are given to all.
    most_labelled: int = 20_000
    seed: int = 42


@dataclass
class Trees:
    """Boosted trees on binned features: node k's children are 2k+1 and 2k+2."""

    edges: list[np.ndarray]
    base: float = 0.0
    rate: float = 0.1
    depth: int = 4
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, value by node

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, b = np.full(len(x), self.base), self.binned(x) if len(x) else np.zeros((0, len(self.edges)), np.int16)
        rows = np.arange(len(x))
        for feat, cutp, value in self.splits:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feat[at]
                at = np.where(f < 0, at, 2 * at + 1 + (b[rows, np.maximum(f, 0)] > cutp[at]))
            out += self.rate * value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, p: Boosting = Boosting()) -> Trees:
    """Least-squares boosting with histograms; deterministic."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(x.shape[1])]
    t = Trees(edges, float(y.mean()), p.rate, p.depth)
    b, (n, m), width = t.binned(x), x.shape, p.bins + 1
    flat = b.astype(np.int64) + np.arange(m) * width
    pred = np.full(n, t.base)
    root = np.bincount(flat.ravel(), minlength=m * width).reshape(1, m, width)
    for _ in range(p.trees):
        g = y - pred
        nodes = 2 ** (p.depth + 1) - 1
        feat, cutp, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
        at = np.zeros(n, np.int64)
        value[0] = g.mean()
        hc, hs = root, np.bincount(flat.ravel(), weights=np.repeat(g, m), minlength=m * width).reshape(1, m, width)
        for level in range(p.depth):
            first, k = 2**level - 1, 2**level
            c, s = hc.cumsum(axis=2), hs.cumsum(axis=2)
            cl, sl, call, sall = c[:, :, :-1], s[:, :, :-1], c[:, :1, -1:], s[:, :1, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((cl >= p.least) & (call - cl >= p.least), sl**2 / cl + (sall - sl) ** 2 / (call - cl) - sall**2 / call, -np.inf).reshape(k, -1)
            best = gain.argmax(axis=1)
            splits = gain[np.arange(k), best] > 1e-9
            f, q = best // (width - 1), best % (width - 1)
            for i in np.flatnonzero(splits).tolist():
                node, left_n, left_s = first + i, c[i, f[i], q[i]], s[i, f[i], q[i]]
                feat[node], cutp[node] = f[i], q[i]
                value[2 * node + 1], value[2 * node + 2] = left_s / left_n, (s[i, 0, -1] - left_s) / (c[i, 0, -1] - left_n)
            here = np.flatnonzero((at >= first) & (at < first + k))
            here = here[splits[at[here] - first]]
            node = at[here] - first
            at[here] = 2 * at[here] + 1 + (b[here, f[node]] > q[node])
            if not len(here) or level + 1 == p.depth:
                break
            # Only left children are counted; a right child has what its parent has beyond that.
            child = at[here] - (2 * first + 1)
            left = here[child % 2 == 0]
            where = (flat[left] + (child[child % 2 == 0] // 2 * (m * width))[:, None]).ravel()
            lc = np.bincount(where, minlength=k * m * width).reshape(k, m, width)
            ls = np.bincount(where, weights=np.repeat(g[left], m), minlength=k * m * width).reshape(k, m, width)
            split = splits[:, None, None]
            hc, hs = (np.stack((x, np.where(split, h - x, 0)), axis=1).reshape(2 * k, m, width) for h, x in ((hc, lc), (hs, ls)))
        t.splits.append((feat, cutp, value))
        pred += p.rate * value[at]
    return t


def grade_cuts(pred: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The four cuts between grades 1 to 5 that part out-of-fold predictions with the fewest errors; the middle of ties."""
    order = np.argsort(pred, kind="stable")
    ps, ys, cuts = pred[order], y[order], []
    for k in range(1, 5):
        err = np.concatenate(([0], np.cumsum(ys > k))) + np.concatenate((np.cumsum((ys <= k)[::-1])[::-1], [0]))
        best = np.flatnonzero(err == err.min())
        i = int(best[len(best) // 2])
        lo, hi = ps[max(0, i - 1)], ps[min(len(ps) - 1, i)]
        cuts.append(k + 0.5 if (ys > k).all() or (ys <= k).all() else float((lo + hi) / 2))
    return np.maximum.accumulate(np.array(cuts))


@dataclass
class ReadingModel:
    trees: Trees
    cuts: np.ndarray
    ranks: dict[str, int]
    #: source -> (labelled documents, exact agreement, mean error in grades, share of 1 and 5 told right), all out of fold
    report: dict[str, tuple[int, float, float, float]]

    def grade(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = self.trees.predict(x)
        return np.searchsorted(self.cuts, raw, side="right") + 1, raw


def labelled(docs: DataFrame, labels: DataFrame, source: str, p: Boosting = Boosting()) -> DataFrame:
    """(doc_id, text, source, level): documents with the median of their raters' grades.

    Null grades, grades outside 1 to 5 and repeated rows don't count, and a rater's several grades of a document count once
    as their mean. At most ``p.most_labelled`` documents.
    """
    one = labels.filter(F.col("level").between(1, 5)).groupBy("doc_id", "rater").agg(F.avg(F.col("level").cast("double")).alias("level"))
    level = one.groupBy("doc_id").agg(F.percentile("level", 0.5).alias("level"))
    some = level.orderBy(F.xxhash64(F.lit(p.seed), "doc_id"), "doc_id").limit(p.most_labelled)
    return docs.select("doc_id", "text", F.col(source).alias("source")).filter(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id")


def train(sample: DataFrame, ranks: dict[str, int], p: Boosting = Boosting()) -> ReadingModel:
    """Fits and calibrates on ``sample`` (doc_id, text, source, level), whose rows are bounded by ``p.most_labelled``; ``ranks`` are
    those of the corpus (``word_ranks``). Features are made where the texts lie; the driver gets only numbers."""
    sent = sample.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(sent.value)
        for pdf in batches:
            for k in range(0, len(pdf), _SLICE):
                some = pdf.iloc[k : k + _SLICE]
                yield pd.DataFrame({"doc_id": some["doc_id"], "source": some["source"], "level": some["level"], "x": list(features(some["text"].tolist(), lexicon))})

    got = sample.mapInPandas(run, "doc_id bigint, source string, level double, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    if got.empty:
        return ReadingModel(Trees([np.zeros(0)] * len(FEATURES), 3.0), np.array([1.5, 2.5, 3.5, 4.5]), ranks, {})
    x, y = np.array(got["x"].tolist()), got["level"].to_numpy(float)
    source = got["source"].fillna("unknown").to_numpy()
    oof, names = np.full(len(y), y.mean()), sorted(set(source))
    for name in names:
        held = source == name
        if (~held).sum() >= 2 * p.least:
            oof[held] = fit(x[~held], y[~held], p).predict(x[held])
    cuts = grade_cuts(oof, y)
    grade, true = np.searchsorted(cuts, oof, side="right") + 1, np.floor(y + 0.5)
    report = {}
    for name in names:
        h = source == name
        ends = h & ((true == 1) | (true == 5))
        report[name] = (int(h.sum()), float((grade == true)[h].mean()), float(np.abs(grade - y)[h].mean()), float((grade == true)[ends].mean()) if ends.any() else float("nan"))
    return ReadingModel(fit(x, y, p), cuts, ranks, report)


def levels(docs: DataFrame, model: ReadingModel, least_words: int = 0) -> DataFrame:
    """(doc_id, level INT, score DOUBLE) of every row of ``docs`` (doc_id, text); both null for a text without words. With
    ``least_words``, only of texts with so many white-space words, counted where the features are made."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        lexicon = Lexicon(m.ranks)
        for pdf in batches:
            if least_words:
                pdf = pdf[[bool(t) and len(split_words(t)) >= least_words for t in pdf["text"]]]
            for k in range(0, len(pdf), _SLICE):
                some = pdf.iloc[k : k + _SLICE]
                x = features([t or "" for t in some["text"]], lexicon)
                grade, raw = m.grade(x)
                bare = ~x.any(axis=1)
                yield pd.DataFrame({"doc_id": some["doc_id"], "level": pd.array(np.where(bare, None, grade).tolist(), "Int32"), "score": pd.array(np.where(bare, None, raw).tolist(), "Float64")})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, level int, score double")


#: Texts whose features are made together.
_SLICE = 500
