"""Sparse, dense and hybrid retrieval of a batch of queries against a whole corpus, read once for all of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parse import lower_words
from ..functions.text import split_words
from ..runtime import cut


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    #: A negative idf becomes this share of the mean idf of all terms.
    epsilon: float = 0.25


def terms(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf, dl): term frequencies of lower-case white-space words; texts without words have no row.

    Counts are made inside the row, so a document's words are shuffled nowhere.
    """
    w = docs.select(F.col(doc_id).alias("doc_id"), lower_words(text).alias("w")).filter(F.size("w") > 0).withColumn("dl", F.size("w"))
    return w.select("doc_id", "dl", F.explode("w").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf")).select("doc_id", "term", "tf", "dl")


def idf(tf: DataFrame, n_docs: int, p: Bm25 = Bm25()) -> DataFrame:
    """(term, df, idf) of all terms."""
    df = tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))
    return df.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, p.epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, p: Bm25 = Bm25()) -> DataFrame:
    """(query_id, doc_id, score, nd): every document that shares a term with a query, query terms counted with multiplicity.

    The corpus' terms are stored once and read for idf and for scoring. Query terms join on the term, documents that share none
    never meet a query.
    """
    tf = cut(terms(docs, doc_id, text))
    stats = tf.groupBy("doc_id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("adl")).collect()[0]
    if not stats.n:
        return tf.select(F.lit(None).cast("string").alias("query_id"), "doc_id", F.lit(0.0).alias("score")).limit(0)
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(lower_words(query)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("m"))
    weights = idf(tf, stats.n, p).join(q.select("term").distinct(), "term", "left_semi")
    norm = F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("dl") / stats.adl)
    part = F.col("m") * F.col("idf") * F.col("tf") * (p.k1 + 1) / norm
    hits = tf.join(weights, "term").join(q, "term")
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def _lower_words(text: str | None) -> list[str]:
    return split_words(text.lower()) if text else []


def frequencies(docs: DataFrame, text: str, most: int = 500_000) -> DataFrame:
    """(term, df, words): document frequencies of all terms; the row with a null term has the number of documents that have
    words, and their words.

    Tasks count before anything is shuffled, so what moves are a task's distinct terms (``most`` at a time), not its words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n, words = Counter(), 0, 0
        flush = lambda: pd.DataFrame({"term": pd.Series(list(seen), dtype=object), "df": pd.Series(list(seen.values()), dtype="int64"), "words": 0})
        for pdf in batches:
            for t in pdf["t"]:
                if w := _lower_words(t):
                    seen.update(set(w))
                    n, words = n + 1, words + len(w)
                if len(seen) > most:
                    yield flush()
                    seen.clear()
        yield flush()
        yield pd.DataFrame({"term": [None], "df": [n], "words": [words]})

    return docs.select(F.col(text).alias("t")).mapInPandas(run, "term string, df bigint, words bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def idf_of(freq: DataFrame, n_docs: int, p: Bm25 = Bm25()) -> DataFrame:
    """(term, df, idf) from ``frequencies``."""
    raw = freq.filter(F.col("term").isNotNull()).select("term", "df", (F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    return raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean")))).select("term", "df", F.when(F.col("raw") < 0, p.epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


class _Best:
    """The best ``k`` documents of each query so far by score of six digits, of equal ones those with the least ids; fed by batches."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.doc = k, np.full((queries, 0), -np.inf), None

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        """``score``: a row per query, a column per document of ``doc``; -inf where there is no hit."""
        docs = np.broadcast_to(doc, score.shape)
        both = np.concatenate((self.score, score), axis=1)
        ids = docs if self.doc is None else np.concatenate((self.doc, docs), axis=1)
        down = -np.round(both, 6)
        if both.shape[1] > self.k:  # no more than the k greatest and what ties with the least of them need be sorted
            least = np.partition(down, self.k - 1, axis=1)[:, self.k - 1]
            width = max(self.k, int(((down <= least[:, None]) & (down < np.inf)).sum(axis=1).max()))
            some = np.argpartition(down, min(width, both.shape[1]) - 1, axis=1)[:, :width]
            both, ids, down = (np.take_along_axis(x, some, 1) for x in (both, ids, down))
        order = np.lexsort((ids, down))[:, : self.k] if both.shape[1] else np.zeros(both.shape, int)
        self.score, self.doc = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)

    def rows(self, names: list) -> pd.DataFrame:
        if self.doc is None:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        q, c = np.nonzero(self.score > -np.inf)
        return pd.DataFrame({"query_id": np.array(names, object)[q], "doc_id": self.doc[q, c], "score": self.score[q, c]})


def _in_blocks(rows: DataFrame, block: int, hits: Callable[[list], DataFrame]) -> DataFrame:
    """The union of ``hits`` of ``rows``, ``block`` at a time. The driver holds one block; what all but the last give is stored."""
    stored, part = [], []
    for r in rows.toLocalIterator():
        if len(part) == block:
            stored.append(cut(hits(part)))
            part = []
        part.append(r)
    return reduce(DataFrame.unionByName, [*stored, hits(part)])


def bm25_pool(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int, pairs: DataFrame | None = None, p: Bm25 = Bm25(), block: int = 2048) -> DataFrame:
    """(query_id, doc_id, score): the best ``k`` documents of each query, as ``bm25_scores`` scores them, ties by doc_id, and those
    of ``pairs`` (query_id, doc_id; some ``k`` a query) that share a term with their query.

    Two passes over the corpus, neither of which shuffles its words: one for document frequencies, one that scores batches of
    documents against a block of queries, of which each task keeps its best ``k``. Blocks have a bounded number of queries, and
    so of terms and of ``pairs``.
    """
    freq = cut(frequencies(docs, text))
    total = freq.filter(F.col("term").isNull()).select("df", "words").collect()
    n, words = (total[0].df, total[0].words) if total else (0, 0)
    q = queries.select(F.col(query_id).alias("q"), F.col(query).alias("t")).filter(F.col("t").isNotNull())
    source = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    kinds = dict(q.dtypes)["q"], dict(source.dtypes)["d"]
    spark, adl, weights = docs.sparkSession, words / n if n else 1.0, idf_of(freq, max(n, 1), p)

    def hits(rows: list) -> DataFrame:
        counts = [Counter(_lower_words(r.t)) for r in rows]
        asked = spark.createDataFrame([(w,) for w in sorted(set().union(*counts))], "term string")
        weight = {r.term: r.idf for r in weights.join(F.broadcast(asked), "term").select("term", "idf").collect()}
        by: dict[str, tuple[list[int], list[float]]] = {}
        for i, c in enumerate(counts):
            for w, m in c.items():
                if w in weight:
                    at, val = by.setdefault(w, ([], []))
                    at.append(i)
                    val.append(m * weight[w] * (p.k1 + 1))
        wanted: dict = {}
        if pairs is not None:
            number = {r.q: i for i, r in enumerate(rows)}
            ids = F.broadcast(spark.createDataFrame([(r.q,) for r in rows], f"query_id {kinds[0]}"))
            for r in pairs.join(ids, "query_id").select("query_id", "doc_id").collect():
                wanted.setdefault(r.doc_id, []).append(number[r.query_id])
        sent = spark.sparkContext.broadcast(([r.q for r in rows], {w: (np.array(a), np.array(v)) for w, (a, v) in by.items()}, wanted))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, by, wanted = sent.value
            best = _Best(len(names), k)
            for pdf in batches:
                for a in range(0, len(pdf) if names else 0, 1000):
                    some = pdf.iloc[a : a + 1000]
                    score, hit = np.zeros((len(some), len(names))), np.zeros((len(some), len(names)), bool)
                    for j, t in enumerate(some["t"]):
                        w = _lower_words(t)
                        norm = p.k1 * (1 - p.b + p.b * len(w) / adl)
                        for term, tf in Counter(x for x in w if x in by).items():
                            at, val = by[term]
                            score[j, at] += val * (tf / (tf + norm))
                            hit[j, at] = True
                    score = np.where(hit, score, -np.inf)
                    best.add(score.T, some["d"].to_numpy())
                    if wanted:
                        own = [(i, j) for j, d in enumerate(some["d"].tolist()) for i in wanted.get(d, ()) if hit[j, i]]
                        yield pd.DataFrame({"query_id": [names[i] for i, _ in own], "doc_id": [some["d"].iloc[j] for _, j in own], "score": [score[j, i] for i, j in own]})
            yield best.rows(names)

        return source.mapInPandas(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")

    return _in_blocks(q, block, hits)


def bm25_top_k(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int, p: Bm25 = Bm25(), block: int = 2048) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` documents of each query, as ``bm25_scores`` scores them; ties by doc_id."""
    return top_k(bm25_pool(docs, doc_id, text, queries, query_id, query, k, None, p, block), k)


def top_k(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id", digits: int = 6) -> DataFrame:
    """``scores`` with rank 1 to k per ``by``: rounded score descending, then ``tie``. Task-local limits come first."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.round(score, digits).desc(), F.col(tie)))
    return scores.withColumn("rank", r).filter(F.col("rank") <= k)


def dense_top_k(corpus: DataFrame, doc_id: str, vec: str, queries: DataFrame, query_id: str, query_vec: str, k: int, least: float | None = None, exclude_self: bool = False,
                block: int = 4096) -> DataFrame:
    """(query_id, doc_id, score, rank): exact inner products; ties by doc_id.

    The query set is a stated one, sent in blocks of ``block`` vectors; the corpus passes once a block, and each task keeps k rows
    a query, of which the window merges those of all tasks. Null vectors match nothing.
    """
    q = queries.filter(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v"))
    source = corpus.filter(F.col(vec).isNotNull()).select(F.col(doc_id).alias("d"), F.col(vec).cast("array<double>").alias("v"))
    kinds = dict(q.dtypes)["q"], dict(source.dtypes)["d"]

    def hits(rows: list) -> DataFrame:
        sent = corpus.sparkSession.sparkContext.broadcast(([r.q for r in rows], np.array([r.v for r in rows])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, m = sent.value
            best = _Best(len(names), k)
            for pdf in batches:
                for a in range(0, len(pdf) if names else 0, 5000):
                    docs = pdf["d"].to_numpy()[a : a + 5000]
                    s = np.round(m @ np.vstack(pdf["v"].to_numpy()[a : a + 5000]).T, 6)
                    if exclude_self:
                        s[np.array(names, object)[:, None] == docs.astype(object)[None, :]] = -np.inf
                    best.add(s if least is None else np.where(s >= least, s, -np.inf), docs)
            yield best.rows(names)

        return source.mapInPandas(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")

    return top_k(_in_blocks(q, block, hits), k)


def source_filtered(hits: DataFrame, sources: DataFrame, wanted: Column, k: int) -> DataFrame:
    """Hits of an over-long list whose document has the wanted source, the best k of them; maybe fewer than k a query."""
    return top_k(hits.drop("rank").join(sources, "doc_id").filter(wanted), k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int, alpha: float = 0.5, pool: int = 200) -> DataFrame:
    """(query_id, doc_id, dense_score, bm25_score, fused_score, rank): of the best ``pool`` of either list, alpha * dense +
    (1 - alpha) * bm25 / best bm25 of the query. A document outside dense's best has dense score 0, its bm25 score is real.

    ``sparse`` needs the best ``pool`` of each query and the scores of dense's pairs (``bm25_pool``), not all scores. A document's
    granularity or source is filtered on the fused list, after pooling (``source_filtered``)."""
    d = top_k(dense.select("query_id", "doc_id", "score"), pool).select("query_id", "doc_id", F.col("score").alias("dense_score"))
    best = sparse.groupBy("query_id").agg(F.max("score").alias("best"))
    sparse = sparse.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    s = top_k(sparse.select("query_id", "doc_id", "score"), pool).select("query_id", "doc_id", F.lit(1).alias("in_pool"))
    both = d.join(s, ["query_id", "doc_id"], "full").join(sparse.select("query_id", "doc_id", F.col("score").alias("bm25")), ["query_id", "doc_id"], "left").join(best, "query_id", "left")
    both = both.select("query_id", "doc_id", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("bm25", F.lit(0.0)).alias("bm25_score"), "best")
    fused = both.withColumn("fused_score", alpha * F.col("dense_score") + (1 - alpha) * F.when(F.col("best") > 0, F.col("bm25_score") / F.col("best")).otherwise(0.0))
    return top_k(fused.drop("best"), k, score="fused_score")


#: Phrases that ask for more than one step when they occur anywhere in a query. Fixed values.
HOP_WORDS = ("and", "both", "compare", "difference", "before", "after", "when did", "which of")


def is_multihop(query: Column | str, most_words: int = 12) -> Column:
    q = F.lower(F.col(query) if isinstance(query, str) else query)
    named = F.lit(False)
    for w in HOP_WORDS:
        named = named | q.contains(w)
    return F.coalesce((F.size(lower_words(q)) > most_words) | named, F.lit(False))


def decompose(query: Column | str) -> Column:
    """Sub-queries of a query: its parts around " and ", the query itself where there is one part only."""
    q = F.col(query) if isinstance(query, str) else query
    parts = F.filter(F.transform(F.split(q, r"(?i)\s+and\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(q))


def fan_out(hits: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(query_id, doc_id, score, rank) from (query_id, sub, n_sub, doc_id, score, rank): each sub-query gives its best k // n_sub,
    ``least`` at least (agents ask for two); a document that several give stays where it came first."""
    taken = hits.filter(F.col("rank") <= F.greatest(F.lit(least), F.floor(F.lit(k) / F.col("n_sub"))))
    first = taken.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("sub", "rank"))).filter("_r = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("sub", "rank"))).select("query_id", "doc_id", "score", "rank")


def rerank(hits: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """Hits in the order of another score, the best k."""
    return top_k(hits.drop("rank").withColumn("rerank_score", score), k, score="rerank_score")
