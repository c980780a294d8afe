"""Samples grounded in the graph: strings matched to nodes, seeds, the lines around them, and what of these bears on the query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, lookup
from . import ftset, graph
from .retrieve import _in_blocks, top_k

Embed = Callable[[Column], Column]


def nearest(left: DataFrame, key: str, vec: str, right: DataFrame, right_id: str, right_vec: str, k: int, least: float, block: int = 4096) -> DataFrame:
    """(key, match, sim, rank): for each row of ``left`` the ``k`` rows of ``right`` with the greatest inner product of at least
    ``least``; ties by match. ``left`` has one row a key and stays where it lies; ``right``, the smaller side, goes out in blocks
    of bounded size. Null vectors and null ids of ``right`` match nothing."""
    r = right.filter(F.col(right_vec).isNotNull() & F.col(right_id).isNotNull()).select(F.col(right_id).alias("i"), F.col(right_vec).cast("array<double>").alias("v"))
    source = left.filter(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"))
    kinds = dict(source.dtypes)["k"], dict(r.dtypes)["i"]

    def hits(rows: list) -> DataFrame:
        rows = sorted(rows, key=lambda x: x.i)  # of equal products the first stands for the least id
        sent = left.sparkSession.sparkContext.broadcast((np.array([x.i for x in rows], object), np.array([x.v for x in rows])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, m = sent.value
            for pdf in batches:
                for a in range(0, len(pdf) if len(names) else 0, 2000):
                    some = pdf.iloc[a : a + 2000]
                    s = np.round(np.vstack(some["v"].to_numpy()) @ m.T, 6)
                    at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    got = np.take_along_axis(s, at, 1)
                    i, j = np.nonzero(got >= least)
                    yield pd.DataFrame({"key": some["k"].to_numpy()[i], "match": names[at[i, j]], "sim": got[i, j]})

        return source.mapInPandas(run, f"key {kinds[0]}, match {kinds[1]}, sim double")

    return top_k(_in_blocks(r, block, hits), k, by="key", score="sim", tie="match")


def node_matches(texts: DataFrame, text: str, nodes: DataFrame, embed: Embed, k: int = 5, least: float = 0.55) -> DataFrame:
    """(text, nodes ARRAY<STRING>): for each distinct text the at most ``k`` graph nodes (node) whose names are most similar to it, best
    first. Texts that match none, and nulls, have no row. Each text and each name is embedded once."""
    t = texts.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().withColumn("v", embed(F.col("text")))
    n = nodes.select("node").distinct().withColumn("v", embed(F.col("node")))
    m = nearest(t, "text", "v", n, "node", "v", k, least)
    return m.groupBy(F.col("key").alias("text")).agg(F.array_sort(F.collect_list(F.struct("rank", "match"))).alias("m")).select("text", F.col("m.match").alias("nodes"))


def seeds(samples: DataFrame, sample_id: str, query: str, known: str, nodes: DataFrame, embed: Embed, of_query: int = 3, of_value: int = 2, hot_rows: int = 200_000) -> DataFrame:
    """(id, node), distinct: for each sample the best ``of_query`` nodes of its query and the best ``of_value`` of each value known."""
    asked = samples.select(F.col(sample_id).alias("id"), F.col(query).alias("text"), F.lit(of_query).alias("most"))
    said = samples.select(F.col(sample_id).alias("id"), F.explode(known).alias("text"), F.lit(of_value).alias("most"))
    wanted = cut(asked.unionByName(said).filter(F.col("text").isNotNull()))
    found = lookup(wanted, "text", node_matches(wanted, "text", nodes, embed), hot_rows)
    return found.select("id", F.explode(F.slice("nodes", 1, F.col("most"))).alias("node")).distinct()


def grounded_lines(samples: DataFrame, sample_id: str, query: str, action: str, seed_nodes: DataFrame, edges: DataFrame, var_edges: DataFrame, embed: Embed, weight: str = "weight",
                   least: float = 0.35, most: int = 12) -> DataFrame:
    """(id, triple, sim, rank): of the lines around a sample's seeds, and at most three placeholder lines for ASK, those similar to its
    query, the best ``most``.

    ``seed_nodes`` (id, node), ``edges`` (src, dst, relation, weight, ...), ``var_edges`` (src, dst) from anchors to placeholders. Lines
    are gathered once per seed, and each text is embedded once.
    """
    s = cut(seed_nodes)
    around = cut(graph.seed_triples(edges, s.select("node").distinct(), weight))
    lists = ftset.gather(s.select(F.col("id").alias("query_id"), F.col("node").alias("seed")), around, var_edges.select(F.col("src").alias("anchor"), F.col("dst").alias("var")),
                         samples.select(F.col(sample_id).alias("id"), F.col(action).alias("action")), "id")
    lines = cut(lists.select("query_id", F.explode("triples").alias("triple")))
    vectors = lines.select("triple").distinct().withColumn("_t", embed(F.col("triple")))
    asked = samples.filter(F.col(query).isNotNull()).select(F.col(sample_id).alias("query_id"), F.col(query).alias("q")).join(lines.select("query_id").distinct(), "query_id", "left_semi")
    both = lines.join(asked.withColumn("_q", embed(F.col("q"))), "query_id").join(vectors, "triple")
    return ftset.relevant(both, F.col("_q"), F.col("_t"), least, most).select(F.col("query_id").alias("id"), "triple", "sim", "rank")
