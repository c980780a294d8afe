"""Chunks of contexts, and the knowledge bases made of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parse import fingerprint, lower_words, numbered_id, sentences
from ..functions.text import let, ws_count, ws_words
from ..runtime import numbered_rows


@dataclass(frozen=True)
class Chunking:
    words: int = 350
    overlap: int = 50
    #: Sentences that a sentence chunk takes over from the one before.
    carry: int = 2
    #: Words from which a source's contexts are chunked; other sources never are. Fixed values.
    above: dict[str, int] = field(default_factory=lambda: {"contract_nli": 300, "quac": 400})


def word_chunks(text: Column, c: Chunking = Chunking()) -> Column:
    """ARRAY<STRUCT<chunk_idx, total_chunks, text>>: windows of ``words`` words, ``words - overlap`` apart, in closed form.

    A text that fits one window is given verbatim, a longer one with its words joined by single blanks.
    """
    step = c.words - c.overlap

    def cut(w: Column) -> Column:
        last = F.ceil((F.size(w) - c.words) / step).cast("int")
        window = lambda k: F.struct(k.alias("chunk_idx"), (last + 1).alias("total_chunks"), F.array_join(F.slice(w, k * step + 1, c.words), " ").alias("text"))
        one = F.array(F.struct(F.lit(0).alias("chunk_idx"), F.lit(1).alias("total_chunks"), text.alias("text")))
        return F.when(F.size(w) > c.words, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)).otherwise(one)

    return let(ws_words(text), cut)


def needs_chunking(source: Column, words: Column, c: Chunking = Chunking()) -> Column:
    out = F.lit(False)
    for name, n in c.above.items():
        out = F.when(source == name, words > n).otherwise(out)
    return out


def sentence_chunks(text: Column, c: Chunking = Chunking()) -> Column:
    """ARRAY<STRING>: sentences packed greedily up to ``words`` words; each chunk after the first begins with the last
    ``carry`` sentences of the one before. A sentence longer than the limit makes a chunk of its own beginnings."""
    counted = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), ws_count(s).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<struct<s:string,n:int>>").alias("now"), F.lit(0).alias("n"))
    joined = lambda now: F.array_join(F.transform(now, lambda x: x["s"]), " ")

    def step(acc: Column, s: Column) -> Column:
        more = F.struct(acc["done"].alias("done"), F.array_append(acc["now"], s).alias("now"), (acc["n"] + s["n"]).alias("n"))
        kept = F.slice(acc["now"], F.greatest(F.size(acc["now"]) - c.carry + 1, F.lit(1)), c.carry) if c.carry else F.slice(acc["now"], 1, 0)
        next_ = let(F.array_append(kept, s), lambda now: F.struct(F.array_append(acc["done"], joined(acc["now"])).alias("done"), now.alias("now"), F.aggregate(now, F.lit(0), lambda a, x: a + x["n"]).alias("n")))
        return F.when((acc["n"] + s["n"] > c.words) & (F.size(acc["now"]) > 0), next_).otherwise(more)

    return F.aggregate(counted, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], joined(acc["now"]))).otherwise(acc["done"]))


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key. The row limit is pushed below the shuffle, so a hot key costs a row per task."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def contexts(samples: DataFrame, text: Column, order: Column) -> DataFrame:
    """(parent_ctx_hash, ctx, source, ord, action_distribution, num_linked): one row per distinct non-blank context text, with
    the source and order of the first sample linked to it. Samples are counted by action before the shuffle, so a text that a
    third of all samples have costs a row per task and action."""
    s = _linked_rows(samples, text, order)
    g = s.groupBy("parent_ctx_hash", "action").agg(F.min(F.struct("ord", "id", "source", "ctx")).alias("f"), F.count("*").cast("int").alias("n"))
    g = g.groupBy("parent_ctx_hash").agg(
        F.min("f").alias("f"), F.array_sort(F.collect_list(F.when(F.col("action").isNotNull(), F.struct("action", "n")))).alias("d"), F.sum("n").cast("int").alias("num_linked"))
    return g.select("parent_ctx_hash", "f.ctx", "f.source", "f.ord", F.map_from_entries("d").alias("action_distribution"), "num_linked")


def source_meta(source: Column, dialogue_id: Column, docs: Column, chunk_idx: Column, total: Column) -> Column:
    """What an entry tells of its origin, by the key of its source: a dialogue, a url, a file with the place of the chunk, or the
    titles of its documents; what a source doesn't tell is null."""
    first, one = (lambda c: F.coalesce(F.get(docs, F.lit(0))[c], F.lit(""))), (lambda name, c, kind: F.when(source == name, c).cast(kind))
    return F.struct(
        one("quac", F.coalesce(dialogue_id, F.lit("")), "string").alias("dialogue_id"), one("sharc", first("url"), "string").alias("url"), one("contractnli", first("doc_id"), "string").alias("doc_id"),
        one("contractnli", first("file_name"), "string").alias("file_name"), one("contractnli", chunk_idx, "int").alias("chunk_idx"), one("contractnli", total, "int").alias("total_chunks"),
        one("hotpotqa", F.transform(docs, lambda d: F.coalesce(d["doc_id"], F.lit(""))), "array<string>").alias("supporting_titles"),
    )


def context_key(source: Column, own: Column, dialogue_id: Column, utterance_id: Column, docs: Column) -> Column:
    """What the rows of one context share, by the key of their source."""
    unknown = F.lit("unknown")
    return (
        F.when(source == "quac", F.coalesce(dialogue_id, unknown)).when(source == "sharc", F.coalesce(utterance_id, own)).when(source == "hotpotqa", own)
        .when(source == "contractnli", F.coalesce(F.get(docs, F.lit(0))["doc_id"], unknown)).otherwise(unknown)
    )


def _linked_rows(samples: DataFrame, text: Column, order: Column) -> DataFrame:
    s = samples.select(text.alias("ctx"), F.col("source"), order.alias("ord"), "id", "action", "query").filter(F.regexp_like("ctx", F.lit(r"(?U)\S")))
    return s.withColumn("parent_ctx_hash", fingerprint("ctx"))


def context_links(samples: DataFrame, text: Column, order: Column) -> DataFrame:
    """(parent_ctx_hash, ord, id, action, query): a row per sample and context, so that links of a text are never gathered."""
    return _linked_rows(samples, text, order).select("parent_ctx_hash", "ord", "id", "action", "query")


def with_links(rows: DataFrame, links: DataFrame, key: str = "parent_ctx_hash") -> DataFrame:
    """``rows`` with the arrays linked_sample_ids, linked_actions, linked_queries in the order of ord and id: the nested form for
    export. A row then holds all its links; plans that only count or filter them take ``context_links``."""
    g = links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "action", "query"))).alias("l"))
    arrays = g.select(key, F.col("l.id").alias("linked_sample_ids"), F.col("l.action").alias("linked_actions"), F.col("l.query").alias("linked_queries"))
    return rows.join(arrays, key, "left")


def flat_kb(ctx: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """The knowledge base: contexts chunked where their source and length ask for it, each distinct chunk once, with the
    figures of the first context it occurs in, numbered in its order. Links are joined on by parent_ctx_hash (``with_links``)."""
    words = ws_count("ctx")
    whole = F.array(F.struct(F.lit(0).alias("chunk_idx"), F.lit(1).alias("total_chunks"), F.col("ctx").alias("text")))
    parts = F.when(needs_chunking(F.col("source"), words, c), word_chunks(F.col("ctx"), c)).otherwise(whole)
    rows = ctx.withColumn("p", F.explode(parts)).select("*", "p.*").drop("p", "ctx").withColumn("chunk_hash", fingerprint("text"))
    once = first_by(rows, ["chunk_hash"], "ord", "parent_ctx_hash", "chunk_idx")
    placed = numbered_rows(once.withColumn("word_count", ws_count("text")), ["ord", "parent_ctx_hash", "chunk_idx"], "_i")
    return placed.withColumn("kb_id", numbered_id("kb", F.col("_i"), 7)).drop("ord", "_i")


def multi_kb(ctx: DataFrame, c: Chunking = Chunking(), least_words: int = 5) -> DataFrame:
    """Coarse sentence chunks and fine single sentences of at least ``least_words`` words, deduplicated together; of equal
    texts within a context the coarse one stays."""
    piece = lambda kind, arr: F.transform(arr, lambda t, i: F.struct(F.lit(kind).alias("granularity"), t.alias("text"), i.alias("pos")))
    fine = F.filter(piece("fine", sentences("ctx")), lambda s: ws_count(s["text"]) >= least_words)  # numbered among all sentences
    rows = ctx.withColumn("p", F.explode(F.concat(piece("coarse", sentence_chunks(F.col("ctx"), c)), fine))).select("*", "p.*").drop("p", "ctx")
    rows = rows.withColumn("hash", fingerprint("text"))
    once = first_by(rows, ["hash"], "ord", "parent_ctx_hash", "granularity", "pos")
    return once.select(
        "granularity", "parent_ctx_hash", F.when(F.col("granularity") == "coarse", F.col("pos")).alias("chunk_idx"), F.when(F.col("granularity") == "fine", F.col("pos")).alias("sent_idx"),
        "source", "text", ws_count("text").alias("word_count"), "action_distribution", "num_linked",
        F.concat(F.lit("mg_"), F.substring("hash", 1, 12)).alias("mg_id"),
    )


def compress(query: Column, texts: Column, most: int = 3) -> Column:
    """For each text its ``most`` sentences with the most of the query's words, ties to the earlier, in their order; a sentence
    that equals a kept one is kept too. A text of at most ``most`` sentences keeps them all."""

    def one(q: Column, s: Column) -> Column:
        scored = F.transform(s, lambda x, i: F.struct((-F.size(F.array_intersect(q, lower_words(x)))).alias("a"), i.alias("i"), x.alias("x")))
        top = F.transform(F.slice(F.array_sort(scored), 1, most), lambda r: r["x"])
        return let(top, lambda t: F.array_join(F.filter(s, lambda x: F.array_contains(t, x)), " "))

    return let(F.array_distinct(lower_words(query)), lambda q: F.transform(texts, lambda t: let(sentences(t), lambda s: one(q, s))))
