"""The pN_ queries: each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..runtime import cut, lookup
from . import data as D
from .conversations import fold_events, messages, whole_conversations
from .format_copies import class_counts, class_members
from .grouped_split import deal, origin_key, tied_groups
from .leaks import find_leaks
from .mixture import draw_mixture, mixture_plan
from .reading import labelled, levels, train, word_ranks
from .split_items import is_oversized, split_oversized
from .split_overlap import chunk_overlap, near_links, near_pairs
from .tokens import encode, token_totals


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized text of kb and of unified_samples' context documents."""
    kb = D.table(spark, sf_dir, "kb").select(F.lit("kb").alias("tbl"), F.col("kb_id").alias("item_id"), F.lit(0).alias("doc_pos"), "text")
    # Only oversized texts go through the shuffle that picks the latest delivery.
    big = F.filter(
        F.transform(D.context_texts(), lambda t, i: F.struct(i.alias("doc_pos"), t.alias("text"))), lambda d: is_oversized(d["text"])
    )
    contexts = D.samples(spark, sf_dir, big=big).select(F.lit("unified_samples").alias("tbl"), F.col("id").alias("item_id"), F.inline("big"))
    return split_oversized(kb.unionByName(contexts), "text", ["tbl", "item_id", "doc_pos"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).filter((F.col("piece_pos") == 0) & (F.col("n_pieces") > 1)).select("tbl", "item_id", "doc_pos")


def _tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.samples(spark, sf_dir, dialogue=D.dialogue_key())
    return tied_groups(rows.withColumn("origin", origin_key()), ["origin", "dialogue"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tied(spark, sf_dir).filter("n > 1").select("id", "group_id")


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id with its group and its new split, 70/15/15 by number of ids."""
    tied = cut(_tied(spark, sf_dir))
    groups = tied.filter(F.col("id") == F.col("group_id")).select("group_id", "n")
    dealt = deal(groups, {"train": 0.7, "validation": 0.15, "test": 0.15})
    return lookup(tied.select("id", "group_id"), "group_id", dealt.select("group_id", "split")).select("id", "group_id", "split")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.table(spark, sf_dir, "unified_samples")
    turns = fold_events(
        log, "id", "ingested_at", dialogue_key=D.dialogue_key(), turn_id=F.col("metadata.turn_id"), query=F.col("query"), response=F.col("response")
    )
    return whole_conversations(turns)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("dialogue_key", "turn_pos", "id")


def p5_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that hold, as ordered messages with roles."""
    return messages(_conversations(spark, sf_dir))


def p3_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents and of chat messages by source, language and domain; "unknown" where a label tells nothing."""
    names = D.source_names(spark, sf_dir)
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    labels = [known(D.source_label("source", names)).alias("source"), X.lang_label("lang").alias("lang"), known(D.source_label("source", names, 1)).alias("domain")]
    docs = D.table(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), *labels, "text")
    chats = D.table(spark, sf_dir, "ft_samples").select(F.lit("ft_samples").alias("tbl"), *labels, F.explode("messages.content").alias("text"))
    return token_totals(docs.unionByName(chats), "text", ["tbl", "source", "lang", "domain"])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(D.table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they leak, substitutions allowed, with the extent of the largest overlap."""
    return find_leaks(D.table(spark, sf_dir, "documents"), "doc_id", "text", D.table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).filter("longest_run >= 12").select("doc_id", "item_id")


def _copy_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    kb = D.table(spark, sf_dir, "kb").select(F.col("kb_id").alias("id"), F.array("text").alias("raw"))
    samples = D.table(spark, sf_dir, "unified_samples").select("id", F.col("ingested_at").alias("v"), F.concat(F.array("query"), D.context_texts()).alias("raw"))
    records = D.table(spark, sf_dir, "raw_records").select(F.col("raw_id").alias("id"), F.array("payload").alias("raw"))
    return [t.select(F.lit(n).alias("tbl"), *t.columns) for n, t in (("kb", kb), ("unified_samples", samples), ("raw_records", records))]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_members(_copy_tables(spark, sf_dir))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record: its smallest id and how many copies there are."""
    return class_counts(_copy_tables(spark, sf_dir)).select("tbl", "first_id", "copies")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_plan(*_mixture(spark, sf_dir)).filter("not met").select("source", "action")


def p6_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's target, availability, quota and shortfalls."""
    return mixture_plan(*_mixture(spark, sf_dir))


def p6_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's target, what there is, and what it lacks by the flow's slack arcs."""
    return p6_plan(spark, sf_dir).select("source", "action", "target", "available", "unavailable", "met")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn ids."""
    return draw_mixture(*_mixture(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = D.source_names(spark, sf_dir)
    rows = D.samples(spark, sf_dir, source=D.source_label("metadata.source", names), action=X.action_label("action"))
    return rows, D.table(spark, sf_dir, "mix_targets")


def _split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = D.source_names(spark, sf_dir)
    queries = D.samples(spark, sf_dir, split=X.split_label("split"), source=D.source_label("metadata.source", names), text=F.col("query"))
    chats = D.table(spark, sf_dir, "ft_samples").select(
        F.lit("content").alias("kind"), F.col("ft_id").alias("id"), X.split_label("split").alias("split"), D.source_label("source", names).alias("source"),
        F.explode(F.filter("messages", lambda m: m["role"] == "user")["content"]).alias("text"),
    )
    return queries.select(F.lit("query").alias("kind"), "id", "split", "source", "text").unionByName(chats)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(_split_records(spark, sf_dir)).select("kind", "left_id", "right_id").distinct()


def p7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the class of those that have the same words, and its number of links across the border of train."""
    return near_links(_split_records(spark, sf_dir)).select("kind", "id", "class_id", "links")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split and source that isn't train: the pairs with train, and the records that have any."""
    held = near_links(_split_records(spark, sf_dir)).filter("split <> 'train' AND links > 0")
    per_record = held.groupBy("kind", "split", "source", "id").agg(F.sum("links").alias("n"))
    return per_record.groupBy("kind", "split", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.sum("n").alias("pairs"), F.count("*").alias("records"))


def p7_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split and source: words in chunks that train has too, and records that such chunks fill by four fifths or wholly."""
    each = chunk_overlap(_split_records(spark, sf_dir))
    return each.groupBy("kind", "split", F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("records"), F.sum("words").alias("words"), F.sum("shared").alias("shared_words"),
        F.count_if(F.col("shared") >= 0.8 * F.col("words")).alias("mostly_shared"), F.count_if(F.col("shared") == F.col("words")).alias("wholly_shared"),
    )


def _reading(spark: SparkSession, sf_dir: str):
    names = D.source_names(spark, sf_dir)
    docs = D.table(spark, sf_dir, "documents").withColumn("_s", D.source_label("source", names))
    return docs, train(labelled(docs, D.table(spark, sf_dir, "reading_labels"), "_s"), word_ranks(docs, "text"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = _reading(spark, sf_dir)
    return levels(docs, model)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = _reading(spark, sf_dir)
    return levels(docs, model, 80).filter(F.col("level").isin(1, 5)).select("doc_id", "level")


def p10_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold agreement with the raters, by source held out."""
    _, model = _reading(spark, sf_dir)
    rows = [(k, *v) for k, v in sorted(model.report.items())]
    return spark.createDataFrame(rows, "source string, documents bigint, agreement double, mean_error double, ends_agreement double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_split, p5_found, p5_messages, p3_token_budget, p8_ids, p9_found, p9_leaks, p4_found, p4_copies, p6_found, p6_plan, p6_availability, p6_sample, p7_found, p7_links, p7_counts, p7_overlap, p10_found, p10_levels, p10_calibration)}
