"""Compositions: the graph and the supervised samples of a knowledge base, and the routed answering of a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions.text import key, ws_count
from ..operators import chunk as C
from ..operators import dialogue as H
from ..operators import ftset as B
from ..operators import gate as D
from ..operators import graph as G
from ..operators import grounding as N
from ..operators import retrieve as R
from ..operators import sampling as S
from ..operators.providers import Providers
from ..runtime import broadcast_if_small, cut, numbered_rows
from .registry import samples, table

SYSTEM = "Decide the next step from the query, what is known, the graph lines and what is missing. Put one decision inside decision tags and give your reason."


def build_graph(kb: DataFrame, p: Providers = Providers()) -> DataFrame:
    """Edges of a knowledge base (kb_id, text, source) by the providers' triples, falling back to nothing where they see none."""
    return G.upsert_edges(chunk_verbs(kb, p))


def chunk_verbs(kb: DataFrame, p: Providers = Providers()) -> DataFrame:
    """(kb_id, source, s, r, o, conf, ord): the providers' triples of each chunk, without weak verbs outside multi-hop sources."""
    t = kb.select("kb_id", "source", F.posexplode(p.triples(F.col("text"))).alias("i", "t")).select("kb_id", "source", "t.*", F.concat("kb_id", F.lit("/"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("ord"))
    return t.filter(F.coalesce(F.col("source").isin(*G.MULTI_HOP), F.lit(False)) | ~G.is_weak(F.regexp_extract("r", "^[^_]+", 0)))


def corpus_graph(kb: DataFrame, links: DataFrame, p: Providers = Providers(), c: G.GraphConfig = G.GraphConfig()) -> dict[str, DataFrame]:
    """The stages of the graph of ``kb`` (kb_id, text, source): edges of triples, of which those stay that their chunks' texts bear
    out; weights after what linked samples say (links: kb_id, sample_id, action, query, ord); placeholders where an ASK sample
    names what no node has; noise and weak edges removed, final weights. Returns edges, var_edges and bridges, stored."""
    first = cut(build_graph(kb, p))
    valid = cut(G.validate(first, G.chunk_similarities(first, kb, p.embed), c))
    m = cut(G.mentions(kb, p.entities(F.col("text"))))
    bridges = cut(G.bridges(m, G.endpoints(valid)))
    events, _ = G.path_events(bridges, kb.select("kb_id", "source"), valid, links)
    weighted = cut(G.reinforce(valid, events, c))
    asks = links.filter("action = 'ASK' AND sample_id IS NOT NULL")
    lacking = G.missing_entities(asks.filter("query IS NOT NULL"), "sample_id", p.entities(F.col("query")), m.select(F.col("node").alias("node_id")))
    anchors = bridges.filter("pos = 0").select("kb_id", F.col("node").alias("anchor"))
    asks = asks.join(lacking.select(F.col("query_id").alias("sample_id")), "sample_id", "left_semi").join(anchors, "kb_id").select("sample_id", "query", "anchor", "kb_id")
    _, var = G.placeholders(asks, c)
    noise = cut(G.noise_nodes(weighted).select("node"))
    kept = G.prune_weak(G.remove_nodes(weighted, noise), c)
    edges = cut(kept.withColumn("final_weight", G.final_weight(F.col("sem_score"), F.col("q_score"), 0.95, 0.95)))
    var = cut(var.join(noise.select(F.col("node").alias("src")), "src", "left_anti"))
    return {"edges": edges, "var_edges": var, "bridges": cut(G.bridges(bridges, G.endpoints(edges)))}


def build_ft(spark: SparkSession, sf_dir: str, p: Providers = Providers(), c: G.GraphConfig = G.GraphConfig()) -> DataFrame:
    """(ft_id, source_id, action, split, reason, messages, …): one row per sample with an action, invalid ones with the reason.

    A sample's graph lines are those around its seeds, the nodes nearest to its query and its known values, that bear on its query.
    """
    s = cut(samples(spark, sf_dir).filter("action IS NOT NULL"))
    multi, single = H.multi_turn_rows(s)
    multi = H.history(H.running_state(multi), last=None).withColumn("htext", H.history_text(F.col("history")))
    none = F.array().cast("array<string>")
    single = single.withColumns({"cum_known": none, "cum_resolved": none, "still_missing": none, "htext": F.lit("")})
    rows = multi.drop("history").unionByName(single)

    kb = table(spark, sf_dir, "kb").filter("text IS NOT NULL")
    each = F.arrays_zip(F.col("linked_sample_ids").alias("sample_id"), F.col("linked_actions").alias("action"), F.col("linked_queries").alias("query"))
    links = cut(kb.select("kb_id", F.posexplode(each).alias("i", "z")).select("kb_id", "z.*", F.concat_ws("/", "kb_id", F.lpad(F.col("i").cast("string"), 6, "0")).alias("at")))
    links = numbered_rows(links, ["at"], "ord").drop("at")
    g = corpus_graph(kb.select("kb_id", "text", key("source").alias("source")), links, p, c)
    seeds = N.seeds(s, "id", "query", "known", G.endpoints(g["edges"]), p.embed)
    lines = N.grounded_lines(s, "id", "query", "action", seeds, g["edges"], g["var_edges"], p.embed, "final_weight")
    top = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "triple"))).alias("t"))
    rows = rows.join(top.select("id", F.col("t.triple").alias("raw")), "id", "left")

    known = F.array_distinct(F.concat(F.coalesce("known", none), "cum_known"))
    rows = rows.withColumns({"all_known": known, "triples": B.cap_requires(B.anonymise(F.coalesce("raw", none)), F.col("action"))})
    rows = rows.withColumn("gaps", B.effective_missing(F.col("query"), F.col("all_known"), F.col("missing"), F.col("triples"), F.col("action"), F.col("cum_known"), F.col("still_missing")))
    rows = rows.withColumns({
        "reason": B.validity(F.col("all_known"), F.col("triples"), F.col("action"), F.col("gaps")),
        "split": S.hash_split(S.group_key(F.col("dialogue_id"), F.col("id"))),
        "messages": B.messages(
            SYSTEM, B.user_turn(F.col("query"), F.col("all_known"), F.col("gaps"), F.col("triples"), F.col("htext"), F.col("cum_resolved")),
            B.assistant_turn(F.coalesce("query", F.lit("")), F.col("action"), F.col("all_known"), F.col("gaps"), F.col("triples"), F.coalesce("failure_mode", F.lit("COMPLETE"))),
        ),
    })
    return rows.select(
        F.concat(F.lit("ft_"), "id").alias("ft_id"), F.col("id").alias("source_id"), "source", "action", "split", "reason", "difficulty", "failure_mode", "multi_turn", "turn_id", "dialogue_id",
        F.size("all_known").alias("num_known"), F.size("gaps").alias("num_missing"), F.size("triples").alias("num_triples"), "messages",
    )


def route(spark: SparkSession, sf_dir: str, p: Providers = Providers(), k: int = 5, pool: int = 200, c: G.GraphConfig = G.GraphConfig()) -> DataFrame:
    """(item_id, decision, reason, reply): retrieve by words and vectors, fuse, rerank, score and gate; where the gate lets answer,
    the planner decides by the graph's lines, if there are any; the chosen agent replies.

    A batch of queries flows through one plan; the three agents are three branches of CASE.
    """
    none = F.array().cast("array<string>")
    docs = table(spark, sf_dir, "documents").filter(ws_count("text") > 0).select("doc_id", "text")
    items = cut(table(spark, sf_dir, "eval_items").select("item_id", p.rewrite(F.col("query")).alias("query")).withColumn("known", p.variables(F.col("query"))))
    subs = items.select("item_id", "query", F.when(p.is_multihop(F.col("query")), p.decompose(F.col("query"))).otherwise(F.array("query")).alias("s"))
    subs = cut(subs.select("item_id", "query", F.size("s").alias("n_sub"), F.posexplode("s").alias("sub", "q")).withColumn("sid", F.concat_ws(":", "item_id", "sub")).withColumn("v", p.embed(F.col("q"))))
    dense = cut(R.dense_top_k(docs.withColumn("v", p.embed(F.col("text"))), "doc_id", "v", subs, "sid", "v", pool))
    sparse = cut(R.bm25_pool(docs, "doc_id", "text", subs, "sid", "q", pool, dense.select("query_id", "doc_id")))
    hits = R.fuse(dense, sparse, k).select(F.col("query_id").alias("sid"), "doc_id", F.col("fused_score").alias("score"), "rank")
    fan = R.fan_out(hits.join(subs.select("sid", F.col("item_id").alias("query_id"), "sub", "n_sub"), "sid"), k)
    ranked = docs.join(broadcast_if_small(cut(fan), 200_000), "doc_id").join(items.select(F.col("item_id").alias("query_id"), "query"), "query_id")
    top = R.rerank(ranked, p.rerank(F.col("query"), F.col("text")), k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("rerank_score").alias("score"), "text"))).alias("h"))
    x = items.join(top.withColumnRenamed("query_id", "item_id"), "item_id", "left").withColumns({
        "scores": F.coalesce("h.score", F.array().cast("array<double>")), "texts": F.coalesce("h.text", none)})
    x = D.text_conflict(cut(x), "item_id", "texts", p.embed)

    kb = table(spark, sf_dir, "kb").filter("text IS NOT NULL").select("kb_id", "text", key("source").alias("source"))
    edges = cut(build_graph(kb, p))
    mine = items.withColumn("action", F.lit("ANSWER"))
    lines = N.grounded_lines(mine, "item_id", "query", "action", N.seeds(items, "item_id", "query", "known", G.endpoints(edges), p.embed), edges, edges.select("src", "dst").limit(0), p.embed)
    graph = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "triple"))).alias("t")).select(F.col("id").alias("item_id"), F.col("t.triple").alias("triples"))
    gaps = G.missing_entities(items, "item_id", p.entities(F.col("query")), G.endpoints(edges).withColumnRenamed("node", "node_id")).select(F.col("query_id").alias("item_id"), F.array("missing").alias("missing"))
    x = x.join(graph, "item_id", "left").join(gaps, "item_id", "left").withColumns({"triples": F.coalesce("triples", none), "missing": F.coalesce("missing", none)})

    x = x.withColumns({"ev": D.evidence(F.col("query"), F.col("scores"), F.col("texts")), "amb": D.ambiguity(F.col("query"))})
    x = x.withColumn("g", D.gate(F.col("ev"), F.col("amb"), F.col("con"), p.answerability(F.col("ev"), F.col("amb"))))
    planned = (F.col("g.action") == "ANSWER") & (F.size("triples") > 0)
    x = x.withColumns({"decision": F.when(planned, P.decision(p.plan(F.col("triples"), F.col("missing")), "ABSTAIN")).otherwise(F.col("g.action")),
                       "reason": F.when(planned, "planned").otherwise(F.col("g.reason"))})
    best = F.get(C.compress(F.col("query"), F.slice("texts", 1, 1), 2), F.lit(0))
    answer = p.generate(D.prompt(F.col("query"), F.col("texts"))) if p.generate else best
    about = F.coalesce(D.anchor(F.col("triples"), F.col("known")), F.get("missing", F.lit(0)))
    reply = (
        F.when(F.col("decision") == "ANSWER", answer)
        .when(F.col("decision") == "ASK", D.as_question(B.question(F.when(F.size("missing") > 0, F.col("missing")).otherwise(F.array(about)), F.col("known"), F.col("query"))))
        .otherwise(F.concat(F.lit("Not answered: "), D.abstain_reason(F.col("query"), F.col("triples"), F.col("known"), F.col("missing"))))
    )
    return x.select("item_id", "decision", "reason", reply.alias("reply"))
