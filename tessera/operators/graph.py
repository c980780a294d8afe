"""The entity graph: build, validate, reinforce, clean, and read it.

Tables: nodes (node_id, ...), edges (src, dst, relation, weight, frequency, sources, kb_ids, ...), one edge per ordered pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parse import is_numeric, plain_name
from ..runtime import cut, cut_counted, drop, lookup
from .gate import dot

#: Words that name no entity. Fixed values.
STOP_NAMES = (
    "he she it they his her its their him them this that these those i we you who which what where when how by the a an was were been being "
    "have has had do does did will would could should may might shall can need dare ought"
).split()
#: Phrases that name nothing in particular. Fixed values.
GENERIC_NAMES = (
    "the season", "the year", "the time", "the game", "the team", "the show", "the film", "one", "two", "three", "the series", "the episode", "the album", "the song", "the book",
)
#: Types of entities that become nodes. Fixed values.
NAMED_TYPES = ("PERSON", "ORG", "GPE", "LOC", "WORK_OF_ART", "EVENT", "LAW", "PRODUCT", "NORP", "FAC", "LANGUAGE")
#: Verbs that make no relation outside multi-hop sources. Fixed values.
WEAK_VERBS = (
    "be have do get make go come say know think see look want give use find tell ask seem feel try leave call keep let put become show"
).split()
#: Sources whose chunks are linked by paths. Fixed value.
MULTI_HOP = ("hotpotqa",)
#: Categories of entity types. Fixed values.
CATEGORY = {
    "PERSON": "Person", "ORG": "Organization", "GPE": "Location", "LOC": "Location", "FAC": "Location", "WORK_OF_ART": "Work", "LAW": "Work", "PRODUCT": "Work",
    "EVENT": "Event", "NORP": "Concept", "LANGUAGE": "Concept", "DATE": "Attribute", "CARDINAL": "Attribute",
}


@dataclass(frozen=True)
class GraphConfig:
    sem_threshold: float = 0.50
    freq_bonus: float = 0.03
    up_answer: float = 0.20
    up_ask: float = 0.05
    down_abstain: float = 0.10
    high: float = 0.95
    low: float = 0.0
    q_answer: float = 0.3
    q_ask: float = 0.1
    max_triples: int = 15
    placeholder_weight: float = 0.9
    reanchor: float = 0.30
    reanchored_weight: float = 0.8
    weak: float = 0.10


def valid_name(n: Column) -> Column:
    """At least three characters, no stop word, no generic phrase, not all digits and marks."""
    return F.coalesce((F.char_length(n) >= 3) & ~F.lower(n).isin(*STOP_NAMES, *GENERIC_NAMES) & ~is_numeric(n), F.lit(False))


def is_weak(verb: Column) -> Column:
    """A weak verb, in its base form or with an ending in s or ed."""
    v = F.lower(verb)
    return reduce(lambda a, b: a | b, (F.regexp_replace(v, f"{e}$", "").isin(*WEAK_VERBS) for e in ("", "s", "d", "es", "ed")))


def category(ent_type: Column) -> Column:
    out = F.lit("Concept")
    for k, v in sorted(CATEGORY.items()):
        out = F.when(ent_type == k, v).otherwise(out)
    return out


def mentions(kb: DataFrame, entities: Column, kb_id: str = "kb_id") -> DataFrame:
    """(kb_id, node, pos): valid distinct names of a chunk, numbered by first appearance."""
    names = F.array_distinct(F.filter(F.transform(entities, plain_name), valid_name))
    return kb.select(F.col(kb_id).alias("kb_id"), F.posexplode(names).alias("pos", "node"))


def capitalised(text: Column, least: int = 4) -> Column:
    """Offline entity names: capitalised runs of ASCII letters."""
    return F.regexp_extract_all(text, F.lit(rf"[A-Z][a-z]{{{least - 1},}}"), 0)


def cooccurrence(m: DataFrame, block: int = 64) -> DataFrame:
    """(src, dst, weight): both directions of each pair of distinct names of a chunk, numbers of chunks as weights.

    A chunk's sorted names are paired block by block, so that a row holds at most ``block`` squared pairs however many names the
    chunk has; pairs are counted one way before they are mirrored.
    """
    sets = m.groupBy("kb_id").agg(F.array_sort(F.collect_set("node")).alias("s"))
    last = F.ceil(F.size("s") / block).cast("int") - 1
    heads = sets.select("kb_id", "s", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    both = heads.select("kb_id", "s", "i", F.explode(F.sequence("i", "last")).alias("j"))
    part = lambda k: F.slice("s", F.col(k) * block + 1, block)
    both = both.select("kb_id", part("i").alias("x"), part("j").alias("y"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("y", lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    one = both.select("kb_id", F.inline(pairs)).groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def chunk_triples(triples: DataFrame, most: int = GraphConfig.max_triples) -> DataFrame:
    """(kb_id, rank, s, r, o): of each chunk its first ``most`` distinct triples. Copies are dropped, and the limit applied, before
    the shuffle."""
    once = triples.groupBy("kb_id", "s", "r", "o").agg(F.min("ord").alias("ord"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("kb_id").orderBy("ord", "s", "r", "o"))).filter(F.col("rank") <= most).select("kb_id", "rank", "s", "r", "o")


def upsert_edges(triples: DataFrame) -> DataFrame:
    """Edges of triples (s, r, o, conf, source, kb_id, ord): of one ordered pair, the first relation, the greatest weight, the
    number of triples, and the distinct sources and chunks. Loops are dropped."""
    t = triples.filter("s <> o")
    return t.groupBy(F.col("s").alias("src"), F.col("o").alias("dst")).agg(
        F.min_by("r", "ord").alias("relation"), F.max("conf").alias("weight"), F.count("*").alias("frequency"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("kb_id")).alias("kb_ids"),
    )


def bridges(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kb_id, node, pos): the mentions (kb_id, node, pos) of a chunk that are ``nodes`` (node) of the graph, numbered anew from 0.
    Made again after nodes were removed, it leaves these out."""
    kept = m.join(nodes.select("node").distinct(), "node", "left_semi")
    return kept.select("kb_id", "node", (F.row_number().over(Window.partitionBy("kb_id").orderBy("pos", "node")) - 1).alias("pos"))


def pair_paths(edges: DataFrame, pairs: DataFrame, hops: int = 3) -> DataFrame:
    """(a, b, path) for ``pairs`` (a, b) within ``hops`` (1 to 3) on the undirected graph, of shortest paths the smallest. Only
    the surroundings of the pairs' ends are walked, from both, and pairs joined by a short path aren't looked for again."""
    adj = cut(undirected(edges))
    out, left = [], cut(pairs.select("a", "b").filter("a <> b").distinct())
    for d in range(1, hops + 1):
        step = left.join(adj.select(F.col("src").alias("a"), F.col("dst").alias("x")), "a")
        if d == 1:
            met = step.filter("x = b").select("a", "b", F.array("a", "b").alias("path"))
        elif d == 2:
            met = step.join(adj.select(F.col("src").alias("x"), F.col("dst").alias("b")), ["x", "b"]).select("a", "b", F.array("a", "x", "b").alias("path"))
        else:
            ends = adj.select(F.col("src").alias("y"), F.col("dst").alias("b"))
            met = step.join(adj.select(F.col("src").alias("x"), F.col("dst").alias("y")), "x").join(ends, ["y", "b"]).select("a", "b", F.array("a", "x", "y", "b").alias("path"))
        out.append(cut(met.groupBy("a", "b").agg(F.min("path").alias("path"))))
        left = left.join(out[-1], ["a", "b"], "left_anti")
    return reduce(DataFrame.unionByName, out)


def chunk_paths(b: DataFrame, edges: DataFrame, hops: int = 3, first: int = 3, upto: int = 4) -> DataFrame:
    """(kb_id, path): for each chunk of ``b`` (kb_id, node, pos) the path of the first pair of its nodes, in their order, that has
    one; of each chunk the ``first`` nodes are paired with those before place ``upto``."""
    i, j = b.filter(F.col("pos") < first).select("kb_id", F.col("node").alias("a"), F.col("pos").alias("i")), b.filter(F.col("pos") < upto).select("kb_id", F.col("node").alias("b"), F.col("pos").alias("j"))
    pairs = cut(i.join(j, "kb_id").filter("i < j"))
    return pairs.join(pair_paths(edges, pairs, hops), ["a", "b"]).groupBy("kb_id").agg(F.min_by("path", F.struct("i", "j")).alias("path"))


def path_events(b: DataFrame, sources: DataFrame, edges: DataFrame, links: DataFrame, multi_hop: tuple[str, ...] = MULTI_HOP) -> tuple[DataFrame, DataFrame]:
    """(events, lacking): what linked samples (links: kb_id, action, ord) say about edges, as (src, dst, action, ord), and the
    nodes (node) that ABSTAIN samples found no information at.

    A chunk of a multi-hop source (sources: kb_id, source) with two nodes or more speaks of both directions of each step of
    its path, if it has one; any other chunk of the edges it gave. Without a path, or outside these sources, an ABSTAIN marks the
    chunk's first node.
    """
    n = b.groupBy("kb_id").agg(F.count("*").alias("n"), F.min_by("node", "pos").alias("first"))
    k = cut(n.join(sources.select("kb_id", F.col("source").isin(*multi_hop).alias("hop")), "kb_id").select("kb_id", "first", (F.coalesce("hop", F.lit(False)) & (F.col("n") > 1)).alias("walks")))
    paths = cut(chunk_paths(b.join(k.filter("walks").select("kb_id"), "kb_id", "left_semi"), edges))
    ends = lambda p, q: F.struct(p.alias("src"), q.alias("dst"))
    steps = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.array(ends(F.get("path", i), F.get("path", i + 1)), ends(F.get("path", i + 1), F.get("path", i))))
    walked = paths.select("kb_id", F.inline(F.flatten(steps)))
    own = edges.select("src", "dst", F.explode("kb_ids").alias("kb_id")).join(k.filter("NOT walks").select("kb_id"), "kb_id").select("kb_id", "src", "dst")
    events = walked.unionByName(own).join(links, "kb_id").select("src", "dst", "action", "ord")
    lost = k.join(paths.select("kb_id"), "kb_id", "left_anti").join(links.filter("action = 'ABSTAIN'"), "kb_id")
    return events, lost.select(F.col("first").alias("node")).distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def without_isolated(nodes: DataFrame, edges: DataFrame, keep: Column | None = None) -> DataFrame:
    """Nodes with an edge, and those that ``keep`` holds for."""
    linked = nodes.join(endpoints(edges).withColumnRenamed("node", "node_id"), "node_id", "left_semi")
    if keep is None:
        return linked
    kept = nodes.filter(keep).join(endpoints(edges).withColumnRenamed("node", "node_id"), "node_id", "left_anti")
    return linked.unionByName(kept)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree); a loop counts on both sides."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def chunk_similarities(edges: DataFrame, kb: DataFrame, embed, m: DataFrame | None = None) -> DataFrame:
    """(src, dst, sim) of each edge, as the text of its ends and relation, with each of its chunks' texts (kb: kb_id, text). With
    mentions ``m`` (kb_id, node), an edge without chunks is compared with the chunks that mention either end."""
    text = F.concat_ws(" ", "src", F.replace(F.coalesce("relation", F.lit("related to")), F.lit("_"), F.lit(" ")), "dst")
    of = edges.select("src", "dst", F.explode("kb_ids").alias("kb_id"))
    if m is not None:
        bare = edges.filter(F.coalesce(F.size("kb_ids"), F.lit(0)) <= 0).select("src", "dst", F.explode(F.array("src", "dst")).alias("node"))
        of = of.unionByName(bare.join(m.select("node", "kb_id"), "node").select("src", "dst", "kb_id").distinct())
    e = of.join(edges.select("src", "dst", embed(text).alias("_e")), ["src", "dst"])
    k = kb.filter("text IS NOT NULL").join(of.select("kb_id").distinct(), "kb_id", "left_semi").select("kb_id", embed(F.col("text")).alias("_k"))
    return e.join(k, "kb_id").select("src", "dst", dot(F.col("_e"), F.col("_k")).alias("sim"))


def sem_scores(edges: DataFrame, sims: DataFrame, c: GraphConfig = GraphConfig()) -> DataFrame:
    """Edges that have a similarity to a chunk (sims: src, dst, sim), with sem_score: the best one and a bonus for frequency."""
    best = sims.groupBy("src", "dst").agg(F.max("sim").alias("_s"))
    return edges.join(best, ["src", "dst"]).withColumn("sem_score", F.round(F.least(F.lit(1.0), F.col("_s") + F.log1p("frequency") * c.freq_bonus), 4)).drop("_s")


def validate(edges: DataFrame, sims: DataFrame, c: GraphConfig = GraphConfig()) -> DataFrame:
    """Edges whose best similarity to one of their chunks (sims: src, dst, sim), with a bonus for frequency, reaches the
    threshold; with sem_score."""
    return sem_scores(edges, sims, c).filter(F.col("sem_score") >= c.sem_threshold)


def reinforce(edges: DataFrame, events: DataFrame, c: GraphConfig = GraphConfig(), ranges: int = 64) -> DataFrame:
    """Edges with weight and q_score after ``events`` (src, dst, action, ord): ANSWER and ASK raise the weight up to ``high``,
    ABSTAIN lowers it down to ``low``, one after the other in the order of ord, as clamping makes order matter.

    A clamped step is w -> min(h, max(l, w + d)), and so are two of them one after the other. So the steps of an edge are first
    put together within ``ranges`` ranges of ord, and then those; no array holds all events of an edge that many have."""
    step = F.when(F.col("action") == "ANSWER", c.up_answer).when(F.col("action") == "ASK", c.up_ask).when(F.col("action") == "ABSTAIN", -c.down_abstain)
    gain = F.when(F.col("action") == "ANSWER", c.q_answer).when(F.col("action") == "ASK", c.q_ask).otherwise(0.0)
    per = events.withColumns({"_d": step, "_q": gain}).filter(F.col("_d").isNotNull())
    span = per.agg(F.min("ord").alias("_from"), (F.max("ord") - F.min("ord") + 1).alias("_span"))
    inf = F.lit(float("inf"))
    one = F.struct("ord", F.col("_d").alias("d"), F.when(F.col("_d") > 0, -inf).otherwise(c.low).alias("l"), F.when(F.col("_d") > 0, c.high).otherwise(inf).alias("h"))
    per = per.crossJoin(F.broadcast(span)).select("src", "dst", "_q", F.floor((F.col("ord") - F.col("_from")) * ranges / F.col("_span")).alias("_r"), one.alias("_s"))
    within = lambda a, l, h: F.least(h, F.greatest(l, a))
    then = lambda a, b: F.struct((a["d"] + b["d"]).alias("d"), within(a["l"] + b["d"], b["l"], b["h"]).alias("l"), within(a["h"] + b["d"], b["l"], b["h"]).alias("h"))
    nothing = F.struct(F.lit(0.0).alias("d"), (-inf).alias("l"), inf.alias("h"))
    together = lambda steps: F.aggregate(steps, nothing, then)
    part = per.groupBy("src", "dst", "_r").agg(F.array_sort(F.collect_list("_s")).alias("_l"), F.sum("_q").alias("_q")).select("src", "dst", "_r", "_q", together(F.col("_l")).alias("_s"))
    g = part.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("_r", "_s.d", "_s.l", "_s.h"))).alias("_l"), F.round(F.sum("_q"), 6).alias("_q"))
    g = g.select("src", "dst", "_q", together(F.col("_l")).alias("_s"))
    out = edges.join(g, ["src", "dst"], "left")
    q0 = F.coalesce(F.col("q_score"), F.lit(0.0)) if "q_score" in edges.columns else F.lit(0.0)
    w = F.col("weight").cast("double")
    moved = F.when(F.col("_s").isNull(), w).otherwise(within(w + F.col("_s.d"), F.col("_s.l"), F.col("_s.h")))
    return out.withColumns({"weight": F.round(moved, 6), "q_score": q0 + F.coalesce("_q", F.lit(0.0))}).drop("_s", "_q")


def final_weight(sem: Column, q: Column, cap: float = 1.0, term_cap: float | None = None) -> Column:
    """Half of the semantic score and half of the use, at most ``cap``. Halves of four-digit scores are often ties of the last
    digit shown, so they are lifted a little before they are rounded."""
    s, u = F.coalesce(sem, F.lit(0.0)), F.coalesce(q, F.lit(0.0))
    if term_cap is not None:
        s, u = F.least(s, F.lit(term_cap)), F.least(u, F.lit(term_cap))
    return F.round(F.least(F.lit(cap), 0.5 * s + 0.5 * u) + 1e-9, 4)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def shortest_paths(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, node, dist, path) of all nodes within ``hops`` of each seed, on the undirected graph; of shortest paths the
    lexicographically smallest. Frontier by frontier, each stored; nodes already reached are left out by an anti join."""
    adj = cut(undirected(edges))
    reached = cut(seeds.select(F.col("node").alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("dist"), F.array("seed").alias("path")))
    levels = [reached]
    for d in range(1, hops + 1):
        step = levels[-1].join(adj, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        done = reduce(DataFrame.unionByName, levels).select("seed", "node")
        new = step.groupBy("seed", "node").agg(F.min("path").alias("path")).join(done, ["seed", "node"], "left_anti")
        levels.append(cut(new.select("seed", "node", F.lit(d).alias("dist"), "path")))
    return reduce(DataFrame.unionByName, levels)


def _label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of the edges (src, node) of one task, by union and find."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while (p := up.setdefault(top, top)) != top:
            top = p
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["src"], pdf["node"]):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]}, dtype=object)


def components(edges: DataFrame, most_rounds: int = 300, hot_rows: int = 200_000, few: int = 50_000) -> DataFrame:
    """(node, component): weakly connected components, named by their least node. Each round a node takes the least label among
    its neighbours' and that label's own label, so that labels run ahead along chains; rounds end when nothing changes. Labels
    of hubs, and of components that many nodes have, are looked up by broadcast; each round's table goes with the next. A graph of at
    most ``few`` directed edges is labelled by one task, as rounds would only move next to nothing."""
    adj, n_edges = cut_counted(undirected(edges).select(F.col("src"), F.col("dst").alias("node")))
    if n_edges <= few:
        return adj.coalesce(1).mapInPandas(_label, "node string, component string")
    labels, n_nodes = cut_counted(adj.groupBy("src").agg(F.min("node").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
    for _ in range(most_rounds):
        near = lookup(adj, "node", labels, hot_rows, n_edges).groupBy("src").agg(F.min("component").alias("m"))
        low = labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        up = lookup(cut(low), "c", jump, hot_rows, n_nodes)
        last, labels = labels, cut(up.select("node", F.least("c", F.coalesce("up", "c")).alias("component"), "old"))
        drop(last)
        if labels.filter("component <> old").isEmpty():
            return labels.select("node", "component")
    raise RuntimeError("labels still change")


def ego(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node) of all nodes within ``hops``."""
    adj = cut(undirected(edges))
    out = front = seeds.select(F.col("node").alias("seed"), F.col("node").alias("node")).distinct()
    for _ in range(hops):
        front = front.join(adj, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        out = out.unionByName(front).distinct()
    return out


def _lines_near(lines: DataFrame, seeds: DataFrame, hops: int, look: int, most: int) -> DataFrame:
    """What ``seed_triples`` gives, of a graph whose ``lines`` (src, dst, triple), in their order, go out to the tasks of the seeds."""
    number: dict[str, int] = {}
    src, dst, triples = [], [], []
    for r in lines.select("src", "dst", "triple").toLocalIterator():
        src.append(number.setdefault(r.src, len(number)))
        dst.append(number.setdefault(r.dst, len(number)))
        triples.append(r.triple)
    sc, kind = lines.sparkSession.sparkContext, dict(lines.dtypes)["src"]
    sent = sc.broadcast((number, np.array(src, np.int32), np.array(dst, np.int32), triples))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, src, dst, triples = sent.value
        for pdf in batches:
            out = []
            for seed in pdf["seed"]:
                if seed not in number:
                    continue
                near = np.zeros(len(number), bool)
                near[number[seed]] = True
                for _ in range(hops):
                    ahead, back = dst[near[src]], src[near[dst]]
                    near[ahead] = near[back] = True
                at = np.flatnonzero(near[src] & near[dst])[:look]
                once = list(dict.fromkeys(triples[i] for i in at))[:most]
                out += [(seed, t, i + 1) for i, t in enumerate(once)]
            yield pd.DataFrame(out, columns=["seed", "triple", "rank"])

    s = seeds.select(F.col("node").alias("seed")).distinct().repartition(sc.defaultParallelism)
    return s.mapInPandas(run, f"seed {kind}, triple string, rank int")


def seed_triples(edges: DataFrame, seeds: DataFrame, weight: str = "weight", hops: int = 2, look: int = 36, most: int = 24, few: int = 200_000) -> DataFrame:
    """(seed, triple, rank): edges with both ends in a seed's surroundings, heaviest first (ties: later text first), the
    distinct ones among the first ``look``, at most ``most``.

    Near a hub each seed's surroundings are most of the graph. They are never stored for a graph of at most ``few`` edges, which
    goes out to the tasks as numbers and lines instead. Those of a larger graph are shuffled: as stored, pairs of seeds and
    nodes take a hundredth of their size in memory, so the optimizer would take them for small enough to broadcast."""
    text = F.concat_ws(" | ", "src", F.replace(F.coalesce("relation", F.lit("related to")), F.lit("_"), F.lit(" ")), "dst")
    lines, n = cut_counted(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.col(weight).alias("_w"), text.alias("triple")))
    if n <= few:
        return _lines_near(lines.orderBy(F.desc("_w"), F.desc("triple")), seeds, hops, look, most)
    e = cut(ego(edges, seeds, hops))
    a, b = e.select("seed", F.col("node").alias("src")), e.select("seed", F.col("node").alias("dst"))
    inside = lines.join(a.hint("merge"), "src").join(b.hint("merge"), ["seed", "dst"])
    w = Window.partitionBy("seed").orderBy(F.desc("_w"), F.desc("triple"))
    ranked = inside.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= look)
    once = ranked.groupBy("seed", "triple").agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("rank"))).filter(F.col("rank") <= most)


def missing_entities(queries: DataFrame, query_id: str, names: Column, nodes: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, missing): the first entity of a query that is no node of the graph."""
    q = queries.select(F.col(query_id).alias("query_id"), F.posexplode(F.transform(names, plain_name)).alias("pos", "node_id")).filter(F.char_length("node_id") >= least)
    return q.join(nodes.select("node_id").distinct(), "node_id", "left_anti").groupBy("query_id").agg(F.min_by("node_id", "pos").alias("missing"))


def placeholders(asks: DataFrame, c: GraphConfig = GraphConfig()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the gaps in ``asks`` (sample_id, query, anchor, kb_id): a ``?var_`` node a sample, required by each
    anchor."""
    var = F.concat(F.lit("?var_"), "sample_id")
    nodes = asks.groupBy(var.alias("node_id")).agg(F.min("query").alias("query"), F.min("anchor").alias("for_kb")).withColumns({"is_var": F.lit(True), "category": F.lit("Variable")})
    edges = asks.select(F.col("anchor").alias("src"), var.alias("dst"), F.col("sample_id")).groupBy("src", "dst").agg(
        F.lit("requires").alias("relation"), F.lit(c.placeholder_weight).alias("weight"), F.count("*").alias("frequency"), F.array(F.lit("variable_injection")).alias("sources"),
        F.array_sort(F.collect_set("sample_id")).alias("kb_ids"), F.lit(1.0).alias("sem_score"), F.lit(1.0).alias("q_score"),
    )
    return nodes, edges


def noise_reason(node: Column, degree: Column, mean_degree: Column, named: Column) -> Column:
    """Why a node is noise, null if it isn't: numbers, short unnamed words, unnamed hubs, unnamed "the ..."; placeholders
    never are."""
    unnamed = ~F.coalesce(named, F.lit(True))
    return F.when(
        ~node.startswith("?"),
        F.when(is_numeric(node), "pure_numeric")
        .when(~F.contains(node, F.lit(" ")) & (F.char_length(node) <= 4) & unnamed, "short_non_entity")
        .when((degree > 3 * mean_degree) & unnamed, "generic_hub")
        .when(node.startswith("the ") & unnamed, "generic_the_phrase"),
    )


def noise_nodes(edges: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(node, reason) of noise nodes; ``named`` (node, named) says which are named entities, absent ones count as named."""
    d = degrees(edges)
    mean = d.agg(F.avg("degree").alias("mean"))
    d = d.join(named, "node", "left") if named is not None else d.withColumn("named", F.lit(None).cast("boolean"))
    r = d.crossJoin(F.broadcast(mean)).withColumn("reason", noise_reason(F.col("node"), F.col("degree"), F.col("mean"), F.col("named")))
    return r.filter(F.col("reason").isNotNull()).select("node", "reason")


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    g = gone.select("node")
    return edges.join(g.withColumnRenamed("node", "src"), "src", "left_anti").join(g.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)


def prune_weak(edges: DataFrame, c: GraphConfig = GraphConfig()) -> DataFrame:
    return edges.filter((F.col("weight") >= c.weak) | F.col("dst").startswith("?var_"))


def reanchor(edges: DataFrame, bad: DataFrame, best: DataFrame, c: GraphConfig = GraphConfig()) -> tuple[DataFrame, DataFrame]:
    """(edges, removed placeholders): placeholders (bad: node) leave their anchors for the best node (best: node, anchor, sim)
    if it is similar enough, otherwise they go."""
    ok = bad.join(best, "node").filter(F.col("sim") >= c.reanchor)
    removed = bad.join(ok.select("node"), "node", "left_anti")
    kept = edges.join(bad.select(F.col("node").alias("dst")), "dst", "left_anti").select(*edges.columns)
    new = ok.select(F.col("anchor").alias("src"), F.col("node").alias("dst"), F.lit("requires").alias("relation"), F.lit(c.reanchored_weight).alias("weight"))
    return kept.unionByName(new, allowMissingColumns=True), removed


def weight_stats(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """One row: mean, median, deviation of a sample, least and greatest weight."""
    w = F.col(weight)
    return edges.agg(F.round(F.avg(w), 4).alias("mean"), F.round(F.percentile(w, 0.5), 4).alias("median"), F.round(F.stddev_samp(w), 4).alias("std"), F.min(w).alias("least"), F.max(w).alias("most"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """One row: number of components and nodes of the largest, from (node, component)."""
    return labels.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, placeholders, edges, mean, least and greatest weight, share of weak relations."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("node_id").startswith("?var_")).alias("placeholders"))
    e = edges.agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 4).alias("mean_weight"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"),
                  F.round(F.avg((F.coalesce("relation", F.lit("related to")) == "related to").cast("int")), 4).alias("weak_share"))
    return n.crossJoin(F.broadcast(e))
