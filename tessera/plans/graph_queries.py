"""Queries over the entity graph, supervised samples and the routed pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import parse as P
from ..functions import text as X
from ..operators import ftset as B
from ..operators import graph as G
from ..operators import grounding as N
from ..operators.providers import ENDINGS, VERB_PATTERN, Providers, rule_planner, rule_type
from ..operators.similarity import similar_hubs
from ..runtime import cut
from . import pipeline
from .registry import S_SAMPLES, query, s_action, s_key, s_split, s_strip, s_vectors, samples, table

# ---------------------------------------------------------------- build

#: Names of a chunk: capitalised words of four letters or more, valid, distinct, by first appearance.
_STOP = ", ".join(f"'{w}'" for w in (*G.STOP_NAMES, *G.GENERIC_NAMES))
_NAMES = f"""
n AS (SELECT kb_id, {s_key("source")} AS source, list_filter(list_transform(regexp_extract_all(text, '[A-Z][a-z]{{3,}}'), lambda w: lower(w)), lambda w: w NOT IN ({_STOP})) AS w, linked_actions, linked_queries, linked_sample_ids FROM kb),
m AS (SELECT kb_id, source, node, (row_number() OVER (PARTITION BY kb_id ORDER BY pos) - 1)::INTEGER AS pos FROM (SELECT kb_id, source, node, min(pos) AS pos FROM (SELECT kb_id, source, unnest(w) AS node, unnest(range(1, len(w) + 1)) AS pos FROM n) GROUP BY ALL))"""
_CO = f"""{_NAMES}, t AS (SELECT kb_id, node FROM m),
e AS (SELECT a.node AS src, b.node AS dst, count(*) AS weight FROM t a JOIN t b ON a.kb_id = b.kb_id AND a.node <> b.node GROUP BY ALL)"""


def _mentions(spark, d):
    k = table(spark, d, "kb").filter("text IS NOT NULL")
    return G.mentions(k, G.capitalised(F.col("text")))


def _edges(spark, d):
    return cut(G.cooccurrence(_mentions(spark, d)))


@query(f"WITH {_NAMES} SELECT node, count(*) AS chunks, min(pos) AS first_pos FROM m GROUP BY 1")
def kg_nodes(spark, d):
    return _mentions(spark, d).groupBy("node").agg(F.count("*").alias("chunks"), F.min("pos").alias("first_pos"))


@query(f"WITH {_CO} SELECT src, dst, weight FROM e")
def kg_edges(spark, d):
    """Co-occurrence edges of all names of each chunk."""
    return G.cooccurrence(_mentions(spark, d)).select("src", "dst", "weight")


#: Sentences whose first two names make a triple: relation the sentence's second word.
_TR = f"""
ts AS (SELECT kb_id, {s_key("source")} AS source, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{{3,}} [a-z]+ [a-z]+ [A-Z][a-z]{{3,}}'), lambda x, i: {{'x': x, 'i': i}}), recursive := true) FROM kb),
tr AS (SELECT kb_id, source, lower(string_split(x, ' ')[1]) AS s, string_split(x, ' ')[2] AS r, lower(string_split(x, ' ')[4]) AS o, kb_id || '/' || lpad(i::VARCHAR, 6, '0') AS ord FROM ts)"""


def _triples(spark, d):
    hits = F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{3,} [a-z]+ [a-z]+ [A-Z][a-z]{3,}"), 0)
    k = table(spark, d, "kb").filter("text IS NOT NULL").select("kb_id", X.key("source").alias("source"), F.posexplode(hits).alias("i", "x"))
    w = F.split("x", " ")
    return k.select("kb_id", "source", F.lower(F.get(w, F.lit(0))).alias("s"), F.get(w, F.lit(1)).alias("r"), F.lower(F.get(w, F.lit(3))).alias("o"), F.lit(0.8).alias("conf"),
                    F.concat("kb_id", F.lit("/"), F.lpad((F.col("i") + 1).cast("string"), 6, "0")).alias("ord"))


def _similarities(spark, d, edges):
    return G.chunk_similarities(edges, table(spark, d, "kb").select("kb_id", "text"), Providers().embed)


_UP = _TR + """, ed AS (SELECT s AS src, o AS dst, min_by(r, ord) AS relation, 0.8::DOUBLE AS weight, count(*) AS frequency, list_sort(list_distinct(list(source))) AS sources, list_sort(list_distinct(list(kb_id))) AS kb_ids FROM tr WHERE s <> o GROUP BY ALL)"""


@query(f"WITH {_UP} SELECT src, dst, relation, frequency, array_to_string(sources, '|') AS sources, array_to_string(kb_ids, '|') AS kb_ids FROM ed")
def kg_triple_edges(spark, d):
    """Triples upserted into a simple directed graph."""
    return G.upsert_edges(_triples(spark, d)).select("src", "dst", "relation", "frequency", F.array_join("sources", "|").alias("sources"), F.array_join("kb_ids", "|").alias("kb_ids"))


#: The best similarity of an edge's text to the texts of its chunks, with the bonus for frequency.
_SEM = f"""{s_vectors("gv", "SELECT src || '|' || dst AS k, src || ' ' || replace(relation, '_', ' ') || ' ' || dst AS t FROM ed")}, {s_vectors("kv", "SELECT kb_id AS k, text AS t FROM kb WHERE kb_id IN (SELECT unnest(kb_ids) FROM ed)")},
sm AS (SELECT src, dst, round(least(1.0, max(s) + ln(1 + any_value(frequency)) * 0.03), 4) AS sem FROM (
  SELECT src, dst, kb_id, any_value(frequency) AS frequency, sum(gv.x * kv.x) AS s FROM (SELECT src, dst, frequency, unnest(kb_ids) AS kb_id FROM ed) JOIN gv ON gv.k = src || '|' || dst JOIN kv ON kv.k = kb_id AND kv.b = gv.b GROUP BY ALL) GROUP BY ALL)"""


@query(f"WITH {_UP}, {_SEM} SELECT src, dst, sem AS sem_score FROM sm WHERE sem >= 0.5")
def kg_validate(spark, d):
    """Edges whose similarity to one of their chunks with the bonus for frequency reaches the threshold."""
    e = cut(G.upsert_edges(_triples(spark, d)))
    return G.validate(e, _similarities(spark, d, e)).select("src", "dst", "sem_score")


_REINF = f"""{_UP}, ev AS (
 SELECT src, dst, a.x AS action, a.i AS ord, kb_id FROM (SELECT src, dst, unnest(kb_ids) AS kb_id FROM ed) JOIN (SELECT kb_id, unnest(list_transform(linked_actions, lambda x, i: {{'x': x, 'i': i}})) AS a FROM kb) USING (kb_id)),
fo AS (SELECT src, dst, list(action ORDER BY kb_id, ord) AS l FROM ev WHERE action IN ('ANSWER', 'ASK', 'ABSTAIN') GROUP BY ALL),
rf AS (SELECT ed.*, round(list_reduce(list_prepend(ed.weight, list_transform(coalesce(l, []), lambda a: CASE a WHEN 'ANSWER' THEN 10.2::DOUBLE WHEN 'ASK' THEN 10.05::DOUBLE ELSE -10.1::DOUBLE END)), lambda w, s: CASE WHEN s > 0 THEN least(0.95, w + s - 10) ELSE greatest(0, w + s + 10) END), 6) AS w2,
  coalesce(round(list_sum(list_transform(l, lambda a: CASE a WHEN 'ANSWER' THEN 0.3 WHEN 'ASK' THEN 0.1 ELSE 0 END)), 6), 0)::DOUBLE AS q FROM ed LEFT JOIN fo USING (src, dst))"""


def _reinforced(spark, d, e):
    links = table(spark, d, "kb").select("kb_id", F.posexplode("linked_actions").alias("i", "action"))
    ev = e.select("src", "dst", F.explode("kb_ids").alias("kb_id")).join(links, "kb_id").select("src", "dst", "action", (F.regexp_extract("kb_id", r"(\d+)$", 1).cast("bigint") * 100_000 + F.col("i")).alias("ord"))
    return G.reinforce(e, ev)


@query(f"WITH {_REINF}, {_SEM} SELECT src, dst, w2 AS weight, q AS q_score, round(least(1.0, 0.5 * sem + 0.5 * q) + 1e-9, 4) AS final_weight, round(least(0.95, 0.5 * least(sem, 0.95) + 0.5 * least(q, 0.95)) + 1e-9, 4) AS capped_weight FROM rf JOIN sm USING (src, dst)")
def kg_reinforce(spark, d):
    """Weights after the linked actions in their order, clamped at every step; final weights with each edge's similarity to its
    chunks."""
    e = cut(G.upsert_edges(_triples(spark, d)))
    sem = F.col("sem_score")
    r = _reinforced(spark, d, e).join(G.sem_scores(e, _similarities(spark, d, e)).select("src", "dst", "sem_score"), ["src", "dst"], "left")
    return r.select("src", "dst", "weight", "q_score", G.final_weight(sem, F.col("q_score")).alias("final_weight"), G.final_weight(sem, F.col("q_score"), 0.95, 0.95).alias("capped_weight"))


@query(f"""WITH {_TR}, o AS (SELECT kb_id, s, r, o, min(ord) AS ord FROM tr GROUP BY ALL)
SELECT kb_id, (row_number() OVER (PARTITION BY kb_id ORDER BY ord, s, r, o))::INTEGER AS rank, s || ' | ' || r || ' | ' || o AS triple FROM o QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY ord, s, r, o) <= 15""")
def kg_chunk_triples(spark, d):
    """The first 15 distinct triples of each chunk."""
    return G.chunk_triples(_triples(spark, d)).select("kb_id", "rank", F.concat_ws(" | ", "s", "r", "o").alias("triple"))


_ENDS = "CASE " + " ".join(f"WHEN regexp_matches(node, '({e})$') THEN '{t}'" for e, t in reversed(ENDINGS)) + " ELSE 'PERSON' END"
_CAT = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.CATEGORY.items()) + " ELSE 'Concept' END"


@query(f"WITH {_NAMES}, t AS (SELECT node, {_ENDS} AS type, count(*) AS chunks FROM m GROUP BY ALL) SELECT node, type, {_CAT} AS category, chunks FROM t WHERE type IN ({', '.join(repr(x) for x in G.NAMED_TYPES)})")
def kg_typed_nodes(spark, d):
    """Names whose type makes a node, with their category; types by the endings of names."""
    t = _mentions(spark, d).groupBy("node").agg(F.count("*").alias("chunks")).withColumn("type", rule_type(F.col("node")))
    return t.filter(F.col("type").isin(*G.NAMED_TYPES)).select("node", "type", G.category(F.col("type")).alias("category"), "chunks")


_WEAK = ", ".join(f"'{v}'" for v in G.WEAK_VERBS)


@query(f"""WITH h AS (SELECT kb_id, {s_key("source")} IN ('hotpotqa') AS hop, unnest(regexp_extract_all(coalesce(text, ''), '{VERB_PATTERN}')) AS h FROM kb),
p AS (SELECT kb_id, hop, lower(regexp_extract(h, '{VERB_PATTERN}', 1)) AS s, regexp_extract(h, '{VERB_PATTERN}', 2) AS v, regexp_extract(h, '{VERB_PATTERN}', 3) AS prep, lower(regexp_extract(h, '{VERB_PATTERN}', 4)) AS o FROM h)
SELECT s, CASE WHEN prep = '' THEN v ELSE v || '_' || prep END AS r, o, CASE WHEN prep = '' THEN 0.8 ELSE 0.7 END::DOUBLE AS conf, count(*) AS n FROM p
WHERE coalesce(hop, false) OR NOT ({" OR ".join(f"regexp_replace(v, '{e}$', '') IN ({_WEAK})" for e in ("", "s", "d", "es", "ed"))}) GROUP BY ALL""")
def kg_verb_triples(spark, d):
    """Verb triples of all chunks; weak verbs count in multi-hop sources only."""
    k = table(spark, d, "kb").filter("text IS NOT NULL").select(X.key("source").alias("source"), "kb_id", "text")
    t = pipeline.chunk_verbs(k, Providers()).groupBy("s", "r", "o", "conf").agg(F.count("*").alias("n"))
    return t.select("s", "r", "o", "conf", "n")


#: Nodes of chunks (br: kb_id, source, node, pos), the pairs looked at (pp) and the first path of each multi-hop chunk (cp).
_CP = f"""{_UP}, {_NAMES}, u AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed),
br AS (SELECT kb_id, source, node, row_number() OVER (PARTITION BY kb_id ORDER BY pos, node) - 1 AS pos FROM m WHERE node IN (SELECT src FROM u)),
wk AS (SELECT kb_id, any_value(source) = 'hotpotqa' AND count(*) > 1 AS walks, min_by(node, pos) AS first FROM br GROUP BY 1),
pp AS (SELECT a.kb_id, a.node AS a, b.node AS b, a.pos AS i, b.pos AS j FROM br a JOIN br b ON a.kb_id = b.kb_id AND a.pos < b.pos WHERE a.pos < 3 AND b.pos < 4 AND a.kb_id IN (SELECT kb_id FROM wk WHERE walks)),
w AS (SELECT DISTINCT a, b, [a, b] AS path FROM pp JOIN u ON u.src = a AND u.dst = b
  UNION ALL SELECT DISTINCT a, b, [a, x.dst, b] FROM pp JOIN u x ON x.src = a JOIN u y ON y.src = x.dst AND y.dst = b
  UNION ALL SELECT DISTINCT a, b, [a, x.dst, y.dst, b] FROM pp JOIN u x ON x.src = a JOIN u y ON y.src = x.dst JOIN u z ON z.src = y.dst AND z.dst = b),
bp AS (SELECT a, b, path FROM w QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) = 1),
cp AS (SELECT kb_id, path FROM pp JOIN bp USING (a, b) QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY i, j) = 1)"""


def _bridges(spark, d, e):
    return cut(G.bridges(_mentions(spark, d), G.endpoints(e)))


def _links(spark, d):
    k = table(spark, d, "kb").select("kb_id", F.posexplode("linked_actions").alias("i", "action"))
    return k.select("kb_id", "action", (F.regexp_extract("kb_id", r"(\d+)$", 1).cast("bigint") * 100_000 + F.col("i")).alias("ord"))


def _path_events(spark, d, e):
    sources = table(spark, d, "kb").select("kb_id", X.key("source").alias("source"))
    return G.path_events(_bridges(spark, d, e), sources, e, _links(spark, d))


@query(f"WITH {_CP} SELECT kb_id, array_to_string(path, '>') AS path FROM cp")
def kg_chunk_paths(spark, d):
    """The first path within three steps between the leading nodes of each multi-hop chunk."""
    e = cut(G.upsert_edges(_triples(spark, d)))
    hops = table(spark, d, "kb").filter(X.key("source").isin(*G.MULTI_HOP)).select("kb_id")
    return G.chunk_paths(_bridges(spark, d, e).join(hops, "kb_id", "left_semi"), e).select("kb_id", F.array_join("path", ">").alias("path"))


_STEPS = """stp AS (SELECT kb_id, unnest(list_transform(range(1, len(path)), lambda i: {'src': path[i], 'dst': path[i + 1]}), recursive := true) FROM cp),
sp AS (SELECT kb_id, src, dst FROM stp UNION ALL SELECT kb_id, dst, src FROM stp UNION ALL SELECT kb_id, src, dst FROM (SELECT src, dst, unnest(kb_ids) AS kb_id FROM ed) JOIN wk USING (kb_id) WHERE NOT coalesce(walks, false)),
la AS (SELECT kb_id, unnest(list_transform(linked_actions, lambda x, i: {'x': x, 'i': i})) AS a FROM kb),
pv AS (SELECT src, dst, list(a.x ORDER BY kb_id, a.i) AS l FROM sp JOIN la USING (kb_id) WHERE a.x IN ('ANSWER', 'ASK', 'ABSTAIN') GROUP BY ALL),
pr AS (SELECT ed.src, ed.dst, round(list_reduce(list_prepend(ed.weight, list_transform(coalesce(l, []), lambda a: CASE a WHEN 'ANSWER' THEN 10.2::DOUBLE WHEN 'ASK' THEN 10.05::DOUBLE ELSE -10.1::DOUBLE END)), lambda w, s: CASE WHEN s > 0 THEN least(0.95, w + s - 10) ELSE greatest(0, w + s + 10) END), 6) AS weight,
  coalesce(round(list_sum(list_transform(l, lambda a: CASE a WHEN 'ANSWER' THEN 0.3 WHEN 'ASK' THEN 0.1 ELSE 0 END)), 6), 0)::DOUBLE AS q_score FROM ed LEFT JOIN pv ON pv.src = ed.src AND pv.dst = ed.dst)"""


@query(f"WITH {_CP}, {_STEPS} SELECT src, dst, weight, q_score FROM pr")
def kg_path_reinforce(spark, d):
    """Weights after what linked samples say: along paths in multi-hop chunks, of a chunk's own edges elsewhere."""
    e = cut(G.upsert_edges(_triples(spark, d)))
    events, _ = _path_events(spark, d, e)
    return G.reinforce(e, events).select("src", "dst", "weight", "q_score")


@query(f"WITH {_CP} SELECT DISTINCT first AS node FROM wk JOIN (SELECT kb_id, unnest(linked_actions) AS action FROM kb) USING (kb_id) WHERE action = 'ABSTAIN' AND kb_id NOT IN (SELECT kb_id FROM cp)")
def kg_missing_info(spark, d):
    """Nodes at which ABSTAIN samples found no information."""
    e = cut(G.upsert_edges(_triples(spark, d)))
    return _path_events(spark, d, e)[1]


@query(f"WITH {_CP}, {_STEPS}, kept AS (SELECT * FROM pr WHERE weight >= 0.75) SELECT kb_id, node FROM br WHERE node IN (SELECT src FROM kept UNION SELECT dst FROM kept)")
def kg_bridges(spark, d):
    """Chunks and their nodes, indexed anew after weak edges and the nodes these leave alone were pruned."""
    e = cut(G.upsert_edges(_triples(spark, d)))
    strong = G.prune_weak(G.reinforce(e, _path_events(spark, d, e)[0]), G.GraphConfig(weak=0.75))
    nodes = G.without_isolated(G.endpoints(e).withColumnRenamed("node", "node_id"), strong)
    return G.bridges(_mentions(spark, d), nodes.withColumnRenamed("node_id", "node")).select("kb_id", "node")


@query(f"WITH {_CP}, {_STEPS} SELECT round(avg(weight), 4) AS mean, round(median(weight), 4) AS median, round(stddev_samp(weight), 4) AS std, min(weight) AS least, max(weight) AS most FROM pr")
def kg_weights(spark, d):
    e = cut(G.upsert_edges(_triples(spark, d)))
    return G.weight_stats(G.reinforce(e, _path_events(spark, d, e)[0]))


@query(f"WITH {_UP} SELECT relation, count(*) AS edges, sum(frequency)::BIGINT AS triples FROM ed GROUP BY 1")
def kg_relations(spark, d):
    """How often each relation occurs."""
    return G.upsert_edges(_triples(spark, d)).groupBy("relation").agg(F.count("*").alias("edges"), F.sum("frequency").alias("triples"))


# ---------------------------------------------------------------- read


@query(f"WITH {_CO}, x AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM x GROUP BY 1")
def kg_degree(spark, d):
    return G.degrees(_edges(spark, d))


@query(f"WITH {_CO}, x AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT node, count(*) AS degree FROM x GROUP BY 1 ORDER BY degree DESC, node LIMIT 20")
def kg_hubs(spark, d):
    """The report of the 20 nodes of highest degree."""
    return G.degrees(_edges(spark, d)).select("node", "degree").orderBy(F.desc("degree"), "node").limit(20)


_SPARSE = f"{_UP}, e AS (SELECT src, dst FROM ed), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query(f"""WITH RECURSIVE {_SPARSE}, r(node, reach) AS (SELECT src, src FROM u UNION SELECT r.node, u.dst FROM r JOIN u ON r.reach = u.src) SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def kg_components(spark, d):
    """Weakly connected components of the triple graph."""
    return G.components(G.upsert_edges(_triples(spark, d)).select("src", "dst"))


@query(f"""WITH RECURSIVE {_SPARSE}, r(node, reach) AS (SELECT src, src FROM u UNION SELECT r.node, u.dst FROM r JOIN u ON r.reach = u.src), c AS (SELECT component, count(*) AS n FROM (SELECT node, min(reach) AS component FROM r GROUP BY 1) GROUP BY 1)
SELECT count(*) AS components, max(n) AS largest FROM c""")
def kg_component_sizes(spark, d):
    return G.component_sizes(G.components(G.upsert_edges(_triples(spark, d)).select("src", "dst")))


_SEEDS = "sd AS (SELECT node AS seed FROM (SELECT src AS node FROM u UNION SELECT dst FROM u))"


def _seeds(edges):
    """Every node."""
    return G.endpoints(edges)


@query(f"""WITH RECURSIVE {_SPARSE}, {_SEEDS}, p(seed, node, dist, path) AS (SELECT seed, seed, 0, [seed] FROM sd UNION ALL SELECT p.seed, u.dst, p.dist + 1, list_append(p.path, u.dst) FROM p JOIN u ON u.src = p.node WHERE p.dist < 3 AND NOT list_contains(p.path, u.dst))
SELECT seed, node, dist::INTEGER AS dist, array_to_string(path, '>') AS path FROM p QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY dist, path) = 1""")
def kg_paths3(spark, d):
    """Shortest paths of at most three steps from every node, of equals the smallest."""
    e = cut(G.upsert_edges(_triples(spark, d)).select("src", "dst"))
    return G.shortest_paths(e, _seeds(e), 3).select("seed", "node", "dist", F.array_join("path", ">").alias("path"))


_EGO = f"{_SPARSE}, {_SEEDS}, h1 AS (SELECT seed, seed AS node FROM sd UNION SELECT seed, u.dst FROM sd JOIN u ON u.src = seed), eg AS (SELECT * FROM h1 UNION SELECT seed, u.dst FROM h1 JOIN u ON u.src = h1.node)"


@query(f"WITH {_EGO} SELECT seed, count(*) AS nodes, min(node) AS first_node, max(node) AS last_node FROM eg GROUP BY 1")
def kg_ego2(spark, d):
    e = cut(G.upsert_edges(_triples(spark, d)).select("src", "dst"))
    return G.ego(e, _seeds(e), 2).groupBy("seed").agg(F.count("*").alias("nodes"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))


@query(f"""WITH {_EGO}, i AS (SELECT a.seed, ed.src || ' | ' || replace(ed.relation, '_', ' ') || ' | ' || ed.dst AS triple, frequency FROM ed JOIN eg a ON a.node = ed.src JOIN eg b ON b.node = ed.dst AND a.seed = b.seed),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY frequency DESC, triple DESC) AS r FROM i)
SELECT seed, triple, (row_number() OVER (PARTITION BY seed ORDER BY r))::INTEGER AS rank FROM r WHERE r <= 36 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY r) <= 24""")
def kg_seed_triples(spark, d):
    """The most frequent triples around each seed."""
    e = cut(G.upsert_edges(_triples(spark, d)))
    return G.seed_triples(e, _seeds(e), "frequency")


@query(f"""WITH {_NAMES}, q AS (SELECT item_id, unnest(list_transform(regexp_extract_all(query, '[A-Z][a-z]{{3,}}'), lambda w, i: {{'w': lower(w), 'i': i}})) AS x FROM eval_items)
SELECT item_id AS query_id, min_by(x.w, x.i) AS missing FROM q WHERE x.w NOT IN (SELECT node FROM m) GROUP BY 1""")
def kg_missing(spark, d):
    """The first name of each evaluation query that no chunk mentions."""
    nodes = _mentions(spark, d).select(F.col("node").alias("node_id"))
    return G.missing_entities(table(spark, d, "eval_items"), "item_id", G.capitalised(F.col("query")), nodes)


@query(f"""WITH {_CO}, x AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e), dg AS (SELECT node, count(*) AS degree FROM x GROUP BY 1), nm AS (SELECT *, regexp_matches(node, '^[b-df-hj-np-tv-z][aeiou][b-df-hj-np-tv-z][aeiou]') AS named, (SELECT avg(degree) FROM dg) AS mean FROM dg)
SELECT node, CASE WHEN length(node) <= 4 AND NOT named THEN 'short_non_entity' WHEN degree > 3 * mean AND NOT named THEN 'generic_hub' END AS reason FROM nm WHERE (length(node) <= 4 OR degree > 3 * mean) AND NOT named""")
def kg_noise(spark, d):
    """Noise nodes; names by their syllables stand in for a recogniser."""
    e = _edges(spark, d)
    named = G.endpoints(e).withColumn("named", F.regexp_like("node", F.lit("^[b-df-hj-np-tv-z][aeiou][b-df-hj-np-tv-z][aeiou]")))
    return G.noise_nodes(e, named)


@query(f"""WITH {_CO}, x AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e), dg AS (SELECT node, count(*) AS degree FROM x GROUP BY 1), b AS (SELECT node FROM dg WHERE degree > 3 * (SELECT avg(degree) FROM dg))
SELECT count(*) AS edges, sum(weight)::BIGINT AS weight, count(DISTINCT src) AS nodes FROM e WHERE src NOT IN (SELECT node FROM b) AND dst NOT IN (SELECT node FROM b) AND weight >= 2""")
def kg_clean(spark, d):
    """The graph without hubs and weak edges."""
    e = _edges(spark, d)
    dg = G.degrees(e)
    hubs = dg.crossJoin(F.broadcast(dg.agg(F.avg("degree").alias("m")))).filter(F.col("degree") > 3 * F.col("m"))
    c = G.prune_weak(G.remove_nodes(e, hubs), G.GraphConfig(weak=2))
    return c.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"), F.count_distinct("src").alias("nodes"))


def _asks(spark, d):
    k = table(spark, d, "kb").select("kb_id", F.inline(F.arrays_zip(F.col("linked_sample_ids").alias("sample_id"), F.col("linked_actions").alias("action"), F.col("linked_queries").alias("query")))).filter("action = 'ASK'")
    first = _mentions(spark, d).groupBy("kb_id").agg(F.min_by("node", "pos").alias("anchor"))
    return k.join(first, "kb_id").select("sample_id", "query", "anchor", "kb_id")


_VARS = f"""{_NAMES}, f AS (SELECT kb_id, min_by(node, pos) AS anchor FROM m GROUP BY 1), la AS (SELECT kb_id, unnest(list_zip(linked_sample_ids, linked_actions)) AS z FROM kb),
va AS (SELECT anchor AS src, '?var_' || z[1] AS dst, count(*) AS frequency FROM la JOIN f USING (kb_id) WHERE z[2] = 'ASK' AND z[1] IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_VARS} SELECT src, dst, 'requires' AS relation, 0.9::DOUBLE AS weight, frequency FROM va")
def kg_placeholders(spark, d):
    """What ASK samples lack, as placeholder nodes at the first name of their chunks."""
    _, edges = G.placeholders(_asks(spark, d).filter("sample_id IS NOT NULL"))
    return edges.select("src", "dst", "relation", "weight", "frequency")


@query(f"""WITH {_CO}, x AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e), dg AS (SELECT node, count(*) AS degree FROM x GROUP BY 1), nm AS (SELECT *, regexp_matches(node, '^[b-df-hj-np-tv-z][aeiou][b-df-hj-np-tv-z][aeiou]') AS named, (SELECT avg(degree) FROM dg) AS mean FROM dg),
nz AS (SELECT node FROM nm WHERE (length(node) <= 4 OR degree > 3 * mean) AND NOT named){_VARS[len(_NAMES):]}, lq AS (SELECT kb_id, unnest(list_zip(linked_sample_ids, linked_actions, linked_queries)) AS z FROM kb),
bd AS (SELECT '?var_' || z[1] AS dst, min(z[3]) AS q FROM lq JOIN f USING (kb_id) WHERE z[2] = 'ASK' AND z[1] IS NOT NULL AND anchor IN (SELECT node FROM m GROUP BY 1 HAVING count(*) = 1) GROUP BY 1), nd AS (SELECT DISTINCT node FROM x WHERE node NOT IN (SELECT node FROM nz)),
{s_vectors("bq", "SELECT dst AS k, q AS t FROM bd WHERE q IS NOT NULL")}, {s_vectors("nq", "SELECT node AS k, node AS t FROM nd")}, sm AS (SELECT bq.k AS dst, nq.k AS node, round(sum(bq.x * nq.x), 6) AS sim FROM bq JOIN nq ON bq.b = nq.b GROUP BY ALL)
SELECT src, dst, 0.9::DOUBLE AS weight FROM va WHERE dst NOT IN (SELECT dst FROM bd) UNION ALL SELECT node, dst, 0.8 FROM (SELECT * FROM sm WHERE sim >= 0.25 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY sim DESC, node) = 1)""")
def kg_reanchored(spark, d):
    """Placeholders whose anchor one chunk only mentions, moved to the node nearest to their query that is no noise, or gone."""
    e, asks = _edges(spark, d), cut(_asks(spark, d).filter("sample_id IS NOT NULL"))
    named = lambda c: F.regexp_like(c, F.lit("^[b-df-hj-np-tv-z][aeiou][b-df-hj-np-tv-z][aeiou]"))
    noise = cut(G.noise_nodes(e, G.endpoints(e).withColumn("named", named("node"))).select("node"))
    rare = _mentions(spark, d).groupBy(F.col("node").alias("anchor")).count().filter(F.col("count") == 1)
    bad = asks.join(rare, "anchor", "left_semi").groupBy(F.concat(F.lit("?var_"), "sample_id").alias("node")).agg(F.min("query").alias("q"))
    bad = cut(bad.withColumn("v", F.when(F.col("q").isNotNull(), Providers().embed(F.col("q")))))
    left = G.endpoints(e).join(noise, "node", "left_anti").withColumn("v", Providers().embed(F.col("node")))
    best = N.nearest(bad, "node", "v", left, "node", "v", 1, 0.25).select(F.col("key").alias("node"), F.col("match").alias("anchor"), "sim")
    moved, _ = G.reanchor(G.placeholders(asks)[1], bad.select("node"), best, G.GraphConfig(reanchor=0.25))
    return moved.select("src", "dst", "weight")


@query()
def kg_similar_hubs(spark, d):
    return similar_hubs(G.degrees(_edges(spark, d)))


@query(f"WITH {_UP} SELECT (SELECT count(*) FROM (SELECT src FROM ed UNION SELECT dst FROM ed)) AS nodes, 0::BIGINT AS placeholders, count(*) AS edges, round(avg(weight), 4) AS mean_weight, min(weight) AS min_weight, max(weight) AS max_weight, round(avg((relation = 'related to')::INT), 4) AS weak_share FROM ed")
def kg_stats(spark, d):
    e = cut(G.upsert_edges(_triples(spark, d)))
    return G.stats(G.endpoints(e).withColumnRenamed("node", "node_id"), e)


# ---------------------------------------------------------------- grounding

#: Texts matched to nodes (mr: t, node, r), seeds of samples (sd: id, node).
_SD = f"""{_REINF}, {S_SAMPLES}, u AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), nd AS (SELECT DISTINCT src AS node FROM u),
tx AS (SELECT query AS t FROM s WHERE query IS NOT NULL UNION SELECT unnest(known) FROM s), {s_vectors("tv", "SELECT t AS k, t FROM tx WHERE t IS NOT NULL")}, {s_vectors("nv", "SELECT node AS k, node AS t FROM nd")},
mt AS (SELECT tv.k AS t, nv.k AS node, round(sum(tv.x * nv.x), 6) AS sim FROM tv JOIN nv ON tv.b = nv.b GROUP BY ALL),
mr AS (SELECT t, node, row_number() OVER (PARTITION BY t ORDER BY sim DESC, node) AS r FROM mt WHERE sim >= 0.55),
sd AS (SELECT id, node FROM s JOIN mr ON mr.t = s.query WHERE r <= 3 UNION SELECT id, node FROM (SELECT id, unnest(known) AS v FROM s) JOIN mr ON mr.t = v WHERE r <= 2)"""


def _weighted(spark, d):
    e = cut(G.upsert_edges(_triples(spark, d)))
    return cut(_reinforced(spark, d, e))


def _seeded(spark, d, edges):
    return N.seeds(samples(spark, d).select("id", "query", "known"), "id", "query", "known", G.endpoints(edges), Providers().embed)


@query(f"WITH {_SD} SELECT t AS text, node, r::INTEGER AS rank FROM mr WHERE r <= 5")
def node_matches(spark, d):
    """The five graph nodes nearest to each distinct query and known value, of a similarity of 0.55 or more."""
    s = samples(spark, d)
    texts = s.select("query").unionByName(s.select(F.explode("known").alias("query")))
    m = N.node_matches(texts, "query", G.endpoints(_weighted(spark, d)), Providers().embed)
    return m.select("text", F.posexplode("nodes").alias("rank", "node")).select("text", "node", (F.col("rank") + 1).alias("rank"))


@query(f"WITH {_SD} SELECT id, node FROM sd")
def ft_seeds(spark, d):
    """Seed nodes of each sample: three of its query, two of each known value."""
    return _seeded(spark, d, _weighted(spark, d))


_LINES_OF = f"""{_SD}, se AS (SELECT DISTINCT node AS seed FROM sd), h1 AS (SELECT seed, seed AS node FROM se UNION SELECT seed, u.dst FROM se JOIN u ON u.src = seed),
eg AS (SELECT * FROM h1 UNION SELECT seed, u.dst FROM h1 JOIN u ON u.src = h1.node),
it AS (SELECT a.seed, rf.src || ' | ' || replace(rf.relation, '_', ' ') || ' | ' || rf.dst AS triple, w2 FROM rf JOIN eg a ON a.node = rf.src JOIN eg b ON b.node = rf.dst AND a.seed = b.seed),
rk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY w2 DESC, triple DESC) AS r FROM it),
st AS (SELECT seed, triple FROM rk WHERE r <= 36 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY r) <= 24)"""


@query(f"""WITH {_LINES_OF}, {_VARS.split("WITH ")[-1]}, vl AS (SELECT id, min(src) AS anchor, dst FROM s JOIN sd USING (id) JOIN va ON va.src = sd.node WHERE action = 'ASK' GROUP BY id, dst QUALIFY row_number() OVER (PARTITION BY id ORDER BY dst) <= 3),
al AS (SELECT id, triple FROM sd JOIN st ON seed = node UNION SELECT id, anchor || ' | requires | ' || dst FROM vl), {s_vectors("qv", "SELECT id AS k, query AS t FROM s WHERE id IN (SELECT id FROM al)")}, {s_vectors("lv", "SELECT DISTINCT triple AS k, triple AS t FROM al")},
sc AS (SELECT id, triple, round(sum(qv.x * lv.x), 6) AS sim FROM al JOIN qv ON qv.k = id JOIN lv ON lv.k = triple AND lv.b = qv.b GROUP BY ALL)
SELECT id, triple, (row_number() OVER (PARTITION BY id ORDER BY sim DESC, triple DESC))::INTEGER AS rank, round(sim, 4) AS sim FROM sc WHERE sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, triple DESC) <= 12""")
def ft_triples(spark, d):
    """The graph lines each sample is grounded in. The offline vectors of short lines are seldom as similar to a query as a sentence
    encoder's, so 0.2 is asked for here instead of 0.35."""
    e = _weighted(spark, d)
    _, var = G.placeholders(_asks(spark, d).filter("sample_id IS NOT NULL"))
    g = N.grounded_lines(samples(spark, d), "id", "query", "action", _seeded(spark, d, e), e, var, Providers().embed, least=0.2)
    return g.select("id", "triple", "rank", F.round("sim", 4).alias("sim"))


# ---------------------------------------------------------------- supervised samples

_USER = "list_filter(messages, lambda m: m.role = 'user')[1].content"
_BLOCK = lambda n: f"coalesce(trim(regexp_extract({_USER}, '(?s)<{n}>(.*?)</{n}>', 1), ' ' || chr(10)), '')"
_LINES = lambda n: f"list_filter(string_split({_BLOCK(n)}, chr(10)), lambda x: len(string_split(x, ' | ')) = 3)"


def _ft(spark, d):
    """Fine-tuning samples with the parts of their user turn parsed back."""
    user = B.content_of(F.col("messages"), "user")
    lines = F.filter(F.split(P.tag(user, "graph_context", ""), "\n"), lambda t: F.size(F.split(t, r" \| ")) == 3)
    f = table(spark, d, "ft_samples").filter(F.regexp_like(user, F.lit("(?s)<query>.*</missing_variables>")))
    return f.withColumns({"action": X.action_label("action"), "triples": lines, "gaps": F.filter(F.transform(F.split(P.tag(user, "missing_variables", ""), "\n"), lambda s: F.regexp_replace(s, "^- ", "")), lambda s: ~s.isin("", "none")),
                          "known": F.filter(F.split(P.tag(user, "known_variables", ""), ", "), lambda s: ~s.isin("", "none")), "q": P.tag(user, "query", "")}).filter("action IS NOT NULL")


_FT = f"""ft AS (SELECT ft_id, {s_action("action")} AS action, {_LINES("graph_context")} AS triples, list_filter(list_transform(string_split({_BLOCK("missing_variables")}, chr(10)), lambda s: regexp_replace(s, '^- ', '')), lambda s: s NOT IN ('', 'none')) AS gaps,
  list_filter(string_split({_BLOCK("known_variables")}, ', '), lambda s: s NOT IN ('', 'none')) AS known FROM ft_samples WHERE {s_action("action")} IS NOT NULL AND regexp_matches({_USER}, '(?s)<query>.*</missing_variables>'))"""


@query(f"""WITH {_FT} SELECT ft_id, CASE
  WHEN len(known) = 0 AND len(triples) = 0 AND action = 'ASK' THEN 'zero_signal_ask' WHEN len(triples) = 0 AND action = 'ANSWER' AND len(known) = 0 THEN 'no_graph_answer'
  WHEN action = 'ASK' AND len(gaps) = 0 AND len(list_filter(triples, lambda t: contains(t, 'requires'))) = 0 THEN 'ask_no_missing_no_var_nodes'
  WHEN action = 'ANSWER' AND len(triples) > 0 AND len(known) > 0 AND len(list_filter(triples, lambda t: len(list_filter(known, lambda k: contains(lower(t), lower(trim(k))))) > 0)) = 0 THEN 'answer_graph_irrelevant'
  WHEN action = 'ANSWER' AND len(triples) = 0 THEN 'answer_empty_graph' ELSE 'ok' END AS reason FROM ft""")
def ft_validity(spark, d):
    """The reason against each sample, or ok."""
    return _ft(spark, d).select("ft_id", B.validity(F.col("known"), F.col("triples"), F.col("action"), F.col("gaps")).alias("reason"))


_RAW3 = "list_concat(triples, [split_part(triples[1], ' | ', 1) || ' | requires | ?var_' || ft_id, 'x | requires | ?var_b', 'y | requires | ?var_' || ft_id, 'z | requires | ?var_c', 'w | requires | ?var_d'])"


@query(f"""WITH {_FT}, a AS (SELECT ft_id, action, list_transform(list_concat(triples, ['x | requires | ?var_' || ft_id, 'x | requires | ?var_b', 'y | requires | ?var_' || ft_id, 'z | requires | ?var_c', 'w | requires | ?var_d']),
  lambda t: replace(replace(replace(replace(t, '?var_' || ft_id, '?unknown_1'), '?var_b', '?unknown_2'), '?var_c', '?unknown_3'), '?var_d', '?unknown_4')) AS t FROM ft)
SELECT ft_id, array_to_string(CASE WHEN action = 'ANSWER' THEN list_filter(t, lambda x: NOT (contains(x, 'requires') AND contains(x, '?unknown'))) ELSE list_concat(list_filter(t, lambda x: NOT contains(x, 'requires | ?unknown')), list_filter(t, lambda x: contains(x, 'requires | ?unknown'))[1:3]) END, ' / ') AS triples FROM a""")
def ft_anonymised(spark, d):
    """Graph lines with five placeholder edges added, anonymised by first appearance and capped."""
    v = lambda s, o: F.concat(F.lit(f"{s} | requires | "), o)
    own = F.concat(F.lit("?var_"), "ft_id")
    f = _ft(spark, d).withColumn("t", F.concat("triples", F.array(v("x", own), v("x", F.lit("?var_b")), v("y", own), v("z", F.lit("?var_c")), v("w", F.lit("?var_d")))))
    return f.select("ft_id", F.array_join(B.cap_requires(B.anonymise(F.col("t")), F.col("action")), " / ").alias("triples"))


@query(f"""WITH {_FT}, p AS (SELECT ft_id, '<decision>' || chr(10) || CASE WHEN len(triples) = 0 THEN 'ABSTAIN' WHEN len(list_filter(triples, lambda x: contains(x, '?'))) > 0 THEN 'ASK' WHEN len(gaps) > 0 THEN 'ABSTAIN' ELSE 'ANSWER' END || chr(10) || '</decision>' AS reply FROM ft)
SELECT ft_id, trim(regexp_extract(reply, '(?s)<decision>(.*?)</decision>', 1), ' ' || chr(10)) AS decision FROM p""")
def ft_rule_planner(spark, d):
    """The rule planner's tagged reply to each sample's graph and gaps, parsed back."""
    return _ft(spark, d).select("ft_id", P.decision(rule_planner(F.col("triples"), F.col("gaps")), "ABSTAIN").alias("decision"))


@query(f"""WITH {_FT}, u AS (SELECT ft_id, {_BLOCK("query")} AS q FROM ft_samples), x AS (SELECT ft.*, u.q, list_filter(string_split_regex(u.q, '\\s+'), lambda w: w <> '') AS w,
  list_filter(list_transform(list_filter(triples, lambda t: contains(split_part(t, ' | ', 2), 'requires') AND starts_with(split_part(t, ' | ', 3), '?unknown')), lambda t: trim(split_part(t, ' | ', 1))), lambda t: NOT starts_with(t, '?')) AS gg FROM ft JOIN u USING (ft_id))
SELECT ft_id, array_to_string(CASE WHEN len(gaps) > 0 THEN gaps WHEN len(gg) > 0 AND action <> 'ANSWER' THEN ['details about ''' || gg[1] || '''']
  WHEN action = 'ASK' THEN [CASE WHEN starts_with(lower(q), 'what') AND len(w) > 1 THEN '''' || w[2] || ''' information' WHEN contains(lower(q), 'who') THEN '''who'' referent for this query' WHEN contains(lower(q), 'which') THEN '''which'' referent for this query' WHEN contains(lower(q), 'where') THEN '''where'' referent for this query' WHEN contains(lower(q), 'when') THEN '''when'' referent for this query' WHEN contains(lower(q), 'how') THEN '''how'' referent for this query'
    ELSE 'context for: ''' || trim(regexp_replace(substr(q, 1, 40), '\\?+$', '')) || '''' END]
  WHEN action = 'ABSTAIN' THEN ['information about ''' || CASE WHEN len(known) > 0 THEN known[1] ELSE w[1] END || ''' absent from knowledge base'] ELSE [] END, '|') AS missing FROM x""")
def ft_effective_missing(spark, d):
    """What each sample lacks, by the first tier that says something."""
    return _ft(spark, d).select("ft_id", F.array_join(B.effective_missing(F.col("q"), F.col("known"), F.col("gaps"), F.col("triples"), F.col("action")), "|").alias("missing"))


_W = B.Wording()
_NL = "chr(10)"


@query(f"""WITH {_FT}, u AS (SELECT ft_id, coalesce({s_strip(f"regexp_extract({_USER}, '(?s)<query>(.*?)</query>', 1)")}, '') AS q FROM ft_samples)
SELECT ft_id, md5('<query>' || {_NL} || q || {_NL} || '</query>' || {_NL} || {_NL} || '<known_variables>' || {_NL} || CASE WHEN len(known) > 0 THEN array_to_string(known, ', ') ELSE 'none' END || {_NL} || '</known_variables>' || {_NL} || {_NL} || '<graph_context>' || {_NL}
  || CASE WHEN len(triples) > 0 THEN array_to_string(triples, {_NL}) ELSE '{_W.no_nodes}' END || {_NL} || '</graph_context>' || {_NL} || {_NL} || '<missing_variables>' || {_NL} || CASE WHEN len(gaps) > 0 THEN array_to_string(list_transform(gaps, lambda g: '- ' || g), {_NL}) ELSE 'none' END
  || {_NL} || '</missing_variables>' || {_NL} || {_NL} || '{_W.task}') AS turn FROM ft JOIN u USING (ft_id)""")
def ft_user_turns(spark, d):
    """User turns written from the parts that were parsed out of the samples'."""
    return _ft(spark, d).select("ft_id", F.md5(B.user_turn(F.col("q"), F.col("known"), F.col("gaps"), F.col("triples"))).alias("turn"))


@query(f"""WITH {_FT}, p AS (SELECT ft_id, action, len(triples) AS n, list_filter(list_transform(triples[1:6], lambda t: string_split(t, ' | ')), lambda x: len(x) = 3) AS p FROM ft),
o AS (SELECT *, list_filter(flatten(list_transform(p, lambda x: [{s_strip("x[1]")}, {s_strip("x[3]")}])), lambda e: NOT starts_with(e, '?') AND length(e) > 2) AS e, list_filter(list_transform(p, lambda x: {s_strip("x[2]")}), lambda r: r NOT IN ('requires', 'related to') AND length(r) > 3) AS r FROM p),
f AS (SELECT *, list_filter(e, lambda x, i: list_position(e, x) = i)[1:4] AS e4, list_filter(r, lambda x, i: list_position(r, x) = i)[1:3] AS r3 FROM o)
SELECT ft_id, CASE WHEN n = 0 THEN '{_W.no_graph}' ELSE 'Entities: ' || CASE WHEN len(e4) > 0 THEN array_to_string(e4, ', ') ELSE 'the query''s topic' END || '. Relations: ' || CASE WHEN len(r3) > 0 THEN array_to_string(r3, ', ') ELSE 'various' END || '. '
  || CASE action WHEN 'ANSWER' THEN '{_W.complete}' WHEN 'ASK' THEN '{_W.partial}' ELSE '{_W.absent}' END END AS summary FROM f""")
def ft_graph_summaries(spark, d):
    """What each sample's graph lines amount to."""
    return _ft(spark, d).select("ft_id", B.graph_summary(F.col("triples"), F.col("action")).alias("summary"))


@query()
def ft_build(spark, d):
    """Supervised samples built from the samples, the graph and running dialogue state, with splits that keep dialogues whole."""
    return pipeline.build_ft(spark, d).select("ft_id", "source_id", "action", "split", "reason", F.md5(F.to_json("messages")).alias("messages_hash"))


_SAID = "list_filter(messages, lambda m: m.role = 'assistant')[1].content"


@query(f"""
WITH t AS (SELECT ft_id, upper({s_strip("action")}) AS action, {_USER} AS u, {_SAID} AS a FROM ft_samples),
f AS (SELECT ft_id, action, u, a, CASE WHEN regexp_matches(a, '(?s)<decision>.*?</decision>') THEN {s_strip("regexp_extract(a, '(?s)<decision>(.*?)</decision>', 1)")} ELSE '' END AS d,
  CASE WHEN regexp_matches(u, '(?s)<graph_context>.*?</graph_context>') THEN regexp_extract(u, '(?s)<graph_context>(.*?)</graph_context>', 1) ELSE '' END AS g FROM t),
l AS (SELECT ft_id, unnest([CASE WHEN d NOT IN ('ANSWER', 'ASK', 'ABSTAIN') THEN 'no_decision' END, CASE WHEN d = 'ANSWER' AND contains(g, '?unknown') THEN 'answer_with_placeholder' END,
  CASE WHEN d = 'ASK' AND NOT contains(coalesce(a, ''), '?') THEN 'ask_without_question' END, CASE WHEN d IN ('ANSWER', 'ASK', 'ABSTAIN') AND d <> action THEN 'decision_differs' END,
  CASE WHEN coalesce({s_strip("u")}, '') = '' THEN 'empty_user' END, CASE WHEN coalesce({s_strip("a")}, '') = '' THEN 'empty_assistant' END]) AS flag FROM f)
SELECT ft_id, flag FROM l WHERE flag IS NOT NULL""")
def ft_quality_flags(spark, d):
    return B.quality_flags(table(spark, d, "ft_samples"))


@query(f"SELECT {s_split('split')} AS split, {s_action('action')} AS action, count(*) AS n, round(avg((num_triples > 0)::INT), 4) AS with_graph, round(avg(multi_turn::INT), 4) AS multi, sum(num_known) AS known FROM ft_samples GROUP BY ALL")
def ft_split_stats(spark, d):
    f = table(spark, d, "ft_samples").groupBy(X.split_label("split").alias("split"), X.action_label("action").alias("action"))
    return f.agg(F.count("*").alias("n"), F.round(F.avg((F.col("num_triples") > 0).cast("int")), 4).alias("with_graph"), F.round(F.avg(F.col("multi_turn").cast("int")), 4).alias("multi"), F.sum("num_known").alias("known"))


@query()
def routed_answers(spark, d):
    """Every evaluation query through hybrid retrieval, gate, planner and agents."""
    return pipeline.route(spark, d).select("item_id", "decision", "reason", "reply")
