"""Queries over chunks, retrieval, the gate and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import parse as P
from ..functions import text as X
from ..operators import chunk as C
from ..operators import gate as D
from ..operators import metrics as E
from ..operators import retrieve as R
from ..operators.ingest import context_text
from ..operators.providers import Providers, overlap_score
from ..runtime import cut
from .registry import S_CTX, S_SAMPLES, query, s_action, s_key, s_sentences, s_vectors, s_words, samples, table

# ---------------------------------------------------------------- chunks

_CHUNKS = f"""
d AS (SELECT doc_id, text, {s_words("text")} AS w FROM documents WHERE len({s_words("text")}) > 0),
k AS (SELECT doc_id, text, w, unnest(range(0, CASE WHEN len(w) > 350 THEN ceil((len(w) - 350) / 300.0)::INT + 1 ELSE 1 END)) AS k, CASE WHEN len(w) > 350 THEN ceil((len(w) - 350) / 300.0)::INT + 1 ELSE 1 END AS total FROM d),
c AS (SELECT doc_id, k::INTEGER AS chunk_idx, total::INTEGER AS total_chunks, CASE WHEN len(w) > 350 THEN array_to_string(w[300 * k + 1:300 * k + 350], ' ') ELSE text END AS text FROM k)
"""


def _chunks(spark, d):
    docs = table(spark, d, "documents").filter(X.ws_count("text") > 0)
    return docs.select("doc_id", F.inline(C.word_chunks(F.col("text"))))


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_idx, total_chunks, md5(text) AS hash FROM c")
def kb_chunks(spark, d):
    return _chunks(spark, d).select("doc_id", "chunk_idx", "total_chunks", P.fingerprint("text").alias("hash"))


@query(f"WITH {_CHUNKS} SELECT md5(text) AS hash, doc_id, chunk_idx FROM c QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id, chunk_idx) = 1")
def kb_dedup(spark, d):
    """Each distinct chunk once, where it occurs first."""
    return C.first_by(_chunks(spark, d).withColumn("hash", P.fingerprint("text")), ["hash"], "doc_id", "chunk_idx").select("hash", "doc_id", "chunk_idx")


_CONTEXTS = f"""
{S_SAMPLES}, x AS (SELECT id, action, query, source, {S_CTX} AS ctx FROM s), y AS (SELECT md5(ctx) AS h, * FROM x WHERE len({s_words("ctx")}) > 0)
"""


def _contexts(spark, d):
    s = samples(spark, d).withColumn("ctx", context_text_of("docs"))
    return C.contexts(s, F.col("ctx"), F.col("id"))


def context_text_of(c: str):
    texts = F.filter(F.transform(c, lambda t: X.strip(F.coalesce(t, F.lit("")))), lambda t: t != "")
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


@query(f"""
WITH {_CONTEXTS} SELECT h AS parent_ctx_hash, string_agg(id, '|' ORDER BY id) AS ids, string_agg(coalesce(action, ''), '|' ORDER BY id) AS actions, count(*)::INTEGER AS num_linked,
  count(*) FILTER (action = 'ANSWER')::INTEGER AS answers, count(*) FILTER (action = 'ASK')::INTEGER AS asks FROM y GROUP BY 1""")
def ctx_links(spark, d):
    """Contexts with the samples linked to them and their distribution of actions."""
    s = samples(spark, d).withColumn("ctx", context_text_of("docs"))
    c = C.with_links(_contexts(spark, d), C.context_links(s, F.col("ctx"), F.col("id")))
    n = lambda a: F.coalesce(F.try_element_at("action_distribution", F.lit(a)), F.lit(0))
    return c.select(
        "parent_ctx_hash", F.array_join("linked_sample_ids", "|").alias("ids"), F.array_join("linked_actions", "|", "").alias("actions"), "num_linked", n("ANSWER").alias("answers"), n("ASK").alias("asks")
    )


_KB = f"""
{_CONTEXTS}, f AS (SELECT h, min(ctx) AS ctx, min(id) AS ord, min_by(source, id) AS source, count(*) AS n FROM y GROUP BY 1),
w AS (SELECT *, {s_words("ctx")} AS w FROM f),
nc AS (SELECT *, len(w) > 350 AND ((source = 'contract_nli' AND len(w) > 300) OR (source = 'quac' AND len(w) > 400)) AS many FROM w)
"""


@query(f"""
WITH {_KB}, k AS (SELECT *, unnest(range(0, CASE WHEN many THEN ceil((len(w) - 350) / 300.0)::INT + 1 ELSE 1 END)) AS k FROM nc),
c AS (SELECT h, ord, n, k::INTEGER AS chunk_idx, CASE WHEN many THEN array_to_string(w[300 * k + 1:300 * k + 350], ' ') ELSE ctx END AS text FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY ord, h, chunk_idx) AS r FROM c)
SELECT printf('kb_%07d', row_number() OVER (ORDER BY ord, h, chunk_idx) - 1) AS kb_id, md5(text) AS chunk_hash, h AS parent_ctx_hash, chunk_idx, len({s_words("text")})::INTEGER AS word_count, n::INTEGER AS num_linked FROM o WHERE r = 1""")
def kb_build(spark, d):
    """The flat knowledge base of all samples' contexts."""
    return C.flat_kb(_contexts(spark, d)).select("kb_id", "chunk_hash", "parent_ctx_hash", "chunk_idx", F.col("word_count").cast("int").alias("word_count"), "num_linked")


@query(f"SELECT doc_id, len({s_sentences('text')})::INTEGER AS n, md5(array_to_string({s_sentences('text')}, '|')) AS h FROM documents")
def sentence_lists(spark, d):
    s = P.sentences("text")
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("h"))


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({s_sentences("text")}, lambda s: {{'s': s, 'n': len({s_words("s")})}}) AS s FROM documents),
f AS (
  SELECT doc_id, s, 0 AS i, []::VARCHAR[] AS done, []::STRUCT(s VARCHAR, n BIGINT)[] AS now FROM d WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN fill THEN list_append(done, array_to_string(list_transform(now, lambda x: x.s), ' ')) ELSE done END,
    list_append(CASE WHEN fill THEN now[greatest(len(now) - 1, 1):] ELSE now END, s[i + 1])
  FROM (SELECT *, coalesce(list_sum(list_transform(now, lambda x: x.n)), 0) + s[i + 1].n > 350 AND len(now) > 0 AS fill FROM f WHERE i < len(s)))
SELECT doc_id, len(done)::INTEGER + 1 AS n, md5(array_to_string(list_append(done, array_to_string(list_transform(now, lambda x: x.s), ' ')), '|')) AS h FROM f WHERE i = len(s)""")
def sentence_chunks(spark, d):
    """Sentences packed up to 350 words, two carried over."""
    told = X.let(C.sentence_chunks(F.col("text")), lambda c: F.struct(F.size(c).alias("n"), F.md5(F.array_join(c, "|")).alias("h")))
    return table(spark, d, "documents").filter(F.size(P.sentences("text")) > 0).select("doc_id", F.inline(F.array(told)))


@query(f"""
WITH {_CONTEXTS}, f AS (SELECT h, min(ctx) AS ctx, min(id) AS ord FROM y GROUP BY 1),
p AS (SELECT h, ord, unnest(list_transform({s_sentences("ctx")}, lambda s, i: {{'s': s, 'i': i - 1}})) AS x FROM f),
r AS (SELECT h, ord, x.s AS text, x.i AS pos FROM p WHERE len({s_words("x.s")}) >= 5)
SELECT md5(text) AS hash, h AS parent_ctx_hash, pos::INTEGER AS sent_idx FROM r
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY ord, h, pos) = 1""")
def fine_sentences(spark, d):
    """Single sentences of five words or more, each once."""
    m = _contexts(spark, d).withColumn("p", F.explode(F.transform(P.sentences("ctx"), lambda s, i: F.struct(s.alias("text"), i.alias("pos"))))).select("*", "p.*")
    once = C.first_by(m.filter(X.ws_count("text") >= 5).withColumn("hash", P.fingerprint("text")), ["hash"], "ord", "parent_ctx_hash", "pos")
    return once.select("hash", "parent_ctx_hash", F.col("pos").alias("sent_idx"))


@query(f"""
WITH RECURSIVE {_CONTEXTS}, f0 AS (SELECT h, min(ctx) AS ctx, min(id) AS ord FROM y GROUP BY 1), d AS (SELECT h, ord, list_transform({s_sentences("ctx")}, lambda s: {{'s': s, 'n': len({s_words("s")})}}) AS s FROM f0),
f AS (
  SELECT h, ord, s, 0 AS i, []::VARCHAR[] AS done, []::STRUCT(s VARCHAR, n BIGINT)[] AS now FROM d WHERE len(s) > 0
  UNION ALL
  SELECT h, ord, s, i + 1, CASE WHEN fill THEN list_append(done, array_to_string(list_transform(now, lambda x: x.s), ' ')) ELSE done END, list_append(CASE WHEN fill THEN now[greatest(len(now) - 1, 1):] ELSE now END, s[i + 1])
  FROM (SELECT *, coalesce(list_sum(list_transform(now, lambda x: x.n)), 0) + s[i + 1].n > 350 AND len(now) > 0 AS fill FROM f WHERE i < len(s))),
c AS (SELECT h, ord, list_append(done, array_to_string(list_transform(now, lambda x: x.s), ' ')) AS parts FROM f WHERE i = len(s)),
r AS (SELECT 'coarse' AS granularity, h, ord, unnest(parts) AS text, unnest(range(0, len(parts))) AS pos FROM c UNION ALL SELECT 'fine', h, ord, text, pos FROM (SELECT h, ord, unnest(list_transform(s, lambda x: x.s)) AS text, unnest(range(0, len(s))) AS pos, unnest(list_transform(s, lambda x: x.n)) AS n FROM d) WHERE n >= 5)
SELECT 'mg_' || substr(md5(text), 1, 12) AS mg_id, granularity, h AS parent_ctx_hash, CASE WHEN granularity = 'coarse' THEN pos::INTEGER END AS chunk_idx, CASE WHEN granularity = 'fine' THEN pos::INTEGER END AS sent_idx, len({s_words("text")}) AS word_count FROM r
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY ord, h, granularity, pos) = 1""")
def multi_kb(spark, d):
    """Coarse and fine entries together; of equal texts of a context the coarse one stays."""
    return C.multi_kb(_contexts(spark, d)).select("mg_id", "granularity", "parent_ctx_hash", "chunk_idx", "sent_idx", "word_count")


# ---------------------------------------------------------------- retrieval


def _lower(c: str) -> str:
    return s_words(f"lower({c})")


def _bm25(docs: str, doc_id: str, text: str) -> str:
    return f"""
t AS (SELECT {doc_id} AS doc_id, {_lower(text)} AS w FROM {docs} WHERE len({_lower(text)}) > 0),
tf AS (SELECT doc_id, term, len(any_value(w)) AS dl, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM t) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(w)) AS adl FROM t),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf, st GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""


def _scores(q: str) -> str:
    return f"""
q AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({_lower("q")}) AS term FROM ({q})) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / adl))) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), st GROUP BY ALL)"""


_ITEMS = "SELECT item_id AS query_id, query AS q FROM eval_items"
_TOP5 = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank, score FROM sc"


@query(f"WITH {_bm25('documents', 'doc_id', 'text')} SELECT term, df, round(idf, 4) AS idf FROM idf")
def bm25_idf(spark, d):
    freq = cut(R.frequencies(table(spark, d, "documents"), "text"))
    return R.idf_of(freq, freq.filter("term IS NULL").collect()[0].df).select("term", "df", F.round("idf", 4).alias("idf"))


@query(f"WITH {_bm25('documents', 'doc_id', 'text')}, {_scores(_ITEMS)} SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 4) AS score FROM ({_TOP5}) WHERE rank <= 5")
def bm25_top5(spark, d):
    s = R.bm25_top_k(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "query", 5)
    return s.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query(f"""
WITH {_CHUNKS}, u AS (SELECT doc_id * 1000 + chunk_idx AS cid, text FROM c QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id, chunk_idx) = 1), {_bm25('u', 'cid', 'text')}, {_scores(_ITEMS)}
SELECT query_id, doc_id AS chunk, rank::INTEGER AS rank, round(score, 4) AS score FROM ({_TOP5}) WHERE rank <= 5""")
def bm25_chunks(spark, d):
    """Flagship: documents are chunked, equal chunks dropped, and each evaluation query gets its five best chunks."""
    once = C.first_by(_chunks(spark, d).withColumn("hash", P.fingerprint("text")), ["hash"], "doc_id", "chunk_idx")
    u = cut(once.select((F.col("doc_id") * 1000 + F.col("chunk_idx")).alias("cid"), "text"))
    s = R.bm25_top_k(u, "cid", "text", table(spark, d, "eval_items"), "item_id", "query", 5)
    return s.select("query_id", F.col("doc_id").alias("chunk"), "rank", F.round("score", 4).alias("score"))


_VEC = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
q AS (SELECT vec_id AS query_id, e AS qe, label AS ql FROM v WHERE vec_id % 100 = 0),
sc AS (SELECT query_id, ql, vec_id AS doc_id, label, round(list_dot_product(qe, e), 6) AS score FROM q, v WHERE query_id <> vec_id)"""


def _dense(spark, d, k):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0")  # the stated query set, against all rows
    return R.dense_top_k(e, "vec_id", "embedding", q, "vec_id", "embedding", k, exclude_self=True)


@query(f"WITH {_VEC} SELECT query_id, doc_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM sc) WHERE rank <= 5")
def dense_top5(spark, d):
    return _dense(spark, d, 5)


@query(f"""WITH {_VEC}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM f WHERE rank <= 25 AND label = ql QUALIFY rank <= 5""".replace("QUALIFY rank <= 5", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5"))
def dense_postfilter(spark, d):
    """The best five of a query's own label among its best 25."""
    e = table(spark, d, "embeddings")
    labels = e.select(F.col("vec_id").alias("doc_id"), "label")
    hits = _dense(spark, d, 25).join(F.broadcast(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))), "query_id")
    return R.source_filtered(hits, labels, F.col("label") == F.col("ql"), 5).select("query_id", "doc_id", "score", "rank")


@query(f"""
WITH {_bm25('documents', 'doc_id', 'text')}, {_scores("SELECT item_id AS query_id, query AS q FROM eval_items WHERE item_id IN (SELECT vec_id FROM embeddings)")},
dn AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN eval_items i ON i.item_id = a.vec_id, embeddings b),
dp AS (SELECT query_id, doc_id, score AS dense_score FROM dn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 200),
sp AS (SELECT query_id, doc_id FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 200),
pool AS (SELECT query_id, doc_id FROM dp UNION SELECT query_id, doc_id FROM sp),
mx AS (SELECT query_id, max(score) AS best FROM sc GROUP BY 1),
fu AS (SELECT query_id, doc_id, coalesce(dense_score, 0) AS dense_score, coalesce(score, 0) AS bm25, 0.5 * coalesce(dense_score, 0) + 0.5 * CASE WHEN best > 0 THEN coalesce(score, 0) / best ELSE 0 END AS fused
  FROM pool LEFT JOIN dp USING (query_id, doc_id) LEFT JOIN sc USING (query_id, doc_id) LEFT JOIN mx USING (query_id))
SELECT query_id, doc_id, round(dense_score + 1e-9, 4) AS dense_score, round(bm25 + 1e-9, 4) AS bm25_score, round(fused + 1e-9, 4) AS fused_score FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 6) DESC, doc_id) <= 5""")
def hybrid_top5(spark, d):
    """Dense and sparse lists fused; item and document numbers pair with vector numbers as stand-ins. Halves of six-digit scores
    are often ties of the last digit shown, so all are lifted a little before they are rounded."""
    e, items = table(spark, d, "embeddings"), table(spark, d, "eval_items")
    known = items.join(e.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    dense = cut(R.dense_top_k(e, "vec_id", "embedding", known, "item_id", "embedding", 200))
    sparse = cut(R.bm25_pool(table(spark, d, "documents"), "doc_id", "text", known, "item_id", "query", 200, dense.select("query_id", "doc_id")))
    return R.fuse(dense, sparse, 5).select("query_id", "doc_id", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("dense_score", "bm25_score", "fused_score")))


_HOP = " OR ".join(f"contains(lower(query), '{w}')" for w in R.HOP_WORDS)


@query(f"SELECT item_id, coalesce(len({_lower('query')}) > 12 OR {_HOP}, false) AS multi_hop, len(CASE WHEN len(p) > 1 THEN p ELSE [query] END)::INTEGER AS subs FROM (SELECT *, list_filter(list_transform(string_split_regex(query, '(?i)\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM eval_items)")
def multihop(spark, d):
    return table(spark, d, "eval_items").select("item_id", R.is_multihop("query").alias("multi_hop"), F.size(R.decompose("query")).alias("subs"))


_SUBS = "SELECT item_id * 100 + i AS query_id, x AS q FROM (SELECT item_id, unnest(list_transform(CASE WHEN len(p) > 1 THEN p ELSE [query] END, lambda x, i: {'x': x, 'i': i - 1}), recursive := true) FROM (SELECT *, list_filter(list_transform(string_split_regex(query, '(?i)\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM eval_items))"


@query(f"""
WITH {_bm25('documents', 'doc_id', 'text')}, {_scores(_SUBS)}, n AS (SELECT query_id // 100 AS item, count(*) AS n_sub FROM ({_SUBS}) GROUP BY 1),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM sc),
tk AS (SELECT h.query_id // 100 AS item, h.query_id % 100 AS sub, doc_id, r FROM h JOIN n ON n.item = h.query_id // 100 WHERE r <= greatest(1, 6 // n_sub)),
f AS (SELECT * FROM tk QUALIFY row_number() OVER (PARTITION BY item, doc_id ORDER BY sub, r) = 1)
SELECT item AS query_id, doc_id, (row_number() OVER (PARTITION BY item ORDER BY sub, r))::INTEGER AS rank FROM f""")
def subquery_fanout(spark, d):
    """Each sub-query's share of six hits, together without repetition."""
    subs = table(spark, d, "eval_items").select("item_id", F.size(R.decompose("query")).alias("n_sub"), F.posexplode(R.decompose("query")).alias("sub", "q")).withColumn("sid", F.col("item_id") * 100 + F.col("sub"))
    hits = R.bm25_top_k(table(spark, d, "documents"), "doc_id", "text", subs, "sid", "q", 6)
    named = hits.withColumnRenamed("query_id", "sid").join(subs.select("sid", F.col("item_id").alias("query_id"), "sub", "n_sub"), "sid")
    return R.fan_out(named, 6).select("query_id", "doc_id", "rank")


# ---------------------------------------------------------------- evidence, gate


_HITS = f"""
{_bm25('documents', 'doc_id', 'text')}, {_scores(_ITEMS)},
h AS (SELECT query_id, doc_id, rank, score FROM ({_TOP5}) WHERE rank <= 5),
g AS (SELECT i.item_id, i.query, list(round(h.score / 10, 6) ORDER BY rank) FILTER (h.doc_id IS NOT NULL) AS sc, list(d.text ORDER BY rank) FILTER (h.doc_id IS NOT NULL) AS tx FROM eval_items i LEFT JOIN h ON h.query_id = i.item_id LEFT JOIN documents d ON d.doc_id = h.doc_id GROUP BY ALL)"""


def _hits(spark, d):
    """Items with scores (scaled to about 0 to 1) and texts of their five best documents, in rank order."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items")
    top = R.bm25_top_k(docs, "doc_id", "text", items, "item_id", "query", 5).join(docs, "doc_id")
    g = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", (F.round(F.col("score") / 10, 6)).alias("score"), "text"))).alias("h"))
    none = F.array().cast("array<double>"), F.array().cast("array<string>")
    return items.select("item_id", "query", "gt_action").join(g.withColumnRenamed("query_id", "item_id"), "item_id", "left").select(
        "item_id", "query", "gt_action", F.coalesce("h.score", none[0]).alias("scores"), F.coalesce("h.text", none[1]).alias("texts")
    )


_LIST = lambda names: "[" + ", ".join(f"'{w}'" for w in names) + "]"
_EV = f"""
n AS (SELECT item_id, query, list_transform(coalesce(sc, []), lambda x: CASE WHEN x > 1 OR x < 0 THEN 1 / (1 + exp(-x)) ELSE x END) AS s, lower(array_to_string(coalesce(tx, []), ' ')) AS body,
  list_filter(list_distinct({_lower("query")}), lambda w: NOT list_contains({_LIST(D.STOP_WORDS)}, w)) AS cw FROM g),
ev AS (SELECT item_id, query, len(s)::INTEGER AS n, CASE WHEN len(s) > 0 THEN round(list_max(s), 4) ELSE 0 END AS confidence, CASE WHEN len(s) > 0 THEN round(list_avg(s), 4) ELSE 0 END AS mean,
  CASE WHEN len(s) = 0 THEN 0 WHEN len(s) > 1 THEN round(s[1] - s[2], 4) ELSE round(s[1], 4) END AS gap,
  CASE WHEN len(s) = 0 THEN 0 WHEN len(cw) = 0 THEN round(list_max(s), 4) ELSE round(len(list_filter(cw, lambda w: contains(body, w))) / len(cw), 4) END AS coverage FROM n)"""
_AMB = f"""(CASE WHEN len({s_words("query")}) <= 4 THEN 1.0 ELSE 0 END + CASE WHEN list_has_any({_lower("query")}, {_LIST(D.PRONOUNS)}) THEN 0.8 ELSE 0 END + CASE WHEN list_has_any({_lower("query")}, {_LIST(D.VAGUE)}) THEN 0.6 ELSE 0 END
 + CASE WHEN len(list_filter({s_words("query")}, lambda w: length(w) > 2 AND NOT list_contains({_LIST(D.STARTERS)}, lower(w)) AND regexp_matches(w, '^\\p{{Lu}}'))) = 0 THEN 0.4 ELSE 0 END
 + CASE WHEN list_has_any({_lower("query")}, {_LIST(D.COMPARATIVE)}) AND len(list_filter({s_words("query")}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) < 2 THEN 0.7 ELSE 0 END) / 5"""


@query(f"WITH {_HITS}, {_EV} SELECT item_id, n, confidence, mean, gap, coverage FROM ev")
def evidence_scores(spark, d):
    return _hits(spark, d).select("item_id", D.evidence(F.col("query"), F.col("scores"), F.col("texts")).alias("e")).select("item_id", "e.*")


@query(f"SELECT item_id, round({_AMB}, 4) AS ambiguity FROM eval_items")
def ambiguity(spark, d):
    return table(spark, d, "eval_items").select("item_id", D.ambiguity(F.col("query")).alias("ambiguity"))


@query(f"""WITH {_VEC}, f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc QUALIFY r <= 4),
p AS (SELECT a.query_id, list_dot_product(x.e, y.e) AS s FROM f a JOIN f b ON a.query_id = b.query_id AND a.r < b.r JOIN v x ON x.vec_id = a.doc_id JOIN v y ON y.vec_id = b.doc_id)
SELECT query_id, round(greatest(0, 1 - avg(s)), 4) AS conflict FROM p GROUP BY 1""")
def conflict(spark, d):
    """How far a query's first four hits disagree."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return D.conflict(_dense(spark, d, 4).join(e, "doc_id"))


#: 1 - the mean similarity of the pairs of the first four texts.
_CON = f"""fx AS (SELECT item_id, unnest(list_transform(tx[1:4], lambda t, i: {{'t': t, 'i': i}}), recursive := true) FROM g), {s_vectors("fv", "SELECT item_id * 10 + i AS k, t FROM fx")},
fs AS (SELECT p.k AS k, r.k AS k2, sum(p.x * r.x) AS s FROM fv p JOIN fv r ON p.b = r.b AND p.k // 10 = r.k // 10 AND p.k < r.k GROUP BY ALL),
fp AS (SELECT o.item_id, o.i, v.i AS j, coalesce(s, 0) AS s FROM fx o JOIN fx v ON o.item_id = v.item_id AND o.i < v.i LEFT JOIN fs ON k = o.item_id * 10 + o.i AND k2 = v.item_id * 10 + v.i),
cn AS (SELECT item_id, round(greatest(0, 1 - avg(s)), 4) AS con FROM fp GROUP BY 1)"""
_GATE = f"""{_HITS}, {_EV}, {_CON}, a AS (SELECT ev.*, round({_AMB}, 4) AS amb, coalesce(con, 0) AS con FROM ev LEFT JOIN cn USING (item_id)),
l AS (SELECT *, CASE WHEN confidence >= 0.35 AND coverage >= 0.5 THEN 'ANSWERABLE' WHEN amb >= 0.45 THEN 'NEEDS_CLARIFICATION' ELSE 'NOT_ANSWERABLE' END AS label FROM a)"""


def _gated(spark, d):
    """Hits with the signals of the gate; the conflict is that of the hits' texts."""
    h = D.text_conflict(cut(_hits(spark, d)), "item_id", "texts", Providers().embed)
    h = h.withColumns({"ev": D.evidence(F.col("query"), F.col("scores"), F.col("texts")), "amb": D.ambiguity(F.col("query"))})
    return h.withColumn("label", D.rule_label(F.col("ev"), F.col("amb")))


@query(f"WITH {_HITS}, {_CON} SELECT item_id, coalesce(con, 0) AS conflict FROM g LEFT JOIN cn USING (item_id)")
def hit_conflict(spark, d):
    """How far the texts of an item's first four hits disagree."""
    return D.text_conflict(cut(_hits(spark, d)), "item_id", "texts", Providers().embed).select("item_id", F.col("con").alias("conflict"))


@query(f"""WITH {_GATE} SELECT item_id,
 CASE WHEN n = 0 THEN 'ABSTAIN' WHEN label = 'NOT_ANSWERABLE' AND confidence < 0.35 THEN 'ABSTAIN' WHEN con >= 0.7 AND amb >= 0.45 THEN 'ASK' WHEN coverage < 0.3 THEN 'ABSTAIN' WHEN amb >= 0.45 THEN 'ASK' WHEN label = 'NEEDS_CLARIFICATION' THEN 'ASK' WHEN confidence < 0.35 THEN 'ABSTAIN' ELSE 'ANSWER' END AS action,
 CASE WHEN n = 0 THEN 'no_context_retrieved' WHEN label = 'NOT_ANSWERABLE' AND confidence < 0.35 THEN 'low_confidence_not_answerable' WHEN con >= 0.7 AND amb >= 0.45 THEN 'high_conflict_and_ambiguity' WHEN coverage < 0.3 THEN 'low_coverage' WHEN amb >= 0.45 THEN 'ambiguous_query' WHEN label = 'NEEDS_CLARIFICATION' THEN 'llm_needs_clarification' WHEN confidence < 0.35 THEN 'low_confidence' ELSE 'sufficient_evidence' END AS reason FROM l""")
def hard_gate(spark, d):
    return _gated(spark, d).select("item_id", D.gate(F.col("ev"), F.col("amb"), F.col("con"), F.col("label")).alias("g")).select("item_id", "g.*")


@query(f"""WITH {_GATE} SELECT item_id,
 CASE WHEN con > 0.7 THEN 'ASK' WHEN confidence < 0.35 AND coverage < 0.3 THEN 'ABSTAIN' WHEN amb > 0.45 THEN 'ASK' WHEN label = 'NOT_ANSWERABLE' THEN 'ABSTAIN' WHEN label = 'NEEDS_CLARIFICATION' THEN 'ASK' ELSE 'ANSWER' END AS action,
 CASE WHEN con > 0.7 THEN 'context_conflict' WHEN confidence < 0.35 AND coverage < 0.3 THEN 'insufficient_evidence' WHEN amb > 0.45 THEN 'query_ambiguous' WHEN label = 'NOT_ANSWERABLE' THEN 'not_answerable' WHEN label = 'NEEDS_CLARIFICATION' THEN 'needs_clarification' ELSE 'sufficient_evidence' END AS reason FROM l""")
def hard_gate_strict(spark, d):
    return _gated(spark, d).select("item_id", D.gate_strict(F.col("ev"), F.col("amb"), F.col("con"), F.col("label")).alias("g")).select("item_id", "g.*")


@query(f"""
WITH {_HITS}, p AS (SELECT item_id, unnest(list_transform(tx, lambda t, i: {{'t': t, 'i': i}})) AS x, query FROM g), z AS (SELECT item_id, x.i AS rank, list_transform({s_sentences("x.t")}, lambda s, i: {{'s': s, 'i': i, 'o': len(list_intersect(list_distinct({_lower("query")}), list_distinct({_lower("s")})))}}) AS ss FROM p),
b AS (SELECT item_id, rank, ss, list_transform(list_sort(list_transform(ss, lambda a: {{'o': -a.o, 'i': a.i, 's': a.s}}))[1:3], lambda a: a.s) AS top FROM z)
SELECT item_id, rank::INTEGER AS rank, md5(array_to_string(list_transform(list_filter(ss, lambda a: list_contains(top, a.s)), lambda a: a.s), ' ')) AS h FROM b""")
def compress_hits(spark, d):
    """The three most fitting sentences of each hit, in their order."""
    c = _hits(spark, d).select("item_id", F.posexplode(C.compress(F.col("query"), F.col("texts"))).alias("r", "t"))
    return c.select("item_id", (F.col("r") + 1).alias("rank"), F.md5("t").alias("h"))


@query(f"""
WITH {_HITS}, p AS (SELECT item_id, query, unnest(list_transform(tx, lambda t, i: {{'t': t, 'i': i}})) AS x FROM g),
r AS (SELECT item_id, x.i AS i, round(len(list_intersect(list_distinct({_lower("query")}), list_distinct({_lower("x.t")}))) / len(list_distinct({_lower("query")})), 6) AS s FROM p)
SELECT item_id, i::INTEGER AS old_rank, (row_number() OVER (PARTITION BY item_id ORDER BY s DESC, i))::INTEGER AS rank, round(s, 4) AS rerank_score FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, i) <= 3""")
def rerank_top3(spark, d):
    h = _hits(spark, d).select(F.col("item_id").alias("query_id"), "query", F.posexplode("texts").alias("p", "text"))
    hits = h.withColumns({"doc_id": F.col("p") + 1, "rank": F.col("p") + 1})
    return R.rerank(hits, overlap_score(F.col("query"), F.col("text")), 3).select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("old_rank"), "rank", F.round("rerank_score", 4).alias("rerank_score"))


# ---------------------------------------------------------------- metrics

_PRED = f"""
p AS (SELECT ft_id, source_id, {s_action("action")} AS gt, upper(trim(regexp_extract(list_filter(messages, lambda m: m.role = 'assistant')[1].content, '(?s)<decision>(.*?)</decision>', 1))) AS raw, {s_key("source")} AS source, multi_turn, num_triples FROM ft_samples),
e AS (SELECT *, CASE WHEN raw IN ('ANSWER', 'ASK', 'ABSTAIN') THEN raw ELSE 'UNKNOWN' END AS pred FROM p WHERE gt IS NOT NULL)"""


def _predictions(spark, d):
    f = table(spark, d, "ft_samples")
    said = F.get(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(0))["content"]
    return f.select("ft_id", "source_id", X.action_label("action").alias("gt"), P.decision(said).alias("pred"), X.key("source").alias("source"), "multi_turn", "num_triples").filter("gt IS NOT NULL")


@query(f"WITH {_PRED} SELECT ft_id, gt, pred FROM e")
def parsed_decisions(spark, d):
    return _predictions(spark, d).select("ft_id", "gt", "pred")


@query(f"""WITH {_PRED}, a(x) AS (VALUES ('ANSWER'), ('ASK'), ('ABSTAIN')) SELECT g.x AS gt, h.x AS pred, count(e.ft_id) AS n FROM a g CROSS JOIN a h LEFT JOIN e ON e.gt = g.x AND e.pred = h.x GROUP BY ALL""")
def confusion(spark, d):
    return E.confusion(_predictions(spark, d))


@query(f"""WITH {_PRED}, a(label) AS (VALUES ('ANSWER'), ('ASK'), ('ABSTAIN')), c AS (SELECT label, count(*) FILTER (gt = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS p, count(*) FILTER (gt = label) AS n FROM a, e GROUP BY 1),
r AS (SELECT label, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pr, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS re, n FROM c)
SELECT label, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1, n AS support FROM r""")
def class_report(spark, d):
    return E.class_report(_predictions(spark, d))


@query(f"""WITH {_PRED}, a(label) AS (VALUES ('ANSWER'), ('ASK'), ('ABSTAIN')), c AS (SELECT label, 2.0 * count(*) FILTER (gt = label AND pred = label) / nullif(count(*) FILTER (pred = label) + count(*) FILTER (gt = label), 0) AS f, count(*) FILTER (gt = label) AS n FROM a, e GROUP BY 1),
f AS (SELECT sum(coalesce(f, 0)) / 3 AS macro, sum(coalesce(f, 0) * n) / sum(n) AS weighted FROM c)
SELECT count(*) AS n, round(avg((gt = pred)::INT), 4) AS accuracy, round(avg((pred = 'ANSWER' AND gt <> 'ANSWER')::INT), 4) AS over_answer, round(avg((pred = 'ABSTAIN' AND gt = 'ANSWER')::INT), 4) AS under_answer, count(*) FILTER (pred = 'UNKNOWN') AS unknown_preds,
  round(count(*) FILTER (pred = 'ANSWER' AND gt = 'ANSWER') / count(*) FILTER (pred = 'ANSWER'), 4) AS selective_accuracy, round(avg((pred = 'ANSWER')::INT), 4) AS coverage, round(any_value(macro), 4) AS macro_f1, round(any_value(weighted), 4) AS weighted_f1,
  round(coalesce(avg(num_triples) FILTER (gt = pred), 0) - coalesce(avg(num_triples) FILTER (gt <> pred), 0), 4) AS confidence_gap FROM e, f""")
def overall_metrics(spark, d):
    """All of it in one row; the number of triples stands in for a confidence."""
    return E.overall(_predictions(spark, d), confidence="num_triples")


@query(f"WITH {_PRED} SELECT source, multi_turn, count(*) AS n, round(avg((gt = pred)::INT), 4) AS accuracy FROM e GROUP BY ALL")
def accuracy_by_source(spark, d):
    return E.accuracy_by(_predictions(spark, d), "source", "multi_turn")


@query(f"""WITH {S_SAMPLES}, t AS (SELECT id, list_distinct({_lower("query")}) AS x, list_distinct({_lower("response")}) AS y, query, response FROM s)
SELECT id, round(CASE WHEN len(list_intersect(x, y)) > 0 THEN 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) ELSE 0 END, 4) AS f1, (lower(regexp_replace(coalesce(query, ''), '^\\s+|\\s+$', '', 'g')) = lower(regexp_replace(coalesce(response, ''), '^\\s+|\\s+$', '', 'g')))::INTEGER AS em FROM t""")
def text_scores(spark, d):
    q, r = F.col("query"), F.col("response")
    return samples(spark, d).select("id", F.round(E.token_f1(q, r), 4).alias("f1"), E.exact_match(q, r).alias("em"))


@query(f"""WITH {S_SAMPLES}, t AS (SELECT id, {_lower("query")} AS a, {_lower("response")} AS b FROM s),
l AS (SELECT id, len(a) AS n, len(b) AS m, list_reduce(a, lambda row, w: list_prepend(0, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k + 1], row[k] + (b[k] = w)::BIGINT))))),
  list_transform(range(0, len(b) + 1), lambda x: 0::BIGINT))[-1] AS c FROM t WHERE len(a) > 0 AND len(b) > 0)
SELECT id, round(coalesce(2.0 * c / (n + m), 0) + 1e-9, 4) AS rouge_l FROM t LEFT JOIN l USING (id)""")
def rouge_scores(spark, d):
    """F of the longest common subsequence of query and response."""
    return samples(spark, d).select("id", F.round(E.rouge_l(F.col("query"), F.col("response")) + 1e-9, 4).alias("rouge_l"))


@query(f"WITH {S_SAMPLES} SELECT count(*) FILTER (action = 'ASK') AS asks, round(count(*) FILTER (action = 'ASK' AND regexp_matches(response, '\\?\\s*$')) / nullif(count(*) FILTER (action = 'ASK'), 0), 4) AS question_rate FROM s")
def ask_is_question(spark, d):
    return E.question_rate(samples(spark, d), "action", "response")


@query(f"""WITH {_PRED}, b AS (SELECT avg((gt = pred)::INT) AS a, avg((pred = 'ANSWER' AND gt <> 'ANSWER')::INT) AS o, avg((pred = 'ANSWER')::INT) AS c FROM e), k AS (SELECT avg((gt = 'ANSWER')::INT) AS a, avg((gt <> 'ANSWER')::INT) AS o FROM e)
SELECT metric, planner, always_answer, round(always_answer - planner, 4) AS delta_always_answer FROM (SELECT unnest([{{'metric': 'accuracy', 'planner': round(b.a, 4), 'always_answer': round(k.a, 4)}}, {{'metric': 'over_answer', 'planner': round(b.o, 4), 'always_answer': round(k.o, 4)}}, {{'metric': 'coverage', 'planner': round(b.c, 4), 'always_answer': 1.0}}], recursive := true) FROM b, k)""")
def system_comparison(spark, d):
    """The parsed planner beside one that always answers."""
    p = _predictions(spark, d)
    return E.compare({"planner": E.overall(p), "always_answer": E.overall(p.withColumn("pred", F.lit("ANSWER")))}, "planner", ["accuracy", "over_answer", "coverage"])
