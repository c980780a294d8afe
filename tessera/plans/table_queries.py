"""Queries over the sources, joins, profiles and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import parse as P
from ..functions import text as X
from ..operators import dialogue as H
from ..operators import ingest as I
from ..operators import profile as A
from ..operators import sampling as S
from ..sources.tables import merged, resume
from .registry import S_SAMPLES, query, s_action, s_key, s_split, s_strip, s_words, samples, table

ACTIONS = ["ANSWER", "ASK", "ABSTAIN"]
LEVELS = ["easy", "medium", "hard", "very_hard"]

# ---------------------------------------------------------------- ingest


@query("""
WITH v AS (SELECT raw_id, payload::JSON AS j FROM raw_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
r AS (SELECT raw_id, j ->> '$.utterance_id' AS u, j ->> '$.question' AS q, j ->> '$.answer' AS answer, coalesce(j ->> '$.snippet', '') AS snippet,
  regexp_replace(coalesce(j ->> '$.scenario', ''), '^\\s+|\\s+$', '', 'g') AS sc, coalesce(json_array_length(j, '$.evidence'), 0)::INTEGER AS ev, coalesce(json_array_length(j, '$.history'), 0)::INTEGER AS hi
  FROM v WHERE coalesce(json_type(j, '$.evidence'), 'ARRAY') IN ('ARRAY', 'NULL') AND coalesce(json_type(j, '$.history'), 'ARRAY') IN ('ARRAY', 'NULL')),
l AS (SELECT *, CASE WHEN answer IN ('Yes', 'No') THEN 'ANSWER' WHEN answer = 'Follow-on' THEN 'ASK' ELSE 'ABSTAIN' END AS action FROM r),
m AS (SELECT *, CASE action WHEN 'ASK' THEN ev WHEN 'ABSTAIN' THEN 1 ELSE 0 END AS mis FROM l)
SELECT printf('sharc_%06d', row_number() OVER (ORDER BY raw_id) - 1) AS id, u AS utterance_id, q AS query, action, snippet || CASE WHEN sc <> '' THEN chr(10) || chr(10) || 'User Scenario: ' || sc ELSE '' END AS text, mis AS num_missing, hi > 0 AS multi_turn, ev > 1 AS reasoning,
  CASE WHEN mis + ev + hi = 0 THEN 'easy' WHEN mis + ev + hi <= 2 THEN 'medium' WHEN mis + ev + hi <= 4 THEN 'hard' ELSE 'very_hard' END AS difficulty,
  CASE WHEN action = 'ASK' OR mis > 0 THEN 'INSUFFICIENT_VARIABLES' ELSE 'COMPLETE' END AS failure_mode,
  CASE action WHEN 'ANSWER' THEN 'complete' WHEN 'ABSTAIN' THEN 'incomplete' ELSE 'partial' END AS completeness
FROM m""")
def ingest_conditional(spark, d):
    """Raw payloads of the rule-based source as unified samples; payloads that are no JSON object are left out."""
    s = I.conditional(conditional_rows(spark, d), order="raw_id")
    return s.select(
        "id", F.col("metadata.utterance_id").alias("utterance_id"), "query", "action", F.col("context.documents")[0]["text"].alias("text"), F.col("metadata.num_missing_variables").alias("num_missing"),
        F.col("metadata.multi_turn").alias("multi_turn"), F.col("metadata.requires_reasoning").alias("reasoning"), F.col("state.difficulty").alias("difficulty"),
        F.col("state.failure_mode").alias("failure_mode"), F.col("state.completeness").alias("completeness"),
    )


def conditional_rows(spark, d):
    raw = table(spark, d, "raw_records").select("raw_id", F.from_json("payload", schemas.CONDITIONAL).alias("j"), F.try_parse_json("payload").alias("v"))
    return raw.filter(F.schema_of_variant("v").startswith("OBJECT")).select("raw_id", "j.*")


@query("""
SELECT ft_id, CASE WHEN num_missing + num_triples = 0 THEN 'easy' WHEN num_missing + num_triples <= 2 THEN 'medium' WHEN num_missing + num_triples <= 4 THEN 'hard' ELSE 'very_hard' END AS level,
  CASE WHEN action = 'ASK' OR num_missing > 0 THEN 'INSUFFICIENT_VARIABLES' ELSE 'COMPLETE' END AS mode, CASE action WHEN 'ANSWER' THEN 'complete' WHEN 'ABSTAIN' THEN 'incomplete' ELSE 'partial' END AS complete
FROM ft_samples WHERE action IS NOT NULL AND num_missing IS NOT NULL AND num_triples IS NOT NULL""")
def label_rules(spark, d):
    f = table(spark, d, "ft_samples").filter("action IS NOT NULL AND num_missing IS NOT NULL AND num_triples IS NOT NULL")
    return f.select("ft_id", I.difficulty(F.col("num_missing"), F.col("num_triples")).alias("level"), I.failure_mode(F.col("action"), F.col("num_missing")).alias("mode"), I.completeness(F.col("action")).alias("complete"))


@query(f"""
WITH {S_SAMPLES} SELECT id, md5(array_to_string(list_filter(list_transform(docs, lambda t: {s_strip("coalesce(t, '')")}), lambda t: t <> ''), ' ')) AS ctx_hash,
  coalesce(length(query), 0)::BIGINT AS q_chars, len({s_words("query")})::BIGINT AS q_words, len(docs)::BIGINT AS n_docs, replace(substr(query, 1, 60), chr(10), ' ') AS shown FROM s""")
def eda_flat(spark, d):
    """Samples flattened to lengths, a context hash and a shortened query."""
    docs = F.filter(F.transform("docs", lambda t: X.strip(F.coalesce(t, F.lit("")))), lambda t: t != "")
    return samples(spark, d).select(
        "id", P.fingerprint(F.array_join(docs, " ")).alias("ctx_hash"), F.coalesce(F.char_length("query"), F.lit(0)).cast("bigint").alias("q_chars"), X.ws_count("query").cast("bigint").alias("q_words"),
        F.size("docs").cast("bigint").alias("n_docs"), F.replace(F.substring("query", 1, 60), F.lit("\n"), F.lit(" ")).alias("shown"),
    )


# ---------------------------------------------------------------- joins


@query(f"WITH {S_SAMPLES} SELECT id FROM s WHERE id NOT IN (SELECT source_id FROM ft_samples WHERE source_id IS NOT NULL)")
def resume_anti(spark, d):
    """Samples that no fine-tuning sample was made of yet."""
    done = table(spark, d, "ft_samples").select(F.col("source_id").alias("id")).filter(F.col("id").isNotNull())
    return resume(samples(spark, d).select("id"), done, "id")


@query(f"WITH {S_SAMPLES} SELECT id, query FROM s WHERE id IN (SELECT source_id FROM ft_samples)")
def trim_semi(spark, d):
    return samples(spark, d).select("id", "query").join(table(spark, d, "ft_samples").select(F.col("source_id").alias("id")), "id", "left_semi")


@query(f"""
WITH {S_SAMPLES}, p AS (SELECT source_id AS id, min(difficulty) AS difficulty FROM ft_samples WHERE source_id IS NOT NULL GROUP BY 1)
SELECT s.id, coalesce(p.difficulty, s.difficulty) AS difficulty, s.action FROM s LEFT JOIN p USING (id)""")
def merge_left(spark, d):
    """Samples with what a checkpoint knows better."""
    patch = table(spark, d, "ft_samples").filter("source_id IS NOT NULL").groupBy(F.col("source_id").alias("id")).agg(F.min("difficulty").alias("difficulty"))
    return merged(samples(spark, d).select("id", "difficulty", "action"), patch, "id", ["difficulty"])


@query(f"""
WITH k AS (SELECT {s_key("source")} AS k, domain, shape FROM source_catalog)
SELECT k.domain, k.shape, count(*) AS n, count(DISTINCT d.collection) AS collections FROM documents d JOIN k ON k.k = {s_key("d.source")} GROUP BY ALL""")
def catalog_join(spark, d):
    """Documents with their source's catalog entry, joined on the key of the label."""
    cat = table(spark, d, "source_catalog").select(X.key("source").alias("k"), "domain", "shape")
    docs = table(spark, d, "documents").select(X.key("source").alias("k"), "collection")
    return docs.join(cat, "k").groupBy("domain", "shape").agg(F.count("*").alias("n"), F.count_distinct("collection").alias("collections"))


# ---------------------------------------------------------------- profiles


@query(f"""
WITH {S_SAMPLES} SELECT source, action, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM s GROUP BY ALL""")
def action_share(spark, d):
    return A.share(samples(spark, d), "source", "action")


@query(f"""
WITH {S_SAMPLES} SELECT difficulty, count(*) FILTER (action = 'ANSWER') AS "ANSWER", count(*) FILTER (action = 'ASK') AS "ASK", count(*) FILTER (action = 'ABSTAIN') AS "ABSTAIN" FROM s GROUP BY 1""")
def difficulty_crosstab(spark, d):
    return A.crosstab(samples(spark, d), "difficulty", "action", ACTIONS)


@query(f"""
WITH {S_SAMPLES}, t AS (SELECT source, count(*) FILTER (difficulty = 'easy') AS a, count(*) FILTER (difficulty = 'medium') AS b, count(*) FILTER (difficulty = 'hard') AS c, count(*) FILTER (difficulty = 'very_hard') AS e FROM s GROUP BY 1)
SELECT source, CASE WHEN a+b+c+e > 0 THEN round(100.0*a/(a+b+c+e), 2) ELSE 0 END AS easy, CASE WHEN a+b+c+e > 0 THEN round(100.0*b/(a+b+c+e), 2) ELSE 0 END AS medium,
  CASE WHEN a+b+c+e > 0 THEN round(100.0*c/(a+b+c+e), 2) ELSE 0 END AS hard, CASE WHEN a+b+c+e > 0 THEN round(100.0*e/(a+b+c+e), 2) ELSE 0 END AS very_hard FROM t""")
def source_pct(spark, d):
    return A.crosstab_pct(samples(spark, d), "source", "difficulty", LEVELS)


@query(f"""
WITH {S_SAMPLES} SELECT source, multi_turn, reasoning, count(*) AS n, count(DISTINCT failure_mode) AS modes, round(avg(len(missing)), 4) AS mean_missing,
  round(avg((len(missing) > 0)::INT), 4) AS some_missing FROM s GROUP BY ALL""")
def flag_profile(spark, d):
    g = samples(spark, d).groupBy("source", "multi_turn", "reasoning")
    return g.agg(F.count("*").alias("n"), F.count_distinct("failure_mode").alias("modes"), F.round(F.avg(F.size("missing")), 4).alias("mean_missing"), F.round(F.avg((F.size("missing") > 0).cast("int")), 4).alias("some_missing"))


@query(f"""
WITH w AS (SELECT {s_key("source")} AS source, len({s_words("text")})::DOUBLE AS v FROM documents WHERE text IS NOT NULL)
SELECT source, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, round(quantile_cont(v, .25), 4) AS p25, round(quantile_cont(v, .5), 4) AS p50,
  round(quantile_cont(v, .75), 4) AS p75, max(v) AS max FROM w GROUP BY 1""")
def length_summary(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(X.key("source").alias("source"), X.ws_count("text").alias("v"))
    return A.summary(docs, "v", "source")


@query(f"""
WITH w AS (SELECT len({s_words("text")}) AS v FROM documents), b(lo, hi) AS (VALUES (0.0::DOUBLE, 50.0::DOUBLE), (50, 100), (100, 200), (200, 350), (350, 700), (700, 1e9))
SELECT b.lo, b.hi, count(w.v) AS n FROM b LEFT JOIN w ON w.v > b.lo AND w.v <= b.hi GROUP BY ALL""")
def length_histogram(spark, d):
    return A.histogram(table(spark, d, "documents"), X.ws_count("text"), [0.0, 50.0, 100.0, 200.0, 350.0, 700.0, 1e9])


@query(f"""
SELECT {s_key("source")} AS source, doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {s_key("source")} ORDER BY length(text) DESC, doc_id) = 1""")
def longest_document(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(X.key("source").alias("source"), "doc_id", F.char_length("text").alias("n"))
    return A.extreme(docs, ["source"], F.col("n"), F.col("doc_id"), ["doc_id", "n"])


@query(f"""
WITH {S_SAMPLES}, c AS (SELECT source, difficulty, count(*) AS n FROM s WHERE difficulty IS NOT NULL GROUP BY ALL)
SELECT source, difficulty, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, difficulty) = 1""")
def modal_difficulty(spark, d):
    return A.most_frequent(samples(spark, d), ["source"], "difficulty")


@query(f"""
SELECT item, count(*) AS n FROM (SELECT unnest({s_words("lower(text)")}) AS item FROM documents) GROUP BY 1 ORDER BY n DESC, item LIMIT 20""")
def top_terms(spark, d):
    """The report of the 20 most frequent words."""
    return A.top_elements(table(spark, d, "documents"), P.lower_words("text"), 20)


@query("SELECT lang, count(*) AS n, count(DISTINCT md5(text)) AS texts, round(count(DISTINCT md5(text)) / count(text), 4) AS ratio FROM documents GROUP BY 1 HAVING count(text) > 0")
def distinct_texts(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct(P.fingerprint("text")).alias("texts"), F.count("text").alias("_c")).filter("_c > 0")
    return g.select("lang", "n", "texts", F.round(F.col("texts") / F.col("_c"), 4).alias("ratio"))


@query(f"""
WITH {S_SAMPLES}, g AS (SELECT dialogue_id, count(*) AS n FROM s WHERE dialogue_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS groups, min(n) AS min_n, round(avg(n), 4) AS mean_n, median(n) AS median_n, max(n) AS max_n FROM g""")
def dialogue_sizes(spark, d):
    return A.group_sizes(samples(spark, d), "dialogue_id")


@query(f"""
WITH {S_SAMPLES}, g AS (SELECT dialogue_id, count(*) AS size FROM s WHERE dialogue_id IS NOT NULL GROUP BY 1) SELECT size, count(*) AS groups FROM g GROUP BY 1""")
def dialogue_size_histogram(spark, d):
    return A.size_histogram(samples(spark, d), "dialogue_id")


@query(f"""
SELECT {s_key("source")} AS source, count(*) AS n, round(avg(word_count), 4) AS mean_words, sum(num_linked) AS links FROM kb GROUP BY 1""")
def kb_source_stats(spark, d):
    k = table(spark, d, "kb").groupBy(X.key("source").alias("source"))
    return k.agg(F.count("*").alias("n"), F.round(F.avg("word_count"), 4).alias("mean_words"), F.sum("num_linked").alias("links"))


@query(f"""
SELECT {s_key("source")} AS source, count(*) FILTER (a = 'ANSWER') AS "ANSWER", count(*) FILTER (a = 'ASK') AS "ASK", count(*) FILTER (a = 'ABSTAIN') AS "ABSTAIN"
FROM (SELECT source, unnest(linked_actions) AS a FROM kb) GROUP BY 1""")
def kb_actions(spark, d):
    e = table(spark, d, "kb").select(X.key("source").alias("source"), F.explode("linked_actions").alias("a"))
    return A.crosstab(e, "source", "a", ACTIONS)


@query(f"""
SELECT source_id, ft_id, num_triples FROM ft_samples WHERE {s_action("action")} = 'ASK' AND multi_turn AND num_triples > 0 AND {s_split("split")} = 'train'""")
def faceted_pool(spark, d):
    """A pool by facets that may be left open."""
    f = table(spark, d, "ft_samples").withColumns({"action": X.action_label("action"), "split": X.split_label("split")})
    return A.matching(f, action="ASK", multi_turn=True, split="train", difficulty=None).filter("num_triples > 0").select("source_id", "ft_id", "num_triples")


@query("""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS least, max(value) AS most, round(quantile_cont(value, .5), 4) AS mid
FROM events GROUP BY 1""")
def events_profile(spark, d):
    g = table(spark, d, "events").groupBy("event_type")
    return g.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.percentile("value", 0.5), 4).alias("mid"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def lineitem_summary(spark, d):
    li = table(spark, d, "lineitem").filter("l_shipdate <= TIMESTAMP '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return li.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("""
SELECT n.n_name AS nation, r.r_name AS region, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL""")
def orders_by_nation(spark, d):
    """A star join whose dimensions Catalyst broadcasts by their size."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---------------------------------------------------------------- dialogues


@query(f"""
WITH {S_SAMPLES}, m AS (SELECT *, count(*) OVER (PARTITION BY dialogue_id) AS n, row_number() OVER (PARTITION BY dialogue_id ORDER BY coalesce(turn_id, 0), id) AS r FROM s WHERE multi_turn AND dialogue_id IS NOT NULL)
SELECT id, dialogue_id, turn_id FROM m WHERE r <= CASE WHEN n <= 7 THEN n WHEN n <= 15 THEN 10 WHEN n <= 30 THEN 15 WHEN n <= 50 THEN 25 ELSE 35 END""")
def turn_cap(spark, d):
    """The first turns of dialogues; how many depends on their length."""
    multi, _ = H.multi_turn_rows(samples(spark, d))
    return H.capped(multi).select("id", "dialogue_id", "turn_id")


@query(f"""
WITH {S_SAMPLES}, c AS (SELECT dialogue_id, action, count(*) AS k, min(coalesce(turn_id, 0)) AS t FROM s WHERE dialogue_id IS NOT NULL GROUP BY ALL)
SELECT dialogue_id, action AS dominant, sum(k) OVER (PARTITION BY dialogue_id)::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY k DESC, t, action NULLS FIRST) = 1""")
def dominant_action(spark, d):
    return S.rollup(samples(spark, d), "dialogue_id", H.turn_no(), "action")


@query(f"""
WITH {S_SAMPLES}, g AS (SELECT dialogue_id, coalesce(turn_id, 0) AS t, count(*) AS n FROM s WHERE dialogue_id IS NOT NULL GROUP BY ALL),
l AS (SELECT *, t - lag(t) OVER (PARTITION BY dialogue_id ORDER BY t) AS step FROM g)
SELECT dialogue_id, sum(n)::BIGINT AS turns, coalesce(bool_or(step > 1), false) AS broken FROM l GROUP BY 1""")
def gap_check(spark, d):
    return H.gaps(samples(spark, d))


_STATE = f"""
WITH {S_SAMPLES}, b AS (SELECT *, coalesce(turn_id, 0) AS t, CASE WHEN action = 'ASK' AND len(missing) > 0 THEN [missing[1]] ELSE [] END AS first FROM s WHERE dialogue_id IS NOT NULL),
e AS (SELECT a.id, p.known, p.missing, p.first, p.t, p.query, p.action, p.response, a.dialogue_id FROM b a JOIN b p ON a.dialogue_id = p.dialogue_id AND p.t < a.t)
"""


@query(_STATE + """, f AS (SELECT id, list_distinct(flatten(list(list_concat(list_filter(known, lambda v: v <> ''), first)))) AS k, list_distinct(flatten(list(first))) AS r, list_distinct(flatten(list(list_filter(missing, lambda v: v <> '')))) AS m FROM e GROUP BY 1)
SELECT b.id, b.dialogue_id, array_to_string(list_sort(coalesce(k, [])), '|') AS cum_known, array_to_string(list_sort(coalesce(r, [])), '|') AS cum_resolved,
  array_to_string(list_sort(list_filter(coalesce(m, []), lambda x: NOT list_contains(r, x))), '|') AS still_missing FROM b LEFT JOIN f USING (id)""")
def running_state(spark, d):
    s = H.running_state(samples(spark, d).filter("dialogue_id IS NOT NULL"))
    return s.select("id", "dialogue_id", *(F.array_join(c, "|").alias(c) for c in ("cum_known", "cum_resolved", "still_missing")))


@query(_STATE + """, f AS (SELECT id, string_agg('Turn ' || t || ' | ' || coalesce(action, '') || ' | Q: ' || coalesce(substr(query, 1, 80), '') || ' | A: ' || coalesce(substr(response, 1, 120), ''), chr(10) ORDER BY t, query NULLS FIRST, action NULLS FIRST, response NULLS FIRST) AS h FROM e GROUP BY 1)
SELECT b.id, coalesce(f.h, '') AS history FROM b LEFT JOIN f USING (id)""")
def dialogue_history(spark, d):
    s = samples(spark, d).filter("dialogue_id IS NOT NULL").withColumns({"action": F.coalesce("action", F.lit("")), "query": F.coalesce("query", F.lit(""))})
    return H.history(s).select("id", H.history_text(F.col("history")).alias("history"))


@query(_STATE + """, o AS (SELECT id, t, query, action, response, row_number() OVER (PARTITION BY id ORDER BY t DESC, query DESC NULLS LAST, action DESC NULLS LAST, response DESC NULLS LAST) AS r FROM e),
f AS (SELECT id, string_agg('Turn ' || t || ' | ' || coalesce(action, '') || ' | Q: ' || coalesce(substr(query, 1, 80), '') || ' | A: ' || coalesce(substr(response, 1, 120), ''), chr(10) ORDER BY r DESC) AS h FROM o WHERE r <= 3 GROUP BY 1)
SELECT b.id, coalesce(f.h, '') AS history FROM b LEFT JOIN f USING (id)""")
def history_last3(spark, d):
    """The last three earlier turns."""
    s = samples(spark, d).filter("dialogue_id IS NOT NULL").withColumns({"action": F.coalesce("action", F.lit("")), "query": F.coalesce("query", F.lit(""))})
    return H.history(s, last=3).select("id", H.history_text(F.col("history")).alias("history"))


#: Responses that say nothing of their own, as the test tables word them.
DUMMIES = ("Could you provide more details?", "There is too little here to decide.", "The text leaves this open.", "I cannot tell from the material given.")
_DUMMY = ", ".join(f"'{x}'" for x in DUMMIES)


@query(_STATE + f""", w AS (SELECT id, t, query, action, substr(CASE WHEN {s_strip("response")} IN ({_DUMMY}) AND action = 'ASK' AND len(missing) > 0 THEN '[asked for: ' || missing[1] || ']' WHEN {s_strip("response")} IN ({_DUMMY}) AND action = 'ABSTAIN' THEN '[could not answer]' ELSE response END, 1, 120) AS said FROM e),
f AS (SELECT id, string_agg('Turn ' || t || ' | ' || coalesce(action, '') || ' | Q: ' || coalesce(substr(query, 1, 80), '') || ' | A: ' || coalesce(said, ''), chr(10) ORDER BY t, query NULLS FIRST, action NULLS FIRST, said NULLS FIRST) AS h FROM w GROUP BY 1)
SELECT b.id, coalesce(f.h, '') AS history FROM b LEFT JOIN f USING (id)""")
def history_rewritten(spark, d):
    """Earlier turns, with responses that say nothing replaced by what their action meant."""
    s = samples(spark, d).filter("dialogue_id IS NOT NULL").withColumns({"action": F.coalesce("action", F.lit("")), "query": F.coalesce("query", F.lit(""))})
    return H.history(s, dummies=DUMMIES).select("id", H.history_text(F.col("history")).alias("history"))


# ---------------------------------------------------------------- samples and splits

_ORDER = "md5('42|' || id)"


@query(f"WITH {S_SAMPLES} SELECT id, source, action FROM s QUALIFY row_number() OVER (PARTITION BY source, action ORDER BY {_ORDER}, id) <= 30")
def stratified_sample(spark, d):
    return S.stratified(samples(spark, d), ["source", "action"], "id", 30).select("id", "source", "action")


@query(f"""
WITH {S_SAMPLES}, r AS (SELECT id, action, row_number() OVER (PARTITION BY action ORDER BY {_ORDER}, id) AS r FROM s WHERE action IS NOT NULL)
SELECT id, action FROM r ORDER BY (r > 200)::INT, {_ORDER}, id LIMIT 600""")
def equal_shares(spark, d):
    """600 samples, a third of each action as far as it goes."""
    return S.equal_shares(samples(spark, d).filter("action IS NOT NULL").select("id", "action"), "action", "id", 600, 3)


_SPLIT = """
g AS (SELECT id, CASE WHEN dialogue_id IS NULL THEN 's:' || id ELSE 'g:' || dialogue_id END AS k, dialogue_id FROM s),
x AS (SELECT *, ('0x' || substr(md5('42|' || k), 1, 8))::BIGINT % 100 AS b FROM g),
z AS (SELECT id, dialogue_id, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split FROM x)
"""


@query(f"WITH {S_SAMPLES}, {_SPLIT} SELECT id, split FROM z")
def group_split(spark, d):
    return samples(spark, d).select("id", S.hash_split(S.group_key(F.col("dialogue_id"), F.col("id"))).alias("split"))


@query(f"WITH {S_SAMPLES} SELECT dialogue_id, count(DISTINCT split) AS splits FROM s WHERE dialogue_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leak_check(spark, d):
    """Dialogues that lie in several of the splits as delivered."""
    return S.leaks(samples(spark, d), "dialogue_id", "split")


@query(f"WITH {S_SAMPLES}, {_SPLIT} SELECT dialogue_id, count(DISTINCT split) AS splits FROM z WHERE dialogue_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def group_split_leaks(spark, d):
    """The same of our own split: no rows."""
    s = samples(spark, d).withColumn("split", S.hash_split(S.group_key(F.col("dialogue_id"), F.col("id"))))
    return S.leaks(s, "dialogue_id", "split")


_ROLL = f"""
{S_SAMPLES}, c AS (SELECT dialogue_id, action, count(*) AS k, min(coalesce(turn_id, 0)) AS t FROM s WHERE dialogue_id IS NOT NULL GROUP BY ALL),
g AS (SELECT dialogue_id, action AS dominant, (sum(k) OVER (PARTITION BY dialogue_id))::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY k DESC, t, action NULLS FIRST) = 1)
"""


@query(f"""
WITH RECURSIVE {_ROLL}, t(a, want) AS (VALUES ('ANSWER', 90), ('ASK', 114), ('ABSTAIN', 96)),
o AS (SELECT dialogue_id, dominant, n, want, row_number() OVER (PARTITION BY dominant ORDER BY md5('42|' || dialogue_id), dialogue_id) AS r FROM g JOIN t ON a = dominant),
f AS (SELECT dominant, 0::BIGINT AS r, 0::BIGINT AS total, NULL::VARCHAR AS dialogue_id, false AS ok, 0::BIGINT AS n FROM o GROUP BY 1
  UNION ALL SELECT f.dominant, o.r, CASE WHEN f.total + o.n <= o.want THEN f.total + o.n ELSE f.total END, o.dialogue_id, f.total + o.n <= o.want, o.n FROM f JOIN o ON o.dominant = f.dominant AND o.r = f.r + 1)
SELECT dialogue_id, dominant, n FROM f WHERE ok""")
def greedy_subsample(spark, d):
    """Whole dialogues per dominant action in shuffled order, skipping those that overflow the action's target."""
    return S.greedy_groups(S.rollup(samples(spark, d), "dialogue_id", H.turn_no(), "action"), "dialogue_id", {"ANSWER": 90, "ASK": 114, "ABSTAIN": 96})


@query(f"""
WITH {_ROLL} SELECT dialogue_id, dominant, n, total FROM (SELECT *, (sum(n) OVER (ORDER BY dialogue_id))::BIGINT AS total FROM g) WHERE total <= 500""")
def prefix_trim(spark, d):
    """Whole dialogues up to a total of 500 rows, stopping at the first that overflows."""
    return S.whole_prefix(S.rollup(samples(spark, d), "dialogue_id", H.turn_no(), "action"), "dialogue_id", ["dialogue_id"], 500)


@query(f"WITH {S_SAMPLES} SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 AS batch_no FROM s")
def fixed_batches(spark, d):
    return S.batches(samples(spark, d).select("id"), ["id"], 50)
