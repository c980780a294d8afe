"""Queries over the raw sources' builders, reply parsers, reports, trimming, reflection and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import runtime
from ..functions import parse as P
from ..functions import text as X
from ..operators import chunk as C
from ..operators import dialogue as H
from ..operators import ftset as B
from ..operators import gate as D
from ..operators import ingest as I
from ..operators import metrics as E
from ..operators import sampling as S
from ..operators.providers import Providers
from ..sources import tables as T
from . import graph_queries, table_queries, text_queries  # noqa: F401  their queries and SQL are used below
from .table_queries import conditional_rows
from .registry import QUERIES, S_SAMPLES, SQL, query, s_action, s_key, s_sentences, s_strip, s_vectors, s_words, samples, table

# ---------------------------------------------------------------- builders of the raw sources

R = I.Replies()
_HARD = lambda n: f"CASE WHEN {n} = 0 THEN 'easy' WHEN {n} <= 2 THEN 'medium' WHEN {n} <= 4 THEN 'hard' ELSE 'very_hard' END"


@query(f"""WITH {S_SAMPLES}, f AS (SELECT *, CASE WHEN action = 'ASK' THEN 'y' WHEN turn_id % 2 = 0 THEN 'm' END AS fu, CASE WHEN action <> 'ABSTAIN' THEN response END AS said FROM s),
l AS (SELECT *, coalesce(fu, 'n') AS flag, coalesce(said, 'CANNOTANSWER') AS ans FROM f), a AS (SELECT *, CASE WHEN ans = 'CANNOTANSWER' THEN 'ABSTAIN' WHEN flag = 'y' THEN 'ASK' ELSE 'ANSWER' END AS act FROM l)
SELECT query, docs[1] AS text, act AS action, CASE act WHEN 'ABSTAIN' THEN '{R.cannot}' WHEN 'ASK' THEN '{R.more}' ELSE ans END AS response, coalesce(dialogue_id, md5(coalesce(docs[1], ''))) AS dialogue_id, flag AS followup,
  CASE WHEN act = 'ANSWER' THEN 'easy' ELSE 'medium' END AS difficulty, CASE WHEN act = 'ANSWER' THEN 'COMPLETE' ELSE 'INSUFFICIENT_VARIABLES' END AS mode FROM a""".replace("docs[1] AS text", "coalesce(docs[1], '') AS text"))
def ingest_dialogues(spark, d):
    """Every sample told as an article of the nested source, and built again from it."""
    u = _dialogues(spark, d)
    return u.select("query", F.col("context.documents")[0]["text"].alias("text"), "action", "response", "metadata.dialogue_id", F.col("metadata.followup_flag").alias("followup"),
                    F.col("state.difficulty").alias("difficulty"), F.col("state.failure_mode").alias("mode"))


def _dialogues(spark, d):
    answer = F.when(F.col("action") != "ABSTAIN", F.col("response"))
    answers = F.when(answer.isNotNull(), F.array(F.struct(answer.alias("text")))).otherwise(F.array().cast("array<struct<text:string>>"))
    qa = F.struct(F.col("query").alias("question"), F.when(F.col("action") == "ASK", "y").when(F.col("turn_id") % 2 == 0, "m").alias("followup"), F.lit("x").alias("yesno"), answers.alias("answers"))
    para = F.struct(F.col("dialogue_id").alias("id"), F.get("docs", F.lit(0)).alias("context"), F.array(qa).alias("qas"))
    return I.dialogues(samples(spark, d).select(F.array(F.struct(F.array(para).alias("paragraphs"))).alias("data")))


@query(f"""WITH {S_SAMPLES}, t AS (SELECT id, query, response, difficulty, list_transform(docs, lambda t, i: 'T' || (i % 3)) AS titles, list_transform(docs, lambda t, i: i % 2) AS ids, list_transform(docs, lambda t: {s_sentences("t")}) AS sents FROM s),
f AS (SELECT *, list_transform(titles, lambda t, i: sents[list_max(list_transform(titles, lambda u, j: CASE WHEN u = t THEN j END))][ids[i] + 1]) AS facts FROM t)
SELECT query, coalesce(response, '') AS response, md5(array_to_string(list_filter(facts, lambda x: x IS NOT NULL), '|')) AS facts, CASE WHEN difficulty IN ('easy', 'medium', 'hard') THEN difficulty ELSE 'medium' END AS difficulty, len(titles)::INTEGER AS n_facts FROM f WHERE titles IS NOT NULL""")
def ingest_multihop(spark, d):
    """Every sample told as a question over titled paragraphs, some titles twice and some sentence numbers beyond the end."""
    u = _multihop(spark, d)
    return u.select("query", F.coalesce("response", F.lit("")).alias("response"), F.md5(F.array_join(F.transform("context.documents", lambda x: x["text"]), "|")).alias("facts"), F.col("state.difficulty").alias("difficulty"),
                    F.col("metadata.num_supporting_facts").alias("n_facts"))


def _multihop(spark, d):
    s = samples(spark, d).filter(F.col("docs").isNotNull())
    titles, ids = F.transform("docs", lambda t, i: F.concat(F.lit("T"), ((i + 1) % 3).cast("string"))), F.transform("docs", lambda t, i: ((i + 1) % 2).cast("int"))
    raw = s.select(F.col("query").alias("question"), F.col("response").alias("answer"), F.lit("bridge").alias("type"), F.col("difficulty").alias("level"), F.struct(titles.alias("title"), ids.alias("sent_id")).alias("supporting_facts"),
                   F.struct(titles.alias("title"), F.transform("docs", lambda t: P.sentences(t)).alias("sentences")).alias("context"))
    return I.multi_hop(raw)


@query(f"""WITH k AS (SELECT kb_id, text, coalesce(num_linked, 0) AS n FROM kb WHERE text IS NOT NULL), a AS (SELECT kb_id, text, unnest([{{'l': 'l1', 'c': ['Entailment', 'Contradiction', 'NotMentioned'][n % 3 + 1], 's': [0, 1, 7]}}, {{'l': 'l2', 'c': 'NotMentioned', 's': []}}]) AS z FROM k),
p AS (SELECT kb_id, text, z.l AS l, z.c AS c, z.s AS s, CASE WHEN z.c = 'NotMentioned' THEN 'ABSTAIN' ELSE 'ANSWER' END AS action FROM a), m AS (SELECT *, CASE WHEN action = 'ANSWER' THEN 0 ELSE 1 END + len(s) AS score FROM p)
SELECT kb_id, l AS label_id, 'h ' || l AS query, action, CASE c WHEN 'Entailment' THEN replace('{R.holds}', '{{0}}', 's ' || l) WHEN 'Contradiction' THEN replace('{R.against}', '{{0}}', 's ' || l) ELSE replace('{R.silent}', '{{0}}', 's ' || l) END AS response,
  array_to_string(list_transform(list_filter(s, lambda i: i < 2), lambda i: {s_strip("substr(text, [1, 9][i + 1], [12, 32][i + 1])")}), '|') AS spans, {_HARD("score")} AS difficulty, len(s)::INTEGER AS num_spans, len(s) > 1 AS reasoning FROM m""")
def ingest_contracts(spark, d):
    """Every knowledge-base text told as an annotated contract; one span number is beyond the end."""
    doc1 = F.col("context.documents")[0]
    return _contracts(spark, d).select(doc1["doc_id"].alias("kb_id"), "metadata.label_id", "query", "action", "response", F.array_join(doc1["spans"], "|").alias("spans"), F.col("state.difficulty").alias("difficulty"), "metadata.num_spans",
                                       F.col("metadata.requires_reasoning").alias("reasoning"))


def _contracts(spark, d):
    ann = "struct<choice:string,spans:array<int>>"
    choice = F.element_at(F.array(F.lit("Entailment"), F.lit("Contradiction"), F.lit("NotMentioned")), (F.coalesce("num_linked", F.lit(0)) % 3 + 1).cast("int"))
    notes = F.create_map(F.lit("l1"), F.struct(choice, F.array(*map(F.lit, (0, 1, 7)))).cast(ann), F.lit("l2"), F.struct(F.lit("NotMentioned"), F.array().cast("array<int>")).cast(ann))
    label = lambda n: F.struct(F.lit(f"h {n}").alias("hypothesis"), F.lit(f"s {n}").alias("short_description"))
    doc = F.struct(F.col("kb_id").alias("id"), F.col("kb_id").alias("file_name"), "text", F.expr("array(array(0, 12), array(8, 40))").alias("spans"), F.array(F.struct(notes.alias("annotations"))).alias("annotation_sets"))
    raw = table(spark, d, "kb").filter("text IS NOT NULL").select(F.create_map(F.lit("l1"), label("l1"), F.lit("l2"), label("l2")).alias("labels"), F.array(doc).alias("documents"))
    return I.contracts(raw)


@query(f"""WITH {S_SAMPLES}, r AS (SELECT id, dialogue_id, [x.url FOR x IN u.documents] AS urls, [x.doc_id FOR x IN u.documents] AS ids, [x.file_name FOR x IN u.documents] AS files, source, utt FROM s JOIN
 (SELECT id, context AS u, metadata.utterance_id AS utt FROM unified_samples WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1) USING (id))
SELECT id, CASE WHEN source = 'quac' THEN coalesce(dialogue_id, '') END AS dialogue_id, CASE WHEN source = 'sharc' THEN coalesce(urls[1], '') END AS url, CASE WHEN source = 'contractnli' THEN coalesce(ids[1], '') END AS doc_id,
  CASE WHEN source = 'contractnli' THEN coalesce(files[1], '') END AS file_name, CASE WHEN source = 'hotpotqa' THEN array_to_string([coalesce(x, '') FOR x IN ids], '|') END AS titles,
  CASE source WHEN 'quac' THEN coalesce(dialogue_id, 'unknown') WHEN 'sharc' THEN coalesce(utt, id) WHEN 'hotpotqa' THEN id WHEN 'contractnli' THEN coalesce(ids[1], 'unknown') ELSE 'unknown' END AS ctx_key FROM r""")
def source_meta(spark, d):
    """What each sample's context tells of its origin, and what it shares it under, by source."""
    cols = {"source": X.key("metadata.source"), "dialogue_id": F.col("metadata.dialogue_id"), "utterance_id": F.col("metadata.utterance_id"), "docs": F.col("context.documents")}
    u = table(spark, d, "unified_samples").filter(F.col("id").isNotNull()).select("id", F.struct("ingested_at", *(c.alias(n) for n, c in cols.items())).alias("r"))
    u = u.groupBy("id").agg(F.max_by("r", "r.ingested_at").alias("r")).select("id", *(F.col(f"r.{n}").alias(n) for n in cols))
    m = C.source_meta(F.col("source"), F.col("dialogue_id"), F.col("docs"), F.lit(0), F.lit(1))
    ctx = C.context_key(F.col("source"), F.col("id"), F.col("dialogue_id"), F.col("utterance_id"), F.col("docs"))
    return u.select("id", m.alias("m"), ctx.alias("ctx_key")).select("id", "m.dialogue_id", "m.url", "m.doc_id", "m.file_name", F.array_join("m.supporting_titles", "|").alias("titles"), "ctx_key")


@query(" UNION ALL ".join(f"SELECT '{n}' AS source, action, count(*) AS n FROM ({SQL[q]}) GROUP BY action" for n, q in (("quac", "ingest_dialogues"), ("sharc", "ingest_conditional"), ("hotpotqa", "ingest_multihop"), ("contract_nli", "ingest_contracts"))).replace(
    f"SELECT 'hotpotqa' AS source, action, count(*) AS n FROM ({SQL['ingest_multihop']}) GROUP BY action", f"SELECT 'hotpotqa', 'ANSWER', count(*) FROM ({SQL['ingest_multihop']})"))
def merged_sources(spark, d):
    """Samples of all four builders together, by source and action."""
    parts = (_dialogues(spark, d), I.conditional(conditional_rows(spark, d), order="raw_id"), _multihop(spark, d), _contracts(spark, d))
    return I.merge(*parts).groupBy("metadata.source", "action").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- reports


@query(f"WITH {S_SAMPLES}, g AS (SELECT dialogue_id, max(turn_id) AS depth FROM s WHERE multi_turn AND dialogue_id IS NOT NULL GROUP BY 1) SELECT depth, count(*) AS dialogues FROM g WHERE depth IS NOT NULL GROUP BY 1")
def turn_depths(spark, d):
    """How many dialogues reach each turn number."""
    multi, _ = H.multi_turn_rows(samples(spark, d))
    return multi.groupBy("dialogue_id").agg(F.max("turn_id").alias("depth")).filter("depth IS NOT NULL").groupBy("depth").agg(F.count("*").alias("dialogues"))


@query(f"WITH {S_SAMPLES} SELECT action, count(*) AS n, round(avg(len(known)), 4) AS mean_known, round(avg(len(missing)), 4) AS mean_missing FROM s GROUP BY 1")
def mean_values(spark, d):
    return samples(spark, d).groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg(F.size("known")), 4).alias("mean_known"), F.round(F.avg(F.size("missing")), 4).alias("mean_missing"))


_PAIRS = (("difficulty", "action"), ("failure_mode", "action"), ("source", "multi_turn"), ("source", "reasoning"), ("reasoning", "action"), ("completeness", "action"), ("source", "action"))


@query(f"WITH {S_SAMPLES} " + " UNION ALL ".join(f"SELECT '{a} x {b}' AS pair, {a}::VARCHAR AS row, {b}::VARCHAR AS col, count(*) AS n FROM s GROUP BY ALL" for a, b in _PAIRS))
def crosstabs(spark, d):
    """All seven crosstabs as rows; the table is read once, and rows are counted by all their labels before they are told apart."""
    cells = samples(spark, d).groupBy(*sorted({c for p in _PAIRS for c in p})).agg(F.count("*").alias("k"))
    each = F.array(*(F.struct(F.lit(f"{a} x {b}").alias("pair"), F.col(a).cast("string").alias("row"), F.col(b).cast("string").alias("col")) for a, b in _PAIRS))
    return cells.select("k", F.inline(each)).groupBy("pair", "row", "col").agg(F.sum("k").alias("n"))


@query(SQL["hard_gate"].replace("WITH ", "WITH gated AS (WITH ", 1) + ") SELECT reason, action, count(*) AS n FROM gated GROUP BY ALL ORDER BY n DESC, reason LIMIT 10")
def gate_reasons(spark, d):
    """The ten most frequent reasons of the gate."""
    return QUERIES["hard_gate"](spark, d).groupBy("reason", "action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@query(SQL["ft_validity"].replace("WITH ", "WITH checked AS (WITH ", 1) + ") SELECT reason, count(*) AS n FROM checked GROUP BY 1")
def skip_reasons(spark, d):
    return QUERIES["ft_validity"](spark, d).groupBy("reason").agg(F.count("*").alias("n"))


_ANCHORS = "SELECT unnest([" + ", ".join(f"'{a}'" for a in B.GENERIC_ANCHORS) + "]) AS t"


@query(f"""WITH {S_SAMPLES}, vs AS (SELECT DISTINCT v FROM (SELECT unnest(list_concat(known, missing)) AS v FROM s) WHERE v IS NOT NULL), {s_vectors("xv", "SELECT v AS k, v AS t FROM vs")}, {s_vectors("av", f"SELECT t AS k, t FROM ({_ANCHORS})")},
sm AS (SELECT xv.k AS v, av.k AS a, sum(xv.x * av.x) AS sim FROM xv JOIN av ON xv.b = av.b GROUP BY ALL), mx AS (SELECT v, max(sim) AS best FROM sm GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (length({s_strip("v")}) >= 4 AND coalesce(best, 0) < 0.45) AS specific, round(avg((length({s_strip("v")}) >= 4 AND coalesce(best, 0) < 0.45)::INT), 4) AS ratio FROM vs LEFT JOIN mx USING (v)""")
def specific_ratio(spark, d):
    """The share of distinct variables that are specific: long enough, and unlike the generic texts."""
    v = samples(spark, d).select(F.explode(F.concat("known", "missing")).alias("v"))
    return B.specificity(v, "v", Providers().embed).agg(F.count("*").alias("n"), F.count_if("specific").alias("specific"), F.round(F.avg(F.col("specific").cast("int")), 4).alias("ratio"))


@query(f"""WITH {S_SAMPLES}, m AS (SELECT *, count(*) OVER (PARTITION BY dialogue_id) AS n, row_number() OVER (PARTITION BY dialogue_id ORDER BY coalesce(turn_id, 0), id) AS r FROM s WHERE multi_turn AND dialogue_id IS NOT NULL),
a AS (SELECT dialogue_id, count(*) AS kept FROM m WHERE r <= CASE WHEN n <= 3 THEN n WHEN n <= 5 THEN 3 ELSE 4 END GROUP BY 1), b AS (SELECT dialogue_id, count(*) AS had FROM s WHERE dialogue_id IS NOT NULL GROUP BY 1)
SELECT dialogue_id, had, kept FROM a JOIN b USING (dialogue_id) WHERE kept < had""")
def trim_diff(spark, d):
    """Dialogues that lost turns to caps of three and four, with their sizes before and after."""
    s = runtime.cut(samples(spark, d).select("id", "dialogue_id", "turn_id", "multi_turn"))
    multi, _ = H.multi_turn_rows(s)
    after = H.capped(multi, cap=lambda n: H.turn_cap(n, ((5, 3),), 3, 4)).groupBy("dialogue_id").agg(F.count("*").alias("kept"))
    before = s.filter(F.col("dialogue_id").isNotNull()).groupBy("dialogue_id").agg(F.count("*").alias("had"))
    return before.join(after, "dialogue_id").filter("kept < had")


@query(f"WITH {S_SAMPLES} SELECT id, row_number() OVER (ORDER BY coalesce(source, ''), coalesce(dialogue_id, id), coalesce(turn_id, 0), id) - 1 AS place FROM s")
def corpus_order(spark, d):
    """Each sample's place when all are sorted by source, dialogue (or id) and turn."""
    s = samples(spark, d).select("id", F.coalesce("source", F.lit("")).alias("a"), F.coalesce("dialogue_id", "id").alias("b"), F.coalesce("turn_id", F.lit(0)).alias("c"))
    return runtime.numbered_rows(s, ["a", "b", "c", "id"], "place").select("id", "place")


@query(f"WITH {S_SAMPLES} SELECT id, md5('Query: ' || coalesce(query, '') || chr(10) || substr(array_to_string(list_transform(docs, lambda t: coalesce(t, '')), ' '), 1, 600)) AS prompt FROM s WHERE docs IS NOT NULL")
def extraction_prompts(spark, d):
    """Prompts of the variable extraction: the query and the first 600 characters of its context."""
    ctx = F.substring(F.array_join(F.transform("docs", lambda t: F.coalesce(t, F.lit(""))), " "), 1, 600)
    return samples(spark, d).filter(F.col("docs").isNotNull()).select("id", F.md5(F.concat(F.lit("Query: "), F.coalesce("query", F.lit("")), F.lit("\n"), ctx)).alias("prompt"))


# ---------------------------------------------------------------- trimming

TRIM = S.Trim({"contractnli": 100, "hotpotqa": 200}, ("sharc", 250), ("quac", 300), {"ANSWER": 300, "ASK": 250, "ABSTAIN": 200})
_TRIM_SQL = f"""WITH RECURSIVE {S_SAMPLES}, t AS (SELECT *, coalesce(multi_turn, false) AND dialogue_id IS NOT NULL AS m, md5('42|' || id) AS h FROM s),
p1 AS (SELECT id, source, action FROM t WHERE NOT m AND source IN ('contractnli', 'hotpotqa', 'sharc') QUALIFY row_number() OVER (PARTITION BY source ORDER BY h, id) <= CASE source WHEN 'contractnli' THEN 100 WHEN 'hotpotqa' THEN 200 ELSE 250 END),
ac AS (SELECT dialogue_id, action, count(*) AS k, min(coalesce(turn_id, 0)) AS t FROM t WHERE m GROUP BY ALL), dm AS (SELECT dialogue_id, action AS dominant FROM ac QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY k DESC, t, action NULLS FIRST) = 1),
dg AS (SELECT dialogue_id, min(source) AS source, count(*) AS n, count(*) FILTER (action = 'ANSWER') AS na, count(*) FILTER (action = 'ASK') AS nk, count(*) FILTER (action = 'ABSTAIN') AS ns, md5('42|' || dialogue_id) AS h FROM t WHERE m GROUP BY dialogue_id),
d2 AS (SELECT dialogue_id FROM (SELECT dialogue_id, sum(n) OVER (ORDER BY h, dialogue_id) - n AS before FROM dg WHERE source = 'sharc') WHERE before < 250 - (SELECT count(*) FROM p1 WHERE source = 'sharc')),
p2 AS (SELECT id, source, action FROM t WHERE m AND dialogue_id IN (SELECT dialogue_id FROM d2)),
us AS (SELECT count(*) FILTER (action = 'ANSWER') AS ua, count(*) FILTER (action = 'ASK') AS uk, count(*) FILTER (action = 'ABSTAIN') AS us FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)),
o AS (SELECT dialogue_id, dominant, n, na, nk, ns, row_number() OVER (ORDER BY h, dialogue_id) AS r FROM dg JOIN dm USING (dialogue_id) WHERE source = 'quac'),
f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS added, greatest(0, 300 - ua)::BIGINT AS a, greatest(0, 250 - uk)::BIGINT AS k, greatest(0, 200 - us)::BIGINT AS s, NULL::VARCHAR AS dialogue_id, false AS ok FROM us
  UNION ALL SELECT r, CASE WHEN ok THEN added + n ELSE added END, CASE WHEN ok THEN greatest(0, a - na) ELSE a END, CASE WHEN ok THEN greatest(0, k - nk) ELSE k END, CASE WHEN ok THEN greatest(0, s - ns) ELSE s END, dialogue_id, ok FROM
    (SELECT o.*, f.added, f.a, f.k, f.s, a + k + s > 0 AND added < 300 AND coalesce(CASE dominant WHEN 'ANSWER' THEN a WHEN 'ASK' THEN k WHEN 'ABSTAIN' THEN s END, 0) > 0 AS ok FROM f JOIN o ON o.r = f.r + 1))
SELECT id, 'single' AS part FROM p1 UNION ALL SELECT id, 'mixed' FROM p2 UNION ALL SELECT id, 'filler' FROM t WHERE m AND dialogue_id IN (SELECT dialogue_id FROM f WHERE ok)"""


@query(_TRIM_SQL)
def budgeted_trim(spark, d):
    """Whole dialogues and single rows by the sources' numbers and the actions' budgets."""
    return S.budgeted_trim(samples(spark, d), TRIM)


# ---------------------------------------------------------------- replies, agents, reflection

_FENCE = "```"


@query(rf"""WITH f AS (SELECT ft_id, {s_action("action")} AS act, coalesce(action, 'none') AS action, coalesce(num_known, 0) AS k, coalesce(num_missing, 0) AS m, source FROM ft_samples)
SELECT ft_id, CASE WHEN contains(upper(action), 'ANSWER') THEN 'ANSWER' WHEN contains(upper(action), 'ASK') THEN 'ASK' ELSE 'ABSTAIN' END AS reply_action, 'second ' || ft_id AS response,
  CASE k % 3 WHEN 0 THEN 'ANSWERABLE' WHEN 1 THEN 'NEEDS_CLARIFICATION' ELSE 'NOT_ANSWERABLE' END AS label, 'one part|two parts' AS listed, array_to_string([x FOR x IN ['a', 'b', 'c', 'd', 'e', 'f', 'g'][1:least(k, 5)]], '|') AS known,
  CASE WHEN act = 'ANSWER' THEN '' ELSE array_to_string(['m' || i FOR i IN range(1, least(m, 8) + 1)], '|') END AS missing, trim(regexp_replace(regexp_replace(lower({s_strip("source")}), '\s+', ' ', 'g'), '[^a-z0-9 \-]', '', 'g')) AS name FROM f""")
def parsed_replies(spark, d):
    """Replies written from each sample's labels in every form the parsers know, and parsed back."""
    n = lambda c: F.coalesce(c, F.lit(0))
    f = table(spark, d, "ft_samples").withColumn("act", X.action_label("action"))
    keyed = F.concat(F.lit("RESPONSE: first\nACTION: none\n ACTION: "), F.coalesce("action", F.lit("none")), F.lit("\nRESPONSE: second "), "ft_id")
    label = F.concat(F.lit("label\n"), F.when(n("num_known") % 3 == 0, "It is ANSWERABLE").when(n("num_known") % 3 == 1, "NEEDS_CLARIFICATION").otherwise("NOT_ANSWERABLE"))
    quoted = lambda a: F.to_json(a)
    known = F.slice(F.array(*map(F.lit, "abcdefg")), 1, n("num_known"))
    gaps = F.when(n("num_missing") > 0, F.transform(F.sequence(F.lit(1), F.greatest(n("num_missing"), F.lit(1))), lambda i: F.concat(F.lit("m"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    reply = F.concat(F.lit(f"{_FENCE}json\n" + '{"known_variables": '), quoted(known), F.lit(', "missing_variables": '), quoted(gaps), F.lit("}\n" + _FENCE))
    v = P.variables_reply(reply, F.coalesce("act", F.lit("")))
    return f.select(
        "ft_id", P.reply_action(keyed).alias("reply_action"), P.key_line(keyed, "RESPONSE").alias("response"), P.answerability(label).alias("label"), F.array_join(P.numbered_list(F.lit("Parts:\n1. one part\n 2) x. two parts\nno")), "|").alias("listed"),
        F.array_join(v["known"], "|").alias("known"), F.array_join(v["missing"], "|").alias("missing"), P.bare_name("source").alias("name"),
    )


@query(f"""WITH {S_SAMPLES}, x AS (SELECT id, query, list_filter(coalesce(known, []), lambda v: v IS NOT NULL) AS k, list_filter(coalesce(missing, []), lambda v: v IS NOT NULL) AS m, len({s_words("query")}) AS w FROM s)
SELECT id, CASE WHEN w < 5 AND len(k) = 0 THEN 'too_vague' WHEN w % 2 = 0 AND len(k) = 0 THEN 'graph_not_connected' WHEN len(m) > 0 THEN 'missing_information' ELSE 'not_covered' END AS why, round(CASE WHEN len(k) + len(m) = 0 THEN 0 ELSE len(m) / (len(k) + len(m)) END, 4) AS incompleteness,
  CASE WHEN w % 2 = 0 THEN 'town' ELSE k[1] END AS anchor FROM x""")
def agent_rules(spark, d):
    """Why nothing can be said, how incomplete the state is, and what to ask about, where queries of even length see a graph line."""
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: v.isNotNull())
    s = samples(spark, d).withColumns({"k": clean("known"), "m": clean("missing")})
    lines = F.when(X.ws_count("query") % 2 == 0, F.array(F.lit("?unknown_1 | requires | x"), F.lit("town | lies in | land"))).otherwise(F.array().cast("array<string>"))
    return s.select("id", D.abstain_reason(F.col("query"), lines, F.col("k"), F.col("m")).alias("why"), F.round(D.incompleteness(F.col("k"), F.col("m")), 4).alias("incompleteness"), D.anchor(lines, F.col("k")).alias("anchor"))


_FIRST = SQL["hard_gate"].replace("WITH ", "WITH g0 AS (WITH ", 1) + "), g1 AS (" + SQL["hard_gate_strict"] + "), r AS (SELECT item_id, g0.action AS a0, g1.action AS a1 FROM g0 JOIN g1 USING (item_id))"


@query(_FIRST + " SELECT item_id, a1 AS action, CASE WHEN a0 <> a1 THEN 'verified ' || item_id ELSE 'first ' || item_id END AS response, a0 <> a1 AS changed FROM r")
def reflection(spark, d):
    """The gate's decision after a second look, which the strict gate stands in for."""
    first, second = (QUERIES[n](spark, d).select("item_id", F.col("action").alias(a)) for n, a in (("hard_gate", "a0"), ("hard_gate_strict", "a1")))
    reply = F.concat(F.lit("VERIFIED_ACTION: "), "a1", F.lit("\nVERIFIED_RESPONSE: verified "), "item_id")
    return first.join(second, "item_id").select("item_id", D.reflected(F.col("a0"), F.concat(F.lit("first "), "item_id"), reply).alias("r")).select("item_id", "r.*")


@query(_FIRST + ", e AS (SELECT a0, a1, upper(gt_action) AS gt FROM r JOIN eval_items USING (item_id)) SELECT gt, count(*) AS n, round(avg((a0 <> a1)::INT), 4) AS changed, round(avg((a1 = gt)::INT), 4) AS accuracy FROM e GROUP BY 1")
def reflection_rate(spark, d):
    """How often a second look changes the decision, and how often it is right then, by true action."""
    r = reflection(spark, d).join(table(spark, d, "eval_items").select("item_id", F.upper("gt_action").alias("gt")), "item_id").withColumnRenamed("action", "pred")
    rate = r.groupBy("gt").agg(F.round(F.avg(F.col("changed").cast("int")), 4).alias("changed"))
    return E.accuracy_by(r, "gt").join(rate, "gt").select("gt", "n", "changed", "accuracy")


_USER = "list_filter(messages, lambda m: m.role = 'user')[1].content"


@query(f"""WITH s AS (SELECT ft_id, list_filter(messages, lambda m: m.role = 'assistant')[1].content AS c FROM ft_samples), l AS (SELECT ft_id, coalesce(trim(string_split(coalesce({s_strip("c")}, ''), chr(10))[1]), '') AS l FROM s)
SELECT ft_id, CASE WHEN l = '' THEN 'Could you say more about this?' WHEN right(l, 1) = '?' THEN l ELSE regexp_replace(l, '[.!\\s]+$', '') || '?' END AS question FROM l""")
def repaired_questions(spark, d):
    """The first line of each reply, made a question."""
    return table(spark, d, "ft_samples").select("ft_id", D.as_question(B.content_of(F.col("messages"), "assistant")).alias("question"))


@query(f"""WITH {S_SAMPLES}, x AS (SELECT id, list_filter(coalesce(known, []), lambda v: v IS NOT NULL) AS k, list_filter(coalesce(missing, []), lambda v: v IS NOT NULL) AS m, coalesce(query, '') AS q FROM s),
g AS (SELECT *, CASE WHEN len(m) > 0 THEN regexp_replace(regexp_replace('Details about ' || m[1], '^(details about|context for:|information about)\\s*', '', 'i'), '^[''" ]+|[''" ]+$', '', 'g') END AS gap, nullif(string_split_regex({s_strip("q")}, '\\s+')[1], '') AS w FROM x)
SELECT id, CASE WHEN len(m) = 0 THEN 'Could you say more about ' || coalesce(k[1], w, 'this topic') || '?' WHEN len(k) = 0 THEN 'What is ' || gap || '?' WHEN lower(k[1]) = lower(gap) THEN 'Could you say more about ' || k[1] || '?' ELSE 'On ' || k[1] || ': what is ' || gap || '?' END AS question FROM g""")
def asked_back(spark, d):
    """The question back for each sample's first gap."""
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: v.isNotNull())
    gaps = F.transform(clean("missing"), lambda m: F.concat(F.lit("Details about "), m))
    return samples(spark, d).select("id", B.question(gaps, clean("known"), F.col("query")).alias("question"))


@query(f"WITH {S_SAMPLES}, p AS (SELECT id, array_to_string(list_transform(docs, lambda t, i: '[' || i || '] ' || substr(coalesce(t, ''), 1, 800)), chr(10)) AS c, query, action, response FROM s WHERE docs IS NOT NULL) SELECT id, md5('So far:' || chr(10) || 'User: ' || coalesce(query, '') || chr(10) || 'Reply (' || coalesce(action, '') || '): ' || coalesce(response, '') || chr(10) || chr(10) || 'Query: ' || coalesce(query, '') || chr(10) || 'Context:' || chr(10) || c) AS prompt FROM p")
def answer_prompts(spark, d):
    """Prompts of the generator with a history of one turn, the sample's own."""
    own = F.array(F.struct("query", "action", "response"))
    return samples(spark, d).filter(F.col("docs").isNotNull()).select("id", F.md5(D.prompt(F.col("query"), F.col("docs"), own)).alias("prompt"))


@query("""WITH m AS (SELECT ft_id, array_to_string(list_transform(messages, lambda m: '[' || m.role || '] ' || coalesce(m.content, '')), chr(10)) AS t FROM ft_samples) SELECT ft_id, md5(regexp_extract(t, '(?s)^\\s*(?:\\S+\\s*){0,60}')) AS chat FROM m""")
def chat_texts(spark, d):
    """Each sample's messages as one text, cut after 60 words."""
    return table(spark, d, "ft_samples").select("ft_id", F.md5(B.chat_text(F.col("messages"), 60)).alias("chat"))


# ---------------------------------------------------------------- sinks and readers


def _folder(spark) -> str:
    return f"{runtime._scratch(spark)}/{uuid.uuid4().hex}"


@query(f"WITH {S_SAMPLES} SELECT id, query, source FROM s WHERE action IS NOT NULL")
def written_lines(spark, d):
    """Samples written as JSON lines without their action, and read back by a scan that tolerates broken lines."""
    s, path = samples(spark, d).filter("action IS NOT NULL").select("id", "query", "source", "action"), _folder(spark)
    T.write_lines(s, path, without=("action",))
    return T.read_lines(spark, path, "id string, query string, source string", tolerant=True)


@query(f"WITH {S_SAMPLES} SELECT id, source, turn_id FROM s WHERE source IS NOT NULL")
def written_by_source(spark, d):
    """Samples in a folder per source, read back with the folders' names as a column."""
    path = _folder(spark)
    T.write_by(samples(spark, d).filter("source IS NOT NULL").select("id", "source", "turn_id"), path, "source")
    return spark.read.parquet(path).select("id", F.col("source").cast("string").alias("source"), "turn_id")


@query("SELECT kb_id, md5(text) AS hash, num_linked FROM kb")
def written_array(spark, d):
    """Knowledge-base entries exported as JSON arrays, and read back as documents."""
    path = _folder(spark)
    T.write_array(table(spark, d, "kb").select("kb_id", F.md5("text").alias("hash"), "num_linked"), path)
    return T.read_document(spark, path, "kb_id string, hash string, num_linked int")


@query(f"WITH {S_SAMPLES}, q AS (SELECT id, {s_words('query')} AS w FROM s) SELECT id, len(w) AS words FROM q")
def resumed_fill(spark, d):
    """Words of queries counted in two runs of a fill that appends what isn't done yet, compacted at the end."""
    s, path = runtime.cut(samples(spark, d).select("id", "query")), _folder(spark)
    fill = lambda df: df.select("id", X.ws_count("query").cast("bigint").alias("words"))
    T.append_new(spark, s.filter("id < 'm'"), "id", path, fill)
    T.append_new(spark, s, "id", path, fill)
    return T.compact(spark, path, f"{path}-all")


@query(f"WITH {s_vectors('kv', 'SELECT kb_id AS k, text AS t FROM kb')} SELECT k AS kb_id, count(*) AS buckets, round(max(x) + 1e-9, 4) AS most FROM kv GROUP BY 1")
def stored_vectors(spark, d):
    """Vectors of the knowledge base, stored beside their ids and read back."""
    v = T.vectors(spark, table(spark, d, "kb").select("kb_id", "text"), "kb_id", "text", Providers().embed, _folder(spark))
    e = v.select("kb_id", F.filter("embedding", lambda x: x > 0).alias("e")).filter(F.size("e") > 0)
    return e.select("kb_id", F.size("e").cast("bigint").alias("buckets"), F.round(F.array_max("e").cast("double") + 1e-9, 4).alias("most"))


@query(SQL["overall_metrics"])
def written_metrics(spark, d):
    """The one row of metrics, written as JSON and read back."""
    m, path = QUERIES["overall_metrics"](spark, d), _folder(spark)
    T.write_lines(m, path)
    return T.read_document(spark, path, ", ".join(f"{n} {k}" for n, k in m.dtypes))


@query(SQL["kg_triple_edges"])
def stored_graph(spark, d):
    """A graph saved under one phase, and loaded where a later phase is looked for first."""
    e, path = QUERIES["kg_triple_edges"](spark, d), _folder(spark)
    T.save_graph({"nodes": e.select(F.col("src").alias("node")).distinct(), "edges": e, "bridges": e.select("kb_ids")}, path, "first")
    return T.load_graph(spark, path, "second", "first")["edges"]
