"""Seeds, paths, steps, trimming and sinks on small fixtures, against brute force where there is any."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import parse as P
from tessera.operators import chunk as C
from tessera.operators import ftset as B
from tessera.operators import gate as D
from tessera.operators import graph as G
from tessera.operators import grounding as N
from tessera.operators import sampling as S
from tessera.operators.providers import Providers, embed
from tessera.operators.retrieve import _Best, fan_out
from tessera.runtime import cut_counted, lookup, numbered_rows, widened
from tessera.sources import tables as T


def val(spark, c):
    return spark.range(1).select(c.alias("x")).collect()[0].x


def test_best_of_batches():
    rng = np.random.default_rng(1)
    for _ in range(200):
        q, k = rng.integers(1, 5), rng.integers(1, 6)
        best, s, d = _Best(q, k), np.zeros((q, 0)), np.zeros(0, int)
        for _ in range(rng.integers(1, 5)):
            n = rng.integers(1, 9)
            part, ids = rng.integers(0, 4, (q, n)).astype(float), rng.permutation(1000)[:n]
            part[rng.random((q, n)) < 0.4] = -np.inf
            best.add(part, ids)
            s, d = np.concatenate((s, part), 1), np.concatenate((d, ids))
        got = best.rows(list(range(q)))
        for i in range(q):
            assert sorted((-r.score, r.doc_id) for r in got[got.query_id == i].itertuples()) == sorted((-s[i, j], d[j]) for j in range(len(d)) if s[i, j] > -np.inf)[:k]
    assert _Best(2, 3).rows(["a", "b"]).empty


@pytest.mark.parametrize("block", [1, 4096])
def test_nearest_and_seeds(spark, block):
    left = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [0.6, 0.8])], "key string, v array<double>")
    right = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("w", [1.0, 0.0]), ("z", None)], "i string, v array<double>")
    got = {(r.key, r["match"]): (r.sim, r.rank) for r in N.nearest(left, "key", "v", right, "i", "v", 2, 0.5, block).collect()}
    assert got == {("a", "w"): (1.0, 1), ("a", "x"): (1.0, 2), ("b", "y"): (1.0, 1), ("d", "y"): (0.8, 1), ("d", "w"): (0.6, 2)}
    assert N.nearest(left.limit(0), "key", "v", right, "i", "v", 2, 0.5).count() == 0 == N.nearest(left, "key", "v", right.limit(0), "i", "v", 2, 0.5).count()
    s = spark.createDataFrame([("s1", "harbour", ["old town", None]), ("s2", None, None), ("s3", "nothing known of it", [])], "id string, query string, known array<string>")
    nodes = spark.createDataFrame([("harbour",), ("old town",), ("town",), (None,)], "node string")
    assert {(r.id, r.node) for r in N.seeds(s, "id", "query", "known", nodes, embed, hot_rows=1).collect()} == {("s1", "harbour"), ("s1", "old town"), ("s1", "town")}


def test_grounded_lines(spark):
    e = spark.createDataFrame([("town", "has", "harbour", 0.9), ("harbour", "lies_at", "sea", 0.5), ("far", "is", "away", 0.9)], "src string, relation string, dst string, weight double")
    var = spark.createDataFrame([("town", "?var_9"), ("far", "?var_1")], "src string, dst string")
    s = spark.createDataFrame([("s1", "has town harbour", "ASK"), ("s2", None, "ASK"), ("s3", "has town harbour", "ANSWER")], "id string, query string, action string")
    seeds = spark.createDataFrame([("s1", "town"), ("s3", "town"), ("s2", "town")], "id string, node string")
    got = [(r.id, r.triple) for r in N.grounded_lines(s, "id", "query", "action", seeds, e, var, embed, least=0.2).orderBy("id", "rank").collect()]
    assert got[0] == ("s1", "town | has | harbour") and ("s1", "town | requires | ?var_9") in got and not any(i == "s2" or "far" in t for i, t in got)
    assert not any(i == "s3" and "?var" in t for i, t in got)


@pytest.mark.parametrize("few", [0, 200_000])
def test_seed_triples_equal_brute_force(spark, few):
    rnd = random.Random(5)
    names = [f"n{i}" for i in range(14)]
    rows = [(a, rnd.choice(["has", "lies_at", None]), b, rnd.choice([0.2, 0.9, None])) for a, b in itertools.product(names, names) if rnd.random() < 0.12]
    rows += [rows[0], ("lone", "is", "lone", 0.1), (None, "is", "n1", 0.9), ("n1", "is", None, 0.9)]
    full = [(a, r, b, w) for a, r, b, w in rows if a and b]
    adj = {n: {b for a, _, b, _ in full if a == n} | {a for a, _, b, _ in full if b == n} for n in [*names, "lone"]}
    want = {}
    for s in [*names, "lone"]:
        near = {s} | adj[s] | {y for x in adj[s] for y in adj[x]}
        inside = [(-2.0 if w is None else w, f"{a} | {(r or 'related to').replace('_', ' ')} | {b}") for a, r, b, w in full if a in near and b in near]
        want |= {(s, i + 1): t for i, t in enumerate(list(dict.fromkeys(t for _, t in sorted(inside, reverse=True)[:6]))[:4])}
    e = spark.createDataFrame(rows, "src string, relation string, dst string, weight double")
    seeds = spark.createDataFrame([(n,) for n in [*names, "lone", "n1", "nowhere", None]], "node string")
    assert {(r.seed, r["rank"]): r.triple for r in G.seed_triples(e, seeds, look=6, most=4, few=few).collect()} == want
    assert G.seed_triples(e.limit(0), seeds, few=few).isEmpty() and G.seed_triples(e, seeds.limit(0), few=few).isEmpty()


def test_surroundings_of_a_hub_are_neither_stored_nor_broadcast(spark, monkeypatch):
    rows = [(f"leaf{i}", "near", "hub", float(i)) for i in range(300)]
    e = spark.createDataFrame(rows, "src string, relation string, dst string, weight double")
    seeds = e.filter("weight < 20").select(F.col("src").alias("node"))
    plan = G.seed_triples(e, seeds, few=299)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    monkeypatch.setattr(G, "ego", None)
    got = G.seed_triples(e, seeds).collect()
    assert len(got) == 480 and {r.triple for r in got if r["rank"] == 1} == {"leaf299 | near | hub"}


def test_pair_paths_equal_brute_force(spark):
    rnd = random.Random(3)
    names = [f"n{i}" for i in range(9)]
    edges = [(a, b) for a, b in itertools.product(names, names) if rnd.random() < 0.1]
    adj = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in names}

    def brute(a, b):
        for d in (1, 2, 3):
            found = [p for p in itertools.product([a], *[names] * (d - 1), [b]) if len(set(p)) == len(p) and all(y in adj[x] for x, y in zip(p, p[1:]))]
            if found:
                return list(min(found))

    want = {(a, b): p for a in names for b in names if a != b and (p := brute(a, b))}
    pairs = spark.createDataFrame(list(itertools.product(names, names)), "a string, b string")
    e = spark.createDataFrame(edges or [("x", "y")], "src string, dst string")
    assert {(r.a, r.b): r.path for r in G.pair_paths(e, pairs).collect()} == want
    assert G.pair_paths(e, pairs.limit(0)).count() == 0


def test_path_events(spark):
    e = spark.createDataFrame([("a", "b", ["k1"]), ("b", "c", ["k2"]), ("p", "q", ["k3"])], "src string, dst string, kb_ids array<string>")
    b = spark.createDataFrame([("k1", "a", 0), ("k1", "c", 1), ("k2", "b", 0), ("k3", "p", 0), ("k3", "q", 1), ("k4", "p", 0), ("k4", "a", 1)], "kb_id string, node string, pos int")
    sources = spark.createDataFrame([("k1", "hotpotqa"), ("k2", "hotpotqa"), ("k3", "quac"), ("k4", "hotpotqa"), ("k5", None)], "kb_id string, source string")
    links = spark.createDataFrame([("k1", "ANSWER", 1), ("k2", "ASK", 2), ("k3", "ABSTAIN", 3), ("k4", "ABSTAIN", 4)], "kb_id string, action string, ord bigint")
    events, lacking = G.path_events(b, sources, e, links)
    assert {(r.src, r.dst, r.action) for r in events.collect()} == {(x, y, "ANSWER") for x, y in (("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"))} | {("b", "c", "ASK"), ("p", "q", "ABSTAIN")}
    assert {r.node for r in lacking.collect()} == {"p"}


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_steps_by_ranges_equal_steps_in_order(spark, ranges):
    rnd = random.Random(8)
    events = [("s", "t", rnd.choice(["ANSWER", "ASK", "ABSTAIN", "ABSTAIN", None]), rnd.randrange(10**6)) for _ in range(60)] + [("u", "v", "ABSTAIN", 5)] * 12
    w = 0.7
    for *_, a, _o in sorted((x for x in events if x[0] == "s" and x[2]), key=lambda x: x[3]):
        w = min(0.95, w + 0.2) if a == "ANSWER" else min(0.95, w + 0.05) if a == "ASK" else max(0.0, w - 0.1)
    e = spark.createDataFrame([("s", "t", 0.7), ("u", "v", 0.7), ("none", "none2", 0.4)], "src string, dst string, weight double")
    ev = spark.createDataFrame(events, "src string, dst string, action string, ord bigint")
    got = {r.src: r.weight for r in G.reinforce(e, ev, ranges=ranges).collect()}
    assert abs(got["s"] - w) < 1e-6 and got["u"] == 0.0 and got["none"] == 0.4
    assert {r.weight for r in G.reinforce(e, ev.limit(0), ranges=ranges).collect()} == {0.7, 0.4}


def test_edges_without_chunks_take_those_of_their_ends(spark):
    e = spark.createDataFrame([("town", "sea", None, ["k1"]), ("town", "hill", "has", []), ("x", "y", "r", None)], "src string, dst string, relation string, kb_ids array<string>")
    kb = spark.createDataFrame([("k1", "town sea"), ("k2", "hill town"), ("k3", None)], "kb_id string, text string")
    m = spark.createDataFrame([("k1", "town"), ("k2", "town"), ("k2", "hill"), ("k3", "hill")], "kb_id string, node string")
    assert {(r.src, r.dst) for r in G.chunk_similarities(e, kb, embed).collect()} == {("town", "sea")}
    got = G.chunk_similarities(e, kb, embed, m).collect()
    assert sorted((r.src, r.dst) for r in got) == [("town", "hill"), ("town", "hill"), ("town", "sea")]
    assert {(r.src, r.dst): r.sem_score for r in G.sem_scores(e.withColumn("frequency", F.lit(0)), G.chunk_similarities(e, kb, embed, m)).collect()}[("town", "hill")] > 0.8


def test_chunk_triples_and_bridges(spark):
    t = spark.createDataFrame([("k", "a", "r", "b", "2"), ("k", "a", "r", "b", "1"), ("k", "c", "r", "d", "3"), ("j", "x", "r", "y", "1")], "kb_id string, s string, r string, o string, ord string")
    assert {(r.kb_id, r.rank, r.s) for r in G.chunk_triples(t, 1).collect()} == {("k", 1, "a"), ("j", 1, "x")}
    m = spark.createDataFrame([("k", "a", 0), ("k", "gone", 1), ("k", "b", 2)], "kb_id string, node string, pos int")
    assert {(r.node, r.pos) for r in G.bridges(m, spark.createDataFrame([("a",), ("b",)], "node string")).collect()} == {("a", 0), ("b", 1)}
    assert [val(spark, G.is_weak(F.lit(v))) for v in ("makes", "used", "goes", "built", "keeps")] == [True, True, True, False, True]
    assert [val(spark, G.valid_name(F.lit(v))) for v in ("the game", "three", "harbour", "12", None)] == [False, False, True, False, False]


def test_components_of_hubs(spark):
    e = spark.createDataFrame([("h", f"l{i}") for i in range(30)] + [("p", "q"), ("q", "r"), ("x", "x")], "src string, dst string")
    for few in (0, 50_000):
        got = {r.node: r.component for r in G.components(e, hot_rows=5, few=few).collect()}
        assert set(got.values()) == {"h", "p"} and len(got) == 34
        assert G.components(e.limit(0), few=few).count() == 0
    assert G.component_sizes(G.components(e)).collect()[0][:] == (2, 31)


def test_numbers_without_gaps(spark):
    df = spark.createDataFrame([(i % 7, f"r{i:03}") for i in range(300)], "k int, id string").repartition(6)
    got, n = cut_counted(numbered_rows(df, ["k", "id"], "at"))
    assert n == 300 and [r.id for r in got.orderBy("at").collect()] == [x for _, x in sorted((i % 7, f"r{i:03}") for i in range(300))]
    assert sorted(r["at"] for r in got.collect()) == list(range(300)) and numbered_rows(df.limit(0), ["id"], "at").count() == 0
    assert widened(df, most_bytes=0) is df


def test_lookup_of_hot_and_null_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(40)] + [("cold", 1), (None, 2), ("none", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", "H"), ("cold", "C"), (None, "N")], "k string, v string")
    got = sorted((r.k or "", r.i, r.v or "") for r in lookup(left, "k", right, hot_rows=5).collect())
    assert len(got) == 43 and got[0] == ("", 2, "") and ("cold", 1, "C") in got and ("none", 3, "") in got and sum(v == "H" for _, _, v in got) == 40


def test_contexts_and_links(spark):
    s = spark.createDataFrame([("2", "b", "ASK", "q2", "same text"), ("1", "a", "ANSWER", "q1", "same text"), ("3", "a", None, None, "same text"), ("4", "a", "ASK", "q4", " "), ("5", "a", "ASK", "q", None)], "id string, source string, action string, query string, ctx string")
    c = C.contexts(s, F.col("ctx"), F.col("id"))
    row = C.with_links(c, C.context_links(s, F.col("ctx"), F.col("id"))).collect()
    assert len(row) == 1 and row[0].source == "a" and row[0].num_linked == 3 and row[0].action_distribution == {"ANSWER": 1, "ASK": 1} and row[0].linked_sample_ids == ["1", "2", "3"]
    assert C.contexts(s.limit(0), F.col("ctx"), F.col("id")).count() == 0


def test_budgeted_trim_equals_a_plain_fold(spark):
    rnd = random.Random(5)
    rows = [(f"c{i}", "c", rnd.choice(["ANSWER", "ABSTAIN"]), None, i, False) for i in range(20)]
    rows += [(f"m{i}", "m", "ASK", None, i, False) for i in range(4)] + [(f"md{i}_{j}", "m", "ASK", f"md{i}", j, True) for i in range(6) for j in range(1 + i % 3)]
    rows += [(f"q{i}_{j}", "q", rnd.choice(["ANSWER", "ASK", "ABSTAIN", None]), f"q{i}", j, True) for i in range(40) for j in range(1 + i % 4)]
    t = S.Trim({"c": 6}, ("m", 9), ("q", 30), {"ANSWER": 14, "ASK": 15, "ABSTAIN": 9})
    h = lambda k: __import__("hashlib").md5(f"42|{k}".encode()).hexdigest()
    want = [r for r in sorted((r for r in rows if r[1] == "c"), key=lambda r: h(r[0]))[:6]] + [r for r in rows if r[1] == "m" and not r[5]]
    n = 4
    dlg = lambda s: sorted({r[3] for r in rows if r[1] == s and r[5]}, key=h)
    for d in dlg("m"):
        if n >= 9:
            break
        turns = [r for r in rows if r[3] == d]
        want, n = want + turns, n + len(turns)
    left = dict(t.budgets)
    for r in want:
        left[r[2]] = max(0, left[r[2]] - 1)
    added = 0
    for d in dlg("q"):
        turns = [r for r in rows if r[3] == d]
        count = {}
        for r in sorted(turns, key=lambda r: r[4]):
            count[r[2]] = count.get(r[2], 0) + 1
        first = {a: min(r[4] for r in turns if r[2] == a) for a in count}
        dom = min(count, key=lambda a: (-count[a], first[a], a or ""))
        if sum(left.values()) <= 0 or added >= 30:
            break
        if left.get(dom, 0) <= 0:
            continue
        want, added = want + turns, added + len(turns)
        for r in turns:
            if r[2]:
                left[r[2]] = max(0, left[r[2]] - 1)
    df = spark.createDataFrame(rows, "id string, source string, action string, dialogue_id string, turn_id int, multi_turn boolean")
    assert sorted(r.id for r in S.budgeted_trim(df, t).collect()) == sorted(r[0] for r in want)
    assert S.budgeted_trim(df.limit(0), t).count() == 0


def test_reflection(spark):
    ask = lambda reply: tuple(val(spark, D.reflected(F.lit("ANSWER"), F.lit("old"), F.lit(reply).cast("string"))))
    assert ask("VERIFIED_ACTION: ASK\nVERIFIED_RESPONSE: new") == ("ASK", "new", True)
    assert ask("VERIFIED_ACTION: ANSWER\nVERIFIED_RESPONSE: new") == ("ANSWER", "old", False)
    assert ask("VERIFIED_ACTION: maybe ASK") == ("ABSTAIN", "VERIFIED_ACTION: maybe ASK", True) and ask(None)[0] == "ABSTAIN"
    assert val(spark, P.action_line(F.lit("ACTION: ASK\nACTION: none"), "ACTION")) == "ASK"


def test_prompts_and_agents_share(spark):
    h = F.array(F.struct(F.lit("q1").alias("query"), F.lit("ASK").alias("action"), F.lit(None).cast("string").alias("response")))
    assert val(spark, D.prompt(F.lit("q"), F.array(F.lit("abcdef"), F.lit(None)), h, 3)) == "So far:\nUser: q1\nReply (ASK): \n\nQuery: q\nContext:\n[1] abc\n[2] "
    assert val(spark, D.prompt(F.lit(None).cast("string"), F.array().cast("array<string>"), F.slice(h, 1, 0))) == "Query: \nContext:\n"
    hits = spark.createDataFrame([("q", s, 4, f"d{s}{r}", 1.0, r) for s in range(4) for r in (1, 2, 3)], "query_id string, sub int, n_sub int, doc_id string, score double, rank int")
    assert fan_out(hits, 4).count() == 4 and fan_out(hits, 4, least=2).count() == 8


def test_specificity(spark):
    v = spark.createDataFrame([("further details",), ("harbour fee",), ("abc",), (None,), ("harbour fee",)], "v string")
    assert {r.value: r.specific for r in B.specificity(v, "v", Providers().embed).collect()} == {"further details": False, "harbour fee": True, "abc": False}
    gap = lambda t, a: val(spark, B.effective_missing(F.lit("who is it"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.array(F.lit(t)), F.lit(a)))
    assert gap("town | requires | ?unknown_1", "ASK") == ["details about 'town'"] and gap("town | requires | x?unknown_1", "ASK") == ["'who' referent for this query"]
    assert gap("a | b | c", "ABSTAIN") == ["information about 'who' absent from knowledge base"]


def test_graph_and_array_sinks(spark, tmp_path):
    nodes, edges, bridges = (spark.createDataFrame([("a", "b")], f"{x} string, y string") for x in ("node_id", "src", "kb_id"))
    T.save_graph({"nodes": nodes, "edges": edges, "bridges": bridges}, str(tmp_path), "p2")
    assert set(T.load_graph(spark, str(tmp_path), "p3", "p2")) == {"nodes", "edges", "bridges"}
    T.write_array(spark.range(5).repartition(2), f"{tmp_path}/arr")
    assert sorted(r.id for r in T.read_document(spark, f"{tmp_path}/arr", "id bigint").collect()) == list(range(5))
    v = T.vectors(spark, spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string"), "i", "t", embed, f"{tmp_path}/vec")
    assert v.count() == 2 and T.compact(spark, f"{tmp_path}/vec", f"{tmp_path}/one", 1).count() == 2
